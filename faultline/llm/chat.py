"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted (by turn, then role, then text, so ties
have one order); adjacent turns of one role become a run, by slices of the sorted array; runs are
concatenated as ``<|role|>text<sep>text</s>``. Control strings inside texts and roles are broken by a
backslash after their first character, and backslashes are doubled, so that no text can hold a control
string and ``read_back`` restores every turn. All steps are linear in the length of a conversation.

The loss mask covers the texts of ``assistant`` turns, without marks: as (chars, loss) pieces in order.

Null roles and texts count as empty ones; a null conversation id is a conversation of its own; repeated
rows are turns like others; an empty table gives no conversation. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The marks of this template, and those of others that texts may imitate.
OPEN, SHUT, JOINT, END = "<|", "|>", "<sep>", "</s>"
CONTROLS = (OPEN, SHUT, JOINT, END, "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"

_META = {"|": r"\|", "[": r"\[", "]": r"\]"}
_quoted = lambda s: "".join(_META.get(c, c) for c in s)
#: The first character of a control string, if the rest follows.
_START = "|".join(f"(?:{_quoted(c[0])}(?={_quoted(c[1:])}))" for c in CONTROLS)


def escape(text: Column) -> Column:
    """Double each backslash, then put one after each start of a control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_START})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def gather(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per conversation: its id and ``runs``, array of (role, texts)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col(turn_column).alias("turn"), empty(role_column).alias("role"), empty(text_column).alias("text"))
    rows = turns.groupBy(id_column).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    count = F.size("turns")
    starts = F.filter(F.sequence(F.lit(1), count), lambda k: (k == 1) | (F.get("turns", k - 1)["role"] != F.get("turns", k - 2)["role"]))
    rows = rows.withColumn("starts", starts)
    stop = lambda i: F.coalesce(F.get("starts", i + 1), count + 1)
    runs = F.transform("starts", lambda s, i: F.struct(F.get("turns", s - 1)["role"].alias("role"), F.transform(F.slice("turns", s, stop(i) - s), lambda t: t["text"]).alias("texts")))
    return rows.select(id_column, runs.alias("runs"))


def formatted(runs: Column) -> Column:
    one = lambda r: F.concat(F.lit(OPEN), escape(r["role"]), F.lit(SHUT), F.array_join(F.transform(r["texts"], escape), JOINT), F.lit(END))
    return F.array_join(F.transform(runs, one), "")


def mask(runs: Column) -> Column:
    """array of (chars, loss) pieces that add up to the formatted text."""
    piece = lambda chars, loss: F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))
    no = F.lit(False)

    def one(r: Column) -> Column:
        head = F.array(piece(F.length(escape(r["role"])) + len(OPEN) + len(SHUT), no))
        texts = F.transform(r["texts"], lambda t, i: F.array(piece(F.when(i > 0, len(JOINT)).otherwise(0), no), piece(F.length(escape(t)), r["role"] == LOSS_ROLE)))
        return F.concat(head, F.flatten(texts), F.array(piece(F.lit(len(END)), no)))

    return F.filter(F.flatten(F.transform(runs, one)), lambda p: p["chars"] > 0)


def chats(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """One row per conversation: id, ``formatted`` and ``mask``."""
    return gather(turns, id_column).select(id_column, formatted(F.col("runs")).alias("formatted"), mask(F.col("runs")).alias("mask"))


def read_back(text: Column) -> Column:
    """array of (role, texts) from a formatted conversation."""
    runs = F.split(text, END)
    return F.transform(
        F.slice(runs, 1, F.size(runs) - 1),  # nothing follows the last mark
        lambda r: F.struct(
            unescape(F.substr(F.substring_index(r, SHUT, 1), F.lit(len(OPEN) + 1))).alias("role"),
            F.transform(F.split(F.substr(r, F.instr(r, SHUT) + len(SHUT)), JOINT), unescape).alias("texts"),
        ),
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are made of control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(text).alias("text"))


def digest(turns: DataFrame) -> DataFrame:
    """The query's rows, all read back from the formatted text."""
    every = turns.select("conv_id", "turn", "role", "text").unionByName(probe(turns.sparkSession))
    rows = gather(every).select("conv_id", formatted(F.col("runs")).alias("formatted")).withColumn("back", read_back(F.col("formatted")))
    told = F.array_join(F.transform("back", lambda r: F.array_join(F.transform(r["texts"], lambda t: F.concat(r["role"], F.lit("\n"), t, F.lit("\n"))), "")), "")
    loss = F.array_join(F.transform(F.filter("back", lambda r: r["role"] == LOSS_ROLE), lambda r: F.array_join(r["texts"], "")), "")
    return rows.select(
        "conv_id",
        F.aggregate("back", F.lit(0).cast("long"), lambda a, r: a + F.size(r["texts"])).alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digest_sql() -> str:
    """The same in SQL; an escaped text is longer by its backslashes and its control strings."""
    longer = lambda c: f"length({c}) + " + " + ".join(f"(length({c}) - length(replace({c}, '{s}', ''))) // {len(s)}" for s in ("\\", *CONTROLS))
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, '{LOSS_ROLE}', '</s>[INST] ok [/INST]')),
m AS (
  SELECT *, {longer("text")} AS text_chars, {longer("role")} AS role_chars,
         row_number() OVER w = 1 OR role <> lag(role) OVER w AS opens
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN opens THEN role_chars + {len(OPEN + SHUT + END)} ELSE {len(JOINT)} END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
