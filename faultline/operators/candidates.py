"""Question candidates: chunk choice, difficulty allocation and schedule, and an extractive generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.config import DIFFICULTIES, Generation
from faultline.functions.text import candidate_id, split_sentences, strip, words

# Months that hint at a date.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def is_good_chunk(cfg: Generation = Generation()) -> Column:
    """Long enough, within the token bounds, and with a number, a date or two capitalised words."""
    t = F.col("text")
    # the cheapest sign first, as one is enough: boundaries and words in any case are tried at every character
    signal = t.rlike("(?s)[A-Z][a-z].*?[A-Z][a-z]") | t.rlike(r"(?U)\b\d{2,}\b") | t.rlike(rf"(?iU)\b(1\d{{3}}|20\d{{2}})\b|\b({MONTHS})\b")
    lead = F.lower(strip(F.col("section_title"))) == "lead"
    return F.col("token_count").between(cfg.min_chunk_tokens, cfg.max_chunk_tokens) & (~lead if cfg.skip_lead_sections else F.lit(True)) & (F.length(t) >= 120) & signal


def round_robin(chunks: DataFrame, cfg: Generation = Generation()) -> DataFrame:
    """The good chunks, one of each page in turn, with their ``slot`` from 0; the first of them only, as
    many as the settings allow. The global order is taken from the top rows alone."""
    turn = Window.partitionBy("page_id").orderBy("paragraph_index", "chunk_index")
    top = chunks.where(is_good_chunk(cfg)).withColumn("turn", F.row_number().over(turn)).orderBy("turn", "page_id").limit(cfg.max_candidate_chunks)
    return top.withColumn("slot", F.row_number().over(Window.orderBy("turn", "page_id")) - 1)


def allocation(spark: SparkSession, totals: list[int], quotas: dict[str, float]) -> DataFrame:
    """total, difficulty, n: whole shares first, one more by the largest remainders; then each listed level
    that has none gets one from the largest, if there are candidates for all. Without any quota all is easy."""
    known = [(k, float(max(v, 0.0)), i) for i, (k, v) in enumerate(quotas.items()) if k in DIFFICULTIES]
    known = known if sum(v for _, v, _ in known) > 0 else [("easy", 1.0, 0)]
    listed = spark.createDataFrame([*known, *((k, 0.0, None) for k in DIFFICULTIES if k not in dict((x[0], x) for x in known))], "difficulty string, quota double, place int")
    rows = listed.withColumn("total", F.explode(F.array(*(F.lit(n).cast("long") for n in totals))))
    of = Window.partitionBy("total")
    rows = rows.withColumn("exact", F.col("total") * (F.col("quota") / F.sum("quota").over(of))).withColumn("n", F.floor("exact"))
    by_rest = of.orderBy(F.col("place").isNull(), F.desc(F.col("exact") - F.col("n")), F.desc("quota"), "place")
    rows = rows.withColumn("n", F.col("n") + (F.row_number().over(by_rest) <= F.col("total") - F.sum("n").over(of)).cast("long"))
    bare = (F.col("n") == 0) & F.col("place").isNotNull() & (F.col("total") >= F.count("place").over(of))
    rows = rows.withColumns({"bare": bare.cast("long"), "size": F.row_number().over(of.orderBy(F.desc("n"), "place"))})
    given = F.when(F.col("size") == 1, F.sum("bare").over(of)).otherwise(0)
    return rows.select("total", "difficulty", (F.col("n") + F.col("bare") - given).alias("n"))


def schedule(spark: SparkSession, total: int, quotas: dict[str, float]) -> DataFrame:
    """slot, difficulty: easy, medium, hard in turn while each lasts."""
    level = F.array_position(F.array(*map(F.lit, DIFFICULTIES)), F.col("difficulty"))
    each = allocation(spark, [total], quotas).where("n > 0").select("difficulty", level.alias("level"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    return each.select((F.row_number().over(Window.orderBy("k", "level")) - 1).alias("slot"), "difficulty")


def generate(chunks: DataFrame, cfg: Generation = Generation()) -> DataFrame:
    """Candidates by the offline generator: the longest sentence of six words or more with its longest
    word masked. Chunks without such a sentence give none; the target bounds the result."""
    sentences = F.filter(split_sentences(F.col("text")), lambda s: F.size(words(s)) >= 6)
    longest = lambda items: F.array_sort(F.transform(items, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s"))))
    rows = round_robin(chunks, cfg).withColumn("support", F.get(longest(sentences), F.lit(0))["s"]).where("support is not null")
    bare = F.filter(F.transform(words(F.col("support")), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")
    rows = rows.withColumn("gold", F.get(longest(bare), F.lit(0))["s"]).where("gold is not null")
    at = F.instr("support", F.col("gold"))
    masked = F.concat(F.substring("support", F.lit(1), at - 1), F.lit("____"), F.substr("support", at + F.length("gold")))
    rows = rows.withColumns({"question": F.concat(F.lit("Which word completes: "), masked), "slot": F.row_number().over(Window.orderBy("slot")) - 1}).where(F.col("slot") < cfg.target_candidates)
    plan = schedule(rows.sparkSession, cfg.target_candidates, cfg.quotas)
    out = rows.join(F.broadcast(plan), "slot")
    return out.select(
        candidate_id(F.col("chunk_id"), F.col("question")).alias("candidate_id"), "question", F.col("gold").alias("gold_answer"), F.col("support").alias("supporting_sentence"),
        F.when(F.col("gold").rlike(r"\d"), "numeric").otherwise("other").alias("answer_type"), "difficulty", F.lit("single_fact").alias("reasoning_type"), F.lit(False).alias("is_time_sensitive"),
        F.struct("page_id", "revision_id", "page_title", "section_title", "chunk_id").alias("source"), "category_group", "slot",
    )


def pending(chunks: DataFrame, done: DataFrame, errors: DataFrame) -> DataFrame:
    """Chunks not yet generated from and without a recorded error: what a resumed run still has to do."""
    seen = done.select(F.col("source.chunk_id").alias("chunk_id")).unionByName(errors.select("chunk_id"))
    return chunks.join(seen, "chunk_id", "left_anti")
