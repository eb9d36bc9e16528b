"""Model-backed steps: candidate generation, the judges of answers and of absence, baseline and evaluation.

A step builds prompts as a column, asks a model inside the tasks (``providers``) and reads the answer back
into columns. A model is any function ``(prompt, system) -> text`` that can be sent to the tasks. Failures
are rows with an error or a cautious verdict, never lost rows. Rows come once for each input row; null
texts count as empty in a prompt; an empty table asks nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import ANSWER_TYPES, DIFFICULTIES, Generation, Run, Validation
from faultline.functions.text import candidate_id, is_abstention, strip
from faultline.operators import candidates, validation
from faultline.providers import answer, answer_json

Model = Callable[[str, str], str]

# The keys a model's answers must have, and the label of the prompts.
QA_KEYS = ("question", "gold_answer", "supporting_sentence", "answer_type", "difficulty", "reasoning_type")
VERDICT_KEYS = ("answerable", "answer_supported", "answer_unique", "question_clear")
READER = "Use nothing but the context. Give the shortest exact answer. If the context does not hold it, say: I don't know."
JSON_ONLY = "Answer with one JSON object and nothing else."

_LEVELS = {
    "easy": "Ask for one fact that a single sentence states: a name, a date, a number or a place.",
    "medium": "Ask for a fact that takes two neighbouring sentences, or a comparison, an order or an attribution.",
    "hard": "Put two conditions into the question, on a fact that stands among similar names, dates or numbers.",
}


def _filled(template: str, **columns: Column | str) -> Column:
    """The template with each {name} replaced by its column; braces in the values do no harm."""
    parts, rest = [], template
    for name in sorted(columns, key=lambda n: template.index("{" + n + "}")):
        before, rest = rest.split("{" + name + "}", 1)
        value = columns[name]
        parts += [F.lit(before), F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def generation_prompt(text: Column | str = "text", target: Column | str = "target") -> Column:
    level = F.col(target) if isinstance(target, str) else target
    told = F.lit(_LEVELS["easy"])
    for name, words in _LEVELS.items():
        told = F.when(level == name, words).otherwise(told)
    return _filled(
        "Write one question about facts that the passage below answers.\n{told}\n"
        "Copy the answer and one sentence that holds it from the passage, letter by letter. The question names neither the answer nor the passage, its title or its article, and needs no other text to be understood.\n"
        f"Keys: question, gold_answer, supporting_sentence, answer_type ({', '.join(ANSWER_TYPES)}), difficulty (" + "{level}), reasoning_type (single_fact, multi_sentence, multi_constraint), is_time_sensitive (true or false).\n\nPassage:\n{text}\n",
        told=told, level=F.when(level.isin(*DIFFICULTIES), level).otherwise("easy"), text=text,
    )


def verdict_prompt(text: Column | str = "chunk_text") -> Column:
    return _filled(
        "Passage:\n{text}\n\nQuestion: {q}\nAnswer: {a}\nSentence: {s}\n\n"
        "Keys: answerable (the passage alone answers the question), answer_supported (it supports this answer), answer_unique (no other answer fits as well), question_clear (the question stands alone and has one meaning), all true or false; confidence from 0 to 1.\n",
        text=text, q="question", a="gold_answer", s="supporting_sentence",
    )


def reader_prompt(context: Column | str) -> Column:
    return _filled("Context:\n{context}\n\nQuestion: {q}\nAnswer:", context=context, q="question")


def correctness_prompt(prediction: Column | str = "prediction") -> Column:
    return _filled("Question: {q}\nExpected answer: {g}\nGiven answer: {p}\n\nDo they mean the same? Keys: correct (true or false), confidence from 0 to 1.\n", q="question", g="gold_answer", p=prediction)


def absence_prompt(context: Column | str) -> Column:
    return _filled("Context:\n{context}\n\nQuestion: {q}\nExpected answer: {g}\n\nCan that answer be drawn from the context, if only by paraphrase or in part? Keys: answer_available (true or false), confidence from 0 to 1.\n", context=context, q="question", g="gold_answer")


def normalized_fields(data: Column, target: Column, enforce: bool) -> Column:
    """The question's fields of a map of texts, trimmed and held to the known values; null if one is missing."""
    of = lambda k: strip(F.coalesce(data[k], F.lit("")))
    known = lambda k, values, default: F.when(F.lower(of(k)).isin(*values), F.lower(of(k))).otherwise(default)
    level = known("difficulty", DIFFICULTIES, "easy")
    level = F.when(target.isin(*DIFFICULTIES), target).otherwise(level) if enforce else level
    made = F.struct(
        of("question").alias("question"), of("gold_answer").alias("gold_answer"), of("supporting_sentence").alias("supporting_sentence"), known("answer_type", ANSWER_TYPES, "other").alias("answer_type"),
        level.alias("difficulty"), F.when(of("reasoning_type") == "", "single_fact").otherwise(of("reasoning_type")).alias("reasoning_type"), (data["is_time_sensitive"] == "true").alias("is_time_sensitive"),
    )
    return F.when((of("question") != "") & (of("gold_answer") != "") & (of("supporting_sentence") != ""), made)


def remaining(done: DataFrame, cfg: Generation) -> dict[str, int]:
    """How many candidates of each difficulty are still wanted: three numbers."""
    want = candidates.allocation(done.sparkSession, [cfg.target_candidates], cfg.quotas).select("difficulty", "n")
    have = done.groupBy("difficulty").agg(F.count("*").alias("have"))
    rows = want.join(have, "difficulty", "left").select("difficulty", F.greatest(F.col("n") - F.coalesce("have", F.lit(0)), F.lit(0)).alias("n")).collect()
    return {k: next((r["n"] for r in rows if r["difficulty"] == k), 0) for k in DIFFICULTIES}


def fill(rows: list[tuple[int, str | None, str]], wanted: dict[str, int], enforce: bool) -> tuple[dict[int, str], int]:
    """(difficulty by slot, last slot looked at) of answers in order: each takes a place of its own level, or,
    if there is none, its target's (enforced) or the first open one; it ends when no place is left."""
    left, out, last = dict(wanted), {}, -1
    for slot, label, target in rows:
        if not sum(left.values()):
            break
        last = slot
        if label is None:
            continue
        if not left.get(label):
            label = target if enforce and left.get(target) else next(k for k, n in left.items() if n)
        out[slot] = label
        left[label] -= 1
    return out, last


def generate(chunks: DataFrame, model: Model, name: str, folder: str, cfg: Generation = Generation(), done: DataFrame | None = None, errors: DataFrame | None = None) -> dict[str, DataFrame]:
    """candidates (with those ``done``, up to the target), errors, raw. Twice as many chunks are asked as
    candidates are wanted, each for the difficulty of its slot; every answer is written to ``folder`` before
    the places are filled, so a later run (with ``done`` and ``errors``) asks nothing twice."""
    spark = chunks.sparkSession
    wanted = remaining(done, cfg) if done is not None else {k: 0 for k in DIFFICULTIES} | {r["difficulty"]: r["n"] for r in candidates.allocation(spark, [cfg.target_candidates], cfg.quotas).collect()}
    picked = candidates.round_robin(chunks, cfg)
    if done is not None:
        no_errors = spark.createDataFrame([], "chunk_id string")
        picked = candidates.pending(picked, done, errors if errors is not None else no_errors)
    asked = picked.withColumn("slot", F.row_number().over(Window.orderBy("slot")) - 1).where(F.col("slot") < 2 * sum(wanted.values()))
    slots = asked.count()
    plan = candidates.schedule(spark, slots, wanted).withColumnRenamed("difficulty", "target")
    asked = asked.join(F.broadcast(plan), "slot").withColumn("prompt", generation_prompt())
    answer_json(asked, model, JSON_ONLY, flags=("is_time_sensitive",)).write.mode("overwrite").parquet(f"{folder}/answers")
    told = spark.read.parquet(f"{folder}/answers")
    told = told.withColumn("fields", normalized_fields(F.col("data"), F.col("target"), cfg.enforce_target_difficulty))
    told = told.withColumn("error", F.coalesce("error", F.when(F.col("fields").isNull(), "missing_fields")))
    labels = [(r["slot"], r["label"], r["target"]) for r in told.select("slot", "fields.difficulty", F.when(F.col("error").isNull(), F.col("fields.difficulty")).alias("label"), "target").orderBy("slot").collect()]
    chosen, last = fill(labels, wanted, cfg.enforce_target_difficulty)
    places = spark.createDataFrame(list(chosen.items()), "slot int, label string")
    rows = told.join(F.broadcast(places), "slot").select(
        candidate_id(F.col("chunk_id"), F.col("fields.question")).alias("candidate_id"), "fields.question", "fields.gold_answer", "fields.supporting_sentence", "fields.answer_type", F.col("label").alias("difficulty"),
        "fields.reasoning_type", "fields.is_time_sensitive", F.struct("page_id", "revision_id", "page_title", "section_title", "chunk_id").alias("source"), "category_group",
        F.struct(F.lit(name).alias("generator_model"), F.lit(cfg.prompt_version).alias("prompt_version"), F.col("target").alias("target_difficulty")).alias("metadata"), "slot",
    )
    failed = told.where(F.col("error").isNotNull() & (F.col("slot") <= last)).select("chunk_id", "error", F.col("target").alias("target_difficulty"))
    out = rows if done is None else done.unionByName(rows, allowMissingColumns=True)
    # the answers as they came; long ones by a hash and their beginning
    short = F.when(F.length("answer") > 4000, F.concat(F.sha1(F.col("answer").cast("binary")), F.lit(":"), F.substring("answer", 1, 4000))).otherwise(F.col("answer"))
    return {"candidates": out, "errors": failed if errors is None else errors.unionByName(failed, allowMissingColumns=True), "raw": told.select("chunk_id", "target", short.alias("response"), "error")}


def signals(rows: DataFrame, chunks: DataFrame, judge: Model, reader: Model, cfg: Validation = Validation()) -> DataFrame:
    """The signals that ``validation.validate`` takes, for candidates that break no rule and whose chunk is
    known. A judge that fails says no to all with confidence 0; a reader that fails answers nothing."""
    found = validation.with_chunks(rows, chunks).where(F.col("chunk_text").isNotNull() & (F.size(validation.rule_reasons(cfg)) == 0))
    found = found.select("candidate_id", "question", "gold_answer", "supporting_sentence", "chunk_text")
    if cfg.use_answerability_judge:
        found = answer_json(found.withColumn("prompt", verdict_prompt()), judge, JSON_ONLY, flags=VERDICT_KEYS, numbers=("confidence",))
        for key in VERDICT_KEYS:
            found = found.withColumn(key, F.coalesce(F.col("data")[key] == "true", F.lit(False)))
        found = found.withColumn("judge_confidence", F.coalesce(F.col("data")["confidence"].cast("double"), F.lit(0.0))).drop("data", "answer", "error", "prompt")
    else:
        found = found.withColumns({k: F.lit(None).cast("boolean") for k in VERDICT_KEYS} | {"judge_confidence": F.lit(None).cast("double")})
    if cfg.use_baseline_test:
        found = answer(found.withColumn("prompt", reader_prompt("chunk_text")), reader, system=READER)
        found = found.withColumn("baseline_prediction", strip(F.col("answer"))).drop("answer", "error", "prompt")
        found = judged_correct(found, judge, "baseline_prediction", "baseline_judge")
    else:
        found = found.withColumns({"baseline_prediction": F.lit(None).cast("string"), "baseline_judge": F.lit(None).cast("boolean")})
    return found.select("candidate_id", *validation.SIGNALS)


def judged_correct(rows: DataFrame, judge: Model, prediction: str, out: str, when: Column | None = None) -> DataFrame:
    """Rows with ``out``: whether the judge takes the prediction for the gold answer; false if the judge fails,
    null where ``when`` does not hold (those are not asked)."""
    prompt = correctness_prompt(prediction)
    told = answer_json(rows.withColumn("prompt", prompt if when is None else F.when(when, prompt)), judge, JSON_ONLY, flags=("correct",), numbers=("confidence",))
    said = F.coalesce(F.col("data")["correct"] == "true", F.lit(False))
    return told.withColumn(out, F.when(F.col("prompt").isNotNull(), said)).drop("data", "answer", "error", "prompt")


def absence(cases: DataFrame, judge: Model) -> DataFrame:
    """failure_id, answerable, confidence of structurally valid cases, for ``verify.verify``; a judge that
    fails or does not say gives no row."""
    asked = cases.where("verification.injection_valid").select("failure_id", "question", "gold_answer", absence_prompt(F.array_join("contexts", "\n\n")).alias("prompt"))
    told = answer_json(asked, judge, JSON_ONLY, flags=("answer_available",), numbers=("confidence",))
    said = F.col("data")["answer_available"]
    return told.where(said.isNotNull()).select("failure_id", (said == "true").alias("answerable"), F.coalesce(F.col("data")["confidence"].cast("double"), F.lit(0.0)).alias("confidence"))


def answers(work: DataFrame, models: dict[str, Model], run: Run = Run(), judge: Model | None = None) -> DataFrame:
    """Jobs by model with model_name, prediction, provider_error and, with a judge, llm_judge_correct for
    answers that are not abstentions. A model that fails answers nothing, which counts as abstention."""
    parts = None
    for name, model in models.items():
        told = answer(work.withColumns({"model_name": F.lit(name), "prompt": reader_prompt("context")}), model, system=READER)
        parts = told if parts is None else parts.unionByName(told)
    out = parts.withColumn("prediction", strip(F.col("answer"))).withColumnRenamed("error", "provider_error").drop("answer", "prompt")
    if judge is None or not run.evaluation.use_llm_judge:
        return out
    return judged_correct(out, judge, "prediction", "llm_judge_correct", ~is_abstention(F.col("prediction"), run.abstain_markers))
