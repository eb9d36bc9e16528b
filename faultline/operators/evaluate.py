"""Model evaluation: jobs, readers, scored answers, merge with earlier results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import Run
from faultline.functions.similarity import semantic_similarity
from faultline.functions.text import contains_answer, exact_match, is_abstention, normalize_model_id, strip, token_f1, words


def jobs(seeds: DataFrame, failures: DataFrame) -> DataFrame:
    """One job per clean seed (with clean_contexts) and per failure case, numbered: seeds first."""
    full = lambda c: F.filter(c, lambda t: t.isNotNull() & (strip(t) != ""))
    context = F.when(F.size("clean_contexts") > 0, F.array_join(full("clean_contexts"), "\n\n")).otherwise(F.col("supporting_sentence"))
    clean = seeds.select("sample_id", F.lit("clean").alias("condition"), F.lit(None).cast("string").alias("severity"), context.alias("context"), "clean_contexts", "question", "gold_answer", F.lit(True).alias("answer_available"), F.lit("answer").alias("expected_behavior"), F.lit(0).alias("part"))
    failed = failures.select(F.col("failure_id").alias("sample_id"), F.col("failure_type").alias("condition"), "severity", F.array_join("contexts", "\n\n").alias("context"), F.col("contexts").alias("clean_contexts"), "question", "gold_answer", "answer_available", "expected_behavior", F.lit(1).alias("part"))
    every = clean.unionByName(failed).withColumnRenamed("clean_contexts", "contexts")
    return every.withColumn("number", F.row_number().over(Window.orderBy("part", "condition", "sample_id")) - 1).drop("part")


#: Offline readers, as expressions over a job: they stand in for models.
READERS = {
    "reader_gold": lambda: F.when(contains_answer(F.col("context"), F.col("gold_answer")), F.col("gold_answer")).otherwise("I don't know"),
    "reader_first": lambda: F.coalesce(F.array_join(F.slice(words(F.get("contexts", F.lit(0))), 1, 3), " "), F.lit("")),
    "reader_abstain": lambda: F.lit("I don't know"),
}


def answer_offline(work: DataFrame, readers: tuple[str, ...] = tuple(READERS)) -> DataFrame:
    """Every job by every offline reader: adds model_name and prediction."""
    each = F.array(*(F.struct(F.lit(n).alias("model_name"), READERS[n]().alias("prediction")) for n in readers))
    return work.withColumn("_a", F.explode(each)).select("*", "_a.model_name", "_a.prediction").drop("_a")


def correct(em: Column, f1: Column, judge: Column) -> Column:
    return F.coalesce(judge, F.lit(False)) | (em >= 1) | (f1 >= 0.6)


def score(answers: DataFrame, run: Run = Run(), similarity: bool = True) -> DataFrame:
    """Evaluation results of answers (jobs with model_name, prediction and, if judged, llm_judge_correct)."""
    rows = answers if "llm_judge_correct" in answers.columns else answers.withColumn("llm_judge_correct", F.lit(None).cast("boolean"))
    p, g = F.col("prediction"), F.col("gold_answer")
    rows = rows.withColumns({"abstained": is_abstention(p, run.abstain_markers), "exact_match": exact_match(p, g), "token_f1": token_f1(p, g), "semantic_similarity": semantic_similarity(p, g) if similarity else F.lit(None).cast("double")})
    rows = rows.withColumn("correct", correct(F.col("exact_match"), F.col("token_f1"), F.col("llm_judge_correct")))
    wrong = ~F.col("correct") & ~F.col("abstained") & ~contains_answer(p, g)
    rows = rows.withColumn("hallucinated", F.when(~F.col("answer_available"), ~F.col("abstained")).otherwise(wrong))
    ident = F.concat(F.lit("eval_"), normalize_model_id(F.col("model_name")), F.lit("_"), F.lpad(F.col("number").cast("string"), 6, "0"))
    return rows.select(ident.alias("eval_id"), "sample_id", "model_name", "condition", "severity", "prediction", "gold_answer", "exact_match", "token_f1", "semantic_similarity", "llm_judge_correct", "abstained", "hallucinated", "expected_behavior", "answer_available", "correct")


def merge(earlier: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier results of models that were not run again (any case), and the new ones."""
    again = new.select(F.lower("model_name").alias("_m")).distinct()
    return earlier.join(again, F.lower("model_name") == F.col("_m"), "left_anti").unionByName(new)
