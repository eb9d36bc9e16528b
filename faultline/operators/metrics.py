"""Metrics of evaluation results, of whole runs, and over several runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.evaluate import correct


def rate(part: Column, of: Column) -> Column:
    """A quotient; null without a positive denominator."""
    return F.when(of > 0, part / of)


def _mean(c: Column) -> Column:
    """Mean of the non-null values as a decimal sum and one division, so that no order of rows shows."""
    return F.round(F.coalesce(F.sum(c.cast("decimal(18,10)")).cast("double") / F.count(c), F.lit(0.0)), 4)


def by_condition_and_severity(results: DataFrame) -> DataFrame:
    """Grouping sets of one pass: (model, condition), and (model, condition, severity) for failed ones."""
    rows = results.withColumn("ok", correct(F.col("exact_match"), F.col("token_f1"), F.col("llm_judge_correct")).cast("int"))
    rows = rows.withColumn("severity", F.coalesce("severity", F.lit("")))
    out = rows.groupingSets([["model_name", "condition"], ["model_name", "condition", "severity"]], "model_name", "condition", "severity").agg(
        F.count("*").alias("n"), _mean(F.col("ok")).alias("accuracy"), _mean(F.col("exact_match")).alias("exact_match"), _mean(F.col("token_f1")).alias("token_f1"),
        _mean(F.col("abstained").cast("int")).alias("abstention_rate"), _mean(F.col("hallucinated").cast("int")).alias("hallucination_rate"), F.grouping("severity").alias("whole"),
    )
    return out.where((F.col("whole") == 1) | ((F.col("condition") != "clean") & (F.col("severity") != "")))


def by_condition(results: DataFrame) -> DataFrame:
    return by_condition_and_severity(results).where("whole = 1").drop("whole", "severity")


def by_severity(results: DataFrame) -> DataFrame:
    return by_condition_and_severity(results).where("whole = 0").drop("whole")


def performance_drop(conditions: DataFrame) -> DataFrame:
    """model_name, condition, accuracy, drop: clean accuracy (0 if missing) less the condition's."""
    clean = conditions.where("condition = 'clean'").select("model_name", F.col("accuracy").alias("_clean"))
    rest = conditions.where("condition <> 'clean'").join(clean, "model_name", "left")
    return rest.select("model_name", "condition", "accuracy", F.round(F.coalesce("_clean", F.lit(0.0)) - F.col("accuracy"), 4).alias("performance_drop"))


def robustness(conditions: DataFrame) -> DataFrame:
    """model_name, clean_accuracy, robustness_score: one less the mean drop; 1 without conditions."""
    drops = performance_drop(conditions).groupBy("model_name").agg(F.round(F.avg(F.col("performance_drop").cast("decimal(10,4)")).cast("double"), 4).alias("mean_drop"))
    models = conditions.groupBy("model_name").agg(F.coalesce(F.max(F.when(F.col("condition") == "clean", F.col("accuracy"))), F.lit(0.0)).alias("clean_accuracy"))
    return models.join(drops, "model_name", "left").select("model_name", "clean_accuracy", F.coalesce(F.round(1 - F.col("mean_drop"), 4), F.lit(1.0)).alias("robustness_score"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Rows by value, null as ``unknown``."""
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def run_metrics(counts: DataFrame) -> DataFrame:
    """Rates of runs from one row of counts each: candidates, errors, accepted, rejected, seeds, valid, invalid."""
    validated = F.col("accepted") + F.col("rejected")
    return counts.select(
        "run_id", "candidates", "accepted", "rejected", "seeds",
        rate(F.col("candidates"), F.col("candidates") + F.col("errors")).alias("schema_success_rate"),
        rate(F.col("accepted"), F.when(validated > 0, validated).otherwise(F.col("candidates"))).alias("qa_acceptance_rate"),
        rate(F.col("seeds"), F.col("candidates")).alias("clean_seed_yield"),
        rate(F.col("valid"), F.col("valid") + F.col("invalid")).alias("failure_verification_pass_rate"),
    )


def mean_std(rows: DataFrame, *columns: str) -> DataFrame:
    """metric, n, mean, std over rows: the sample deviation, 0 for one value, null for none."""
    names = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    long = rows.selectExpr(f"stack({len(columns)}, {names}) as (metric, value)")
    std = F.when(F.count("value") == 1, 0.0).otherwise(F.stddev_samp("value"))
    return long.groupBy("metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(std, 6).alias("std"))


def human_rate(decisions: DataFrame, column: str, positive: str) -> DataFrame:
    """One row: share of ``positive`` among non-blank decisions; null without any."""
    said = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    kept = F.when(said != "", (said == positive.lower()).cast("double"))
    return decisions.agg(F.count(kept).alias("n"), F.avg(kept).alias("rate"))
