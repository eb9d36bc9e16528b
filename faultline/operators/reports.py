"""Report tables and their text: funnels, galleries, review packs, CSV projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import format_number, format_percent, keyed
from faultline.operators import metrics, validation


def failure_distribution(cases: DataFrame) -> DataFrame:
    return cases.groupBy("failure_type", "severity").agg(F.count("*").alias("count"))


def evaluation_csv(results: DataFrame) -> DataFrame:
    """The flat projection of results: nulls empty, predictions on one line and at most 300 characters."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = ["eval_id", "sample_id", "model_name", "condition", "severity", "exact_match", "token_f1", "semantic_similarity", "llm_judge_correct", "abstained", "hallucinated", "gold_answer"]
    return results.select(*(text(c).alias(c) for c in plain), F.substring(F.replace(text("prediction"), F.lit("\n"), F.lit(" ")), 1, 300).alias("prediction"))


def review_sample(cases: DataFrame, seed: int, per_cell: int = 17) -> DataFrame:
    """Up to ``per_cell`` cases of each type and severity, by keyed hash: a sample for annotators."""
    w = Window.partitionBy("failure_type", "severity").orderBy(keyed(seed, F.col("failure_type"), F.col("severity"), F.col("failure_id")), "failure_id")
    return cases.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= per_cell).drop("_rank")


def _blank(*names: str) -> list[Column]:
    return [F.lit("").alias(n) for n in names]


def seed_review(seeds: DataFrame) -> DataFrame:
    """Seeds with empty columns for an annotator's decisions."""
    s = F.col("source")
    return seeds.select("sample_id", "question", "gold_answer", "supporting_sentence", "answer_type", "difficulty", "category_group", "quality_score", s["page_title"].alias("page_title"), s["chunk_id"].alias("chunk_id"), *_blank("decision", "question_clear", "answer_in_evidence", "answer_unique", "needs_title", "time_sensitive_ok", "notes"))


def failure_review(cases: DataFrame, seed: int, per_cell: int = 17) -> DataFrame:
    rows = review_sample(cases, seed, per_cell)
    return rows.select("failure_id", "parent_seed_id", "failure_type", "severity", "question", "gold_answer", "supporting_sentence", F.array_join("contexts", "\n---\n").alias("contexts"), "answer_available", "expected_behavior", *_blank("human_injection_valid", "human_label_correct", "severity_ok", "issue_code", "notes"))


def gallery(cases: DataFrame, per_type: int = 3) -> DataFrame:
    """The first cases of each type, with the beginnings of their first contexts."""
    w = Window.partitionBy("failure_type").orderBy("failure_id")
    shown = F.transform(F.slice("contexts", 1, 3), lambda c: F.substring(c, 1, 80))
    return cases.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= per_type).select("failure_type", "severity", "failure_id", "question", "gold_answer", shown.alias("contexts"))


def _lines(df: DataFrame, order: list[str], hide: str = "") -> str:
    """A small report table (groups, not rows of data) as markdown."""
    rows = (df.orderBy(*order) if order else df).drop(hide).collect()
    df = df.drop(hide)
    head = "| " + " | ".join(df.columns) + " |\n|" + " - |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)])


def evaluation_report(results: DataFrame) -> str:
    conditions = metrics.by_condition(results)
    parts = ["# Evaluation", _lines(metrics.robustness(conditions), ["model_name"]), _lines(conditions, ["model_name", "condition"]), _lines(metrics.by_severity(results), ["model_name", "condition", "severity"])]
    return "\n\n".join(parts) + "\n"


def validation_report(candidates: DataFrame, results: DataFrame, chosen: DataFrame) -> str:
    """Funnel, rejection reasons, and the kinds of seeds, the frequent ones first."""
    falling = lambda df: _lines(df.withColumn("_n", -F.col("n")), ["_n", df.columns[-2]], hide="_n")
    known = validation.overview(results)
    funnel = known.crossJoin(chosen.agg(F.count("*").alias("seeds"))).crossJoin(candidates.agg(F.count("*").alias("generated"))).select("generated", "accepted", "rejected", "seeds")  # one row by one row
    reasons = validation.reason_counts(results.where("not accepted")).select("reason", "n")
    parts = ["# Validation", _lines(funnel, []), "## Rejection reasons", falling(reasons)]
    for c in ("category_group", "difficulty", "answer_type"):
        parts += [f"## Seeds by {c}", falling(metrics.distribution(chosen, c))]
    return "\n\n".join(parts) + "\n"


def contribution_report(results: DataFrame, parts: DataFrame) -> str:
    """What each validation layer rejected, mean and deviation over runs, and each run with its top reasons.
    ``results`` has ``run_id``; ``parts`` is runs.contributions of it."""
    wide = parts.groupBy("component").agg(*(F.struct(F.avg(c).alias("mean"), F.when(F.count(c) > 1, F.stddev_samp(c)).alias("std")).alias(c) for c in ("rejected", "unique_rejections")))
    shown = wide.select("component", *(format_number(F.col(c)["mean"], F.col(c)["std"]).alias(c) for c in ("rejected", "unique_rejections")))
    out = ["# Validation layers", _lines(shown, ["component"])]
    for run in [r.run_id for r in parts.select("run_id").distinct().orderBy("run_id").collect()]:
        mine = results.where(F.col("run_id") == run)
        top = validation.top_reasons(mine.where("not accepted"), 3)
        out += [f"## {run}", _lines(validation.overview(mine), []), _lines(parts.where(F.col("run_id") == run).drop("run_id"), ["component"]), _lines(top, ["component", "rank"])]
    return "\n\n".join(out) + "\n"


def stability_report(runs: DataFrame, rates: tuple[str, ...], counts: tuple[str, ...]) -> str:
    """Mean and deviation of rates in per cent and of counts, and the runs themselves."""
    show = lambda names, form: _lines(metrics.mean_std(runs, *names).withColumn("shown", form(F.col("mean"), F.col("std"))), ["metric"])
    return "\n\n".join(["# Stability", show(rates, format_percent), show(counts, format_number), "## Runs", _lines(runs, ["run_id"])]) + "\n"
