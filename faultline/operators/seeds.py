"""Clean seeds: stratified choice by category, difficulty and quality, and their clean contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import DIFFICULTIES, Run
from faultline.functions.text import keyed
from faultline.operators.pools import attach_pools

#: The share of each difficulty within a category.
TARGETS = {"easy": 0.40, "medium": 0.40, "hard": 0.20}


def select_seeds(accepted: DataFrame, run: Run) -> DataFrame:
    """At most the target of accepted candidates, numbered ``sample_id``.

    Each category takes its share: the best of each difficulty up to its (half-even) quota, then the best
    of the rest; the best of all remaining candidates fill up. Ties go by a keyed hash.
    """
    target = run.validation.target_clean_seeds
    share = max(target // len(run.categories), 1)
    tie = keyed(run.seed, F.lit("seed"), F.col("candidate_id"))
    best = [F.desc(F.coalesce("quality_score", F.lit(0.0))), tie, "candidate_id"]
    want = F.lit(0)
    for level, ratio in TARGETS.items():
        want = F.when(F.col("level") == level, F.lit(round(share * ratio))).otherwise(want)
    level = F.when(F.col("difficulty").isin(*DIFFICULTIES), F.col("difficulty")).otherwise("easy")
    rows = accepted.withColumns({"level": level, "known": F.col("category_group").isin(*run.categories)})
    rows = rows.withColumn("in_level", F.row_number().over(Window.partitionBy("known", "category_group", "level").orderBy(*best)))
    rows = rows.withColumn("first", F.col("known") & (F.col("in_level") <= want))
    rows = rows.withColumn("in_category", F.row_number().over(Window.partitionBy("known", "category_group").orderBy(F.desc("first"), *best)))
    rows = rows.withColumn("chosen", F.col("known") & (F.col("in_category") <= share))
    # only the target's number of rows is ever numbered in one place
    top = rows.orderBy(F.desc("chosen"), F.when(F.col("chosen"), F.col("category_group")), F.when(F.col("chosen"), F.col("in_category")), *best).limit(target)
    order = Window.orderBy(F.desc("chosen"), F.when(F.col("chosen"), F.col("category_group")), F.when(F.col("chosen"), F.col("in_category")), *best)
    numbered = top.withColumn("number", F.row_number().over(order) - 1)
    return numbered.select(
        F.concat(F.lit("seed_"), F.lpad(F.col("number").cast("string"), 6, "0")).alias("sample_id"), "candidate_id", "question", "gold_answer", "supporting_sentence", "answer_type", "difficulty",
        "reasoning_type", "is_time_sensitive", "source", "category_group", F.coalesce("quality_score", F.lit(1.0)).alias("quality_score"),
    )


def clean_contexts(seeds: DataFrame, chunks: DataFrame, run: Run, pooled: DataFrame | None = None) -> DataFrame:
    """Add clean_contexts: the gold chunk, its neighbours, then easy fillers up to the budget, all
    different; the supporting sentence if the gold chunk is missing. ``pooled`` holds pools that were drawn
    before, with those of the purpose ``clean``."""
    budget = run.failures.context_budget
    rows = attach_pools(seeds, chunks, run, "clean") if pooled is None else pooled.where("purpose = 'clean'")
    filled = lambda a: F.filter(a, lambda t: t.isNotNull() & (F.trim(t) != ""))
    own = F.slice(F.array_distinct(F.concat(F.array("gold_text"), filled(F.array("previous_text", "next_text")))), 1, budget)
    every = F.slice(F.array_distinct(F.concat(own, filled(F.transform("easy", lambda d: d["text"])))), 1, budget)
    alone = F.filter(F.array("supporting_sentence"), lambda t: F.trim(t) != "")
    return rows.withColumn("clean_contexts", F.when(F.col("gold_text").isNull(), alone).otherwise(every)).select(*seeds.columns, "clean_contexts")
