"""Tables of whole runs: frozen corpora, the latest run, logged answers, open places, counts over several runs.

A run is a folder below a root, with the tables of ``plans.build`` in it. Missing tables count as empty; a
run without validation results is left out of contributions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import metrics, validation
from faultline.sources.io import exists, read_decisions

#: Tables that a corpus consists of; chunks are what later steps read.
CORPUS = ("accepted", "rejected", "pages", "chunks")
#: Characters of an answer that a log keeps.
LOGGED = 4000

# Names of the reported columns and of the validation components, in report order.
COUNTS = ("candidates", "errors", "accepted", "seeds", "valid", "invalid")
RATES = ("schema_success_rate", "qa_acceptance_rate", "clean_seed_yield", "failure_verification_pass_rate", "human_acceptance_rate", "human_failure_validity_rate")
COMPONENTS = ("rule_checks", "llm_judge", "baseline_test", "quality_threshold", "deduplication")


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def freeze(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> list[str]:
    """Copies the corpus of a run into another run's folder, and names the tables copied. Tables the target
    has stay unless ``overwrite``; a source without chunks is an error."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("a corpus cannot be frozen into its own folder")
    if not exists(spark, f"{source}/chunks"):
        raise FileNotFoundError(f"no chunks in {source}")
    copied = [t for t in CORPUS if exists(spark, f"{source}/{t}") and (overwrite or not exists(spark, f"{target}/{t}"))]
    for name in copied:
        spark.read.parquet(f"{source}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")
    return copied


def publish(spark: SparkSession, root: str, run_id: str) -> None:
    """Appends the run to the root's list of finished ones."""
    spark.createDataFrame([(run_id,)], "run_id string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{root}/published")


def latest(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The table of the run published last; None if there is no such run or table."""
    listed = optional(spark, f"{root}/published")
    last = listed.orderBy(F.desc("at"), F.desc("run_id")).first() if listed is not None else None
    return optional(spark, f"{root}/{last.run_id}/{table}") if last else None


def logged(answers: DataFrame, stage: str) -> DataFrame:
    """stage, response, truncated, sha1, full_chars, error, ts: answers for a log; a longer one than LOGGED
    keeps its beginning and 16 digits of its hash. A null answer stays null."""
    text = F.col("answer")
    long = F.coalesce(F.length(text) > LOGGED, F.lit(False))
    return answers.select(F.lit(stage).alias("stage"), F.when(long, F.substring(text, 1, LOGGED)).otherwise(text).alias("response"), long.alias("truncated"), F.when(long, F.substring(F.sha1(text.cast("binary")), 1, 16)).alias("sha1"), F.length(text).alias("full_chars"), F.col("error"), F.current_timestamp().alias("ts"))


def resumed(done: DataFrame, new: DataFrame, target: int) -> DataFrame:
    """Earlier candidates, then new ones by slot, up to the target; an id that is done is not taken again."""
    both = done.withColumn("_new", F.lit(0)).unionByName(new.join(done.select("candidate_id"), "candidate_id", "left_anti").withColumn("_new", F.lit(1)))
    return both.orderBy("_new", "slot", "candidate_id").limit(target).drop("_new")


def first_cases(cases: DataFrame, limit: int) -> DataFrame:
    """The first cases by type, seed and severity: a short trial run; all of them for a limit of 0."""
    return cases.orderBy("failure_type", "parent_seed_id", "severity").limit(limit) if limit > 0 else cases


def quota_counts(rows: DataFrame, allocation: DataFrame) -> DataFrame:
    """difficulty, wanted, made: both sides whole, zero where one has none."""
    made = rows.groupBy("difficulty").agg(F.count("*").alias("made"))
    return allocation.select("difficulty", F.col("n").alias("wanted")).join(made, "difficulty", "full").select("difficulty", F.coalesce("wanted", F.lit(0)).alias("wanted"), F.coalesce("made", F.lit(0)).alias("made"))


def _size(spark: SparkSession, path: str, where: Column | None = None) -> int:
    rows = optional(spark, path)
    return 0 if rows is None else (rows if where is None else rows.where(where)).count()


def run_counts(spark: SparkSession, root: str, run_ids: list[str], reviews: str | None = None) -> DataFrame:
    """A row of counts and rates for each run, human rates from review packs where there are any."""
    rows = []
    for name in run_ids:
        at = f"{root}/{name}"
        ok, good = F.col("accepted"), F.col("verification.injection_valid")
        human = [None, None]
        if reviews:
            packs = (("seeds_review", "decision", "keep"), ("failures_review", "human_injection_valid", "yes"))
            tables = [(read_decisions(spark, f"{reviews}/{name}/{p}"), c, v) for p, c, v in packs]
            human = [metrics.human_rate(t, c, v).first().rate if t is not None else None for t, c, v in tables]
        rows.append((name, _size(spark, f"{at}/candidates"), _size(spark, f"{at}/errors"), _size(spark, f"{at}/results", ok), _size(spark, f"{at}/results", ~ok), _size(spark, f"{at}/seeds"), _size(spark, f"{at}/verified", good), _size(spark, f"{at}/verified", ~F.coalesce(good, F.lit(False))), *human))
    kinds = "run_id string, candidates long, errors long, accepted long, rejected long, seeds long, valid long, invalid long, human_acceptance_rate double, human_failure_validity_rate double"
    counts = spark.createDataFrame(rows, kinds)
    return metrics.run_metrics(counts).join(counts.drop("candidates", "accepted", "rejected", "seeds"), "run_id")


def stability(runs: DataFrame) -> DataFrame:
    """metric, n, mean, std of the reported counts and rates."""
    return metrics.mean_std(runs, *COUNTS, *RATES)


def all_results(spark: SparkSession, root: str, run_ids: list[str]) -> DataFrame | None:
    """Validation results of the runs that have them, with ``run_id``; None if no run has."""
    found = [(r, optional(spark, f"{root}/{r}/results")) for r in run_ids]
    tables = [t.withColumn("run_id", F.lit(r)) for r, t in found if t is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else None


def contributions(results: DataFrame) -> DataFrame:
    """run_id, component, rejected, unique_rejections: every component for every run, zero where it rejected none."""
    parts = validation.contribution_parts(results, "run_id")
    every = results.select("run_id").distinct().withColumn("component", F.explode(F.array(*map(F.lit, COMPONENTS))))
    return every.join(parts, ["run_id", "component"], "left").select("run_id", "component", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("rejected", "unique_rejections")))
