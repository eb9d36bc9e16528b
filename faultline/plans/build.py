"""Whole runs and their single steps. Each step is a table under the run's folder.

A model is a function from prompt and system text to an answer, as ``providers.Endpoint.complete``; steps
without one use the offline generator and readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from faultline.config import Run
from faultline.operators import candidates, chunks, dedup, evaluate, failures, filters, metrics, models, runs, seeds, validation, verify


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def filter_step(pages: DataFrame, run: Run, folder: str) -> dict[str, DataFrame]:
    """Filter, deduplicate, draw the quotas. Tables: accepted, rejected, pages."""
    accepted, rejected = filters.split_decided(kept(filters.decide_pages(pages, run.filtering), folder, "decided"))
    accepted = kept(dedup.numbered(accepted), folder, "accepted")
    decided = kept(dedup.deduplicate_pages(accepted), folder, "dedup")
    repeats = accepted.join(decided.where("not kept"), ["page_id", "copy"]).drop("rejection_reasons").withColumnRenamed("reasons", "rejection_reasons")
    out = {"accepted": accepted, "rejected": kept(rejected.unionByName(repeats.select(*rejected.columns)), folder, "rejected")}
    unique = accepted.join(decided.where("kept").select("page_id", "copy"), ["page_id", "copy"], "left_semi")
    return out | {"pages": kept(dedup.quota_sample(unique, run), folder, "pages")}


def chunk_step(pages: DataFrame, run: Run, folder: str) -> DataFrame:
    return kept(chunks.chunk_pages(pages, run.chunking), folder, "chunks")


def generate_step(found: DataFrame, run: Run, folder: str, model: models.Model | None = None, name: str = "") -> DataFrame:
    if model is None:
        return kept(candidates.generate(found, run.generation), folder, "candidates")
    made = models.generate(found, model, name, f"{folder}/asked", run.generation)
    kept(made["errors"], folder, "generation_errors")
    return kept(made["candidates"], folder, "candidates")


def validate_step(made: DataFrame, found: DataFrame, run: Run, folder: str, signals: DataFrame | None = None) -> DataFrame:
    first = kept(validation.validate(made, found, run.validation, signals), folder, "first_results")
    return kept(validation.with_dedup(first), folder, "results")


def seed_step(results: DataFrame, found: DataFrame, run: Run, folder: str) -> tuple[DataFrame, DataFrame]:
    """(chosen, seeds): without and with clean contexts."""
    chosen = kept(seeds.select_seeds(results.where("accepted"), run), folder, "chosen")
    return chosen, kept(seeds.clean_contexts(chosen, found, run), folder, "seeds")


def inject_step(chosen: DataFrame, found: DataFrame, run: Run, folder: str, judge: models.Model | None = None) -> DataFrame:
    """Verified cases, valid or not; with a judge, also by whether it finds an answer that should be absent."""
    cases = failures.inject(chosen, found, run, folder=f"{folder}/drawn/{uuid.uuid4().hex}")
    if judge is None:
        return kept(verify.verify(cases), folder, "verified")
    cases = kept(cases, folder, "cases")
    told = kept(models.absence(verify.verify(cases), judge), folder, "absence")
    return kept(verify.verify(cases, told), folder, "verified")


def evaluate_step(chosen: DataFrame, verified: DataFrame, run: Run, folder: str, by: dict[str, models.Model] | None = None, judge: models.Model | None = None) -> DataFrame:
    """Scored answers to seeds and valid cases; results of models that are not run again stay."""
    work = evaluate.jobs(chosen, verify.split_valid(verified)[0])
    told = models.answers(work, by, run, judge) if by else evaluate.answer_offline(work)
    new = kept(evaluate.score(told, run), folder, "new_evaluation")
    earlier = runs.optional(new.sparkSession, f"{folder}/evaluation")
    every = kept(evaluate.merge(earlier, new), folder, "merged_evaluation") if earlier is not None else new
    return kept(every, folder, "evaluation")


def build_corpus(pages: DataFrame, run: Run, folder: str) -> dict[str, DataFrame]:
    """Filter, deduplicate, draw the quotas, chunk. Tables: accepted, rejected, pages, chunks."""
    out = filter_step(pages, run, folder)
    return out | {"chunks": chunk_step(out["pages"], run, folder)}


def build_failures(found: DataFrame, run: Run, folder: str, signals: DataFrame | None = None) -> dict[str, DataFrame]:
    """Candidates, validation, seeds, verified failures, offline evaluation and its metrics."""
    out = {"candidates": generate_step(found, run, folder)}
    out["results"] = validate_step(out["candidates"], found, run, folder, signals)
    chosen, out["seeds"] = seed_step(out["results"], found, run, folder)
    verified = inject_step(chosen, found, run, folder)
    out["failures"], out["quarantine"] = verify.split_valid(verified)
    out["evaluation"] = evaluate_step(out["seeds"], verified, run, folder)
    out["conditions"] = metrics.by_condition(out["evaluation"])
    out["robustness"] = metrics.robustness(out["conditions"])
    return out
