"""Candidate validation: rules, uniqueness, optional judge and baseline signals, quality, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import Validation
from faultline.functions.text import exact_match, normalize_answer, reason_component, strip, token_count, token_f1
from faultline.operators.dedup import deduplicate_candidates

SIGNALS = {"answerable": "boolean", "answer_supported": "boolean", "answer_unique": "boolean", "question_clear": "boolean", "judge_confidence": "double", "baseline_prediction": "string", "baseline_judge": "boolean"}


def with_chunks(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Left join by chunk id: a candidate without its chunk stays, with a null chunk."""
    side = chunks.select(F.col("chunk_id").alias("_chunk"), F.col("text").alias("chunk_text"), F.col("page_title").alias("chunk_title"))
    return candidates.join(side, F.col("source.chunk_id") == F.col("_chunk"), "left").drop("_chunk")


def rule_reasons(cfg: Validation = Validation()) -> Column:
    """The broken rules of a candidate joined with its chunk, in order."""
    q, gold, support = (strip(F.coalesce(F.col(c), F.lit(""))) for c in ("question", "gold_answer", "supporting_sentence"))
    nq, ng, ns, title = normalize_answer(q), normalize_answer(gold), normalize_answer(support), normalize_answer(F.col("chunk_title"))
    found = F.col("chunk_text").isNotNull()
    checks = [
        (gold == "", "empty_gold_answer"),
        (q == "", "empty_question"),
        (F.length(q) < cfg.min_question_chars, "question_too_short"),
        (token_count(q) > cfg.max_question_tokens, "question_too_long"),
        ((gold != "") & F.contains(nq, ng), "answer_in_question"),
        (F.lit(cfg.require_answer_containment) & (gold != "") & ~F.contains(ns, ng), "answer_not_in_supporting_sentence"),
        (F.lit(cfg.require_evidence_containment) & found & (ns != "") & ~F.contains(normalize_answer(F.col("chunk_text")), ns), "supporting_sentence_not_in_chunk"),
        (found & (title != "") & F.contains(nq, title), "title_leak_in_question"),
    ]
    return F.filter(F.array(*(F.when(c, n) for c, n in checks)), lambda r: r.isNotNull())


def not_unique() -> Column:
    """A who/which/what question on a person or organisation whose support lists several."""
    asks = F.lower("question").rlike("^(who|which|what)")
    return asks & F.col("answer_type").isin("person", "organization") & F.contains("supporting_sentence", F.lit(" and ")) & ~F.contains(F.lower("gold_answer"), F.lit(" and "))


def judge_passed(cfg: Validation = Validation()) -> Column:
    return F.col("answerable") & F.col("answer_supported") & F.col("answer_unique") & F.col("question_clear") & (F.col("judge_confidence") >= cfg.min_judge_confidence)


def quality_score(rule_ok: Column, unique_ok: Column) -> Column:
    """0.3 rules, 0.1 uniqueness, 0.3 judge, 0.3 baseline; a layer that was not run counts as the rules do."""
    part = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)) * 0.25
    rules = rule_ok.cast("double")
    judge = (part("answerable") + part("answer_supported") + part("answer_unique") + part("question_clear")) * F.coalesce("judge_confidence", F.lit(0.0))
    baseline = F.greatest(F.coalesce("baseline_f1", F.lit(0.0)), F.col("baseline_correct").cast("double"))
    total = 0.30 * rules + 0.10 * unique_ok.cast("double") + 0.30 * F.when(F.col("answerable").isNull(), rules).otherwise(judge) + 0.30 * F.when(F.col("baseline_correct").isNull(), rules).otherwise(baseline)
    return F.round(F.least(total, F.lit(1.0)), 4)


def validate(candidates: DataFrame, chunks: DataFrame, cfg: Validation = Validation(), signals: DataFrame | None = None) -> DataFrame:
    """Validation results before deduplication. ``signals`` (candidate_id and SIGNALS) come from a judge
    and a baseline reader; null signals mean that a layer was not run."""
    rows = with_chunks(candidates, chunks)
    rows = rows.join(signals, "candidate_id", "left") if signals is not None else rows.withColumns({c: F.lit(None).cast(t) for c, t in SIGNALS.items()})
    rows = rows.withColumns({"rules": rule_reasons(cfg), "multiple": not_unique()})
    ran = F.col("baseline_prediction").isNotNull()
    rows = rows.withColumns({"baseline_em": F.when(ran, exact_match(F.col("baseline_prediction"), F.col("gold_answer"))), "baseline_f1": F.when(ran, token_f1(F.col("baseline_prediction"), F.col("gold_answer")))})
    rows = rows.withColumn("baseline_correct", F.when(ran, (F.col("baseline_em") >= 1) | (F.col("baseline_f1") >= 0.6) | F.coalesce("baseline_judge", F.lit(False))))
    rule_ok, unique_ok = F.size("rules") == 0, ~F.col("multiple")
    rows = rows.withColumn("quality_score", quality_score(rule_ok, unique_ok))
    more = F.array(
        F.when(F.col("multiple"), "possible_multiple_answers"),
        F.when(F.lit(cfg.use_answerability_judge) & F.col("answerable").isNotNull() & ~judge_passed(cfg), "judge_rejected"),
        F.when(F.lit(cfg.use_baseline_test and cfg.require_baseline_correct) & ~F.col("baseline_correct"), "baseline_incorrect"),
        F.when(F.col("quality_score") < cfg.min_quality_score, "below_quality_threshold"),
    )
    rows = rows.withColumn("rejection_reasons", F.concat("rules", F.filter(more, lambda r: r.isNotNull())))
    return rows.withColumn("accepted", F.size("rejection_reasons") == 0).drop("rules", "multiple", "chunk_text", "chunk_title")


def with_dedup(results: DataFrame, percent: int = 85) -> DataFrame:
    """Accepted results that repeat an earlier accepted one are rejected with the reasons."""
    dropped = deduplicate_candidates(results.where("accepted"), percent).where("not kept").select("candidate_id", F.col("reasons").alias("_more"))
    out = results.join(dropped, "candidate_id", "left")
    reasons = F.concat("rejection_reasons", F.coalesce("_more", F.array().cast("array<string>")))
    return out.withColumns({"rejection_reasons": reasons, "accepted": F.col("accepted") & F.col("_more").isNull()}).drop("_more")


def contribution_parts(results: DataFrame, *groups: str) -> DataFrame:
    """By group and validation layer: candidates it rejected, and those that no other layer rejected."""
    parts = results.where("not accepted").select(*groups, "candidate_id", F.array_distinct(F.filter(F.transform("rejection_reasons", reason_component), lambda c: c.isNotNull())).alias("parts"))
    each = parts.select(*groups, F.explode("parts").alias("component"), (F.size("parts") == 1).alias("alone"))
    return each.groupBy(*groups, "component").agg(F.count("*").alias("rejected"), F.sum(F.col("alone").cast("long")).alias("unique_rejections"))


def contribution(results: DataFrame) -> DataFrame:
    return contribution_parts(results)


def reason_counts(results: DataFrame) -> DataFrame:
    """component, reason, n over all results, accepted or not."""
    each = results.select(F.explode("rejection_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return each.select(reason_component(F.col("reason")).alias("component"), "reason", "n")


def top_reasons(results: DataFrame, most: int = 5) -> DataFrame:
    """The most frequent reasons of each component, with their ``rank``."""
    w = Window.partitionBy("component").orderBy(F.desc("n"), "reason")
    return reason_counts(results).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def overview(results: DataFrame) -> DataFrame:
    """One row: candidates, accepted, rejected, those that a model assessed, acceptance rate (null for none)."""
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    ok = F.col("accepted")
    seen = F.col("answerable").isNotNull() | F.col("baseline_correct").isNotNull()
    return results.agg(F.count("*").alias("candidates"), one(ok).alias("accepted"), one(~ok).alias("rejected"), one(seen).alias("llm_assessed"), F.avg(ok.cast("double")).alias("acceptance_rate"))
