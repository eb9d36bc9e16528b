"""Structural verification of failure cases: base checks, operator checks, score, optional judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import normalize_answer

_p = lambda name: F.col(f"parameters.{name}")


def _checks() -> Column:
    """array of (name, ok) of the checks that apply, in order; null-valued ones do not apply."""
    kind, gold, size = F.col("failure_type"), F.col("_gold"), F.size("contexts")
    is_ = lambda *kinds: kind.isin(*kinds)
    at = lambda p: F.get("_norms", p)
    holds = lambda hay, needle: F.contains(hay, needle)
    pos = _p("gold_position")
    pieces, places, others = _p("split_pieces"), _p("gold_positions"), _p("distractor_positions")
    in_range = lambda p: (p >= 0) & (p < size)
    listed = pieces.isNotNull() & (F.size(pieces) > 0)
    piece_norms = F.filter(F.transform(pieces, normalize_answer), lambda x: x != "")
    placed = (F.size(places) == F.size(pieces)) & F.forall(F.zip_with(places, pieces, lambda p, x: in_range(p) & holds(at(p), normalize_answer(x))), lambda ok: F.coalesce(ok, F.lit(False)))
    clean = F.forall(others, lambda p: F.coalesce(in_range(p) & ~holds(at(p), gold) & ~F.exists(piece_norms, lambda x: holds(at(p), x)), F.lit(False)))
    whole = F.exists("contexts", lambda c: F.contains(c, F.col("supporting_sentence")))
    absent = ~F.contains(F.col("_joined"), F.col("supporting_sentence"))
    positions = is_("context_noise", "evidence_position") & pos.isNotNull() & in_range(pos)
    no = F.lit(False)
    said, other = F.coalesce(_p("conflict_passage"), F.lit("")), F.coalesce(_p("alternate_answer"), F.lit(""))
    table = [
        ("contexts_nonempty", F.lit(True), size > 0),
        ("gold_answer_present", F.col("answer_available"), F.col("_leaked")),
        ("gold_answer_absent", ~F.col("answer_available"), ~F.col("_leaked")),
        ("supporting_sentence_removed", is_("missing_evidence"), absent),
        ("supporting_sentence_absent", is_("hard_negative"), absent),
        ("context_count_matches", is_("context_noise", "hard_negative") & _p("num_contexts").isNotNull(), size == _p("num_contexts")),
        ("gold_at_recorded_position", positions, holds(at(pos), gold)),
        ("evidence_split_across_chunks", is_("chunk_boundary"), ~whole),
        ("pieces_reconstruct_sentence", is_("chunk_boundary"), F.coalesce(listed & (normalize_answer(F.array_join(pieces, " ")) == normalize_answer(F.coalesce(_p("split_sentence"), F.col("supporting_sentence")))), no)),
        ("gold_pieces_at_recorded_positions", is_("chunk_boundary"), F.coalesce(listed & placed, no)),
        ("positions_disjoint", is_("chunk_boundary"), F.coalesce(~F.arrays_overlap(places, others), no)),
        ("distractors_lack_gold_evidence", is_("chunk_boundary"), F.coalesce(clean, no)),
        ("gold_count_matches_splits", is_("chunk_boundary"), F.coalesce(F.size(places) == _p("num_splits"), no)),
        ("conflict_passage_present", is_("conflict"), (said != "") & F.exists("contexts", lambda c: F.contains(c, said))),
        ("alternate_answer_present", is_("conflict") & (other != ""), holds(F.col("_norm"), normalize_answer(other))),
        ("gold_still_present", is_("conflict") & (F.size(F.coalesce(places, F.array().cast("array<int>"))) > 0), F.coalesce(F.exists(places, lambda p: in_range(p) & holds(at(p), gold)), no)),
    ]
    named = F.array(*(F.when(applies, F.struct(F.lit(name).alias("name"), F.coalesce(ok, no).alias("ok"))) for name, applies, ok in table))
    return F.filter(named, lambda c: c.isNotNull())


def verify(cases: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Cases with ``verification``. ``judged`` (failure_id, answerable, confidence) adds a judge's view of
    structurally valid cases: 0.7 of the score is structural, 0.3 the judge's agreement; disagreement
    rejects only where the answer should be absent."""
    full = F.filter("contexts", lambda c: c.isNotNull() & (c != ""))
    rows = cases.withColumns({"_gold": normalize_answer(F.col("gold_answer")), "_norms": F.transform("contexts", normalize_answer), "_norm": normalize_answer(F.array_join(full, "\n\n")), "_joined": F.array_join("contexts", "\n\n")})
    rows = rows.withColumn("_leaked", F.contains("_norm", F.col("_gold"))).withColumn("_checks", _checks())
    failed = F.transform(F.filter("_checks", lambda c: ~c["ok"]), lambda c: c["name"])
    rows = rows.withColumns({"_failed": failed, "_score": F.round((F.size("_checks") - F.size(failed)) / F.size("_checks"), 4)})
    rows = rows.join(judged.select("failure_id", F.col("answerable").alias("_yes"), F.col("confidence").alias("_sure")), "failure_id", "left") if judged is not None else rows.withColumns({"_yes": F.lit(None).cast("boolean"), "_sure": F.lit(None).cast("double")})
    seen = F.col("_yes").isNotNull() & (F.size("_failed") == 0)
    agrees = F.when(seen, F.col("_yes") == F.col("answer_available"))
    broken = F.coalesce(~agrees & ~F.col("answer_available"), F.lit(False))
    sure = F.when(agrees, F.col("_sure")).otherwise(1 - F.col("_sure"))
    score = F.when(seen, F.round(0.7 * F.col("_score") + 0.3 * sure, 4)).otherwise(F.col("_score"))
    reasons = F.when(broken, F.array_append("_failed", "judge_answer_still_available")).otherwise(F.col("_failed"))
    made = F.struct((F.size(reasons) == 0).alias("injection_valid"), "answer_available", (~F.col("answer_available") & F.col("_leaked")).alias("gold_answer_leaked"), agrees.alias("judge_verified"), score.alias("verification_score"), reasons.alias("failed_checks"), F.when(seen, F.col("_sure")).alias("judge_confidence"))
    return rows.withColumn("verification", made).select(*cases.columns, "verification")


def split_valid(verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    return verified.where("verification.injection_valid"), verified.where("not verification.injection_valid")


def report(verified: DataFrame) -> DataFrame:
    """Valid and rejected cases by type and severity."""
    ok = F.col("verification.injection_valid").cast("long")
    return verified.groupBy("failure_type", "severity").agg(F.count("*").alias("n"), F.sum(ok).alias("valid"), F.sum(1 - ok).alias("rejected"))


def failed_checks(verified: DataFrame) -> DataFrame:
    return verified.select("failure_type", F.explode("verification.failed_checks").alias("check")).groupBy("failure_type", "check").agg(F.count("*").alias("n"))
