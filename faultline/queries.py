"""Registered queries of the engine's own operators over the tables at hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.config import Filtering, Generation, Run
from faultline.functions import text as t
from faultline.functions.similarity import semantic_similarity
from faultline.operators import candidates, chunks, dedup, evaluate, failures, filters, metrics, reports, seeds, validation, verify
from faultline.operators.clean import clean_pages, with_sections
from faultline.sources.adapters import corpus_pages, table, web_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RUN = Run()
GENERATION = Generation()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pages(table(spark, sf, "documents", "doc_id", "text", "lang", "source"))


def _turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn as gold and the assistant turn after it as prediction."""
    turns = table(spark, sf, "conversations")
    user = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("turn"), F.col("text").alias("gold"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return user.join(reply, ["conv_id", "turn"])


# Corpus


@query
def page_reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = filters.filter_pages(_pages(spark, sf))
    return rejected.select("page_id", "category_group", F.array_join("rejection_reasons", ",").alias("reasons"), "char_count")


@query
def page_reject_counts(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = filters.filter_pages(_pages(spark, sf))
    return filters.reason_counts(rejected, "category_group")


@query
def page_filter_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Phase one over pages whose titles and flags take all its forms in turn."""
    form, title = F.col("page_id") % 11, F.col("page_title")
    named = F.when(form == 1, F.concat(F.lit(" List of "), title)).when(form == 2, F.concat(title, F.lit(" (Disambiguation)"))).when(form == 3, F.concat(F.lit("A TIMELINE of "), title)).when(form == 4, F.concat(F.lit("Outlines of "), title)).when(form == 5, F.lit(None)).otherwise(title)
    rows = _pages(spark, sf).withColumns({"page_title": named, "is_redirect": F.col("page_id") % 7 == 0, "is_disambiguation": F.col("page_id") % 13 == 0})
    return rows.select("page_id", F.array_join(filters.raw_reasons(Filtering(min_page_chars=500)), ",").alias("reasons"))


@query
def cleaned_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean_pages(_pages(spark, sf))
    return rows.select("page_id", "page_title", "section_count", "char_count", F.md5(F.col("cleaned_text").cast("binary")).alias("text_md5"))


@query
def section_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean_pages(_pages(spark, sf)).select("page_id", F.explode("sections").alias("s"))
    return rows.select("page_id", F.col("s.section_title").alias("section_title"), F.col("s.level").alias("level"), F.array_join("s.section_path", "/").alias("path"), F.length("s.text").alias("chars"))


@query
def web_page_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_sections(web_pages(table(spark, sf, "pages")), "raw_text").select("page_id", F.posexplode("sections").alias("pos", "s"))
    return rows.select("page_id", "pos", F.col("s.section_title").alias("section_title"), F.length("s.text").alias("chars"))


@query
def prose_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(t.prose_ratio(F.col("text")), 6).alias("ratio"))


@query
def paragraph_repeat_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", F.round(t.paragraph_repeat_ratio(F.col("raw_text")), 6).alias("ratio"))


@query
def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").withColumn("s", t.split_sentences(F.coalesce("text", F.lit(""))))
    return rows.select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("sentences_md5"))


@query
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.token_count(F.col("text")).alias("tokens"))


@query
def title_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", t.normalize_title(F.col("page_title")).alias("title_key"))


@query
def exact_title_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pages(spark, sf).withColumn("title_key", t.normalize_title(F.col("page_title")))
    return dedup.first_by_key(rows, F.col("title_key"), "page_id").select("page_id", "title_key")


@query
def title_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Titles drawn per source in keyed order, each title once over all sources: the first source wins."""
    rows = table(spark, sf, "documents").join(_pages(spark, sf).select(F.col("page_id").alias("doc_id"), t.normalize_title(F.col("page_title")).alias("title_key")), "doc_id")
    once = dedup.first_by_key(rows, F.struct("source", "title_key"), "doc_id")
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(t.keyed(RUN.seed, F.col("source"), F.col("title_key")), "title_key")
    drawn = once.withColumn("rank", F.row_number().over(w)).where("rank <= 20")
    return dedup.first_by_key(drawn, F.col("title_key"), "source", "rank").select("source", "title_key", "rank")


@query
def near_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    _, pairs = dedup.near_pairs(table(spark, sf, "documents"), "doc_id", F.col("text"))
    return pairs.select("a", "b", "inter", "either")


@query
def near_dup_pages(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.deduplicate_pages(clean_pages(_pages(spark, sf))).select("page_id", "kept", F.array_join("reasons", ",").alias("reasons"))


@query
def category_quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.quota_sample(_pages(spark, sf).select("page_id", "category_group"), RUN).select("page_id", "category_group", "rank")


# Chunks


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk_pages(clean_pages(_pages(spark, sf)))


@query
def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("chunk_id", "page_id", "section_title", "paragraph_index", "chunk_index", "token_count", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def chunk_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("chunk_id", "previous_chunk_id", "next_chunk_id")


@query
def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    pages = clean_pages(_pages(spark, sf))
    return chunks.dataset_stats(pages, chunks.chunk_pages(pages))


# Text metrics


@query
def normalize_answer(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(t.normalize_answer(F.col("text")).cast("binary")).alias("normal_md5"))


@query
def exact_match_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _turn_pairs(spark, sf).select("conv_id", "turn", t.exact_match(F.col("prediction"), F.col("gold")).alias("em"))


@query
def token_f1_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turn_pairs(spark, sf).withColumns({"p": t.answer_tokens(F.col("prediction")), "g": t.answer_tokens(F.col("gold"))})
    return rows.select("conv_id", "turn", F.round(t.token_f1_of(F.col("p"), F.col("g")), 6).alias("f1"))


@query
def lexical_overlap_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _turn_pairs(spark, sf).select("conv_id", "turn", F.round(t.lexical_overlap(F.col("gold"), F.col("prediction")), 6).alias("overlap"))


@query
def semantic_similarity_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _turn_pairs(spark, sf).select("conv_id", "turn", semantic_similarity(F.col("prediction"), F.col("gold")).alias("similarity"))


@query
def gram_similarity_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _turn_pairs(spark, sf).select("conv_id", "turn", F.round(t.gram_similarity(F.coalesce("gold", F.lit("")), F.coalesce("prediction", F.lit(""))), 6).alias("similarity"))


@query
def abstention_turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", t.is_abstention(F.col("text")).alias("abstained"))


@query
def split_in_two(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").withColumn("cut", t.halves(F.coalesce("text", F.lit(""))))
    return rows.select("item_id", F.col("cut.a").alias("a"), F.col("cut.b").alias("b"))


@query
def char_ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.size(t.char_ngrams(F.coalesce("text", F.lit("")))).alias("grams"))


# Candidates, validation, seeds


def _candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Candidates, and the chunks of their pages: only pages that gave a candidate are cut up a second time."""
    rows = dedup.held(candidates.generate(_chunks(spark, sf), GENERATION), f"{dedup.shared_folder(spark)}/candidates")
    asked = rows.select(F.col("source.page_id").alias("page_id")).distinct()
    return rows, chunks.chunk_pages(clean_pages(_pages(spark, sf).join(F.broadcast(asked), "page_id", "left_semi")))


@query
def qa_chunk_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.round_robin(_chunks(spark, sf), GENERATION).select("slot", "chunk_id", "turn")


@query
def difficulty_allocation(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.allocation(spark, [1, 2, 7, 33, 100, 500, 1000], GENERATION.quotas)


@query
def difficulty_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.schedule(spark, GENERATION.target_candidates, GENERATION.quotas)


@query
def candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _candidates(spark, sf)
    return rows.select("candidate_id", "slot", "difficulty", "answer_type", "gold_answer", "question", F.col("source.chunk_id").alias("chunk_id"))


@query
def rule_reasons(spark: SparkSession, sf: str) -> DataFrame:
    rows, found = _candidates(spark, sf)
    return validation.with_chunks(rows, found).select("candidate_id", F.array_join(validation.rule_reasons(), ",").alias("reasons"), validation.not_unique().alias("multiple"))


def _validated(rows: DataFrame, found: DataFrame) -> DataFrame:
    """All layers, deduplication of the accepted in the order of their ids last."""
    results = dedup.held(validation.validate(rows, found), f"{dedup.shared_folder(rows.sparkSession)}/results")
    return validation.with_dedup(results)


@query
def validation_results(spark: SparkSession, sf: str) -> DataFrame:
    return _validated(*_candidates(spark, sf)).select("candidate_id", "accepted", "quality_score", F.array_join("rejection_reasons", ",").alias("reasons"))


@query
def validation_contribution(spark: SparkSession, sf: str) -> DataFrame:
    return validation.contribution(_validated(*_candidates(spark, sf)))


@query
def rejected_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    results = _validated(*_candidates(spark, sf))
    return results.join(results.where("accepted").select("candidate_id"), "candidate_id", "left_anti").select("candidate_id")


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as validation rows with every kind of signal in turn: layers not run, passed, failed."""
    n, lines = F.col("doc_id"), t.split_sentences(F.coalesce("text", F.lit("")))
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    ran, told = n % 3 > 0, n % 5 > 0
    return table(spark, sf, "documents", "doc_id", "text").select(
        n.cast("string").alias("candidate_id"),
        F.concat(F.when(n % 4 == 0, "Who ").when(n % 4 == 1, "which ").when(n % 4 == 2, "When ").otherwise("What "), F.substring(first, 1, 40)).alias("question"),
        F.element_at(F.array(*map(F.lit, ("person", "organization", "location", "other"))), (n % 4 + 1).cast("int")).alias("answer_type"),
        F.when(n % 2 == 0, F.concat(first, F.lit(" and more"))).otherwise(first).alias("supporting_sentence"),
        F.when(n % 7 == 0, "a AND b").otherwise("a").alias("gold_answer"),
        *(F.when(ran, n % k > 0).alias(c) for c, k in (("answerable", 11), ("answer_supported", 13), ("answer_unique", 17), ("question_clear", 19))),
        F.when(ran, n % 10 / 10).alias("judge_confidence"), F.when(told, n % 8 / 8).alias("baseline_f1"), F.when(told, n % 6 > 1).alias("baseline_correct"), (n % 9 > 0).alias("rule_ok"),
    )


@query
def uniqueness_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf).select("candidate_id", validation.not_unique().alias("multiple"))


@query
def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _mixed(spark, sf).withColumn("multiple", validation.not_unique())
    return rows.select("candidate_id", validation.quality_score(F.col("rule_ok"), ~F.col("multiple")).alias("quality_score"), F.coalesce(validation.judge_passed(), F.lit(False)).alias("judged_good"))


@query
def layer_contribution(spark: SparkSession, sf: str) -> DataFrame:
    """Rejections by layer where each layer decides on some rows."""
    n, score = F.col("candidate_id").cast("long"), F.col("quality_score")
    rows = _mixed(spark, sf).withColumn("quality_score", validation.quality_score(F.col("rule_ok"), F.lit(True)))
    reasons = (F.when(~F.col("rule_ok"), "question_too_short"), F.when(F.col("answerable").isNotNull() & ~validation.judge_passed(), "judge_rejected"), F.when(~F.col("baseline_correct"), "baseline_incorrect"), F.when((score < 0.85) & (n % 2 == 0), "below_quality_threshold"), F.when(n % 23 == 0, "duplicate_question"))
    rows = rows.withColumn("rejection_reasons", F.array_compact(F.array(*reasons))).withColumn("accepted", F.size("rejection_reasons") == 0)
    return validation.contribution(rows)


@query
def rejection_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return validation.reason_counts(_validated(*_candidates(spark, sf)))


@query
def question_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _candidates(spark, sf)
    return dedup.deduplicate_candidates(rows).select("candidate_id", "kept", F.array_join("reasons", ",").alias("reasons"))


def _seeds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    folder = dedup.shared_folder(spark)
    found = dedup.held(_chunks(spark, sf), f"{folder}/chunks")
    chosen = seeds.select_seeds(_validated(candidates.generate(found, GENERATION), found).where("accepted"), RUN)
    return dedup.held(chosen, f"{folder}/seeds"), found


@query
def seed_selection(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.select_seeds(_validated(*_candidates(spark, sf)).where("accepted"), RUN).select("sample_id", "candidate_id", "category_group", "difficulty", "quality_score")


@query
def clean_contexts(spark: SparkSession, sf: str) -> DataFrame:
    rows = seeds.clean_contexts(*_seeds(spark, sf), RUN)
    return rows.select("sample_id", F.size("clean_contexts").alias("n"), F.md5(F.array_join("clean_contexts", "|").cast("binary")).alias("contexts_md5"))


# Failures


def _flat(cases: DataFrame) -> DataFrame:
    return cases.select("failure_id", "severity", "difficulty", F.size("contexts").alias("n"), F.md5(F.array_join("contexts", "|").cast("binary")).alias("contexts_md5"), "answer_available")


def _register_operator(kind: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _flat(failures.inject(*_seeds(spark, sf), RUN, (kind,)))

    run.__name__ = f"inject_{kind}"
    query(run)


for _kind in RUN.failures.types:
    _register_operator(_kind)


def _verified(spark: SparkSession, sf: str, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Verified cases, seeds, chunks, and the folder of the pools, those of ``also`` included. The cases are held:
    a filter on the verification would evaluate all its checks again."""
    chosen, found = _seeds(spark, sf)
    folder = dedup.shared_folder(spark)
    cases = dedup.held(failures.inject(chosen, found, RUN, folder=folder, also=also), f"{folder}/cases")
    return dedup.held(verify.verify(cases), f"{folder}/verified"), chosen, found, folder


@query
def structural_verification(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("verification")
    return _verified(spark, sf)[0].select("failure_id", v["injection_valid"].alias("valid"), v["gold_answer_leaked"].alias("leaked"), v["verification_score"].alias("score"), F.array_join(v["failed_checks"], ",").alias("failed"))


@query
def verification_report(spark: SparkSession, sf: str) -> DataFrame:
    return verify.report(_verified(spark, sf)[0])


@query
def failed_check_counts(spark: SparkSession, sf: str) -> DataFrame:
    return verify.failed_checks(_verified(spark, sf)[0])


@query
def failure_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return reports.failure_distribution(verify.split_valid(_verified(spark, sf)[0])[0])


@query
def review_sample(spark: SparkSession, sf: str) -> DataFrame:
    return reports.failure_review(verify.split_valid(_verified(spark, sf)[0])[0], RUN.seed).select("failure_id", "failure_type", "severity")


@query
def sample_gallery(spark: SparkSession, sf: str) -> DataFrame:
    return reports.gallery(_verified(spark, sf)[0]).select("failure_type", "failure_id", "gold_answer", F.array_join("contexts", "|").alias("shown"))


# Evaluation


def _results(spark: SparkSession, sf: str) -> DataFrame:
    verified, chosen, found, folder = _verified(spark, sf, also=("clean",))
    clean = seeds.clean_contexts(chosen, found, RUN, spark.read.parquet(f"{folder}/pools"))
    work = evaluate.jobs(clean, verify.split_valid(verified)[0])
    return evaluate.score(evaluate.answer_offline(work), RUN)


@query
def eval_results(spark: SparkSession, sf: str) -> DataFrame:
    return reports.evaluation_csv(_results(spark, sf))


@query
def eval_metrics_by_condition(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.by_condition(_results(spark, sf))


@query
def eval_metrics_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.by_severity(_results(spark, sf))


@query
def performance_drop(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.performance_drop(metrics.by_condition(_results(spark, sf)))


@query
def robustness_scores(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.robustness(metrics.by_condition(_results(spark, sf)))


def _turn_results(spark: SparkSession, sf: str) -> DataFrame:
    """Turn pairs as evaluation results: the model is the parity of the conversation, the condition and the
    severity follow the turn."""
    pairs = _turn_pairs(spark, sf)
    cond = F.when(F.col("turn") == 0, "clean").when(F.col("turn") % 4 == 2, "context_noise").otherwise("conflict")
    level = F.when(F.col("turn") == 0, F.lit(None)).when(F.col("conv_id") % 3 == 0, "low").when(F.col("conv_id") % 3 == 1, "medium").otherwise("high")
    rows = pairs.withColumns({"model_name": F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd"), "condition": cond, "severity": level, "p": t.answer_tokens(F.col("prediction")), "g": t.answer_tokens(F.col("gold"))})
    rows = rows.withColumns({"exact_match": t.exact_match(F.col("prediction"), F.col("gold")), "token_f1": t.token_f1_of(F.col("p"), F.col("g")), "abstained": t.is_abstention(F.col("prediction")), "llm_judge_correct": F.when(F.col("turn") > 2, F.length("gold") > 200)})
    return rows.withColumn("hallucinated", F.when(F.col("turn") > 0, ~F.col("abstained") & (F.col("token_f1") < 0.2)))


@query
def turn_metrics_by_condition(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.by_condition(_turn_results(spark, sf))


@query
def turn_metrics_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.by_severity(_turn_results(spark, sf))


@query
def turn_performance_drop(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.performance_drop(metrics.by_condition(_turn_results(spark, sf)))


@query
def model_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.concat("role", F.lit("-"), (F.col("conv_id") % 3).cast("string")).alias("model_name"), "conv_id", "turn")
    again = rows.where("conv_id % 3 = 1 and turn = 0").withColumns({"model_name": F.upper("model_name"), "turn": F.col("turn") + 1000})
    return evaluate.merge(rows, again)


# Runs


@query
def stability_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as runs: mean and deviation of their rates."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    counts = docs.groupBy(F.col("source").alias("run_id")).agg(
        F.count("*").alias("candidates"), count(F.col("n_chars") < 200).alias("errors"), count(F.col("quality") == 1).alias("accepted"), count(F.col("quality") == 0).alias("rejected"),
        count(F.col("toxic") == 0).alias("seeds"), count(F.col("lang") == "en").alias("valid"), count(F.col("lang") != "en").alias("invalid"),
    )
    return metrics.mean_std(metrics.run_metrics(counts), "candidates", "accepted", "schema_success_rate", "qa_acceptance_rate", "clean_seed_yield", "failure_verification_pass_rate")


@query
def human_rates(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(F.when(F.col("quality") == 1, " Keep ").when(F.col("quality") == 0, "reject").otherwise("").alias("decision"))
    return metrics.human_rate(said, "decision", "keep").select("n", F.round("rate", 6).alias("rate"))


@query
def pages_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.distribution(filters.filter_pages(_pages(spark, sf))[0], "category_group")


@query
def alternate_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Another answer for the first words of each document that hold a digit, as a number and as a date."""
    found = F.regexp_extract(F.coalesce("text", F.lit("")), r"([^\s]*[^\s\d]?\d+(?:\.\d+)?[^\s]*)", 1)
    rows = table(spark, sf, "documents", "doc_id", "text").select("doc_id", found.alias("gold"), (F.col("doc_id") % 2000 / 8 + 0.0625).cast("string").alias("small")).where("gold <> ''")
    other = lambda c, kind: t.alternate_answer(F.col(c), F.lit(kind), RUN.seed, F.col("doc_id"))
    return rows.select("doc_id", other("gold", "numeric").alias("counted"), other("small", "other").alias("raised"), other("gold", "date").alias("dated"))


@query
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return metrics.distribution(docs, "quality")
