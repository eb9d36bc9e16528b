"""The engine's own operators: values, invariants, and brute force where SQL has no form."""

import json
import random
import re
import urllib.error

import pytest
from pyspark.sql import functions as F

from faultline import providers
from faultline.config import Chunking, Failures, Filtering, Generation, Run, Validation
from faultline.functions import text as t
from faultline.functions.similarity import semantic_similarity
from faultline.__main__ import main
from faultline.operators import candidates, chunks, clean, dedup, evaluate, failures, filters, metrics, models, reports, runs, seeds, validation, verify
from faultline.plans.build import build_corpus, build_failures
from faultline.sources import io, pages, schemas
from faultline.sources.adapters import corpus_pages, web_pages
from faultline.streaming.evaluations import merge_stream

EXTRACT = "Lead text here.[1] More [citation needed] text.\n\n== History ==\nHist   body.\n\n=== Early ===\nearly body\n\n=== Late ===\n\n== References ==\nref\n\n== See also ==\nx\n\n== Architecture ==\narch"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_normalised_answers(spark):
    n = lambda s: value(spark, t.normalize_answer(F.lit(s)))
    assert n("The Google, Inc.") == "google inc" and n("  A  Test ") == "test" and n(None) == "" and n("The") == ""
    assert value(spark, t.contains_answer(F.lit("anything"), F.lit("The")))
    assert value(spark, t.token_f1(F.lit("the cat sat"), F.lit("cat sat down"))) == pytest.approx(0.8)
    assert value(spark, t.token_f1(F.lit(""), F.lit(""))) == 1.0 and value(spark, t.token_f1(F.lit("x"), F.lit(""))) == 0.0
    assert value(spark, t.is_abstention(F.lit(" I don't know. "))) and value(spark, t.is_abstention(F.lit(None).cast("string"))) and not value(spark, t.is_abstention(F.lit("Paris")))
    assert value(spark, t.normalize_model_id(F.lit("a/b c"))) == "a_b_c" and value(spark, t.normalize_model_id(F.lit("//"))) == "model"


def test_similarity(spark):
    from difflib import SequenceMatcher

    assert value(spark, semantic_similarity(F.lit("The Cat sat."), F.lit("cat sits"))) == SequenceMatcher(None, "cat sat", "cat sits").ratio()


def test_sentences_like_a_character_loop(spark):
    for text in ("A b. C d! E", "...", "A... b", "Wait?! Yes.", "", "no end"):
        parts, held = [], ""
        for ch in text:
            held += ch
            if ch in ".!?" and len(held) > 1:
                parts.append(held.strip())
                held = ""
        assert value(spark, t.split_sentences(F.lit(text))) == [p for p in [*parts, held.strip()] if p]


def test_conflicts(spark):
    other = lambda g, k: value(spark, t.alternate_answer(F.lit(g), F.lit(k), 1, "x"))
    assert other("A12 has 1", "numeric") == "A12 has 2" and other("3.14159", "other") == "4.14159" and other("12345.678", "numeric") == "12346.7"
    assert other("999999.7", "numeric") == "1e+06" and other("1234567.5", "numeric") == "1.23457e+06" and other("0.5", "numeric") == "1.5"
    assert other("July 4, 1999", "date") == "July 4, 1996" and other("about 41 men", "numeric") == "about 42 men" and other("2.5", "numeric") == "3.5"
    assert other("Paris", "location") in {"Tokyo", "Cairo", "Toronto", "Sydney"}
    said = lambda s, g: value(spark, t.conflict_passage(F.lit(s), F.lit(g), F.lit("X")))
    assert said("It is Rome. Rome!", "Rome") == "It is X. Rome!" and said("it is ROME", "Rome") == "it is X" and said("none", "Rome").startswith("Some sources")


def test_cleaning_and_filters(spark):
    df = spark.createDataFrame([(1, 1, "K", EXTRACT, "c", False, False), (2, 1, "List of things", EXTRACT, "c", False, False), (3, 1, "X (disambiguation)", "x", "c", True, False), (4, 1, "R", None, None, False, False)], "page_id long, revision_id long, page_title string, raw_text string, category_group string, is_redirect boolean, is_disambiguation boolean")
    row = clean.clean_pages(df).where("page_id = 1").first()
    assert row.cleaned_text == "Lead text here. More text.\n\n== History ==\nHist body.\n\n=== Early ===\nearly body\n\n== Architecture ==\narch"
    assert [(s.section_title, list(s.section_path)) for s in row.sections] == [("Lead", ["Lead"]), ("History", ["History"]), ("Early", ["History", "Early"]), ("Architecture", ["Architecture"])]
    for s in row.sections:
        assert row.cleaned_text[s.char_start : s.char_end].strip().endswith(s.text)
    accepted, rejected = filters.filter_pages(df, Filtering(min_page_chars=50, min_sections=2, min_prose_ratio=0.4, max_paragraph_repeat_ratio=0.5))
    assert [r.page_id for r in accepted.collect()] == [1]
    assert {r.page_id: list(r.rejection_reasons) for r in rejected.collect()} == {2: ["list_page"], 3: ["redirect", "disambiguation", "too_short"], 4: ["too_short"]}


def test_chunks_pack_and_link(spark):
    body = " ".join(f"Sentence number {i} has some words." for i in range(60))
    assert all(len(chunks._TOKEN.findall(p)) <= 80 for p in chunks.pack(body, 80, 10)) and " ".join(chunks.pack(body, 80, 10)) == body
    long = " ".join(f"w{i}" for i in range(100))
    assert len(chunks.windows(long, 30, 10)) > 5 and chunks.windows("a b", 30, 0) == ["a b"]
    df = spark.createDataFrame([(1, 1, "K", f"{body}\n\nshort one.\n\n== S ==\n{long}", "c")], "page_id long, revision_id long, page_title string, raw_text string, category_group string")
    rows = chunks.chunk_pages(clean.clean_pages(df), Chunking(80, 10)).orderBy("paragraph_index", "chunk_index").collect()
    assert all(5 <= r.token_count <= 80 for r in rows)
    assert [r.previous_chunk_id for r in rows[1:]] == [r.chunk_id for r in rows[:-1]] and rows[-1].next_chunk_id is None


def brute_first_wins(rows, percent):
    seen, kept, out = set(), [], {}
    grams = lambda s: {s[i : i + 5] for i in range(len(s) - 4)} if len(s) >= 5 else {s} - {""}
    for d, title, text in sorted(rows):
        g, reasons = grams(" ".join(text.lower().split())), []
        if title in seen:
            reasons.append("duplicate_title")
        elif any(g and h and 100 * len(g & h) >= percent * len(g | h) for h in kept):
            reasons.append("near_duplicate_text")
        if not reasons:
            seen.add(title)
            kept.append(g)
        out[d] = (not reasons, reasons)
    return out


def test_greedy_dedup_against_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [f"word{i}" for i in range(40)]
    rows = []
    for d in range(120):
        words = list(base) if d % 3 else [f"z{rng.randrange(10**6)}" for _ in range(40)]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(40)] = f"q{rng.randrange(999)}"
        rows.append((d, f"t{rng.randrange(100)}", " ".join(words)))
    df = spark.createDataFrame(rows, "page_id long, page_title string, raw_text string").withColumn("cleaned_text", F.lit(None).cast("string"))
    assert {r.page_id: (r.kept, list(r.reasons)) for r in dedup.deduplicate_pages(df).collect()} == brute_first_wins(rows, 85)


def test_allocation_and_schedule(spark):
    quotas = {"easy": 0.4, "medium": 0.4, "hard": 0.2}
    of = lambda n, q: {r.difficulty: r.n for r in candidates.allocation(spark, [n], q).collect()}
    assert of(500, quotas) == {"easy": 200, "medium": 200, "hard": 100} and sum(of(7, quotas).values()) == 7
    assert of(3, {"easy": 0.98, "medium": 0.01, "hard": 0.01}) == {"easy": 1, "medium": 1, "hard": 1} and of(4, {"hard": 0.0}) == {"easy": 4, "medium": 0, "hard": 0}
    assert [r.difficulty for r in candidates.schedule(spark, 5, quotas).orderBy("slot").collect()] == ["easy", "medium", "hard", "easy", "medium"]


@pytest.fixture(scope="module")
def built(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    run = Run(filtering=Filtering(min_page_chars=300, min_sections=1), validation=Validation(target_clean_seeds=20))
    corpus = build_corpus(corpus_pages(spark.read.parquet(f"{sf}/documents.parquet")), run, folder)
    return corpus, build_failures(corpus["chunks"], run, folder), run


def test_run_invariants(built):
    corpus, out, run = built
    assert corpus["accepted"].count() > 0 and corpus["rejected"].count() > 0
    n = out["seeds"].count()
    assert 0 < n <= 20 and out["seeds"].where("sample_id not rlike '^seed_[0-9]{6}$'").count() == 0
    valid, bad = out["failures"].count(), out["quarantine"].count()
    assert valid + bad <= n * 18 and valid > 0
    assert out["failures"].where("answer_available and expected_behavior <> 'answer'").count() == 0
    assert out["failures"].where("parameters.num_contexts <> size(contexts)").count() == 0
    again = verify.verify(out["failures"].drop("verification"))
    assert again.where("not verification.injection_valid").count() == 0
    assert out["seeds"].where("size(clean_contexts) > 8 or size(array_distinct(clean_contexts)) <> size(clean_contexts)").count() == 0
    scores = {r.model_name: r for r in out["robustness"].collect()}
    assert scores["reader_gold"].clean_accuracy == 1.0 and scores["reader_abstain"].clean_accuracy == 0.0


def test_repartitioning_changes_nothing(built):
    corpus, out, run = built
    chosen = out["seeds"].drop("clean_contexts")
    a = failures.inject(chosen.repartition(7), corpus["chunks"].repartition(5), run)
    b = out["failures"].drop("verification").unionByName(out["quarantine"].drop("verification"))
    flat = lambda df: sorted((r.failure_id, tuple(r.contexts)) for r in df.select("failure_id", "contexts").collect())
    assert flat(a) == flat(b)


def test_wrong_positions_fail_verification(built):
    _, out, _ = built
    moved = out["failures"].where("failure_type = 'chunk_boundary'").drop("verification").withColumn("parameters", F.col("parameters").withField("gold_positions", F.transform("parameters.gold_positions", lambda p: p + 50)))
    rows = verify.verify(moved).select("verification.failed_checks").collect()
    assert rows and all("gold_pieces_at_recorded_positions" in r.failed_checks for r in rows)


def test_judge_rejects_only_what_should_be_absent(built):
    _, out, _ = built
    cases = out["failures"].drop("verification")
    judged = cases.select("failure_id", F.lit(True).alias("answerable"), F.lit(0.9).alias("confidence"))
    rows = verify.verify(cases, judged)
    assert rows.where("answer_available and not verification.injection_valid").count() == 0
    assert rows.where("not answer_available and verification.injection_valid").count() == 0


def test_validation_layers(spark):
    source = "struct<page_id:bigint,revision_id:bigint,page_title:string,section_title:string,chunk_id:string>"
    rows = [("c1", "Who founded the firm in town?", "Ann", "Ann and Bob founded it.", "person", (1, 1, "P", "S", "k")), ("c2", "What is Rome?", "Rome", "It is Oslo.", "location", (1, 1, "P", "S", "none"))]
    cand = spark.createDataFrame(rows, f"candidate_id string, question string, gold_answer string, supporting_sentence string, answer_type string, source {source}")
    found = spark.createDataFrame([("k", "Ann and Bob founded it. More.", "Title")], "chunk_id string, text string, page_title string")
    got = {r.candidate_id: r for r in validation.validate(cand, found).collect()}
    assert validation.overview(spark.createDataFrame(list(got.values()), validation.validate(cand, found).schema)).first().rejected == 2
    assert list(got["c1"].rejection_reasons) == ["possible_multiple_answers"] and got["c1"].quality_score == 0.9
    assert list(got["c2"].rejection_reasons) == ["answer_in_question", "answer_not_in_supporting_sentence", "below_quality_threshold"]
    signals = spark.createDataFrame([("c1", True, True, True, False, 0.9, "Bob", None)], "candidate_id string, answerable boolean, answer_supported boolean, answer_unique boolean, question_clear boolean, judge_confidence double, baseline_prediction string, baseline_judge boolean")
    row = validation.validate(cand, found, signals=signals).where("candidate_id = 'c1'").first()
    assert set(row.rejection_reasons) == {"possible_multiple_answers", "judge_rejected", "baseline_incorrect", "below_quality_threshold"}


def test_metrics(spark):
    rows = [("m", "clean", None, 1.0, 1.0, None, False, False), ("m", "clean", None, 1.0, 1.0, None, False, False), ("m", "context_noise", "low", 1.0, 1.0, None, False, None), ("m", "context_noise", "low", 0.0, 0.0, None, True, True)]
    df = spark.createDataFrame(rows, "model_name string, condition string, severity string, exact_match double, token_f1 double, llm_judge_correct boolean, abstained boolean, hallucinated boolean")
    conditions = metrics.by_condition(df)
    assert {r.condition: r.accuracy for r in conditions.collect()} == {"clean": 1.0, "context_noise": 0.5}
    assert metrics.performance_drop(conditions).first().performance_drop == 0.5 and metrics.robustness(conditions).first().robustness_score == 0.5
    assert "0.5" in reports.evaluation_report(df)
    decisions = spark.createDataFrame([("a", "keep"), ("b", " Keep"), ("c", "reject"), ("d", ""), ("e", None)], "id string, decision string")
    assert metrics.human_rate(decisions, "decision", "keep").first().rate == pytest.approx(2 / 3)
    one = metrics.mean_std(spark.createDataFrame([(0.5, None)], "a double, b double"), "a", "b")
    assert {r.metric: (r.n, r["mean"], r["std"]) for r in one.collect()} == {"a": (1, 0.5, 0.0), "b": (0, None, None)}


def test_io_and_schemas(spark, tmp_path):
    assert io.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0 and io.count_lines(spark, str(tmp_path / "none")) == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": 3}\n')
    assert io.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2 and io.count_lines(spark, str(tmp_path / "x.jsonl")) == 2
    for name, text in schemas.export().items():
        assert json.loads(text) == schemas.schema(name).jsonValue()
    df = spark.createDataFrame([("low",), ("other",)], "severity string")
    with pytest.raises(Exception, match="may not be other"):
        io.required(df, severity=("low",)).collect()


def test_provider_retries_and_reports_errors(spark):
    waits, calls = [], []

    def busy(prompt, system):
        calls.append(prompt)
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 429, "busy", None, None)
        return "done"

    assert providers.Endpoint("http://x", "m").complete("p", request=busy, sleep=waits.append) == "done" and len(waits) == 2
    df = spark.createDataFrame([("a",), ("bad",)], "prompt string")

    def reply(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    got = {r.prompt: (r.answer, r.error) for r in providers.answer(df, reply).collect()}
    assert got == {"a": ("A", None), "bad": ("", "ValueError: no")}
    assert providers.extract_json('x ```json\n{"a": 1}\n``` y') == {"a": 1} and providers.extract_json('say {"a": {"b": 2}} end') == {"a": {"b": 2}} and providers.extract_json("[1]") is None


def test_page_source(spark):
    edges = spark.createDataFrame([("A", "p1", False), ("A", "B", True), ("B", "P_1", False), ("B", "p2", False)], "parent string, child string, is_category boolean")
    members = pages.category_members(edges, spark.createDataFrame([("g", "A"), ("h", "B")], "group string, parent string"))
    titles = pages.sample_titles(members, {"g": 5, "h": 5}, 1)
    assert titles.count() == titles.select("key").distinct().count() == 3

    def transport(group, title):
        if title == "p2":
            raise OSError("down")
        return {"page_id": 1 if title == "p1" else 2, "page_title": title, "raw_text": "x"}

    good, bad = pages.fetch(titles.coalesce(1), transport, per_second=1000, attempts=2, base_delay=0.0)
    assert {r.page_id for r in good.collect()} == {1, 2} and [r.title for r in bad.collect()] == ["p2"]


def test_http_pages(spark, tmp_path, capsys):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    asked = []

    class Wiki(BaseHTTPRequestHandler):
        def do_GET(self):
            title = parse_qs(urlparse(self.path).query)["titles"][0]
            asked.append(title)
            page = {"pageid": 5, "title": "Real", "extract": "Real MAY refer to: two things", "revisions": [{"revid": 9}]}
            said = {"query": {"pages": [{"missing": True}]}} if title == "gone" else {"query": {"pages": [page], "redirects": [{"from": "Old name", "to": "Real"}]}}
            if title == "late" and asked.count("late") < 2:
                said = {"error": {"code": "maxlag"}}
            self.send_response(503 if title == "down" else 200)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Wiki)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        titles = spark.createDataFrame([("g", "old_name"), ("g", "gone"), ("g", "down"), ("g", "late")], "group string, title string").coalesce(1)
        good, bad = pages.fetch(titles, pages.http_transport(f"http://127.0.0.1:{server.server_port}/api", "test"), per_second=1000, attempts=2, base_delay=0.0)
        rows, lost = good.collect(), {r.title: r.error for r in bad.collect()}
        folder, listed = str(tmp_path / "run"), str(tmp_path / "titles")
        titles.where("title in ('old_name', 'gone')").write.parquet(listed)
        asked.clear()
        main(["fetch", "--titles", listed, "--endpoint", f"http://127.0.0.1:{server.server_port}/api", "--folder", folder], spark)
        assert "pages: 1, errors: 1" in capsys.readouterr().out and sorted(asked) == ["gone", "old_name"]
        main(["filter", "--folder", folder], spark)
        assert "accepted: 0, rejected: 1" in capsys.readouterr().out
    finally:
        server.shutdown()
    assert len(rows) == 1 and (rows[0].page_id, rows[0].revision_id, rows[0].page_title, rows[0].is_disambiguation) == (5, 9, "Real", True)
    assert set(lost) == {"gone", "down"} and lost["gone"].startswith("missing") and "503" in lost["down"]
    assert pages.page_of({"query": {"pages": [{"pageid": 1, "title": "Real"}], "redirects": [{"from": "Old name", "to": "Real"}]}}, "old_name")["is_redirect"]
    assert not pages.page_of({"query": {"pages": [{"pageid": 1, "title": "Real"}]}}, "Real")["is_redirect"]


def test_streamed_results_merge_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text('{"eval_id": "1", "x": 1}\n{"eval_id": "2", "x": 1}\n')
    merge_stream(spark, str(source), target, str(tmp_path / "c1"), "eval_id string, x int").awaitTermination()
    merge_stream(spark, str(source), target, str(tmp_path / "c2"), "eval_id string, x int").awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_web_pages(spark, sf):
    rows = web_pages(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert rows and any(r.raw_text.startswith("== ") for r in rows)


def test_page_reasons_of_ids_and_redirects(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, "A", text(1), None), (1, "B", text(2), None), (2, "C", text(3), "a"), (3, "a ", text(4), None), (4, "D", text(1), None), (5, "E", text(5), "E"), (6, "F", text(6), "B")]
    df = spark.createDataFrame(rows, "page_id long, page_title string, raw_text string, redirect_target string").withColumn("cleaned_text", F.lit(None).cast("string"))
    got = sorted((r.page_id, r.kept, tuple(r.reasons)) for r in dedup.deduplicate_pages(df).collect())
    first = [r for r in got if r[0] == 1]
    assert sorted(r[1] for r in first) == [False, True] and ("duplicate_page_id",) in [r[2] for r in first]
    assert {r[0]: r[2] for r in got if r[0] in (5,)} == {5: ()}
    kept_title = "A" if dedup.numbered(df).where("page_id = 1 and copy = 0").first().page_title == "A" else "B"
    assert (2, kept_title != "A", ("redirect_alias",) if kept_title == "A" else ()) in got and (6, kept_title != "B", ("redirect_alias",) if kept_title == "B" else ()) in got


def test_chunk_places(spark):
    long = " ".join(f"Sentence number {i} has some words." for i in range(60))
    df = spark.createDataFrame([(1, 1, "K", f"Some lead text stands here.\n\n{long}\n\n== S ==\nOne two three four five.\n\n\n  Six seven eight nine ten.", "c")], "page_id long, revision_id long, page_title string, raw_text string, category_group string")
    page = clean.clean_pages(df)
    text = page.first().cleaned_text
    rows = chunks.chunk_pages(page, Chunking(80, 10)).collect()
    assert len(rows) > 6 and all(text[r.char_start : r.char_end] == r.text for r in rows)
    assert chunks.pack(long, 80, 10, ("token", "sentence")) == chunks.windows(long, 80, 10)


def test_fill_takes_places_in_order():
    rows = [(0, "easy", "easy"), (1, None, "easy"), (2, "easy", "medium"), (3, "hard", "hard"), (4, "easy", "easy")]
    assert models.fill(rows, {"easy": 1, "medium": 1, "hard": 1}, True) == ({0: "easy", 2: "medium", 3: "hard"}, 3)
    assert models.fill(rows, {"easy": 3, "medium": 0, "hard": 0}, True)[0] == {0: "easy", 2: "easy", 3: "easy"}


def test_model_steps(spark, built, tmp_path):
    corpus, out, run = built
    found = corpus["chunks"]

    def writer(prompt, system):
        passage = prompt.split("Passage:\n")[1]
        words = passage.split()
        if len(passage) % 7 == 0:
            raise OSError("down")
        if len(passage) % 5 == 0:
            return "no object"
        return json.dumps({"question": f"Which words stand first near {words[3]}?", "gold_answer": words[0], "supporting_sentence": " ".join(words[:8]), "answer_type": "PLACE", "difficulty": "easy", "is_time_sensitive": "false"})

    cfg = Generation(target_candidates=10)
    made = models.generate(found, writer, "m", str(tmp_path / "a"), cfg)
    rows = made["candidates"].collect()
    assert 0 < len(rows) <= 10 and {r.answer_type for r in rows} == {"other"} and all(r.is_time_sensitive for r in rows)
    assert made["raw"].count() >= len(rows) and {r.error.split(":")[0] for r in made["errors"].collect()} <= {"request_error", "json_parse_error"}
    again = models.generate(found, writer, "m", str(tmp_path / "b"), Generation(target_candidates=12), made["candidates"], made["errors"])
    assert len(rows) <= again["candidates"].count() <= 12
    assert again["candidates"].select("candidate_id").distinct().count() == again["candidates"].count()

    judge = lambda prompt, system: '{"answerable": true, "answer_supported": 1, "answer_unique": "x", "question_clear": true, "correct": false, "answer_available": true, "confidence": 0.9}'
    reader = lambda prompt, system: " I don't know "
    told = models.signals(out["candidates"], found, judge, reader)
    assert told.count() > 0 and told.where("answerable and answer_supported and answer_unique and judge_confidence = 0.9 and baseline_prediction = \"I don't know\" and not baseline_judge").count() == told.count()

    def broken(prompt, system):
        raise OSError("down")

    assert models.signals(out["candidates"], found, broken, broken).where("answerable or judge_confidence > 0 or baseline_prediction <> ''").count() == 0
    cases = out["failures"]
    assert models.absence(cases, judge).count() == cases.count() and models.absence(cases, broken).count() == 0
    work = evaluate.jobs(out["seeds"], cases).limit(5)
    answered = models.answers(work, {"a": reader, "b": broken, "c": lambda p, s: "Oslo"}, run, judge)
    assert answered.count() == 15 and answered.where("model_name = 'b' and provider_error is null").count() == 0
    assert answered.where("llm_judge_correct is not null").select("model_name").distinct().count() == 1


def test_merge_by_model(spark):
    old = spark.createDataFrame([("A", 1), ("b", 1)], "model_name string, x int")
    new = spark.createDataFrame([("a", 2)], "model_name string, x int")
    assert sorted(map(tuple, evaluate.merge(old, new).collect())) == [("a", 2), ("b", 1)]


def test_seed_shares(built):
    _, out, run = built
    per = {r.category_group: r.n for r in out["seeds"].groupBy("category_group").agg(F.count("*").alias("n")).collect()}
    assert sum(per.values()) == out["seeds"].count() and seeds.TARGETS.keys() == {"easy", "medium", "hard"}


def test_registered_evaluation_has_similarities(spark, sf, monkeypatch):
    from difflib import SequenceMatcher

    from faultline import queries

    rows = [("s0", "clean", None, "Oslo lies there. More text.", ["Oslo lies there. More text."], "Where?", "Oslo", True, "answer", 0), ("f0", "conflict", "low", "no", ["no"], "Where?", "Oslo", True, "answer", 1)]
    work = spark.createDataFrame(rows, "sample_id string, condition string, severity string, context string, contexts array<string>, question string, gold_answer string, answer_available boolean, expected_behavior string, number int")
    monkeypatch.setattr(queries, "_verified", lambda spark, sf: (None, None, None))
    monkeypatch.setattr(queries.verify, "split_valid", lambda cases: (None, None))
    monkeypatch.setattr(queries.seeds, "clean_contexts", lambda *args: None)
    monkeypatch.setattr(queries.evaluate, "jobs", lambda *args: work)
    got = {(r.sample_id, r.model_name): float(r.semantic_similarity) for r in queries.QUERIES["eval_results"](spark, sf).collect()}
    assert len(got) == 6 and got["s0", "reader_gold"] == 1.0
    assert got["s0", "reader_first"] == pytest.approx(SequenceMatcher(None, "oslo lies there", "oslo").ratio())


def test_tables_of_runs(spark, built, tmp_path, capsys):
    corpus, out, run = built
    source = corpus["chunks"].inputFiles()[0].removeprefix("file:").split("/chunks/")[0]
    ask = lambda *a: (main([*a], spark), capsys.readouterr().out)[1]
    root, reviews = str(tmp_path / "root"), str(tmp_path / "reviews")
    assert "chunks" in ask("freeze", "--source", source, "--folder", f"{root}/a") and "nothing" in ask("freeze", "--source", source, "--folder", f"{root}/a")
    with pytest.raises(FileNotFoundError):
        runs.freeze(spark, root, f"{root}/b")
    assert spark.read.parquet(f"{root}/a/chunks").count() == corpus["chunks"].count()
    for name in ("candidates", "results", "seeds", "verified"):
        out["candidates" if name == "candidates" else name if name in out else "failures"].write.parquet(f"{root}/a/{name}")
    ask("export-review", "--folder", f"{root}/a", "--output", f"{reviews}/a")
    assert "0" in ask("stats", "--folder", f"{root}/a") and "# Validation" in ask("validation-report", "--folder", f"{root}/a")
    counted = runs.run_counts(spark, root, ["a", "none"], reviews).orderBy("run_id").collect()
    n = out["results"].where("accepted").count()
    assert counted[0].accepted == n and counted[0].seeds == out["seeds"].count() and counted[0].failure_verification_pass_rate == 1.0
    assert counted[0].human_acceptance_rate is None and counted[1].candidates == 0 and counted[1].qa_acceptance_rate is None
    assert "## Runs" in ask("stability-report", "--folder", root, "--runs", "a,none") and "## a" in ask("contribution", "--folder", root, "--runs", "a,none")
    assert "no run" in ask("contribution", "--folder", root, "--runs", "none")
    parts = {r.component: r.rejected for r in runs.contributions(runs.all_results(spark, root, ["a"])).collect()}
    assert set(parts) == set(runs.COMPONENTS) and parts["llm_judge"] == 0
    assert runs.latest(spark, root, "seeds") is None
    runs.publish(spark, root, "a")
    assert runs.latest(spark, root, "seeds").count() == counted[0].seeds and runs.latest(spark, root, "absent") is None


def test_single_steps_are_the_whole_run(spark, built, sf, tmp_path, capsys, monkeypatch):
    corpus, out, run = built
    import faultline.__main__ as commands

    monkeypatch.setattr(commands.config, "Run", lambda: run)
    folder = str(tmp_path / "steps")
    ask = lambda *a: (main([*a, "--folder", folder], spark), capsys.readouterr().out)[1]
    ask("filter", "--documents", f"{sf}/documents.parquet")
    for command in ("chunk", "generate", "validate", "select-seeds", "inject"):
        assert ": " in ask(command)
    assert "reader_gold" in ask("evaluate")
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    assert rows(read("chunks"), "chunk_id", "text") == rows(corpus["chunks"], "chunk_id", "text")
    assert rows(read("seeds"), "sample_id", "question") == rows(out["seeds"], "sample_id", "question")
    assert rows(read("evaluation"), "eval_id", "prediction") == rows(out["evaluation"], "eval_id", "prediction")
    n = read("evaluation").count()
    monkeypatch.setattr(commands, "Endpoint", lambda url, model: type("Fixed", (), {"complete": staticmethod(lambda prompt, system="": "Oslo")}))
    assert ask("ping", "--endpoint", "http://x", "--model", "m").strip() == "Oslo"
    ask("evaluate", "--endpoint", "http://x", "--model", "m")
    ask("evaluate", "--endpoint", "http://x", "--model", "m")
    found = {r.model_name: r.n for r in read("evaluation").groupBy("model_name").agg(F.count("*").alias("n")).collect()}
    assert found["m"] * 3 == n and sum(found.values()) == n + found["m"]
    served = ("--endpoint", "http://x", "--model", "m")  # an answer that is no object: a judge says no, a writer gives errors
    assert ask("validate", *served).strip() == "accepted: 0" and read("signals").count() > 0
    assert ask("inject", *served).strip() != "valid cases: 0" and read("absence").count() == 0
    assert ask("generate", *served).strip() == "candidates: 0" and read("generation_errors").count() > 0
    for bad in (["ping", "--model", "m"], ["fetch"], ["chunk"]):
        with pytest.raises(SystemExit):
            main(bad, spark)


def test_logs_places_and_heads(spark):
    said = spark.createDataFrame([("x" * 4001, None), ("short", None), (None, "request_error")], "answer string, error string")
    rows = {r.full_chars: r for r in runs.logged(said, "qa").collect()}
    assert len(rows[4001].response) == 4000 and rows[4001].truncated and len(rows[4001].sha1) == 16
    assert rows[5].response == "short" and rows[5].sha1 is None and rows[None].response is None and not rows[None].truncated
    made = spark.createDataFrame([("easy",), ("easy",), ("odd",)], "difficulty string")
    want = spark.createDataFrame([("easy", 3), ("hard", 1)], "difficulty string, n long")
    assert {tuple(r) for r in runs.quota_counts(made, want).collect()} == {("easy", 3, 2), ("hard", 1, 0), ("odd", 0, 1)}
    done = spark.createDataFrame([("a", 7)], "candidate_id string, slot int")
    new = spark.createDataFrame([("c", 2), ("a", 0), ("b", 1)], "candidate_id string, slot int")
    assert [r.candidate_id for r in runs.resumed(done, new, 2).collect()] == ["a", "b"]
    cases = spark.createDataFrame([("b", "s", "low"), ("a", "t", "low")], "failure_type string, parent_seed_id string, severity string")
    assert runs.first_cases(cases, 1).first().failure_type == "a" and runs.first_cases(cases, 0).count() == 2


def test_near_pairs_are_exact_and_write_no_gram_sets(spark, tmp_path, monkeypatch):
    """All pairs of a brute-force comparison, in less space than the texts' gram sets would take."""
    import random

    rng = random.Random(5)
    rows = []
    for d in range(260):
        words = rows[rng.randrange(len(rows))][1].split(" ") if d % 4 and rows else [f"w{rng.randrange(400)}" for _ in range(rng.choice((1, 3, 20, 60, 300)))]
        for _ in range(rng.choice((0, 1, 2, len(words) // 25))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append((d, " ".join(words)))
    grams = {d: frozenset(t[i : i + 5] for i in range(len(t) - 4)) if len(t) > 4 else frozenset([t]) for d, t in rows}
    least = {}
    for d, g in grams.items():
        least.setdefault(g, d)
    reps = sorted(least.values())
    wanted = {(a, b, len(grams[a] & grams[b]), len(grams[a] | grams[b])) for a in reps for b in reps if a < b and 100 * len(grams[a] & grams[b]) >= 85 * len(grams[a] | grams[b])}
    monkeypatch.setattr(dedup, "shared_folder", lambda _: str(tmp_path / "shared"))
    members, pairs = dedup.near_pairs(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"))
    assert {tuple(r) for r in pairs.collect()} == wanted and len(wanted) > 50
    assert {tuple(r) for r in members.collect()} == {(d, least[g]) for d, g in grams.items()}
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < sum(8 * len(g) for g in grams.values())


def test_pages_of_unique_ids_are_numbered_where_they_lie(spark):
    pages = lambda ids: spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "page_id long, raw_text string")
    once, again = dedup.numbered(pages([1, 2, 3])), dedup.numbered(pages([1, 2, 1, None, None]))
    assert "Window" not in once._jdf.queryExecution().toString() and [r[0] for r in once.select("copy").collect()] == [0, 0, 0]
    assert sorted((r[0] or 0, r[1]) for r in again.select("page_id", "copy").collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_candidates_meet_chunks_of_their_own_pages_only(spark, sf):
    from faultline import queries

    rows, found = queries._candidates(spark, sf)
    asked = {r[0] for r in rows.select("source.page_id").distinct().collect()}
    assert {r[0] for r in found.select("page_id").distinct().collect()} == asked
    assert len(asked) < queries._pages(spark, sf).count()
    assert rows.join(found, F.col("source.chunk_id") == F.col("chunk_id"), "left_anti").count() == 0


def test_results_draw_and_verify_once(spark, sf, monkeypatch):
    from faultline import queries
    from faultline.operators import pools, verify

    draws, verified = [], []
    draw, split = pools.draw, verify.split_valid
    monkeypatch.setattr(pools, "draw", lambda *a: draws.append(a[3]) or draw(*a))
    monkeypatch.setattr(verify, "split_valid", lambda v: verified.append(v) or split(v))
    queries._results(spark, sf)
    assert len(draws) == 1 and "clean" in draws[0]
    assert verified[0].inputFiles() and "/verified/" in verified[0].inputFiles()[0]


def test_headers_are_searched_twice_however_often_sections_name_them(spark):
    from faultline.operators.clean import HEADER, with_sections

    texts = [None, "", " \n", "no header", "a\n== B ==\nc", "== A ==\n\n=== B = C ===  \nx\n== D ==", "\n== x =\n=== y ==\n== == ==\nz"]
    found = with_sections(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "page_id int, raw_text string"), "raw_text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("split(") == 1
    for row in found.collect():
        heads, text = list(re.finditer(HEADER.replace("(?md)", "(?m)"), row.raw_text or "")), row.raw_text or ""
        ends = [m.start() for m in heads[1:]] + [len(text)]
        expected = [(m[2].strip(), len(m[1]), m.start(), e, text[m.end() : e].strip()) for m, e in zip(heads, ends)]
        lead = text[: heads[0].start()] if heads else text
        expected = ([("Lead", 1, 0, len(lead), lead.strip())] if lead.strip() else []) + expected
        assert [(s.section_title, s.level, s.char_start, s.char_end, s.text) for s in row.sections] == expected


def test_hard_negatives_are_scored_once_and_are_the_best(spark, monkeypatch):
    from faultline.operators import failures

    monkeypatch.setattr(failures, "GROUP", 3, raising=False)
    monkeypatch.setattr(failures, "CHUNKS_AT_ONCE", 64, raising=False)
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice("red blue green stone river cloud tree bird night morning".split()) for _ in range(n))
    seeds = [(f"s{i}", rng.choice(["en", "de", None, "rare", ""]), (i * 7) % 40, ["tree", "night", "", "zz", "!"][i % 5], some(i % 6), some(3)) for i in range(20)]
    chunks = [(f"c{i}", i % 40, rng.choice(["en", "de", None, ""]), some(rng.randrange(0, 12))) for i in range(700)]
    s = spark.createDataFrame(seeds, "sample_id string, category_group string, page long, gold_answer string, question string, supporting_sentence string").withColumn("source", F.struct(F.col("page").alias("page_id")))
    c = spark.createDataFrame(chunks, "chunk_id string, page_id long, category_group string, text string").repartition(3)
    found = failures.near_misses(s, c, 4)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    expected = set()
    for sid, cat, page, answer, question, support in seeds:
        query = {w for w in f"{question} {support}".split() if len(w) > 2}
        ranked = []
        for cid, p, k, text in chunks:
            overlap = len(query & set(text.split())) / max(len(query), 1)
            if p != page and text and answer.strip("!") and answer not in text:
                ranked.append((overlap + 2.0 * bool(cat and cat == k), cid, overlap))
        expected |= {(sid, x[1], x[2], r) for r, x in enumerate(sorted(ranked, reverse=True)[:4], 1)}
    assert {(r.sample_id, r.chunk_id, r.overlap, r.rank) for r in found.collect()} == expected


def test_draws_are_made_once_and_are_the_least(spark, monkeypatch):
    import hashlib

    from faultline.operators import pools

    monkeypatch.setattr(pools, "AT_ONCE", 200, raising=False)
    run = Run(failures=Failures(context_budget=3))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    nr = lambda h, k=0: int(h[8 * k : 8 * k + 8], 16) % pools.PRIME
    seeds = [(f"s{i}", ["en", None, "none"][i % 3], None if i == 4 else i) for i in range(6)]
    chunks = [(f"c{i:03}", None if i % 50 == 0 else i % 9, ["en", "de", None][i % 3], f"text {i % 70}") for i in range(400)]
    s = spark.createDataFrame(seeds, "sample_id string, category_group string, page long").withColumn("source", F.struct(F.col("page").alias("page_id")))
    c = spark.createDataFrame(chunks, "chunk_id string, page_id long, category_group string, text string").repartition(3)
    got = pools.draw(s, c, run, ("a", "b"))
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    expected = set()
    for purpose in ("a", "b"):
        for sid, cat, page in seeds:
            key = md5(f"{run.seed}:{purpose}:{sid}")
            for same in (True, False):
                least = {}
                for cid, p, k, text in chunks:
                    if (k == cat) == same and (p is None or p != page):
                        at = ((nr(md5(text)) * nr(key, 0) + nr(key, 1)) % pools.PRIME, md5(text))
                        least[at] = min(cid, least.get(at, cid))
                expected |= {(purpose, sid, same, r, least[at]) for r, at in enumerate(sorted(least)[: pools.drawn_by(run)], 1)}
    assert {tuple(r) for r in got.collect()} == expected


def test_signs_of_a_good_chunk_by_cost(spark):
    """Capitalised words decide before the patterns that cost most; any sign is enough, in any text."""
    signs = ["12 x", "x 1999", "in May", "IN MAY", "mayor", "Aa Bb", "AaBb", "Aa\nBb", "AAA Bb", "Aa BB", "a1999b", "7", "x20 y", "١٢", ""]
    expected = [bool(re.search(r"\b\d{2,}\b", s) or re.search(rf"(?i)\b(1\d{{3}}|20\d{{2}})\b|\b({candidates.MONTHS})\b", s) or len(re.findall("[A-Z][a-z]+", s)) >= 2) for s in signs]
    good = candidates.is_good_chunk(Generation(min_chunk_tokens=0, max_chunk_tokens=999))
    rows = spark.createDataFrame([(i, "s", 100, s + " ~" * 100) for i, s in enumerate(signs)], "i int, section_title string, token_count int, text string")
    assert [r.g for r in rows.select("i", good.alias("g")).orderBy("i").collect()] == expected
    plan = rows.where(good)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("[A-Z][a-z]") < plan.index("January")
