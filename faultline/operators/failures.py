"""The six failure operators: a seed and its pools become contexts with one controlled fault.

Each operator is a set of array expressions over seeds that carry their gold chunk, its neighbours and
their distractors (``operators.pools``), three severities each. The pools of all operators are drawn in
one pass over the chunks. Seeds without their gold chunk give no case, except for hard negatives.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import SEVERITY_DIFFICULTY, STAGE_OF, Run
from faultline.functions.text import alternate_answer, conflict_passage, contains_answer, halves, keyed, matches_support, normalize_answer, split_sentences, strip, words
from faultline.operators.dedup import held, shared_folder
from faultline.operators.pools import NO_PAGE, attach_pools, collected

PARAMETERS = {
    "removed": "string", "num_contexts": "int", "noise_ratio": "double", "num_distractors": "int", "distractor_hardness": "string", "gold_position": "int",
    "relative_position": "double", "num_splits": "int", "split_sentence": "string", "split_pieces": "array<string>", "gold_positions": "array<int>",
    "distractor_positions": "array<int>", "alternate_answer": "string", "conflict_passage": "string", "conflict_positions": "array<int>", "num_conflicts": "int",
    "distractor_chunk_ids": "array<string>", "mean_lexical_overlap": "double", "max_lexical_overlap": "double", "same_category_only": "boolean",
}
STRINGS = "array<string>"


def _texts(pool: str, n: Column | int) -> Column:
    return F.slice(F.transform(pool, lambda d: d["text"]), F.lit(1), n if isinstance(n, Column) else F.lit(n))


def _full(a: Column) -> Column:
    return F.filter(a, lambda t: t.isNotNull() & (strip(t) != ""))


def _positions(a: Column, wanted: Column) -> Column:
    return F.filter(F.transform(a, lambda t, i: F.when(t == wanted, i)), lambda i: i.isNotNull())


def _by_severity(low: Column, medium: Column, high: Column) -> Column:
    s = F.col("severity")
    return F.when(s == "low", low).when(s == "medium", medium).otherwise(high)


def _seeds(pooled: DataFrame, run: Run, purpose: str) -> DataFrame:
    """Seeds of one purpose with a found gold chunk, once for each severity."""
    rows = pooled.where((F.col("purpose") == purpose) & F.col("gold_text").isNotNull()).drop("purpose")
    return rows.withColumn("severity", F.explode(F.array(*map(F.lit, run.failures.severities))))


def _cases(rows: DataFrame, kind: str, available: bool, difficulty: Column | None = None, **parameters: Column) -> DataFrame:
    """The case envelope around ``contexts``; parameters an operator does not have are null."""
    level = F.lit(None).cast("double")
    for name, value in SEVERITY_DIFFICULTY.items():
        level = F.when(F.col("severity") == name, F.lit(value)).otherwise(level)
    parameters["num_contexts"] = F.size("contexts")
    packed = F.struct(*(parameters.get(n, F.lit(None)).cast(t).alias(n) for n, t in PARAMETERS.items()))
    return rows.select(
        F.concat_ws("__", "sample_id", F.lit(kind), "severity").alias("failure_id"), F.col("sample_id").alias("parent_seed_id"), F.lit(kind).alias("failure_type"), F.lit(STAGE_OF[kind]).alias("stage"),
        "severity", (level if difficulty is None else difficulty).cast("double").alias("difficulty"), "question", "gold_answer", "supporting_sentence", "contexts", F.lit(available).alias("answer_available"),
        F.lit("answer" if available else "abstain").alias("expected_behavior"), "source", "category_group", packed.alias("parameters"),
    )


def missing_evidence(pooled: DataFrame, run: Run) -> DataFrame:
    """The evidence goes: its sentence, its chunk, or all that is near it."""
    b = run.failures.context_budget
    rows = _seeds(pooled, run, "missing_evidence")
    gold, support = F.col("gold_answer"), strip(F.col("supporting_sentence"))
    clean = lambda a: F.filter(a, lambda t: ~contains_answer(t, gold))
    near = F.filter(F.array("previous_text", "next_text"), lambda t: t.isNotNull())
    kept = clean(F.filter(split_sentences(F.col("gold_text")), lambda s: ~matches_support(s, support)))
    low = F.concat(F.array(strip(F.array_join(kept, " "))), clean(F.slice(near, 1, 1)))
    high = F.slice(clean(_texts("hard", min(6, 2 * b))), 1, min(3, b))
    rows = rows.withColumn("contexts", _full(_by_severity(low, F.slice(clean(near), 1, 2), high)))
    return _cases(rows, "missing_evidence", False, removed=_by_severity(F.lit("supporting_sentence"), F.lit("gold_chunk"), F.lit("all_related_evidence")))


def context_noise(pooled: DataFrame, run: Run) -> DataFrame:
    """The gold chunk among distractors, shuffled by a keyed hash."""
    b, ratios = run.failures.context_budget, run.failures.noise_ratios
    number = {s: min(max(1, round(b * r)), b - 1) for s, r in ratios.items()}
    rows = _seeds(pooled, run, "context_noise")
    of = lambda d, default: _by_severity(*(F.lit(d.get(s, default)) for s in ("low", "medium", "high")))
    rows = rows.withColumn("taken", F.when(F.col("severity") == "low", _texts("easy", of(number, 1))).otherwise(_texts("hard", of(number, 1))))
    key = lambda i: keyed(run.seed, "noise_order", F.col("sample_id"), F.col("severity"), i)
    mixed = F.array_sort(F.transform(F.concat("taken", F.array("gold_text")), lambda t, i: F.struct(key(i).alias("o"), t.alias("t"))))
    rows = rows.withColumn("contexts", F.transform(mixed, lambda x: x["t"]))
    ratio = of(ratios, 0.5)
    hardness = F.when(F.col("severity") == "low", "easy").otherwise("hard")
    return _cases(rows, "context_noise", True, ratio, noise_ratio=ratio, num_distractors=F.size("taken"), distractor_hardness=hardness, gold_position=F.array_position("contexts", F.col("gold_text")) - 1)


def evidence_position(pooled: DataFrame, run: Run) -> DataFrame:
    """The gold chunk in front, in the middle or last among the same fillers at every severity."""
    rows = _seeds(pooled, run, "evidence_position").withColumn("fillers", _texts("easy", max(2, run.failures.context_budget - 1)))
    total = F.size("fillers") + 1
    rows = rows.withColumn("pos", _by_severity(F.lit(0), F.floor(total / 2).cast("int"), total - 1))
    rows = rows.withColumn("contexts", F.array_insert("fillers", F.col("pos") + 1, F.col("gold_text")))
    where = F.round(F.col("pos") / F.greatest(total - 1, F.lit(1)), 3)
    return _cases(rows, "evidence_position", True, where, gold_position=F.col("pos"), relative_position=where)


def chunk_boundary(pooled: DataFrame, run: Run) -> DataFrame:
    """The supporting sentence cut over two or three contexts, with distractors between."""
    rows = _seeds(pooled, run, "chunk_boundary").withColumn("support", strip(F.col("supporting_sentence")))
    rows = rows.withColumns({"sentences": split_sentences(F.col("gold_text")), "cut": halves(F.col("support"))})
    at = F.coalesce(F.get(F.filter(F.transform("sentences", lambda s, i: F.when(F.contains(s, F.col("support")), i)), lambda i: i.isNotNull()), F.lit(0)), F.size("sentences"))
    rows = rows.withColumn("at", at)
    joined = lambda a: strip(F.array_join(a, " "))
    rows = rows.withColumns({"before": joined(F.slice("sentences", F.lit(1), F.col("at"))), "after": joined(F.slice("sentences", F.col("at") + 2, F.size("sentences"))), "second": words(F.col("cut.b"))})
    middle = F.greatest(F.lit(1), F.floor(F.size("second") / 2).cast("int"))
    rows = rows.withColumns({"b1": F.array_join(F.slice("second", F.lit(1), middle), " "), "b2": F.array_join(F.slice("second", middle + 1, F.size("second")), " ")})
    gold = lambda *parts: F.struct(strip(F.concat_ws(" ", *parts)).alias("t"), F.lit(True).alias("g"))
    noise = lambda k: F.struct(strip(F.coalesce(F.get("hard", F.lit(k))["text"], F.lit(""))).alias("t"), F.lit(False).alias("g"))
    first, two = gold("before", "cut.a"), gold("cut.b", "after")
    slots = _by_severity(F.array(first, two), F.array(first, noise(0), two), F.array(first, noise(0), gold("b1"), noise(1), gold("b2", "after")))
    rows = rows.withColumns({"slots": F.filter(slots, lambda s: s["t"] != ""), "pieces": F.when(F.col("severity") == "high", F.array("cut.a", "b1", "b2")).otherwise(F.array("cut.a", "cut.b"))})
    rows = rows.where(F.size(F.filter("slots", lambda s: s["g"])) == F.size("pieces")).withColumn("contexts", F.transform("slots", lambda s: s["t"]))
    places = lambda g: F.filter(F.transform("slots", lambda s, i: F.when(s["g"] == F.lit(g), i)), lambda i: i.isNotNull())
    return _cases(rows, "chunk_boundary", True, num_splits=F.size("pieces"), split_sentence=F.col("support"), split_pieces=F.col("pieces"), gold_positions=places(True), distractor_positions=places(False))


def conflict(pooled: DataFrame, run: Run) -> DataFrame:
    """The gold chunk and a passage that claims another answer."""
    b = run.failures.context_budget
    rows = _seeds(pooled, run, "conflict").withColumn("support", strip(F.col("supporting_sentence")))
    rows = rows.withColumn("other", alternate_answer(F.col("gold_answer"), F.col("answer_type"), run.seed, "conflict", F.col("sample_id"), F.col("severity")))
    rows = rows.withColumn("passage", strip(conflict_passage(F.col("support"), F.col("gold_answer"), F.col("other"))))
    rows = rows.where((F.col("passage") != "") & (normalize_answer(F.col("passage")) != normalize_answer(F.col("supporting_sentence"))))
    contrary = F.concat(F.lit("Contrary to other reports, the correct answer is "), F.col("other"), F.lit(", not "), F.col("gold_answer"), F.lit("."))
    rows = rows.withColumn("passage", F.when(contains_answer(F.col("passage"), F.col("gold_answer")), contrary).otherwise(F.col("passage")))
    rows = rows.withColumn("fillers", F.filter(_full(_texts("easy", max(2, b))), lambda t: t != F.col("gold_text")))
    one, gold = F.array("passage"), F.array("gold_text")
    high = F.slice(F.concat(one, F.slice("fillers", 1, max(0, b - 3)), one, gold), 1, b)
    rows = rows.withColumn("contexts", _full(_by_severity(F.concat(gold, one), F.concat(one, gold, F.slice("fillers", 1, 2)), high)))
    claims = _positions(F.col("contexts"), F.col("passage"))
    return _cases(rows, "conflict", True, alternate_answer=F.col("other"), conflict_passage=F.col("passage"), conflict_positions=claims, gold_positions=_positions(F.col("contexts"), F.col("gold_text")), num_conflicts=F.size(claims))


#: Seeds of one category that are scored at once, and chunks at most.
GROUP, CHUNKS_AT_ONCE = 256, 2048


def near_misses(seeds: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best chunks for each seed that lie on another page and lack its answer: same category first,
    then the share of the seed's words they hold, then the chunk id, all falling.

    Every chunk is scored against all seeds inside its task, and only a task's best k for each seed leave
    it, without their texts. The seeds are a bounded set (the target of the selection, checked) and travel
    as one broadcast; so the best are few, and are held: every use of them would score all chunks again.
    Once the k best of a group of seeds are of its category, no other chunk can be among them.
    """
    known = collected(seeds, "sample_id", F.coalesce("category_group", F.lit("")).alias("cat"), F.col("source.page_id").alias("page"), normalize_answer(F.col("gold_answer")).alias("answer"), normalize_answer(F.concat_ws(" ", "question", "supporting_sentence")).alias("query"))
    queries = [sorted({w for w in r["query"].split(" ") if len(w) > 2}) for r in known]
    shared = seeds.sparkSession.sparkContext.broadcast(([(r["sample_id"], r["cat"], NO_PAGE if r["page"] is None else r["page"], r["answer"]) for r in known], queries))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, queries = shared.value
        place = {w: n for n, w in enumerate(sorted({w for q in queries for w in q}))}
        vocabulary = pa.array(list(place), pa.string())
        groups = []
        for cat in sorted({r[1] for r in rows}):
            own = [s for s, r in enumerate(rows) if r[1] == cat and r[3]]  # an empty answer is in every text
            for some in (own[at : at + GROUP] for at in range(0, len(own), GROUP)):
                used = sorted({place[w] for s in some for w in queries[s]})
                local = np.full(len(place), -1, np.int32)
                local[used] = np.arange(len(used))
                holds = np.zeros((len(used), len(some)), np.float32)
                for j, s in enumerate(some):
                    holds[[local[place[w]] for w in queries[s]], j] = 1
                groups.append((cat, np.array(some), np.array([rows[s][2] for s in some], np.int64), np.array([max(len(queries[s]), 1) for s in some], float), local, holds))
        best: list[list[tuple]] = [[] for _ in rows]
        floor = np.full(len(rows), -1.0)
        size = 64  # few chunks while every chunk is among the best
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size)
                at, size = at + size, min(2 * size, CHUNKS_AT_ONCE)
                split = pc.split_pattern(part.column(3), " ")
                which = pc.index_in(pc.list_flatten(split), value_set=vocabulary)
                known_word = pc.is_valid(which).to_numpy(zero_copy_only=False)
                which, parent = which.drop_null().to_numpy(), pc.list_parent_indices(split).to_numpy()[known_word]
                page, cats = part.column(0).fill_null(NO_PAGE).to_numpy(), part.column(2).fill_null("")
                names, norms = part.column(1).to_pylist(), part.column(3).to_pylist()
                for cat, some, pages, sizes, local, holds in groups:
                    same = pc.equal(cats, cat).to_numpy(zero_copy_only=False) if cat else np.zeros(part.num_rows, bool)
                    picked = np.flatnonzero(same) if (floor[some] >= 2).all() else np.arange(part.num_rows)
                    row = np.full(part.num_rows, -1)
                    row[picked] = np.arange(len(picked))
                    r, w = row[parent], local[which]
                    both = (r >= 0) & (w >= 0)
                    found = np.zeros((len(picked), len(holds)), np.float32)
                    found[r[both], w[both]] = 1
                    overlap = (found @ holds).astype(float) / sizes
                    score = overlap + 2.0 * same[picked][:, None]
                    for i, j in zip(*(x.tolist() for x in np.nonzero((score >= floor[some]) & (page[picked][:, None] != pages)))):
                        s, n = some[j], picked[i]
                        item = (float(score[i, j]), names[n], float(overlap[i, j]))
                        heap = best[s]
                        if (len(heap) < k or item[:2] > heap[0][:2]) and rows[s][3] not in norms[n]:
                            heapq.heappush(heap, item) if len(heap) < k else heapq.heapreplace(heap, item)
                            if len(heap) == k:
                                floor[s] = heap[0][0]
        out = [(rows[s][0], x[1], x[0], x[2]) for s, heap in enumerate(best) for x in heap]
        kinds = [pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 4, kinds)], ["sample_id", "chunk_id", "score", "overlap"])

    full = chunks.where(strip(F.col("text")) != "").select("page_id", "chunk_id", "category_group", normalize_answer(F.col("text")).alias("norm"))
    top = full.mapInArrow(work, "sample_id string, chunk_id string, score double, overlap double")
    w = Window.partitionBy("sample_id").orderBy(F.desc("score"), F.desc("chunk_id"))
    top = held(top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), f"{shared_folder(seeds.sparkSession)}/near")
    texts = chunks.join(F.broadcast(top.select("chunk_id").distinct()), "chunk_id", "left_semi").select("chunk_id", "text", F.col("category_group").alias("category"))
    return F.broadcast(top).join(texts, "chunk_id")


def hard_negative(seeds: DataFrame, chunks: DataFrame, run: Run) -> DataFrame:
    """Topical near misses in place of the evidence."""
    b = run.failures.context_budget
    ranked = near_misses(seeds, chunks, b)
    # overlaps in ten-thousandths: whole numbers have one rounding and one sum
    item = F.struct("rank", "text", "chunk_id", F.floor(F.col("overlap") * 10000 + 0.5).alias("parts"), "category")
    best = ranked.groupBy("sample_id").agg(F.array_sort(F.collect_list(item)).alias("best"))
    rows = seeds.join(best, "sample_id").withColumn("severity", F.explode(F.array(*map(F.lit, run.failures.severities))))
    rows = rows.withColumn("best", F.slice("best", F.lit(1), _by_severity(F.lit(min(2, b)), F.lit(min(max(3, b // 2), b)), F.lit(b))))
    rows = rows.withColumns({"contexts": F.transform("best", lambda x: x["text"]), "parts": F.transform("best", lambda x: x["parts"])})
    total, n = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x), F.greatest(F.size("parts"), F.lit(1))
    mean = F.floor((2 * total + n) / (2 * n)) / 10000
    return _cases(
        rows, "hard_negative", False, mean, distractor_chunk_ids=F.transform("best", lambda x: x["chunk_id"]), mean_lexical_overlap=mean, max_lexical_overlap=F.array_max("parts") / 10000,
        same_category_only=F.forall("best", lambda x: x["category"].eqNullSafe(F.col("category_group"))),
    )


#: Operators over seeds with pools; hard negatives rank all chunks themselves.
POOLED = {"missing_evidence": missing_evidence, "context_noise": context_noise, "chunk_boundary": chunk_boundary, "evidence_position": evidence_position, "conflict": conflict}
OPERATORS = {**POOLED, "hard_negative": hard_negative}


def inject(seeds: DataFrame, chunks: DataFrame, run: Run, types: tuple[str, ...] | None = None, folder: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """All configured operators (or ``types``) in one table; new operators register in POOLED or OPERATORS.
    With several, give a ``folder`` to hold the pools in, so that they are drawn once; with a folder, pools of
    further purposes (``also``) are drawn and held along with them."""
    types = types or run.failures.types
    drawing = tuple(t for t in types if t in POOLED)
    pooled = attach_pools(seeds, chunks, run, *drawing, *(also if folder is not None else ())) if drawing or (also and folder is not None) else None
    if pooled is not None and folder is not None:
        pooled.write.parquet(f"{folder}/pools")
        pooled = seeds.sparkSession.read.parquet(f"{folder}/pools")
    parts = [POOLED[t](pooled, run) if t in POOLED else OPERATORS[t](seeds, chunks, run) for t in types]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
