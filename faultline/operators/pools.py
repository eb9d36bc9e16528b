"""Distractors of seeds.

A seed draws at random from all chunks of its own category (hard) or of the others (easy), never from its
own page, and no text twice. A draw is the order of a keyed hash: each text has a number, each draw (a seed
and a purpose) a line through the residues of a prime, and the draw takes the texts with the least values
on its line. So a task goes over its chunks once for all draws, keeps the best few of each, and passes on
their numbers alone; the texts of those that win overall are read afterwards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import Run
from faultline.functions.text import keyed
from faultline.operators.dedup import held, shared_folder

#: The prime of the lines; texts and draws are numbered below it.
PRIME = 2**31 - 1
#: Seeds that meet every chunk, at most: they travel to the tasks.
MOST_SEEDS = 20_000
#: Values of draws that are computed at once, and chunk ids that are sent to all tasks, at most.
AT_ONCE, FEW = 500_000, 200_000
#: Stands for a chunk without a page; no seed has it.
NO_PAGE = -(2**63)


def number(hexadecimal: Column, at: int = 0) -> Column:
    """A number below the prime from eight digits of a hash."""
    return F.conv(F.substring(hexadecimal, 8 * at + 1, 8), 16, 10).cast("long") % PRIME


def drawn_by(run: Run) -> int:
    """Texts of each kind that a draw takes: all that any operator uses, however many of them it drops."""
    return max(2 * run.failures.context_budget, run.failures.context_budget + 3)


def collected(seeds: DataFrame, *columns: Column | str) -> list:
    """The seeds on the driver: a set that the settings bound, checked."""
    rows = seeds.select(*columns).limit(MOST_SEEDS + 1).collect()
    if len(rows) > MOST_SEEDS:
        raise ValueError(f"more than {MOST_SEEDS} seeds cannot meet every chunk at once; split them")
    return rows


def draw(seeds: DataFrame, chunks: DataFrame, run: Run, purposes: tuple[str, ...]) -> DataFrame:
    """purpose, sample_id, same, rank, chunk_id: the least values of each draw among texts of the seed's
    category (``same``) and among the others. Categories compare null-safe. The rows are held: each use of
    them would go over all chunks again."""
    most = drawn_by(run)
    known = collected(seeds, "sample_id", "category_group", F.col("source.page_id").alias("page"), *(F.struct(*(number(keyed(run.seed, p, F.col("sample_id")), k).alias(n) for k, n in enumerate("bc"))).alias(p) for p in purposes))
    draws = [(p, r["sample_id"], r["category_group"], r["page"], r[p]["b"], r[p]["c"]) for p in purposes for r in known]
    shared = seeds.sparkSession.sparkContext.broadcast(draws)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = shared.value
        b, c = (np.array([d[k] for d in draws], np.int64) for k in (4, 5))
        pages = np.array([-1 if d[3] is None else d[3] for d in draws], np.int64)
        cats: dict[object, np.ndarray] = {}
        best: list[list[tuple[int, str, str]]] = [[] for _ in range(2 * len(draws))]  # by draw: other, same category
        floor = np.full(2 * len(draws), PRIME, np.int64)
        size = 16  # few chunks while every chunk is among the best
        for batch in batches if draws else ():
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size)
                at, size = at + size, min(2 * size, max(16, AT_ONCE // len(draws)))
                chunks, cat, marks = (part.column(n).to_pylist() for n in (0, 2, 3))
                page, a = part.column(1).fill_null(NO_PAGE).to_numpy(), part.column(4).to_numpy()
                for own in dict.fromkeys(cat):
                    if own not in cats:
                        cats[own] = 2 * np.arange(len(draws)) + np.array([d[2] == own for d in draws])
                    to, rows = cats[own], np.array([i for i, x in enumerate(cat) if x == own])
                    value = (a[rows][:, None] * b + c) % PRIME
                    for i, k in zip(*(x.tolist() for x in np.nonzero((value <= floor[to]) & (page[rows][:, None] != pages)))):
                        chunk, heap, item = chunks[rows[i]], best[to[k]], (-int(value[i, k]), marks[rows[i]], chunks[rows[i]])
                        if len(heap) == most and item[0] < heap[0][0]:  # the floor has fallen since
                            continue
                        twin = next((j for j, x in enumerate(heap) if x[:2] == item[:2]), None)
                        if twin is not None:  # of equal texts the smallest chunk stays
                            if chunk < heap[twin][2]:
                                heap[twin] = item
                                heapq.heapify(heap)
                        elif len(heap) < most:
                            heapq.heappush(heap, item)
                        else:
                            heapq.heappushpop(heap, item)
                        if len(heap) == most:
                            floor[to[k]] = -heap[0][0]
        found = [(*draws[j // 2][:2], bool(j % 2), -v, mark, chunk) for j, heap in enumerate(best) for v, mark, chunk in heap]
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found) if found else [()] * 6, kinds)], ["purpose", "sample_id", "same", "value", "mark", "chunk_id"])

    mark = F.md5(F.col("text").cast("binary"))
    rows = chunks.select("chunk_id", F.col("page_id").cast("long"), "category_group", mark.alias("mark"), number(mark).alias("a"))
    few = rows.mapInArrow(work, "purpose string, sample_id string, same boolean, value long, mark string, chunk_id string")
    few = few.groupBy("purpose", "sample_id", "same", "value", "mark").agg(F.min("chunk_id").alias("chunk_id"))
    w = Window.partitionBy("purpose", "sample_id", "same").orderBy("value", "mark")
    few = few.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("purpose", "sample_id", "same", "rank", "chunk_id")
    return held(few, f"{shared_folder(seeds.sparkSession)}/drawn")


def attach_pools(seeds: DataFrame, chunks: DataFrame, run: Run, *purposes: str) -> DataFrame:
    """Seeds, once for each ``purpose``, with gold_text, previous_text, next_text (null if the gold chunk or
    the neighbour is missing) and the arrays ``easy`` and ``hard`` of struct(chunk_id, text, category), in
    the order of the draw. If no chunk of the wanted kind exists, any other page's will do."""
    picked = draw(seeds, chunks, run, purposes)
    asked = F.broadcast(seeds.select("sample_id", F.col("source.chunk_id").alias("chunk_id")))
    gold = chunks.join(asked, "chunk_id").select("sample_id", F.col("text").alias("gold_text"), "previous_chunk_id", "next_chunk_id")
    rows = seeds.join(gold, "sample_id", "left")
    for name in ("previous", "next"):
        near = rows.select(F.col(f"{name}_chunk_id").alias("chunk_id")).distinct()
        texts = chunks.join(F.broadcast(near), "chunk_id").select(F.col("chunk_id").alias(f"{name}_chunk_id"), F.col("text").alias(f"{name}_text"))
        rows = rows.join(texts, f"{name}_chunk_id", "left")
    wanted = picked.select("chunk_id").distinct()
    wanted = F.broadcast(wanted) if picked.count() <= FEW else wanted  # else the texts of all chunks would be dealt out
    texts = chunks.join(wanted, "chunk_id", "left_semi").select("chunk_id", "text", F.col("category_group").alias("category"))
    item = F.struct("rank", "chunk_id", "text", "category")
    pool = lambda same: F.transform(F.array_sort(F.collect_list(F.when(F.col("same") == F.lit(same), item))), lambda d: d.dropFields("rank"))
    pools = picked.join(texts, "chunk_id").groupBy("purpose", "sample_id").agg(pool(True).alias("_hard"), pool(False).alias("_easy"))
    rows = rows.withColumn("purpose", F.explode(F.array(*map(F.lit, purposes)))).join(pools, ["purpose", "sample_id"], "left")
    none = F.array().cast(pools.schema["_easy"].dataType)
    either = lambda a, b: F.coalesce(F.when(F.size(a) > 0, F.col(a)), F.col(b), none)
    return rows.withColumns({"hard": either("_hard", "_easy"), "easy": either("_easy", "_hard")}).drop("_hard", "_easy", "previous_chunk_id", "next_chunk_id")
