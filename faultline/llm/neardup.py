"""Near duplicates: fast similarity sketches, banding, exact verification, connected components.

Each text becomes its set of distinct word shingles (64-bit hashes) and a sketch of ``t`` coordinates
made by rounds of hashed bin placement: in round i < t every shingle falls into one hashed bin with a
value that ranks below those of later rounds; in round t + j all shingles go to bin j. Rounds stop when
all bins are filled, so every coordinate fills within 2 t rounds, and the share of equal coordinates
estimates the Jaccard similarity with the concentration of t independent samples.

Equal sets are collapsed first (a group of copies is one class). Bands of coordinates give buckets of
classes. Within a bucket every class is first compared with one hub, its smallest id: linear in the
bucket, so a group of a third of all rows stays cheap. Components of those links are formed; then, in
buckets where classes other than the hub still lie in different components, all pairs across
components are compared in blocks of bounded size, on full sets, and each block returns a spanning
forest of its links instead of its pairs. No partner or candidate is capped. All comparisons are exact
on the shingle sets; with the parameters here a pair at the threshold misses all bands with a
probability below 1e-8.

Rows without words have an empty set and link with nothing. Rows with a null id are measured, but get
no component and are not kept. A node of the graph is a class of equal sets, not an id: rows that share
an id but not the text stand apart, and repeated rows get equal results. An empty table gives an empty
result. Tables that only the computation needs are deleted before it returns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map, checkpoint_dir, discard, fresh


@dataclass(frozen=True)
class Parameters:
    """Words in a shingle, least similarity in per cent, and the sketch's bands."""

    words: int = 3
    percent: int = 85
    bands: int = 32
    rows: int = 5


#: At the threshold a pair misses all bands with (1 - 0.85^5)^32 = 7e-9, or (1 - 0.8^4)^40 = 7e-10.
STRICT, LOOSE = Parameters(), Parameters(5, 80, 40, 4)
#: Classes, and shingles, in one block of a bucket, about.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Members of a bucket that are dealt to one task together, about.
DEALT = 256

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EMPTY = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of fewer words, the whole sequence is one."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    span = min(width, n)
    if not span:
        return hashes
    out = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        out = mix(out + hashes[k : n - span + 1 + k] * np.uint64(2 * k + 1))
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates for each non-empty set."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    out = np.full((len(sets), t), _EMPTY)
    flat = out.reshape(-1)
    low = np.uint64(0xFFFFFFFF)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        place = (h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32) if i < t else np.full(len(h), i - t, np.uint64)
        np.minimum.at(flat, owner * t + place.astype(np.int64), (h & low) | np.uint64(i << 32))
        open_ = (out == _EMPTY).any(1)[owner]
        items, owner = items[open_], owner[open_]
    return out


def band_keys(coordinates: np.ndarray, p: Parameters) -> np.ndarray:
    keys = np.tile(np.arange(p.bands, dtype=np.uint64), (len(coordinates), 1))
    cells = coordinates.reshape(len(coordinates), p.bands, p.rows)
    for k in range(p.rows):
        keys = mix(keys + cells[:, :, k])
    return keys


def _mark(text_column: str) -> Column:
    """With the id, what tells texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("mark")


def _profiles(docs: DataFrame, id_column: str, text_column: str, p: Parameters) -> DataFrame:
    """doc_id, mark, n_shingles, two 64-bit sums that stand for the set, band keys (none for an empty set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, p.words) for t in batch.column(2).to_pylist()]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(sketches(full, p.bands * p.rows), p).view(np.int64))
            sums = [np.array([mix(s + np.uint64(k)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for k in (1, 2)]
            keyed = [next(keys) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x) for x in sums), pa.array(keyed, pa.list_(pa.int64()))], ["doc_id", "mark", "n_shingles", "set_a", "set_b", "keys"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), _mark(text_column), F.col(text_column).alias("text"))
    return arrow_map(rows, work, "doc_id bigint, mark bigint, n_shingles bigint, set_a bigint, set_b bigint, keys array<bigint>", "text")


def _sets(texts: DataFrame, p: Parameters) -> DataFrame:
    """node and the full shingle set as array<bigint>, of rows (node, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, p.words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return arrow_map(texts.select("node", "text"), work, "node bigint, set array<bigint>", "text")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(id, component) of every id in edges (a, b): alternating large-star and small-star steps.

    Each round is written to the shared folder, so lineage stays short; only a count and a checksum of
    the edges come to the driver.
    """
    spark = edges.sparkSession
    both = lambda e: e.union(e.select("b", "a"))
    current = edges.select("a", "b").where("a <> b").distinct()
    state, k = None, 0
    while True:
        current.write.parquet(f"{folder}/edges-{k}")
        current = spark.read.parquet(f"{folder}/edges-{k}")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            break
        state, k = tuple(now), k + 1
        around = both(current)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest)
        current = small.where("a <> b").distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(current.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def _forest(rows: pa.Table, percent: int) -> pa.Table:
    """Links across labels inside one block, as a spanning forest; intersections by a matrix product
    over the shingles that two or more of the block's sets share."""
    ids = rows["id"].to_numpy()
    label = rows["label"].to_numpy()
    side = rows["chunk"].to_numpy()
    first, second = rows["i"][0].as_py(), rows["j"][0].as_py()
    sets = [np.asarray(s) for s in rows["set"].combine_chunks().to_numpy(zero_copy_only=False)]
    size = np.array([len(s) for s in sets], np.int64)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    owner, column = owner[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int((count > 1).sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        cells = np.zeros((len(sets), 4096), np.float32)
        cells[owner[a:b], column[a:b] - start] = 1
        common += cells @ cells.T
    inter = common.astype(np.int64)
    linked = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    linked &= (label[:, None] != label[None, :]) & (ids[:, None] < ids[None, :])
    if first != second:
        linked &= side[:, None] != side[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for a, b in np.argwhere(linked).tolist():
        ra, rb = root(int(label[a])), root(int(label[b]))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((int(ids[a]), int(ids[b])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


#: What stands for a shingle set: two sums over it and its size.
_SAME = ["set_a", "set_b", "n_shingles"]


def _grouped(docs: DataFrame, p: Parameters, id_column: str, text_column: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, groups): the rows' profiles, and one row for each class of equal non-empty sets: the sums,
    rep (its row of the smallest id, as id and mark), and component, an arbitrary number."""
    spark = docs.sparkSession

    def held(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    profiles = held(_profiles(docs, id_column, text_column, p), "profiles")
    named = profiles.where("n_shingles > 0 and doc_id is not null")
    first = named.groupBy(*_SAME).agg(F.min(F.struct("doc_id", "mark", "keys")).alias("rep"))
    group = held(first.select(F.monotonically_increasing_id().alias("node"), *_SAME, F.col("rep.doc_id").alias("doc_id"), F.col("rep.mark").alias("mark"), F.col("rep.keys").alias("keys")), "groups")

    # Band rows are (band key, node). A bucket's members are dealt by key and a hash of their node.
    rows = held(group.select(F.explode("keys").alias("key"), "node", F.col("n_shingles").alias("size")), "rows")
    buckets = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = held(rows.join(buckets, "key"), "members")

    pairs = members.where("node <> hub").select("hub", "node").distinct()
    wanted = group.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark"))
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), _mark(text_column), F.col(text_column).alias("text"))
    texts = texts.join(wanted, (texts.doc_id == wanted.its_id) & (texts.mark == wanted.its_mark))
    sets = held(_sets(texts, p).dropDuplicates(["node"]), "sets")
    left = sets.select("node", F.col("set").alias("mine"))
    right = sets.select(F.col("node").alias("hub"), F.col("set").alias("theirs"))
    fits = F.least(F.size("mine"), F.size("theirs")) * 100 >= F.greatest(F.size("mine"), F.size("theirs")) * p.percent
    inter = F.size(F.array_intersect("mine", "theirs"))
    links = pairs.join(left, "node").join(right, "hub").where(fits & (100 * inter >= p.percent * (F.size("mine") + F.size("theirs") - inter)))
    stars = held(links.select(F.col("hub").alias("a"), F.col("node").alias("b")), "stars")
    first = held(components(stars, f"{folder}/first"), "labels")

    # What the hubs leave open: buckets whose other members lie in two or more components.
    others = members.where("n > 2 and node <> hub").join(first, members.node == first.id, "left").select("key", "node", "size", "n", F.coalesce("component", "node").alias("label"))
    deals = F.ceil(F.col("n") / DEALT).cast("int")
    others = held(others.withColumn("deal", F.pmod(F.xxhash64("node"), deals).cast("int")), "others")
    open_ = others.groupBy("key", "n").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"), F.sum("size").alias("shingles")).where("low < high")
    open_ = open_.select("key", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("chunks"), F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
    placed = others.join(open_, ["key", "deal"]).withColumn("chunk", F.pmod(F.xxhash64("node", "key"), F.col("chunks")).cast("int"))
    blocks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("key", F.col("node").alias("id"), "label", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    blocks = blocks.join(sets.withColumnRenamed("node", "id"), "id")
    percent = p.percent
    rest = held(blocks.groupBy("key", "i", "j").applyInArrow(lambda t: _forest(t, percent), "a bigint, b bigint"), "rest")
    final = held(components(stars.union(rest), f"{folder}/final"), "components") if not rest.isEmpty() else first

    groups = held(group.join(final, group.node == final.id, "left").select(*_SAME, "doc_id", "mark", F.coalesce("component", "node").alias("component")), "classes")
    for name in ("groups", "rows", "members", "sets", "stars", "first", "labels", "others", "rest", "final", "components"):
        discard(spark, f"{folder}/{name}")
    return profiles, groups


def _folder(docs: DataFrame) -> str:
    return f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/neardup-{uuid.uuid4().hex}"


def classes(docs: DataFrame, p: Parameters = STRICT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable), kept."""
    profiles, groups = _grouped(docs, p, id_column, text_column, _folder(docs))
    least = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = profiles.join(groups.join(least, "component").select(*_SAME, "component_id"), _SAME, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, p: Parameters = LOOSE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group, of its smallest id (of equal ids, the text of the smallest hash); all columns
    as they came. Rows with a null id cannot be named in a group, and rows without words are in none: they stay."""
    _, groups = _grouped(docs, p, id_column, text_column, _folder(docs))
    best = groups.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("best"))
    number, mark, row, its_number, its_mark = fresh(docs, "number", "mark", "row", "its_number", "its_mark")
    best = best.select(F.col("best.doc_id").alias(its_number), F.col("best.mark").alias(its_mark))
    rows = docs.select("*", F.col(id_column).cast("long").alias(number), _mark(text_column).alias(mark))
    once = Window.partitionBy(number, mark).orderBy(number)
    kept = rows.join(best, [F.col(number) == F.col(its_number), F.col(mark) == F.col(its_mark)], "left_semi").withColumn(row, F.row_number().over(once)).where(F.col(row) == 1).drop(number, mark, row)
    wordless = ~F.coalesce(F.col(text_column), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.unionByName(docs.where(F.col(id_column).isNull() | wordless))
