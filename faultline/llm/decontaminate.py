"""Benchmark decontamination: a broadcast hash set of test windows, verified hits, removed spans.

Words are lower-cased runs of ASCII letters, digits and all non-ASCII characters. A window is ten
consecutive item words; an item of one to nine words is one window. Each block of the benchmark (at
most ``BLOCK_WORDS`` words, a fixed bound) is broadcast as: its vocabulary, and the sorted hashes of
its windows. A document becomes an array of vocabulary numbers; its window hashes are looked up and
every hit is verified word by word. A benchmark beyond one block takes further blocks, each against
all documents, and the hits of a document are united afterwards: nothing is dropped at any size. An
item longer than a block is cut into parts that overlap by all but one word of a window.

Null and empty texts have no words, so they are clean; null or wordless items have no windows. Rows of
one item id are one item. Items of a null id are one item that is counted but has no name in the list.
An empty benchmark leaves every document clean. Extra columns may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import arrow_map, checkpoint_dir, fresh

WINDOW = 10
#: Benchmark words in one broadcast block (about 100 bytes each once indexed).
BLOCK_WORDS = 400_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` numbers."""
    n = len(ids) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    wide = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wide ^= wide >> np.uint64(29)
    for k in range(length if n > 0 else 0):
        out = out * np.uint64(0xD6E8FEB86659FD93) + wide[k : k + n]
    return out


class Index:
    """The windows of some items: by length the sorted hashes, and by window the items that hold it."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        holders: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, found) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
            length = min(WINDOW, len(ids))
            for window in dict.fromkeys(tuple(ids[i : i + length]) for i in range(len(ids) - length + 1) if length):
                holders[length][window].append(k)
        self.holders = {n: dict(x) for n, x in holders.items()}
        self.sorted = {n: np.unique(_hashes(np.array(list(x), np.int64).reshape(-1), n)[::n]) for n, x in self.holders.items()}

    def hits(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges (start, end) and the numbers of the items, of one document."""
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))
        starts: list[tuple[int, int]] = []
        items: set[int] = set()
        for n, known in self.sorted.items():
            if len(ids) < n:
                continue
            edges = np.concatenate([[0], np.cumsum(ids == 0)])
            at = np.flatnonzero(edges[n:] == edges[:-n])  # windows whose words are all known
            if not len(at):
                continue
            h = _hashes(ids, n)[at]
            at = at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
            holders = self.holders[n]
            for i in at.tolist():
                if (owners := holders.get(tuple(ids[i : i + n].tolist()))) is not None:
                    items.update(owners)
                    starts.append((i, i + n))
        return united(starts), items


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text") -> Iterator[list[tuple[object, list[bytes]]]]:
    """The benchmark in blocks of bounded size, read partition by partition."""
    block: list[tuple[object, list[bytes]]] = []
    size = 0
    most = max(BLOCK_WORDS, WINDOW)
    for item, text in benchmark.select(item_column, text_column).toLocalIterator():
        found = words(text)
        for start in range(0, max(len(found) - WINDOW, 0) + 1, most - WINDOW + 1) if found else ():
            part = found[start : start + most]
            if block and size + len(part) > most:
                yield block
                block, size = [], 0
            block.append((item, part))
            size += len(part)
    if block:
        yield block


def _marked(docs: DataFrame, benchmark: DataFrame, text_column: str, drop_share: float | None) -> tuple[DataFrame, list[str]]:
    """All rows with three more columns, whose names come too: the number of words, the hit ranges (flat
    pairs, united) and the hit items (distinct, as strings). With a ``drop_share``, the rows and columns as
    they came with the ranges cut out instead.

    One pass over the rows for each block; between passes the rows go to the checkpoint folder, so
    that a task never holds more than one block. The cut happens inside the last pass: a stage of one
    Python function needs one worker for each task.
    """
    kinds = {"words": F.lit(0).cast("long"), "ranges": F.lit([]).cast("array<bigint>"), "items": F.lit([]).cast("array<string>")}
    added = fresh(docs, *kinds)
    rows = docs.select("*", *(column.alias(name) for column, name in zip(kinds.values(), added)))
    each = blocks(benchmark)
    block = next(each, [])
    while block is not None:
        after = next(each, None)
        rows = _pass(rows, block, text_column, after is None, drop_share)
        if after is not None:
            checkpoint_dir(docs.sparkSession)
            rows = rows.checkpoint()
        block = after
    return rows, added


def _pass(rows: DataFrame, block: list, text_column: str, last: bool, drop_share: float | None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Index(block))
    fields, at = rows.columns, rows.columns.index(text_column)
    own = len(fields) - 3
    cutting = last and drop_share is not None
    out = T.StructType(rows.schema.fields[:own]) if cutting else T.StructType([f for k, f in enumerate(rows.schema.fields) if k != at or not last])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            n_words, ranges, items, texts, kept = [], [], [], [], []
            for text, old, held in zip(*(batch.column(k).to_pylist() for k in (at, own + 1, own + 2))):
                found = words(text)
                hit, owners = index.hits(found)
                pairs = united([*hit, *zip(old[::2], old[1::2])])
                if cutting:
                    kept.append(not pairs or sum(b - a for a, b in pairs) < drop_share * len(found))
                    texts.append(_cut(text, pairs) if pairs and kept[-1] else text)
                    continue
                n_words.append(len(found))
                ranges.append([x for pair in pairs for x in pair])
                named = dict.fromkeys(index.items[k] for k in owners)
                items.append(list(dict.fromkeys([*held, *(None if k is None else str(k) for k in named)])))
            if cutting:
                columns = list(batch.columns[:own])
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, fields[:own]).filter(pa.array(kept, pa.bool_()))
                continue
            columns = [*batch.columns[:own], pa.array(n_words, pa.int64()), pa.array(ranges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            done = pa.RecordBatch.from_arrays(columns, fields)
            yield done.select([k for k in range(len(fields)) if k != at]) if last else done

    return arrow_map(rows, work, out, text_column)


def find(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items (sorted as strings), contaminated. No shuffle."""
    rows, (n_words, ranges, items) = _marked(docs.select(id_column, text_column), benchmark, text_column, None)
    starts = F.filter(ranges, lambda x, k: k % 2 == 0)
    ends = F.filter(ranges, lambda x, k: k % 2 == 1)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        id_column,
        F.col(n_words).alias("n_words"),
        (total(ends) - total(starts)).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.array_sort(F.array_compact(items)).alias("items"),
        (F.size(ranges) > 0).alias("contaminated"),
    )


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the hit words and what stands between them."""
    data = text.encode()
    marked = np.frombuffer(data.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    out, done = [], 0
    for a, b in ranges:
        out.append(data[done : edges[2 * a]])
        done = edges[2 * b - 1]
    return b"".join([*out, data[done:]]).decode()


def remove(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", drop_share: float = 0.5) -> DataFrame:
    """The documents without benchmark passages: hit spans are cut out; a document of which at least
    ``drop_share`` of the words are hit goes as a whole. Rows stay apart (no join on an id)."""
    return _marked(docs, benchmark, text_column, drop_share)[0]
