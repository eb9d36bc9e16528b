"""Quality rules: gradient-boosted trees over document statistics.

``statistics`` measures every whole text; ``fit`` boosts depth-limited trees on labelled documents,
with monotonic constraints on the features where more can only be worse (or better); ``Forest``
keeps all trees as numpy node arrays and scores whole batches at once.

Words are runs of anything but the six ASCII white-space characters. A null text has no words, so it
fails the base rules, as an empty one does. A document is rejected if it fails the base rules or if the
forest's probability of good quality is below the calibrated threshold. Repeated rows get equal
verdicts. Without labels (an empty table, or labels of one class only) there is no forest and the base
rules decide alone. ``judge`` reads only the id and the text, so extra columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map

#: Labelled rows that a model is fitted on, at most: those of the smallest hashed ids.
MAX_LABELLED = 20_000
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Features, each with its constraint: -1 if more can only lower the quality, 1 the reverse, 0 free.
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "exclamation_share": -1,
    "other_punctuation_share": 0,
    "distinct_word_share": 1,
    "same_neighbour_share": -1,
    "words_per_line": 0,
}

_MIX = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def _mask(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_SPACE, _SYMBOL = _mask(b" \t\n\r\x0b\x0c"), _mask(b"#*$%&|<>")
_UPPER, _LOWER, _DIGIT = (_mask(bytes(range(ord(a), ord(b) + 1))) for a, b in ("AZ", "az", "09"))
_PUNCTUATION = _mask(bytes(range(33, 127))) & ~(_UPPER | _LOWER | _DIGIT | _SYMBOL) & ~_mask(b"!")
_CONTINUATION = np.zeros(256, bool)
_CONTINUATION[0x80:0xC0] = True
_GROUPS = np.column_stack([_SPACE, _SYMBOL, _UPPER, _DIGIT, _PUNCTUATION, _CONTINUATION, _mask(b"!")]).astype(np.int64)


def repeated_words(hashes: np.ndarray, words: list[bytes]) -> int:
    """Words inside windows that occur twice or more: found by window hashes, then held against the words."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    windows = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        windows += hashes[k : k + n] * _MIX[k]
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = again[np.minimum(np.searchsorted(again, windows), len(again) - 1)] == windows
    places = np.flatnonzero(hit)
    values, first = np.unique(windows[places], return_index=True)
    lead = places[first][np.searchsorted(values, windows[places])]
    if any(words[i : i + WINDOW] != words[j : j + WINDOW] for i, j in zip(places.tolist(), lead.tolist())):
        # unlike windows share a hash: the words themselves decide
        shown = [b" ".join(words[i : i + WINDOW]) for i in places.tolist()]
        times = Counter(shown)
        hit[places] = [times[w] > 1 for w in shown]
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[:n] += hit
    edges[WINDOW:] -= hit
    return int(np.count_nonzero(np.cumsum(edges)))


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one whole text."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    space, symbols, upper, digits, punctuation, rest, shouts = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _GROUPS).tolist()
    chars = len(data) - space - rest
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeats = repeated_words(hashes, words)
    counts = [n, chars, symbols, dup_lines, repeats]
    w, c = max(n, 1), max(chars, 1)
    same = int(np.count_nonzero(hashes[1:] == hashes[:-1]))
    return counts, [
        np.log1p(n), chars / w, symbols / w, dup_lines / max(len(lines), 1), repeats / w, upper / c, digits / c, shouts / w, punctuation / w,
        len(set(words)) / w, same / w, n / max(len(lines), 1),
    ]


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: ``feature`` and ``cut`` by (tree, inner node), ``leaf`` by (tree, leaf)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        tree = np.arange(trees)
        row = np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
        margin = self.bias + self.leaf[tree, at - inner].sum(1)
        return 1 / (1 + np.exp(-margin))

    def keeps(self, x: np.ndarray) -> np.ndarray:
        return self.probability(x) >= self.threshold


def _grow(bins: np.ndarray, n_bins: int, gradient: np.ndarray, hessian: np.ndarray, depth: int, signs: list[int], rate: float, smooth: float):
    """One tree level by level; returns split feature and bin for each inner node, and leaf values."""
    inner = 2**depth - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, n_bins, np.int64)
    node = np.zeros(len(bins), np.int64)
    low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
    value = lambda g, h: -g / (h + smooth)
    gain = lambda g, h: g * g / (h + smooth)
    for at in range(inner):
        rows = np.flatnonzero(node == at)
        left, right = 2 * at + 1, 2 * at + 2
        low[[left, right]], high[[left, right]] = low[at], high[at]
        best = (1e-6, 0, n_bins)
        if len(rows):
            g, h = gradient[rows], hessian[rows]
            for f, sign in enumerate(signs):
                gl = np.cumsum(np.bincount(bins[rows, f], g, n_bins))[:-1]
                hl = np.cumsum(np.bincount(bins[rows, f], h, n_bins))[:-1]
                gr, hr = g.sum() - gl, h.sum() - hl
                score = gain(gl, hl) + gain(gr, hr) - gain(g.sum(), h.sum())
                bad = (hl < 1) | (hr < 1)
                if sign:
                    bad |= sign * (np.clip(value(gr, hr), low[at], high[at]) - np.clip(value(gl, hl), low[at], high[at])) < 0
                score[bad] = -1
                k = int(score.argmax())
                if score[k] > best[0]:
                    best = (float(score[k]), f, k)
                    if sign:
                        middle = float(np.clip((value(gl[k], hl[k]) + value(gr[k], hr[k])) / 2, low[at], high[at]))
                        bounds = middle
                    else:
                        bounds = None
            if best[2] < n_bins:
                feature[at], cut[at] = best[1], best[2]
                if bounds is not None:  # the sides of a constrained split may not cross later
                    up, down = (right, left) if signs[best[1]] > 0 else (left, right)
                    low[up], high[down] = max(low[up], bounds), min(high[down], bounds)
            go = bins[rows, feature[at]] > cut[at]
            node[rows] = np.where(go, right, left)
    leaf = np.zeros(inner + 1)
    for k in range(inner + 1):
        rows = node == inner + k
        if rows.any():
            leaf[k] = rate * float(np.clip(value(gradient[rows].sum(), hessian[rows].sum()), low[inner + k], high[inner + k]))
    return feature, cut, leaf, leaf[node - inner]


def fit(x: np.ndarray, good: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, n_bins: int = 64, wrong: float = 0.002) -> Forest | None:
    """Boost on four fifths of the rows; the threshold, at most 0.5, lets ``wrong`` of the other fifth's good rows go at most."""
    if not len(x) or good.min() == good.max():
        return None
    held = np.arange(len(x)) % 5 == 4
    if min(np.bincount(good[~held].astype(int), minlength=2)) == 0 or not good[held].any():
        held[:] = False
    signs = list(FEATURES.values())
    xs, ys = x[~held], good[~held].astype(float)
    edges = [np.unique(np.quantile(xs[:, f], np.linspace(0, 1, n_bins)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, xs[:, f], side="left") for f, e in enumerate(edges)])
    prior = float(np.clip(ys.mean(), 0.01, 0.99))
    bias = float(np.log(prior / (1 - prior)))
    margin = np.full(len(xs), bias)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        feature, cut, leaf, step = _grow(bins, n_bins, p - ys, p * (1 - p), depth, signs, rate, 1.0)
        margin += step
        values = np.array([edges[f][k] if k < len(edges[f]) else np.inf for f, k in zip(feature, cut)])
        grown.append((feature, values, leaf))
    forest = Forest(*(np.stack(a) for a in zip(*grown)), bias, 0.5)
    kept = np.sort(forest.probability(x[held & good.astype(bool)])) if held.any() else np.ones(1)
    return Forest(forest.feature, forest.cut, forest.leaf, bias, float(min(0.5, kept[int(wrong * len(kept))])))


def _measure(docs: DataFrame, id_column: str, text_column: str, forest: Forest | None) -> DataFrame:
    """The id, COUNTS, FEATURES as one array, and the forest's probability (1 without a forest)."""
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_column, *COUNTS, "features", "probability"]
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            counts = np.array([r[0] for r in rows], np.int64)
            x = np.array([r[1] for r in rows], np.float64)
            p = forest.probability(x) if forest else np.ones(len(x))
            features = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T), features, pa.array(p)], names)

    schema = f"`{id_column}` {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, features array<double>, probability double"
    return arrow_map(docs.select(id_column, text_column), work, schema, text_column)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Forest | None:
    """Fit on at most MAX_LABELLED labelled documents, those of the smallest hashed ids."""
    chosen = (
        labels.select(F.col(id_column), F.col(label_column).cast("int").alias("label"))
        .where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
        .orderBy(F.xxhash64(id_column), id_column, "label")
        .limit(MAX_LABELLED)
        .groupBy(id_column)
        .agg(F.max("label").alias("label"))
    )
    named = docs.select(id_column, text_column).join(F.broadcast(chosen), id_column)
    rows = (
        _measure(named, id_column, text_column, None)
        .join(F.broadcast(chosen), id_column)
        .select(id_column, "features", "label")
        .orderBy(F.xxhash64(id_column), id_column, "features")
        .limit(MAX_LABELLED)
        .collect()
    )
    x = np.array([r["features"] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], np.int64) > 0)


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id, the counts, ``base_failed``, ``kept`` and ``probability``."""
    forest = train(docs, labels, id_column, text_column)
    threshold = forest.threshold if forest else 0.0
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        _measure(docs, id_column, text_column, forest)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
        .select(id_column, *COUNTS, "base_failed", "kept", "probability")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they came; no join, so repeated ids stay apart."""
    forest = train(docs, labels, id_column, text_column)
    fields, at = docs.columns, docs.columns.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(at).to_pylist()]
            fine = np.array([c[0] >= 20 and 100 * c[4] <= 30 * c[0] for c, _ in rows], bool)
            if forest:
                fine &= forest.keeps(np.array([x for _, x in rows], np.float64))
            yield batch.filter(pa.array(fine)).rename_columns(fields)

    return arrow_map(docs, work, docs.schema, text_column)
