"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

``frequent_words`` counts the pre-tokens of all documents. ``Lexicon`` compiles the frequent ones into a minimal acyclic automaton (shared prefixes and suffixes) whose transitions carry counts,
so that the sum along a word is its number, and the number leads to its token ids. The packed
automaton is a file of a few MB that Spark ships to every executor, where workers memory-map it.
Words outside it are merged exactly by the merge ranks. The lexicon changes the speed, never a result.

Follows a tokenizer file with: special tokens matched in the raw text; NFC, white space to one space,
lower case; a pattern split; byte-level symbols; BPE with a word-end suffix; no decoder, so decoding
joins token strings by spaces. Null texts encode like empty ones: no ids, and an empty decoded text.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import acyclic, arrow_map, checkpoint_dir, hexdigest, slices

#: Words in the lexicon at most (each at least that share of all), and the longest word it and a
#: worker's cache take.
LEXICON_WORDS, LONGEST = 100_000, 48
#: Distinct words a task counts before it passes its counts on, and words a worker keeps encoded.
COUNTED, CACHED = 250_000, 150_000

#: Bytes of text that are looked up together.
SLICE = 3_000_000

# The white space of the normaliser and the pre-tokenizer's pattern.
SPACE = "".join(regex.escape(chr(c)) for c in (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
_PIECES_OR_SPACE = regex.compile(" |" + _PIECES.pattern)
#: A stop or comma that stands alone between a letter or digit and white space: a pre-token of its own.
_TAIL = re.compile(r"([.,])(?<=[^\W_][.,])(?=[ \t\r\n]|\Z)")
#: What str.split() takes for white space and the tokenizer does not.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def default_path() -> str:
    """The installed tokenizer file (the same on every machine)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Model:
    """A tokenizer file: token ids, merge ranks, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in data["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in data["added_tokens"]}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        symbols = _byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + suffix] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))

    def merge(self, word: str) -> list[int]:
        """The ids of one pre-token: always the lowest rank first, the leftmost of equals."""
        data = word.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, none = self.merges.get, (1 << 60, 0)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best[1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same through a heap and linked places, for words of any length."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        get = self.merges.get
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (m := get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """``merge`` of many words at once: each round merges the best pair of every open word."""
        encoded = [w.encode() for w in words]
        length = np.array([len(w) for w in encoded], np.int64)
        out: list[list[int]] = [[]] * len(words)
        order = np.argsort(length, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 8192)):
            if not len(part):
                continue
            if length[part[-1]] > 64:
                for k in part.tolist():
                    out[k] = self.merge(words[k])
                continue
            for k, ids in zip(part.tolist(), self._merge_table([encoded[k] for k in part.tolist()], length[part])):
                out[k] = ids
        return out

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbol ids by byte (inner, last), and the merges as sorted pair keys with (rank, id) packed."""
        pairs = np.array([a << 20 | b for a, b in self.merges], np.int64)
        made = np.array([rank << 20 | i for rank, i in self.merges.values()], np.int64)
        order = np.argsort(pairs)
        return np.array(self.inner), np.array(self.last), pairs[order], made[order]

    def _merge_table(self, encoded: list[bytes], length: np.ndarray) -> Iterator[list[int]]:
        inner, last, pairs, made = self._table
        none = np.int64(1) << 60

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a << 20 | b
            at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            return np.where((pairs[at] == key) & (b >= 0), made[at], none)

        n, width = len(encoded), int(length[-1])
        flat = np.frombuffer(b"".join(encoded), np.uint8)
        inside = np.arange(width) < length[:, None]
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width][inside] = inner[flat]
        rows = np.arange(n)
        ids[rows, length - 1] = last[flat[np.cumsum(length) - 1]]
        ranks = np.full((n, width + 1), none)
        ranks[:, :width] = rank(ids[:, :-1], ids[:, 1:])
        live, final, left = rows, ids.copy(), length.copy()
        places = np.arange(width + 1)
        while len(live):
            at = ranks.argmin(1)
            here = np.arange(len(live))
            best = ranks[here, at]
            going = best < none
            if not going.all():
                final[live[~going]] = ids[~going]
                live, ids, ranks, at, best = live[going], ids[going], ranks[going], at[going], best[going]
                here = np.arange(len(live))
                if not len(live):
                    break
            left[live] -= 1
            ids[here, at] = best & 0xFFFFF
            source = np.minimum(places + (places > at[:, None]), width)
            ids = np.take_along_axis(ids, source, 1)
            ids[:, -1] = -1
            # the pair at `at` is new, and so is the one before it; what follows moves left by one
            ranks = np.take_along_axis(ranks, np.minimum(places + (places >= at[:, None]), width), 1)
            ranks[here, at] = rank(ids[here, at], ids[here, np.minimum(at + 1, width)])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = rank(ids[before, at[before] - 1], ids[before, at[before]])
        for row, k in zip(final.tolist(), left.tolist()):
            yield row[:k]

    def segments(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """Special tokens (id, no chunks) and the chunks between white space (None, chunks)."""
        for part in self.split.split(text) if self.split and "<" in text else (text,):
            if (found := self.special.get(part)) is not None:
                yield found, []
            elif part:
                yield None, chunks(part)


def chunks(text: str) -> list[str]:
    """Normalised text, cut at white space; no pre-token reaches across it."""
    if not text.isascii():
        # each character is lowered by itself: a final capital sigma too becomes the common small one
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
    # most words come with and without a stop or comma: cut those off, and far fewer chunks differ
    text = _TAIL.sub(r" \1", text.lower())
    return list(filter(None, regex.split(f"[{SPACE}]+", text))) if _SEPARATORS.search(text) else text.split()


class Lexicon:
    """A packed minimal acyclic transducer: words to numbers, numbers to id lists."""

    def __init__(self, data):
        view = memoryview(data)
        states, arcs, words, _ = view[:16].cast("I").tolist()
        at = 16
        parts = []
        for count in (states + 1, arcs, arcs, words + 1):
            parts.append(view[at : at + 4 * count].cast("I"))
            at += 4 * count
        self.first, self.target, self.skip, self.offset = parts
        self.final = view[at : at + states]
        self.labels = (data, at + states)
        self.ids = view[at + states + arcs + (-(states + arcs)) % 4 :].cast("I")

    def number(self, word: bytes) -> int:
        """The word's number, or -1."""
        first, target, skip = self.first, self.target, self.skip
        data, base = self.labels
        state = total = 0
        for byte in word:
            arc = data.find(byte.to_bytes(), base + first[state], base + first[state + 1])
            if arc < 0:
                return -1
            arc -= base
            total += skip[arc]
            state = target[arc]
        return total if self.final[state] else -1

    def lookup(self, word: str) -> list[int] | None:
        k = self.number(word.encode())
        return None if k < 0 else self.ids[self.offset[k] : self.offset[k + 1]].tolist()

    @cached_property
    def _arcs(self) -> tuple[np.ndarray, ...]:
        """The mapped arrays for whole batches: arcs by (state, byte), which is the order they lie in."""
        first = np.asarray(self.first)
        data, at = self.labels
        labels = np.frombuffer(data, np.uint8, len(self.target), at)
        state = np.repeat(np.arange(len(first) - 1), np.diff(first.astype(np.int64)))
        return state << 8 | labels, np.asarray(self.target).astype(np.int64), np.asarray(self.skip).astype(np.int64), np.asarray(self.final)

    def numbers(self, words: list[str]) -> np.ndarray:
        """``number`` of many words at once, one byte of all words at a time."""
        arcs, target, skip, final = self._arcs
        encoded = [w.encode() for w in words]
        length = np.array([len(w) for w in encoded], np.int64)
        start = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(encoded), np.uint8)
        out = np.full(len(words), -1, np.int64)
        live, state, total = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        depth = 0
        while len(live):
            done = length[live] == depth
            ended = done & (final[state] > 0)
            out[live[ended]] = total[ended]
            live, state, total = live[~done], state[~done], total[~done]
            key = state << 8 | flat[start[live] + depth]
            arc = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
            known = arcs[arc] == key
            live, arc, total = live[known], arc[known], total[known]
            state, total = target[arc], total + skip[arc]
            depth += 1
        return out

    @staticmethod
    def pack(words: Iterable[str], merge) -> bytes:
        """Add the sorted words one by one, sharing equal right languages, then lay the states out."""
        register: dict[tuple, int] = {}
        frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(frozen)
                frozen.append(key)
            return register[key]

        ordered = sorted({w.encode() for w in words})
        path: list[list] = [[False, []]]
        previous = b""
        for word in [*ordered, b""]:
            common = 0
            while common < min(len(word), len(previous)) and word[common] == previous[common]:
                common += 1
            for depth in range(len(previous), common, -1):
                path[depth - 1][1].append((previous[depth - 1], freeze(path.pop())))
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = path[-1][0] or bool(word)
            previous = word
        root = freeze(path[0])
        size: list[int] = []  # words below each state; children are frozen before their parents
        for final, arcs in frozen:
            size.append(final + sum(size[t] for _, t in arcs))
        order = [root, *(s for s in range(len(frozen)) if s != root)]
        place = {s: k for k, s in enumerate(order)}
        first, target, skip, labels = [0], [], [], bytearray()
        for s in order:
            passed = int(frozen[s][0])
            for byte, t in frozen[s][1]:
                labels.append(byte)
                target.append(place[t])
                skip.append(passed)
                passed += size[t]
            first.append(len(target))
        offset, ids = [0], []
        for word in ordered:
            ids += merge(word.decode())
            offset.append(len(ids))
        array = lambda x: np.array(x, np.uint32).tobytes()
        body = bytes(frozen[s][0] for s in order) + bytes(labels)
        head = array([len(order), len(target), len(ordered), len(ids)])
        return head + array(first) + array(target) + array(skip) + array(offset) + body + bytes(-len(body) % 4) + array(ids)


class Kept:
    """Results by chunk or word, in two generations: when the young one is full, it becomes the old one."""

    def __init__(self, kinds: int):
        self.young: list[dict] = [{} for _ in range(kinds)]
        self.old = self.young

    def missing(self, keys: set[str]) -> list[str]:
        """Those not kept; what only the old generation has becomes young again."""
        if len(self.young[0]) > CACHED:
            self.old, self.young = self.young, [{} for _ in self.young]
        fresh = keys.difference(self.young[0])
        again = fresh.intersection(self.old[0]) if self.old is not self.young else ()
        for young, old in zip(self.young, self.old) if again else ():
            young.update((k, old[k]) for k in again)
        return list(fresh.difference(again))


class Codec:
    """Encoding and decoding in one process: lexicon first, exact merges else. Chunks of many texts are
    looked up together; what short words and chunks give is kept for a while."""

    def __init__(self, model: Model, lexicon: Lexicon | None):
        self.model, self.lexicon = model, lexicon
        self.words, self.shown = Kept(1), Kept(2)
        last = max(model.tokens) + 1
        #: Text of each id in the ids' and in the tokens' rendering; place -1 is a mark between chunks.
        self.digits = [*map(str, range(last)), "\n"]
        self.tokens = [*(model.tokens.get(i, "") for i in range(last)), "\n"]

    def ids_of(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of all these words; short ones are kept."""
        fresh = self.words.missing({w for w in words if len(w) <= LONGEST})
        found = self.words.young[0]
        if self.lexicon and fresh:
            number = self.lexicon.numbers(fresh)
            offset, ids = self.lexicon.offset, self.lexicon.ids
            for k in np.flatnonzero(number >= 0).tolist():
                n = int(number[k])
                found[fresh[k]] = ids[offset[n] : offset[n + 1]].tolist()
            fresh = [fresh[k] for k in np.flatnonzero(number < 0).tolist()]
        found.update(zip(fresh, self.model.merge_all(fresh)))
        return found

    def flat(self, found: list[str]) -> list[int]:
        """The ids of these chunks in a row, with -1 between chunks."""
        words = _PIECES_OR_SPACE.findall(" ".join(found))
        distinct = set(words) - {" "}
        ids = self.ids_of(distinct)
        passing = {w: self.model.merge(w) for w in distinct if len(w) > LONGEST} | {" ": [-1]}
        return list(chain.from_iterable(ids.get(w) or passing[w] for w in words))

    def render(self, found: list[str]) -> tuple[list[str], list[str]]:
        """Of each chunk: its ids, and its tokens, as text."""
        flat = self.flat(found)
        return tuple(" ".join(map(texts.__getitem__, flat)).split(" \n ") if found else [] for texts in (self.digits, self.tokens))

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text; what the chunks give is looked up for all texts together."""
        cut = [list(self.model.segments(t or "")) for t in texts]
        every = list(set().union(*(found for segments in cut for _, found in segments)))
        known: dict[str, list[int]] = {}
        if every:
            flat = np.array(self.flat(every), np.int64)
            ends = [*np.flatnonzero(flat < 0).tolist(), len(flat)]
            flat = flat.tolist()
            start = 0
            for chunk, end in zip(every, ends):
                known[chunk] = flat[start:end]
                start = end + 1
        for segments in cut:
            out: list[int] = []
            for special, found in segments:
                if special is not None:
                    out.append(special)
                out.extend(chain.from_iterable(map(known.__getitem__, found)))
            yield out

    def decode(self, ids: Iterable[int]) -> str:
        tokens = self.model.tokens
        return " ".join(tokens[i] for i in ids if i in tokens)

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, digest of the ids, digest of their decoding."""
        cut = [list(self.model.segments(t or "")) for t in texts]
        chunks_ = set().union(*(found for segments in cut for _, found in segments))
        long = [c for c in chunks_ if len(c) > LONGEST]
        fresh = self.shown.missing(chunks_.difference(long))
        for young, shown in zip(self.shown.young, self.render(fresh)):
            young.update(zip(fresh, shown))
        kept = self.shown.young
        for young, shown in zip(kept, self.render(long)):
            young.update(zip(long, shown))
        for segments in cut:
            parts: tuple[list[str], list[str]] = [], []
            for special, found in segments:
                if special is not None:
                    parts[0].append(str(special))
                    parts[1].append(self.model.tokens[special])
                elif found:
                    pick = itemgetter(*found)
                    for part, shown in zip(parts, kept):
                        part.append(" ".join(pick(shown)) if len(found) > 1 else pick(shown))
            ids, decoded = (" ".join(p) for p in parts)
            yield ids.count(" ") + 1 if ids else 0, hexdigest(ids.encode()), hexdigest(decoded.encode())
        for young in kept:  # long chunks are not kept
            for chunk in long:
                young.pop(chunk, None)


@lru_cache(maxsize=4)
def _model(path: str) -> Model:
    return Model(path)


def _codec(path: str, name: str | None) -> Codec:
    """A task's codec (a worker outlives it, and should not hold its words); the lexicon file is the copy
    that Spark has put beside the executor."""
    if not name:
        return Codec(_model(path), None)
    with open(SparkFiles.get(name), "rb") as f:
        return Codec(_model(path), Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))


def frequent_words(docs: DataFrame, path: str, text_column: str = "text", limit: int = LEXICON_WORDS) -> list[str]:
    """The pre-tokens that make up 1 in ``limit`` of all pre-tokens of all texts.

    All texts are counted. A task passes on the words that make up 1 in 10 ``limit`` of what it counted,
    so a sum lacks a tenth of the share asked for at most; the words that reach nine tenths of it are
    taken: none of that share is missed, and 10/9 of ``limit`` is a bound on their number.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = _model(path), Counter()

        def out() -> pa.RecordBatch:
            words: Counter = Counter()
            each = iter(counts.values())
            n = next(each, 0)
            for word in _PIECES_OR_SPACE.findall(" ".join(counts)):
                if word == " ":
                    n = next(each)
                else:
                    words[word] += n
            counts.clear()
            total = words.total()
            kept = [(w, c) for w, c in words.items() if 10 * limit * c >= total and len(w) <= LONGEST]
            names, sums = [None, *(w for w, _ in kept)], [total, *(c for _, c in kept)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, found in model.segments(text or ""):
                    counts.update(found)
                if len(counts) > COUNTED:
                    yield out()
        yield out()

    spark = docs.sparkSession
    at = f"{checkpoint_dir(spark).rstrip('/')}/words-{uuid.uuid4().hex}"
    arrow_map(docs.select(text_column), work, "word string, n bigint", text_column).groupBy("word").agg(F.sum("n").alias("n")).write.parquet(at)
    counted = spark.read.parquet(at)
    total = counted.where("word is null").agg(F.sum("n")).first()[0] or 0
    return [r["word"] for r in counted.where(F.col("word").isNotNull() & (F.col("n") * limit * 10 >= 9 * total)).collect()]


def ship(docs: DataFrame, path: str, text_column: str = "text") -> str:
    """Build the lexicon of the documents and have Spark bring it to every executor; returns its name."""
    spark = docs.sparkSession
    packed = Lexicon.pack(frequent_words(docs, path, text_column), _model(path).merge)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    at = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    to = jvm.org.apache.hadoop.fs.Path(at)
    stream = to.getFileSystem(sc._jsc.hadoopConfiguration()).create(to)
    try:
        stream.write(bytearray(packed))
    finally:
        stream.close()
    sc.addFile(at)
    return name


def digest(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256."""
    name = ship(docs, path, text_column)
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, name)
        with acyclic():
            for batch in slices(batches, text_column, SLICE):
                n, ids, decoded = zip(*codec.digests(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], [id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(id_column, text_column), work, f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", text_column)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids array<int>."""
    name = ship(docs, path, text_column)
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, name)
        with acyclic():
            for batch in slices(batches, text_column, SLICE):
                ids = list(codec.encode(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], [id_column, "n_tokens", "ids"])

    return arrow_map(docs.select(id_column, text_column), work, f"`{id_column}` {kind}, n_tokens bigint, ids array<int>", text_column)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """One row per input row: id and the decoded text; null ids decode to the empty text."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, None)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], [id_column, "text"])

    return arrow_map(encoded.select(id_column, ids_column), work, f"`{id_column}` {kind}, text string", ids_column)
