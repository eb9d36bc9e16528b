"""Near-duplicate pages and greedy first-wins deduplication.

Pairs are exact. Two near sets of n and m grams differ in at most ``(100 - percent) * (n + m) / (100 + percent)``
grams. So the grams are dealt by a hash to more parts than that, and some parts of both sets are equal: a set is
stood for by one 32-bit number for each part. Sets meet only with sets of their band of size; the parts of a band
are dealt to groups, and by the pigeonhole one group has as many equal parts as its share of the bound demands.
Every group is one task's matrix; the pairs it finds are confirmed on full sets, block by block. Gram sets are never
written: numbers of parts and normal texts are.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from faultline.config import Run
from faultline.functions.text import keyed, normalize_answer, normalize_title, squeeze, strip

N = 5
#: Sizes of sets in one band, as a ratio; parts of a group, at least, and groups of a band, at most.
BAND, PARTS, MOST_GROUPS = 1.2, 32, 64
#: Bytes of part numbers that a task gathers before it passes them on, pairs that are compared at once, and grams
#: of a block that is confirmed.
FLUSH, AT_ONCE, BLOCK = 16_000_000, 100_000, 250_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that the cluster names; one of our own where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"{tempfile.gettempdir()}/faultline-checkpoints"
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def held(df: DataFrame, path: str) -> DataFrame:
    """Written and read again: cuts the lineage in storage that outlives an executor."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def grams_of(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the character n-grams; a shorter text is its own gram."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.zeros(0, np.int64)
    n = min(N, len(points))
    out = np.full(len(points) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(out)] + np.uint64(1))
    return np.unique(out).view(np.int64)


def normal_text(text: Column) -> Column:
    return strip(squeeze(F.lower(F.coalesce(text, F.lit("")))))


def _bands(percent: int) -> tuple[list[int], list[int], list[int]]:
    """Of each band its least size, its number of parts, and the parts of a group. Sets of band b meet those of
    their own band and larger ones up to 100 / percent of their size."""
    lows, parts, groups = [1], [], []
    while lows[-1] < 1 << 31:
        low = lows[-1]
        lows.append(max(low + 1, math.ceil(low * BAND)))
        top = lows[-1] - 1
        bound = (100 - percent) * (top + top * 100 // percent) // (100 + percent)
        parts.append(bound + max(1, bound // 8))
        groups.append(max(PARTS, -(-parts[-1] // MOST_GROUPS)))
    return lows, parts, groups


def part_numbers(grams: np.ndarray, parts: int) -> np.ndarray:
    """One number for each part of the grams; 0 for an empty part."""
    h = _mix(grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
    out = np.zeros(parts, np.uint64)
    np.add.at(out, ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), _mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(3)))
    return (out >> np.uint64(32)).astype(np.uint32)


def _key(value):
    """A value of an id as something to compare: structs in the order of their fields, null first."""
    return tuple((x is not None, x) for x in value.values()) if isinstance(value, dict) else value


def _signatures(percent: int, ids: pa.DataType):
    """Batches of (id, text) to rows of (band, part group, ids, body)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, parts, width = _bands(percent)
        firsts = np.array(lows)

        def out(kept: pa.Array, gathered: dict[int, list]) -> pa.RecordBatch:
            rows = []
            for band, items in gathered.items():
                at = pa.array([x[0] for x in items])
                head = np.array([x[1:4] for x in items], np.uint64)
                matrix = np.stack([x[4] for x in items])
                for q, first in enumerate(range(0, max(1, matrix.shape[1]), width[band] if band >= 0 else 1)):
                    body = np.ascontiguousarray(matrix[:, first : first + width[band]] if band >= 0 else matrix)
                    rows.append((band, q, kept.take(at), head.tobytes() + body.tobytes()))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[2]) for r in rows)]), pa.int32()), pa.concat_arrays([r[2] for r in rows]) if rows else pa.array([], ids))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), lists, pa.array([r[3] for r in rows], pa.binary())], ["band", "q", "ids", "body"])

        for batch in batches:
            gathered: dict[int, list] = {}
            held_bytes = 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                g = grams_of(text)
                n, u = len(g), g.view(np.uint64)
                key = (int(_mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)), int(_mix(u * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)))
                own = int(np.searchsorted(firsts, n, "right")) - 1
                for band in (own, own - 1):
                    if band == own or (band >= 0 and n * percent <= (lows[own] - 1) * 100):
                        numbers = part_numbers(g, parts[band]) if n else np.zeros(0, np.uint32)
                        gathered.setdefault(band, []).append((k, n, *key, numbers))
                        held_bytes += 4 * len(numbers) + 100
                if held_bytes > FLUSH:
                    yield out(batch.column(0), gathered)
                    gathered, held_bytes = {}, 0
            if gathered:
                yield out(batch.column(0), gathered)

    return work


def _equal_runs(column: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with equal values, in portions."""
    order = np.argsort(column, kind="stable")
    value = column[order]
    first, left, right, total, step = np.arange(len(order)), [], [], 0, 1
    while True:
        first = first[first + step < len(order)]
        first = first[value[first] == value[first + step]]
        if not len(first):
            break
        left.append(order[first])
        right.append(order[first + step])
        total += len(first)
        step += 1
        if total > AT_ONCE:
            yield np.concatenate(left), np.concatenate(right)
            left, right, total = [], [], 0
    if left:
        yield np.concatenate(left), np.concatenate(right)


def _group_pairs(percent: int, band: int, n: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rows (i, j, surplus, wanted) of distinct sets that may be near: the shorter of this band, sizes close, and
    as many equal parts as this group's share of the bound demands. ``surplus`` is what it has beyond one less;
    over all groups a near pair's comes to ``wanted``. A pair is taken from its first equal part.

    Empty parts would be equal in many sets. A set with fewer empty parts than any pair must have equal ones
    meets others by its full parts alone, and its empty ones count as equal wherever they could be.
    """
    lows, parts, widths = _bands(percent)
    total, width, found = parts[band], matrix.shape[1], [np.zeros((0, 4), np.int64)]
    shares = [min(widths[band], total - at) for at in range(0, total, widths[band])]
    top = lows[band + 1] - 1
    least = width - (100 - percent) * (top + top * 100 // percent) // (100 + percent) * width // total
    empty = (matrix == 0).sum(axis=1)
    keys = matrix.astype(np.int64)
    few = np.flatnonzero(empty < least)
    keys[few] = np.where(matrix[few] == 0, -1 - few[:, None], keys[few])
    empty[empty >= least] = 0
    for c in range(width):
        for i, j in _equal_runs(keys[:, c]):
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = (small < lows[band + 1]) & (small * 100 >= large * percent)
            i, j, both = i[ok], j[ok], (small + large)[ok]
            for at in range(0, len(i), AT_ONCE):
                x, y = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
                equal = keys[x] == keys[y]
                differ = (100 - percent) * both[at : at + AT_ONCE] // (100 + percent)
                surplus = equal.sum(axis=1) + np.maximum(empty[x], empty[y]) - (width - differ * width // total) + 1
                take = (equal.argmax(axis=1) == c) & (surplus > 0)
                wanted = len(shares) - differ + sum(differ * w // total for w in shares)
                found.append(np.stack([x[take], y[take], surplus[take], wanted[take]], axis=1))
    return np.concatenate(found)


def _groups(percent: int, ids: pa.DataType):
    """The rows of one band and part group to members (x is of class y; once for each id) and pairs x, y."""

    def work(table: pa.Table) -> pa.Table:
        band, q = table["band"][0].as_py(), table["q"][0].as_py()
        names = pa.chunked_array([c.flatten() for c in table["ids"].chunks]).combine_chunks()
        heads, bodies = [], []
        for count, body in zip((len(x) for x in table["ids"]), table["body"]):
            data = body.as_buffer()
            heads.append(np.frombuffer(data, np.uint64, 3 * count).reshape(count, 3))
            bodies.append(np.frombuffer(data, np.uint32, offset=24 * count).reshape(count, -1))
        head, matrix = np.concatenate(heads), np.concatenate(bodies)
        plain = pa.types.is_integer(names.type)
        values = names.to_numpy(zero_copy_only=False) if plain else [_key(x) for x in names.to_pylist()]
        by_id = np.argsort(values, kind="stable") if plain else np.array(sorted(range(len(values)), key=values.__getitem__))
        _, first, cls = np.unique(head[by_id], axis=0, return_index=True, return_inverse=True)
        cls, rep = cls.reshape(-1), by_id[first]
        n = head[rep, 0].astype(np.int64)
        lows = _bands(percent)[0]
        kinds, xs, ys, counts = [], [], [], []
        if q == 0:
            own = np.ones(len(by_id), bool) if band < 0 else head[by_id, 0] < lows[band + 1]
            xs.append(by_id[own])
            ys.append(rep[cls[own]])
            kinds.append(np.zeros(own.sum(), bool))
            counts.append(np.zeros((own.sum(), 2), np.int64))
        if band >= 0:
            pairs = _group_pairs(percent, band, n, matrix[rep])
            place = np.empty(len(names), np.int64)
            place[by_id] = np.arange(len(by_id))
            a, b = rep[pairs[:, 0]], rep[pairs[:, 1]]
            swap = place[a] > place[b]
            xs.append(np.where(swap, b, a))
            ys.append(np.where(swap, a, b))
            kinds.append(np.ones(len(a), bool))
            counts.append(pairs[:, 2:])
        x, y, count = np.concatenate(xs), np.concatenate(ys), np.concatenate(counts)
        size = head[:, 0].astype(np.int64)
        return pa.table([pa.array(np.concatenate(kinds)), names.take(pa.array(x)), names.take(pa.array(y)), *map(pa.array, (size[x], size[y], count[:, 0].copy(), count[:, 1].copy()))], ["pair", "a", "b", "na", "nb", "surplus", "wanted"])

    return work


def _confirm(percent: int):
    """Rows of cells in order, texts before pairs, to the pairs that are near, with both numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def near(texts: list[tuple], pairs: list[tuple]) -> pa.RecordBatch:
            at = {_key(i): k for k, (i, _) in enumerate(texts)}
            sets = [grams_of(t) for _, t in texts]
            ends = np.cumsum([0, *map(len, sets)])
            all_, local = np.unique(np.concatenate(sets), return_inverse=True)
            local = [local[ends[k] : ends[k + 1]] for k in range(len(sets))]
            mark, last, found = np.zeros(len(all_), bool), None, []
            for x, y, a, b in sorted(((at[_key(a)], at[_key(b)], a, b) for a, b in pairs), key=lambda p: p[:2]):
                if x != last:
                    if last is not None:
                        mark[local[last]] = False
                    mark[local[x]] = True
                    last = x
                inter = int(np.count_nonzero(mark[local[y]]))
                either = len(sets[x]) + len(sets[y]) - inter
                if inter * 100 >= either * percent:
                    found.append((a, b, inter, either))
            columns = list(zip(*found)) if found else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (kind, kind, pa.int32(), pa.int32()))], ["a", "b", "inter", "either"])

        cell, texts, pairs = None, [], []
        for batch in batches:
            kind = batch.column(2).type
            for c, a, b, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if c != cell:
                    if pairs:
                        yield near(texts, pairs)
                    cell, texts, pairs = c, [], []
                if text is not None:
                    texts.append((a, text))
                else:
                    pairs.append((a, b))
        if pairs:
            yield near(texts, pairs)

    return work


def near_pairs(rows: DataFrame, id_column: str, text: Column, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): ``members`` maps id to cls, the smallest id of equal gram sets; ``pairs`` has
    classes a < b with 100 * intersection >= percent * union, and both numbers."""
    folder = shared_folder(rows.sparkSession)
    return _near(_held_texts(rows.select(F.col(id_column).alias("id"), normal_text(text).alias("text")), f"{folder}/texts"), folder, percent)


def _held_texts(rows: DataFrame, path: str) -> DataFrame:
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _near(texts: DataFrame, folder: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """``near_pairs`` of held rows (id, text) of normal texts."""
    kind = texts.schema["id"].dataType
    arrow = to_arrow_type(kind)
    signed = texts.select("id", "text").mapInArrow(_signatures(percent, arrow), T.StructType([T.StructField("band", T.IntegerType()), T.StructField("q", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("body", T.BinaryType())]))
    schema = T.StructType([T.StructField("pair", T.BooleanType()), T.StructField("a", kind), T.StructField("b", kind), T.StructField("na", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("nb", "surplus", "wanted"))])
    met = held(signed.groupBy("band", "q").applyInArrow(_groups(percent, arrow), schema), f"{folder}/met")
    members = met.where("not pair").select(F.col("a").alias("id"), F.col("b").alias("cls"))
    found = met.where("pair").groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("surplus").alias("surplus"), F.max("wanted").alias("wanted"))
    candidates = held(found.where("surplus >= wanted").drop("surplus", "wanted"), f"{folder}/candidates")

    # A class goes to a block of those that share its least candidate; a cell is what two blocks have in common.
    both = candidates.select(F.col("a").alias("id"), F.col("na").alias("n"), F.col("b").alias("other")).union(candidates.select("b", "nb", "a"))
    hubs = both.groupBy("id").agg(F.max("n").alias("n"), F.least(F.min("other"), F.col("id")).alias("hub"))
    blocks = hubs.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK).alias("k"))
    spots = held(hubs.join(blocks, "hub").select("id", F.struct(F.xxhash64("hub").alias("h"), F.pmod(F.xxhash64("id"), F.col("k")).alias("k")).alias("spot")), f"{folder}/spots")
    of = lambda c: spots.select(F.col("id").alias(c), F.col("spot").alias(f"s{c}"))
    cells = held(candidates.join(of("a"), "a").join(of("b"), "b").select(F.xxhash64(F.least("sa", "sb"), F.greatest("sa", "sb")).alias("cell"), "a", "b"), f"{folder}/cells")
    asked = held(cells.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct(), f"{folder}/asked")
    sides = texts.join(asked, "id").select("cell", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), "text")
    sides = sides.union(cells.select("cell", F.lit(1), "a", "b", F.lit(None).cast("string"))).repartition("cell").sortWithinPartitions("cell", "kind")
    result = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("inter", T.IntegerType()), T.StructField("either", T.IntegerType())])
    return members, held(sides.mapInArrow(_confirm(percent), result), f"{folder}/pairs")


def first_wins(rows: DataFrame, id_column: str, exact: dict[str, Column | tuple[Column, Column]], text: Column, near_reason: str, percent: int = 85) -> DataFrame:
    """id, kept, reasons: in the order of ids, a row goes if its exact key is that of an earlier kept row, or
    else its text is near that of an earlier kept row. A dropped row suppresses nothing. A key may be a pair:
    what this row looks for, and what kept rows offer; a null key looks for nothing and offers nothing.

    Rounds settle every row whose earlier rivals are settled, until none is open. Rivals are compared by
    class and key aggregates, never as pairs of rows. A row without any rival is kept at once and takes no
    part in the rounds.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark)
    names = list(exact)
    both = {n: c if isinstance(c, tuple) else (c, c) for n, c in exact.items()}
    keys = [*[c.alias(f"k_{n}") for n, (c, _) in both.items()], *[c.alias(f"o_{n}") for n, (_, c) in both.items()]]
    texts = _held_texts(rows.select(F.col(id_column).alias("id"), *keys, normal_text(text).alias("text")), f"{folder}/texts")
    members, pairs = _near(texts, folder, percent)
    nodes = texts.drop("text").join(members, "id")
    links = pairs.select(F.col("a").alias("cls"), F.col("b").alias("to")).union(pairs.select("b", "a")).union(members.select("cls", F.col("cls").alias("to")).distinct())
    links = held(links, f"{folder}/links")
    nodes = held(nodes, f"{folder}/nodes")

    # Rows that share a key or a class with others, or whose class has a link.
    crowd = links.where("cls <> to").select("cls").union(nodes.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")).distinct()
    contested = nodes.join(crowd, "cls", "left_semi").select("id")
    for n in names:
        offered = nodes.where(F.col(f"o_{n}").isNotNull()).groupBy(F.col(f"o_{n}").alias(f"k_{n}")).agg(F.count("*").alias("n"), F.min("id").alias("least"))
        contested = contested.union(nodes.join(offered, f"k_{n}").where("n > 1 or id <> least").select("id")).union(nodes.join(nodes.where(F.col(f"k_{n}").isNotNull()).select(F.col("id").alias("other"), F.col(f"k_{n}").alias(f"o_{n}")), f"o_{n}").where("id <> other").select("id") if both[n][0] is not both[n][1] else nodes.select("id").limit(0))
    contested = held(contested.distinct(), f"{folder}/contested")
    alone = nodes.join(contested, "id", "left_anti").select("id", F.lit(True).alias("kept"), F.array().cast("array<string>").alias("reasons"))
    state = held(nodes.join(contested, "id", "left_semi").withColumns({"kept": F.lit(None).cast("boolean"), "reasons": F.lit(None).cast("array<string>")}), f"{folder}/0")
    rounds = 0
    while state.where("kept is null").limit(1).count():
        out = state
        least = lambda key, name: state.groupBy(F.col(key).alias(name)).agg(F.min(F.when(F.col("kept"), F.col("id"))).alias("won"), F.min(F.when(F.col("kept").isNull(), F.col("id"))).alias("open"))
        for name in names:
            out = out.join(least(f"o_{name}", f"k_{name}").withColumnsRenamed({"won": f"won_{name}", "open": f"open_{name}"}), f"k_{name}", "left")
        by_class = links.join(least("cls", "to"), "to").groupBy("cls").agg(F.min("won").alias("won_near"), F.min("open").alias("open_near"))
        out = out.join(by_class, "cls", "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("id"), F.lit(False))
        hit = {n: before(f"won_{n}") for n in names}
        waits = [*(before(f"open_{n}") & ~hit[n] for n in names), before("open_near")]
        any_exact = F.greatest(*hit.values(), F.lit(False))
        reasons = F.filter(F.array(*(F.when(c, n) for n, c in hit.items()), F.when(~any_exact & before("won_near"), near_reason)), lambda r: r.isNotNull())
        # an open exact rival may add a reason, unless a kept one has given it; wait for a near one only if nothing else decides
        ready = ~F.greatest(*waits[:-1], F.lit(False)) & (any_exact | before("won_near") | ~waits[-1])
        settle = F.col("kept").isNull() & ready
        out = out.withColumn("_r", reasons).select(
            "id", *[f"k_{n}" for n in names], *[f"o_{n}" for n in names], "cls",
            F.when(settle, F.size("_r") == 0).otherwise(F.col("kept")).alias("kept"), F.when(settle, F.col("_r")).otherwise(F.col("reasons")).alias("reasons"),
        )
        rounds += 1
        state = held(out, f"{folder}/{rounds}")
    return state.select("id", "kept", "reasons").union(alone).withColumnRenamed("id", id_column)


def numbered(pages: DataFrame) -> DataFrame:
    """Pages with ``copy``: 0 for the first row of a page id, then 1, 2, …, by a hash of the text. Only pages
    whose id comes again are sorted."""
    again = held(pages.groupBy("page_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("page_id").alias("_id")), f"{shared_folder(pages.sparkSession)}/again")
    if not again.limit(1).count():
        return pages.withColumn("copy", F.lit(0))
    w = Window.partitionBy("page_id").orderBy(F.xxhash64("raw_text"), "raw_text")
    same = F.col("page_id").eqNullSafe(F.col("_id"))
    once = pages.join(again, same, "left_anti").withColumn("copy", F.lit(0))
    return once.unionByName(pages.join(again, same, "left_semi").withColumn("copy", F.row_number().over(w) - 1))


def deduplicate_pages(pages: DataFrame, percent: int = 85) -> DataFrame:
    """page_id, copy, kept, reasons, in the order of ids and copies: equal ids, equal titles, a redirect to the
    title of a kept page, near texts."""
    rows = pages if "copy" in pages.columns else numbered(pages)
    title, target = normalize_title(F.col("page_title")), normalize_title(F.col("redirect_target")) if "redirect_target" in pages.columns else F.lit(None).cast("string")
    alias = F.when((target != title) & (target != ""), target)
    rows = rows.withColumn("_place", F.col("page_id").cast("decimal(28,0)") * 1_000_000 + F.col("copy"))
    exact = {"duplicate_page_id": F.col("page_id"), "duplicate_title": title, "redirect_alias": (alias, title)}
    done = first_wins(rows, "_place", exact, F.coalesce("cleaned_text", "raw_text"), "near_duplicate_text", percent)
    at = F.floor(F.col("_place") / 1_000_000).cast("long")
    return done.select(at.alias("page_id"), (F.col("_place") - at * 1_000_000).cast("int").alias("copy"), "kept", "reasons")


def deduplicate_candidates(candidates: DataFrame, percent: int = 85) -> DataFrame:
    """candidate_id, kept, reasons, in the order of ``slot`` (that of generation; ids alone where there is none):
    equal questions, equal facts, near-equal questions."""
    fact = F.concat(normalize_answer(F.col("supporting_sentence")), F.lit("||"), normalize_answer(F.col("gold_answer")))
    slot = F.col("slot").cast("long") if "slot" in candidates.columns else F.lit(None).cast("long")
    rows = candidates.withColumn("_place", F.struct(slot.alias("slot"), F.col("candidate_id").alias("candidate_id")))
    done = first_wins(rows, "_place", {"duplicate_question": normalize_answer(F.col("question")), "duplicate_supporting_fact": fact}, F.col("question"), "near_duplicate_question", percent)
    return done.select("_place.candidate_id", "kept", "reasons")


def first_by_key(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def quota_sample(pages: DataFrame, run: Run) -> DataFrame:
    """Up to the quota of pages of each category, in the order of a keyed hash, with their ``rank``. Ids alone
    are ranked, by a fixed limit that the window's partial form can use; the rows follow by a join with the
    chosen ids, of which there are as many as the quotas allow."""
    quota = F.lit(None).cast("int")
    for name, n in run.categories.items():
        quota = F.when(F.col("category_group") == name, F.lit(n)).otherwise(quota)
    narrow = pages.where(F.col("category_group").isin(*run.categories)).select("page_id", "category_group")
    w = Window.partitionBy("category_group").orderBy(keyed(run.seed, F.col("category_group"), F.col("page_id")), "page_id")
    ranked = narrow.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(run.categories.values()))
    chosen = ranked.where(F.col("rank") <= quota).select("page_id", "rank")
    if set(pages.columns) <= {"page_id", "category_group"}:
        return ranked.where(F.col("rank") <= quota)
    return pages.join(F.broadcast(chosen), "page_id")
