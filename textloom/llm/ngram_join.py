"""Exact n-gram Jaccard join: a size-aware join with heavy and light sets.

Sets that are equal are one set from the start. A total order puts rare
shingles first (frequent ones last, by count), and two sets that are similar
enough share something within their first shingles, their prefixes:

* small (light) sets enumerate all 2-subsets of a prefix one longer than
  needed for one common shingle: similar sets share one such subset;
* large (heavy) sets scan the inverted lists of their prefix's shingles;
* the boundary is where the estimated cost of the first way, counted in keys,
  exceeds that of the second, in list entries.

Links form components. Sets that are linked already need no further proof, so
the sets of each list are compared with one of them first, the one with the
fewest shingles of its own, and only sets of different components are compared
afterwards. Nothing is capped: every pair that could still join two components
is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bloom import bits_for, gathered, maybe
from ._components import components
from ._numpy import U64, distinct, list_array, mix, shingles, slices, words
from ._spark import least_count, small_batches, staged, text_of

SIZE, NUM, DEN = 5, 75, 100
#: A shingle counts as frequent from so many counted sightings on; the MOST_FREQUENT of them are sorted last.
FREQUENT, MOST_FREQUENT = 12, 1 << 18
#: Shingles are counted so many at a time within a task.
HELD = 1 << 23
#: Sets beyond this size are never light.
LIGHT_AT_MOST = 48


def overlap(a: Column, b: Column) -> Column:
    """The least intersection of similar sets of ``a`` and ``b``: 100 i >= 75 (a + b - i)."""
    return F.ceil((F.lit(NUM) * (a + b)) / F.lit(NUM + DEN))


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = words(texts)
    h, offsets, _ = shingles(w.hashes(), w.of_text, SIZE)
    return distinct(h, offsets)


def _per_text(values: np.ndarray, offsets: np.ndarray, of: np.ufunc) -> np.ndarray:
    """``of`` reduced over each text's values; 0 for a text without any."""
    out = np.zeros(len(offsets) - 1, dtype=values.dtype)
    some = np.diff(offsets) > 0
    if some.any():
        out[some] = of.reduceat(values, offsets[:-1][some])
    return out


def _signatures(sets: np.ndarray, offsets: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a set, as two sums of mixed values; the first is its name.

    ``shared`` (ascending) are first halves that several sets have: these sets
    take their names from both halves, and all others keep theirs.
    """
    with np.errstate(over="ignore"):
        a, b = _per_text(mix(sets ^ U64(0x51ED270B9F3C5A17)), offsets, np.add), _per_text(mix(sets ^ U64(0xC2B2AE3D27D4EB4F)), offsets, np.add)
        if len(shared):
            where = shared[np.minimum(np.searchsorted(shared, a), len(shared) - 1)] == a
            a = np.where(where, mix(a + mix(b)), a)
    return a, b


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _batches(batch: pa.RecordBatch, i: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for a, b in slices(batch.column(i)):
        yield batch.slice(a, b - a), batch.column(i).slice(a, b - a)


def _sketches(rows: DataFrame, id_type: str, shared: np.ndarray) -> DataFrame:
    """Kind 0: a document's size and signature. Kind 1: a shingle seen in several sets of one slice. Kind 2: sums over a slice's sets of one size."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, list] = {"h": [], "n": []}
        before: set[int] = set()

        def counted() -> Iterator[pa.RecordBatch]:
            h, size = np.concatenate(count["h"]), np.concatenate(count["n"])
            order = np.argsort(h, kind="stable")
            h, size = h[order], size[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(h)))
            many = times > 1
            yield _sketch_rows(1, None, times[many], h[first][many], None)
            small = size <= LIGHT_AT_MOST
            entries, others = np.bincount(size[small], minlength=LIGHT_AT_MOST + 1), np.bincount(size[small], weights=(np.repeat(times, times) - 1)[small], minlength=LIGHT_AT_MOST + 1)
            use = np.flatnonzero(entries)
            yield _sketch_rows(2, None, use, entries[use].astype(U64), others[use].astype(U64))

        for batch in batches:
            for part, texts in _batches(batch, 1):
                sets, offsets = _sets(texts)
                n = np.diff(offsets)
                a, b = _signatures(sets, offsets, shared)
                yield _sketch_rows(0, part.column(0), n, a, b)
                # Frequencies count each different set once per task.
                fresh = np.array([s not in before for s in a.tolist()], dtype=bool)
                fresh[fresh] = [i == 0 for i in _repeats(a[fresh])]
                before.update(a[fresh].tolist())
                count["h"].append(sets[np.repeat(fresh, n)])
                count["n"].append(np.repeat(n[fresh], n[fresh]))
                if sum(map(len, count["h"])) > HELD:  # what a task holds stays bounded
                    yield from counted()
                    count = {"h": [], "n": []}
                    before.clear()
        if count["h"]:
            yield from counted()

    def _repeats(x: np.ndarray) -> list[int]:
        seen: dict[int, int] = {}
        return [seen.setdefault(v, -1) + 1 if v not in seen else 1 for v in x.tolist()]

    def _sketch_rows(kind: int, ids, n, a, b) -> pa.RecordBatch:
        size = len(n)
        ids = pa.nulls(size, id_arrow) if ids is None else ids
        b = np.zeros(size, U64) if b is None else b
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), ids, pa.array(n.astype(np.int64)), _long(a), _long(b)], names=["kind", "id", "n", "a", "b"])

    id_arrow = rows.select("id").limit(0).toArrow().schema.field(0).type
    return rows.mapInArrow(sketch, f"kind int, id {id_type}, n long, a long, b long")


def _light_boundary(sums: DataFrame) -> int:
    """The largest size up to which enumerating 2-subsets costs less than scanning lists.

    A set of n has p = n - ceil(0.75 n) + 1 list entries and scans lists whose
    mean length, for its size, is measured in the sketches; or it has
    p (p + 1) / 2 keys, which hardly anything but similar sets shares.
    """
    best = 0
    by_size = sums.groupBy("n").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("tasks")).collect()  # LIGHT_AT_MOST rows at most
    tasks = max((r["tasks"] for r in by_size), default=1)
    for size, entries, others in sorted((r["n"], r["a"], r["b"]) for r in by_size):
        p = size + 1 - -(-size * NUM // DEN)
        if size > 2 and p * (p + 1) / 2 <= p * (1 + tasks * others / max(1, entries)):
            best = size
    return best


def _keys(rows: DataFrame, frequent: np.ndarray, light: int, shared: np.ndarray) -> DataFrame:
    """Keys of each set: (key, sig, n, pos). List entries have even keys and their place in the order, 2-subsets odd ones."""
    order = np.argsort(frequent)
    known = rows.sparkSession.sparkContext.broadcast((frequent[order], order.astype(U64)))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, rank = known.value
        table = np.zeros(1 << 22, dtype=bool)
        table[(value >> U64(42)).astype(np.int64)] = True
        before: set[int] = set()
        for batch in batches:
            for _, texts in _batches(batch, 0):
                sets, offsets = _sets(texts)
                n = np.diff(offsets)
                sig = _signatures(sets, offsets, shared)[0]
                ranked = sets >> U64(1)  # rare shingles by hash, frequent ones behind them
                if len(value):
                    at = np.flatnonzero(table[(sets >> U64(42)).astype(np.int64)])
                    j = np.minimum(np.searchsorted(value, sets[at]), len(value) - 1)
                    same = value[j] == sets[at]
                    ranked[at[same]] = U64(1 << 63) + rank[j[same]]
                keys, of, pos = [], [], []
                for i, (a, b, s) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), sig.tolist(), strict=True)):
                    if a == b or s in before:
                        continue
                    before.add(s)
                    size = b - a
                    p = size + 1 - -(-size * NUM // DEN)
                    by = np.argsort(ranked[a:b], kind="stable") if ranked[a:b].max() >> U64(63) else np.arange(size)
                    own = sets[a:b][by]
                    if size > light * NUM // DEN:
                        keys.append(own[:p] & ~U64(1))
                        of.append(np.full(p, i))
                        pos.append(np.arange(p, dtype=np.int32))
                    if 2 < size <= light:
                        x, y = np.triu_indices(min(p + 1, size), 1)
                        pair = mix(np.minimum(own[x], own[y]) * U64(3) + np.maximum(own[x], own[y])) | U64(1)
                        keys.append(pair)
                        of.append(np.full(len(pair), i))
                        pos.append(np.zeros(len(pair), dtype=np.int32))
                if keys:
                    of = np.concatenate(of)
                    yield pa.RecordBatch.from_arrays([_long(np.concatenate(keys)), _long(sig[of]), pa.array(n[of]), pa.array(np.concatenate(pos))], names=["key", "sig", "n", "pos"])

    return rows.select("t").mapInArrow(prefix, "key long, sig long, n long, pos int")


def _whole_sets(rows: DataFrame, wanted: DataFrame, shared: np.ndarray) -> DataFrame:
    """(sig, n, set) of the sets whose ``sig`` is in ``wanted``: a filter in the scan, then an exact semi-join."""
    wanted = staged(wanted.select("sig").distinct(), "wanted")
    likely = rows.sparkSession.sparkContext.broadcast(gathered(wanted.select(F.col("sig").alias("h")), bits_for(wanted.count())))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: set[int] = set()
        for batch in batches:
            for _, texts in _batches(batch, 0):
                sets, offsets = _sets(texts)
                sig = _signatures(sets, offsets, shared)[0]
                hit = maybe(likely.value, sig)
                use = [i for i in np.flatnonzero(hit & (np.diff(offsets) > 0)).tolist() if not (sig[i] in before or before.add(sig[i]))]
                if use:
                    sizes = np.diff(offsets)[use]
                    flat = np.concatenate([sets[offsets[i] : offsets[i + 1]] for i in use])
                    yield pa.RecordBatch.from_arrays([_long(sig[use]), pa.array(sizes), list_array(_long(flat), np.concatenate(([0], np.cumsum(sizes))))], names=["sig", "n", "members"])

    found = rows.select("t").mapInArrow(whole, "sig long, n long, members array<long>")
    return found.join(wanted, "sig", "left_semi").dropDuplicates(["sig"])


def _verified(rows: DataFrame, pairs: DataFrame, shared: np.ndarray) -> DataFrame:
    """The (u, v) of ``pairs`` whose whole sets are similar."""
    pairs = staged(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    sets = staged(_whole_sets(rows, pairs.select(F.col("u").alias("sig")).unionByName(pairs.select(F.col("v").alias("sig"))), shared), "sets")
    left = pairs.join(sets.select(F.col("sig").alias("u"), F.col("n").alias("nu"), F.col("members").alias("mu")), "u")
    both = left.join(sets.select(F.col("sig").alias("v"), F.col("n").alias("nv"), F.col("members").alias("mv")), "v")
    return staged(both.filter(F.size(F.array_intersect("mu", "mv")) >= overlap(F.col("nu"), F.col("nv"))).select("u", "v"), "links")


def _ratio(a: Column, b: Column) -> Column:
    """Sizes alone don't rule out a link."""
    return F.least(a, b) * DEN >= F.greatest(a, b) * NUM


def _ranked(entries: DataFrame) -> DataFrame:
    """With each list entry's rank among its set's entries, which are those that can be shared at all."""
    of = Window.partitionBy("sig").orderBy("listed", "pos", "key")
    return entries.withColumn("listed", F.col("key").bitwiseAND(F.lit(1)) == 0).withColumn("rank", F.row_number().over(of) - F.sum((~F.col("listed")).cast("int")).over(Window.partitionBy("sig")) - 1)


def _may_link(x: str, y: str) -> Column:
    """The sets of two entries of a key can be similar.

    What they share before the key is among the ranked entries of both, and
    what they share behind it is behind it in both.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    most = F.least(c(x, "rank"), c(y, "rank")) + 1 + F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos")) - 1
    return _ratio(c(x, "n"), c(y, "n")) & (~c(x, "listed") | (most >= overlap(c(x, "n"), c(y, "n"))))


def _first_pairs(entries: DataFrame) -> DataFrame:
    """All sets of a list with that one of them which has the fewest unshared shingles before the key."""
    ranked = staged(_ranked(entries), "ranked")
    heads = staged(ranked.groupBy("key").agg(F.min(F.struct((F.col("pos") - F.col("rank")).alias("own"), "sig", "n", "pos", "rank", "listed")).alias("p")).select("key", "p.*"), "heads")
    met = ranked.alias("x").join(heads.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.sig") != F.col("y.sig")) & _may_link("x", "y"))
    return met.select(F.greatest("x.sig", "y.sig").alias("u"), F.least("x.sig", "y.sig").alias("v")).distinct()


def _last_pairs(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Sets of different components that share keys enough to be similar.

    Of two sets the smaller one is found by its first shingles alone: as many
    as a set that has to share six sevenths of itself cannot all do without.
    """
    placed = staged(entries.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", "n", "pos", F.coalesce("root", "sig").alias("root")), "placed")
    mixed = staged(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key"), "mixed")
    open_ = staged(_ranked(placed.join(mixed, "key", "left_semi")), "open")
    behind = F.ceil(F.col("n") * F.lit(2 * NUM) / F.lit(NUM + DEN)) - 1  # shingles behind the first ones
    x, y = open_.alias("x"), open_.filter(~F.col("listed") | (F.col("pos") < F.col("n") - behind)).withColumn("behind", behind).alias("y")
    larger = F.struct("x.n", "x.sig") > F.struct("y.n", "y.sig")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & larger & _may_link("x", "y"))
    counted = met.groupBy(F.col("x.sig").alias("u"), F.col("y.sig").alias("v")).agg(
        F.first("x.n").alias("nu"), F.first("y.n").alias("nv"), F.first("behind").alias("behind"), F.sum(F.col("x.listed").cast("long")).alias("shared"), F.max(~F.col("x.listed")).alias("subset")
    )
    rest = F.greatest(F.ceil(F.col("nu") * F.lit(NUM) / F.lit(DEN)) - 1, F.col("behind"))
    return counted.filter(F.col("subset") | (F.col("shared") + rest >= overlap(F.col("nu"), F.col("nv")))).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set
    has all distinct 5-word shingles of the whole text, or with fewer words the
    whole sequence. Texts link when 100 * intersection >= 75 * union. Null and
    empty texts have no shingles and no links. component_id is the smallest id
    reachable. Rows that repeat are rows of their own, in one component; ids
    may have any type that has an order; a very long text is one set, hashed
    piece by piece; further columns are ignored; an empty table gives an empty
    result.
    """
    small_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    shared = np.zeros(0, U64)
    while True:
        sketch = staged(_sketches(rows, id_type, shared), "sketch")
        texts = sketch.filter("kind = 0")
        nodes = staged(texts.filter("n > 0").groupBy(F.col("a").alias("sig")).agg(F.min("n").alias("n"), F.max("n").alias("most"), F.min("b").alias("b"), F.max("b").alias("b2"), F.min("id").alias("first")), "nodes")
        # Different sets under one name, a few among 10^10: these are named by both halves.
        again = nodes.filter("n <> most or b <> b2").select("sig").toArrow()["sig"].to_numpy().view(U64)
        if not len(np.setdiff1d(again, shared)):
            break
        shared = np.union1d(shared, again)

    light = _light_boundary(sketch.filter("kind = 2"))
    often = staged(sketch.filter("kind = 1").groupBy(F.col("a").alias("h")).agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT), "often")
    often = often.filter(F.col("n") >= least_count(often, MOST_FREQUENT)).toArrow()
    by_count = np.lexsort((often["h"].to_numpy(), often["n"].to_numpy()))
    frequent = often["h"].to_numpy()[by_count].view(U64)

    key = Window.partitionBy("key")
    entries = _keys(rows, frequent, light, shared).withColumn("lo", F.min("sig").over(key)).withColumn("hi", F.max("sig").over(key)).filter("lo <> hi").select("key", "sig", "n", "pos")
    entries = staged(entries, "entries")
    first = staged(components(_verified(rows, _first_pairs(entries), shared)), "first")
    links = _verified(rows, _last_pairs(entries, first), shared)

    # Links between components make components of components.
    root = lambda end: F.coalesce(F.col(f"r{end}.root"), F.col(end)).alias(end)
    over = links.join(first.alias("ru"), F.col("u") == F.col("ru.node"), "left").join(first.alias("rv"), F.col("v") == F.col("rv.node"), "left").select(root("u"), root("v"))
    second = staged(components(over), "second")
    placed = nodes.select("sig", "first").join(first, F.col("sig") == F.col("node"), "left").select("sig", "first", F.coalesce("root", "sig").alias("root1")).join(second, F.col("root1") == F.col("node"), "left").select("sig", "first", F.coalesce("root", "root1").alias("root"))
    placed = staged(placed, "roots")
    least = staged(placed.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "components")
    named = staged(placed.join(least, "root", "left").select(F.col("sig").alias("s"), F.coalesce("component", "first").alias("component")), "named")
    return texts.select("id", "n", F.when(F.col("n") > 0, F.col("a")).alias("s")).join(named, "s", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
