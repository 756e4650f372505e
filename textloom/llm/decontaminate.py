"""Benchmark items in documents: SimHashes of item-sized windows, multi-index Hamming blocks, exact proof.

A window of a document has as many words as an item. Windows get 128-bit
SimHashes; an index over blocks of the items' hashes gives every item within
RADIUS of a window, and exact weighted-shingle similarity decides. Windows that
together with all items of their length share too little weight to be similar
to any of them, mostly none at all, are not hashed.

A shingle counts in a SimHash with the square root of its weight. The cosine of
two sets is then common / sqrt(a b), where a and b are their weights: with a
weighted similarity s it is 2 s / (1 + s) at least, however unequal single
weights are. At s = 0.75 that is an angle of 31 degrees, or some 22 of 128 bits
with a deviation of 4.3; RADIUS leaves two deviations. What a window misses its
neighbours mostly find; the tests measure a recall of 0.9 or more at the very
threshold, and passages that are whole have distance 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bloom import bits_for, gathered, maybe
from ._numpy import U64, mix, shingles, slices, words
from ._spark import small_batches, staged, text_of

SIZE, THRESHOLD = 5, 0.75
BITS, BLOCKS = 128, 8
RADIUS = 31
#: Items go to the executors in blocks of so many characters at most, or one longer item.
ITEM_CHARS = 16_000_000
#: Windows are hashed in stretches of about so many words; longer windows, a few bits at a time.
STRETCH, QUERIES = 1 << 13, 1 << 11


def _signs(h: np.ndarray, low: int = 0, high: int = BITS // 8) -> np.ndarray:
    """Signs (+1, -1) of the 128 bits of each shingle, or of some bytes of them."""
    both = np.stack((h, mix(h ^ U64(0x6A09E667F3BCC909))), axis=1)
    return np.unpackbits(both.view(np.uint8)[:, low:high], axis=1).astype(np.float64) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Signs of sums as bytes of bits."""
    return np.packbits(sums > 1e-9, axis=1)


_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _masks(most: int) -> np.ndarray:
    """All 16-bit words with ``most`` bits set at most."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[_POP[every & 255] + _POP[every >> 8] <= most]


class HammingIndex:
    """All of some fingerprints within ``radius`` of a query.

    Two fingerprints within the radius differ, in one of BLOCKS blocks of 16
    bits, in radius // BLOCKS bits at most. Tables by block list every
    fingerprint under its own block and those one bit away; a query looks up
    the blocks that are as many bits away as are left.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = np.ascontiguousarray(prints), radius
        near = radius // BLOCKS
        stored, self.masks = _masks(min(1, near)), _masks(max(0, near - 1))
        self.tables = []
        for b in range(BLOCKS):
            flat = (self.prints.view(np.uint16)[:, b, None] ^ stored).ravel()
            order = np.argsort(flat, kind="stable")
            self.tables.append((np.searchsorted(flat[order], np.arange((1 << 16) + 1)).astype(np.int32), (order // len(stored)).astype(np.int32)))

    def candidates(self, queries: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, fingerprint) that some block brings together, of the fingerprints that ``among`` marks."""
        n = max(1, len(self.prints))
        found = [np.zeros(0, np.int64)]
        for b, (start, owner) in enumerate(self.tables):
            value = (np.ascontiguousarray(queries).view(np.uint16)[:, b, None] ^ self.masks).astype(np.int32)
            low, size = start[value], start[value + 1] - start[value]
            q, _ = at = np.nonzero(size)
            low, size = low[at], size[at]
            i = owner[np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)]
            q = np.repeat(q, size)
            if among is not None:
                q, i = q[among[i]], i[among[i]]
            found.append(q * n + i)
        return np.divmod(np.unique(np.concatenate(found)), n)

    def search(self, queries: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (query, fingerprint, distance) within the radius."""
        rows = []
        for at in range(0, len(queries), QUERIES):
            q, i = self.candidates(queries[at : at + QUERIES], among)
            d = _POP[queries[at + q] ^ self.prints[i]].sum(axis=1, dtype=np.int64)
            ok = d <= self.radius
            rows.append((at + q[ok], i[ok], d[ok]))
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3


class Items:
    """A block of items: shingles, weights, fingerprints, and for each length in words the shingles that its items have."""

    def __init__(self, texts: list[str], n_items: int, common: dict[int, int]):
        w = words(pa.array(texts, pa.string()))
        h, offsets, _ = shingles(w.hashes(), w.of_text, SIZE)
        self.length = np.diff(w.of_text)
        self.top = 1 + np.log(max(1, n_items))
        self.sets = [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.known = np.unique(h)
        self.weight = np.array([self.top - np.log(common.get(int(x), 1)) for x in self.known.view(np.int64)])
        self.total = np.array([self.weigh(s).sum() for s in self.sets])
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[(self.known >> U64(44)).astype(np.int64)] = True
        self.index = HammingIndex(np.concatenate([np.zeros((0, BITS // 8), np.uint8), *[self.print_of(s) for s in self.sets]]))
        #: By length: which of the known shingles its items have, and the least weight of one of them.
        self.by_length: dict[int, tuple[np.ndarray, float]] = {}
        for n in np.unique(self.length[self.length > 0]).tolist():
            which = np.flatnonzero(self.length == n)
            self.by_length[n] = np.unique(np.concatenate([np.searchsorted(self.known, self.sets[i]) for i in which])), float(self.total[which].min())

    def print_of(self, h: np.ndarray) -> np.ndarray:
        """The fingerprint of a set, as one row of bytes."""
        out, root = np.empty((1, BITS // 8), np.uint8), np.sqrt(self.weigh(h))
        for low in range(0, BITS // 8, 4):
            out[:, low : low + 4] = _pack((_signs(h, low, low + 4) * root[:, None]).sum(axis=0)[None])
        return out

    def prints(self, h: np.ndarray, starts: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the windows of ``runs`` shingles that begin at ``starts`` (ascending), and which of these have repeated shingles."""
        out, twice = np.empty((len(starts), BITS // 8), np.uint8), np.zeros(len(starts), dtype=bool)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + STRETCH)))
            at = starts[i:j] - starts[i]
            part = h[starts[i] : starts[j - 1] + runs]
            order = np.argsort(part, kind="stable")
            same = part[order[1:]] == part[order[:-1]]
            left, right = order[:-1][same], order[1:][same]
            left, right = left[right - left < runs], right[right - left < runs]
            # A pair of equal shingles is in the windows that begin behind right - runs, and not behind left.
            marks = np.bincount(np.maximum(0, right - runs + 1), minlength=len(part) + 1) - np.bincount(left + 1, minlength=len(part) + 1)
            twice[i:j] = np.cumsum(marks)[at] > 0
            root = np.sqrt(self.weigh(part))[:, None]
            step = BITS // 8 if len(part) <= 4 * STRETCH else 1
            for low in range(0, BITS // 8, step):
                total = np.concatenate((np.zeros((1, 8 * step)), np.cumsum(_signs(part, low, low + step) * root, axis=0)))
                out[i:j, low : low + step] = _pack(total[at + runs] - total[at])
            for k in np.flatnonzero(twice[i:j]).tolist():
                out[i + k] = self.print_of(np.unique(part[at[k] : at[k] + runs]))
            i = j
        return out, twice

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the known ones, or -1."""
        out = np.full(len(h), -1)
        at = np.flatnonzero(self.table[(h >> U64(44)).astype(np.int64)])
        j = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        same = self.known[j] == h[at]
        out[at[same]] = j[same]
        return out

    def weigh(self, h: np.ndarray) -> np.ndarray:
        j = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[j] == h, self.weight[j], self.top)

    def similarity(self, window: np.ndarray, item: int) -> float:
        window = np.unique(window)
        common = self.weigh(window[np.isin(window, self.sets[item], assume_unique=True)]).sum()
        return float(common / (self.weigh(window).sum() + self.total[item] - common))

    def matches(self, h: np.ndarray, n_words: int, run: int) -> dict[int, tuple]:
        """Best (similarity, start, distance, words) by item, for a text's runs ``h`` of ``run`` words."""
        place = self.find(h)
        hits = np.flatnonzero(place >= 0)
        best: dict[int, tuple] = {}
        if not len(hits):
            return best
        held, weights = place[hits], None
        present = np.unique(held)
        for n, (shingles_of, least) in self.by_length.items():
            if min(n, SIZE, n_words) != run or not np.isin(present, shingles_of, assume_unique=True).any():
                continue
            size = min(n, n_words)
            runs = size - run + 1  # in a window
            p = hits[np.isin(held, shingles_of)]
            total = np.concatenate(([0.0], np.cumsum(self.weight[place[p]])))
            # Only windows that begin up to runs before a hit have any; what they share, repeats included, bounds every similarity.
            edges = np.unique(np.clip(np.concatenate((p - runs + 1, p + 1, [0, len(h) - runs + 1])), 0, len(h) - runs + 1))
            shared = total[np.searchsorted(p, edges[:-1] + runs)] - total[np.searchsorted(p, edges[:-1])]
            use = np.flatnonzero(shared >= (THRESHOLD - 1e-9) * least)
            length = edges[use + 1] - edges[use]
            starts = np.arange(length.sum()) + np.repeat(edges[use] - (np.cumsum(length) - length), length)
            if not len(starts):
                continue
            found, twice = self.prints(h, starts, runs)
            q, i, d = self.index.search(found, among=self.length == n)
            if len(q) and weights is None:
                weights = np.concatenate(([0.0], np.cumsum(self.weigh(h))))
            for item in np.unique(i).tolist():
                at = q[i == item]
                x = starts[at]
                own = p[np.isin(h[p], self.sets[item])]
                total = np.concatenate(([0.0], np.cumsum(self.weight[place[own]])))
                common = total[np.searchsorted(own, x + runs)] - total[np.searchsorted(own, x)]
                sim = common / np.maximum(weights[x + runs] - weights[x] + self.total[item] - common, 1e-12)
                for k in np.flatnonzero(twice[at]).tolist():
                    sim[k] = self.similarity(h[x[k] : x[k] + runs], item)
                k = int(np.argmax(np.round(sim, 9)))
                exact = self.similarity(h[x[k] : x[k] + runs], item)
                if exact >= THRESHOLD - 1e-12:
                    best[item] = exact, int(x[k]), int(d[i == item][k]), size
        return best


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list]:
    """All items, in blocks of bounded size, in order of their ids."""
    block, size = [], 0
    for r in items.select(F.col(item_id).alias("i"), text_of(item_text).alias("t")).orderBy("i", "t").toLocalIterator():
        if block and size + len(r["t"]) > ITEM_CHARS:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, start_word, n_words, distance, similarity.

    A document holds an item if a window of as many words (the whole text, if
    that is shorter) has a SimHash within RADIUS of the item's and a weighted
    Jaccard similarity of 0.75 or more with it, over distinct 5-word shingles
    (fewer words: the whole sequence); the best and first such window is
    reported. A shingle weighs 1 + ln(items / items that have it). Words are
    runs of anything but ASCII white space, with A-Z lower-cased. Null and
    empty texts and items match nothing; items that repeat match apart; rows
    that repeat give rows of their own; ids may have any type; further columns
    are ignored; without items or documents the result is empty.

    Documents are scanned once. Only if the items don't fit into one block are
    those documents that share a shingle with any item written out first, and
    scanned again for every block.
    """
    small_batches(docs.sparkSession)
    id_type, item_type = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id]
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch.column(0))
            h, offsets, _ = shingles(w.hashes(), w.of_text, SIZE)
            each = [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, U64), *each]).view(np.int64))], names=["h"])

    n_items, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text_of(item_text))), F.lit(0))).first()
    common = items.select(text_of(item_text)).mapInArrow(grams, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    item_arrow = items.select(item_id).limit(0).toArrow().schema.field(0).type
    schema = f"doc_id {id_type}, item_id {item_type}, start_word long, n_words long, distance long, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    several = chars > ITEM_CHARS
    if several:
        rows = staged(_sharing(rows, staged(items.select(text_of(item_text)).mapInArrow(grams, "h long").distinct(), "grams")), "sharing")
    for block in _blocks(items, item_id, item_text):
        own = docs.sparkSession.createDataFrame([(t,) for _, t in block], "t string").mapInArrow(grams, "h long").distinct()
        table = common.join(own, "h", "left_semi").toArrow()
        weights = dict(zip(table["h"].to_pylist(), table["n"].to_pylist(), strict=True))
        held = docs.sparkSession.sparkContext.broadcast(([i for i, _ in block], [t for _, t in block], n_items, weights))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            item_ids, item_texts, *rest = held.value
            item_ids, index = pa.array(item_ids, item_arrow), Items(item_texts, *rest)
            short = sorted({int(n) for n in index.length if 0 < n < SIZE})
            for batch in batches:
                for a, b in slices(batch.column(1)):
                    texts, ids = batch.column(1).slice(a, b - a), batch.column(0).slice(a, b - a)
                    w = words(texts)
                    hashes, n = w.hashes(), np.diff(w.of_text)
                    found: list[tuple] = []
                    for run in [SIZE, *short]:
                        # Texts of fewer than SIZE words are one run already in the first round.
                        h, offsets, _ = shingles(hashes, w.of_text, run)
                        if not len(index.known):
                            break
                        hit = np.flatnonzero(index.find(h) >= 0)
                        for d in np.unique(np.searchsorted(offsets, hit, side="right") - 1).tolist():
                            size = min(run, int(n[d]))
                            if run == SIZE or n[d] > run:
                                for item, best in index.matches(h[offsets[d] : offsets[d + 1]], int(n[d]), size).items():
                                    found.append((d, item, *best))
                    d, item, sim, start, dist, size = zip(*found, strict=True) if found else ((),) * 6
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(d, pa.int64())), item_ids.take(pa.array(item, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(dist, pa.int64()), pa.array(sim, pa.float64())],
                        names=["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"],
                    )

        one = rows.mapInArrow(search, schema)
        if several:
            one = staged(one, "held")
            held.unpersist()
        out = out.unionByName(one)
    return out


def _sharing(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """The ``rows`` (id, t) that may have one of the shingles ``grams`` (h), or are shorter than a shingle, so that shorter runs of theirs may be an item's."""
    some = rows.sparkSession.sparkContext.broadcast(gathered(grams, bits_for(grams.count())))

    def sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                w = words(batch.column(1).slice(a, b - a))
                keep, hashes = np.zeros(b - a, dtype=bool), w.hashes()
                for run in range(1, SIZE + 1):
                    h, offsets, _ = shingles(hashes, w.of_text, run)
                    keep[np.searchsorted(offsets, np.flatnonzero(maybe(some.value, h)), side="right") - 1] = True
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return rows.mapInArrow(sharing, rows.schema)
