"""A hashed maximum-entropy language model with a class-factored softmax.

P(w | h) = P(class | h) P(w | class), and the class "repeat" adds its
probability to the word that came before. Classes are the most frequent words,
each its own, buckets of words that end alike, the end of a text, and "repeat".
P(class | h) is a softmax over hashed features: the four words before, as
skips, two n-grams, and which of them repeat. P(w | class) is the smoothed
share of the word in its class's training tokens, so that all words together,
with one for all unknown ones, have probability 1.

Word counts are a table of all training documents. Frequent words, a bounded
number, are looked up where the texts are; what depends on other words' counts
joins that table and is added per document. Which words are looked up changes
no score: any word that follows itself may be a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._numpy import U64, Words, mix, slices, words
from ._spark import least_count, small_batches, staged, text_of

FREQUENT, FREQUENT_BYTES = 1 << 18, 48
SINGLES, BUCKETS = 12, 18
END, REPEAT = SINGLES + BUCKETS, SINGLES + BUCKETS + 1
CLASSES = REPEAT + 1
ROWS, FEATURES, BLOCK = 1 << 14, 8, 256
#: Training goes over every position of every training document once, in ROUNDS parts.
ROUNDS, RATE, BATCH = 2, 0.12, 2048
#: Features are made for so many positions at a time, whole batches that stay in the cache.
PART = BATCH * 8
#: Suffixes are put into buckets by which singles stand up to so many words before them.
SUFFIXES, NEAR = 1 << 12, 3
SMOOTH = 0.1
#: Rows of gradients are added so many at a time.
STEP = 16
#: So many positions are multiplied at a time: larger products would wake the library's threads.
WIDE = 128
#: Sums of weights up to here are safe to raise e to.
FAR = 60


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray  # of the frequent words, ascending
    counts: np.ndarray
    singles: np.ndarray  # hashes of the words that are classes
    bucket: np.ndarray  # by suffix
    weights: np.ndarray  # ROWS x CLASSES
    total: int = 0  # training tokens
    distinct: int = 0
    docs: int = 0
    class_tokens: np.ndarray | None = None
    class_words: np.ndarray | None = None

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    def inside(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(word | class); a class that is one word is sure of it."""
        many = (cls >= SINGLES) & (cls < END)
        return np.where(many, np.log10((count + SMOOTH) / (self.class_tokens[cls] + SMOOTH * (self.class_words[cls] + 1))), 0.0)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places among the frequent words, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        each, of = np.unique(h, return_inverse=True)
        j = np.minimum(np.searchsorted(self.hashes, each), len(self.hashes) - 1)
        return np.where(self.hashes[j] == each, j, -1)[of]

    def classes(self, w: Words, h: np.ndarray) -> np.ndarray:
        out = self.bucket[suffixes(w)].astype(np.int64)
        for k, single in enumerate(self.singles):
            out[h == single] = k
        return out


def suffixes(w: Words) -> np.ndarray:
    """A hash of each word's last two bytes, and of whether it is short."""
    last = w.data[w.end - 1].astype(np.uint64)
    short = w.end - w.begin < 2
    before = np.where(short, 0, w.data[np.maximum(w.end - 2, 0)]).astype(np.uint64)
    return (mix(last * U64(512) + before * U64(2) + (w.end - w.begin < 4).astype(np.uint64) + U64(1 << 20)) & U64(SUFFIXES - 1)).astype(np.int64)


def sequences(w: Words, h: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with their ends: hash (0 at an end), class, word number (-1 at an end), and texts' offsets."""
    n = np.diff(w.of_text)
    offsets = np.concatenate(([0], np.cumsum(n + 1)))
    place = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
    token, kind, word = np.zeros(offsets[-1], U64), np.full(offsets[-1], END), np.full(offsets[-1], -1)
    token[place], kind[place], word[place] = h, cls, np.arange(len(h))
    return token, kind, word, offsets


def contexts(token: np.ndarray, offsets: np.ndarray, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the positions ``where`` (or all), and the words before them (0 at a text's start)."""
    where = np.arange(len(token)) if where is None else where
    position = where - offsets[np.searchsorted(offsets, where, side="right") - 1]
    a, b, c, d = (np.where(position >= back, token[np.maximum(where - back, 0)], U64(0)) for back in range(1, 5))
    same = (a == b).astype(np.uint64) + U64(2) * (b == c).astype(np.uint64) + U64(4) * (a == c).astype(np.uint64) + U64(8) * (a == U64(0)).astype(np.uint64)
    two = mix(a) + b
    rows = np.empty((FEATURES, len(where)), dtype=np.int64)  # each feature's rows are together
    for f, k in enumerate((a, b * U64(3), c * U64(5), d * U64(7), two, mix(two) + c)):
        rows[f] = _row(f, k)
    rows[-2], rows[-1] = SAME.take(same.view(np.int64)), ALWAYS
    return rows.T, a


def _row(f: int, key: np.ndarray) -> np.ndarray:
    return mix(key + U64((f + 1) * 0x9E3779B97F4A7C15 % 2**64)) & U64(ROWS - 1)


#: The last two features have a few rows only: one for each way in which the words before repeat, and one for all positions.
SAME = _row(FEATURES - 2, np.arange(16, dtype=U64) + U64(11)).astype(np.int64)
ALWAYS = int(_row(FEATURES - 1, np.array([13], dtype=U64))[0])
_SAME_AT = np.zeros(ROWS, dtype=np.int64)
_SAME_AT[SAME] = np.arange(16)


def preceding(token: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The word before every position, 0 at a text's start."""
    out = np.zeros_like(token)
    out[1:] = token[:-1]
    out[offsets[:-1]] = U64(0)
    return out


def parts(n: int) -> Iterator[np.ndarray]:
    """All positions, so many at a time: features take much more room than the words."""
    for at in range(0, n, PART):
        yield np.arange(at, min(n, at + PART))


def exponentials(weights: np.ndarray, rows: np.ndarray, may_repeat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What classes' probabilities are in proportion to, and the sum of each row."""
    z = (weights.take(SAME, axis=0) + weights[ALWAYS]).take(_SAME_AT.take(rows[:, -2]), axis=0)
    for f in range(FEATURES - 2):
        z += weights.take(rows[:, f], axis=0)
    safe = not z.size or (z.max() < FAR and z.min() > -FAR)
    z[~may_repeat, REPEAT] = -1e9
    if not safe:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, np.einsum("ij->i", z)


def class_probabilities(weights: np.ndarray, rows: np.ndarray, may_repeat: np.ndarray) -> np.ndarray:
    z, total = exponentials(weights, rows, may_repeat)
    z /= total[:, None]
    return z


def row_sums(g: np.ndarray, owner: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of ``g[owner[first[i]:first[i + 1]]]`` for every i, none of them empty.

    Goes by pieces of STEP rows, all pieces side by side, and then by sums of
    pieces: reduceat takes short rows one by one.
    """
    sizes = np.diff(np.append(first, len(owner)))
    n = -(-sizes // STEP)
    head = np.cumsum(n) - n
    start = np.repeat(first - head * STEP, n) + np.arange(n.sum()) * STEP
    length = np.minimum(STEP, np.repeat(first + sizes, n) - start)
    by = np.argsort((STEP - length).astype(np.uint8), kind="stable")
    start = start[by]
    got = g.take(owner[start], axis=0)
    for j, longer in enumerate(np.searchsorted(-length[by], -np.arange(1, STEP)).tolist(), 1):
        got[:longer] += g.take(owner[start[:longer] + j], axis=0)
    place = np.empty(len(by), dtype=np.int64)
    place[by] = np.arange(len(by))
    out = got.take(place[head], axis=0)
    many = n > 1
    if many.any():
        out[many] = row_sums(got, place[np.repeat(many, n)], np.cumsum(n[many]) - n[many])
    return out


def gradients(g: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of weights that ``g``'s positions have, how many positions have each, and their sums of ``g``; some rows at a time.

    The row of all positions has one sum instead of a list. Rows go by the
    lengths of their lists, the longest first, so that the j-th ones of all
    lists are a slice; lists over STEP are counts times ``g``.
    """
    n = len(g)
    blocks = n // WIDE + 1
    g, own = np.zeros((blocks * WIDE, CLASSES), np.float32), g
    g[:n], g[n] = own, own.sum(axis=0)
    flat, owner = np.empty((FEATURES - 1) * n + 1, np.uint16), np.empty((FEATURES - 1) * n + 1, np.int64)  # numpy sorts uint16 by radix
    flat[:-1].reshape(-1, n)[:], owner[:-1].reshape(-1, n)[:] = rows.T[:-1], np.arange(n)
    flat[-1], owner[-1] = ALWAYS, n
    order = np.argsort(flat, kind="stable")
    ordered, owner = flat.take(order), owner.take(order)
    edge = np.ones(len(flat) + 1, dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=edge[1:-1])
    first = np.flatnonzero(edge)
    first, sizes = first[:-1], first[1:] - first[:-1]
    kept = np.minimum(sizes, STEP + 1)
    by = np.argsort((STEP + 1 - kept).astype(np.uint8), kind="stable")
    first, sizes = first.take(by), sizes.take(by)
    longer = (len(by) - np.cumsum(np.bincount(kept, minlength=STEP + 2))).tolist()
    long = longer[STEP]
    row = ordered.take(first).astype(np.int64)
    for a in range(0, len(by), BATCH):
        b = min(a + BATCH, len(by))
        total = g.take(owner.take(first[a:b]), axis=0)
        for j in range(1, STEP):
            if longer[j] <= max(a, long):
                break
            which = slice(max(a, long), min(b, longer[j]))
            total[which.start - a : which.stop - a] += g.take(owner.take(first[which] + j), axis=0)
        if a < long:
            n_long = min(b, long) - a
            n_listed = sizes[a : a + n_long]
            head = np.cumsum(n_listed) - n_listed
            listed = owner.take(np.arange(n_listed.sum()) + np.repeat(first[a : a + n_long] - head, n_listed))
            if n_long > WIDE // 2:
                total[:n_long] = row_sums(g, listed, head)
            else:
                cell = (listed // WIDE * n_long + np.repeat(np.arange(n_long), n_listed)) * WIDE + listed % WIDE
                often = np.bincount(cell, minlength=blocks * n_long * WIDE).astype(np.float32).reshape(blocks, n_long, WIDE)
                total[:n_long] = (often @ g.reshape(blocks, WIDE, CLASSES)).sum(axis=0)
        yield row[a:b], sizes[a:b] + (row[a:b] == ALWAYS) * (n - 1), total


def _trained(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run over the texts once, from the model's weights; yield blocks of rows of weights, times the positions that moved them."""
    weights = model.weights.copy()
    whole_rows = weights.view(np.dtype((np.void, weights.itemsize * CLASSES)))[:, 0]
    seen = np.zeros(ROWS, dtype=np.float32)
    for batch in batches:
        for p, q in slices(batch.column(0)):
            w = words(batch.column(0).slice(p, q - p))
            h = w.hashes()
            token, kind, word, offsets = sequences(w, h, model.classes(w, h))
            for part in parts(len(token)):
                rows, before = contexts(token, offsets, part)
                may_repeat = before != 0
                own = np.where(may_repeat & (token[part] == before) & (word[part] >= 0), REPEAT, kind[part])
                for at in range(0, len(part), BATCH):
                    i = slice(at, at + BATCH)
                    g = class_probabilities(weights, rows[i], may_repeat[i])
                    g[np.arange(len(g)), own[i]] -= 1
                    for row, n, total in gradients(g, rows[i]):
                        moved = seen.take(row) + n.astype(np.float32)
                        seen[row] = moved
                        total *= (np.float32(RATE) / np.sqrt(moved))[:, None]
                        np.subtract(weights.take(row, axis=0), total, out=total)
                        np.put(whole_rows, row, total.view(whole_rows.dtype)[:, 0])
    weights *= seen[:, None]
    for block in np.flatnonzero(seen.reshape(-1, BLOCK).any(axis=1)).tolist():
        part = slice(block * BLOCK, (block + 1) * BLOCK)
        yield _block(block, weights[part], seen[part])


def _block(block: int, weights: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([seen.astype(np.float64).tobytes()], pa.binary())], names=["block", "w", "seen"])


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights, seen = np.zeros((BLOCK, CLASSES)), np.zeros(BLOCK)
    for batch in batches:
        for w, n in zip(batch.column("w").to_pylist(), batch.column("seen").to_pylist(), strict=True):
            weights += np.frombuffer(w, dtype=np.float32).reshape(-1, CLASSES)
            seen += np.frombuffer(n)
    yield _block(key[0].as_py(), weights, seen)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all of ``texts`` (one column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

        for batch in batches:
            for a, b in slices(batch.column(0)):
                w = words(batch.column(0).slice(a, b - a))
                ends = np.concatenate(([0], np.cumsum(w.end - w.begin))).astype(np.int32)
                place = np.arange(ends[-1]) + np.repeat(w.begin - ends[:-1], w.end - w.begin)
                counted = pa.StringArray.from_buffers(len(w.begin), pa.py_buffer(ends), pa.py_buffer(w.data[place])).value_counts()
                parts.append(pa.table({"word": counted.field(0), "n": counted.field(1)}))
                if sum(map(len, parts[1:])) > 1 << 20:
                    parts[:] = [summed()]
                    if len(parts[0]) > 1 << 20:  # what a task holds stays bounded
                        yield from parts.pop().to_batches(100_000)
        if parts:
            yield from summed().to_batches(100_000)

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def suffix_counts(texts: DataFrame, singles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over all ``texts`` (one column): how often each suffix has each single up to NEAR words before it, and occurs."""
    order = np.argsort(singles)
    sought, columns = singles[order], len(singles) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SUFFIXES * columns, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                w = words(batch.column(0).slice(a, b - a))
                h, end = w.hashes(), suffixes(w)
                seen += np.bincount(end * columns + columns - 1, minlength=len(seen))
                j = np.minimum(np.searchsorted(sought, h), columns - 2)
                at = np.flatnonzero(sought[j] == h)
                limit = w.of_text[np.searchsorted(w.of_text, at, side="right")]
                for back in range(1, NEAR + 1):
                    inside = at + back < limit
                    seen += np.bincount(end[at[inside] + back] * columns + order[j[at[inside]]], minlength=len(seen))
        cell = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(seen[cell])], names=["cell", "n"])

    out = np.zeros(SUFFIXES * columns)
    if len(singles):
        summed = texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    out = out.reshape(SUFFIXES, columns)
    return out[:, :-1], out[:, -1]


def _buckets(seen: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """A bucket for every suffix: suffixes that follow the same frequent words go together (a few rounds of k-means)."""
    out = np.arange(SUFFIXES) % BUCKETS + SINGLES
    if not mass.any():
        return out
    common = np.argsort(-mass, kind="stable")[:512]
    share = seen[common] + seen.sum(axis=0) / max(1, seen.sum()) * 4
    share = np.sqrt(share / np.maximum(share.sum(axis=1, keepdims=True), 1e-9))
    centre = share[:BUCKETS].copy()
    for _ in range(12):
        near = (share @ centre.T).argmax(axis=1)
        for k in range(len(centre)):
            if (near == k).any():
                centre[k] = (share[near == k] * mass[common][near == k][:, None]).sum(axis=0)
                centre[k] /= max(1e-9, np.linalg.norm(centre[k]))
    out[common] = near % BUCKETS + SINGLES
    return out


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all ``texts`` (one string column), and the table of counts (word, n).

    Texts that repeat count as often; very long ones go by parts; without texts
    every word is unknown and every class as likely.
    """
    spark = texts.sparkSession
    small_batches(spark)
    counts = staged(word_counts(texts), "counts")
    n_docs = texts.count()
    least = least_count(counts.filter(F.octet_length("word") <= FREQUENT_BYTES), FREQUENT)
    held = counts.filter((F.col("n") >= least) & (F.octet_length("word") <= FREQUENT_BYTES)).toArrow()
    joined = pa.array([" ".join(held["word"].to_pylist())], pa.string())
    h, n = words(joined).hashes(), held["n"].to_numpy()
    order = np.argsort(h)
    singles = h[np.lexsort((h, -n))[:SINGLES]]
    name = texts.columns[0]
    model = Model(h[order], n[order], singles, _buckets(*suffix_counts(texts, singles)), np.zeros((ROWS, CLASSES), dtype=np.float32), docs=n_docs)
    drawn = spark.sparkContext.broadcast(model)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                w = words(batch.column(0).slice(a, b - a))
                cls = drawn.value.classes(w, w.hashes())
                np.add.at(tokens, cls, batch.column(1).slice(a, b - a).to_numpy())
                np.add.at(distinct, cls, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(tokens), pa.array(distinct)], names=["cls", "tokens", "words"])

    sums = counts.select("word", "n").mapInArrow(by_class, "cls long, tokens long, words long").groupBy("cls").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        tokens[r["cls"]], distinct[r["cls"]] = r["tokens"], r["words"]
    model = replace(model, total=int(tokens.sum()) + n_docs, distinct=int(distinct.sum()) + (n_docs > 0), class_tokens=tokens, class_words=distinct)

    for k in range(ROUNDS):
        now = spark.sparkContext.broadcast(model)
        part = texts.filter(F.pmod(F.xxhash64(name, F.lit("round")), F.lit(ROUNDS)) == k)
        blocks = "block long, w binary, seen binary"
        moved = part.mapInArrow(lambda batches, now=now: _trained(now.value, batches), blocks).withColumn("part", F.spark_partition_id() % 32)
        # Weights are averaged by the positions that moved them; partial sums first.
        summed = moved.groupBy("block", "part").applyInArrow(_added, blocks).groupBy("block").applyInArrow(_added, blocks).toArrow()
        weights = model.weights.copy()
        for r in summed.to_pylist():
            rows, seen = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK), np.frombuffer(r["seen"])
            mean = np.frombuffer(r["w"], dtype=np.float32).reshape(-1, CLASSES) / np.maximum(seen, 1)[:, None]
            weights[rows] = np.where(seen[:, None] > 0, mean, weights[rows])
        model = replace(model, weights=weights)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, base_score, score (log10 probabilities of the whole text and its end).

    Words are runs of anything but ASCII white space, A-Z lower-cased. Null and
    empty texts are their end alone. Rows that repeat stay apart; further
    columns are ignored; an empty table stays empty. With nothing to learn from,
    every word is unknown. A very long text goes by parts.
    """
    small_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), *[F.xxhash64(F.lit(s), F.col(id_col), text).alias(f"k{s}") for s in (1, 2)])
    held = docs.sparkSession.sparkContext.broadcast(model)
    frequent = F.lit(int(model.counts.min()) if len(model.counts) else 1 << 62)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                w = words(part.column(1))
                h = w.hashes()
                place = m.find(h)
                known = place >= 0
                count = np.where(known, m.counts[place] if len(m.counts) else 0, 0)
                cls = m.classes(w, h)
                token, kind, word, offsets = sequences(w, h, cls)
                before = preceding(token, offsets)
                repeats = before != 0
                p_class, p_repeat = np.empty(len(token)), np.zeros(len(token))
                for positions in parts(len(token)):
                    context, _ = contexts(token, offsets, positions)
                    for at in range(0, len(positions), BATCH):
                        i = positions[at : at + BATCH]
                        p, total = exponentials(m.weights, context[at : at + BATCH], repeats[i])
                        p_class[i] = p[np.arange(len(p)), kind[i]] / total
                        p_repeat[i] = p[:, REPEAT] / total
                base, own = np.zeros(len(token)), np.log10(np.maximum(p_class, 1e-300))
                is_word = word >= 0
                in_table = np.zeros(len(token), dtype=bool)
                in_table[is_word] = known[word[is_word]]
                base[in_table] = m.base(count[word[in_table]])
                own[in_table] += m.inside(count[word[in_table]], kind[in_table])
                again = in_table & repeats & (token == before)
                own[again] = np.log10(10.0 ** own[again] + p_repeat[again])
                base[~is_word] = m.base(np.array(float(m.docs)))
                n_known = np.add.reduceat(in_table.astype(np.int64), offsets[:-1]) + (m.docs > 0)

                # Words that aren't looked up, each once a text; a text that has none gets a word that no table has.
                which = np.flatnonzero(~known)
                of = np.searchsorted(w.of_text, which, side="right") - 1
                order = np.lexsort((h[which], of))
                which, of = which[order], of[order]
                # Where such a word follows itself, "repeat" adds to its share, which isn't known here: how much more likely "repeat" is than the class, as log10.
                again = np.flatnonzero((word[which + of] >= 0) & (token[which + of] == before[which + of]))
                at = (which + of)[again]
                odds = np.log10(np.maximum(p_repeat[at], 1e-300)) - np.log10(np.maximum(p_class[at], 1e-300))
                new = np.ones(len(which), dtype=bool)
                new[1:] = (of[1:] != of[:-1]) | (h[which[1:]] != h[which[:-1]])
                first = np.flatnonzero(new)
                without = np.setdiff1d(np.arange(len(part)), of)
                times = np.concatenate((np.diff(np.append(first, len(which))), np.zeros(len(without), np.int64)))
                place = np.concatenate((np.searchsorted(again, np.append(first, len(order))), np.full(len(without), len(again))))
                which, of = which[first], np.concatenate((of[first], without))
                size = w.end[which] - w.begin[which]
                spans = np.concatenate(([0], np.cumsum(size)))
                text = w.data[np.arange(spans[-1]) + np.repeat(w.begin[which] - spans[:-1], size)]
                each = pa.StringArray.from_buffers(len(which), pa.py_buffer(spans.astype(np.int32)), pa.py_buffer(text))
                each = pa.concat_arrays([each, pa.array([f" {k}" for k in part.column(2).take(pa.array(without)).to_pylist()], pa.string())])
                lead = np.ones(len(of), dtype=bool)  # the row that has the text's own sums
                lead[1:] = of[1:] != of[:-1]
                owner = pa.array(of)
                sums = [np.where(lead, x[of], 0) for x in (np.diff(offsets), n_known, np.add.reduceat(base, offsets[:-1]), np.add.reduceat(own, offsets[:-1]))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of, mask=~lead)), part.column(2).take(owner), part.column(3).take(owner), each, pa.array(times.astype(np.int32)), pa.array(np.concatenate((cls[which], np.zeros(len(without), np.int64))).astype(np.int32)), pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(odds)), pa.array(lead.astype(np.int32)), *map(pa.array, sums)],
                    names=["id", "k1", "k2", "word", "times", "cls", "odds", "lead", "n_tokens", "n_known", "base", "own"],
                )

    found = rows.select("id", "t", "k1", "k2").mapInArrow(scan, f"id {id_type}, k1 long, k2 long, word string, times int, cls int, odds array<double>, lead int, n_tokens long, n_known long, base double, own double")
    joined = found.join(counts.filter((F.col("n") < frequent) | (F.octet_length("word") > FREQUENT_BYTES)), "word", "left")
    c = F.coalesce("n", F.lit(0)) + F.lit(SMOOTH)
    shares = [float(t + SMOOTH * (d + 1)) for t, d in zip(model.class_tokens, model.class_words, strict=True)]
    share = F.element_at(F.array(*[F.lit(x) for x in shares]), F.col("cls") + 1)
    whole = F.lit(float(model.total + SMOOTH * (model.distinct + 1)))
    many: Column = (F.col("cls") >= SINGLES) & (F.col("cls") < END)
    inside = F.when(many, F.log10(c / share)).otherwise(0.0)

    def plus(total: Column, odds: Column) -> Column:
        """Adds log10(1 + 10^x), where x is how much more likely "repeat" is than the class and the word in it."""
        x = odds - F.col("inside")
        return total + F.when(x > 30, x).otherwise(F.log10(1 + F.pow(F.lit(10.0), x)))

    # A row that occurs so many times has all its words as often. Unknown words are counted, so that as many of them add the same, in any order.
    is_known = F.col("n").isNotNull()
    unknown = F.sum(F.when(is_known, 0).otherwise(F.col("times"))) * F.log10(F.lit(SMOOTH) / whole)
    each = joined.withColumn("inside", inside).groupBy("k1", "k2").agg(
        F.first("id", ignorenulls=True).alias("id"), F.sum("lead").alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(is_known, F.col("times")).otherwise(0)).alias("n_known"),
        (F.sum(F.col("base") + F.when(is_known, F.col("times") * F.log10(c / whole)).otherwise(0.0)) + unknown).alias("base"), F.sum(F.col("own") + F.col("times") * F.col("inside") + F.aggregate("odds", F.lit(0.0), plus)).alias("own"),
    )
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias(id_col), *[(F.col(x) / F.col("copies")).cast("long").alias(x) for x in ("n_tokens", "n_known")],
        (F.col("base") / F.col("copies")).alias("base_score"), (F.col("own") / F.col("copies")).alias("score"),
    )
