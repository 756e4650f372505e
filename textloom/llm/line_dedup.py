"""Lines that many documents share, found with two Bloom filters and confirmed exactly.

The first filter has the bits of keys seen once, the second those of keys seen
twice; both are filled where the lines are and merged in blocks, so no hash is
shuffled. Only lines that the second may hold move, as text, to be confirmed;
of whole texts only those move that may lose a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bloom import bits_for, gathered, maybe, twice_seen
from ._numpy import U64, Lines, lines, slices, span_hashes
from ._spark import small_batches, staged, text_of

MIN_CHARS, MIN_DOCS = 40, 5


def _keyed(texts: pa.Array, min_chars: int) -> tuple[Lines, np.ndarray, np.ndarray]:
    """The texts' lines, which of them have keys that count, and these keys' hashes."""
    found = lines(texts)
    which = np.flatnonzero(found.chars >= max(1, min_chars))
    return found, which, span_hashes(found.data, found.key_begin[which], found.key_end[which])


def _texts(batch: pa.RecordBatch, i: int) -> Iterator[tuple[int, int, pa.Array]]:
    column = batch.column(i)
    for a, b in slices(column):
        yield a, b, column.slice(a, b - a)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text_col`` rid of shared lines, and n_lines and n_dropped added.

    A line's key is the line, stripped of ASCII white space, with A-Z
    lower-cased. A key of ``min_chars`` code points or more that stands in
    ``min_docs`` rows or more loses all its lines except those in the largest
    id that has it. Texts split at line feeds only; null and empty texts have
    one empty line, and come back empty. A key that repeats within a row counts
    once for it; rows that share an id count apart, and keep alike. Further
    columns pass unchanged, even if they are named n_lines or n_dropped: these
    are then replaced.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*[text_of(text_col).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in columns])
    id_type = dict(docs.dtypes)[id_col]

    # No text has more keys than lines, or than min_chars goes into its bytes.
    text = F.col(f"`{text_col}`")
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")  # on bytes; translate goes by characters
    most = rows.agg(F.sum(F.least(n_lines, F.octet_length(text) / max(1, min_chars)))).first()[0]

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, texts in _texts(batch, 0):
            found, which, h = _keyed(texts, min_chars)
            of = np.searchsorted(found.of_text, which, side="right")
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            first = np.ones(len(h), dtype=bool)  # a key that repeats within a row counts once
            first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            yield h[first]

    repeated = docs.sparkSession.sparkContext.broadcast(twice_seen(rows.select(text_col), keys, bits_for(int(most or 0))))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _texts(batch, 1):
                found, which, h = _keyed(texts, min_chars)
                hit = maybe(repeated.value, h)
                which, h = which[hit], h[hit]
                of = np.searchsorted(found.of_text, which, side="right") - 1
                order = np.lexsort((which, h, of))
                which, h, of = which[order], h[order], of[order]
                # The lines of one document that share a hash: those of the first one's very text are one key.
                groups: dict[tuple[int, bytes], list[int]] = {}
                data = found.data.tobytes()
                for d, line, s, e in zip(of.tolist(), which.tolist(), found.key_begin[which].tolist(), found.key_end[which].tolist(), strict=True):
                    groups.setdefault((d, data[s:e]), []).append(line - int(found.of_text[d]))
                at = [d for d, _ in groups]
                sizes = np.fromiter(map(len, groups.values()), dtype=np.int64, count=len(groups))
                flat = np.fromiter((x for g in groups.values() for x in g), dtype=np.int32, count=int(sizes.sum()))
                places = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
                ids = batch.column(0).slice(a, b - a).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([k for _, k in groups], pa.binary()).cast(pa.string()), places], names=["id", "key", "places"])

    found = rows.select(F.col(id_col).alias("id"), text_col).mapInArrow(suspects, f"id {id_type}, key string, places array<int>")
    found = staged(found, "suspects")
    shared = staged(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep")).filter(F.col("n") >= min_docs).select("key", "keep"), "shared")
    # Rows that share an id have the same losses or none, by key; the text itself says which lines they are.
    losses = staged(found.join(shared, "key").filter("id < keep").groupBy("id").agg(F.collect_list(F.struct("key", "places")).alias("__losses")), "losses")
    losers = docs.sparkSession.sparkContext.broadcast(gathered(losses.select(F.xxhash64("id").alias("h")), bits_for(losses.count())))

    kept_fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in columns)
    place = columns.index(text_col)

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = maybe(losers.value, batch.column(len(columns)).to_numpy().view(U64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(may)], names=[*columns, "__may"])

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dropped = [], []
            for text, lost in zip(batch.column(place).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True):
                own = text.split("\n")
                keys = {x["key"] for x in lost or ()}
                out = {i for x in lost or () for i in x["places"] if i < len(own) and _key(own[i]) in keys}
                texts.append("\n".join(x for i, x in enumerate(own) if i not in out))
                dropped.append(len(out))
            arrays = [*batch.columns[: len(columns) + 1], pa.array(dropped, pa.int64())]
            arrays[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "n_lines", "n_dropped"])

    split = rows.withColumn("__hash", F.xxhash64(F.col(f"`{id_col}`"))).mapInArrow(flagged, f"{kept_fields}, __may boolean").withColumn("n_lines", n_lines)
    clean = split.filter("not __may").drop("__may").withColumn("n_dropped", F.lit(0).cast("long"))
    moved = split.filter("__may").drop("__may").join(losses.withColumnRenamed("id", "__id"), F.col(f"`{id_col}`") == F.col("__id"), "left").select(*[F.col(f"`{c}`") for c in columns], "n_lines", "__losses")
    return clean.unionByName(moved.mapInArrow(without, f"{kept_fields}, n_lines long, n_dropped long"))


_STRIP = " \t\n\v\f\r"
_FOLD = {c: c + 32 for c in range(65, 91)}


def _key(line: str) -> str:
    return line.strip(_STRIP).translate(_FOLD)
