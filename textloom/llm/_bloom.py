"""Bloom filters over 64-bit hashes, built where the rows are and merged in blocks.

A filter has a power of two of bits, MAX_BITS at most, which bounds what is
sent to the driver and to the executors at MAX_BITS / 8 bytes. Beyond its
comfortable load a filter only lets more through; whoever uses one confirms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._numpy import U64

HASHES = 2
MIN_BITS, MAX_BITS = 1 << 16, 1 << 30
#: Filters are sent in blocks of so many bits; a task writes its hashes out when it has so many.
BLOCK_BITS, HELD = 1 << 16, 1 << 21


def bits_for(n: int, per_item: int = 16) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (max(1, n * per_item) - 1).bit_length()))


def places(h: Column, bits: int) -> list[Column]:
    """The bits of a hash: its low end, and its high end."""
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 64 - (bits.bit_length() - 1))]


def gathered(items: DataFrame, bits: int) -> np.ndarray:
    """The filter of what ``items`` (h long) has."""
    seen = items.select(F.explode(F.array(*places(F.col("h"), bits))).alias("bit"))
    words = seen.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    out = np.zeros(bits // 64, dtype=U64)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["mask"].to_numpy().view(U64)
    return out


def _marked(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of the hashes, ascending and distinct."""
    return np.unique(np.concatenate((hashes & U64(bits - 1), hashes >> U64(64 - (bits.bit_length() - 1))))).astype(np.int64)


def _packed(bits: np.ndarray) -> bytes:
    """A block's bits (places in it), as a compressed bitmap."""
    block = np.zeros(BLOCK_BITS, dtype=bool)
    block[bits] = True
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(block, bitorder="little").tobytes())


def _bitmap(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=U64)


def twice_seen(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """The filter of the hashes that ``rows`` has twice or more, by way of a filter of those it has once or more.

    ``hashes`` gives what of a batch is to be counted. Every task fills both
    filters for its own rows and sends their blocks, compressed; no hash moves.
    Of two tasks' filters the once-seen bits are or-ed, and so are the
    twice-seen ones, to which the bits that both have once are added. So every
    hash that is seen twice anywhere has its bits in the second filter.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def filters() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            once, twice = _marked(values, bits), _marked(values[n > 1], bits)
            block, first = np.unique(once // BLOCK_BITS, return_index=True)
            ends, at = np.append(first, len(once)), np.searchsorted(twice, np.append(block, bits) * BLOCK_BITS)
            pack = lambda x: _packed(x % BLOCK_BITS)
            return pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array([pack(once[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.array([pack(twice[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                names=["block", "once", "twice"],
            )

        for batch in batches:
            for h in hashes(batch):
                held.append(h)
                if sum(map(len, held)) > HELD:
                    yield filters()
                    held.clear()
        if sum(map(len, held)):
            yield filters()

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(BLOCK_BITS // 64, U64), np.zeros(BLOCK_BITS // 64, U64)
        for batch in batches:
            for a, b in zip(batch.column("once"), batch.column("twice"), strict=True):
                more = _bitmap(a.as_py())
                twice |= once & more
                once |= more
                if b.is_valid:
                    twice |= _bitmap(b.as_py())
        zstd = zstandard.ZstdCompressor(level=1)
        packed = [pa.array([zstd.compress(x.tobytes()) if x.any() else None], pa.binary()) for x in (once, twice)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), *packed], names=["block", "once", "twice"])

    schema = "block long, once binary, twice binary"
    parts = rows.mapInArrow(blocks, schema).withColumn("part", F.spark_partition_id() % 32)
    whole = parts.groupBy("block", "part").applyInArrow(merged, schema).groupBy("block").applyInArrow(merged, schema)
    out = np.zeros(bits // 64, dtype=U64)
    got = whole.filter("twice is not null").select("block", "twice").toArrow()
    for block, packed in zip(got["block"].to_pylist(), got["twice"], strict=True):
        out[block * (BLOCK_BITS // 64) :][: BLOCK_BITS // 64] = _bitmap(packed.as_py())
    return out


def maybe(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False where a hash is surely not in the filter."""
    bits = len(words) * 64
    out = np.ones(len(hashes), dtype=bool)
    for place in (hashes & U64(bits - 1), hashes >> U64(64 - (bits.bit_length() - 1))):
        out &= (words[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == 1
    return out
