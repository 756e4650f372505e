"""Byte-level BPE through a table of distinct words.

Texts are split into words where they are read. A slice, some megabytes of
texts, keeps its texts as numbers of its own distinct words and sends these to
the table of distinct words, in buckets by hash: all equal words meet there,
each is encoded once, and its ids go back to every slice that sent it, where
they are joined to the texts by position. Decoding joins ids with the
id-to-piece table, which is no larger than the vocabulary and so is broadcast,
as an array with the id as its key.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._numpy import PIECE, give_back, lean, raw, slices, span_hashes
from ._spark import small_batches, text_of

#: Texts of about so many bytes share a list of distinct words; a longer text has one of its own.
SLICE_TEXT = 8 << 20
#: There is a bucket of the table for so many bytes of text, whose distinct words are some fifth of that in all slices together, but so many at least.
BUCKET_TEXT, BUCKETS = 128 << 20, 64
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CONTRACTIONS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")


class Tokenizer:
    """A byte-level BPE of the ``tokenizers`` library, read from its file's text."""

    def __init__(self, text: str):
        self.text = text
        spec = json.loads(text)
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
            raise ValueError("only plain byte-level BPE without normalisation is supported")
        self.added = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' bytes and where each id's begin; ids without a piece have none."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in byte_of.values())}
        table = [b""] * (max(self.vocab.values()) + 1)
        for piece, i in self.vocab.items():
            table[i] = piece.encode() if piece in self.added else bytes(byte_of[c] for c in piece)
        sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table))
        return np.frombuffer(b"".join(table), dtype=np.uint8), np.concatenate(([0], np.cumsum(sizes)))

    def load(self):
        """The library's tokenizer, which all copies of this one in a process share."""
        return _library(self.text)


@lru_cache(maxsize=1)
def _library(text: str):
    """One for each process, not for each bucket: of every one that has encoded something, the library keeps a MB or more after its end."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    made = tokenizers.Tokenizer.from_str(text)
    made.no_truncation()
    made.no_padding()
    return made


def char_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            out[cp] = _LETTER if kind == "L" else _NUMBER
    out[_WHITE] = _SPACE
    return out


def _chars(data: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters of valid UTF-8 begin, and their classes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    head = data[at]
    kind = classes[head]
    for low, high, size, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        which = np.flatnonzero((head >= low) & (head < high))
        cp = (head[which] & mask).astype(np.int64)
        for j in range(1, size):
            cp = (cp << 6) | (data[at[which] + j] & 0x3F)
        kind[which] = classes[cp]
    return at, kind


def word_starts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words begin in the texts ``data[offsets[i]:offsets[i + 1]]``; a word ends where the next one begins.

    Goes by pieces of about PIECE bytes, cut before a space between two ASCII letters.
    """
    cuts = [0]
    while len(data) - cuts[-1] > PIECE:
        at = cuts[-1] + PIECE
        window = data[at - 1 : at + (1 << 16)]
        letter = (window | 32) - 97 < 26
        fits = np.flatnonzero(letter[:-2] & (window[1:-1] == 32) & letter[2:])
        if not len(fits):
            break  # the rest in one piece
        cuts.append(at + int(fits[0]))
    found = [_starts(data[a:b], np.append(0, offsets[(offsets > a) & (offsets < b)] - a), classes) + a for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
    return np.concatenate(found)


def _starts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words begin in one piece.

    Words are maximal runs of letters, of numbers, of white space, or of
    anything else. A space before a run of another kind belongs to it; of white
    space before such a run the last character is a word of its own, if it is
    no space; and an apostrophe that begins a word takes a contraction's letters.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    at, kind = _chars(data, classes)
    n = len(at)
    head = np.zeros(n + 1, dtype=bool)  # a text begins
    head[np.searchsorted(at, offsets[offsets < len(data)])] = True
    head[n] = True
    run = head[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = data[at] == 32
    white = kind == _SPACE
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = blank[:-1] & ~head[1:n]
    start = run.copy()
    led = run & ~white & after_blank  # takes the space before it
    start[led] = False
    start[np.flatnonzero(led) - 1] = True
    ends = np.flatnonzero(white[:-1] & run[1:] & ~head[1:n]) if n > 1 else np.zeros(0, np.int64)
    start[ends[~blank[ends]]] = True  # the last white space before something else

    lone = np.flatnonzero(run & (data[at] == 39) & ~after_blank)
    lone = lone[(lone + 1 < n)]
    lone = lone[run[lone + 1] & ~head[lone + 1] & (kind[lone + 1] == _LETTER)]
    padded = np.concatenate((data, np.zeros(4, np.uint8)))
    for short in _CONTRACTIONS:
        fits = np.ones(len(lone), dtype=bool)
        for j, byte in enumerate(short):
            fits &= padded[at[lone] + j] == byte
        i = lone[fits]
        end = i + len(short)
        # All its letters are ASCII and in this text: no text begins among them.
        for j in range(2, len(short)):
            inside = ~head[np.minimum(i + j, n)]
            i, end = i[inside], end[inside]
        start[i + 1] = False
        start[end[end < n]] = start[end[end < n]] | ~white[end[end < n]] | head[end[end < n]]
    return at[start]


def _words(texts: pa.Array, classes: np.ndarray, added: list[str]) -> tuple[np.ndarray, pa.Array]:
    """All words of the texts as one array, and the offsets of each text's."""
    special = [a for a in added if pc.any(pc.match_substring(texts, a)).as_py()]
    if not special:
        data, offsets = raw(texts)
        starts = word_starts(data, offsets, classes)
        ends = np.append(starts, len(data)).astype(np.int32)
        return np.searchsorted(starts, offsets), pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
    parts, owner = [], []
    for i, text in enumerate(texts.to_pylist()):
        for part in cut.split(text):
            if part:
                parts.append(part)
                owner.append(i)
    data, offsets = raw(pa.array(parts, pa.string()))
    starts = word_starts(data, offsets, classes)
    part_of = np.searchsorted(offsets, starts, side="right") - 1
    whole = np.array([p in special for p in parts], dtype=bool)
    starts = starts[~whole[part_of] | (starts == offsets[part_of])]
    of = np.searchsorted(starts, offsets)
    first = np.searchsorted(np.array(owner, dtype=np.int64), np.arange(len(texts) + 1))
    ends = np.append(starts, len(data)).astype(np.int32)
    return of[first], pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def _flat(batch: pa.RecordBatch, place: int, classes: np.ndarray, added: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Slices of a batch, the offsets of their texts' words, and all words as one array."""
    for a, b in slices(batch.column(place)):
        rows = batch.slice(a, b - a)
        yield rows, *_words(rows.column(place), classes, added)


def ragged(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The entries ``index`` of a ragged table, one behind the other."""
    sizes = offsets[index + 1] - offsets[index]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(offsets[index] - (ends - sizes), sizes)]


def _ids_of(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one behind the other, and how many each word has."""
    ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(words), 2_000):
        part = words[at : at + 2_000]
        got = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
        ids.append(np.array(got.ids, dtype=np.int32))
        sizes.append(np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(part)))
    return np.concatenate(ids), np.concatenate(sizes)


def _texts_of(pieces: tuple[np.ndarray, np.ndarray], ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The texts of several lists of ids, which lie one behind the other; ids without a piece are left out."""
    flat, offsets = pieces
    known = (ids >= 0) & (ids < len(offsets) - 1)
    if not known.all():
        bounds = np.concatenate(([0], np.cumsum(known)))[bounds]
        ids = ids[known]
    ids = ids.astype(np.int64)
    raw_bytes = ragged(flat, offsets, ids).tobytes()
    ends = np.concatenate(([0], np.cumsum(offsets[ids + 1] - offsets[ids])))[bounds].tolist()
    return [raw_bytes[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _zipped(x: np.ndarray) -> bytes:
    """Numbers as a compressed string, the low bytes of all first."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _word_hashes(words: pa.Array) -> np.ndarray:
    data, offsets = raw(words)
    return span_hashes(data, offsets[:-1], offsets[1:])  # no word is empty


def _print_of(words: pa.Array) -> int:
    """31 bits that tell lists of words apart."""
    h = _word_hashes(words)
    return int((h * (np.arange(len(h), dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum() >> np.uint64(33))


def _listed(words: pa.Array) -> bytes:
    """Words as a compressed string, their lengths before them."""
    data, offsets = raw(words)
    lengths = np.diff(offsets).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(lengths)], "<u4").tobytes() + lengths.tobytes() + data.tobytes())


def _unlisted(x: bytes) -> pa.Array:
    plain = zstandard.ZstdDecompressor().decompress(x)
    n = int(np.frombuffer(plain, "<u4", count=1)[0])
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(plain, "<u4", count=n, offset=4)))).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(plain[4 + 4 * n :]))


def _unzipped(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def encode(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>) instead of its text, and in place of one of that name.

    With ``decoded``, a column of that name has what ``decode`` makes of the
    ids, in the same pass over them.

    The ids are those that the library gives for the whole text without adding
    special tokens; added tokens that stand in a text count as such. Null and
    empty texts have no ids. Rows that repeat stay apart, further columns pass
    unchanged, and an empty table stays empty. A very long text is a slice of
    its own, whose words are split piece by piece.

    Slices follow the order in which rows are read, and their exchange feeds
    both the table and the texts. Should rows be read again in another order,
    after the loss of an executor, slices no longer fit their words: that is
    an error, never a wrong result. Tables on disk are read in one order.
    """
    spark = docs.sparkSession
    small_batches(spark)
    types = dict(docs.dtypes)
    others = [c for c in docs.columns if c not in ("ids", decoded, text_col)]
    own = [f"__c{i}" for i in range(len(others))]
    classes = spark.sparkContext.broadcast(char_classes())
    pieces = spark.sparkContext.broadcast(tokenizer.pieces()) if decoded else None
    texts = docs.select(text_of(text_col).alias("__text"), *[F.col(f"`{c}`").alias(o) for c, o in zip(others, own, strict=True)])
    size = texts.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    buckets = max(BUCKETS, -(-size // BUCKET_TEXT))
    names = ["__slice", "__row", *own, "__n", "__codes", "__bucket", "__numbers", "__words"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts with the numbers of their words, and for every bucket a row of the slice's words and their numbers."""
        number = TaskContext.get().partitionId() << 32
        rows, ends, words, size = [], [], [], 0

        def slice_of() -> Iterator[pa.RecordBatch]:
            known = pa.concat_arrays(words).dictionary_encode()
            code = known.indices.to_numpy()
            order = np.argsort(-np.bincount(code, minlength=len(known.dictionary)), kind="stable")  # frequent words have small numbers
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            row = at = 0
            for part, end in zip(rows, ends, strict=True):
                n, total = len(end) - 1, int(end[-1])
                codes = [_zipped(rank[code[at : at + total]]), *[None] * (n - 1)]
                at += total
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), pa.array(np.arange(row, row + n, dtype=np.int32)), *part, pa.array(np.diff(end).astype(np.int32)), pa.array(codes, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names,
                )
                row += n
            each = known.dictionary
            bucket = (_word_hashes(each) % np.uint64(buckets)).astype(np.int32)
            by = pc.sort_indices(pa.table({"bucket": bucket, "word": each}), sort_keys=[("bucket", "ascending"), ("word", "ascending")]).to_numpy()
            to, first = np.unique(bucket[by], return_index=True)
            for b, i, j in zip(to.tolist(), first.tolist(), np.append(first, len(by))[1:].tolist(), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.nulls(1, pa.int32()), *[pa.nulls(1, x.type) for x in rows[0]], pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([b], pa.int32()), pa.array([_zipped(rank[by[i:j]])], pa.binary()), pa.array([_listed(each.take(pa.array(by[i:j])))], pa.binary())], names=names,
                )

        for batch in batches:
            for part, end, found in _flat(batch, 0, classes.value, tokenizer.added):
                rows.append(part.columns[1:])
                ends.append(end)
                words.append(found)
                size += part.column(0).nbytes
                if size >= SLICE_TEXT:
                    yield from slice_of()
                    rows, ends, words, size = [], [], [], 0
                    number += 1
                    give_back()
        if rows:
            yield from slice_of()
        rows, ends, words = [], [], []
        give_back()

    sliced = texts.mapInArrow(split, ", ".join(["__slice long, __row int", *[f"{o} {types[c]}" for c, o in zip(others, own, strict=True)], "__n int, __codes binary, __bucket int, __numbers binary, __words binary"]))

    def sent(slice_: pa.Table) -> pa.Table:
        return slice_.filter(pc.is_valid(slice_["__bucket"])).select(["__bucket", "__slice", "__words"])

    def table(bucket: pa.Table) -> pa.Table:
        """A bucket of the table: each different word is encoded once, and its ids are handed to all slices that sent it."""
        lists = [_unlisted(x.as_py()) for x in bucket["__words"]]
        known = pa.concat_arrays(lists).dictionary_encode()
        ids, sizes = _ids_of(tokenizer.load(), known.dictionary.to_pylist())
        offsets, place = np.concatenate(([0], np.cumsum(sizes))), known.indices.to_numpy()
        out, at = [], 0
        for words in lists:
            own = place[at : at + len(words)]
            at += len(words)
            out.append(_zipped(np.concatenate(([len(own), _print_of(words)], sizes[own], ragged(ids, offsets, own)))))
        return pa.table({"__slice": bucket["__slice"], "__bucket": bucket["__bucket"], "__ids": pa.array(out, pa.binary())})

    words = sliced.groupBy("__slice").applyInArrow(sent, "__bucket int, __slice long, __words binary")
    encoded = words.groupBy("__bucket").applyInArrow(lambda bucket: lean(table)(bucket), "__slice long, __bucket int, __ids binary")

    def assemble(slice_: pa.Table, encoded: pa.Table) -> pa.Table:
        """A slice: its words' ids by their numbers, then its texts, a few at a time."""
        ids_of = {b: _unzipped(x.as_py()) for b, x in zip(encoded["__bucket"].to_pylist(), encoded["__ids"], strict=True)}
        number, sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        lists = slice_.filter(pc.is_valid(slice_["__bucket"])).select(["__bucket", "__numbers", "__words"])
        for b, numbers, packed in zip(*(lists[c] for c in lists.column_names), strict=True):
            x, n = ids_of.pop(b.as_py(), np.zeros(2, np.int64)), _unzipped(numbers.as_py())
            if len(n) != x[0] or _print_of(_unlisted(packed.as_py())) != x[1]:
                raise RuntimeError("a slice's words are not those that were encoded: its rows were read again in another order")
            number.append(n)
            sizes.append(x[2 : len(n) + 2])
            ids.append(x[len(n) + 2 :])
        number, sizes, ids = np.concatenate(number), np.concatenate(sizes), np.concatenate(ids).astype(np.int32)
        place = np.empty(len(number), dtype=np.int64)
        place[number] = np.arange(len(number))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        rows = slice_.filter(pc.is_valid(slice_["__row"])).sort_by("__row")
        packed = rows["__codes"].combine_chunks()
        heads = np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False))
        per_row = rows["__n"].to_numpy()
        done = []
        for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(rows)], strict=True):
            word = place[_unzipped(packed[i].as_py())]
            ends = np.concatenate(([0], np.cumsum(offsets[word + 1] - offsets[word])))
            bounds = ends[np.concatenate(([0], np.cumsum(per_row[i:j])))]
            got = ragged(ids, offsets, word)
            made = [*[rows[o].slice(i, j - i) for o in own], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(got))]
            if decoded:
                made.append(pa.array(_texts_of(pieces.value, got, bounds), pa.string()))
            done.append(pa.table(made, names=[*others, "ids", *([decoded] if decoded else [])]))
        return pa.concat_tables(done)

    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c in others] + ["ids array<int>"] + ([f"`{decoded}` string"] if decoded else []))
    return sliced.groupBy("__slice").cogroup(encoded.groupBy("__slice")).applyInArrow(lambda slice_, encoded: lean(assemble)(slice_, encoded), schema)


def decode(encoded: DataFrame, tokenizer: Tokenizer, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids added (in place of a column of that name).

    Special tokens are written out; ids that the vocabulary lacks have no
    piece; bytes that are no UTF-8 become U+FFFD; null ids give the empty text.
    """
    small_batches(encoded.sparkSession)
    pieces = encoded.sparkSession.sparkContext.broadcast(tokenizer.pieces())
    columns = [c for c in encoded.columns if c != text_col]
    place = columns.index(ids_col)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            lists = batch.column(place)
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            texts = _texts_of(pieces.value, lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, text_col])

    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c in columns)
    return encoded.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(decoded, f"{schema}, `{text_col}` string")
