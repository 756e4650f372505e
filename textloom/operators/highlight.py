"""Excerpts of a text with the words that a query matched marked."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer
from . import positional
from . import query as Q
from .filters import parse_number

Range = tuple[int, int]  # first and last position


def matched(q: Q.Query, at: dict[str, list[int]]) -> Iterator[Range]:
    """The ranges of positions that a rewritten query matches among a field's terms."""
    if isinstance(q, Q.TermQuery):
        yield from ((p, p) for p in at.get(q.term, ()))
    elif isinstance(q, Q.MultiTermQuery):
        for t, _ in q.kept():
            yield from ((p, p) for p in at.get(t, ()))
    elif isinstance(q, Q.PhraseQuery):
        slots = [sorted(p - off for t in ts for p in at.get(t, ())) for off, ts in q.slots]
        if slots and all(slots):
            for base in slots[0]:
                near = [min(s, key=lambda p, base=base: abs(p - base)) for s in slots]
                if max(near) - min(near) <= q.slop:
                    places = [p + off for p, (off, _) in zip(near, q.slots, strict=True)]
                    yield from ((min(places), max(places)),) if not q.slop else ((p, p) for p in sorted(places))
    elif isinstance(q, Q.BooleanQuery):
        for c in q.clauses:
            if not c.prohibited:
                yield from matched(c.query, at)
    elif isinstance(q, Q.FilteredQuery):
        yield from matched(q.query, at)
    elif isinstance(q, Q.RangeQuery):
        for t, places in at.items():
            if in_range(t, q):
                yield from ((p, p) for p in places)
    elif isinstance(q, Q.SPANS):
        yield from ((a, b - 1) for a, b in positional.spans(q, lambda t: at.get(t, [])))


def in_range(term: str, q: Q.RangeQuery) -> bool:
    value, low, high = term.encode(), q.lower and q.lower.encode(), q.upper and q.upper.encode()
    if q.typed:
        bounds = [None if x is None else parse_number(x) for x in (q.lower, q.upper)]
        if all(b is not None or x is None for b, x in zip(bounds, (q.lower, q.upper), strict=True)):
            value, low, high = parse_number(term), *bounds
            if value is None:
                return False
    above = low is None or value > low or (q.include_lower and value == low)
    return above and (high is None or value < high or (q.include_upper and value == high))


def compact(ranges: list[Range], breaks: bool = True) -> list[tuple[int, int, float]]:
    """Ascending ranges with their scores; overlapping ones are one (and, without breaks, neighbours too)."""
    out: list[tuple[int, int, float]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + (0 if breaks else 1):
            first, last, score = out[-1]
            out[-1] = first, max(last, b), score + 1.0
        else:
            out.append((a, b, 1.0))
    return out


def vectors(q: Q.Query, breaks: bool):
    """A function from a column of {term: positions} to its compacted ranges."""

    def run(maps: pa.Array) -> pa.Array:
        found = [compact(list(matched(q, dict(m))), breaks) for m in maps.to_pylist()]
        return pa.array([[{"first": a, "last": b, "score": s} for a, b, s in x] for x in found], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])))

    run.__annotations__ = {"maps": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<first:int,last:int,score:double>>")


@dataclass(frozen=True)
class Highlighter:
    excerpt_length: int | None = 150  # None: the whole field
    num_excerpts: int = 2
    pre_tag: str = "<b>"
    post_tag: str = "</b>"
    ellipsis: str = "..."

    def excerpts(self, text: str, q: Q.Query, analyzer: Analyzer) -> list[str] | None:
        """Marked excerpts of ``text``; None if nothing in it matches and it is no short text. Lengths are in bytes.

        The stretches of matches worth most become excerpts; where there are
        fewer than asked for, the text's opening makes up for them. Excerpts
        that fit into their common length are one, and each is filled up with
        the tokens around it.
        """
        begins: list[int] = []  # bytes of each position
        ends: list[int] = []
        at: dict[str, list[int]] = {}
        pos = -1
        offset = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text], dtype=np.int64))).tolist()
        for t in analyzer.tokens(text):
            pos += t.pos_inc
            missing = pos + 1 - len(begins)
            begins += [offset[t.start]] * missing
            ends += [offset[t.end]] * missing
            at.setdefault(t.text, []).append(pos)
        raw, found = text.encode(), compact(list(matched(q, at)))
        size = len(raw) + 1 if self.excerpt_length is None else self.excerpt_length
        marks = [(begins[a], ends[b]) for a, b, _ in found]
        if len(raw) < size * self.num_excerpts:
            return [self._mark(raw, 0, len(raw), marks)]
        if not found:
            return None
        out = []
        for matches, tokens, length in self._joined(found, marks, size):
            left, right = self._filled(tokens, begins, ends, length)
            begin, end = (begins[left], ends[right]) if right >= left else (0, 0)
            if len(raw) - end <= len(self.ellipsis.encode()):
                end = len(raw)
            out.append((self.ellipsis if begin else "") + self._mark(raw, begin, end, marks[matches]) + (self.ellipsis if end < len(raw) else ""))
        return out

    def _joined(self, found: list[tuple[int, int, float]], marks: list[Range], size: int) -> Iterator[tuple[slice, Range, int]]:
        """Excerpts in order: their matches, first and last token (none: an empty range), and the length they may have."""
        openings = [(slice(0, 0), (0, -1), (0, 0))] * max(0, self.num_excerpts - len(found))
        parts = openings + [(slice(a, b), (found[a][0], found[max(a, b - 1)][1]), (marks[a][0], marks[max(a, b - 1)][1])) for a, b in self._best(found, marks, size)]
        i = 0
        while i < len(parts):
            room = range(i + 1, len(parts))
            last = max([i, *(j for j in room if parts[j][2][1] - parts[i][2][0] < (j - i + 1) * size)])
            yield slice(parts[i][0].start, parts[last][0].stop), (parts[i][1][0], parts[last][1][1]), (last - i + 1) * size
            i = last + 1

    def _best(self, found: list[tuple[int, int, float]], marks: list[Range], size: int) -> list[Range]:
        """The stretches of matches worth most, in order; what one has is worth nothing to another."""
        begins, ends = np.array(marks).T
        stop = np.searchsorted(ends, begins + size, side="right")
        first, worth = np.arange(len(found)), np.array([score for _, _, score in found])
        open_ = np.ones(len(found), dtype=bool)
        for _ in range(min(self.num_excerpts, len(found))):
            total = np.concatenate(([0.0], np.cumsum(worth)))
            k = int(np.where(open_, total[stop] - total[first], -1.0).argmax())
            open_[k] = False
            worth[k : stop[k]] = 0
        return [(int(k), int(stop[k])) for k in np.flatnonzero(~open_)]

    @staticmethod
    def _filled(tokens: Range, begins: list[int], ends: list[int], length: int) -> Range:
        """The range grown by a token before and one behind, in turn, as long as one of them fits into ``length``."""
        left, right = tokens
        if right < left:
            if len(ends) < 2 or ends[1] >= length:
                return tokens
            right = left + 1
        fits = lambda a, b: 0 <= a and b < len(ends) and ends[b] - begins[a] < length
        while (before := fits(left - 1, right)) | (behind := fits(left - before, right + 1)):
            left, right = left - before, right + behind
        return left, right

    def _mark(self, raw: bytes, begin: int, end: int, marks: list[Range]) -> str:
        out, last = [], begin
        for a, b in marks:
            out += [raw[last:a].decode("utf-8", "replace"), self.pre_tag, raw[a:b].decode("utf-8", "replace"), self.post_tag]
            last = b
        return "".join([*out, raw[last:end].decode("utf-8", "replace")])


def highlight(docs: DataFrame, field: str, q: Q.Query, analyzer: Analyzer, options: Highlighter) -> DataFrame:
    """``docs`` with a column ``excerpts``; texts are marked in parallel."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else options.excerpts(t, q, analyzer) for t in texts.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn("excerpts", F.arrow_udf(run, "array<string>")(F.col(field)))


