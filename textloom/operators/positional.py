"""Matching inside one document: sloppy phrases and spans, over its terms' positions."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

from ..functions.similarity import sloppy_freq
from . import query as Q

Span = tuple[int, int]


def _stretches(slots: list[list[int]]) -> list[tuple[int, int, int]]:
    """All slots' positions merged: (slot, first, last) of every stretch of one slot that no other slot's position interrupts.

    Where several slots share a position, the stretch that is under way takes its own first.
    """
    shared: dict[int, list[int]] = {}
    for i, places in enumerate(slots):
        for p in places:
            shared.setdefault(p, []).append(i)
    out: list[tuple[int, int, int]] = []
    for p in sorted(shared):
        for i in sorted(shared[p], key=lambda i: (not (out and out[-1][0] == i), i)):
            if out and out[-1][0] == i:
                out[-1] = i, out[-1][1], p
            else:
                out.append((i, p, p))
    return out


def _windows(slots: list[list[int]]) -> Iterator[int]:
    """Lengths of the windows of a phrase: each begins where a stretch ends, and goes on until every other slot has come again."""
    ahead: dict[int, int] = {}
    for i, first, last in reversed(_stretches(slots)):
        others = [p for j, p in ahead.items() if j != i]
        if len(others) == len(slots) - 1:
            yield max(others) - last
        ahead[i] = first


def _windows_of_own_words(slots: list[list[int]], offsets: list[int]) -> Iterator[int]:
    """As ``_windows``, for phrases that repeat a term: no word of the text stands for two slots at once."""
    held: dict[int, int] = {}  # the position each slot holds

    def free(i: int, behind: int) -> list[int]:
        taken = {p + offsets[j] for j, p in held.items() if offsets[j] != offsets[i]}
        return [p for p in slots[i] if p > behind and p + offsets[i] not in taken]

    for i in range(len(slots)):
        if not (open_ := free(i, -(1 << 40))):
            return
        held[i] = open_[0]
    while True:
        end = max(held.values())
        low = min(held, key=lambda i: (held[i], i))
        own = held.pop(low)
        fence = min(held.values())
        inside = [p for p in free(low, own) if p <= fence]
        yield end - (inside[-1] if inside else own)
        behind = free(low, fence)
        if not behind:
            return
        held[low] = behind[0]


def sloppy_phrase(slots: list[list[int]], slop: int, offsets: list[int] | None = None) -> float:
    """The frequency of a phrase whose slots stand at ``slots`` (positions less the slots' offsets, ascending).

    Windows of at most ``slop`` count 1 / (1 + length). ``offsets`` are given
    for phrases that have a term in several slots.
    """
    if not slots or not all(slots):
        return 0.0
    if len(slots) == 1:
        return float(len(slots[0]))
    found = _windows(slots) if offsets is None else _windows_of_own_words(slots, offsets)
    return sum(sloppy_freq(n) for n in found if n <= slop)


def spans(q: Q.Query, positions: Callable[[str], list[int]]) -> list[Span]:
    """The spans (start, end) of a query in a document, in order; an end is one behind."""
    if isinstance(q, Q.SpanTermQuery):
        return [(p, p + 1) for p in positions(q.term)]
    if isinstance(q, Q.SpanMultiTermQuery):
        return sorted((p, p + 1) for t in q.terms for p in positions(t))
    if isinstance(q, Q.SpanFirstQuery):
        return [s for s in spans(q.match, positions) if s[1] <= q.end]
    if isinstance(q, Q.SpanOrQuery):
        return sorted(s for c in q.clauses for s in spans(c, positions))
    if isinstance(q, Q.SpanNotQuery):
        out = spans(q.exclude, positions)
        return [s for s in spans(q.include, positions) if not any(x[0] < s[1] and x[1] > s[0] for x in out)]
    if isinstance(q, Q.SpanNearQuery):
        if len(q.clauses) == 1:
            return spans(q.clauses[0], positions)
        return (_ordered if q.in_order else _unordered)([spans(c, positions) for c in q.clauses], q.slop)
    raise TypeError(f"{type(q).__name__} is no span query")


def _unordered(parts: list[list[Span]], slop: int) -> list[Span]:
    """Every clause's next span from each span on, in whatever order, if what lies between them all is no more than ``slop``."""
    ahead: dict[int, Span] = {}
    out: list[Span] = []
    for span, i in sorted(((s, i) for i, part in enumerate(parts) for s in part), reverse=True):
        ahead[i] = span
        if len(ahead) == len(parts):
            end = max(b for _, b in ahead.values())
            if end - span[0] - sum(b - a for a, b in ahead.values()) <= slop:
                out.append((span[0], end))
    return out[::-1]


def _ordered(parts: list[list[Span]], slop: int) -> list[Span]:
    """From each span of the first clause, each next clause's first span that isn't before the one found last, nor before one that an earlier start had to pass."""
    out: list[Span] = []
    least = [(-1, -1)] * len(parts)
    for start in parts[0]:
        chain = [start]
        for i, part in enumerate(parts[1:], 1):
            least[i] = max(least[i], chain[-1])
            at = bisect_left(part, least[i])
            if at == len(part):
                return out
            chain.append(part[at])
        if chain[-1][1] - start[0] - sum(b - a for a, b in chain) <= slop:
            out.append((start[0], chain[-1][1]))
    return out


def needed(q: Q.Query) -> list[set[str]]:
    """Sets of terms, one of each of which a document must have to match."""
    if isinstance(q, Q.SpanNearQuery):
        return [x for c in q.clauses for x in needed(c)]
    if isinstance(q, Q.SpanNotQuery):
        return needed(q.include)
    if isinstance(q, Q.SpanFirstQuery):
        return needed(q.match)
    return [span_terms(q)]


def span_terms(q: Q.Query) -> set[str]:
    if isinstance(q, Q.SpanTermQuery):
        return {q.term}
    if isinstance(q, Q.SpanMultiTermQuery):
        return set(q.terms)
    parts = q.clauses if isinstance(q, (Q.SpanOrQuery, Q.SpanNearQuery)) else (q.include, q.exclude) if isinstance(q, Q.SpanNotQuery) else (q.match,)
    return set().union(*(span_terms(p) for p in parts))
