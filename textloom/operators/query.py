"""Queries as values: what they match is up to the planner, what they look like is here."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

MAX_TERMS, MAX_CLAUSES = 256, 1024


def _number(x: float) -> str:
    return repr(float(x)) if x != int(x) else f"{x:.1f}"


@dataclass(frozen=True)
class Query:
    boost: float = field(default=1.0, kw_only=True)

    def boosted(self, boost: float):
        return replace(self, boost=boost)

    def to_s(self, default: str = "") -> str:
        return self._text(default) + (f"^{_number(self.boost)}" if self.boost != 1.0 else "")

    def _text(self, default: str) -> str:
        raise NotImplementedError

    def __str__(self) -> str:
        return self.to_s()


def _at(name: str, default: str) -> str:
    return "" if name == default else f"{name}:"


@dataclass(frozen=True)
class TermQuery(Query):
    field: str
    term: str

    def _text(self, default):
        return _at(self.field, default) + self.term


@dataclass(frozen=True)
class MultiTermQuery(Query):
    """Any of some terms, as one term whose document frequency is the sum of theirs."""

    field: str
    terms: tuple[tuple[str, float], ...] = ()
    max_terms: int = MAX_TERMS
    min_score: float = 0.0

    def add_term(self, term: str, boost: float = 1.0) -> MultiTermQuery:
        return replace(self, terms=(*self.terms, (term, boost)))

    def kept(self) -> list[tuple[str, float]]:
        """Those above the least score; of too many, those with the highest boosts."""
        some = [t for t in self.terms if t[1] > self.min_score]
        return sorted(some, key=lambda t: (-t[1], t[0]))[: self.max_terms]

    def _text(self, default):
        return _at(self.field, default) + '"' + "|".join(t + (f"^{_number(b)}" if b != 1.0 else "") for t, b in sorted(self.terms)) + '"'


@dataclass(frozen=True)
class PrefixQuery(Query):
    field: str
    prefix: str
    max_terms: int = MAX_TERMS

    def _text(self, default):
        return f"{_at(self.field, default)}{self.prefix}*"


@dataclass(frozen=True)
class WildcardQuery(Query):
    field: str
    pattern: str
    max_terms: int = MAX_TERMS

    def _text(self, default):
        return _at(self.field, default) + self.pattern


@dataclass(frozen=True)
class FuzzyQuery(Query):
    field: str
    term: str
    min_similarity: float = 0.5
    prefix_length: int = 0
    max_terms: int = MAX_TERMS

    def __post_init__(self):
        if not 0 <= self.min_similarity < 1 or self.prefix_length < 0 or self.max_terms < 0:
            raise ValueError("similarity must be from 0 to below 1, lengths must not be negative")

    def _text(self, default):
        return f"{_at(self.field, default)}{self.term}~" + ("" if self.min_similarity == 0.5 else _number(self.min_similarity))


@dataclass(frozen=True)
class RangeQuery(Query):
    field: str
    lower: str | None = None
    upper: str | None = None
    include_lower: bool = True
    include_upper: bool = True
    typed: bool = False

    def __post_init__(self):
        if self.lower is None and self.upper is None:
            raise ValueError("a range needs a bound")
        if not self.typed and self.lower is not None and self.upper is not None and self.lower.encode() > self.upper.encode():
            raise ValueError("the lower bound is above the upper one")

    def _text(self, default):
        left = "<" if self.lower is None else ("[" if self.include_lower else "{") + self.lower
        right = ">" if self.upper is None else self.upper + ("]" if self.include_upper else "}")
        return _at(self.field, default) + left + (" " if self.lower is not None and self.upper is not None else "") + right


def TypedRangeQuery(field: str, *args, **kwargs) -> RangeQuery:
    return RangeQuery(field, *args, typed=True, **kwargs)


@dataclass(frozen=True)
class MatchAllQuery(Query):
    def _text(self, default):
        return "*"


@dataclass(frozen=True)
class ConstantScoreQuery(Query):
    filter: Any

    def _text(self, default):
        return f"ConstantScore({self.filter})"


@dataclass(frozen=True)
class FilteredQuery(Query):
    query: Query
    filter: Any

    def _text(self, default):
        return f"FilteredQuery({self.query.to_s(default)})"


@dataclass(frozen=True)
class PhraseQuery(Query):
    """Terms at places: ``slots`` are (offset, terms), the first offset being 0."""

    field: str
    slots: tuple[tuple[int, tuple[str, ...]], ...] = ()
    slop: int = 0

    def add_term(self, term: str | list[str] | tuple[str, ...], pos_inc: int = 1) -> PhraseQuery:
        at = self.slots[-1][0] + pos_inc if self.slots else 0
        return replace(self, slots=(*self.slots, (at, (term,) if isinstance(term, str) else tuple(term))))

    def append(self, term: str) -> PhraseQuery:
        """One more term at the last place."""
        at, terms = self.slots[-1]
        return replace(self, slots=(*self.slots[:-1], (at, (*terms, term))))

    def _text(self, default):
        words, last = [], None
        for at, terms in self.slots:
            words += ["<>"] * (at - last - 1 if last is not None else 0)
            words.append("|".join(terms))
            last = at
        return f'{_at(self.field, default)}"{" ".join(words)}"' + (f"~{self.slop}" if self.slop else "")


MUST, SHOULD, MUST_NOT = "must", "should", "must_not"
_SIGN = {MUST: "+", SHOULD: "", MUST_NOT: "-"}


@dataclass(frozen=True)
class BooleanClause:
    query: Query
    occur: str = SHOULD

    @property
    def required(self) -> bool:
        return self.occur == MUST

    @property
    def prohibited(self) -> bool:
        return self.occur == MUST_NOT


@dataclass(frozen=True)
class BooleanQuery(Query):
    clauses: tuple[BooleanClause, ...] = ()
    coord: bool = True
    max_clauses: int = MAX_CLAUSES

    def add(self, query: Query, occur: str = SHOULD) -> BooleanQuery:
        if len(self.clauses) >= self.max_clauses:
            raise ValueError(f"more than {self.max_clauses} clauses")
        return replace(self, clauses=(*self.clauses, BooleanClause(query, occur)))

    def to_s(self, default: str = "") -> str:
        text = self._text(default)
        return f"({text})^{_number(self.boost)}" if self.boost != 1.0 else text

    def _text(self, default):
        parts = []
        for c in self.clauses:
            inner = c.query.to_s(default)
            nested = isinstance(c.query, BooleanQuery) and c.query.boost == 1.0
            parts.append(_SIGN[c.occur] + (f"({inner})" if nested else inner))
        return " ".join(parts)


# Spans
@dataclass(frozen=True)
class SpanTermQuery(Query):
    field: str
    term: str

    def _text(self, default):
        return f"span_terms({_at(self.field, default)}{self.term})"


@dataclass(frozen=True)
class SpanMultiTermQuery(Query):
    field: str
    terms: tuple[str, ...]

    def _text(self, default):
        return f"span_terms({_at(self.field, default)}[{','.join(self.terms)}])"


@dataclass(frozen=True)
class SpanPrefixQuery(Query):
    field: str
    prefix: str
    max_terms: int = MAX_TERMS

    def _text(self, default):
        return f"{_at(self.field, default)}{self.prefix}*"


@dataclass(frozen=True)
class SpanFirstQuery(Query):
    match: Query
    end: int

    def _text(self, default):
        return f"span_first({self.match.to_s(default)}, {self.end})"


@dataclass(frozen=True)
class SpanOrQuery(Query):
    clauses: tuple[Query, ...]

    def _text(self, default):
        return f"span_or[{','.join(c.to_s(default) for c in self.clauses)}]"


@dataclass(frozen=True)
class SpanNearQuery(Query):
    clauses: tuple[Query, ...]
    slop: int = 0
    in_order: bool = False

    def _text(self, default):
        return f"span_near[{','.join(c.to_s(default) for c in self.clauses)}]"


@dataclass(frozen=True)
class SpanNotQuery(Query):
    include: Query
    exclude: Query

    def _text(self, default):
        return f"span_not(inc:<{self.include.to_s(default)}>, exc:<{self.exclude.to_s(default)}>)"


SPANS = (SpanTermQuery, SpanMultiTermQuery, SpanPrefixQuery, SpanFirstQuery, SpanOrQuery, SpanNearQuery, SpanNotQuery)


def span_field(q: Query) -> str:
    """The one field of a span query."""
    if isinstance(q, SpanFirstQuery):
        return span_field(q.match)
    parts = q.clauses if isinstance(q, (SpanOrQuery, SpanNearQuery)) else (q.include, q.exclude) if isinstance(q, SpanNotQuery) else ()
    if not parts:
        return q.field
    names = {span_field(p) for p in parts}
    if len(names) > 1:
        raise ValueError(f"all clauses of a span query must have one field, not {sorted(names)}")
    return names.pop()
