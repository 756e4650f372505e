"""From a query to a DataFrame (doc_id, score).

A query is first rewritten: expansions become lists of terms, by small lookups
in the dictionary. Then its weights are worked out from document frequencies,
and it becomes one plan in which a boolean query is one union and one
aggregation by document, and a term one filtered scan of the postings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import similarity
from . import positional
from . import query as Q
from .filters import RangeFilter
from .index import SearchIndex


#: Documents of the rarest part of a conjunction go to all executors up to so many.
RARE = 1_000_000


def _bytewise(term: Column) -> Column:
    """A string with one character for each byte."""
    return F.decode(F.encode(term, "UTF-8"), "ISO-8859-1")


def rewrite(q: Q.Query, index: SearchIndex) -> Q.Query:
    """Replace what stands for other queries, until nothing does."""
    while (new := _rewrite(q, index)) != q:
        q = new
    return q


def _dictionary(index: SearchIndex, name: str, condition: Column, limit: int) -> list[str]:
    """The first terms of a field that fit, in byte order: ``limit`` of them, which the query sets."""
    found = index.term_stats.filter((F.col("field") == name) & condition).select("term")
    return [r["term"] for r in found.orderBy("term").limit(limit).collect()]


def _rewrite(q: Q.Query, index: SearchIndex) -> Q.Query:
    term = F.col("term")
    if isinstance(q, Q.PrefixQuery):
        terms = _dictionary(index, q.field, term.startswith(q.prefix), q.max_terms)
        return Q.MultiTermQuery(q.field, tuple((t, 1.0) for t in terms), q.max_terms, boost=q.boost)
    if isinstance(q, Q.WildcardQuery):
        if not re.search(r"[*?]", q.pattern):
            return Q.TermQuery(q.field, q.pattern, boost=q.boost)
        literal = re.match(r"[^*?]*", q.pattern)[0]
        java = "".join({"*": "(?s:.*)", "?": "(?s:.)"}.get(x, re.escape(x)) for x in re.split(r"([*?])", q.pattern) if x)
        terms = _dictionary(index, q.field, term.startswith(literal) & term.rlike(rf"\A{java}\z"), q.max_terms)
        return Q.MultiTermQuery(q.field, tuple((t, 1.0) for t in terms), q.max_terms)
    if isinstance(q, Q.FuzzyQuery):
        return _fuzzy(q, index)
    if isinstance(q, Q.RangeQuery):
        return Q.ConstantScoreQuery(RangeFilter(replace(q, boost=1.0)), boost=q.boost)
    if isinstance(q, Q.MultiTermQuery) and len(q.terms) == 1 and q.terms[0][1] == 1.0:
        return Q.TermQuery(q.field, q.terms[0][0], boost=q.boost)
    if isinstance(q, Q.PhraseQuery) and len(q.slots) == 1:
        terms = q.slots[0][1]
        return Q.TermQuery(q.field, terms[0], boost=q.boost) if len(terms) == 1 else Q.MultiTermQuery(q.field, tuple((t, 1.0) for t in terms), boost=q.boost)
    if isinstance(q, Q.BooleanQuery):
        if len(q.clauses) == 1 and not q.clauses[0].prohibited:
            inner = q.clauses[0].query
            return inner.boosted(inner.boost * q.boost)
        if q.clauses and all(c.prohibited for c in q.clauses):
            return replace(q, clauses=(*q.clauses, Q.BooleanClause(Q.MatchAllQuery(), Q.MUST)))
        return replace(q, clauses=tuple(replace(c, query=_rewrite(c.query, index)) for c in q.clauses))
    if isinstance(q, Q.FilteredQuery):
        return replace(q, query=_rewrite(q.query, index))
    if isinstance(q, Q.SpanPrefixQuery):
        return Q.SpanMultiTermQuery(q.field, tuple(_dictionary(index, q.field, term.startswith(q.prefix), q.max_terms)), boost=q.boost)
    if isinstance(q, Q.SpanFirstQuery):
        return replace(q, match=_rewrite(q.match, index))
    if isinstance(q, (Q.SpanOrQuery, Q.SpanNearQuery)):
        return replace(q, clauses=tuple(_rewrite(c, index) for c in q.clauses))
    if isinstance(q, Q.SpanNotQuery):
        return replace(q, include=_rewrite(q.include, index), exclude=_rewrite(q.exclude, index))
    return q


def fuzzy_similarity(term: Column, q: Q.FuzzyQuery) -> Column:
    """1 less the edit distance of what follows the prefix, over the shorter length, all in bytes; 0 or less: no match."""
    own = q.term.encode().decode("latin-1")
    p = min(q.prefix_length, len(own))
    suffix, text = own[p:], F.substr(_bytewise(term), F.lit(p + 1))
    m, n = F.length(text), len(suffix)
    shorter = F.least(m, F.lit(n)) + p
    most = F.floor((1 - q.min_similarity) * shorter + 1e-9)
    if n == 0:
        return F.lit(0.0) if p == 0 else 1 - m / p
    distance = F.levenshtein(text, F.lit(suffix))
    plain = F.when((F.abs(m - n) <= most) & (distance <= most), 1 - distance / shorter).otherwise(0.0)
    return F.when(m == 0, F.lit(0.0) if p == 0 else F.lit(1 - n / p)).otherwise(plain)


def _fuzzy(q: Q.FuzzyQuery, index: SearchIndex) -> Q.Query:
    if q.prefix_length >= len(q.term.encode()):
        return Q.TermQuery(q.field, q.term, boost=q.boost)
    prefix = q.term.encode()[: q.prefix_length].decode("utf-8", "ignore")
    found = index.term_stats.filter((F.col("field") == q.field) & F.col("term").startswith(prefix)).select("term")
    scored = found.withColumn("s", fuzzy_similarity(F.col("term"), q)).filter(F.col("s") > q.min_similarity)
    best = scored.orderBy(F.desc("s"), "term").limit(q.max_terms).collect()
    return Q.MultiTermQuery(q.field, tuple((r["term"], r["s"]) for r in best), q.max_terms)


@dataclass
class Weight:
    """What a query is worth: ``value`` multiplies its documents' frequencies."""

    query: Q.Query
    idf: float = 1.0
    factor: float = 1.0
    parts: tuple[Weight, ...] = ()

    @property
    def squares(self) -> float:
        if isinstance(self.query, Q.BooleanQuery):
            own = sum(w.squares for w, c in zip(self.parts, self.query.clauses, strict=True) if not c.prohibited)
            return own * self.query.boost**2
        if isinstance(self.query, Q.FilteredQuery):
            return self.parts[0].squares * self.query.boost**2
        return (self.idf * self.query.boost) ** 2

    def normalize(self, norm: float) -> Weight:
        if self.parts:
            for w in self.parts:
                w.normalize(norm * self.query.boost)
        self.factor = norm
        return self

    @property
    def value(self) -> float:
        return self.idf * self.query.boost * self.factor * self.idf


class Planner:
    def __init__(self, index: SearchIndex):
        self.index = index

    # Weights
    def weigh(self, q: Q.Query) -> Weight:
        """The normalised weights of a rewritten query."""
        self.dfs = self.index.doc_freqs(self._terms(q))
        w = self._weight(q)
        return w.normalize(similarity.query_norm(w.squares))

    def _terms(self, q: Q.Query) -> set[tuple[str, str]]:
        if isinstance(q, Q.TermQuery):
            return {(q.field, q.term)}
        if isinstance(q, Q.MultiTermQuery):
            return {(q.field, t) for t, _ in q.kept()}
        if isinstance(q, Q.PhraseQuery):
            return {(q.field, t) for _, ts in q.slots for t in ts}
        if isinstance(q, Q.SPANS):
            name = Q.span_field(q)
            return {(name, t) for t in positional.span_terms(q)}
        if isinstance(q, Q.BooleanQuery):
            return set().union(*(self._terms(c.query) for c in q.clauses)) if q.clauses else set()
        return self._terms(q.query) if isinstance(q, Q.FilteredQuery) else set()

    def _idf(self, dfs: list[int]) -> float:
        return sum(similarity.idf(d, self.index.max_doc) for d in dfs)

    def _weight(self, q: Q.Query) -> Weight:
        if isinstance(q, Q.BooleanQuery):
            return Weight(q, parts=tuple(self._weight(c.query) for c in q.clauses))
        if isinstance(q, Q.FilteredQuery):
            return Weight(q, parts=(self._weight(q.query),))
        if isinstance(q, (Q.MatchAllQuery, Q.ConstantScoreQuery)):
            return Weight(q)
        if isinstance(q, Q.MultiTermQuery):
            return Weight(q, self._idf([sum(self.dfs[q.field, t] for t, _ in q.kept())]))
        if isinstance(q, Q.PhraseQuery):
            return Weight(q, self._idf([self.dfs[q.field, t] for _, ts in q.slots for t in ts]))
        return Weight(q, self._idf([self.dfs[t] for t in sorted(self._terms(q))]))

    # Plans
    def hits(self, q: Q.Query) -> DataFrame:
        """All live documents that match, with their scores."""
        q = rewrite(q, self.index)
        found = self._plan(self.weigh(q))
        if found is None:
            return self.index.stored.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        return self.index.live(found)

    def _plan(self, w: Weight) -> DataFrame | None:
        """None where there is nothing that could score."""
        q = w.query
        if isinstance(q, Q.TermQuery):
            return self._postings(q.field, [q.term]).select("doc_id", (similarity.tf(F.col("freq")) * F.lit(w.value) * F.col("norm")).alias("score"))
        if isinstance(q, Q.MultiTermQuery):
            return self._multi(q, w)
        if isinstance(q, Q.MatchAllQuery):
            return self.index.docs().select("doc_id", F.lit(w.value).alias("score"))
        if isinstance(q, Q.ConstantScoreQuery):
            return q.filter.docs(self.index).select("doc_id", F.lit(w.value).alias("score"))
        if isinstance(q, Q.FilteredQuery):
            inner = self._plan(w.parts[0])
            return None if inner is None else inner.join(q.filter.docs(self.index), "doc_id", "left_semi")
        if isinstance(q, Q.PhraseQuery):
            return self._scored(self.phrase_freq(q), w) if q.slots else None
        if isinstance(q, Q.BooleanQuery):
            return self._boolean(q, w)
        return self._scored(self.span_freq(q), w)

    def _postings(self, name: str, terms: list[str]) -> DataFrame:
        return self.index.postings.filter((F.col("field") == name) & F.col("term").isin(terms))

    def _only_with(self, rows: DataFrame, needed: list[tuple[str, list[str]]], terms: set[tuple[str, str]]) -> DataFrame:
        """``rows`` of documents that have the rarest of what is ``needed``, where it is rare enough to tell them early.

        Each part needed is a field and terms one of which a document must
        have. The rarest part's documents are broadcast if there are RARE of
        them at most and they are few beside the postings of all ``terms``.
        """
        sizes = [(sum(self.dfs[name, t] for t in ts), name, ts) for name, ts in needed]
        total = sum(self.dfs[t] for t in terms)
        if not sizes or min(sizes)[0] > RARE or min(sizes)[0] * 8 > total:
            return rows
        _, name, ts = min(sizes)
        return rows.join(F.broadcast(self._postings(name, ts).select("doc_id").distinct()), "doc_id", "left_semi")

    @staticmethod
    def _scored(freqs: DataFrame, w: Weight) -> DataFrame:
        return freqs.filter("freq > 0").select("doc_id", (F.sqrt("freq") * F.lit(w.value) * F.col("norm")).alias("score"))

    def _multi(self, q: Q.MultiTermQuery, w: Weight) -> DataFrame | None:
        kept = q.kept()
        if not kept:
            return None
        rows = self._postings(q.field, [t for t, _ in kept])
        boosts = {b for _, b in kept}
        if len(boosts) == 1:
            boost = F.lit(boosts.pop())
        else:
            table = F.create_map(*[F.lit(x) for t, b in kept for x in (t, b)])
            boost = F.element_at(table, F.col("term"))
        return rows.groupBy("doc_id").agg((F.sum(similarity.tf(F.col("freq")) * boost) * F.lit(w.value) * F.max("norm")).alias("score"))

    def phrase_slots(self, q: Q.PhraseQuery) -> DataFrame:
        """Per document the norm and, for each slot, its positions less the slot's offset."""
        terms = self._terms(q)
        rows = self._only_with(self._postings(q.field, sorted(t for _, t in terms)), [(q.field, list(ts)) for _, ts in q.slots], terms)

        def shifted(at: int):
            return lambda p: p - at

        slots = [F.flatten(F.collect_list(F.when(F.col("term").isin(list(ts)), F.transform("positions", shifted(at))))).alias(f"s{i}") for i, (at, ts) in enumerate(q.slots)]
        found = rows.groupBy("doc_id").agg(F.max("norm").alias("norm"), *slots)
        return found.filter(reduce(lambda a, b: a & b, [F.size(f"s{i}") > 0 for i in range(len(q.slots))]))

    def phrase_freq(self, q: Q.PhraseQuery) -> DataFrame:
        """(doc_id, norm, freq); an exact phrase stays in the JVM."""
        found, n = self.phrase_slots(q), len(q.slots)
        if q.slop == 0:
            both = reduce(F.array_intersect, [F.col(f"s{i}") for i in range(n)])
            return found.select("doc_id", "norm", F.size(both).cast("double").alias("freq"))
        all_terms = [t for _, ts in q.slots for t in ts]
        offsets, slop = [at for at, _ in q.slots] if len(set(all_terms)) < len(all_terms) else None, q.slop

        def run(rows: pa.Array) -> pa.Array:
            return pa.array([positional.sloppy_phrase([sorted(s) for s in r], slop, offsets) for r in rows.to_pylist()], pa.float64())

        run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
        freq = F.arrow_udf(run, T.DoubleType())(F.array(*[f"s{i}" for i in range(n)]))
        return found.select("doc_id", "norm", freq.alias("freq"))

    def spans(self, q: Q.Query) -> DataFrame:
        """(doc_id, norm, spans) of the documents that have a term of every part that must be there."""
        name, terms = Q.span_field(q), sorted(positional.span_terms(q))
        needed = [sorted(x) for x in positional.needed(q)]
        rows = self._only_with(self._postings(name, terms), [(name, x) for x in needed], {(name, t) for t in terms}).groupBy("doc_id")
        rows = rows.agg(*[F.max(F.col("term").isin(x)).alias(f"has{i}") for i, x in enumerate(needed)], F.max("norm").alias("norm"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
        for i in range(len(needed)):
            rows = rows.filter(f"has{i}")
        if isinstance(q, Q.SpanTermQuery):
            found = F.transform(F.element_at("m", q.term), lambda p: F.struct(p.alias("start"), (p + 1).alias("end")))
            return rows.select("doc_id", "norm", found.alias("spans"))

        def run(maps: pa.Array) -> pa.Array:
            out = []
            for m in maps.to_pylist():
                table = dict(m)
                out.append([{"start": a, "end": b} for a, b in positional.spans(q, lambda t, table=table: table.get(t, []))])
            return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

        run.__annotations__ = {"maps": pa.Array, "return": pa.Array}
        of = F.arrow_udf(run, "array<struct<start:int,end:int>>")
        return rows.select("doc_id", "norm", of("m").alias("spans"))

    def span_freq(self, q: Q.Query) -> DataFrame:
        rate = F.aggregate("spans", F.lit(0.0), lambda s, x: s + F.lit(1.0) / (x["end"] - x["start"] + 1))
        return self.spans(q).select("doc_id", "norm", rate.alias("freq"))

    def _boolean(self, q: Q.BooleanQuery, w: Weight) -> DataFrame | None:
        plans = [(c, self._plan(p), p) for c, p in zip(q.clauses, w.parts, strict=True)]
        if any(c.required and df is None for c, df, _ in plans):
            return None
        plans = [(c, df, p) for c, df, p in plans if df is not None]
        positive = [c for c, _, _ in plans if not c.prohibited]
        if not positive:
            return None
        n_must, total = sum(c.required for c in positive), len(positive)
        tagged = self._one_scan(plans) or [df.select("doc_id", "score", F.lit(c.occur).alias("occur")) for c, df, _ in plans]
        count = lambda occur: F.count(F.when(F.col("occur") == occur, 1))
        found = reduce(DataFrame.unionByName, tagged).groupBy("doc_id").agg(
            F.sum(F.when(F.col("occur") != Q.MUST_NOT, F.col("score"))).alias("sum"), count(Q.MUST).alias("must"), count(Q.SHOULD).alias("should"), count(Q.MUST_NOT).alias("bad")
        )
        found = found.filter((F.col("bad") == 0) & (F.col("must") == n_must) & (F.col("must") + F.col("should") > 0))
        scale = similarity.coord(F.col("must") + F.col("should"), total) if q.coord else F.lit(1.0)
        return found.select("doc_id", (F.col("sum") * scale).alias("score"))

    def _one_scan(self, plans) -> list[DataFrame] | None:
        """Clauses that are all terms are read in one scan, each row for all of the clauses that it fits."""
        if not all(isinstance(c.query, Q.TermQuery) for c, _, _ in plans):
            return None
        fits = lambda c: (F.col("field") == c.query.field) & (F.col("term") == c.query.term)
        by_field: dict[str, set[str]] = {}
        for c, _, _ in plans:
            by_field.setdefault(c.query.field, set()).add(c.query.term)
        wanted = reduce(lambda a, b: a | b, [(F.col("field") == n) & F.col("term").isin(sorted(ts)) for n, ts in by_field.items()])
        own = F.array_compact(F.array(*[F.when(fits(c), F.struct(F.lit(p.value).alias("value"), F.lit(c.occur).alias("occur"))) for c, _, p in plans]))
        musts = [(c.query.field, [c.query.term]) for c, _, _ in plans if c.required]
        rows = self._only_with(self.index.postings.filter(wanted), musts, {(n, t) for n, ts in by_field.items() for t in ts}).select("doc_id", "freq", "norm", F.inline(own))
        return [rows.select("doc_id", (similarity.tf(F.col("freq")) * F.col("value") * F.col("norm")).alias("score"), "occur")]
