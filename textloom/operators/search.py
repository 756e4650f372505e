"""Searching: top hits, sorting, paging, scans, explanations and highlights."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity
from ..plans.parser import QueryParser
from . import query as Q
from .highlight import Highlighter, highlight, vectors
from .index import SearchIndex
from .planner import Planner, Weight, rewrite

DIGITS = 6  # scores are compared after rounding


@dataclass(frozen=True)
class SortField:
    """``kind``: score, doc_id, integer, float, string, byte or auto."""

    name: str | None = None
    kind: str = "auto"
    reverse: bool = False

    def __str__(self) -> str:
        label = {"score": "<SCORE>", "doc_id": "<DOC>"}.get(self.kind, f"{self.name}:<{self.kind}>")
        return label + ("!" if self.reverse else "")


SCORE, DOC_ID = SortField(kind="score"), SortField(kind="doc_id")
SCORE_REVERSED, DOC_ID_REVERSED = SortField(kind="score", reverse=True), SortField(kind="doc_id", reverse=True)
RELEVANCE, INDEX_ORDER = (SCORE, DOC_ID), (DOC_ID,)


def parse_sort(text: str) -> list[SortField]:
    """``"size DESC, name"``; SCORE and DOC_ID are no fields."""
    out = []
    for part in text.split(","):
        words = part.split()
        down = len(words) > 1 and words[-1].upper() == "DESC"
        name = words[0]
        out.append(SortField(kind={"SCORE": "score", "DOC_ID": "doc_id"}[name], reverse=down) if name in ("SCORE", "DOC_ID") else SortField(name, reverse=down))
    return out


class FieldSymbol(str):
    """``FieldSymbol("size").integer.desc`` is a sort field in the making."""

    kind, down = "auto", False

    def _with(self, **changes) -> FieldSymbol:
        new = FieldSymbol(self)
        new.kind, new.down = changes.get("kind", self.kind), changes.get("down", self.down)
        return new

    integer = property(lambda self: self._with(kind="integer"))
    float = property(lambda self: self._with(kind="float"))
    string = property(lambda self: self._with(kind="string"))
    byte = property(lambda self: self._with(kind="byte"))
    desc = property(lambda self: self._with(down=not self.down))

    def sort_field(self) -> SortField:
        return SortField(str(self), self.kind, self.down)


@dataclass
class Explanation:
    value: float
    description: str
    details: list[Explanation] = field(default_factory=list)

    def to_s(self, depth: int = 0) -> str:
        return "  " * depth + f"{self.value:.6g} = {self.description}\n" + "".join(d.to_s(depth + 1) for d in self.details)

    def to_html(self) -> str:
        return f"<ul>\n<li>{self.value:.6g} = {self.description}</li>\n" + "".join(d.to_html() for d in self.details) + "</ul>\n"


@dataclass
class TopDocs:
    hits: DataFrame  # doc_id, score, in order
    found: DataFrame
    _all: tuple | None = None

    def _totals(self) -> tuple:
        if self._all is None:
            self._all = tuple(self.found.agg(F.count(F.lit(1)), F.max("score")).first())
        return self._all

    @property
    def total_hits(self) -> int:
        return self._totals()[0]

    @property
    def max_score(self) -> float:
        return self._totals()[1] or 0.0

    def doc_ids(self) -> list[int]:
        return [r["doc_id"] for r in self.hits.collect()]

    def to_json(self) -> str:
        return json.dumps([{"doc": r["doc_id"], "score": r["score"]} for r in self.hits.select("doc_id", "score").collect()])

    def __str__(self) -> str:
        lines = [f"\t{r['doc_id']}: {r['score']}" for r in self.hits.select("doc_id", "score").collect()]
        return "\n".join([f"TopDocs: total_hits = {self.total_hits}, max_score = {self.max_score}", *lines])


FilterProc = Callable[[Column, Column], Column]


class Searcher:
    """Searches one index, or several as one: later ones are numbered on from those before."""

    def __init__(self, *indexes: SearchIndex, parser: QueryParser | None = None):
        self.index = reduce(lambda a, b: a.merge(b), indexes)
        self.planner = Planner(self.index)
        infos = self.index.fields
        self.parser = parser or QueryParser("*", infos.indexed_fields, infos.tokenized_fields, self.index.analyzer)

    def query(self, q: Q.Query | str) -> Q.Query:
        return self.parser.parse(q) if isinstance(q, str) else q

    def hits(self, q: Q.Query | str, filter=None, filter_proc: FilterProc | None = None) -> DataFrame:
        """(doc_id, score). ``filter_proc`` gives a column of (doc_id, score): null or false drops, a number scales the score."""
        found = self.planner.hits(self.query(q))
        if filter is not None:
            found = found.join(self.index.filtered(filter), "doc_id", "left_semi")
        if filter_proc is not None:
            verdict = filter_proc(F.col("doc_id"), F.col("score"))
            kind = found.select(verdict.alias("v")).schema["v"].dataType.simpleString()
            found = found.filter(verdict) if kind == "boolean" else found.withColumn("__scale", verdict).filter("__scale is not null").select("doc_id", (F.col("score") * F.col("__scale")).alias("score"))
        return found

    def search(self, q: Q.Query | str, offset: int = 0, limit: int | None = 10, sort=None, filter=None, filter_proc: FilterProc | None = None) -> TopDocs:
        """The best hits; ``limit`` None gives all."""
        if offset < 0 or (limit is not None and limit <= 0):
            raise ValueError("offset must not be negative and limit must be positive")
        found = self.hits(q, filter, filter_proc).withColumn("score", F.round("score", DIGITS))
        ordered = self._sorted(found, sort)
        if offset:
            ordered = ordered.offset(offset)
        return TopDocs(ordered.limit(limit) if limit is not None else ordered, found)

    def _sorted(self, found: DataFrame, sort) -> DataFrame:
        fields = self._sort_fields(sort)
        keys: list[Column] = []
        for i, s in enumerate(fields):
            if s.kind == "score":
                key = F.col("score")
                keys.append(key.asc() if s.reverse else key.desc())
            elif s.kind == "doc_id":
                keys.append(F.desc("doc_id") if s.reverse else F.asc("doc_id"))
            else:
                name = f"__sort{i}"
                found = found.join(self._sort_values(s, name), "doc_id", "left")
                if s.kind in ("integer", "float"):
                    found = found.withColumn(name, F.coalesce(name, F.lit(0)))
                key = F.col(name)
                keys.append(key.desc_nulls_first() if s.reverse else key.asc_nulls_last())
        return found.orderBy(*keys, F.asc("doc_id")).select("doc_id", "score")

    def _sort_fields(self, sort) -> list[SortField]:
        if sort is None:
            return list(RELEVANCE)
        parts = [sort] if isinstance(sort, (str, SortField)) else list(sort)
        out: list[SortField] = []
        for p in parts:
            out += [p.sort_field()] if isinstance(p, FieldSymbol) else parse_sort(p) if isinstance(p, str) else [p]
        return [self._resolved(s) for s in out]

    def _resolved(self, s: SortField) -> SortField:
        """An auto field's type is told by its first term."""
        if s.kind != "auto":
            return s
        first = self.index.term_stats.filter(F.col("field") == s.name).agg(F.min("term")).first()[0]
        if first is None:
            raise ValueError(f"cannot sort by {s.name!r}, which has no terms")
        kind = "integer" if re.fullmatch(r"\s*[+-]?\d+", first) else "float" if re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", first) else "string"
        return SortField(s.name, kind, s.reverse)

    def _sort_values(self, s: SortField, name: str) -> DataFrame:
        """One value for each document: its last term's."""
        last = self.index.postings.filter(F.col("field") == s.name).groupBy("doc_id").agg(F.max("term").alias("t"))
        if s.kind == "byte":  # a term's place in the dictionary is its order among the bytes
            return last.select("doc_id", F.encode("t", "UTF-8").alias(name))
        if s.kind == "integer":
            return last.select("doc_id", F.coalesce(F.regexp_extract("t", r"\A\s*([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0)).alias(name))
        if s.kind == "float":
            return last.select("doc_id", F.coalesce(F.regexp_extract("t", r"\A\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0)).alias(name))
        return last.select("doc_id", F.col("t").alias(name))

    def search_each(self, q: Q.Query | str, **options) -> DataFrame:
        """Hits whose scores are at most 1: those above are taken as shares of the best."""
        top = self.search(q, **options)
        return top.hits.crossJoin(F.broadcast(top.found.agg(F.greatest(F.max("score"), F.lit(1.0)).alias("best")))).select("doc_id", F.round(F.col("score") / F.col("best"), DIGITS).alias("score"))

    def scan(self, q: Q.Query | str, start_doc: int = 0, limit: int | None = 50) -> DataFrame:
        """Matches in the order of documents, unscored."""
        found = self.planner.hits(self.query(q)).select("doc_id").filter(F.col("doc_id") >= start_doc).orderBy("doc_id")
        return found if limit is None else found.limit(limit)

    def search_many(self, queries: dict[str, tuple[str, str]], limit: int = 10) -> DataFrame:
        """The best hits of many single-term queries {name: (field, term)} in one pass: (query, doc_id, score, rank).

        Queries are a small table that is broadcast; each has a score of
        sqrt(tf) * idf * norm, as if it were searched alone.
        """
        dfs = self.index.doc_freqs(set(queries.values()))
        rows = [(name, f, t, similarity.idf(dfs[f, t], self.index.max_doc)) for name, (f, t) in queries.items()]
        table = self.index.spark.createDataFrame(rows, "query string, field string, term string, idf double")
        found = self.index.postings.join(F.broadcast(table), ["field", "term"])
        scored = self.index.live(found.select("query", "doc_id", F.round(similarity.tf(F.col("freq")) * F.col("idf") * F.col("norm"), DIGITS).alias("score")))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")))
        return ranked.filter(F.col("rank") <= limit)

    def match_vector(self, q: Q.Query | str, field: str, breaks: bool = True) -> DataFrame:
        """(doc_id, first, last, score): the ranges of positions in a field that a query matches, overlapping ones as one (without breaks neighbours too)."""
        own = rewrite(_in_field(self.query(q), field) or Q.BooleanQuery(), self.index)
        terms = sorted(t for _, t in self.planner._terms(own))
        at = self.planner._postings(field, terms).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
        return self.index.live(at).select("doc_id", F.inline(vectors(own, breaks)("m")))

    def highlight(self, q: Q.Query | str, field: str, docs: DataFrame | None = None, excerpt_length: int | None = 150, num_excerpts: int = 2, **tags) -> DataFrame:
        """(doc_id, excerpts) of the documents in ``docs`` (doc_id), or of the ten best."""
        plain = self.query(q)
        docs = self.search(plain).hits if docs is None else docs
        rows = self.index.docs().join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", field)
        own = rewrite(_in_field(plain, field) or Q.BooleanQuery(), self.index) if not isinstance(plain, Q.RangeQuery) else plain
        return highlight(rows, field, own, self.index.analyzer.for_field(field), Highlighter(excerpt_length, num_excerpts, **tags)).select("doc_id", "excerpts")

    def explain(self, q: Q.Query | str, doc_id: int) -> Explanation:
        """How one document came by its score."""
        weight = self.planner.weigh(rewrite(self.query(q), self.index))
        return self._explain(weight, doc_id)

    def explain_all(self, q: Q.Query | str) -> DataFrame:
        """For every document that a boolean query over plain clauses matches: (doc_id, score, sum, coord, clauses matched), in one plan."""
        weight = self.planner.weigh(rewrite(self.query(q), self.index))
        plain = weight.query
        if not isinstance(plain, Q.BooleanQuery):
            return self.index.live(self.planner._plan(weight)).select("doc_id", "score", F.col("score").alias("sum"), F.lit(1.0).alias("coord"), F.lit(1).cast("long").alias("matched"))
        whole = self.planner._plan(weight)
        plans = [(c, self.planner._plan(p)) for c, p in zip(plain.clauses, weight.parts, strict=True) if not c.prohibited]
        parts = reduce(DataFrame.unionByName, [df.select("doc_id", F.col("score").alias("part")) for _, df in plans if df is not None])
        sums = parts.groupBy("doc_id").agg(F.sum("part").alias("sum"), F.count(F.lit(1)).alias("matched"))
        possible = sum(df is not None for _, df in plans)
        coord = F.col("matched") / F.lit(float(possible)) if plain.coord else F.lit(1.0)
        return self.index.live(whole).join(sums, "doc_id").select("doc_id", "score", "sum", coord.alias("coord"), "matched")

    def _explain(self, w: Weight, doc_id: int) -> Explanation:
        q, here = w.query, F.col("doc_id") == doc_id
        if isinstance(q, Q.BooleanQuery):
            parts = [(c, self._explain(p, doc_id)) for c, p in zip(q.clauses, w.parts, strict=True)]
            possible = [c for c, p in zip(q.clauses, w.parts, strict=True) if not c.prohibited and self.planner._plan(p) is not None]
            hit = [(c, e) for c, e in parts if e.value > 0 or e.description == "matches with score 0"]
            if any(c.prohibited for c, _ in hit) or any(c.required and all(c is not h for h, _ in hit) for c in q.clauses) or not hit:
                return Explanation(0.0, "no match", [e for _, e in parts])
            total = sum(e.value for _, e in hit)
            share = len(hit) / len(possible) if q.coord else 1.0
            return Explanation(total * share, "product of:", [Explanation(total, "sum of:", [e for _, e in hit]), Explanation(share, f"coord({len(hit)}/{len(possible)})")])
        if isinstance(q, Q.TermQuery):
            row = self.index.postings.filter(here & (F.col("field") == q.field) & (F.col("term") == q.term)).select("freq", "norm").first()
            if row is None:
                return Explanation(0.0, f"no term {q.to_s()} in {doc_id}")
            tf = row["freq"] ** 0.5
            inner = [Explanation(tf, f"tf(freq={row['freq']})"), Explanation(w.idf, "idf"), Explanation(row["norm"], "norm")]
            return Explanation(tf * w.value * row["norm"], f"weight({q.to_s()} in {doc_id})", [Explanation(w.value / w.idf if w.idf else 0.0, "query weight"), *inner])
        plan = self.planner._plan(w)
        found = None if plan is None else plan.filter(here).first()
        if found is None:
            return Explanation(0.0, f"{q.to_s()} doesn't match {doc_id}")
        details = [Explanation(q.boost, "boost"), Explanation(w.factor, "query norm"), Explanation(w.idf, "idf")]
        return Explanation(found["score"], f"weight({q.to_s()} in {doc_id})" if found["score"] else "matches with score 0", details)

    def documents(self, hits: DataFrame) -> DataFrame:
        """Hits with their stored fields."""
        return hits.join(self.index.docs(), "doc_id")


def _in_field(q: Q.Query, name: str) -> Q.Query | None:
    """What of a query concerns one field."""
    if isinstance(q, Q.BooleanQuery):
        kept = [(c, _in_field(c.query, name)) for c in q.clauses if not c.prohibited]
        return Q.BooleanQuery(clauses=tuple(Q.BooleanClause(x) for _, x in kept if x is not None))
    if isinstance(q, Q.FilteredQuery):
        return _in_field(q.query, name)
    if isinstance(q, (Q.MatchAllQuery, Q.ConstantScoreQuery)):
        return None
    own = Q.span_field(q) if isinstance(q, Q.SPANS) else q.field
    return q if own == name else None


def iterate(df: DataFrame) -> Iterator[dict]:
    """Rows one by one, a partition at a time."""
    for row in df.toLocalIterator():
        yield row.asDict(recursive=True)
