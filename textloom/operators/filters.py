"""Filters: each gives the documents that it lets through."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import Query, RangeQuery

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_HEX = r"[+-]?0[xX][0-9a-fA-F]+"


def parse_number(text: str) -> float | None:
    if re.fullmatch(_HEX, text):
        return float(int(text, 16))
    return float(text) if re.fullmatch(_NUMBER, text) else None


def number_of(term: Column) -> Column:
    """The number that a whole term is, or null. Terms below "+." or beyond the digits are none."""
    sign = F.when(term.startswith("-"), -1.0).otherwise(1.0)
    hexadecimal = sign * F.conv(F.regexp_replace(term, r"\A[+-]?0[xX]", ""), 16, 10).cast("double")
    value = F.when(term.rlike(rf"\A{_HEX}\z"), hexadecimal).when(term.rlike(rf"\A{_NUMBER}\z"), term.try_cast("double"))
    return F.when((term >= "+.") & (F.left(term, F.lit(1)) <= "9"), value)


def range_condition(term: Column, q: RangeQuery) -> Column:
    """The terms of a range, by bytes; if it is typed and its bounds are numbers, by number."""
    if q.typed:
        low, high = (None if x is None else parse_number(x) for x in (q.lower, q.upper))
        if (low is not None or q.lower is None) and (high is not None or q.upper is None):
            value, ok = number_of(term), F.lit(True)
            if low is not None:
                ok &= value >= low if q.include_lower else value > low
            if high is not None:
                ok &= value <= high if q.include_upper else value < high
            return ok & value.isNotNull()
    ok = F.lit(True)
    if q.lower is not None:
        ok &= term >= q.lower if q.include_lower else term > q.lower
    if q.upper is not None:
        ok &= term <= q.upper if q.include_upper else term < q.upper
    return ok


@dataclass(frozen=True)
class RangeFilter:
    query: RangeQuery

    def docs(self, index) -> DataFrame:
        q = self.query
        return index.postings.filter((F.col("field") == q.field) & range_condition(F.col("term"), q)).select("doc_id").distinct()

    def __str__(self) -> str:
        return self.query.to_s()


@dataclass(frozen=True)
class QueryFilter:
    query: Query

    def docs(self, index) -> DataFrame:
        from .planner import Planner

        return Planner(index).hits(self.query).select("doc_id")

    def __str__(self) -> str:
        return f"QueryFilter({self.query})"


@dataclass(frozen=True)
class DocsFilter:
    """Any DataFrame with doc_id, or a function from the index to one."""

    source: Any

    def docs(self, index) -> DataFrame:
        got = self.source(index) if callable(self.source) else self.source
        return got.select("doc_id").distinct()


# Sets of documents
def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").intersect(b.select("doc_id"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").subtract(b.select("doc_id"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("doc_id").distinct().union(b.select("doc_id").distinct())
    return both.groupBy("doc_id").count().filter(F.col("count") == 1).select("doc_id")
