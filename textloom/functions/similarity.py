"""Scoring formulas as columns, and the same for numbers where the planner needs one."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def tf(freq: Column) -> Column:
    return F.sqrt(freq.cast("double"))


def idf(doc_freq: int, max_doc: int) -> float:
    return math.log(max_doc / (doc_freq + 1)) + 1 if max_doc else 0.0


def length_norm(n: Column) -> Column:
    return F.when(n > 0, 1 / F.sqrt(n.cast("double"))).otherwise(0.0)


def stored_norm(x: Column) -> Column:
    """What a norm is after its byte: a power of two times 1, 1.25, 1.5 or 1.75, truncated.

    Fixed values: powers go from -31 to 32; what is larger is the largest, what
    is smaller the smallest, and the byte for 2 ** -31 itself means 0.
    """
    power = F.pow(F.lit(2.0), F.floor(F.log2(x)))
    small, large = 2.0**-31, 2.0**32
    plain = F.when(x >= 2 * large, 1.75 * large).when(x < small, 1.25 * small).when(x < 1.25 * small, 0.0).otherwise(F.floor(x / power * 4) / 4 * power)
    return F.when(x > 0, plain).otherwise(0.0)


def query_norm(squares: float) -> float:
    return 1 / math.sqrt(squares) if squares > 0 else 1.0


def sloppy_freq(distance: float) -> float:
    return 1 / (distance + 1)


def coord(matched: Column, total: int) -> Column:
    return matched / F.lit(float(total))
