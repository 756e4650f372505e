"""Strings that sort as the numbers and times that they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Precisions of dates and times, and their formats.
FORMATS = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH", "minute": "yyyyMMddHHmm", "second": "yyyyMMddHHmmss"}


def int_to_lex(n: Column) -> Column:
    """Four digits of length and the digits; negative numbers by ten's complement behind a minus sign.

    Both parts are complemented for a negative number, so that a longer one
    sorts before a shorter one.
    """
    digits = F.abs(n).cast("string")
    size = F.length(digits)
    plus = F.concat(F.lpad(size.cast("string"), 4, "0"), digits)
    complement = F.lpad((F.rpad(F.lit("1"), size + 1, F.lit("0")).cast("decimal(38,0)") - F.abs(n).cast("decimal(38,0)")).cast("string"), size, F.lit("0"))
    minus = F.concat(F.lit("-"), F.lpad((10000 - size).cast("string"), 4, "0"), complement)
    return F.when(n < 0, minus).otherwise(plus)


def lex_to_int(text: Column) -> Column:
    """What ``int_to_lex`` was given."""
    negative = text.startswith("-")
    digits = F.when(negative, F.substr(text, F.lit(6))).otherwise(F.substr(text, F.lit(5)))
    value = digits.cast("decimal(38,0)")
    return F.when(negative, value - F.rpad(F.lit("1"), F.length(digits) + 1, F.lit("0")).cast("decimal(38,0)")).otherwise(value).cast("long")


def int_to_pad(n: Column, width: int = 10) -> Column:
    """Right-aligned with spaces; longer numbers stay whole."""
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def time_to_lex(t: Column, precision: str = "second") -> Column:
    return F.date_format(t, FORMATS[precision])


def lex_to_time(text: Column) -> Column:
    """A timestamp from any of the precisions."""
    padded = F.concat(text, F.substr(F.lit("00000101000000"), F.length(text) + 1))
    return F.to_timestamp(padded, FORMATS["second"])


def lex_to_date(text: Column) -> Column:
    return lex_to_time(text).cast("date")
