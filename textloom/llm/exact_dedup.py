"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

Every text is cut where its own content says so, each chunk gets an identifier
that is verified against the chunk's bytes, and documents are equal when their
ordered identifier lists are equal. A text's bytes move once at most, as chunks
that are combined before the shuffle; later steps move identifiers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import staged, text_of

#: Chunks have MIN to MAX characters and end after a vowel, a common consonant and white space.
MIN_CHARS, MAX_CHARS = 512, 4096
BOUNDARY = r"(?<=[aeiou][lnrst][ \n])"
CHUNK = rf"(?s).{{{MIN_CHARS},{MAX_CHARS}}}?(?:{BOUNDARY}|\z)|.{{{MAX_CHARS}}}|.+"


def chunks(text: Column) -> Column:
    """Cut ``text`` into consecutive chunks; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk, F.length(chunk))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_of: Callable[[Column], Column] = chunk_hash,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    The largest id of equal texts stays. Null counts as the empty text; rows
    that repeat an id count as rows of their own, with the same text or with
    another; very long texts are many chunks; an empty table gives an empty
    result; further columns of ``docs`` are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    cut, sha = chunks(F.col("t")), F.sha2(F.col("t"), 256)

    # Verified identifiers: a hash stands for a chunk unless two contents share it.
    contents = rows.select(F.explode(cut).alias("c")).select(hash_of(F.col("c")).alias("h"), "c").groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"))
    clashes = staged(contents.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "clashes")
    recipes = rows.select("id", F.transform(cut, hash_of).alias("recipe"), sha.alias("sha"))
    none = F.array().cast("array<struct<pos:int,number:int>>")
    if clashes.isEmpty():  # no text to look up
        recipes = recipes.withColumn("marks", none)
    else:
        recipes = recipes.join(_marks(rows, contents, clashes, hash_of), "sha", "left").withColumn("marks", F.coalesce("marks", none))
    recipes = staged(recipes, "recipes")

    groups = staged(recipes.groupBy("recipe", "marks").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    out = recipes.join(groups, ["recipe", "marks"], "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.coalesce("keep", "id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep") == F.col("id"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _marks(rows: DataFrame, contents: DataFrame, clashes: DataFrame, hash_of) -> DataFrame:
    """(sha, marks) of the texts with chunks whose hash stands for several contents.

    The contents of such a hash are numbered, and a text's marks say which one
    stands at each of its places; so hash and number together are injective.
    Only clashing chunks move as text, once for each different text; rows find
    their text's marks by its digest, so that rows are neither lost nor merged.
    """
    number = F.row_number().over(Window.partitionBy("h").orderBy("c"))
    named = staged(contents.join(clashes, "h", "left_semi").select("h", "c", number.alias("number")), "named")
    places = rows.select(F.sha2("t", 256).alias("sha"), F.posexplode(chunks(F.col("t"))).alias("pos", "c")).withColumn("h", hash_of(F.col("c")))
    seen = places.join(clashes, "h", "left_semi").distinct().join(named, ["h", "c"])
    return seen.groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("pos", "number"))).alias("marks"))
