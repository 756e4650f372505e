"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of ``documents``, and leaves
further ones out, whatever their names; n_chars follows the text. Null and empty
texts pass the filters that find nothing in them, very long texts are one
document like others, and an empty table gives an empty result.

A document is known by its doc_id. Rows that share one pass or go together
where a document goes as a whole; of repeated rows, which are copies of each
other, near_dedup keeps one. Rows without a doc_id are scored, cleaned and
encoded, but no group of copies and no benchmark item can name them, so that
these two stages keep them. Of equally good copies the smallest id stays, of
shared lines those in the largest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import line_crf
from textloom.llm._spark import staged, table
from textloom.llm.bpe import encode
from textloom.llm.decontaminate import contaminated
from textloom.llm.line_dedup import dedup_lines
from textloom.llm.ngram_join import near_duplicates
from textloom.llm.queries import byte_bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
GOOD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, fitted on all labels, rejects go."""
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    return line_crf.score(docs.select(COLUMNS), model).filter(F.col("score") >= GOOD).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in the last of these only."""
    return dedup_lines(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near copies the document with the smallest id stays."""
    groups = staged(near_duplicates(docs).filter("doc_id is not null"), "groups")
    copies = staged(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    kept = docs.select(COLUMNS).join(copies, "doc_id", "left_anti").select(COLUMNS)
    repeated = staged(groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").select(COLUMNS).dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(COLUMNS).unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    held = staged(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "contaminated")
    return docs.select(COLUMNS).join(held, "doc_id", "left_anti").select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text."""
    return encode(docs.select("doc_id", "source", "text"), byte_bpe()).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
#: The classifier and the components of near copies can't be had from SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
