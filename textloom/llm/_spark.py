"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts go to Python so many at a time; ten thousand, the default, can be hundreds of MB in every task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS rows, unless they are smaller already.

    Plans are run after the operator has returned, so this can't be undone here.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="textloom-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends at the files, so a lost executor costs a reread and not a
    recomputation; and the reader sees no partitioning, so that adaptive
    execution may split skewed joins on it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/textloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, whatever the locale and script."""
    return F.translate(col, UPPER, LOWER)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def least_count(counts: DataFrame, most: int, n: str = "n", weight: Column | None = None) -> int:
    """The least count so that ``most`` rows at most (or their weights) have it or a higher one.

    What is collected is bounded by the kinds of counts: from 4096 on they are
    told apart by powers of two only.
    """
    kind = F.when(F.col(n) < 4096, F.col(n)).otherwise(F.pow(2.0, F.floor(F.log2(n))).cast("long"))
    least, so_far = 1 << 62, 0
    for r in counts.groupBy(kind.alias("n")).agg(F.sum(F.lit(1) if weight is None else weight).alias("rows")).orderBy(F.desc("n")).collect():
        so_far += r["rows"]
        if so_far > most:
            break
        least = r["n"]
    return least
