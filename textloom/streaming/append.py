"""Adding a stream of documents to an index on disk, one micro-batch after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.analysis import Analyzer, PerFieldAnalyzer
from ..operators.index import SearchIndex, with_doc_ids
from ..operators.schema import FieldInfos
from ..sources import store


def append_stream(docs: DataFrame, path: str, analyzer: Analyzer | PerFieldAnalyzer, checkpoint: str, key: list[str] | None = None, fields: FieldInfos | None = None, id_col: str = "doc_id", once: bool = True) -> StreamingQuery:
    """Index what ``docs`` brings; with ``key``, newer documents replace older ones.

    Every micro-batch is a segment of its own, so its cost doesn't follow the
    index's size; the manifest keeps the last batch's number, so that one which
    is repeated after a failure changes nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        if key:  # of a batch's documents with the same key the last one stays
            last = Window.partitionBy(*[F.col(f"`{k}`") for k in key]).orderBy(F.desc(id_col))
            batch = batch.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
        numbered = with_doc_ids(batch.withColumnRenamed(id_col, "__given"), ["__given"]).drop("__given")
        store.append(SearchIndex.build(numbered, FieldInfos.load((fields or FieldInfos()).to_json()), analyzer), path, key=key, mark=(checkpoint, number))

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
