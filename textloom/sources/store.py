"""Indexes as Parquet, with a manifest for each version, and JSON lines."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer, PerFieldAnalyzer
from ..operators.index import MAX_FIELD_LENGTH, SearchIndex, aligned
from ..operators.schema import FieldInfos

CODECS = {"no": "uncompressed", "brotli": "zstd", "bz2": "gzip", "lz4": "lz4"}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset a temporary one, for local sessions only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="textloom-")


class LockError(RuntimeError):
    pass


@dataclass
class Directory:
    """A folder in any file system that Spark reaches, through Hadoop's interface."""

    spark: SparkSession
    path: str

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def touch(self, name: str) -> None:
        self._fs.create(self._at(name), True).close()

    def create_new(self, name: str) -> bool:
        self._fs.mkdirs(self._at())
        return self._fs.createNewFile(self._at(name))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._at(name), True)

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._at(old), self._at(new))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at())) if self.exists() else []

    def __iter__(self):
        return iter(self.names())

    def size(self, name: str = "") -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()

    def file_count(self) -> int:
        return len(self.names())

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect())

    @contextmanager
    def lock(self, name: str = "write", seconds: float = 10.0):
        """Held by whoever could create the lock's file; others wait, and give up after ``seconds``. ``break_lock`` frees what a crash has left."""
        end = time.monotonic() + seconds
        while not self.create_new(f"{name}.lock"):
            if time.monotonic() > end:
                raise LockError(f"{self.path} is locked for {name}")
            time.sleep(0.05)
        try:
            yield
        finally:
            self.delete(f"{name}.lock")

    def break_lock(self, name: str = "write", older_than: float = 3600.0) -> bool:
        """Free a lock that is so many seconds old: whoever held it is gone."""
        if not self.locked(name):
            return False
        made = self._fs.getFileStatus(self._at(f"{name}.lock")).getModificationTime() / 1000
        return time.time() - made >= older_than and self.delete(f"{name}.lock")

    def locked(self, name: str = "write") -> bool:
        return self.exists(f"{name}.lock")


#: Ten segments of a size class become one of the next.
MERGE_FACTOR = 10
#: So many bytes of segments' postings make a part of the merged ones: a task sorts some twenty times as much in memory.
MERGED_PART = 16 << 20


def save(index: SearchIndex, path: str, codec: str = "lz4", partitions: int | None = None) -> int:
    """Write the whole index as one segment of a new version, and return the version's number.

    Postings stay with the task that made them, which sorts them by field and
    term: nothing is shuffled, a query's terms are found by the statistics of
    few row groups and pages of each part, and a frequent term has a share in
    every part (``partitions`` deals them by field and term to so many parts
    instead). The dictionary is counted from the postings that were written,
    if the index has none. The manifest is written last: readers see the
    old version or the new one. An index that is the last version's already,
    table by table, isn't written again: the new version shares its segment.
    """
    where = Directory(index.spark, path)
    tables, how = (index.stored, index.postings, index.norms, index.deletes), (path, codec, partitions)
    with where.lock():
        now = version(where)
        was, one, deletes = index._memo.get("saved", {}).get(how, ((None,) * 4, None, None))
        same = one is not None and now and all(a is b for a, b in zip(was, tables, strict=True))
        if not same or [_manifest(where, now)[k] for k in ("segments", "deletes")] != [[one], deletes]:
            one, deletes = _segment(index, path, f"v{now + 1:08d}", codec, partitions), None
            if index.deletes is not None:
                deletes = f"{one['data']}/deletes"
                index.deletes.write.option("compression", codec).parquet(f"{path}/{deletes}")
            index._memo["saved"] = index._memo.get("saved", {}) | {how: (tables, one, deletes)}
        _publish(where, now + 1, [one], deletes, index.max_doc, index.max_field_length, index.fields)
    return now + 1


def append(index: SearchIndex, path: str, codec: str = "lz4", merge_factor: int = MERGE_FACTOR, key: list[str] | None = None, mark: tuple[str, int] | None = None) -> int:
    """Add an index's documents to those on disk, numbered on from the last, as a segment of their own.

    What is there already isn't rewritten: the cost follows the documents that
    are added. Segments whose sizes lie between the same powers of
    ``merge_factor`` become one as soon as there are that many, so that each
    document is written again once for every power at most. With ``key``, what
    is added replaces documents with the same values; deletions are a list,
    until ``compact``. With ``mark``, a source's name and a number that goes
    up, what was added under it once isn't added again.
    """
    where = Directory(index.spark, path)
    with where.lock():
        now = version(where)
        if not now:
            old, held, deletes, base, marks = None, [], None, 0, {}
        else:
            manifest = _manifest(where, now)
            old, held, deletes, base = load(index.spark, path, index.analyzer, now), manifest["segments"], manifest["deletes"], manifest["max_doc"]
            marks = manifest.get("marks", {})
        if mark and marks.get(mark[0], -1) >= mark[1]:
            return now
        new = index if not base else replace(index, **{t: getattr(index, t).withColumn("doc_id", F.col("doc_id") + base) for t in ("stored", "postings", "norms")}, _memo={})
        if index.deletes is not None:
            gone = index.deletes.withColumn("doc_id", F.col("doc_id") + base)
            new = replace(new, **{t: getattr(new, t).join(gone, "doc_id", "left_anti") for t in ("stored", "postings", "norms")}, deletes=None, dictionary=None, _memo={})
        label = f"v{now + 1:08d}"
        held = [*held, _segment(new, path, label, codec, None)]
        if key and old is not None:
            same = reduce(lambda a, b: a & b, [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in key])
            gone = old.docs().alias("o").join(index.docs().select(*key).alias("n"), same, "left_semi").select("doc_id")
            if not gone.isEmpty():
                every = gone if old.deletes is None else gone.unionByName(old.deletes).distinct()
                deletes = f"{held[-1]['data']}/deletes"
                every.write.option("compression", codec).parquet(f"{path}/{deletes}")
        fields = index.fields if old is None else FieldInfos(old.fields.default, dict(index.fields.specs | old.fields.specs))
        while small := _crowded(held, merge_factor):
            merged = _read(index.spark, path, small)
            size = sum(where.size(f"{x['data']}/postings") for x in small)
            together = merged["postings"].coalesce(-(-size // MERGED_PART) or 1)
            one = _segment(SearchIndex(merged["stored"], together, merged["norms"], fields, index.analyzer, dictionary=merged["dictionary"]), path, label, codec, None)
            held = [x for x in held if x not in small] + [one]
        _publish(where, now + 1, held, deletes, base + index.max_doc, index.max_field_length, fields, marks | dict([mark] if mark else []))
    return now + 1


def _crowded(held: list[dict], merge_factor: int) -> list[dict] | None:
    """The segments of the smallest size class that has ``merge_factor`` of them."""
    classes: dict[int, list[dict]] = {}
    for s in held:
        size = 0
        while s["docs"] >= merge_factor ** (size + 1):
            size += 1
        classes.setdefault(size, []).append(s)
    return next((classes[k] for k in sorted(classes) if len(classes[k]) >= merge_factor), None)


def _segment(index: SearchIndex, path: str, label: str, codec: str, partitions: int | None) -> dict:
    """Write a segment's tables; stored fields with a codec of their own are a table each."""
    name = f"{label}-{uuid.uuid4().hex[:8]}"
    dealt = index.postings.repartition(partitions, "field", "term", F.pmod(F.xxhash64("doc_id"), F.lit(partitions))) if partitions else index.postings
    dealt.sortWithinPartitions("field", "term", "doc_id").write.option("compression", codec).partitionBy("field").parquet(f"{path}/{name}/postings")
    own = {c: CODECS[index.fields[c].compression] for c in index.stored.columns if c != "doc_id" and index.fields[c].compression != "no"}
    apart = sorted(c for c, x in own.items() if x != codec)
    index.stored.drop(*apart).write.option("compression", codec).parquet(f"{path}/{name}/stored")
    for i, c in enumerate(apart):
        index.stored.select("doc_id", F.col(f"`{c}`")).write.option("compression", own[c]).parquet(f"{path}/{name}/stored-{i}")
    index.norms.write.option("compression", codec).parquet(f"{path}/{name}/norms")
    written = index.spark.read.schema(index.postings.schema).parquet(f"{path}/{name}/postings")
    replace(index, postings=written, _memo={}).term_stats.sortWithinPartitions("field", "term").write.option("compression", codec).parquet(f"{path}/{name}/dictionary")
    docs = index.spark.read.parquet(f"{path}/{name}/stored").count()
    return {"data": name, "docs": docs, "apart": len(apart)}


def _publish(where: Directory, number: int, held: list[dict], deletes: str | None, max_doc: int, max_field_length: int | None, fields: FieldInfos, marks: dict[str, int] | None = None) -> None:
    where.write(f"manifest-{number:08d}.json", json.dumps({"version": number, "segments": held, "deletes": deletes, "max_doc": max_doc, "max_field_length": max_field_length, "fields": json.loads(fields.to_json()), "marks": marks or {}}))


def _manifest(where: Directory, number: int) -> dict:
    return json.loads(where.read(f"manifest-{number:08d}.json"))


def segments(spark: SparkSession, path: str, at: int | None = None) -> list[dict]:
    """The segments of a version: their folders and numbers of documents."""
    where = Directory(spark, path)
    return _manifest(where, at or version(where))["segments"]


def version(where: Directory) -> int:
    found = [int(x[9:17]) for x in where.names() if x.startswith("manifest-")]
    return max(found, default=0)


def _read(spark: SparkSession, path: str, held: list[dict]) -> dict[str, DataFrame]:
    """The tables of some segments as one each."""

    def stored(s: dict) -> DataFrame:
        parts = [spark.read.parquet(f"{path}/{s['data']}/{t}") for t in ("stored", *(f"stored-{i}" for i in range(s["apart"])))]
        return reduce(lambda a, b: a.join(b, "doc_id"), parts)

    def whole(frames: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: (lambda x, y: x.unionByName(y, allowMissingColumns=True))(*aligned(a, b)), frames)

    tables = {t: whole([spark.read.parquet(f"{path}/{s['data']}/{t}") for s in held]) for t in ("postings", "norms", "dictionary")}
    if len(held) > 1:
        tables["dictionary"] = tables["dictionary"].groupBy("field", "term").agg(F.sum("doc_freq").alias("doc_freq"), F.sum("total_freq").alias("total_freq"))
    tables["postings"] = tables["postings"].select("field", "term", "doc_id", "freq", "positions", "norm")
    return tables | {"stored": whole([stored(s) for s in held])}


def load(spark: SparkSession, path: str, analyzer: Analyzer | PerFieldAnalyzer, at: int | None = None) -> SearchIndex:
    where = Directory(spark, path)
    manifest = _manifest(where, at or version(where))
    tables = _read(spark, path, manifest["segments"])
    deletes = spark.read.parquet(f"{path}/{manifest['deletes']}") if manifest["deletes"] else None
    return SearchIndex(tables["stored"], tables["postings"], tables["norms"], FieldInfos.load(json.dumps(manifest["fields"])), analyzer, deletes, manifest["max_doc"], manifest.get("max_field_length", MAX_FIELD_LENGTH), tables["dictionary"])


def is_latest(spark: SparkSession, path: str, at: int) -> bool:
    return version(Directory(spark, path)) == at


def compact(spark: SparkSession, path: str, analyzer: Analyzer | PerFieldAnalyzer, codec: str = "lz4") -> int:
    """Rewrite the last version without its deleted documents."""
    return save(replace(load(spark, path, analyzer).optimize()), path, codec)


def settled(index: SearchIndex) -> SearchIndex:
    """The index with its tables written out and read again, so that a chain of changes makes no chain of plans.

    The tables go to the folder in ``spark.checkpoint.dir``, or where that is
    unset to a temporary one.
    """
    spark = index.spark
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"

    def again(df: DataFrame | None, name: str) -> DataFrame | None:
        if df is None:
            return None
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    return replace(index, stored=again(index.stored, "stored"), postings=again(index.postings, "postings"), norms=again(index.norms, "norms"), deletes=again(index.deletes, "deletes"), dictionary=again(index.dictionary, "dictionary"), _memo={})


def export_jsonl(index: SearchIndex, path: str) -> None:
    index.docs().write.mode("overwrite").json(path)


def import_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)
