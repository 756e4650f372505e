"""One object for an index and everything that is done with it; changes give it a new state."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer, PerFieldAnalyzer, standard_analyzer
from ..plans.parser import QueryParser
from ..sources import store
from . import query as Q
from .index import MAX_FIELD_LENGTH, SearchIndex, with_doc_ids
from .schema import FieldInfos, FieldSpec
from .search import Explanation, Searcher, TopDocs, iterate

Documents = DataFrame | Iterable[dict | str | list]


class Index:
    """Documents go in as DataFrames or as dictionaries (a string or list is a value of ``default_field``).

    With ``key``, a document replaces those with the same values. With
    ``path``, ``commit`` writes a new version there, and an existing index is
    opened from it, with its own ``max_field_length``. Every state is an immutable set of DataFrames.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, analyzer: Analyzer | PerFieldAnalyzer | None = None, fields: FieldInfos | None = None, default_field: str | list[str] = "*", id_field: str = "id", key: str | list[str] | None = None, create: bool = False, default_input_field: str = "id", max_field_length: int | None = MAX_FIELD_LENGTH, **parsing: Any):
        self.spark, self.path, self.analyzer = spark, path, analyzer or standard_analyzer()
        self.default_field, self.id_field, self.input_field, self.parsing = default_field, id_field, default_input_field, parsing
        self.key = [key] if isinstance(key, str) else key
        self.max_field_length = max_field_length
        self.__dict__["index"] = None
        self.infos = fields or FieldInfos().add(FieldSpec(id_field, index="untokenized"))
        if path and not create and store.version(store.Directory(spark, path)):
            self.__dict__["index"] = store.load(spark, path, self.analyzer)
            self.infos = self.index.fields

    def __setattr__(self, name: str, value: Any) -> None:
        """A changed index is written out at once, or changes would pile up in its plan."""
        super().__setattr__(name, store.settled(value) if name == "index" and value is not None and "index" in self.__dict__ else value)

    # State
    @property
    def state(self) -> SearchIndex:
        if self.index is None:
            raise LookupError("the index has no documents yet")
        return self.index

    @property
    def searcher(self) -> Searcher:
        infos = self.state.fields
        return Searcher(self.state, parser=QueryParser(self.default_field, infos.indexed_fields, infos.tokenized_fields, self.analyzer, **self.parsing))

    @property
    def field_infos(self) -> FieldInfos:
        return self.infos

    def size(self) -> int:
        return 0 if self.index is None else self.index.num_docs()

    def has_deletions(self) -> bool:
        return self.index is not None and self.index.has_deletions()

    def deleted(self, doc_id: int) -> bool:
        return self.state.is_deleted(doc_id)

    def __iter__(self) -> Iterator[dict]:
        return iterate(self.state.docs().orderBy("doc_id")) if self.index is not None else iter(())

    def to_s(self) -> str:
        return "\n".join(str(d) for d in self)

    # Adding
    def _frame(self, documents: Documents) -> DataFrame:
        if isinstance(documents, DataFrame):
            docs = documents
            return docs if "__given" in docs.columns else docs.withColumn("__given", F.monotonically_increasing_id())
        rows = [d if isinstance(d, dict) else {self.input_field: d} for d in documents]
        names = list(dict.fromkeys(n for r in rows for n in r))
        many = {n for r in rows for n, v in r.items() if isinstance(v, (list, tuple))}
        as_text = lambda v: None if v is None else v if isinstance(v, str) else str(v)

        def cell(row: dict, n: str):
            v = row.get(n)
            if n not in many:
                return as_text(v)
            return None if v is None else [as_text(x) for x in (v if isinstance(v, (list, tuple)) else [v])]

        schema = ", ".join(["__given long", *(f"`{n}` {'array<string>' if n in many else 'string'}" for n in names)])
        return self.spark.createDataFrame([(i, *(cell(r, n) for n in names)) for i, r in enumerate(rows)], schema)

    def add(self, documents: Documents, boost_col: str | None = None) -> Index:
        docs = self._frame(documents)
        if self.index is None:
            if self.key:
                from pyspark.sql import Window

                last = Window.partitionBy(*[F.col(f"`{k}`") for k in self.key]).orderBy(F.desc("__given"))
                docs = docs.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
            numbered = with_doc_ids(docs, ["__given"]).drop("__given")
            self.index = SearchIndex.build(numbered, self.infos, self.analyzer, boost_col=boost_col, max_field_length=self.max_field_length)
        else:
            self.index = self.index.add(docs.drop("doc_id").withColumnRenamed("__given", "doc_id"), key=self.key, boost_col=boost_col)
        return self

    add_document = add

    def __lshift__(self, document: dict | str | list) -> Index:
        return self.add([document])

    def add_indexes(self, *others: SearchIndex) -> Index:
        for other in others:
            self.index = other if self.index is None else self.index.merge(other)
        return self

    # Reading
    def process_query(self, query: Q.Query | str) -> Q.Query:
        return self.searcher.query(query)

    def search(self, query: Q.Query | str, **options) -> TopDocs:
        return self.searcher.search(query, **options)

    def search_each(self, query: Q.Query | str, **options) -> DataFrame:
        return self.searcher.search_each(query, **options)

    def scan(self, query: Q.Query | str, start_doc: int = 0, limit: int | None = 50) -> DataFrame:
        return self.searcher.scan(query, start_doc, limit)

    def explain(self, query: Q.Query | str, doc_id: int) -> Explanation:
        return self.searcher.explain(query, doc_id)

    def highlight(self, query: Q.Query | str, field: str, **options) -> DataFrame:
        return self.searcher.highlight(query, field, **options)

    def _ids(self, what: int | str | range | list | DataFrame) -> DataFrame:
        """The numbers of documents that are named by number, range, id term, list of these, or a DataFrame."""
        live = self.state.docs().select("doc_id")
        if isinstance(what, DataFrame):
            return what.select("doc_id")
        if isinstance(what, range):
            return live.filter(F.col("doc_id").between(what.start, what.stop - 1))
        many = what if isinstance(what, list) else [what]
        numbers = [self.state.max_doc + x if x < 0 else x for x in many if isinstance(x, int)]
        terms = [x for x in many if isinstance(x, str)]
        by_id = self.state.postings.filter((F.col("field") == self.id_field) & F.col("term").isin(terms)).select("doc_id")
        return live.filter(F.col("doc_id").isin(numbers)) if not terms else self.state.live(by_id if not numbers else by_id.union(live.filter(F.col("doc_id").isin(numbers))))

    def doc(self, what: int | str) -> dict | None:
        """The first document of that number or id."""
        row = self.state.docs().join(self._ids(what), "doc_id", "left_semi").orderBy("doc_id").first()
        return None if row is None else LazyDoc(row)

    def __getitem__(self, what: int | str | slice):
        if isinstance(what, slice):
            start, stop, _ = what.indices(self.state.max_doc)
            return [LazyDoc(r) for r in self.state.documents(start, stop - start).collect()]
        return self.doc(what)

    # Changing
    def delete(self, what: int | str | range | list | DataFrame) -> Index:
        self.index = self.state.delete_docs(self._ids(what))
        return self

    def query_delete(self, query: Q.Query | str) -> Index:
        self.index = self.state.delete_docs(self.searcher.hits(query))
        return self

    def update(self, what: int | str, document: dict | str) -> Index:
        """Replace documents by another one."""
        return self.delete(what).add([document])

    def batch_update(self, documents: Documents) -> Index:
        """Replace every document whose id (or key) one of the new ones has."""
        docs = self._frame(documents)
        by = self.key or [self.id_field]
        self.index = self.state.add(docs.drop("doc_id").withColumnRenamed("__given", "doc_id"), key=by)
        return self

    def query_update(self, query: Q.Query | str, changes: dict[str, Any]) -> Index:
        """Set fields of all documents that match."""
        self.index = self.state.update(self.searcher.hits(query), {k: v if isinstance(v, Column) else F.lit(v) for k, v in changes.items()})
        return self

    def optimize(self) -> Index:
        self.index = self.state.optimize()
        return self

    def commit(self, codec: str = "lz4") -> int | None:
        """Write the state as a new version, and go on from there."""
        if self.path is None or self.index is None:
            return None
        number = store.save(self.index, self.path, codec)
        self.__dict__["index"] = store.load(self.spark, self.path, self.analyzer)
        return number

    flush = commit

    def persist(self, path: str) -> int:
        self.path = path
        return self.commit()

    def export_jsonl(self, path: str) -> None:
        store.export_jsonl(self.state, path)

    def import_jsonl(self, path: str) -> Index:
        return self.add(store.import_jsonl(self.spark, path).drop("doc_id"))


class LazyDoc(dict):
    """A stored document as a dictionary of its fields that have values, with its number, and some ways to take it apart."""

    def __init__(self, row: Row | dict):
        values = row.asDict(recursive=True) if isinstance(row, Row) else dict(row)
        self.number = values.pop("doc_id", None)
        super().__init__({"doc_id": self.number} | {k: v for k, v in values.items() if v is not None})

    @property
    def fields(self) -> list[str]:
        return [k for k in self if k != "doc_id"]

    def fetch(self, name: str, *default: Any) -> Any:
        return self[name] if name in self or not default else default[0]

    def dig(self, name: str, *rest: Any) -> Any:
        value = self.get(name)
        for key in rest:
            value = value.get(key) if isinstance(value, dict) else value[key] if value is not None and len(value) > key else None
        return value

    def values_at(self, *names: str) -> list[Any]:
        return [self.get(n) for n in names]

    def slice(self, *names: str) -> dict:
        return {n: self[n] for n in names if n in self}

    def without(self, *names: str) -> dict:
        return {k: v for k, v in self.items() if k not in names}

    def select(self, test: Callable[[str, Any], bool]) -> dict:
        return {k: v for k, v in self.items() if test(k, v)}

    def reject(self, test: Callable[[str, Any], bool]) -> dict:
        return {k: v for k, v in self.items() if not test(k, v)}

    def merge(self, other: dict) -> dict:
        return dict(self) | other

    def transform_values(self, change: Callable[[Any], Any]) -> dict:
        return {k: change(v) for k, v in self.items()}

    def transform_keys(self, change: Callable[[str], str]) -> dict:
        return {change(k): v for k, v in self.items()}

    def key_of(self, value: Any) -> str | None:
        return next((k for k, v in self.items() if v == value), None)

    def invert(self) -> dict:
        return {v: k for k, v in self.items()}

    def to_h(self) -> dict:
        return dict(self)


class BestOf:
    """A queue of at most ``capacity`` items that keeps the largest; the least is on top."""

    def __init__(self, capacity: int, rank: Callable[[Any], Any] = lambda x: x):
        self.capacity, self.rank, self._heap, self._n = capacity, rank, [], 0

    def insert(self, item: Any) -> None:
        self._n += 1
        entry = (self.rank(item), self._n, item)
        if len(self._heap) < self.capacity:
            heapq.heappush(self._heap, entry)
        elif self._heap and entry[0] > self._heap[0][0]:
            heapq.heapreplace(self._heap, entry)

    def top(self) -> Any:
        return self._heap[0][2] if self._heap else None

    def pop(self) -> Any:
        return heapq.heappop(self._heap)[2] if self._heap else None

    def clear(self) -> None:
        self._heap.clear()

    def adjust(self) -> None:
        """Put the queue in order again after the top item has changed."""
        if self._heap:
            _, n, item = self._heap[0]
            heapq.heapreplace(self._heap, (self.rank(item), n, item))

    def clone(self) -> BestOf:
        other = BestOf(self.capacity, self.rank)
        other._heap, other._n = list(self._heap), self._n
        return other

    def __len__(self) -> int:
        return len(self._heap)
