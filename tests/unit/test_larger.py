"""What larger inputs showed: work and memory that grow with the text alone, and rows that the SQL doesn't have."""

import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import analysis
from textloom.functions.analysis import Analyzer, HyphenFilter, LowerCaseFilter, MappingFilter, StemFilter
from textloom.operators.index import SearchIndex
from textloom.plans import registry
from textloom.sources import store


def test_many_hyphens_in_one_text(spark):
    n, analyzer = 20_000, Analyzer(analysis.WHITESPACE, (LowerCaseFilter(), HyphenFilter()))
    began = time.monotonic()
    got = spark.createDataFrame([("Pre-war " * n,)], "t string").select(F.inline(analyzer.column(F.col("t")))).orderBy("pos", "term").collect()
    assert time.monotonic() - began < 60
    assert len(got) == 3 * n and [tuple(r) for r in got[:3]] == [("pre", 0), ("prewar", 0), ("war", 1)] and max(r["pos"] for r in got) == 2 * n - 1


@pytest.mark.parametrize("filters", [(StemFilter(),), (MappingFilter((("th", "z"),)),), (HyphenFilter(),)])
@pytest.mark.parametrize("places", [False, True])
def test_tokens_leave_a_worker_in_pieces(filters, places):
    texts = pa.array(["the well-known " * 5000, None, ""] * 40)
    analyzer = Analyzer(analysis.WHITESPACE, filters)
    pieces = list(analyzer._function(places=places).func(iter([texts])))
    most = len(analyzer.tokens(texts[0].as_py()))
    assert sum(map(len, pieces)) == len(texts) and max(len(p.flatten()) for p in pieces) < analysis.PIECE + most
    assert [len(x) for p in pieces for x in p.to_pylist()] == [most, 0, 0] * 40


def test_several_values_with_python_parts(spark):
    docs = spark.createDataFrame([(0, ["Cats running", None, "", "dogs"])], "doc_id long, tags array<string>")
    index = SearchIndex.build(docs, analyzer=Analyzer(analysis.LETTER, (LowerCaseFilter(), StemFilter())))
    assert {r["term"]: r["positions"] for r in index.postings.collect()} == {"cat": [0], "run": [1], "dog": [2]}


def test_plain_words_take_no_detour(monkeypatch):
    text = "Plain words, with marks. And one: well (so) 2024. " * 50
    seen = []
    one = analysis.StandardTokenizer._one
    monkeypatch.setattr(analysis.StandardTokenizer, "_one", lambda self, s, a: seen.append(a) or one(self, s, a))
    assert [t.text for t in analysis.STANDARD.tokens(text)] == ["Plain", "words", "with", "marks", "And", "one", "well", "so", "2024"] * 50
    assert not seen


@pytest.fixture()
def folder(spark, tmp_path):
    """Documents with a word beyond the engine's bound of tokens, with nulls, and without letters."""
    rows = [(0, "a " * 10_500 + "the", "de", "s"), (1, "the end", None, "s"), (2, "1234 !", "en", None), (3, None, "es", "s"), (4, "the", "fr", "s")]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def by_sql(name, folder):
    """The rows of a registered query's SQL."""
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return sorted(map(repr, db.sql(registry.ORACLES[name]).fetchall()))


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_facade_indexes_whole_texts(spark, folder):
    assert rows(registry.QUERIES["facade"](spark, folder)) == by_sql("facade", folder)


@pytest.mark.parametrize("name", ["norms", "field_length"])
def test_fields_without_tokens(spark, folder, name):
    assert rows(registry.QUERIES[name](spark, folder)) == by_sql(name, folder)


def test_postings_are_made_without_a_shuffle(spark):
    docs = spark.createDataFrame([(0, "b a b A", ["x y", "y"]), (1, "", None), (2, None, []), (3, "c", ["z"])], "doc_id long, text string, tags array<string>")
    index = SearchIndex.build(docs)
    got = {(r["field"], r["term"], r["doc_id"]): (r["freq"], r["positions"]) for r in index.postings.collect()}
    assert got == {("text", "a", 0): (2, [1, 3]), ("text", "b", 0): (2, [0, 2]), ("text", "c", 3): (1, [0]), ("tags", "x", 0): (1, [0]), ("tags", "y", 0): (2, [1, 2]), ("tags", "z", 3): (1, [0])}
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()


def test_an_unchanged_index_is_written_once(spark, tmp_path):
    path, other = str(tmp_path / "a"), str(tmp_path / "b")
    index = SearchIndex.build(spark.createDataFrame([(0, "one two"), (1, "two")], "doc_id long, text string"))
    assert [store.save(index, path) for _ in range(2)] == [1, 2] and store.segments(spark, path, 1) == store.segments(spark, path, 2)
    assert store.load(spark, path, index.analyzer).docs().count() == 2 and not store.is_latest(spark, path, 1)
    fewer = index.delete_terms("text", "one")
    assert [store.save(fewer, path) for _ in range(2)] == [3, 4] and store.segments(spark, path, 3) != store.segments(spark, path, 2)
    assert [store.load(spark, path, index.analyzer, k).num_docs() for k in (2, 3, 4)] == [2, 1, 1]
    assert store.save(index, path) == 5 and store.segments(spark, path) != store.segments(spark, path, 4) and store.load(spark, path, index.analyzer).num_docs() == 2
    assert store.save(index, path, codec="zstd") == 6 and store.segments(spark, path) != store.segments(spark, path, 5)
    assert store.save(index, other) == 1 and store.load(spark, other, index.analyzer).num_docs() == 2


def test_an_index_is_written_without_a_shuffle_of_its_postings(spark, tmp_path):
    path, each = str(tmp_path / "index"), 40
    for k in range(2):
        docs = spark.range(k * each, (k + 1) * each, numPartitions=4).select(F.col("id").alias("doc_id"), F.format_string("same d%d", "id").alias("text"))
        part = SearchIndex.build(docs.withColumn("doc_id", F.col("doc_id") - k * each))
        store.append(part, path, merge_factor=2 if k else 10)
        if not k:
            files = spark.read.parquet(f"{path}/{store.segments(spark, path)[0]['data']}/postings").withColumn("file", F.input_file_name())
            found = [(r["file"], r["term"], r["doc_id"]) for r in files.collect()]
            assert {f: sum(x[0] == f and x[1] == "same" for x in found) for f, _, _ in found} == dict.fromkeys({x[0] for x in found}, each / 4)
            assert all(a[0] != b[0] or a[1:] < b[1:] for a, b in zip(found, found[1:], strict=False)) and len({x[0] for x in found}) == 4
    one = store.segments(spark, path)
    back = store.load(spark, path, SearchIndex.build(docs).analyzer)
    assert len(one) == 1 and spark.read.parquet(f"{path}/{one[0]['data']}/postings").select(F.input_file_name()).distinct().count() == 1
    assert [r["doc_id"] for r in back.term_docs("text", "same").collect()] == list(range(2 * each)) and back.doc_freq("text", "same") == 2 * each
