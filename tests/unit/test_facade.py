import json

import pytest
from pyspark.sql import functions as F

from textloom.functions.analysis import whitespace_analyzer
from textloom.operators.facade import BestOf, Index
from textloom.streaming.append import append_stream


def ids(index, q):
    return sorted(r["id"] for r in index.state.docs().join(index.searcher.hits(q), "doc_id", "left_semi").collect())


def test_life_of_an_index(spark, tmp_path):
    index = Index(spark, key="id", analyzer=whitespace_analyzer(), default_field="text")
    assert index.size() == 0 and list(index) == []
    with pytest.raises(LookupError):
        index.search("x")
    index.add([{"id": "a", "text": "one two", "n": 3}, {"id": "b", "text": "two three"}, {"id": "a", "text": "four", "n": 4}])
    assert index.size() == 2 and ids(index, "two") == ["b"] and index.doc("a")["text"] == "four" and index[0]["id"] == "b"
    index << {"id": "b", "text": "five"}
    assert index.size() == 2 and ids(index, "two") == [] and ids(index, "text:five") == ["b"] and index.has_deletions()
    index.batch_update([{"id": "a", "text": "six"}, {"id": "c", "text": "six seven"}])
    assert ids(index, "six") == ["a", "c"] and [h["doc_id"] for h in index.scan("six").collect()] == sorted(h["doc_id"] for h in index.scan("six").collect())
    index.query_update("seven", {"text": "eight"})
    assert ids(index, "eight") == ["c"] and ids(index, "seven") == []
    index.update("c", {"id": "c", "text": "nine"})
    assert ids(index, "nine") == ["c"] and index.size() == 3
    index.delete("c")
    assert index.size() == 2 and index.doc("c") is None
    index.query_delete("six")
    assert [d["id"] for d in index] == ["b"]
    assert index.optimize().state.max_doc == 1 and index.doc(-1)["id"] == "b" and index[0:1][0]["id"] == "b"
    assert index.explain("five", 0).value > 0 and "five" in index.explain("five", 0).to_s() and "<li>" in index.explain("five", 0).to_html()
    assert index.highlight("five", "text").first()["excerpts"] == ["<b>five</b>"]

    assert index.persist(str(tmp_path / "i")) == 1
    again = Index(spark, str(tmp_path / "i"), analyzer=whitespace_analyzer(), default_field="text", key="id")
    assert ids(again, "five") == ["b"] and again.add([{"id": "z", "text": "ten"}]).commit() == 2
    again.export_jsonl(str(tmp_path / "lines"))
    copy = Index(spark, analyzer=whitespace_analyzer(), default_field="text").import_jsonl(str(tmp_path / "lines"))
    assert ids(copy, "five ten") == ["b", "z"]
    assert copy.add_indexes(again.state).size() == 4
    assert json.loads(copy.search("ten").to_json())[0]["score"] > 0 and "total_hits = 2" in str(copy.search("ten"))


def test_values_of_many_kinds(spark):
    index = Index(spark, analyzer=whitespace_analyzer(), default_input_field="text", default_field="text")
    index.add([["one two", "three"], "four"]).add([{"text": 5}])
    assert [r["doc_id"] for r in index.searcher.hits('"two three"').collect()] == [0]
    assert [r["doc_id"] for r in index.searcher.hits("5").collect()] == [2]


def test_best_of():
    best = BestOf(3)
    for x in (5, 1, 9, 7, 3):
        best.insert(x)
    assert len(best) == 3 and best.top() == 5 and [best.pop() for _ in range(4)] == [5, 7, 9, None]


def test_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "doc_id long, key string, text string"
    for batch in ([(0, "a", "one"), (1, "b", "two")], [(0, "a", "three"), (1, "c", "one")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        append_stream(stream, path, whitespace_analyzer(), str(tmp_path / "state"), key=["key"]).awaitTermination()
    index = Index(spark, path, analyzer=whitespace_analyzer())
    got = {r["key"]: r["text"] for r in index.state.docs().select(F.col("key"), F.col("text")).collect()}
    assert got == {"a": "three", "b": "two", "c": "one"}
