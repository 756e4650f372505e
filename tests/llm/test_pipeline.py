"""Every stage of the pipeline against a plain version, on what its predecessor kept."""

import random

import pytest

import corpus_pipeline
from textloom.llm import line_crf
from textloom.llm.queries import byte_bpe

from . import brute
from .test_documents import ODD, corpus


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    texts = dict(corpus(seed=11, size=90))
    junk = {i: "\n".join(" ".join(x.upper() + "!!" for x in rng.choices(["buy", "now", "cheap", "free"], k=15)) for _ in range(3)) for i in range(500, 540)}
    rows = [(i, t, rng.choice(["en", None]), "src", None if t is None else len(t)) for i, t in (texts | junk).items()]
    clean = [t for t in texts.values() if t and len(t.split()) > 12]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 500), 0) for i in [*texts, *junk] if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(rng.sample(clean, 4))), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    import pyarrow as pa

    good = sorted((i, t) for i, t in texts.items() if model.score(pa.array([t or ""]))[0] >= 0.3)
    kept = corpus_pipeline.quality(spark, docs, sf_dir).cache()
    assert [(i, t or "") for i, t in rows_of(kept.na.fill({"text": ""}))] == [(i, t or "") for i, t in good]
    assert len(good) == len(texts) - 40 and kept.columns == corpus_pipeline.COLUMNS

    lines = [(i, t) for i, _, _, t in brute.kept_lines(good)]
    deduped = corpus_pipeline.line_dedup(spark, kept, sf_dir).cache()
    assert rows_of(deduped) == lines and lines != good
    assert all(r["n_chars"] == len(r["text"]) for r in deduped.collect())

    first = [(i, t) for (i, t), (_, _, c) in zip(lines, brute.components(lines), strict=True) if i == c]
    unique = corpus_pipeline.near_dedup(spark, deduped, sf_dir).cache()
    assert rows_of(unique) == first and len(first) < len(lines)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {d for d, _ in brute.contaminated(first, items)}
    pure = corpus_pipeline.decontamination(spark, unique, sf_dir).cache()
    assert rows_of(pure) == [(i, t) for i, t in first if i not in held] and held

    library = byte_bpe().load()
    got = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in corpus_pipeline.tokens(spark, pure, sf_dir).collect()}
    assert got == {i: (len(x), x) for i, t in first if i not in held for x in [library.encode(t, add_special_tokens=False).ids]}
    assert {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()} == got


def test_near_dedup_keeps_one_of_repeated_rows(spark, sf_dir):
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, words), (1, words), (2, words), (3, "other " + words[:30]), (3, "other " + words[:30]), (None, words), (None, words), (4, None), (4, None), (5, words + " thirteen")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    got = sorted(corpus_pipeline.near_dedup(spark, docs, sf_dir).collect(), key=str)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got if r["text"]) == sorted([("1", words), ("3", "other " + words[:30]), ("None", words), ("None", words)])
    assert [r["doc_id"] for r in got if not r["text"]] == [4] and got[0].asDict().keys() == dict.fromkeys(corpus_pipeline.COLUMNS).keys()


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        assert i == 4 or out.columns == corpus_pipeline.COLUMNS
    assert len(ODD) > 5
