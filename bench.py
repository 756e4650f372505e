"""Headline queries, timed: indexing, a batch of term queries, and one query of each kind. Prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from textloom.functions import analysis
from textloom.operators.index import SearchIndex
from textloom.operators.search import Searcher
from textloom.plans import registry
from textloom.sources import store


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The table is one file with one row group: without this, one task would analyze it all.
    docs = registry.documents(spark, sf).select("doc_id", "text").repartition(int(cpus))
    n, folder = docs.count(), tempfile.mkdtemp()
    times: dict[str, float] = {}
    extra: dict[str, float] = {}
    try:
        build = SearchIndex.build(docs, analyzer=analysis.whitespace_analyzer())
        for name, codec in (("warm_up", "lz4"), ("index_and_write", "lz4"), ("index_and_write_zstd", "zstd")):
            times[name] = timed(lambda name=name, codec=codec: store.save(build, f"{folder}/{name}", codec))
            size = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(f"{folder}/{name}") for f in files)
            extra[f"{name}_mb"] = round(size / 1e6, 1)
        del times["warm_up"], extra["warm_up_mb"]
        extra["docs_per_s"] = round(n / times["index_and_write"])

        whole = registry.index(spark, sf)
        whole.postings.count()
        words = [r["term"] for r in whole.terms("text").orderBy("doc_freq", ascending=False).limit(1000).collect()]
        search = Searcher(whole)
        batch = {w: ("text", w) for w in words}
        times["search_1000_terms"] = timed(lambda: search.search_many(batch, 10).collect())
        extra["queries_per_s"] = round(len(batch) / times["search_1000_terms"])
        # Cold: another session's first queries, on the index as it lies on disk.
        store.save(whole, f"{folder}/stored")
        for name, text in (("cold_term", "text:the"), ("cold_conjunction", "text:(+the +thatingen)"), ("cold_fuzzy", "text:thation~0.6"), ("cold_phrase", 'text:"of the"')):
            times[name] = timed(lambda text=text: Searcher(store.load(spark, f"{folder}/stored", analysis.letter_analyzer())).search(text).hits.collect())
        for name in ("q_term", "q_prefix", "q_fuzzy", "q_phrase_exact", "phrase_sloppy", "b_must", "b_req_opt", "b_must_not", "topk_offset", "span_near", "sort_int_desc", "highlight"):
            registry.QUERIES[name](spark, sf).collect()
            times[name] = timed(lambda name=name: registry.QUERIES[name](spark, sf).collect())
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, **extra}))


if __name__ == "__main__":
    main()
