"""The operators on pages and captures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm.url_filter import Automaton, judge_urls, rule
from textloom.llm.warc import KEPT_FIELDS, canonical_url, header_map, resolve_revisits


def glob_regex(glob):
    out = ""
    for part in re.split(r"(\*+|\?)", glob):
        out += "[^/]*" if part == "*" else "(?s:.*)" if part.startswith("*") else "[^/]" if part == "?" else re.escape(part)
    return re.compile(out)


def test_automaton_against_regular_expressions():
    import numpy as np

    rng = random.Random(0)
    globs = ["", "*", "**", "a*b?c", "*.x/**", "??", "é*", "a/b", "**/z", "a" * 70 + "*", *("".join(rng.choices("ab/*?é", k=rng.randint(1, 12))) for _ in range(60))]
    texts = ["", "a", "x/", "a" * 70 + "b", "日本", *("".join(rng.choices("ab/éxc.z", k=rng.randint(0, 14))) for _ in range(400))]
    size = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    got = Automaton(globs).match(codes, np.cumsum(size) - size, size)
    assert (got == [[bool(glob_regex(g).fullmatch(t)) for g in globs] for t in texts]).all()


RULES = [rule("allow", "com/"), rule("block", "example.com/en/"), rule("allow", "www.example.com/en/"), rule("block", "net/es/"), rule("block", "net/fr/")]


def test_judging(spark):
    urls = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"), "http://COM/": ("com", "/", "com/", "allow"), "http://a.com": ("a.com", "", None, "allow"), "https://www.Example.com/en/1?q#f": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://blog.example.com/en/": ("blog.example.com", "/en/", "example.com/en/", "block"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "x://evil.org/a.com/": ("evil.org", "/a.com/", None, "allow"),
        "ftp://n.net/fr/é": ("n.net", "/fr/é", "net/fr/", "block"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "a://b://c": ("b:", "//c", None, "allow"), "http://É.net/es/" + "y" * 9000: ("É.net", "/es/" + "y" * 9000, "net/es/", "block"),
        "http://a.com?x": ("a.com", "", None, "allow"), "http://a.com#/x": ("a.com", "", None, "allow"),
    }
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, "http://a.com/x", None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, RULES).collect()]
    assert sorted(got, key=str) == sorted([*urls.values(), urls["http://a.com/x"], urls[None]], key=str)
    assert judge_urls(df.limit(0), RULES).collect() == []
    assert {r["verdict"] for r in judge_urls(df, [], default="block").collect()} == {"block"}


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTP://user@WWW.Example.com:80/a/b/?b=2&a=1&utm_source=x#f", "example.com/a/b?a=1&b=2"), ("https://example.com", "example.com"), ("http://example.com/?gclid=1", "example.com"), ("http://ex.com:8080/A", "ex.com:8080/A"),
        ("nothing", None), (None, None),
    ],
)
def test_canonical_urls(spark, url, expected):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u"))).first()[0] == expected


def test_header_maps(spark):
    block = "HTTP/1.1 304 x\r\nETag:  W/\"a\" \r\nno field\r\netag: last:one\nX-É: no\r\nEmpty:"
    got = spark.createDataFrame([(block,), (None,)], "b string").select(header_map(F.col("b"))).collect()
    assert [r[0] for r in got] == [{"etag": "last:one", "empty": ""}, {}]


def test_revisits(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        # a third of all records are one URL's
        url = "http://hot.org/" if rng.random() < 0.35 else f"https://www.s{rng.randint(0, 9)}.org/?a={rng.randint(0, 1)}"
        tag, since = rng.choice(["", '"a"', 'W/"a"', '"b"']), rng.choice(["", "mon", "tue"])
        head = "".join(f"{k}: {v}\r\n" for k, v in (("ETag", tag), ("Last-Modified", since), ("Content-Length", str(i)), ("X-Id", str(i))) if v)
        rows.append((i, None if i % 97 == 0 else url, None if i % 89 == 0 else rng.randint(0, 60), rng.choice(["response", "revisit", "request", None]), rng.choice([200, 200, 304, None]), None if i % 53 == 0 else head, "x"))
    df = spark.createDataFrame(rows, "record_id long, url string, date long, kind string, http_status int, headers string, status string")
    got = {r["record_id"]: (r["status"], r["original_id"], r["headers"]) for r in resolve_revisits(df.repartition(4)).collect()}

    def fields(block):
        return {k.lower(): v for k, v in (x.split(": ") for x in (block or "").split("\r\n") if x)}

    expected = {}
    for i, url, date, kind, _, head, _ in rows:
        if kind != "revisit":
            continue
        own = fields(head)
        full = [r for r in rows if r[3] == "response" and r[4] == 200 and r[1] == url and url and date is not None and r[2] is not None and r[2] < date]
        best = max(full, key=lambda r: (r[2], r[0]), default=None)
        merged, status = own, "no_original"
        if best:
            theirs = fields(best[5])
            pair = next(((own[k], theirs[k]) for k in ("etag", "last-modified") if k in own and k in theirs), None)
            status = "no_validator" if pair is None else "resolved" if pair[0].removeprefix("W/") == pair[1].removeprefix("W/") else "mismatch"
            if status == "resolved":
                merged = theirs | {k: v for k, v in own.items() if k not in KEPT_FIELDS}
        expected[i] = (status, best[0] if best else None, sorted(f"{k}: {v}" for k, v in merged.items()))
    assert got == expected
    assert {s for s, _, _ in got.values()} == {"resolved", "mismatch", "no_validator", "no_original"}
    assert resolve_revisits(df.limit(0)).collect() == []
