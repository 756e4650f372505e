"""Searching: every query against a plain predicate over small made-up documents, then order, paging, changes and storage."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.analysis import letter_analyzer, whitespace_analyzer
from textloom.operators import query as Q
from textloom.operators.filters import DocsFilter, QueryFilter, RangeFilter
from textloom.operators.highlight import Highlighter
from textloom.operators.index import SearchIndex, with_doc_ids
from textloom.operators.planner import rewrite
from textloom.operators.schema import FieldInfos
from textloom.operators.search import FieldSymbol, Searcher, SortField
from textloom.sources import store

RNG = random.Random(31)
VOCABULARY = ["harbour", "harvest", "lantern", "lintel", "meadow", "orchard", "quarry", "river"]
DOCS = [
    {"day": str(20240100 + 7 * i % 29), "path": "/".join(RNG.choices(["north", "south", "east"], k=RNG.randint(1, 3))), "amount": RNG.choice([str(RNG.randint(-30, 30)), f"{RNG.uniform(-30, 30):.3f}", f"+{RNG.uniform(0, 30):.2f}"]), "body": RNG.choices(VOCABULARY, k=RNG.randint(1, 12))}
    for i in range(36)
]


@pytest.fixture(scope="module")
def searcher(spark):
    rows = [(i, d["day"], d["path"], d["amount"], " ".join(d["body"]), 1.0 + i % 5) for i, d in enumerate(DOCS)]
    docs = spark.createDataFrame(rows, "doc_id long, day string, path string, amount string, body string, boost double")
    return Searcher(SearchIndex.build(docs, analyzer=whitespace_analyzer(), boost_col="boost").cached())


def ids(searcher, q, **kw):
    return sorted(r["doc_id"] for r in searcher.hits(q, **kw).collect())


def expected(test):
    return [i for i, d in enumerate(DOCS) if test(d)]


def term(t, field="body"):
    return Q.TermQuery(field, t)


def boolean(*clauses, **kw):
    return Q.BooleanQuery(clauses=tuple(Q.BooleanClause(q, occur) for q, occur in clauses), **kw)


def phrase(*terms, slop=0):
    out = Q.PhraseQuery("body", slop=slop)
    for t in terms:
        out = out.add_term(*t) if isinstance(t, tuple) else out.add_term(t)
    return out


def follows(d, *choices, gap=1):
    return any(all(d["body"][i + k * gap] in c for k, c in enumerate(choices)) for i in range(len(d["body"]) - gap * (len(choices) - 1)))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


A, B, C = term("harbour"), term("lantern"), term("river")
AMOUNT = lambda **kw: Q.RangeQuery("amount", typed=True, **kw)
DAY = lambda **kw: Q.RangeQuery("day", **kw)
has = lambda t: lambda d: t in d["body"]
CASES = [
    (A, has("harbour")), (A.boosted(40), has("harbour")), (term("nothing"), has("nothing")), (term(""), has("")), (Q.MatchAllQuery(), lambda d: True),
    (boolean((A, Q.MUST), (C, Q.MUST)), lambda d: {"harbour", "river"} <= {*d["body"]}), (boolean((A, Q.MUST), (C, Q.MUST), (B, Q.SHOULD)), lambda d: {"harbour", "river"} <= {*d["body"]}),
    (boolean((C, Q.MUST), (B, Q.MUST_NOT)), lambda d: "river" in d["body"] and "lantern" not in d["body"]), (boolean((C, Q.MUST_NOT)), lambda d: "river" not in d["body"]),
    (boolean((C, Q.SHOULD), (B, Q.SHOULD)), lambda d: {"lantern", "river"} & {*d["body"]}), (boolean((A, Q.MUST), (term("nothing"), Q.MUST)), lambda d: False), (boolean((boolean((A, Q.SHOULD), (B, Q.SHOULD)), Q.MUST), (C, Q.MUST)), lambda d: "river" in d["body"] and {"lantern", "harbour"} & {*d["body"]}),
    (phrase("river", "meadow"), lambda d: follows(d, ["river"], ["meadow"])), (phrase("river", ("meadow", 2)), lambda d: follows(d, ["river"], ["meadow"], gap=2)), (phrase(["river", "quarry"], ["meadow", "lintel"]), lambda d: follows(d, ["river", "quarry"], ["meadow", "lintel"])),
    (phrase("river", "meadow", slop=1), lambda d: any(x == "river" and y == "meadow" and abs(j - i - 1) <= 1 for i, x in enumerate(d["body"]) for j, y in enumerate(d["body"]))),
    (DAY(lower="20240105", upper="20240112"), lambda d: "20240105" <= d["day"] <= "20240112"), (DAY(lower="20240105", upper="20240112", include_lower=False), lambda d: "20240105" < d["day"] <= "20240112"), (DAY(lower="20240105", upper="20240112", include_upper=False), lambda d: "20240105" <= d["day"] < "20240112"),
    (DAY(upper="20240107"), lambda d: d["day"] <= "20240107"), (DAY(lower="20240120", include_lower=False), lambda d: d["day"] > "20240120"),
    (AMOUNT(lower="-4", upper="7.5"), lambda d: -4 <= float(d["amount"]) <= 7.5), (AMOUNT(lower="0x8", include_lower=False), lambda d: float(d["amount"]) > 8), (AMOUNT(upper="0.0", include_upper=False), lambda d: float(d["amount"]) < 0), (AMOUNT(lower="1000", upper="2000"), lambda d: False),
    (Q.PrefixQuery("path", "north"), lambda d: d["path"].startswith("north")), (Q.WildcardQuery("path", "*/s?uth*"), lambda d: "/south" in d["path"]), (Q.WildcardQuery("path", "east*"), lambda d: d["path"].startswith("east")), (Q.WildcardQuery("body", "l?nte*"), lambda d: {"lantern", "lintel"} & {*d["body"]}),
    (Q.FuzzyQuery("body", "lanterm", 0.6), lambda d: any(1 - distance(w, "lanterm") / min(len(w), 7) > 0.6 for w in d["body"])), (Q.FilteredQuery(A, RangeFilter(DAY(upper="20240110"))), lambda d: "harbour" in d["body"] and d["day"] <= "20240110"), (Q.ConstantScoreQuery(QueryFilter(B)), has("lantern")),
    (Q.MultiTermQuery("body", (("orchard", 1.0), ("quarry", 0.6), ("meadow", 9.0)), 4, 0.7), lambda d: {"orchard", "meadow"} & {*d["body"]}), (Q.MultiTermQuery("body"), lambda d: False),
]


@pytest.mark.parametrize(("q", "test"), CASES)
def test_hits(searcher, q, test):
    assert ids(searcher, q) == expected(test)


def test_scores(searcher):
    """tf, idf and norms by their formulas; a document's boost is part of its norm."""
    n, holding = len(DOCS), [i for i, d in enumerate(DOCS) if "river" in d["body"]]
    idf = math.log(n / (len(holding) + 1)) + 1

    def norm(i):
        v = (1.0 + i % 5) / math.sqrt(len(DOCS[i]["body"]))
        e = math.floor(math.log2(v))
        return math.floor(4 * v / 2**e) / 4 * 2**e

    assert {r["doc_id"]: r["score"] for r in searcher.hits(C).collect()} == {i: pytest.approx(math.sqrt(DOCS[i]["body"].count("river")) * idf * norm(i)) for i in holding}


def test_best_and_explained(searcher):
    q = boolean((A, Q.MUST), (C, Q.MUST), (B, Q.SHOULD))
    top = searcher.search(q, limit=3)
    first = top.hits.first()
    assert top.total_hits == len(expected(lambda d: {"harbour", "river"} <= {*d["body"]})) and top.max_score == first["score"]
    assert searcher.explain(q, first["doc_id"]).value == pytest.approx(first["score"], abs=1e-5)
    assert searcher.explain(q, expected(lambda d: "harbour" not in d["body"])[0]).value == 0


def test_paging(searcher):
    everything = searcher.search(C, limit=None).doc_ids()
    assert searcher.search(C, offset=1, limit=3).doc_ids() == everything[1:4]
    assert searcher.search(C, offset=100, limit=3).doc_ids() == []
    for bad in ({"offset": -1}, {"limit": 0}, {"limit": -1}):
        with pytest.raises(ValueError):
            searcher.search(C, **bad)
    assert [r["doc_id"] for r in searcher.scan(B, 9).collect()] == [i for i in expected(has("lantern")) if i >= 9]
    assert max(r["score"] for r in searcher.search_each(C).collect()) <= 1


def test_sorting(searcher):
    found = expected(has("quarry"))
    by = lambda key: sorted(found, key=lambda i: (key(DOCS[i]), i))
    assert searcher.search(term("quarry"), sort=[SortField("amount", "float")], limit=None).doc_ids() == by(lambda d: float(d["amount"]))
    assert searcher.search(term("quarry"), sort="day DESC", limit=None).doc_ids() == by(lambda d: -int(d["day"]))
    assert searcher.search(term("quarry"), sort=[FieldSymbol("path").string, FieldSymbol("day").integer.desc], limit=None).doc_ids() == by(lambda d: (d["path"], -int(d["day"])))


def test_filters(searcher):
    some = DocsFilter(searcher.index.stored.filter("doc_id < 11").select("doc_id"))
    assert ids(searcher, C, filter=some) == [i for i in expected(has("river")) if i < 11]
    assert ids(searcher, C, filter_proc=lambda d, s: d % 6 == 0) == [i for i in expected(has("river")) if i % 6 == 0]
    full = {r["doc_id"]: r["score"] for r in searcher.hits(B).collect()}
    half = {r["doc_id"]: r["score"] for r in searcher.hits(B, filter_proc=lambda d, s: F.lit(0.5)).collect()}
    assert half == {k: pytest.approx(v / 2) for k, v in full.items()}


def test_many_at_once(searcher):
    got = searcher.search_many({"a": ("body", "lantern"), "b": ("body", "river")}, limit=2).collect()
    for name, q in (("a", B), ("b", C)):
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == name] == searcher.search(q, limit=2).doc_ids()


def test_rewriting(searcher):
    assert isinstance(rewrite(Q.WildcardQuery("body", "river"), searcher.index), Q.TermQuery)
    assert rewrite(boolean((A, Q.MUST), boost=2.0), searcher.index) == A.boosted(2.0)
    with pytest.raises(ValueError):
        Q.RangeQuery("f", "b", "a")
    with pytest.raises(ValueError):
        boolean((A, Q.MUST), max_clauses=1).add(B)


def test_query_language(searcher):
    assert ids(searcher, "body:(+harbour +river)") == expected(lambda d: {"harbour", "river"} <= {*d["body"]})
    assert ids(searcher, "day:[20240103 20240115] AND body:lantern") == expected(lambda d: "20240103" <= d["day"] <= "20240115" and "lantern" in d["body"])
    assert ids(searcher, 'body:"river meadow"') == expected(lambda d: follows(d, ["river"], ["meadow"]))


TALE = "at dawn a boat left the quay with lamps and nets for the far bank and by noon the boat was back without nets or lamps to show"
BOAT, NETS = term("boat"), term("nets")
EITHER = boolean((BOAT, Q.SHOULD), (NETS, Q.SHOULD))


@pytest.mark.parametrize(
    ("q", "size", "number", "marked"),
    [
        (BOAT, 12, 1, ["...a <b>boat</b> left..."]), (BOAT, 14, 2, ["...a <b>boat</b> left...", "...the <b>boat</b> was..."]), (BOAT, 12, 3, ["at dawn a <b>boat</b> left the...", "...the <b>boat</b>..."]),
        (BOAT, 500, 1, [TALE.replace("boat", "<b>boat</b>")]), (BOAT, None, 2, [TALE.replace("boat", "<b>boat</b>")]), (term("absent"), 12, 2, None), (EITHER, 26, 1, ["...<b>boat</b> was back without <b>nets</b>..."]), (EITHER.add(phrase("boat", "was")), 20, 1, ["...the <b>boat was</b> back..."]),
    ],
)
def test_excerpts(q, size, number, marked):
    assert Highlighter(size, number).excerpts(TALE, q, whitespace_analyzer()) == marked


def test_excerpts_hold_what_they_may():
    rng = random.Random(17)
    for _ in range(300):
        text = " ".join(rng.choices(["boat", "nets", "dusk", "é", "longerword"], k=rng.randint(20, 80)))
        size, number = rng.choice([12, 30, 60]), rng.randint(1, 4)
        got = Highlighter(size, number).excerpts(text, EITHER, whitespace_analyzer())
        plain = [x.replace("<b>", "").replace("</b>", "").replace("...", "") for x in got or ()]
        assert got is None or (0 < len(got) <= number and all(x in text for x in plain) and sum(len(x.encode()) for x in plain) <= size * number + len("..."))


def test_highlighting_hits(searcher):
    got = {r["doc_id"]: r["excerpts"] for r in searcher.highlight(term("orchard"), "body", excerpt_length=None).collect()}
    top = searcher.search(term("orchard")).doc_ids()
    assert set(got) == set(top) and all(got[i] == [" ".join(f"<b>{w}</b>" if w == "orchard" else w for w in DOCS[i]["body"])] for i in top)


def test_changes(spark, searcher, tmp_path):
    index = searcher.index
    lantern, river = expected(has("lantern")), expected(has("river"))
    gone = index.delete_terms("body", "lantern")
    left = [i for i in river if i not in lantern]
    assert gone.num_docs() == 36 - len(lantern) and gone.max_doc == 36 and gone.has_deletions() and gone.is_deleted(lantern[0])
    assert ids(Searcher(gone), C) == left
    assert gone.doc_freq("body", "lantern") == len(lantern) and gone.optimize().doc_freq("body", "lantern") == 0
    assert gone.optimize().max_doc == 36 - len(lantern) and gone.undelete_all().num_docs() == 36

    day = DOCS[3]["day"]
    same_day = expected(lambda d: d["day"] == day)
    new = spark.createDataFrame([(0, day, "replaced"), (1, "20990101", "newer")], "doc_id long, day string, body string")
    added = index.add(new, key=["day"])
    assert added.num_docs() == 36 - len(same_day) + 2 and ids(Searcher(added), term("newer")) == [37]
    assert ids(Searcher(index, gone), B) == lantern

    path = str(tmp_path / "index")
    assert store.save(gone, path) == 1
    back = store.load(spark, path, whitespace_analyzer())
    assert ids(Searcher(back), C) == left
    assert store.compact(spark, path, whitespace_analyzer()) == 2 and store.load(spark, path, whitespace_analyzer()).max_doc == 36 - len(lantern)
    assert store.is_latest(spark, path, 2)
    with store.Directory(spark, path).lock(), pytest.raises(store.LockError), store.Directory(spark, path).lock(seconds=0.1):
        pass
    store.export_jsonl(index, str(tmp_path / "lines"))
    assert store.import_jsonl(spark, str(tmp_path / "lines")).count() == 36


def test_update(spark, searcher):
    n = len(expected(has("lantern")))
    changed = searcher.index.update(searcher.hits(B), {"body": F.lit("changed")})
    assert ids(Searcher(changed), term("changed")) == list(range(36, 36 + n)) and changed.num_docs() == 36


def test_numbering(spark):
    df = with_doc_ids(spark.range(100).select((F.col("id") * 7 % 101).alias("x")), ["x"])
    got = [r["doc_id"] for r in df.orderBy("x").collect()]
    assert got == list(range(100))


def test_several_values_and_options(spark):
    docs = spark.createDataFrame([(0, ["a b", "c"], "One Two"), (1, None, None)], "doc_id long, many array<string>, whole string")
    infos = FieldInfos().add_field("whole", index="untokenized", norms=False)
    index = SearchIndex.build(docs, infos, whitespace_analyzer())
    assert [(r["term"], r["positions"]) for r in index.term_vector(0, "many").collect()] == [("a", [0]), ("b", [1]), ("c", [2])]
    hit = Searcher(index).hits(Q.TermQuery("whole", "One Two")).collect()
    assert [(r["doc_id"], r["score"]) for r in hit] == [(0, 0.0)]
    assert FieldInfos.load(index.fields.to_json())["whole"].norms is False
    new = index.set_norms(spark.createDataFrame([(0, "whole", 0.5)], "doc_id long, field string, norm double"))
    assert Searcher(new).hits(Q.TermQuery("whole", "One Two")).first()["score"] > 0


def test_registered_indexes_hold_whole_texts(spark, tmp_path):
    from textloom.plans import registry

    text = "a " * 10_500 + "tail end"
    docs = spark.createDataFrame([(0, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    index = registry.build(docs)
    store.save(index, str(tmp_path / "whole"))
    more = store.load(spark, str(tmp_path / "whole"), letter_analyzer()).add(docs)
    assert {r["doc_id"]: r["length"] for r in more.norms.filter("field = 'text'").collect()} == {0: 10_502, 1: 10_502}
    assert index.term_positions("text", "end").collect()[0]["pos"] == 10_501
    cut = SearchIndex.build(docs.select("doc_id", "text"))  # the engine's own default
    assert cut.norms.first()["length"] == 10_001
