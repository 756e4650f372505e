"""Analysis, fuzzy matching, spans, sloppy phrases and sorting: rules on own examples, and plain versions on generated ones."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import analysis, lex, stem, stopwords
from textloom.functions.analysis import Analyzer, HyphenFilter, LowerCaseFilter, MappingFilter, PerFieldAnalyzer, StemFilter, StopFilter, Token
from textloom.operators import positional
from textloom.operators import query as Q
from textloom.operators.index import SearchIndex
from textloom.operators.planner import Planner
from textloom.operators.search import Searcher, SortField, parse_sort

NOTE = "Ask ann.lee@post.example.org for My well-known 47 %% files. See https://docs.example.net/a-b/c/ or U.N.O. 77-01-XQ-9"
TOKENS = ["Ask", "ann.lee@post.example.org", "for", "My", "well-known", "47", "files", "See", "docs.example.net/a-b/c", "or", "UNO", "77-01-XQ-9"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (NOTE, TOKENS), ("snake_case words", ["snake_case", "words"]), ("Anna's dog isn't Chris' o'hare", ["Anna", "dog", "isn't", "Chris", "o'hare"]), ("R&D and B&O", ["R&D", "and", "B&O"]),
        ("2,500.75 -6 3.14/2", ["2,500.75", "-6", "3.14/2"]), ("naïve Ölmühle ÉTÉ", ["naïve", "Ölmühle", "ÉTÉ"]), ("ftp://host/x end", ["host/x", "end"]), ("", []), ("... !?", []),
    ],
)
def test_standard_tokens(text, expected):
    found = list(analysis.STANDARD.tokens(text))
    assert [t.text for t in found] == expected
    assert all(0 <= t.start < t.end <= len(text) for t in found) and all(a.end <= b.start for a, b in itertools.pairwise(found))


def test_standard_analyzer_and_hyphens():
    got = [(t.text, t.start, t.end, t.pos_inc) for t in analysis.standard_analyzer().tokens("It is a well-known fact of THE trade")]
    assert got == [("wellknown", 8, 18, 4), ("well", 8, 12, 0), ("known", 13, 18, 1), ("fact", 19, 23, 1), ("trade", 31, 36, 3)]


def test_filters():
    some = Analyzer(analysis.WHITESPACE, (LowerCaseFilter(), StopFilter(("of",)), MappingFilter((("qu", "k"), ("quo", "z"))), StemFilter()))
    assert [(t.text, t.pos_inc) for t in some.tokens("QUOqua OF Jumping")] == [("zka", 1), ("jump", 2)]
    per = PerFieldAnalyzer(analysis.letter_analyzer()).add_field("raw", analysis.whitespace_analyzer())
    assert [t.text for t in per.for_field("raw").tokens("X-y z")] == ["X-y", "z"] and [t.text for t in per.for_field("other").tokens("X-y z")] == ["x", "y", "z"]
    assert Token(0, 1, "b") < Token(0, 2, "a") < Token(1, 2, "a")


@pytest.mark.parametrize("analyzer", [analysis.letter_analyzer(), analysis.whitespace_analyzer(True), analysis.regexp_analyzer(r"\w{2,}"), Analyzer(analysis.LETTER, (LowerCaseFilter(), StopFilter())), Analyzer(analysis.WHOLE, ()), analysis.standard_analyzer(), Analyzer(analysis.LETTER, (StemFilter(), HyphenFilter())), Analyzer(analysis.WHITESPACE, (LowerCaseFilter(), HyphenFilter(), StopFilter(("b",))))])
def test_columns_agree_with_python(spark, analyzer):
    texts = [NOTE, "The Slow and the old, Ü ô", "", None, "  a  b\n", "pre-war-time x- --y a-b-c d"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", analyzer.column(F.col("t")).alias("x"), analyzer.offsets(F.col("t")).alias("o")).orderBy("i").collect()
    for text, row in zip(texts, rows, strict=True):
        pos, expected = -1, []
        for t in analyzer.tokens(text or ""):
            pos += t.pos_inc
            expected.append((t.text, max(pos, 0), t.start, t.end))
        assert [(x["term"], x["pos"]) for x in row["x"] or []] == [e[:2] for e in expected]
        assert [tuple(x) for x in row["o"] or []] == expected


@pytest.mark.parametrize(
    ("word", "expected"),
    [("dresses", "dress"), ("berries", "berri"), ("lies", "lie"), ("bus", "bus"), ("maps", "map"), ("freed", "freed"), ("painted", "paint"), ("stopping", "stop"), ("baked", "bake"), ("sunny", "sunni"), ("my", "my"), ("toy", "toy"),
     ("national", "nation"), ("kindness", "kind"), ("electrical", "electr"), ("relational", "relat"), ("dying", "die"), ("skies", "sky"), ("news", "news"), ("proceeding", "proceed"), ("youthful", "youth")],
)
def test_stems(word, expected):
    assert stem.english(word) == expected


@pytest.mark.parametrize(
    ("algorithm", "pairs"),
    [
        ("german", "kategorien kategori kategorischen kategor katers kat katzen katz kätzchen katzch käufer kauf kaufleute kaufleut häuser haus ergebnisse ergebnis freundlichkeit freundlich aufgaben aufgab größte grosst einigung einig"),
        ("spanish", "chicharrones chicharron chicos chic torear tor toreros torer torneo torne cheque chequ chilena chilen rápidamente rapid comiendo com sociología sociolog pague pag canción cancion felicidades felic diciéndole dic"),
    ],
)
def test_stems_of_other_languages(algorithm, pairs):
    words = pairs.split()
    assert [stem.ALGORITHMS[algorithm](w) for w in words[::2]] == words[1::2]


def test_stop_lists(tmp_path):
    assert len(stopwords.ENGLISH) == 32 and "themselves" in stopwords.FULL_ENGLISH and set(stopwords.FULL_ENGLISH) < set(stopwords.EXTENDED_ENGLISH)
    (tmp_path / "x.txt").write_text("| remark\nund | and\n\noder  # or\n")
    assert stopwords.load(str(tmp_path / "x.txt")) == ["und", "oder"]


def test_sortable_numbers(spark):
    numbers = [-(10**9), -1001, -1000, -999, -10, -9, -1, 0, 1, 9, 10, 999, 1000, 10**12]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", lex.int_to_lex(F.col("n")).alias("s"), lex.lex_to_int(lex.int_to_lex(F.col("n"))).alias("back"), lex.int_to_pad(F.col("n"), 5).alias("pad")).orderBy("n").collect()
    assert [r["s"] for r in rows] == sorted(r["s"] for r in rows) and [r["back"] for r in rows] == numbers
    assert {r["n"]: r["s"] for r in rows}[10] == "000210" and {r["n"]: r["pad"] for r in rows}[9] == "    9"


RNG = random.Random(41)
WORDS = ["".join(RNG.choices("mno", k=RNG.randint(2, 9))) for _ in range(60)] + ["é" * 4, "ééé", "lantern", "lanterns", "intern"]


@pytest.fixture(scope="module")
def fuzzy(spark):
    return Planner(SearchIndex.build(spark.createDataFrame(list(enumerate(WORDS)), "doc_id long, field string"), analyzer=analysis.whitespace_analyzer()).cached())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("text", "least", "prefix"), [("mnomno", 0.5, 0), ("mnomno", 0.5, 2), ("ooo", 0.3, 0), ("lantern", 0.7, 0), ("lantern", 0.7, 3), ("latnern", 0.6, 1), ("éééé", 0.6, 0), ("zzzz", 0.5, 0), ("nom", 0.5, 3), ("mmnnoomm", 0.4, 1)])
def test_fuzzy(fuzzy, text, least, prefix):
    """Edit distance in bytes behind a common prefix, over the shorter length: terms nearer than the least similarity."""
    own = text.encode()

    def fits(word):
        w = word.encode()
        if prefix >= len(own):
            return word == text
        if w[:prefix] != own[:prefix]:
            return False
        shorter = prefix + min(len(w) - prefix, len(own) - prefix)
        return 1 - distance(w[prefix:], own[prefix:]) / shorter > least

    got = sorted(r["doc_id"] for r in fuzzy.hits(Q.FuzzyQuery("field", text, least, prefix_length=prefix)).collect())
    assert got == [i for i, w in enumerate(WORDS) if fits(w)]


def test_fuzzy_bounds():
    for bad in (1.1, -0.1):
        with pytest.raises(ValueError):
            Q.FuzzyQuery("f", "s", bad)


TEXTS = [RNG.choices(["oak", "elm", "ash", "fir", "firs", "yew"], k=RNG.randint(3, 11)) for _ in range(40)]


def t(word):
    return Q.SpanTermQuery("field", word)


def near(*words, slop=0, order=False):
    return Q.SpanNearQuery(tuple(t(w) if isinstance(w, str) else w for w in words), slop, order)


def places(words, *wanted):
    return [i for i, w in enumerate(words) if w in wanted]


def close(words, *wanted, slop=0, order=False):
    """Some choice of one place for each word lies as close together (and in order)."""
    return any((not order or list(c) == sorted(set(c))) and max(c) + 1 - min(c) - len(c) <= slop for c in itertools.product(*(places(words, *([w] if isinstance(w, str) else w)) for w in wanted)))


SPANS = [
    (t("oak"), lambda w: "oak" in w), (Q.SpanMultiTermQuery("field", ("elm", "yew")), lambda w: {"elm", "yew"} & {*w}), (Q.SpanPrefixQuery("field", "fir"), lambda w: {"fir", "firs"} & {*w}),
    *((near("oak", "elm", slop=s, order=o), lambda w, s=s, o=o: close(w, "oak", "elm", slop=s, order=o)) for s in (0, 1, 3) for o in (False, True)),
    *((near("oak", "ash", "yew", slop=s), lambda w, s=s: close(w, "oak", "ash", "yew", slop=s)) for s in (0, 2, 5)), (near(Q.SpanPrefixQuery("field", "fir"), "oak", slop=1), lambda w: close(w, ("fir", "firs"), "oak", slop=1)),
    (Q.SpanFirstQuery(t("ash"), 3), lambda w: "ash" in w[:3]), (Q.SpanOrQuery((t("yew"), Q.SpanFirstQuery(t("oak"), 1))), lambda w: "yew" in w or w[0] == "oak"),
    (Q.SpanNotQuery(t("oak"), near("oak", "elm", order=True)), lambda w: any(w[i + 1 : i + 2] != ["elm"] for i in places(w, "oak"))), (Q.SpanNotQuery(near("oak", "elm", slop=2, order=True), t("ash")), lambda w: any(j > i and j - i <= 3 and "ash" not in w[i:j] and "elm" not in w[i + 1 : j] for i in places(w, "oak") for j in places(w, "elm"))),
]


@pytest.fixture(scope="module")
def spans(spark):
    return Searcher(SearchIndex.build(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(TEXTS)], "doc_id long, field string"), analyzer=analysis.whitespace_analyzer()).cached())


@pytest.mark.parametrize(("q", "test"), SPANS)
def test_spans(spans, q, test):
    got = {r["doc_id"]: r["score"] for r in spans.hits(q).collect()}
    expected = [i for i, w in enumerate(TEXTS) if test(w)]
    assert sorted(got) == expected
    if expected:
        assert spans.explain(q, expected[0]).value == pytest.approx(got[expected[0]])


def test_spans_of_one_field(spans):
    with pytest.raises(ValueError):
        spans.hits(Q.SpanOrQuery((t("oak"), Q.SpanTermQuery("other", "oak"))))


def test_sloppy_windows():
    """A window ends where the last of the other slots comes again; with repeated terms no word stands for two slots."""
    assert positional.sloppy_phrase([[3], [3]], 0) == 1.0  # an exact phrase
    assert positional.sloppy_phrase([[1, 9], [3]], 2) == pytest.approx(1 / 3)
    assert positional.sloppy_phrase([[1, 2], [4]], 2) == pytest.approx(1 / 3)
    assert positional.sloppy_phrase([[0, 6], [2, 8]], 2) == pytest.approx(2 / 3)
    assert positional.sloppy_phrase([[5], []], 9) == 0.0
    twice = [[0, 4], [-1, 3]]  # "a a" where "a" stands at 0 and 4
    assert positional.sloppy_phrase(twice, 9) > 0 and positional.sloppy_phrase(twice, 2, [0, 1]) == 0.0
    assert positional.sloppy_phrase([[0, 1], [-1, 0]], 0, [0, 1]) == 1.0  # "a a" side by side


SORTABLE = [("oak", "14", "2.5"), (None, "3", "0.25"), ("", "14", "-1.5"), ("ash", "-2", "30.0"), ("elm", "3", "7e1"), ("yew", "900", "0.0")]


@pytest.fixture(scope="module")
def sortable(spark):
    docs = spark.createDataFrame([(i, "all", *r, 1.0 + i) for i, r in enumerate(SORTABLE)], "doc_id long, x string, name string, size string, share string, boost double")
    return Searcher(SearchIndex.build(docs, analyzer=analysis.whitespace_analyzer(), boost_col="boost").cached())


@pytest.mark.parametrize(
    ("sort", "key"),
    [
        ("DOC_ID", lambda i: i), ("DOC_ID DESC", lambda i: -i), ("size", lambda i: (int(SORTABLE[i][1]), i)), ("size DESC", lambda i: (-int(SORTABLE[i][1]), i)), ([SortField("share", "float")], lambda i: (float(SORTABLE[i][2]), i)),
        ([SortField("name", "string")], lambda i: (not SORTABLE[i][0], SORTABLE[i][0] or "", i)), ("size DESC, name", lambda i: (-int(SORTABLE[i][1]), not SORTABLE[i][0], SORTABLE[i][0] or "", i)),
    ],
)
def test_sorting(sortable, sort, key):
    expected = sorted(range(len(SORTABLE)), key=key)
    q = Q.TermQuery("x", "all")
    assert sortable.search(q, sort=sort).doc_ids() == expected
    assert sortable.search(q, sort=sort, offset=2, limit=3).doc_ids() == expected[2:5]
    scores = [r["score"] for r in sortable.search(q).hits.collect()]
    assert scores == sorted(scores, reverse=True)


def test_sort_fields(sortable):
    assert [str(s) for s in parse_sort("a DESC, SCORE, DOC_ID DESC")] == ["a:<auto>!", "<SCORE>", "<DOC>!"]
    with pytest.raises(ValueError):
        sortable.search("x:all", sort="nothing")


def test_segments(spark, tmp_path):
    """An added part is a segment; ten of a size become one; keys replace, and a repeated batch adds nothing."""
    from textloom.sources import store

    path = str(tmp_path / "parts")
    part = lambda *rows: SearchIndex.build(spark.createDataFrame(list(rows), "doc_id long, key string, body string"), analyzer=analysis.whitespace_analyzer())
    store.append(part((0, "a", "oak elm"), (1, "b", "oak")), path, key=["key"], mark=("s", 0))
    assert store.append(part((0, "b", "ash"), (1, "c", "oak ash")), path, key=["key"], mark=("s", 1)) == 2
    assert store.append(part((0, "b", "ash")), path, key=["key"], mark=("s", 1)) == 2  # the same batch again
    index = store.load(spark, path, analysis.whitespace_analyzer())
    assert len(store.segments(spark, path)) == 2 and index.num_docs() == 3 and index.max_doc == 4
    assert sorted(r["doc_id"] for r in Searcher(index).hits(Q.TermQuery("body", "oak")).collect()) == [0, 3]
    assert index.doc_freq("body", "oak") == 3 and store.load(spark, path, analysis.whitespace_analyzer(), at=1).num_docs() == 2
    store.compact(spark, path, analysis.whitespace_analyzer())
    assert store.load(spark, path, analysis.whitespace_analyzer()).doc_freq("body", "oak") == 2 and len(store.segments(spark, path)) == 1
    where = store.Directory(spark, path)
    assert where.create_new("write.lock") and not where.break_lock() and where.break_lock(older_than=0)
