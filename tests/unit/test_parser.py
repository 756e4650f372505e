"""The query language, rule by rule: what is written, and its canonical form."""

import pytest

from textloom.functions.analysis import standard_analyzer
from textloom.plans.parser import ParseError, QueryParser

#: The default field is "body"; "tag" isn't tokenized, "head" and "note" are.
RULES = {
    "words": [("river", "river"), ("head:river", "head:river"), ("", ""), ("river stone", "river stone"), ("o'clock", "o'clock"), ("River", "river"), ("tag:River", "tag:River")],
    "fields": [("*:hill", "hill tag:hill head:hill note:hill"), ("head|note:hill", "head:hill note:hill"), ("head:(hill dale)", "head:hill head:dale"), ("head:(hill note:dale)", "head:hill note:dale")],
    "phrases": [
        ('"green hill"', '"green hill"'), ('"lonely"', "lonely"), ('head:"green hill"~3', 'head:"green hill"~3'), ('tag:"a <> c"', 'tag:"a <> c"'), ('tag:"a <> c <>"', 'tag:"a <> c"'),
        ('tag:"big|small HILL|dale"', 'tag:"big|small HILL|dale"'), ('"low @@@ hill"', '"low <> hill"~1'), ('head|note:"green hill"', 'head:"green hill" note:"green hill"'), ('"green hill', '"green hill"'),
    ],
    "ranges": [("[ash oak]", "[ash oak]"), ("{ash oak}", "{ash oak}"), ("[ash oak}", "[ash oak}"), ("{ash oak]", "{ash oak]"), ("[ash>", "[ash>"), ("<oak}", "<oak}"), ("head:>ash", "head:{ash>"), (">=ash", "[ash>"), ("<oak", "<oak}"), ("tag:<=Oak", "tag:<Oak]"), ("[ASH>", "[ash>")],
    "signs": [
        ("+fir -yew", "+fir -yew"), ("REQ fir yew", "+fir yew"), ("fir !yew", "fir -yew"), ("NOT yew", "-yew +*"), ("fir NOT yew", "fir -yew"), ("-fir -yew", "-fir -yew"),
        ("fir AND yew", "+fir +yew"), ("fir OR yew", "fir yew"), ("fir yew AND elm", "fir yew +elm"), ("fir AND yew AND elm", "+fir +yew +elm"),
    ],
    "groups": [("fir (yew AND elm)", "fir (+yew +elm)"), ("fir AND (yew OR elm)", "+fir +(yew elm)"), ("note:(fir AND (yew OR elm))", "+note:fir +(note:yew note:elm)"), ("fir AND (head:yew OR [a b])", "+fir +(head:yew [a b])"), ("(fir)", "fir")],
    "boosts": [("fir^2.5", "fir^2.5"), ("(fir AND yew)^4.0", "(+fir +yew)^4.0"), ('(REQ head:"green hill")^7', 'head:"green hill"^7.0'), ("note:(fir AND [a b]^0.5)^3.0", "(+note:fir +note:[a b]^0.5)^3.0")],
    "fuzzy": [("stoen~0.7", "stoen~0.7"), ("head:stoen~0.7^2.0", "head:stoen~0.7^2.0"), ("head|note:stoen~0.7", "head:stoen~0.7 note:stoen~0.7"), ("stoen~", "stoen~")],
    "wildcards": [("r?ver", "r?ver"), ("ri*r", "ri*r"), ("tag:R*", "tag:R*"), ("head|note:r?v*^5.0", "(head:r?v* note:r?v*)^5.0")],
    "escapes": [("tag:two\\ words", "tag:two words"), ("tag:a\\:b", "tag:a:b")],
}


@pytest.mark.parametrize(("text", "expected"), [pair for pairs in RULES.values() for pair in pairs])
def test_canonical_form(text, expected):
    parser = QueryParser("body", ["body", "tag", "head", "note"], ["body", "head", "note"])
    assert parser.parse(text).to_s("body") == expected


@pytest.mark.parametrize(("text", "expected"), [("tag:88", "tag:88"), ("tag:(88 and Elm)", "tag:88 tag:elm"), ("the with but", ""), ("green and hills", "green hills")])
def test_stop_words_are_left_out(text, expected):
    assert QueryParser("body", ["body", "tag"], analyzer=standard_analyzer()).parse(text).to_s("body") == expected


def test_errors():
    with pytest.raises(ParseError):
        QueryParser("a", ["a"], handle_parse_errors=False, clean_string=False).parse("(fir")
    assert QueryParser("a", ["a"], clean_string=False).parse("(fir").to_s("a") == "fir"
    assert QueryParser("a", ["a"]).parse("fir)").to_s("a") == "fir"
