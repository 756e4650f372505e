"""Personal data by weak supervision, in DataFrame operations only.

Base rules and, beside them, looser patterns, a gazetteer of domains and words
of context propose candidate spans. Regex, gazetteer, context and boundary
labelers vote on each (for, against, or not at all). Expectation-maximisation
over the votes estimates how reliable each labeler is, and so how likely each
candidate is; on these likelihoods a logistic span classifier is trained, which
sees the votes and the span's shape. Both work on counts of equal candidates,
of which there are a few thousand kinds at most, however many texts there are.
Spans of the base rules always stay; the classifier adds others.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import ascii_lower, staged, text_of

KINDS = ("email", "ip", "card", "phone")
#: Base rules, written so that a search never goes over the same characters twice.
_NAME = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_NAME})|\G){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Words that announce a number.
_CALL, _HOST, _PAY = "call|tel|phone|fax|mobile|cell|mobil|ring|dial", "ip|host|server|address|login", "card|visa|amex|mastercard|karte|carte"
#: Spans that the base rules don't have: looser writings; names before a domain that the gazetteer knows; numbers behind words of context.
_AT, _DOT = r"(?: ?[(\[] ?at ?[)\]] ?| at )", r"(?: ?[(\[] ?dot ?[)\]] ?| dot |\.)"
MORE = {
    "email": rf"(?:(?<!{_NAME})|\G){_NAME}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{7}}(?![0-9A-Fa-f:])|(?<=\b(?i:{_HOST})[ :=]{{1,3}})[0-9A-Fa-f]{{1,4}}(?::{{1,2}}[0-9A-Fa-f]{{1,4}}){{2,6}}(?![0-9A-Fa-f:])",
    "card": rf"(?<![0-9-])[0-9]{{4}}(?:[._/][0-9]{{4}}){{3}}(?![0-9-])|(?<=\b(?i:{_PAY})[ :#]{{1,3}})[0-9]{{4}}(?:[._/ -]{{1,2}}[0-9]{{2,7}}){{2,4}}(?![0-9-])",
    "phone": rf"(?<![0-9+().-])(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[.-])[0-9]{{3}}[.-][0-9]{{4}}(?![0-9-])|(?<=\b(?i:{_CALL})[ .:#]{{1,3}})[0-9(][0-9 ()./-]{{5,18}}[0-9](?![0-9-])",
}
#: Cheap tests that a text with such a span passes.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
_MORE_HINT = {"email": r"[Aa]t[ )\]]", "ip": r"[0-9A-Fa-f]:{1,2}[0-9A-Fa-f]{1,4}:", "card": rf"[0-9]{{4}}[._/][0-9]{{4}}[._/]|(?i:{_PAY})[ :#]{{1,3}}[0-9]", "phone": rf"[0-9]{{3}}[.-][0-9]{{4}}|(?i:{_CALL})[ .:#]{{1,3}}[0-9(]"}
#: Top-level domains, calling codes, card issuers, words near a span.
TLDS = "com org net edu gov mil int info biz io co ai app dev eu uk us de fr es it nl pl se no dk fi pt ch at be ie cz ru ua tr in cn jp kr br mx ar au nz ca za example test".split()
CALLING = r"\A\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1268]|2[2-69][0-9]|3[578][0-9]|42[0-3]|5[09][0-9]|67[0-9]|68[0-9]|85[02356]|88[06]|9[679][0-9])"
ISSUERS = r"\A(?:4|5[1-5]|2[2-7]|3[0-9]|6[0-9])"
NEAR = {
    "email": r"mail|contact|write|reach|kontakt|schreib|correo|escrib|courriel|contacte|from|to:",
    "ip": r"\bip\b|addr|host|server|login|logged|from|peer|client|adresse|servidor|serveur",
    "card": r"card|visa|master|amex|pay|credit|debit|karte|zahl|tarjeta|pago|carte|paie",
    "phone": r"call|tel|phone|fax|mobil|cell|anruf|ruf|llam|m[oó]vil|appel|num",
}
AGAINST = r"version|release|build|isbn|issn|order|invoice|serial|\bv$|\bv\.? ?$|#$|\bid:? ?$"
LEFT, RIGHT = 32, 16
ROUNDS, STEPS, RATE, LEAST = 40, 300, 0.5, 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """A string of digits passes the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _small_parts(m: Column) -> Column:
    """No number between the dots is over 255."""
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, r"\A0+", ""))
    return ~F.exists(parts, lambda p: (F.length(p) > 3) | (F.coalesce(F.when(F.length(p) <= 3, p).try_cast("int"), F.lit(0)) > 255))


def _found(t: Column, kind: int, base: bool) -> Column:
    """Matches with their places in order, the gap before each, and what stands around it."""
    pattern, hint = (BASE, _HINT) if base else (MORE, _MORE_HINT)
    name = KINDS[kind]
    may = F.instr(t, "@") > 0 if hint[name] == "@" else t.rlike(hint[name])
    matches, gaps = F.regexp_extract_all(t, F.lit(pattern[name]), F.lit(0)), F.split(t, pattern[name], -1)
    pairs = F.transform(
        F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g"), F.slice(gaps, 2, F.size(matches)).alias("after")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("i"), F.length(x["g"]).alias("gap"), x["m"].alias("m"), F.right(x["g"], F.lit(LEFT)).alias("left"), F.left(x["after"], F.lit(RIGHT)).alias("right")),
    )
    return F.when(may & (F.size(matches) > 0), pairs)


def _by_kind(cases: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.col("kind") == k, cases[name]) for k, name in enumerate(KINDS)])


def candidates(rows: DataFrame) -> DataFrame:
    """Candidate spans of ``rows`` (rid, id, t) with votes and shapes; a text without any has one row of nulls."""
    t = F.col("t")
    none = F.array().cast("array<struct<kind:int,base:boolean,i:int,gap:int,m:string,left:string,right:string>>")
    everything = F.concat(*[F.coalesce(_found(t, k, base), none) for base in (True, False) for k in range(len(KINDS))])
    spans = rows.select("rid", "id", F.inline_outer(everything))
    ordered = Window.partitionBy("rid", "kind", "base").orderBy("i")
    spans = spans.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(ordered).cast("long")).withColumn("start", F.col("end") - F.length("m"))

    digits = F.length(_digits(F.col("m")))
    valid = _by_kind({"email": F.lit(True), "ip": F.when(F.col("base"), _small_parts(F.col("m"))).otherwise(True), "card": F.when(digits.between(14, 19), luhn(_digits(F.col("m")))).otherwise(False), "phone": digits.between(F.when(F.col("base"), 10).otherwise(7), 15)})
    spans = spans.withColumn("valid", valid)
    yes, no, silent = F.lit(1), F.lit(-1), F.lit(0)
    vote = lambda good: F.when(good, yes).otherwise(no)
    near = ascii_lower(F.concat(F.col("left"), F.lit(" "), F.col("right")))
    kept = _by_kind({k: near.rlike(NEAR[k]) for k in KINDS})
    domain = F.regexp_extract(ascii_lower(F.col("m")), r"([a-z0-9-]+)\z", 1)
    gazetteer = _by_kind(
        {
            "email": vote(domain.isin(TLDS)),
            "ip": F.when(F.col("base"), vote(F.col("m").rlike(r"\A(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."))).otherwise(silent),
            "card": vote(F.col("m").rlike(ISSUERS)),
            "phone": F.when(F.col("base"), vote(F.concat(F.lit("+"), _digits(F.col("m"))).rlike(CALLING))).otherwise(vote(_digits(F.col("m")).rlike(r"\A[2-9]"))),
        }
    )
    inside = F.col("left").rlike(r"[\p{L}\p{N}]\z") | F.col("right").rlike(r"\A[\p{L}\p{N}]")
    size = F.length("m")
    return spans.withColumns(
        {
            "regex": F.when(~F.col("valid"), no).when(F.col("base"), yes).otherwise(silent),
            "gazetteer": gazetteer,
            "context": F.when(ascii_lower(F.col("left")).rlike(AGAINST), no).when(kept, yes).otherwise(silent),
            "boundary": vote(~inside),
            "size": F.when(size < 12, 0).when(size < 18, 1).when(size < 30, 2).otherwise(3),
            "mixed": F.col("m").rlike("[A-Za-z]").cast("int"),
        }
    ).drop("gap", "i", "left", "right", "m")


LABELERS = ("regex", "gazetteer", "context", "boundary")


def reliabilities(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Dawid and Skene's model: the share of true spans, and for each labeler P(vote | false), P(vote | true).

    ``patterns`` are votes of all labelers and how many candidates have them.
    Starts from the majority of votes and assumes that labelers err
    independently, given the truth.
    """
    total = sum(n for _, n in patterns)
    truth = [min(0.95, max(0.05, 0.5 + sum(votes) / (2 * len(votes)))) for votes, _ in patterns]
    share, tables = 0.5, []
    for _ in range(ROUNDS):
        share = (1 + sum(n * p for (_, n), p in zip(patterns, truth, strict=True))) / (2 + total)
        tables = []
        for j in range(len(LABELERS)):
            seen = {v: [0.5, 0.5] for v in (-1, 0, 1)}
            for (votes, n), p in zip(patterns, truth, strict=True):
                seen[votes[j]][0] += n * (1 - p)
                seen[votes[j]][1] += n * p
            sums = [sum(x[y] for x in seen.values()) for y in (0, 1)]
            tables.append({v: (x[0] / sums[0], x[1] / sums[1]) for v, x in seen.items()})
        truth = [posterior(votes, share, tables) for votes, _ in patterns]
    return share, tables


def posterior(votes: tuple[int, ...], share: float, tables: list[dict[int, tuple[float, float]]]) -> float:
    z = math.log(share / (1 - share)) + sum(math.log(t[v][1] / t[v][0]) for v, t in zip(votes, tables, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


_SHAPES = [(name, v) for name in LABELERS for v in (-1, 1)] + [("size", v) for v in (1, 2, 3)] + [("mixed", 1)]


def trained(rows: list[tuple[tuple[float, ...], float, int]]) -> list[float]:
    """Logistic regression by gradient steps on (features, mean likelihood, count); the last weight is the bias."""
    w = [0.0] * (len(_SHAPES) + 1)
    total = sum(n for _, _, n in rows) or 1
    for _ in range(STEPS):
        g = [0.01 * x for x in w]
        for x, p, n in rows:
            z = sum(a * b for a, b in zip(w, x, strict=False)) + w[-1]
            e = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p)
            for i, b in enumerate(x):
                if b:
                    g[i] += e * b
            g[-1] += e
        w = [a - RATE * b for a, b in zip(w, g, strict=True)]
    return w


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base and spans, arrays of (start, kind, end, likelihood) in order.

    Offsets are code points, ends exclusive; kind is a place in KINDS. base has
    the spans of the base rules; spans has these and those that the classifier
    adds, which touch no base span. Null and empty texts have none. Rows that
    repeat stay apart; further columns are ignored; an empty table stays empty.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    spans = staged(candidates(rows), "candidates")
    known = spans.filter("kind is not null")

    # What is collected: one row for every pattern of votes and shape, of which there are some 4 * 3^4 * 8.
    shapes = [r.asDict() for r in known.groupBy("kind", *LABELERS, "size", "mixed").agg(F.count(F.lit(1)).alias("n")).collect()]
    weights: dict[int, list[float]] = {}
    for k in range(len(KINDS)):
        own = [r for r in shapes if r["kind"] == k]
        counts: dict[tuple[int, ...], int] = {}
        for r in own:
            votes = tuple(r[x] for x in LABELERS)
            counts[votes] = counts.get(votes, 0) + r["n"]
        model = reliabilities(sorted(counts.items()))
        weights[k] = trained([(tuple(float(r[name] == v) for name, v in _SHAPES), posterior(tuple(r[x] for x in LABELERS), *model), r["n"]) for r in sorted(own, key=lambda r: tuple(sorted(r.items())))])

    def odds(w: list[float]) -> Column:
        return reduce(lambda a, b: a + b, [F.when(F.col(name) == v, F.lit(x)).otherwise(0.0) for (name, v), x in zip(_SHAPES, w, strict=False)], F.lit(w[-1]))

    sure = F.col("base") & F.col("valid")
    likely = 1 / (1 + F.exp(-F.coalesce(*[F.when(F.col("kind") == k, odds(w)) for k, w in weights.items()])))
    judged = spans.withColumn("sure", sure).withColumn("p", likely).filter(F.col("kind").isNull() | F.col("sure") | (F.col("valid") & (F.col("p") >= LEAST)))
    # Added spans must not touch base ones; both looks along the text are running extrema.
    ahead = Window.partitionBy("rid").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("rid").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    judged = judged.withColumn("reach", F.max(F.when(F.col("sure"), F.col("end"))).over(ahead)).withColumn("next", F.min(F.when(F.col("sure"), F.col("start"))).over(back))
    free = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.lit(1 << 62)) >= F.col("end"))
    entry = F.struct("start", "kind", "end", F.round("p", 6).alias("likelihood"))
    listed = lambda which: F.array_sort(F.collect_list(F.when(which, entry)))
    found = judged.filter("kind is not null").groupBy("rid").agg(listed(F.col("sure")).alias("base"), listed(F.col("sure") | free).alias("spans"))
    ids = spans.select("rid", "id").distinct()
    empty = F.array().cast(found.schema["base"].dataType)
    return ids.join(found, "rid", "left").select(F.col("id").alias(id_col), F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"))


def listed(spans: Column) -> Column:
    """"kind:start:end", comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
