"""Analyzers: chains of a tokenizer and filters, as Spark columns and as Python generators.

A chain of built-in parts (letters, white space, a regular expression or the
whole text; lower-casing; stop words) stays in the JVM. Other chains run as one
Arrow function over batches. Both give the same tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stem, stopwords

TOKEN = "array<struct<term:string,pos:int>>"
#: Arrow functions give back so many tokens or characters at a time, or one text.
PIECE = 1 << 18


@dataclass(order=True, unsafe_hash=True, slots=True)
class Token:
    """A term with its place in the text; ``pos_inc`` is its distance from the token before."""

    start: int
    end: int
    text: str
    pos_inc: int = field(default=1, compare=False)


# Tokenizers: a Java regular expression if the JVM can do it, and a Python form.
@dataclass(frozen=True)
class RegExpTokenizer:
    """One token for every match; ``change`` maps its text, in Python."""

    pattern: str
    change: Callable[[str], str] | None = None

    @property
    def java(self) -> str | None:
        return None if self.change else self.pattern

    def tokens(self, text: str) -> Iterator[Token]:
        for m in regex.finditer(self.pattern, text):
            if m[0]:
                yield Token(m.start(), m.end(), self.change(m[0]) if self.change else m[0])


LETTER = RegExpTokenizer(r"\p{L}+")
WHITESPACE = RegExpTokenizer(r"[^ \t\n\x0B\f\r]+")
WHOLE = RegExpTokenizer(r"(?s).+")

_NUM, _URL = ".,\\/_-", "./-_"
#: A plain word, which nothing that follows can make longer, or else the first character of what may be a token.
_START = re.compile(r"([^\W_]++(?!['&@]|[.,\\/_-][^\W_]|://))|[^\W_]|[.,\\/_-](?=[^\W_])")
_GROUPS = re.compile(r"[.,\\/_-]?[^\W_]+(?:[.,\\/_-][^\W_]+)*")


class StandardTokenizer:
    """Words, possessives, companies, numbers, URLs, e-mail addresses and acronyms."""

    java = None

    def tokens(self, text: str) -> Iterator[Token]:
        at = 0
        while m := _START.search(text, at):
            at = m.start()
            if m[1]:
                yield Token(at, at := m.end(), m[1])
                continue
            if text[at] in _NUM and not text[at + 1].isdigit():
                at += 1
                continue
            term, end = self._one(text, at)
            yield Token(at, end, term)
            at = max(end, at + 1)

    @staticmethod
    def _part(c: str) -> bool:
        return bool(c) and (c.isalnum() or c in _NUM or c in "&@':")

    def _one(self, s: str, a: int) -> tuple[str, int]:
        i = a
        while i < len(s) and s[i].isalnum():
            i += 1
        c = s[i : i + 1]
        if i > a and not self._part(c):
            return s[a:i], i
        if c == "'":
            while i < len(s) and (s[i].isalpha() or s[i] == "'"):
                i += 1
            return re.sub(r"('[sS]|')$", "", s[a:i]), i
        if c == "&":
            while i < len(s) and (s[i].isalpha() or s[i] in "@&"):
                i += 1
            return s[a:i], i
        number = self._number(s, a)
        if number and not self._part(s[number : number + 1]):
            return s[a:number], number
        scheme = s[a:i]
        begin = a
        if s[i : i + 3] == "://":
            i += 3
            if scheme.lower() in ("ftp", "http", "https", "file") and s[i : i + 1].isalpha():
                begin = i
        seen_at = False
        while i < len(s):
            c, before = s[i], s[i - 1] if i else ""
            if c.isalnum():
                i += 1
            elif (c in _URL or (c == "@" and not seen_at)) and (i == begin or before.isalnum()):
                seen_at |= c == "@"
                i += 1
            else:
                break
        while i > begin + 1 and not s[i - 1].isalnum():
            i -= 1
        if number and number >= i:
            return s[a:number], number
        term, end = s[begin:i], i
        if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", term):
            return term.replace(".", ""), end + (s[end : end + 1] == ".")
        return term, end

    @staticmethod
    def _number(s: str, a: int) -> int | None:
        """The end of a number: groups joined by single marks, with a digit in every second group at least."""
        m = _GROUPS.match(s, a)
        if not m:
            return None
        groups = [g for g in re.split(r"[.,\\/_-]", m[0]) if g]
        digit = [any(c.isdigit() for c in g) for g in groups]
        if any(digit) and (len(groups) == 1 or all(digit[i] or digit[i + 1] for i in range(len(groups) - 1))):
            return m.end()
        return None


STANDARD = StandardTokenizer()


# Filters
@dataclass(frozen=True)
class LowerCaseFilter:
    def apply(self, tokens: Iterable[Token]) -> Iterator[Token]:
        for t in tokens:
            low = t.text.lower()
            yield t if low == t.text else Token(t.start, t.end, low, t.pos_inc)

    def column(self, terms: Column) -> Column:
        return F.transform(terms, lambda t: F.struct(F.lower(t["term"]).alias("term"), t["pos"].alias("pos")))


@dataclass(frozen=True)
class StopFilter:
    """Drops words; the next token's distance grows by theirs."""

    words: tuple[str, ...] = tuple(stopwords.ENGLISH)

    def apply(self, tokens: Iterable[Token]) -> Iterator[Token]:
        gone, words = 0, set(self.words)
        for t in tokens:
            if t.text in words:
                gone += t.pos_inc
            else:
                yield Token(t.start, t.end, t.text, t.pos_inc + gone) if gone else t
                gone = 0

    def column(self, terms: Column) -> Column:
        return F.filter(terms, lambda t: ~t["term"].isin(list(self.words))) if self.words else terms


@dataclass(frozen=True)
class HyphenFilter:
    """e-mail becomes email, and e and mail at the same place and the next."""

    column = None

    def apply(self, tokens: Iterable[Token]) -> Iterator[Token]:
        for t in tokens:
            if "-" in t.text and regex.fullmatch(r"\p{L}+(?:-\p{L}*)+", t.text):
                yield Token(t.start, t.end, t.text.replace("-", ""), t.pos_inc)
                first = True
                for m in re.finditer("[^-]+", t.text):
                    yield Token(t.start + m.start(), t.start + m.end(), m[0], 0 if first else 1)
                    first = False
            else:
                yield t


@dataclass(frozen=True)
class MappingFilter:
    """Replaces substrings: of the patterns that begin at a place the longest, from left to right."""

    mapping: tuple[tuple[str, str], ...]
    column = None

    @cached_property
    def _replace(self) -> Callable[[str], str]:
        table = dict(self.mapping)
        any_ = re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True))))
        return (lambda text: any_.sub(lambda m: table[m[0]], text)) if table else str

    def map(self, text: str) -> str:
        return self._replace(text)

    def apply(self, tokens: Iterable[Token]) -> Iterator[Token]:
        for t in tokens:
            yield Token(t.start, t.end, self.map(t.text), t.pos_inc)

    def text_column(self, text: Column) -> Column:
        """Whole texts mapped, where they are."""

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                out, size = [], 0
                for i in range(len(texts)):
                    value = texts[i].as_py()
                    out.append(None if value is None else self.map(value))
                    size += len(out[-1] or "")
                    if size >= PIECE or i + 1 == len(texts):
                        yield pa.array(out, pa.string())
                        out, size = [], 0

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "string")(text)


@dataclass(frozen=True)
class StemFilter:
    algorithm: str = "english"
    column = None

    def apply(self, tokens: Iterable[Token]) -> Iterator[Token]:
        of = stem.ALGORITHMS[self.algorithm]
        for t in tokens:
            yield Token(t.start, t.end, of(t.text), t.pos_inc)


@dataclass(frozen=True)
class FunctionFilter:
    """Any Python function from tokens to tokens."""

    function: Callable[[Iterable[Token]], Iterable[Token]]
    column = None

    def apply(self, tokens: Iterable[Token]) -> Iterable[Token]:
        return self.function(tokens)


@dataclass(frozen=True)
class Analyzer:
    tokenizer: object = LETTER
    filters: tuple = (LowerCaseFilter(),)

    def tokens(self, text: str) -> list[Token]:
        return list(self._tokens(text))

    def _tokens(self, text: str) -> Iterable[Token]:
        out: Iterable[Token] = self.tokenizer.tokens(text)
        for f in self.filters:
            out = f.apply(out)
        return out

    @property
    def native(self) -> bool:
        return self.tokenizer.java is not None and all(f.column for f in self.filters)

    def column(self, text: Column) -> Column:
        """array<struct<term, pos>>; positions count from 0, and a first token that follows dropped ones has theirs."""
        if not self.native:
            return self._function()(text)
        found = F.regexp_extract_all(text, F.lit(self.tokenizer.java), F.lit(0))
        first = self.filters[0] if self.filters else None
        if isinstance(first, LowerCaseFilter):  # lower-case once, not term by term
            found = F.regexp_extract_all(F.lower(text), F.lit(self.tokenizer.java), F.lit(0))
        out = F.transform(found, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
        for f in self.filters[1 if isinstance(first, LowerCaseFilter) else 0 :]:
            out = f.column(out)
        return out

    def for_field(self, name: str) -> Analyzer:
        return self

    def values_column(self, values: Column) -> Column:
        """The same of lists of texts, whose positions run on, for chains with Python parts."""
        return self._function(many=True)(values)

    def offsets(self, text: Column) -> Column:
        """array<struct<term, pos, start, end>> with places in code points."""

        return self._function(places=True)(text)

    def _function(self, many: bool = False, places: bool = False):
        """An Arrow function from texts (``many``: lists of texts, whose positions run on) to their tokens.

        It gives its rows back in pieces of PIECE tokens or characters, so that
        a worker holds the tokens of few texts, however many a batch has.
        """
        names = ("term", "pos", "start", "end") if places else ("term", "pos")
        kinds = [pa.string(), *[pa.int32()] * (len(names) - 1)]

        def pieces(texts: pa.Array) -> Iterator[pa.Array]:
            columns, ends = [[] for _ in names], [0]
            terms, at = columns[0], columns[1]
            read = 0
            for i in range(len(texts)):
                value = texts[i].as_py()
                base = 0
                for text in (value or ()) if many else (value,):
                    pos, found = base - 1, False
                    for t in self._tokens(text) if text is not None else ():
                        pos += t.pos_inc
                        found = True
                        terms.append(t.text)
                        at.append(pos if pos > base else base)
                        if places:
                            columns[2].append(t.start)
                            columns[3].append(t.end)
                    read += len(text or "")
                    base = at[-1] + 1 if found else base
                ends.append(len(terms))
                if max(len(terms), read) >= PIECE or i + 1 == len(texts):
                    rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))
                    yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
                    columns, ends, read = [[] for _ in names], [0], 0
                    terms, at = columns[0], columns[1]

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                if len(texts):
                    yield from pieces(texts)

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, f"array<struct<{','.join(f'{n}:{"string" if n == "term" else "int"}' for n in names)}>>")


def letter_analyzer(lower: bool = True) -> Analyzer:
    return Analyzer(LETTER, (LowerCaseFilter(),) if lower else ())


def whitespace_analyzer(lower: bool = False) -> Analyzer:
    return Analyzer(WHITESPACE, (LowerCaseFilter(),) if lower else ())


def regexp_analyzer(pattern: str, lower: bool = True, change=None) -> Analyzer:
    return Analyzer(RegExpTokenizer(pattern, change), (LowerCaseFilter(),) if lower else ())


def standard_analyzer(stop_words: Iterable[str] = stopwords.FULL_ENGLISH, lower: bool = True) -> Analyzer:
    return Analyzer(STANDARD, (*((LowerCaseFilter(),) if lower else ()), StopFilter(tuple(stop_words)), HyphenFilter()))


@dataclass(frozen=True)
class PerFieldAnalyzer:
    default: Analyzer
    fields: dict[str, Analyzer] = field(default_factory=dict)

    def for_field(self, name: str) -> Analyzer:
        return self.fields.get(name, self.default)

    def add_field(self, name: str, analyzer: Analyzer) -> PerFieldAnalyzer:
        return PerFieldAnalyzer(self.default, self.fields | {name: analyzer})
