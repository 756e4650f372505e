"""The query language: a hand-written parser from strings to queries.

    expression = clause {[AND | OR] clause}
    clause     = [+ | REQ | - | ! | NOT] item [^boost]
    item       = word | word~ | word~0.4 | wild* | "phrase"~slop | [a b} | >= a | (expression) | field|field:item | *:item
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from ..functions.analysis import Analyzer, PerFieldAnalyzer, standard_analyzer
from ..operators import query as Q

_SPECIAL = "&:()[]{}!\"~^|<>=*?+-"
_BREAKS = " \t()[]{}!\"~^|<>="
_IN_PHRASE = '<>|"'


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class _Token:
    kind: str  # word, wild, a sign, or one of AND OR REQ NOT
    text: str = ""


def clean(text: str) -> str:
    """Close open quotes and brackets, and escape what has no meaning inside quotes."""
    out: list[str] = []
    opened, quoted, i = 0, False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            quoted = not quoted
            out.append(c)
        elif quoted:
            if text[i : i + 2] == "<>":
                out.append("<>")
                i += 1
            elif c in _SPECIAL and c != "|":
                out.append("\\" + c)
            else:
                out.append(c)
        elif c == ")" and not opened:
            out = ["(", *out, c]
        else:
            opened += (c == "(") - (c == ")")
            out.append(c)
        i += 1
    return "".join(out) + '"' * quoted + ")" * opened


def _lex(text: str) -> list[_Token]:
    out: list[_Token] = []
    i = 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if c in " \t":
            i += 1
        elif c in "-!":
            out.append(_Token("NOT"))
            i += 1
        elif c == "+":
            out.append(_Token("REQ"))
            i += 1
        elif two in ("&&", "||"):
            out.append(_Token("AND" if c == "&" else "OR"))
            i += 2
        elif c in _SPECIAL and c not in "*?&" or two == "*:":
            out.append(_Token(c))
            i += 1
        else:
            word, wild, start = [], False, i
            while i < len(text):
                c = text[i]
                if c == "\\" and i + 1 < len(text):
                    word.append(text[i + 1])
                    i += 2
                elif c == ":":
                    if text[i + 1 : i + 2] != ":":
                        break
                    word.append(":")
                    i += 2
                elif c in _BREAKS:
                    break
                else:
                    wild |= c in "*?"
                    word.append(c)
                    i += 1
            whole = "".join(word)
            if text[start:i] in ("AND", "OR", "REQ", "NOT"):
                out.append(_Token(whole))
            else:
                out.append(_Token("wild" if wild else "word", whole))
    return out


class QueryParser:
    def __init__(
        self,
        default_field: str | Iterable[str] = "*",
        fields: Iterable[str] = (),
        tokenized_fields: Iterable[str] | None = None,
        analyzer: Analyzer | PerFieldAnalyzer | None = None,
        or_default: bool = True,
        wild_lower: bool = True,
        validate_fields: bool = False,
        typed_ranges: bool = True,
        clean_string: bool = True,
        handle_parse_errors: bool = True,
        max_clauses: int = 512,
        min_similarity: float = 0.5,
    ):
        defaults = [default_field] if isinstance(default_field, str) else list(default_field)
        self.fields = list(dict.fromkeys([*fields, *(f for f in defaults if f != "*")]))
        self.default_fields = self.fields if defaults == ["*"] else defaults
        self.tokenized = set(self.fields if tokenized_fields is None else tokenized_fields)
        self.all_tokenized = tokenized_fields is None
        self.analyzer = analyzer or standard_analyzer()
        self.or_default, self.wild_lower, self.validate, self.typed = or_default, wild_lower, validate_fields, typed_ranges
        self.clean, self.forgiving, self.max_clauses, self.min_similarity = clean_string, handle_parse_errors, max_clauses, min_similarity

    def parse(self, text: str) -> Q.Query:
        text = clean(text) if self.clean else text
        self.scope: list[list[str]] = [self.default_fields]
        try:
            self.tokens, self.at = _lex(text), 0
            found = self._boolean(None)
            if self.at < len(self.tokens):
                raise ParseError(f"unexpected {self.tokens[self.at].kind!r} in {text!r}")
        except (ParseError, ValueError) as error:
            if not self.forgiving:
                raise ParseError(str(error)) from error
            self.scope = [self.default_fields]
            found = self._each(lambda name: self._term(name, text))
        return found or Q.BooleanQuery()

    # Tokens
    def _peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead].kind if self.at + ahead < len(self.tokens) else ""

    def _next(self, *kinds: str) -> str:
        if kinds and self._peek() not in kinds:
            raise ParseError(f"{' or '.join(kinds)} expected at {self._peek() or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1].text

    def _take(self, *kinds: str) -> str | None:
        if self._peek() in kinds:
            kind = self._peek()
            self.at += 1
            return kind
        return None

    # Grammar
    def _boolean(self, end: str | None) -> Q.Query | None:
        clauses: list[Q.BooleanClause] = []
        first = True
        while self._peek() and self._peek() != end:
            joined = None if first else self._take("AND", "OR")
            clause = self._clause()
            if clause is not None:
                both = not first and (joined == "AND" or (joined is None and not self.or_default))
                if both:
                    if len(clauses) == 1 and not clauses[0].prohibited:
                        clauses[0] = replace(clauses[0], occur=Q.MUST)
                    if not clause.prohibited:
                        clause = replace(clause, occur=Q.MUST)
                clauses.append(clause)
            first = False
        if not clauses:
            return None
        if len(clauses) == 1:
            if clauses[0].prohibited:
                return Q.BooleanQuery(clauses=(clauses[0], Q.BooleanClause(Q.MatchAllQuery(), Q.MUST)), max_clauses=self.max_clauses)
            return clauses[0].query
        if len(clauses) > self.max_clauses:
            raise ParseError(f"more than {self.max_clauses} clauses")
        return Q.BooleanQuery(clauses=tuple(clauses), max_clauses=self.max_clauses)

    def _clause(self) -> Q.BooleanClause | None:
        sign = self._take("REQ", "NOT")
        found = self._item()
        if self._take("^"):
            boost = self._next("word")
            try:
                found = found.boosted(float(boost)) if found is not None else None
            except ValueError:
                pass  # a boost that is no number changes nothing
        return None if found is None else Q.BooleanClause(found, {"REQ": Q.MUST, "NOT": Q.MUST_NOT, None: Q.SHOULD}[sign])

    def _item(self) -> Q.Query | None:
        kind = self._peek()
        if kind == "(":
            self._next()
            if self._take(")"):
                return Q.BooleanQuery(max_clauses=self.max_clauses)
            found = self._boolean(")")
            self._next(")")
            return found
        if kind == "*" or (kind == "word" and self._names_fields()):
            return self._in_fields()
        if kind == '"':
            return self._phrase()
        if kind in ("[", "{", "<", ">"):
            return self._range()
        if kind == "wild":
            pattern = self._next()
            return self._each(lambda name: self._wild(name, pattern))
        word = self._next("word")
        if self._take("~"):
            least = self._next() if self._peek() == "word" else None
            return self._each(lambda name: self._fuzzy(name, word, least))
        return self._each(lambda name: self._term(name, word))

    def _names_fields(self) -> bool:
        i = 1
        while self._peek(i) == "|" and self._peek(i + 1) == "word":
            i += 2
        return self._peek(i) == ":"

    def _in_fields(self) -> Q.Query | None:
        if self._take("*"):
            names = self.fields
        else:
            names = [self._next("word")]
            while self._take("|"):
                names.append(self._next("word"))
            names = [n for n in dict.fromkeys(names) if not self.validate or n in self.fields]
        self._next(":")
        self.scope.append(names)
        found = self._item()
        self.scope.pop()
        return found

    def _each(self, make: Callable[[str], Q.Query | None]) -> Q.Query | None:
        """One query for the field at hand, or one for each of several, any of which may match."""
        names = self.scope[-1]
        if len(names) == 1:
            return make(names[0])
        found = [q for q in map(make, names) if q is not None]
        return Q.BooleanQuery(clauses=tuple(Q.BooleanClause(q) for q in found), max_clauses=self.max_clauses) if found else None

    # Leaves
    def _analyze(self, name: str, word: str):
        if not self.all_tokenized and name not in self.tokenized:
            from ..functions.analysis import Token

            return [Token(0, len(word), word)]
        return self.analyzer.for_field(name).tokens(word)

    def _lowered(self, name: str, text: str | None) -> str | None:
        return text.lower() if text is not None and self.wild_lower and (self.all_tokenized or name in self.tokenized) else text

    def _term(self, name: str, word: str) -> Q.Query | None:
        tokens = self._analyze(name, word)
        if len(tokens) < 2:
            return Q.TermQuery(name, tokens[0].text) if tokens else None
        phrase = Q.PhraseQuery(name).add_term(tokens[0].text, 0)
        for t in tokens[1:]:
            phrase = replace(phrase.add_term(t.text, t.pos_inc), slop=phrase.slop + 1) if t.pos_inc else phrase.append(t.text)
        return phrase

    def _fuzzy(self, name: str, word: str, least: str | None) -> Q.Query | None:
        tokens = self._analyze(name, word)
        return Q.FuzzyQuery(name, tokens[0].text, float(least) if least else self.min_similarity, max_terms=self.max_clauses) if tokens else None

    def _wild(self, name: str, pattern: str) -> Q.Query:
        pattern = self._lowered(name, pattern)
        if pattern == "*":
            return Q.MatchAllQuery()
        if pattern.endswith("*") and not set(pattern[:-1]) & set("*?"):
            return Q.PrefixQuery(name, pattern[:-1], self.max_clauses)
        return Q.WildcardQuery(name, pattern, self.max_clauses)

    def _range(self) -> Q.Query | None:
        opened = self._next_kind()
        low = high = None
        include_low = include_high = False
        if opened in "[{":
            include_low = opened == "["
            low = self._next("word")
            if not self._take(">"):
                high = self._next("word")
                include_high = self._take("]") is not None
                if not include_high:
                    self._next("}")
        elif opened == "<":
            include_high = self._take("=") is not None
            high = self._next("word")
            if not include_high and (closed := self._take("}", "]")):
                include_high = closed == "]"
        else:
            include_low = self._take("=") is not None
            low = self._next("word")
        return self._each(lambda n: Q.RangeQuery(n, self._lowered(n, low), self._lowered(n, high), include_low, include_high, self.typed))

    def _next_kind(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1].kind

    def _phrase(self) -> Q.Query | None:
        self._next('"')
        words: list[tuple[int, list[str]]] = []  # gap before, alternatives
        gap = 0
        while not self._take('"'):
            if self._take("<"):
                self._next(">")
                gap += bool(words)  # gaps before the first word mean nothing
            elif self._take("|"):
                words[-1][1].append(self._next("word")) if words else self._next("word")
            else:
                words.append((gap, [self._next("word", "wild")]))
                gap = 0
        slop = self._next("word") if self._take("~") else None
        if not words:
            return None
        return self._each(lambda name: self._phrase_in(name, words, slop))

    def _phrase_in(self, name: str, words: list[tuple[int, list[str]]], slop: str | None) -> Q.Query | None:
        if len(words) == 1:
            if len(words[0][1]) == 1:
                return self._term(name, words[0][1][0])
            terms = [t[0].text for t in (self._analyze(name, w) for w in words[0][1]) if t]
            if not terms:
                return Q.BooleanQuery()
            return Q.TermQuery(name, terms[0]) if len(terms) == 1 else Q.MultiTermQuery(name, tuple((t, 1.0) for t in terms), len(terms))
        phrase, step, extra = Q.PhraseQuery(name), 0, 0
        for gap, alternatives in words:
            extra += step > 0  # the word before was a stop word: its place may hold anything
            step += gap + 1
            if len(alternatives) == 1:
                for t in self._analyze(name, alternatives[0]):
                    if t.pos_inc or not phrase.slots:
                        phrase = phrase.add_term(t.text, step or t.pos_inc)
                    else:
                        phrase = phrase.append(t.text)
                        extra += 1
                    step = 0
            else:
                placed = False
                for tokens in (self._analyze(name, w) for w in alternatives):
                    if tokens and not placed:
                        phrase, placed, step = phrase.add_term(tokens[0].text, step or tokens[0].pos_inc), True, 0
                    elif tokens:
                        phrase = phrase.append(tokens[0].text)
        return replace(phrase, slop=(int(slop) if slop and slop.isdigit() else 0) + extra)
