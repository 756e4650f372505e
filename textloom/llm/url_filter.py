"""Wildcard rules over URLs by one bit-parallel automaton.

All glob rules are packed into the words of multiword Shift-And masks. A rule
of m elements takes m + 1 bits: bit i says that its first i elements are
matched. One shift, one AND with the mask of the character at hand and one AND
for the stars that stay in place advance every rule at once; numpy does this
for all URLs of a batch side by side.

Globs: ``*`` is any run without ``/``, ``**`` any run, ``?`` one character but
``/``; all else stands for itself. Globs are anchored at both ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import ascii_lower


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for the hosts at or below ``host`` whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.name}**", f"*.{self.name}**"]


def rule(verdict: str, text: str) -> Rule:
    """``rule("block", "net/es/")``; the path begins at the first slash."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


class Automaton:
    """Shift-And masks of many globs over an alphabet of the characters that they name."""

    def __init__(self, globs: Sequence[str]):
        parsed = [self._parse(g) for g in globs]
        named = sorted({c for items, _ in parsed for c in items if c is not None} | {"/"})
        self.code_points = np.array([ord(c) for c in named], dtype=np.uint32)
        other = len(named)
        bits = sum(len(items) + 1 for items, _ in parsed)
        self.words = max(1, -(-bits // 64))
        step = np.zeros((other + 1, self.words), dtype=np.uint64)
        stay = np.zeros_like(step)
        self.start = np.zeros(self.words, dtype=np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        slash, at = named.index("/"), 0
        for items, stars in parsed:
            self._set(self.start, at)
            for i, c in enumerate(items):
                for a in range(other + 1) if c is None else [named.index(c)]:
                    if c is not None or a != slash:
                        self._set(step[a], at + i + 1)
            for i, across in stars.items():
                for a in range(other + 1):
                    if across or a != slash:
                        self._set(stay[a], at + i)
            at += len(items) + 1
            self.final.append(((at - 1) // 64, np.uint64(1 << (at - 1) % 64)))
        self.step, self.stay = step, stay

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << bit % 64)

    @staticmethod
    def _parse(glob: str) -> tuple[list[str | None], dict[int, bool]]:
        """Elements (None: any character but a slash) and, by state, whether its star crosses slashes."""
        items: list[str | None] = []
        stars: dict[int, bool] = {}
        i = 0
        while i < len(glob):
            if glob[i] == "*":
                run = len(glob[i:]) - len(glob[i:].lstrip("*"))
                stars[len(items)] = stars.get(len(items), False) or run > 1
                i += run
            else:
                items.append(None if glob[i] == "?" else glob[i])
                i += 1
        return items, stars

    def match(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Booleans (texts x globs) for the texts at ``codes[begin : begin + size]`` (code points)."""
        place = np.minimum(np.searchsorted(self.code_points, codes), len(self.code_points) - 1)
        letters = np.where(self.code_points[place] == codes, place, len(self.code_points))
        order = np.argsort(-size, kind="stable")
        first, length = begin[order], size[order]
        state = np.tile(self.start, (len(order), 1))
        live = np.searchsorted(-length, -np.arange(1, (int(length[0]) if len(length) else 0) + 1), side="right")
        for t, k in enumerate(live.tolist()):
            d, c = state[:k], letters[first[:k] + t]
            moved = d << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:k] = (moved & self.step[c]) | (d & self.stay[c])
        out = np.empty((len(order), len(self.final)), dtype=bool)
        for j, (w, bit) in enumerate(self.final):
            out[order, j] = (state[:, w] & bit) != 0
        return out


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict.

    The longest rule that fits decides (of equally long ones the first), else
    ``default`` with a null rule. A null URL, or one without ``://``, has an
    empty host and path. Rows that repeat stay apart; no rules and empty tables
    are allowed; further columns are ignored.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = [g for r in ranked for g in r.globs()]
    machine = Automaton(globs)
    per_rule = len(globs) // max(1, len(ranked))
    names = [r.name for r in ranked]
    verdicts = [r.verdict for r in ranked]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [h + p for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            fits = machine.match(codes, np.cumsum(size) - size, size).reshape(len(texts), len(ranked), per_rule).any(axis=2)
            best = fits.argmax(axis=1).tolist() if ranked else [0] * len(texts)
            some = fits.any(axis=1).tolist()
            won = [b if s else -1 for b, s in zip(best, some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([names[b] if b >= 0 else None for b in won], pa.string()), pa.array([verdicts[b] if b >= 0 else default for b in won], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return rows.mapInArrow(judged, f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, verdict string")
