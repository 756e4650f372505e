"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features, and those of its neighbours,
score the two labels; a transition matrix ties labels of lines that follow each
other. Forward-backward gives each line's marginal; a document's mean marginal,
weighted by line length, is calibrated to a probability.

Lines have no labels of their own. A good document's lines are taken to be good
ones; which lines of a bad document are bad is latent: first all are, and then
those that the model finds bad, with the rest of the document's worse half. So
labels change inside of documents, and the transitions learn how they do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._numpy import counts_in, lines, slices, words
from ._spark import small_batches, text_of

#: The model is fitted on all lines of so many labelled documents at most (the first by a hash of their ids).
TRAIN_DOCS = 8000
STEPS, RATE, DECAY, ROUNDS = 120, 0.15, 1e-3, 1

#: Kinds of bytes that are counted per line.
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "bang": b"!?", "symbol": b"#$%&*@^~=+<>{}[]\\_`", "bar": b"|", "stop": b".,;:"}
_KIND = np.zeros((len(_KINDS) + 1, 256), dtype=bool)
for _row, _members in enumerate(_KINDS.values()):
    _KIND[_row, list(_members)] = True
_KIND[-1, 0xC0:] = True  # heads of characters of several bytes
OWN, SHARED = 15, 8
FEATURES = OWN + 2 * SHARED + 2


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (lines x FEATURES), the texts' offsets among them, and the lines' weights."""
    found = lines(texts)
    w = words(texts, lower=False)
    n = len(found.begin)
    size = (found.end - found.begin).astype(np.float64)
    lo, hi = np.searchsorted(w.begin, found.begin), np.searchsorted(w.begin, found.end)
    count = (hi - lo).astype(np.float64)
    data = w.data
    sums = {}
    for name, kind in zip([*_KINDS, "wide"], _KIND, strict=True):
        sums[name] = counts_in(kind[data], found.begin, found.end).astype(np.float64)
    h = w.hashes()
    same = np.zeros(len(h) + 1)
    same[2:] = np.cumsum(h[1:] == h[:-1])  # same[j] counts the words before j that repeat the one before them
    repeated = np.where(count > 1, same[hi] - same[np.minimum(lo + 1, len(h))], 0)
    solid = np.concatenate(([0], np.cumsum(w.end - w.begin)))
    letters = np.maximum(1, solid[hi] - solid[lo])
    total_hash = np.concatenate(([np.uint64(0)], np.cumsum(h)))
    line_hash = total_hash[hi] - total_hash[lo]
    per_word = np.maximum(1, count)
    last = np.zeros(n, dtype=np.uint8)
    some = hi > lo
    last[some] = data[w.end[hi[some] - 1] - 1]

    x = np.zeros((n, FEATURES))
    x[:, 0] = sums["upper"] / letters
    x[:, 1] = np.minimum(2, sums["bang"] / per_word)
    x[:, 2] = np.minimum(1, 4 * sums["symbol"] / letters)
    x[:, 3] = np.minimum(1, 2 * sums["bar"] / per_word)
    x[:, 4] = sums["digit"] / letters
    x[:, 5] = repeated / per_word
    x[:, 6] = np.minimum(2, sums["stop"] / per_word)
    x[:, 7] = np.log1p(size) / 8
    x[:, 8] = np.minimum(3, letters / per_word / 10)
    x[:, 9] = sums["wide"] / letters
    x[:, 10] = np.isin(last, np.frombuffer(b".!?:;\"'", dtype=np.uint8))
    x[:, 11] = count == 0
    x[:, 12] = count == 1
    x[1:, 13] = (line_hash[1:] == line_hash[:-1]) & some[1:]
    x[:, 14] = 1
    first = np.zeros(n, dtype=bool)
    first[found.of_text[:-1]] = True
    x[first, 13] = 0
    final = np.roll(first, -1)
    x[1:, OWN : OWN + SHARED] = x[:-1, :SHARED]
    x[first, OWN : OWN + SHARED] = 0
    x[:-1, OWN + SHARED : OWN + 2 * SHARED] = x[1:, :SHARED]
    x[final, OWN + SHARED : OWN + 2 * SHARED] = 0
    x[:, -2], x[:, -1] = first, final
    return x, found.of_text, size + 1


def _messages(step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of one chain of 2 x 2 ``step`` matrices, each scaled to sum 1.

    The chain is cut into some sqrt(n) blocks: their products, side by side,
    give the messages at the cuts, and from these those inside, side by side.
    So a text of very many lines takes few steps.
    """
    n = len(step)
    width = max(1, int(np.ceil(np.sqrt(n))))
    blocks = -(-n // width) if n else 0
    a = np.tile(np.eye(2), (blocks * width, 1, 1))
    a[:n] = step
    a = a.reshape(blocks, width, 2, 2)
    whole = np.tile(np.eye(2), (blocks, 1, 1))
    for t in range(width):
        whole = whole @ a[:, t]
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    ahead, back = np.empty((blocks, width, 2)), np.empty((blocks, width, 2))
    left, right = np.full((blocks + 1, 2), 0.5), np.full((blocks + 1, 2), 0.5)
    for k in range(blocks):
        left[k + 1] = left[k] @ whole[k]
        left[k + 1] /= left[k + 1].sum()
        right[blocks - k - 1] = whole[blocks - k - 1] @ right[blocks - k]
        right[blocks - k - 1] /= right[blocks - k - 1].sum()
    v, w = left[:-1], right[1:]
    for t in range(width):
        v = (v[:, None, :] @ a[:, t])[:, 0]
        v = v / v.sum(axis=1, keepdims=True)
        ahead[:, t] = v
        back[:, width - 1 - t] = w
        w = (a[:, width - 1 - t] @ w[:, :, None])[:, :, 0]
        w = w / w.sum(axis=1, keepdims=True)
    return ahead.reshape(-1, 2)[:n], back.reshape(-1, 2)[:n]


@dataclass
class LineCrf:
    """Weights for the label good (bad scores 0), the transitions [from, to], and the calibration."""

    weights: np.ndarray
    transitions: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def forward_backward(self, unary: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of good for every line, and of pairs of labels for every line and the one before it (0 for a first line)."""
        size = np.diff(offsets)
        # Two-state messages, scaled at every step.
        e = np.exp(np.clip(np.stack((np.zeros_like(unary), unary), axis=1), -50, 50))
        move = np.exp(self.transitions)
        step = move[None] * e[:, None, :]
        step[offsets[:-1][size > 0]] = 0.5 * e[offsets[:-1][size > 0]][:, None, :]  # a first line forgets what was before
        ahead, back = _messages(step)
        both = ahead * back
        good = both[:, 1] / both.sum(axis=1)
        pairs = np.zeros((len(unary), 2, 2))
        inner = np.ones(len(unary), dtype=bool)
        inner[offsets[:-1][size > 0]] = False
        at = np.flatnonzero(inner)
        p = ahead[at - 1][:, :, None] * move[None] * (e[at] * back[at])[:, None, :]
        pairs[at] = p / p.sum(axis=(1, 2), keepdims=True)
        return good, pairs

    def raw(self, x: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginals, as log odds; every text has one line at least."""
        good, _ = self.forward_backward(x @ self.weights, offsets)
        mean = np.add.reduceat(good * weight, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1])
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.raw(*line_features(texts)) * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def latent_labels(good: np.ndarray, weight: np.ndarray, label: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Line labels by the lines' marginals: 1 in good documents; in bad ones 0 where bad is likelier, and in the worse half by length."""
    of = np.repeat(np.arange(len(label)), np.diff(offsets))
    order = np.lexsort((good, of))
    before = np.cumsum(weight[order]) - weight[order]
    begin = before[offsets[:-1]]  # lines keep their documents' places in this order
    total = np.add.reduceat(weight, offsets[:-1])
    worse = np.empty(len(good), dtype=bool)
    worse[order] = before - begin[of] < total[of] / 2
    return np.where(label[of] == 1, 1.0, ((good > 0.5) & ~worse).astype(np.float64))


def _climb(model: LineCrf, x: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> None:
    """Raise the conditional likelihood of the line labels ``y``."""
    inner = np.ones(len(y), dtype=bool)
    inner[offsets[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))  # transitions
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    mean, square = [np.zeros(FEATURES), np.zeros((2, 2))], [np.zeros(FEATURES), np.zeros((2, 2))]
    for step in range(1, STEPS + 1):
        good, pairs = model.forward_backward(x @ model.weights, offsets)
        slopes = [x.T @ (y - good) / len(y) - DECAY * model.weights, (seen - pairs.sum(axis=0)) / len(y) - DECAY * model.transitions]
        for i, g in enumerate(slopes):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            move = RATE * (1 - step / STEPS) * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
            if i == 0:
                model.weights = model.weights + move
            else:
                model.transitions = model.transitions + move


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineCrf:
    """Fit on documents with labels 0 and 1 (others and nulls are left out).

    The model maximises the line labels' conditional likelihood, with Adam on
    whole gradients, and bad documents' line labels are drawn anew from it
    ROUNDS times. Rows that repeat count as often; of a very long text all
    lines count; other columns are ignored. Without labelled documents every
    score is 0.5.
    """
    small_batches(docs.sparkSession)
    some = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    share = min(1.0, 2 * TRAIN_DOCS / max(1, some.count()))  # what can't be among the first isn't sorted
    some = some.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = some.orderBy(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)), "__id", "__label").limit(TRAIN_DOCS)  # bounded, and so fit to be broadcast
    picked = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).join(F.broadcast(some), "__id").select("__label", "__text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                x, offsets, weight = line_features(batch.column(1).slice(a, b - a))
                keep = [slice(int(p), int(q)) for p, q in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x[k].astype(np.float32).tobytes() for k in keep]), pa.array([weight[k].tobytes() for k in keep])], names=["label", "x", "weight"])

    rows = picked.mapInArrow(features, "label int, x binary, weight binary").toArrow().to_pylist()
    model = LineCrf(np.zeros(FEATURES), np.zeros((2, 2)))
    if not rows:
        return model
    rows.sort(key=lambda r: (r["x"], r["label"]))
    x = np.concatenate([np.frombuffer(r["x"], dtype=np.float32) for r in rows]).reshape(-1, FEATURES).astype(np.float64)
    weight = [np.frombuffer(r["weight"]) for r in rows]
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in weight])))
    weight = np.concatenate(weight)
    label = np.array([r["label"] for r in rows])
    y = np.repeat(label, np.diff(offsets)).astype(np.float64)
    _climb(model, x, offsets, y)
    for _ in range(ROUNDS):
        good, _ = model.forward_backward(x @ model.weights, offsets)
        _climb(model, x, offsets, latent_labels(good, weight, label, offsets))

    # A logistic curve over the documents' log odds: a few Newton steps.
    z = model.raw(x, offsets, weight)
    design, c = np.stack((z, np.ones_like(z)), axis=1), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ c, -40, 40)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        c = c + np.clip(np.linalg.solve(hess, design.T @ (label - p) - 0.1 * (c - [1.0, 0.0])), -1, 1)
    model.slope, model.shift = max(0.05, float(c[0])), float(c[1])
    return model


def score(docs: DataFrame, model: LineCrf, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` in place of one of that name: the probability that the document is good.

    Null and empty texts are scored as one empty line; further columns pass
    unchanged; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c != "score"]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(columns))
            parts = [held.value.score(texts.slice(a, b - a)) for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate([np.zeros(0), *parts]))], names=[*columns, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in columns)
    return docs.select(*[F.col(f"`{c}`") for c in columns], text_of(text_col).alias("__text")).mapInArrow(scored, f"{schema}, score double")
