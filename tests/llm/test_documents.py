"""The operators on documents, against plain versions and on odd inputs."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import line_crf, maxent_lm
from textloom.llm._components import components
from textloom.llm.bpe import decode, encode
from textloom.llm.decontaminate import RADIUS, HammingIndex, contaminated
from textloom.llm.exact_dedup import chunks, exact_groups
from textloom.llm.line_dedup import dedup_lines
from textloom.llm.ngram_join import near_duplicates
from textloom.llm.pii import KINDS, find_spans
from textloom.llm.queries import byte_bpe

from . import brute

SCHEMA = "doc_id long, text string, n_lines string, ids string, score string, id long, sig long, recipe string, h long, n long"
ODD = [None, "", " ", "\n\n", "one", "é" * 300, "x" * 20_000, "word " * 3000, "A b\tC\x0bd e", "\U0001f600 " * 50, "same text here for all of them", "Same  Text here\nfor all of them"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1, 2, "r", 3, 4) for i, t in rows], SCHEMA)


def corpus(seed=5, size=60):
    """Documents with exact and near copies, shared lines, and odd texts; ids don't follow the order."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["the", "of", "and"]
    lines = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(6)]
    texts = list(ODD)
    for _ in range(size):
        kind = rng.random()
        if kind < 0.3 and len(texts) > len(ODD):
            w = rng.choice(texts[len(ODD) :]).split(" ")
            for _ in range(rng.choice([0, 1, 1, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        elif kind < 0.4:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 9))))
        else:
            own = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 30))) for _ in range(rng.randint(1, 4))]
            texts.append("\n".join([*own, *rng.sample(lines, rng.randint(0, 3))]))
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def df(spark, docs):
    return frame(spark, docs).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).limit(0)


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(df, docs, weak):
    options = {"hash_of": lambda c: F.length(c).cast("long") % 3} if weak else {}
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_groups(df, **options).collect()}
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    assert got == {i: (max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_of_rows_that_repeat_ids(spark, weak):
    options = {"hash_of": lambda c: F.lit(7).cast("long")} if weak else {}
    rng = random.Random(8)
    cases = [
        [(1, "same"), (1, "same"), (2, "same"), (3, "other")],
        [(1, "aaaaaaaaa"), (1, "bbbbbbbbb")],
        [(rng.randrange(6), "".join(rng.choices(["er ", "of ", "xyz"], k=rng.choice([0, 1, 2, 400, 1200])))) for _ in range(80)],
    ]
    for rows in cases:
        rows = rows + rows[:3]
        groups = {}
        for i, t in rows:
            groups.setdefault(t, []).append(i)
        expected = sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t]), sha(t)) for i, t in rows)
        assert sorted(tuple(r) for r in exact_groups(frame(spark, rows), **options).collect()) == expected


def test_chunks_cover_the_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("aeiou nrst\nlx", k=n)) for n in (1, 511, 512, 513, 5000, 30_000)] + ["z" * 10_000, "\U0001f600" * 5000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r["c"]) == r["t"] for r in got)
    long = next(r["c"] for r in got if len(r["t"]) == 30_000)
    assert 10 < len(long) < 60 and all(512 <= len(c) <= 4096 for c in long[:-1])


def test_line_dedup(df, docs):
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in dedup_lines(df).collect())
    assert got == brute.kept_lines(docs)
    assert any(x[2] for x in got)


def test_line_dedup_of_equal_ids_and_marks(spark):
    line = "A line that is long enough to be counted as one, é"
    rows = [(i % 6, f"  {line.upper() if i % 2 else line}\t\nown {i}\n{line}") for i in range(12)]
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in dedup_lines(frame(spark, rows)).collect())
    assert got == brute.kept_lines(rows)


def test_twice_seen_holds_every_hash_seen_twice(spark):
    import numpy as np

    from textloom.llm import _bloom

    rng = random.Random(12)
    seen = [rng.getrandbits(64) for _ in range(3000)] + [rng.getrandbits(64)] * 4
    seen += rng.sample(seen, 300)
    rows = spark.createDataFrame([(x - (1 << 63),) for x in seen], "h long").repartition(7)
    hashes = lambda batch: iter([batch.column(0).to_numpy().view(np.uint64)])
    words = _bloom.twice_seen(rows, hashes, 1 << 18)
    kept = np.array([x - (1 << 63) for x in sorted(set(seen))]).view(np.uint64)
    hit = _bloom.maybe(words, kept)
    assert all(hit[i] for i, x in enumerate(sorted(set(seen))) if seen.count(x) > 1)
    assert hit.sum() < 450


def test_line_dedup_counts_lines_on_bytes(spark):
    rows = [(1, "\n"), (2, "\né\n\n\U0001f600"), (3, None), (4, ""), (5, "\r\n\r"), (6, "a\nb\n")]
    got = dedup_lines(frame(spark, rows))
    assert {r["doc_id"]: r["n_lines"] for r in got.collect()} == {i: (t or "").count("\n") + 1 for i, t in rows}
    assert "translate(" not in got._jdf.queryExecution().toString()


def test_line_dedup_of_a_very_long_text(spark):
    shared = "a line that is long enough to be counted here"
    long = "\n".join([shared, *(f"line {i} of a text of twenty million bytes, give or take" for i in range(350_000)), shared])
    rows = [(0, long), *((i, f"{shared}\nown {i}") for i in range(1, 6))]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], sha(r["text"])) for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == {i: (n, d, sha(t)) for i, n, d, t in brute.kept_lines(rows)}


def test_near_duplicates(df, docs):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect())
    assert got == brute.components(docs)
    assert len({x[2] for x in got}) < len(got) - 5


def test_near_duplicates_whose_names_clash(spark, df, docs, monkeypatch):
    """With names of four bits at first, sets that share one are told apart by both halves."""
    import numpy as np

    from textloom.llm import ngram_join

    real = ngram_join._signatures

    def weak(sets, offsets, shared):
        a, b = real(sets, offsets, np.zeros(0, np.uint64))
        plain = a & np.uint64(15)
        return np.where(np.isin(plain, shared), a, plain), b

    monkeypatch.setattr(ngram_join, "_signatures", weak)
    monkeypatch.setattr(ngram_join, "HELD", 500)
    named = df.withColumn("doc_id", F.format_string("%06d", "doc_id"))
    got = sorted((int(r["doc_id"]), r["n_shingles"], int(r["component_id"])) for r in near_duplicates(named).collect())
    assert got == brute.components(docs)


def test_near_duplicates_in_a_chain_of_small_sets(spark):
    rng = random.Random(3)
    base = [f"v{i}" for i in range(11)]
    rows = [(i, " ".join(base[: 5 + i % 7] if i % 3 else rng.sample(base, 7))) for i in range(60)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == brute.components(rows)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (30, 30)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def test_contaminated(spark, docs, df):
    rng = random.Random(2)
    sources = [t for _, t in docs if t and len(t.split()) > 8]
    items = [(i, t) for i, t in enumerate([*rng.sample(sources, 6), " ".join(rng.choice(sources).split()[2:9]), "w1 w2", "one", "", None, "no such words in here at all"])]
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.contaminated(docs, items)
    assert len(got) > 8


def test_contaminated_with_a_shared_template(spark):
    """Items that share all but one shingle, and documents that differ from them in one heavy shingle: as far as can be at this similarity."""
    shared = [f"t{i}" for i in range(43)]
    items = [(i, " ".join([*shared, f"own{i}"])) for i in range(200)]
    texts = [(i, " ".join([*shared, f"other{i}"])) for i in range(40)] + [(40, "lead " * 30 + items[7][1] + " tail" * 30)]
    got = contaminated(frame(spark, texts).repartition(2), spark.createDataFrame(items, "item_id long, text string")).collect()
    found, truth = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got}, brute.contaminated(texts, items)
    assert found.items() <= truth.items() and len(found) >= 0.95 * len(truth) and len(truth) > 8000
    assert max(r["distance"] for r in got) <= RADIUS
    assert next(r["distance"] for r in got if (r["doc_id"], r["item_id"]) == (40, 7)) == 0


def test_contaminated_recall_of_near_copies(spark):
    """Passages with words changed here and there: nearly all that are similar are found, and nothing else."""
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(20, 90)))) for i in range(25)]
    texts = []
    for k in range(150):
        w = items[k % 25][1].split()
        for _ in range(k // 25):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append((k, " ".join([*rng.choices(vocabulary, k=rng.randint(0, 60)), *w, *rng.choices(vocabulary, k=rng.randint(0, 60))])))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    truth = brute.contaminated(texts, items)
    assert got.keys() <= truth.keys() and len(got) >= 0.97 * len(truth) and len(truth) > 50
    assert sum(abs(got[k] - truth[k]) < 1e-8 for k in got) >= 0.97 * len(got)


def test_contaminated_in_several_blocks(spark, docs, df, monkeypatch):
    rng = random.Random(2)
    items = [(f"i{i}", t) for i, t in enumerate([*rng.sample([t for _, t in docs if t and len(t.split()) > 8], 6), "w1 w2", "one", None])]
    one = contaminated(df, spark.createDataFrame(items, "item_id string, text string")).collect()
    monkeypatch.setattr("textloom.llm.decontaminate.ITEM_CHARS", 200)
    assert sorted(map(str, contaminated(df, spark.createDataFrame(items, "item_id string, text string")).collect())) == sorted(map(str, one)) and one


@pytest.mark.parametrize("radius", [5, 17, RADIUS])
def test_hamming_index_misses_nothing(radius):
    import numpy as np

    rng = np.random.default_rng(0)
    prints = rng.integers(0, 256, (60, 16), dtype=np.uint8)
    queries = np.repeat(prints, 20, axis=0)
    flips = rng.random((len(queries), 128)) < rng.random((len(queries), 1)) * 0.4
    queries = queries ^ np.packbits(flips, axis=1)
    index = HammingIndex(prints, radius)
    q, i, d = index.search(queries)
    truth = np.unpackbits(queries[:, None] ^ prints[None], axis=2).sum(axis=2)
    assert {*zip(q.tolist(), i.tolist(), d.tolist(), strict=True)} == {(a, b, int(truth[a, b])) for a, b in zip(*np.nonzero(truth <= radius), strict=True)}
    # The blocks prune: of random pairs few are compared.
    many = rng.integers(0, 256, (1000, 16), dtype=np.uint8)
    assert len(index.candidates(many)[0]) < 0.1 * len(many) * len(prints)


@pytest.mark.parametrize("small", [False, True])
def test_bpe(spark, small, monkeypatch):
    if small:  # several slices, few buckets, short pieces
        for name, value in (("SLICE_TEXT", 3000), ("BUCKETS", 3), ("PIECE", 64)):
            monkeypatch.setattr(f"textloom.llm.bpe.{name}", value)
    tokenizer, library = byte_bpe(), byte_bpe().load()
    rng = random.Random(4)
    parts = ["'", "s", "'ll", " ", "  ", "\n", "a", "É", "1", "²", "!", "日本", "\t", "😀", "\x85", "<|endoftext|>", "don't", "word", None]
    rows = [(i, None if rng.random() < 0.02 else "".join(x or "" for x in rng.choices(parts, k=rng.randint(0, 20)))) for i in range(400)] + list(enumerate(ODD, 1000)) + [(5, "twice"), (5, "twice")]
    got = [(r["doc_id"], r["ids"], r["text"]) for r in decode(encode(frame(spark, rows), tokenizer), tokenizer).collect()]
    fused = [(r["doc_id"], r["ids"], r["text"]) for r in encode(frame(spark, rows), tokenizer, decoded="text").collect()]
    assert sorted(fused, key=str) == sorted(got, key=str)
    expected = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_bpe_of_a_very_long_text(spark):
    rng = random.Random(14)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(5000)] + ["don't", "été", "\n", "12", "!?"]
    text = " ".join(rng.choices(words, k=1_000_000))
    got = encode(frame(spark, [(1, text), (2, "short")]), byte_bpe(), decoded="text").orderBy("doc_id").select("doc_id", F.size("ids").alias("n"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids"), F.sha2("text", 256).alias("text")).collect()
    ids = byte_bpe().load().encode(text, add_special_tokens=False).ids
    assert tuple(got[0]) == (1, len(ids), sha(",".join(map(str, ids))), sha(text)) and got[1]["doc_id"] == 2


def test_row_sums_of_short_and_long_lists():
    import numpy as np

    rng = np.random.default_rng(3)
    for sizes in ([1], [16], [17], [1, 2, 3, 15, 16, 17, 31, 33], [5000, 1, 256, 257, 4096, 16], rng.integers(1, 40, 300).tolist()):
        g = rng.random((50, 32)).astype(np.float32)
        owner = rng.integers(0, 50, sum(sizes))
        first = np.cumsum([0, *sizes[:-1]])
        got = maxent_lm.row_sums(g, owner, first)
        assert got.dtype == np.float32
        np.testing.assert_allclose(got, [g[owner[a : a + n]].astype(float).sum(axis=0) for a, n in zip(first, sizes, strict=True)], rtol=1e-5)


def test_gradients_are_all_positions_sums():
    """Each row of weights gets the sum over its positions once: short and long lists, and rows that features share."""
    import numpy as np

    rng = np.random.default_rng(4)
    for n, spread in ((1, 50), (127, 3), (128, 400), (300, maxent_lm.ROWS), (2048, 30), (2048, 300), (2048, maxent_lm.ROWS)):
        g = rng.normal(size=(n, maxent_lm.CLASSES)).astype(np.float32)
        rows = np.minimum(rng.zipf(1.2, (n, maxent_lm.FEATURES)), spread) * 37 % maxent_lm.ROWS
        rows[: n // 3, 1] = maxent_lm.ALWAYS
        rows[:, -2], rows[:, -1] = maxent_lm.SAME[rng.integers(0, 16, n)], maxent_lm.ALWAYS
        expected, often = np.zeros((maxent_lm.ROWS, maxent_lm.CLASSES)), np.bincount(rows.ravel(), minlength=maxent_lm.ROWS)
        np.add.at(expected, rows, g[:, None].astype(float))
        got = list(maxent_lm.gradients(g, rows))
        row, times, total = (np.concatenate(x) for x in zip(*got, strict=True))
        assert sorted(row) == np.flatnonzero(often).tolist() and (times == often[row]).all()
        assert total.dtype == np.float32 and max(len(r) for r, _, _ in got) <= maxent_lm.BATCH
        np.testing.assert_allclose(total, expected[row], rtol=1e-4, atol=1e-3)


def test_training_moves_weights_as_plain_sgd_does():
    """Weights and counts after some batches are those of sums over all positions and features, in doubles."""
    import numpy as np
    import pyarrow as pa

    from textloom.llm._numpy import words

    rng = random.Random(6)
    texts = pa.array([" ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(n)) for n in (3000, 0, 1, 2500, 17)] + ["the the the the x"])
    w = words(texts)
    none = np.zeros(0, np.uint64)
    start = np.random.default_rng(5).normal(0, 0.2, (maxent_lm.ROWS, maxent_lm.CLASSES)).astype(np.float32)
    model = maxent_lm.Model(none, none, words(pa.array(["the w1 w2"])).hashes(), np.arange(maxent_lm.SUFFIXES) % maxent_lm.BUCKETS + maxent_lm.SINGLES, start)
    token, kind, word, offsets = maxent_lm.sequences(w, w.hashes(), model.classes(w, w.hashes()))
    rows, before = maxent_lm.contexts(token, offsets)
    assert (rows[:, -1] == maxent_lm.ALWAYS).all() and set(rows[:, -2].tolist()) <= set(maxent_lm.SAME.tolist())
    own = np.where((before != 0) & (token == before) & (word >= 0), maxent_lm.REPEAT, kind)
    weights, seen = start.astype(float), np.zeros(maxent_lm.ROWS)
    for at in range(0, len(token), maxent_lm.BATCH):
        i = slice(at, at + maxent_lm.BATCH)
        z = weights[rows[i]].sum(axis=1)
        z[before[i] == 0, maxent_lm.REPEAT] = -np.inf
        g = np.exp(z - z.max(axis=1, keepdims=True))
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(g)), own[i]] -= 1
        moved = np.zeros_like(weights)
        np.add.at(moved, rows[i], g[:, None])
        seen += np.bincount(rows[i].ravel(), minlength=maxent_lm.ROWS)
        weights -= maxent_lm.RATE * moved / np.sqrt(np.maximum(seen, 1))[:, None]
    for b in maxent_lm._trained(model, iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
        for r in b.to_pylist():
            part, n = slice(r["block"] * maxent_lm.BLOCK, (r["block"] + 1) * maxent_lm.BLOCK), np.frombuffer(r["seen"])
            assert (n == seen[part]).all()
            got = np.frombuffer(r["w"], dtype=np.float32).reshape(-1, maxent_lm.CLASSES)[n > 0] / n[n > 0, None]
            np.testing.assert_allclose(got, weights[part][n > 0], rtol=1e-4, atol=1e-4)


def test_probabilities_gather_a_row_less_a_position_and_bear_large_weights():
    """The rows of the last two features are added up before they are looked up; sums of weights may be far from 0."""
    import numpy as np

    class Counted(np.ndarray):
        taken = 0

        def take(self, at, *args, **kwargs):
            Counted.taken += np.size(at)
            return np.asarray(self).take(at, *args, **kwargs)

    rng = np.random.default_rng(7)
    token, offsets = rng.integers(1, 60, 1000).astype(np.uint64), np.array([0, 400, 1000])
    rows, before = maxent_lm.contexts(token, offsets)
    for size in (0.3, 40, 4000):
        weights = rng.normal(0, size, (maxent_lm.ROWS, maxent_lm.CLASSES)).astype(np.float32)
        Counted.taken = 0
        got = maxent_lm.class_probabilities(weights.view(Counted), rows, before != 0)
        assert 0 < Counted.taken <= (maxent_lm.FEATURES - 1) * len(token) + len(maxent_lm.SAME)
        z = weights.astype(float)[rows].sum(axis=1)
        z[before == 0, maxent_lm.REPEAT] = -np.inf
        p = np.exp(z - z.max(axis=1, keepdims=True))
        np.testing.assert_allclose(got, p / p.sum(axis=1, keepdims=True), rtol=1e-5 * max(1, size), atol=1e-6 * max(1, size))
        assert np.isfinite(got).all() and (got[before == 0, maxent_lm.REPEAT] == 0).all()


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    """Spans shorter and longer than a piece, at its edges, have one hash whatever the size of pieces."""
    import numpy as np

    from textloom.llm import _numpy

    data = np.random.default_rng(8).integers(0, 256, 100_000).astype(np.uint8)
    cut = np.unique(np.random.default_rng(9).integers(0, 60_000, 4000))
    begin, end = np.append(cut[:-1:2], 60_000), np.append(cut[1::2][: len(cut[:-1:2])], 100_000)
    got = []
    for piece in (1 << 20, _numpy.HASHED, 64, 7):
        monkeypatch.setattr(_numpy, "HASHED", piece)
        got.append(_numpy.span_hashes(data, begin, end))
    assert all((x == got[0]).all() for x in got) and int(got[0][0]) == int(_numpy.span_hashes(data[begin[0] : end[0]], np.array([0]), np.array([end[0] - begin[0]]))[0])


def test_memory_is_given_back_when_nothing_holds_it(monkeypatch):
    import weakref

    import numpy as np

    from textloom.llm import _numpy

    held, alive = [], []

    def work(n):
        words = np.zeros(n)
        held.append(weakref.ref(words))
        return n + 1

    monkeypatch.setattr(_numpy, "give_back", lambda: alive.append(held[-1]() is not None))
    assert _numpy.lean(work)(5) == 6 and alive == [False]


def test_a_process_loads_a_tokenizer_once():
    """Every bucket and task has its own copy of the tokenizer; the library's, whose memory does not all come back, is one."""
    import pickle

    from textloom.llm import bpe

    bpe._library.cache_clear()
    copies = [pickle.loads(pickle.dumps(byte_bpe())) for _ in range(3)]
    assert len({id(c.load()) for c in copies}) == 1 and bpe._library.cache_info().misses == 1
    assert bpe._library.cache_info().maxsize == 1


def test_bpe_of_all_characters():
    """Python's Unicode tables and the library's may be of different versions; the ids are the same."""
    import numpy as np
    import pyarrow as pa

    from textloom.llm import bpe

    tokenizer, library, classes = byte_bpe(), byte_bpe().load(), bpe.char_classes()
    points = [chr(c) for c in [*range(0x3000), *range(0x3000, 0xD800, 7), *range(0xE000, 0x32000, 11), *range(0xE0000, 0xE01F0)]]
    texts = [f"x{c}y 1{c} {c}{c}a '{c}" for c in points]
    ends, words = bpe._words(pa.array(texts), classes, tokenizer.added)
    ids, sizes = bpe._ids_of(library, words.to_pylist())
    bounds = np.concatenate(([0], np.cumsum(sizes)))[ends].tolist()
    got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_decoding_takes_any_ids(spark):
    tokenizer = byte_bpe()
    lists = [[220, 50256, 0], [99999, -1, 64], [], None, [161, 64]]
    got = {r["i"]: r["text"] for r in decode(spark.createDataFrame(list(enumerate(lists)), "i long, ids array<int>"), tokenizer).collect()}
    library = tokenizer.load()
    assert got == {0: library.decode(lists[0], skip_special_tokens=False), 1: "a", 2: "", 3: "", 4: library.decode(lists[4])}


def test_pii(spark):
    rng = random.Random(6)
    parts = ["me@a.b", "x@y", "a.b@c.d.e_f@g.h", "1.2.3.4", "300.1.1.1", "0001.2.3.4.5.6", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+44", "é", "😀", " ", "call", "12", ".", "-", "+", "(212) 555-0100", "joe at mail dot com", "@"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(300)] + list(enumerate(ODD, 1000)) + [(7, "me@a.b"), (7, "me@a.b")]
    got = [(r["doc_id"], sorted((s["start"], s["kind"], s["end"]) for s in r["base"]), [(s["start"], s["kind"], s["end"]) for s in r["spans"]]) for r in find_spans(frame(spark, rows)).collect()]
    assert sorted((i, b) for i, b, _ in got) == sorted((i, brute.pii(t)) for i, t in rows)
    for _, base, spans in got:
        assert spans == sorted(spans) and set(base) <= set(spans) and all(0 <= k < len(KINDS) for _, k, _ in spans)
        assert all(a[2] <= b[0] or b[2] <= a[0] for a in set(spans) - set(base) for b in base)


def planted_pii(rng, n=600):
    """Texts with personal data that the base rules don't have, and with look-alikes; and the spans that are meant."""
    words = ["river", "stone", "green", "over", "walks", "slowly", "and", "the"]
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    name = lambda: rng.choice(["joe", "ann", "li", "max"]) + rng.choice(["", ".roe", "_k", digits(2)])
    true = [
        lambda: ("write to ", f"{name()} at {rng.choice(['mail', 'example'])} dot {rng.choice(['com', 'org', 'de'])}", 0), lambda: ("contact: ", f"{name()} [at] {rng.choice(['host', 'site'])}.{rng.choice(['net', 'fr', 'com'])}", 0),
        lambda: ("server ", ":".join("".join(rng.choices("0123456789abcdef", k=4)) for _ in range(8)), 1), lambda: ("please call ", f"({rng.randint(200, 989)}) 555-{digits(4)}", 3), lambda: ("tel. ", f"{rng.randint(200, 989)}-555-{digits(4)}", 3), lambda: ("phone: ", f"{rng.randint(2, 9)}{digits(2)} {digits(2)} {digits(2)}", 3),
    ]
    false = [lambda: f"order {digits(3)}-{digits(3)}-{digits(4)}", lambda: f"serial 1{digits(2)}.{digits(3)}.{digits(4)}x", lambda: "look at once dot stop", lambda: f"version {digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}", lambda: f"invoice 0{digits(2)}-{digits(3)}-{digits(4)}"]
    rows, meant = [], set()
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(1, 6))) + " "
        for _ in range(rng.randint(0, 2)):
            lead, span, kind = rng.choice(true)()
            text += lead
            meant.add((i, len(text), kind, len(text) + len(span)))
            text += span + " , " + rng.choice(words) + " "
        if rng.random() < 0.5:
            text += rng.choice(false)() + " " + rng.choice(words)
        rows.append((i, text))
    return rows, meant


def test_pii_adds_what_base_rules_miss(spark):
    """Precision and recall of the spans that the classifier adds, on planted ones; no labels are used."""
    rows, meant = planted_pii(random.Random(33))
    added = set()
    for r in find_spans(frame(spark, rows)).collect():
        base = {tuple(x)[:3] for x in r["base"]}
        added |= {(r["doc_id"], s["start"], s["kind"], s["end"]) for s in r["spans"] if tuple(s)[:3] not in base}
    right = len(added & meant)
    print("added", len(added), "meant", len(meant), "precision", right / len(added), "recall", right / len(meant))
    assert right / len(added) >= 0.9 and right / len(meant) >= 0.8


def test_pii_learns_from_votes():
    from textloom.llm.pii import posterior, reliabilities

    share, tables = reliabilities([((1, 1, 1, 1), 500), ((1, 1, 0, 1), 300), ((-1, -1, 0, 1), 400), ((-1, -1, 0, -1), 200), ((0, 1, 1, 1), 30)])
    assert 0.4 < share < 0.75
    assert posterior((1, 1, 1, 1), share, tables) > 0.95 > 0.05 > posterior((-1, -1, 0, -1), share, tables)
    assert tables[0][1][1] > tables[0][1][0]


def test_forward_backward_against_all_labellings():
    """Marginals of lines and pairs, and the length-weighted mean, by enumerating every sequence of labels."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    sizes = [1, 2, 5, 3, 6]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    unary, weight, move = rng.normal(size=offsets[-1]) * 2, rng.uniform(1, 50, offsets[-1]), rng.normal(size=(2, 2))
    model = line_crf.LineCrf(np.ones(1), move)
    good, pairs = model.forward_backward(unary, offsets)
    z = model.raw(unary[:, None], offsets, weight)
    for d, (a, n) in enumerate(zip(offsets, sizes, strict=False)):
        p, two, total = np.zeros(n), np.zeros((n, 2, 2)), 0.0
        for y in itertools.product((0, 1), repeat=n):
            s = np.exp(sum(unary[a + i] * y[i] for i in range(n)) + sum(move[y[i - 1], y[i]] for i in range(1, n)))
            total += s
            p += s * np.array(y)
            for i in range(1, n):
                two[i, y[i - 1], y[i]] += s
        assert np.allclose(good[a : a + n], p / total) and np.allclose(pairs[a : a + n], two / total)
        mean = (p / total * weight[a : a + n]).sum() / weight[a : a + n].sum()
        assert z[d] == pytest.approx(np.log(mean / (1 - mean)))


def test_line_labels_are_latent():
    import numpy as np

    good, weight, offsets = np.array([0.9, 0.8, 0.1, 0.9, 0.7, 0.4, 0.6]), np.array([9.0, 1, 5, 4, 2, 1, 1]), np.array([0, 2, 5, 7])
    got = line_crf.latent_labels(good, weight, np.array([1, 0, 0]), offsets)
    assert got.tolist() == [1, 1, 0, 1, 0, 0, 1]  # of the second, the lines with the first half of its length stay bad


def test_quality(spark):
    rng = random.Random(7)
    clean = lambda: " ".join(rng.choices(["river", "stone", "walks", "over", "green"], k=12)).capitalize() + "."
    junk = lambda: " ".join(x.upper() + "!!" for x in rng.choices(["buy", "now", "cheap"], k=12))
    rows = [(i, "\n".join([clean(), *[junk() if i % 2 else clean() for _ in range(i % 5)], clean()])) for i in range(300)]
    rows = [(i, t) for i, t in rows if i % 5 or i % 2 == 0]
    labels = spark.createDataFrame([(i, int(not (i % 2 and i % 5))) for i, _ in rows] + [(1, None), (-5, 1)], "doc_id long, quality int")
    data = frame(spark, rows)
    model = line_crf.fit(data, labels.filter("doc_id < 200"))
    got = {r["doc_id"]: r["score"] for r in line_crf.score(data, model).collect()}
    assert all((got[i] >= 0.3) == (not (i % 2 and i % 5)) for i, _ in rows if i >= 200)
    odd = line_crf.score(frame(spark, list(enumerate(ODD))), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert line_crf.fit(data, labels.limit(0)).score(__import__("pyarrow").array(["x"]))[0] == 0.5


def test_quality_learns_from_all_lines(spark):
    """Two texts that differ after line 256 only, with labels that differ, are told apart."""
    same = ["river stone walks over green."] * 300
    rows = [(i, "\n".join([*same, *(["BUY!!! NOW!!!"] * 300 if i % 2 else same)])) for i in range(8)]
    model = line_crf.fit(frame(spark, rows), spark.createDataFrame([(i, 1 - i % 2) for i in range(8)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in line_crf.score(frame(spark, rows), model).collect()}
    assert all((got[i] > 0.5) == (i % 2 == 0) for i in got)


def test_language_model(spark, docs, df):
    held = lambda i: i % 5 == 0
    train = df.filter("doc_id % 5 <> 0").select(F.coalesce("text", F.lit("")).alias("text"))
    model, counts = maxent_lm.fit(train)
    got = {r["doc_id"]: r for r in maxent_lm.score(df, model, counts).collect()}
    count = {}
    for i, t in docs:
        if not held(i):
            for w in brute.words(t):
                count[w] = count.get(w, 0) + 1
    n_docs = sum(not held(i) for i, _ in docs)
    total, distinct = sum(count.values()) + n_docs, len(count) + 1
    for i, t in docs:
        w = brute.words(t)
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in [*(count.get(x, 0) for x in w), n_docs])
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["n_tokens"] == len(w) + 1 and got[i]["n_known"] == sum(x in count for x in w) + 1
        assert got[i]["score"] < 0
    assert model.total == total


def test_language_model_probabilities_add_up(spark, df):
    """After any context, all known words, an unknown one of each class and the end have probability 1."""
    import numpy as np
    import pyarrow as pa

    from textloom.llm._numpy import words

    model, counts = maxent_lm.fit(df.select(F.coalesce("text", F.lit("")).alias("text")))
    known = [(r["word"], r["n"]) for r in counts.collect()]
    w = words(pa.array([" ".join(k for k, _ in known)]))
    cls = model.classes(w, w.hashes())
    token = np.array([w.hashes()[3], w.hashes()[3], np.uint64(0)])
    rows, before = maxent_lm.contexts(token, np.array([0, 3]))
    for at in range(3):
        may = np.array([bool(before[at]) and bool(model.find(before[at : at + 1])[0] >= 0)])
        p = maxent_lm.class_probabilities(model.weights, rows[at : at + 1], may)[0]
        inside = 10 ** model.inside(np.array([n for _, n in known], dtype=float), cls)
        unknown = sum(p[c] * 10 ** float(model.inside(np.array([0.0]), np.array([c]))[0]) for c in range(maxent_lm.SINGLES, maxent_lm.END))
        used = sorted(set(cls.tolist()) - set(range(maxent_lm.SINGLES, maxent_lm.END)))
        idle = sum(p[c] for c in range(maxent_lm.SINGLES) if c not in used)
        assert p[maxent_lm.END] + p[maxent_lm.REPEAT] + (p[cls] * inside).sum() + unknown + idle == pytest.approx(1, abs=1e-4)


def test_language_model_learns_from_every_position(spark):
    """All positions move the weights; suffixes are counted in all texts, however long, and not across texts."""
    import numpy as np
    import pyarrow as pa

    from textloom.llm._numpy import words

    texts = ["a b c d e f g", "x y", "", "the " + "cat sat " * 5000]
    singles = words(pa.array(["the"])).hashes()
    seen, mass = maxent_lm.suffix_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), singles)
    assert mass.sum() == sum(len(t.split()) for t in texts) and seen.sum() == 3
    none = np.zeros(0, np.uint64)
    model = maxent_lm.Model(none, none, singles, np.full(maxent_lm.SUFFIXES, maxent_lm.SINGLES), np.zeros((maxent_lm.ROWS, maxent_lm.CLASSES), np.float32))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    moved = sum(np.frombuffer(r["seen"]).sum() for b in maxent_lm._trained(model, iter([batch])) for r in b.to_pylist())
    assert moved == maxent_lm.FEATURES * sum(len(t.split()) + 1 for t in texts)


def test_language_model_scores_do_not_depend_on_the_lookup(spark, docs, df, monkeypatch):
    """Words repeat whether they are looked up or joined: frequent, rare, long and unknown ones."""
    long = "z" * 60
    more = [(900, f"{long} {long} w3 w3 {long}"), (901, "q1 q1 q1 q2 q2 w5"), (902, "w79 w79 and and"), (903, "unseen unseen unseen w1")]
    every = df.unionByName(frame(spark, more)).repartition(3).cache()
    train = every.filter("doc_id <> 903").select(F.coalesce("text", F.lit("")).alias("text"))
    got = []
    for frequent, size in ((1 << 18, 48), (40, 48), (1 << 18, 1 << 20)):
        monkeypatch.setattr(maxent_lm, "FREQUENT", frequent)
        monkeypatch.setattr(maxent_lm, "FREQUENT_BYTES", size)
        model, counts = maxent_lm.fit(train)
        got.append({r["doc_id"]: r["score"] for r in maxent_lm.score(every, model, counts).collect()})
    assert got[1] == pytest.approx(got[0], rel=1e-6) and got[2] == pytest.approx(got[0], rel=1e-6)
    rare = maxent_lm.score(frame(spark, [(1, "unseen unseen unseen"), (2, "unseen other strange")]), model, counts).collect()
    assert len({r["base_score"] for r in rare}) == 1 and len({r["score"] for r in rare}) == 2


def test_one_very_long_text(spark):
    """Three million bytes in one text, several pieces and slices, for the operators that see words or lines."""
    rng = random.Random(15)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(4000)]
    body = "\n".join(" ".join(rng.choices(words, k=12)) + "." for _ in range(45_000))
    item = " ".join(body[1_048_300:1_048_900].split()[1:-1])
    rows = frame(spark, [(1, body), (2, body + " end"), (3, "short text"), (4, None)]).cache()
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    found = contaminated(rows, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["distance"], r["similarity"]) for r in found) == [(1, 0, 1.0), (2, 0, 1.0)]
    model = line_crf.fit(rows, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))
    assert line_crf.score(rows, model).count() == 4
    lm, counts = maxent_lm.fit(rows.filter("doc_id <> 2").select(F.coalesce("text", F.lit("")).alias("text")))
    got = {r["doc_id"]: r["n_tokens"] for r in maxent_lm.score(rows, lm, counts).collect()}
    assert got == {1: len(body.split()) + 1, 2: len(body.split()) + 2, 3: 3, 4: 1}
    assert {r["doc_id"]: r["group_size"] for r in exact_groups(rows).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "some item that has words enough")], "item_id long, text string")
    tokenizer = byte_bpe()
    model, counts = maxent_lm.fit(empty.select(F.coalesce("text", F.lit("")).alias("text")))
    crf = line_crf.fit(empty, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    for got in (
        exact_groups(empty), dedup_lines(empty), near_duplicates(empty), contaminated(empty, items), contaminated(empty, items.limit(0)), decode(encode(empty, tokenizer), tokenizer),
        find_spans(empty), line_crf.score(empty, crf), maxent_lm.score(empty, model, counts),
    ):
        assert got.collect() == []
    some = frame(spark, [(1, "a b"), (2, None)])
    assert [r["n_known"] for r in maxent_lm.score(some, model, counts).collect()] == [0, 0]
    assert contaminated(some, items.limit(0)).collect() == []


def test_null_ids(spark):
    rows = frame(spark, [(None, "one two three four five six"), (None, None), (3, "one two three four five six")])
    assert sorted(r["group_size"] for r in exact_groups(rows).collect()) == [1, 2, 2]
    assert dedup_lines(rows).count() == 3
    assert [r["component_id"] for r in near_duplicates(rows).collect() if r["n_shingles"]] == [3, 3]
    assert find_spans(rows).count() == 3 and encode(rows, byte_bpe()).count() == 3


def test_pattern_sources_agree():
    assert re.compile(brute.PII[0]).search("a@b.c")


def test_lm_reads_each_text_once_to_score_it(spark):
    """Each row gives its own sums and its rare words in one pass; rows that repeat stay apart."""
    rows = [(1, "oak elm oak"), (2, "zzq zzq new"), (2, "zzq zzq new"), (3, ""), (3, None), (None, "oak"), (4, "y" * 60 + " elm")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = maxent_lm.fit(spark.createDataFrame([("oak elm",), ("elm ash",), ("y" * 60,)], "text string"))
    out = maxent_lm.score(df, model, counts)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"]) for r in out.collect()))
    assert got == [(-1, 2, 2), (1, 4, 4), (2, 4, 1), (2, 4, 1), (3, 1, 1), (3, 1, 1), (4, 3, 3)]
    same = [(r["base_score"], r["score"]) for r in out.filter("doc_id = 2").collect()]
    assert same[0] == pytest.approx(same[1])
