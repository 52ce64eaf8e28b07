"""Language model scores against a brute force, and the model against finite differences and its own unigrams."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fauntrack.llm import gru, recurrent_lm


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), None]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def brute(rows):
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    counts = Counter(t for doc_id, text in rows if not held(doc_id) for t in tokens_of(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        tokens = tokens_of(text)
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        out.append((doc_id, held(doc_id), len(tokens), sum(counts[t] > 0 for t in tokens), total, base))
    return sorted(out, key=str)


def compare(df, rows):
    got = sorted((tuple(r) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=str)
    want = brute(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def small_model(words=40, width=5, classes=6, seed=1):
    mass = np.sort(np.random.default_rng(seed).integers(1, 100, words))[::-1] + 0.1
    shape = gru.Shape.of(mass, width, classes)
    return shape, mass, gru.first_parameters(shape, mass, seed)


def plain_score(shape, flat, doc, first):
    """One document, one token at a time, with plain loops over the published equations."""
    p = {k: v.astype(float) for k, v in shape.views(flat).items()}
    w, h, before, total = shape.width, np.zeros(shape.width), first, 0.0
    for y in doc:
        g, m = p["inputs"][before], h @ p["state"]
        z, r = (1 / (1 + np.exp(-(g[a : a + w] + m[a : a + w]))) for a in (0, w))
        h = (1 - z) * np.tanh(g[2 * w :] + r * m[2 * w :]) + z * h
        k = int(np.searchsorted(shape.starts, y, side="right")) - 1
        classes = np.exp(h @ p["to_class"] + p["class_bias"])
        a, b = shape.starts[k], shape.starts[k + 1]
        inside = np.exp(p["to_word"][a:b] @ h + p["word_bias"][a:b])
        total += math.log(classes[k] / classes.sum()) + math.log(inside[y - a] / inside.sum())
        before = y
    return total


def test_lanes_carry_the_state_through_whole_documents():
    shape, _, flat = small_model()
    flat = flat + np.random.default_rng(2).standard_normal(len(flat)).astype(np.float32) * 0.3
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 40, n) for n in (1, 7, 300, 2, 33, 64, 1, 150)]
    laid = gru.lanes(np.concatenate(docs), np.array([len(d) for d in docs]), 3, most=3)
    got = gru.Gru(shape, flat).scores(laid, len(docs), steps=16)
    assert np.allclose(got, [plain_score(shape, flat, d, 3) for d in docs], rtol=1e-4)


def test_probabilities_sum_to_one():
    shape, _, flat = small_model()
    h = np.random.default_rng(3).standard_normal((1, shape.width)).astype(np.float32)
    logs, _ = gru.Gru(shape, flat).output(np.repeat(h, 40, axis=0), np.arange(40))
    assert abs(np.exp(logs).sum() - 1) < 1e-5


def test_gradient_agrees_with_finite_differences(monkeypatch):
    monkeypatch.setattr(gru, "F32", np.float64)
    shape, mass, flat = small_model(words=12, width=3, classes=3)
    flat = flat.astype(float) + np.random.default_rng(8).standard_normal(shape.size) * 0.2
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 12, n) for n in (4, 9, 1, 6)]
    laid = gru.lanes(np.concatenate(docs), np.array([len(d) for d in docs]), 0, most=2)
    window = next(laid.windows(20))
    loss = lambda x: gru.Gru(shape, x).gradient(window, np.zeros((2, 3)), np.zeros(shape.size))[0]
    grad = np.zeros(shape.size)
    gru.Gru(shape, flat).gradient(window, np.zeros((2, 3)), grad)
    for k in rng.choice(shape.size, 60, replace=False):
        step = np.zeros(shape.size)
        step[k] = 1e-5
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-5 - grad[k]) < 1e-6


def test_even_lanes_hold_every_token_once():
    tokens, sizes = np.arange(1, 101), np.array([1, 50, 20, 29])
    laid = gru.even_lanes(tokens, sizes, 0, most=7)
    seen = [int(x) for _, now, _, doc in laid.windows(4) for x in now[doc >= 0]]
    assert sorted(seen) == list(tokens)


def odd_rows():
    rows = [(k, t) for k, t in enumerate(["The THE the", "É é É x", "a\x0bb\x0cc\td\r\ne  f", "no break space", "", None, "once", " ", "\n", "Zebra zebra ZEBRA"] * 4)]
    rows += [(100, "w" * 70 + " " + "W" * 70 + " é" * 3), (101, "long " * 3000), (None, "null id"), (None, None), (3, "repeated id"), (3, "repeated id"), (110, "é" * 40 + " " + "é" * 65)]
    return rows + [(k, "only held out words") for k in range(200, 300) if held(k)]


def test_base_agrees_with_brute_force(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, row int, words string").repartition(3)
    compare(recurrent_lm.score_documents(docs), rows)


def test_rare_words_are_joined(spark, monkeypatch):
    rows = odd_rows()
    monkeypatch.setattr(recurrent_lm, "HEAD_KEYS", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(recurrent_lm.score_documents(docs), rows)


def test_empty_table_and_no_training_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert recurrent_lm.score_documents(docs).count() == 0
    rows = [(None, "a b"), (None, "")]
    compare(recurrent_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_total_probability_of_words_is_one(spark, monkeypatch):
    """The model's signs and the shares of other words make a distribution over seen words and one unseen."""
    monkeypatch.setattr(recurrent_lm, "WORDS", 5)
    rows = [(k, f"w{k % 7} w{k % 3} x{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = recurrent_lm.word_counts(docs)
    counts, _ = recurrent_lm.corpus_counts(docs, found)
    own = {w for w, k in counts.index.items() if counts.model_id[k] != counts.other}
    others = [r["c"] for r in found.collect() if r["c"] > 0 and r["word"].encode() not in own]
    assert others and abs((10 ** counts.log_share(np.array([*others, 0]))).sum() / 10**counts.log_other - 1) < 1e-9


@pytest.fixture(scope="module")
def scored(spark):
    return recurrent_lm.op11_recurrent_lm(spark, "/root/testdata/sf0.01").toPandas()


def test_documents(spark, scored):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    compare(spark.createDataFrame(scored), rows)


def test_model_beats_the_counts_on_held_out_documents(scored):
    held_out = scored[scored.held_out]
    assert len(held_out) > 50 and np.isfinite(scored.score).all()
    gain = (held_out.score - held_out.base_score) / held_out.n_tokens
    assert held_out.score.sum() > held_out.base_score.sum() and (gain > 0).mean() > 0.6


def test_every_training_document_passes_through_the_network(spark, monkeypatch):
    """No training document is left out, and no held-out one taken, however many rounds there are."""
    rows = [(k, f"word{k} " * (k % 5)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts, _ = recurrent_lm.corpus_counts(docs, recurrent_lm.word_counts(docs))
    seen = spark.sparkContext.accumulator(0)

    def counting(shared, shape, end):
        def run(batches):
            for b in batches:
                seen.add(sum(len(x) // recurrent_lm.SIGN.itemsize for x in b.column("signs").to_pylist()))
            yield from ()

        return run

    monkeypatch.setattr(recurrent_lm, "_train", counting)
    recurrent_lm.train(recurrent_lm.documents(docs, counts), 10_000, counts)
    assert seen.value == counts.tokens == sum(k % 5 + 1 for k, _ in rows if not held(k))
