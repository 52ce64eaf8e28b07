"""What the language model does by batch or by window it does not do by document or by word, with the same results."""

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa

from fauntrack.llm import gru, recurrent_lm

TEXTS = ["The THE\tthe ", "\x0bÉ é\x1cx\x85y\xa0z w", "", None, " \r\n", "a  b\x0c\x0cc", "W" * 70 + " " + "é" * 40 + " " + "É" * 65]


class Shared:
    def __init__(self, value):
        self.value = value


def plain_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" " + hashlib.sha256(w.encode()).hexdigest() if len(w) > 64 else w for w in words]


def counts_of(words):
    c = np.arange(len(words), 0, -1) * 10
    model_id = np.where(np.arange(len(words)) < 2, np.arange(len(words)) + 1, 0).astype(np.int32)
    return recurrent_lm.Counts(1000, 1100.0, 7, pa.array(words, pa.string()), c, model_id, np.array([500.0, 20.0, 10.0, 7.0]), 3, 0, -0.2)


def calls(f):
    n = [0]

    def note(frame, event, arg):
        n[0] += event in ("call", "c_call")

    sys.setprofile(note)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n[0]


def batch_of(texts):
    n = len(texts)
    return pa.record_batch([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array([False] * n), pa.array(texts, pa.string())], ["row", "doc_id", "held_out", "text"])


def test_words_of_a_batch():
    for texts in (TEXTS, TEXTS[2:5], [None], []):
        for column in (pa.array(texts, pa.string()), pa.array(["x y", *texts], pa.string()).slice(1), pa.array(texts, pa.large_string())):
            words, sizes = recurrent_lm.split_words(column)
            assert sizes.tolist() == [len(plain_words(t)) for t in texts]
            assert words.to_pylist() == [w for t in texts for w in plain_words(t)]


def test_counts_of_words(monkeypatch):
    want = {}
    for k, text in enumerate(TEXTS * 3):
        for w in plain_words(text):
            c, n = want.get(w, (0, 0))
            want[w] = c + (k % 4 > 0), n + 1
    batch = pa.record_batch([pa.array([k % 4 > 0 for k in range(len(TEXTS) * 3)]), pa.array(TEXTS * 3, pa.string())], ["t", "text"])
    for most in (16 << 20, 1):
        monkeypatch.setattr(recurrent_lm, "COUNTED", most)
        got = {}
        for b in recurrent_lm._count(iter([batch.slice(0, 9), batch.slice(9, 0), batch.slice(9)])):
            for w, c, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                a = got.get(w, (0, 0))
                got[w] = a[0] + c, a[1] + n
        assert got == want


def test_rows_of_documents(monkeypatch):
    words = ["the", "é", "a", plain_words("W" * 70)[0]]
    counts = counts_of(words)
    share, end = counts.log_share(counts.count), counts.log_share(np.array([7]))[0]
    for most in (4 << 20, 1):
        monkeypatch.setattr(recurrent_lm, "READ", most)
        rows = pa.Table.from_batches(list(recurrent_lm._read(Shared(counts))(iter([batch_of(TEXTS), batch_of([])])))).to_pylist()
        assert [r["row"] for r in rows] == list(range(len(TEXTS)))
        for r, text in zip(rows, TEXTS, strict=True):
            at = [words.index(w) if w in words else -1 for w in plain_words(text)]
            signs = [int(counts.model_id[k]) if k >= 0 else 0 for k in at]
            assert np.frombuffer(r["signs"], recurrent_lm.SIGN).tolist() == [*signs, 3]
            assert r["words"] == [w for w in plain_words(text) if w not in words]
            assert r["n_known"] == sum(k >= 0 for k in at) + 1
            assert abs(r["base_score"] - sum(share[k] for k in at if k >= 0) - end) < 1e-9
            assert abs(r["beside"] - sum((share[k] if k >= 0 else 0) + 0.2 for k, s in zip(at, signs, strict=True) if s == 0)) < 1e-9


def test_reading_makes_no_calls_by_document_or_word():
    read = recurrent_lm._read(Shared(counts_of(["word1", "word2", "word3"])))
    few, many = (calls(lambda n=n: list(read(iter([batch_of([f"word{k % 9} " * 20 for k in range(n)])])))) for n in (20, 2000))
    # what the helper that makes the batch calls is in both, by a few calls a text
    made = [calls(lambda n=n: batch_of([f"word{k % 9} " * 20 for k in range(n)])) for n in (20, 2000)]
    assert many - made[1] < few - made[0] + 50


def test_sums_by_key():
    rng = np.random.default_rng(4)
    for n, keys in ((1, 1), (500, 3), (500, 400), (4000, 90), (17, 1), (16, 1)):
        key = np.minimum(rng.geometric(0.1, n), keys).astype(np.int16)
        rows = rng.standard_normal((n, 5))
        found, sums = gru.row_sums(rows, key)
        assert sorted(found) == sorted(set(key.tolist()))
        assert np.allclose(sums, [rows[key == k].sum(axis=0) for k in found])


def test_large_weights_stay_finite():
    """Beyond PLAIN the exponents are shifted, and both ways agree where both hold."""
    mass = np.sort(np.random.default_rng(1).integers(1, 100, 40))[::-1] + 0.1
    shape = gru.Shape.of(mass, 5, 6)
    flat = gru.first_parameters(shape, mass)
    h = np.random.default_rng(2).standard_normal((40, 5)).astype(np.float32)
    plain = gru.Gru(shape, flat).output(h, np.arange(40))[0]
    gru_plain, gru.PLAIN = gru.PLAIN, -1.0
    try:
        shifted = gru.Gru(shape, flat).output(h, np.arange(40))[0]
    finally:
        gru.PLAIN = gru_plain
    assert np.allclose(plain, shifted, rtol=1e-5)
    assert np.isfinite(gru.Gru(shape, flat * 300).output(h, np.arange(40))[0]).all()
