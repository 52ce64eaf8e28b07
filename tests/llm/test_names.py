"""Names of lines, words and contexts: patterns that meet under polynomial hashes stay apart; names that meet by chance too."""

import hashlib

import numpy as np
import pytest

from fauntrack.llm import common, line_dedup, ngram_join, substring_dedup
from tests.llm import brute


def doubling(n):
    """A string whose k-th letter is the parity of k's bits, and its complement."""
    x = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[v] for v in x), "".join("ba"[v] for v in x)


@pytest.mark.parametrize("n", [1024, 4096])
def test_unlike_lines_and_words_stay(spark, n):
    a, b = doubling(n)
    rows = [(1, a), (2, b), (3, a)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(d).collect()} == {1: 0, 2: 0, 3: 1}
    assert sorted(map(tuple, ngram_join.jaccard_classes(d).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_contexts_of_patterns(spark):
    a, b = doubling(512)
    rows = [(1, a + b), (2, b + a), (3, a[:200] + "x" + b[:300])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in substring_dedup.remove_repeats(d).collect()) == brute.removed(rows)


def test_strong_hash_names_bytes():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 99, 6000).astype(np.uint8)
    start = rng.integers(0, 5000, 4000)
    end = start + np.r_[rng.integers(0, 40, 3900), rng.integers(400, 900, 100)]
    names = {}
    for h, s, e in zip(common.strong_hash(buf, start, end).tolist(), start, end, strict=True):
        assert names.setdefault(h, buf[s:e].tobytes()) == buf[s:e].tobytes()
    assert len(names) == len(set(names.values()))


def test_names_that_meet_by_chance(spark, monkeypatch):
    """With names of a few values, the tags keep unlike lines and sets apart and like ones together."""

    class Short:
        def __init__(self, x):
            self.x = x

        def digest(self):
            full = hashlib.sha256(self.x).digest()
            return bytes([full[0] & 1]) + bytes(7) + full[:8]

    lines = [f"some line of more than a few words {k * 7919}" for k in range(12)]
    rows = [(k, "\n".join(lines[(k + j) % 12] for j in range(3))) for k in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    batches = d.select("doc_id", "text").toArrow().to_batches()
    import pyarrow as pa

    monkeypatch.setattr(line_dedup.hashlib, "blake2b", lambda x, digest_size: Short(x))
    own = []
    for b in batches:
        b = b.append_column("of", pa.array(range(b.num_rows), pa.int64()))
        for out in line_dedup._sign(2)([b]):
            own += [r for r in out.to_pylist() if r["kind"] == line_dedup.K.OWN]
    monkeypatch.undo()
    assert len({r["b"] for r in own}) == 2 and len({(r["b"], r["payload"]) for r in own}) == 12
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(r["a"], r["bucket"], r["b"], bytearray(r["payload"])) for r in own], "doc long, line int, ent long, tag binary")
    named = line_dedup.K.spread(table, spark.createDataFrame([], "ent long, tag binary, label long"), F.struct("doc", "line"), "t").collect()
    assert len(named) == 12 and all(r["rows"] == r["total"] == 3 for r in named)
