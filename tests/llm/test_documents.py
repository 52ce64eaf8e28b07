"""Operators on documents against brute force, with awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fauntrack.llm import line_dedup, mixing, ngram_join, packing, pii, quality, substring_dedup
from tests.llm import brute


def make(n=90, seed=4):
    rng = random.Random(seed)
    words = ["bcdfghjklmnpqrstvwxz"[k % 20] + "aeiou"[k // 20 % 5] + "nrst"[k // 100] for k in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 260))) for _ in range(n // 2)]
    passage = " ".join(rng.choices(words, k=60))
    out = []
    for k in range(n):
        t = rng.choice(base).split(" ")
        r = rng.random()
        if r < 0.4:
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
        if r > 0.7:
            at = rng.randrange(len(t))
            t[at:at] = passage.split(" ")
        for _ in range(rng.randint(0, 3)):
            t.insert(rng.randrange(len(t) + 1), "\n")
        out.append((k, " ".join(t)))
    long = " ".join(rng.choices(words, k=9000))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "a b"), (n + 4, "A b"), (n + 5, long), (n + 6, long + " end"), (n + 7, "x" * 3000), (n + 8, "é" * 700), (n + 9, "\n".join(["the same line stands here again and again"] * 5))]
    rng.shuffle(out)
    return out


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names clash with the operators' own
    return spark.createDataFrame([(i, t, "s", 7, "k", 1.0) for i, t in ROWS], "doc_id long, text string, source string, n int, key string, size double")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_jaccard_classes(docs):
    assert got(ngram_join.jaccard_classes(docs), "doc_id", "n_shingles", "component_id") == brute.jaccard_classes(ROWS)


def test_jaccard_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "")]
    d = spark.createDataFrame([*rows, (None, "q r s t u v")], "doc_id long, text string")
    assert sorted(map(str, got(ngram_join.jaccard_classes(d).fillna(-1), "doc_id", "component_id"))) == sorted(map(str, [(1, 1), (1, 1), (2, 1), (3, 3), (-1, -1)]))


def test_signatures_find_every_link_of_random_sets():
    """Two sets with J >= 0.8 share a signature, or both ran out of partitions."""
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(5, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        n = len(a)
        change = int(rng.integers(0, max(1, n // 9) + 1))
        b = np.unique(np.r_[a[rng.permutation(n)[: n - change]], rng.integers(0, 1 << 63, int(rng.integers(0, change + 1)), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if 5 * both < 4 * (len(a) + len(b) - both):
            continue
        frequent = np.sort(a[rng.random(n) < 0.2])
        sig, who, failed = ngram_join.signatures(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), frequent)
        assert failed.all() or set(sig[who == 0]) & set(sig[who == 1])


def test_substring_dedup(docs):
    assert got(substring_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.removed(ROWS)


def test_substring_dedup_repeated_rows(spark):
    t = "".join(random.Random(1).choices("abcdefgh ", k=400))
    d = spark.createDataFrame([(5, t), (5, t), (None, t), (7, t[:150])], "doc_id long, text string")
    r = sorted((x["n_bytes"], x["n_removed"]) for x in substring_dedup.remove_repeats(d).collect())
    assert r == [(150, 150), (400, 0), (400, 400), (400, 400)]


def test_line_dedup(docs):
    want = brute.line_drops(ROWS)
    out = line_dedup.dedup_lines(docs)
    assert {"source", "n", "size"} <= set(out.columns)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    assert all(r["kept_sha256"] == hashlib.sha256((want[r["doc_id"]] or "").encode()).hexdigest() for r in out.collect())


def test_edit_distance_is_exact():
    rng = random.Random(3)
    a = [bytes(rng.choices(b"abc", k=rng.randint(0, 40))) for _ in range(800)]
    b = []
    for x in a:
        y = bytearray(x)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(y))
            y[k : k + rng.randint(0, 1)] = rng.choice([b"", b"z", b"a"])
        b.append(bytes(y))
    for k in (1, 2, 3):
        assert line_dedup.within_edits(a, b, k).tolist() == [brute.edits(x, y) <= k for x, y in zip(a, b, strict=True)]


def test_quality_counts(docs):
    want = sorted((i, *brute.main_words(t)) for i, t in ROWS)
    r = quality.quality_report(docs)
    assert got(r, "doc_id", *quality.COUNTS) == want
    for x in r.collect():
        assert x["base_failed"] == (x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"])
        assert not (x["kept"] and x["base_failed"])


def test_quality_filter_agrees_with_report(docs):
    assert got(quality.quality_filter(docs), "doc_id") == got(quality.quality_report(docs).where("kept"), "doc_id")


def test_packing(docs):
    rows = packing.pack(docs).collect()
    ids = {i: [*packing._json_encoder(packing.VOCABULARY).encode(t or "", add_special_tokens=False).ids, 0] for i, t in ROWS}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(parts):
            own = ids[i][at : at + r["length"]]
            assert (r["piece"], r["start"]) == (k, at) and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
            assert k == 0 or r["length"] == packing.CAPACITY
            at += r["length"]
        assert at == len(ids[i])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY


def test_packing_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    x = np.minimum(2048, np.maximum(1, rng.lognormal(6.3, 1, 20_000).astype(int)))
    h = dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True)), strict=True))
    rows, n = packing.plan_packing(h)
    assert n <= 1.003 * (-(-x.sum() // 2048)) + 1
    assert {k: int(rows[rows[:, 0] == k][:, 2].sum()) for k in h} == h


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.randint(0, 300)), rng.choice(["a", "b", "B", None, "é", "a"])) for k in range(600)] + [(7, "w w", "a"), (7, "w w", "a"), (900, None, "b")]
    r = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, r)) == sorted(map(tuple, again)) and len(r) == len(rows)
    total = {}
    for i, t, s in rows:
        total[s] = total.get(s, 0) + len(brute.WORD.findall(t or ""))
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    lo, hi = 0.0, 1e9
    for _ in range(200):  # water level by bisection
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * total[s], mid * weight[s]) for s in names) < 1.5 * sum(total.values()) else (lo, mid)
    by = {}
    for x in r:
        assert 0 <= x["taken"] <= 2 * x["size"]
        by.setdefault((x["source_size"], round(x["target"], 3)), 0)
        by[(x["source_size"], round(x["target"], 3))] += x["taken"]
    assert set(by) == {(total[s], round(min(2 * total[s], lo * weight[s]), 3)) for s in names}
    assert all(abs(t - target) <= 3 * mixing.BLOCK for (_, target), t in by.items())


@pytest.fixture(scope="module")
def tagger():
    return pii.train(["the quick brown fox jumps over a dog and runs home again", "alpha beta gamma delta epsilon zeta eta theta"])


def test_base_spans_and_model(tagger, spark):
    t = "mail a.b@x.org, ip 10.0.0.255 or 1.2.3.999, card 4111 1111 1111 1111, phone +1 (068) 555-2748. é"
    (base, _), (none, no), (_, spans) = pii.all_spans([t, "nothing here at all, 12 of 13", x := "some words of a text before 6625883203433323 and some more after it"], tagger)
    assert [t[s:e] for s, e in base["email"]] == ["a.b@x.org"] and [t[s:e] for s, e in base["ip"]] == ["10.0.0.255"]
    assert [t[s:e] for s, e in base["card"]] == ["4111 1111 1111 1111"] and [t[s:e] for s, e in base["phone"]] == ["+1 (068) 555-2748"]
    assert "6625883203433323" in [x[s:e] for k, s, e in spans if k == 2]
    assert not no and not any(none.values())


def test_tagger_on_held_out_spans(tagger):
    rng, hits, wrong, there = np.random.default_rng(99), [0] * 4, [0] * 4, [0] * 4
    for _ in range(600):
        kind, span = pii._made_up(rng)
        text = f"some words before {span} and some after"
        found = [(k, text[s:e]) for k, s, e in pii.all_spans([text], tagger)[0][1]]
        if kind is not None:
            there[kind] += 1
            hits[kind] += (kind, span) in found
        for x in found:
            wrong[x[0]] += x != (kind, span)
    assert all(h / n >= 0.7 for h, n in zip(hits, there, strict=True)), (hits, there)
    assert all(h / (h + w) >= 0.8 for h, w in zip(hits, wrong, strict=True)), (hits, wrong)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(8)
    parts = ["a", "x.y", "@", "@@", "b-c.org", ".", "-", "--", " ", "  ", "(", ")", "+", "+1", "4111111111111111", "4111 1111", "1111-1111", "10.0.0.1", "256", "1.2.3", ".7", "0", "00000000012", "555", "\u0663", "\u00a0", "é"]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(x):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(x))) % 10 == 0

    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        want = {k: [m.span() for m in re.finditer(p, text) if holds(k, m[0])] for k, p in patterns.items()}
        assert pii.base_spans(text) == want, text


def test_model_reads_long_and_dense_texts(tagger):
    for text in ("1 2/" * 20_000, "@" * 50_000, "7" * 50_000, "a@b " * 10_000):
        (_, spans), = pii.all_spans([text], tagger)
        assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
    x = "word " * 3000 + "+1 555\u2013123\u20134567" + " word" * 3000
    assert "+1 555\u2013123\u20134567" in [x[s:e] for k, s, e in pii.all_spans([x], tagger)[0][1] if k == 3]


def test_pii_query_rows(docs):
    r = pii.find_personal_data(docs).collect()
    assert sorted(x["doc_id"] for x in r) == sorted(i for i, _ in ROWS)
    assert all(x["base_sha256"] == hashlib.sha256(b"").hexdigest() for x in r if not (x["n_email"] + x["n_ip"] + x["n_card"] + x["n_phone"]))


@pytest.mark.parametrize("f", [ngram_join.jaccard_classes, substring_dedup.remove_repeats, line_dedup.dedup_lines, quality.quality_report, quality.quality_filter, packing.pack, mixing.mix_sources, pii.find_personal_data])
def test_empty_tables(spark, f):
    assert f(empty(spark)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = P.quality_rules(spark, docs, str(tmp_path))
    cut = P.line_dedup(spark, kept, str(tmp_path))
    one = P.ngram_jaccard(spark, cut, str(tmp_path))
    assert kept.columns == cut.columns == one.columns == columns
    texts = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    assert len(texts) > 50
    want = {i: t for i, t in brute.line_drops(texts).items() if t.strip(" \t\n\x0b\x0c\r")}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want
    stays = {i for i, _, c in brute.jaccard_classes(sorted(want.items())) if i == c}
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == stays
    assert P.run(spark, str(tmp_path)).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_components_both_ways(spark, monkeypatch):
    from fauntrack.llm import linkage

    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    u = brute.Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    want = sorted((x, u.find(x)) for x in u.up)
    d = spark.createDataFrame(edges, "a long, b long")
    assert got(linkage.components(d), "node", "label") == want
    monkeypatch.setattr(linkage, "ONE_TASK_EDGES", 0)
    assert got(linkage.components(d), "node", "label") == want
