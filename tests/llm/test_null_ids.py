"""Near copies whose doc_id is null or repeated are linked like any others, one text a set."""

import random

from fauntrack.llm import ngram_join


def near_copies(n, rng):
    words = [f"word{k}" for k in range(60)]
    out = []
    for _ in range(n):
        text = list(words)
        text[rng.randrange(60)] = f"other{rng.randrange(9)}"
        out.append(" ".join(text))
    return out


def test_near_copies_without_ids(spark):
    rng = random.Random(5)
    texts = near_copies(3000, rng)
    rows = [(None, t) for t in texts[:2000]] + [(7, t) for t in texts[2000:]] + [(None, "alone " + " ".join(f"x{k}" for k in range(20))), (None, None), (3, "too short")]
    asked = []
    kept = ngram_join.materialise

    def watch(df, name):
        out = kept(df, name)
        if name == "ngram-sets":
            asked.append((out.count(), out.select("ent").distinct().count()))
        return out

    ngram_join.materialise = watch
    try:
        got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    finally:
        ngram_join.materialise = kept
    assert asked and all(a == b for a, b in asked)  # a set comes from one row, however many have its doc_id
    assert len(got) == len(rows)
    assert sorted({(r["n_shingles"], r["component_id"]) for r in got}, key=str) == sorted({(56, 7), (17, None), (0, None), (1, 3)}, key=str)
