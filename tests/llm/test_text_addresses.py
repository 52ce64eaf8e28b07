"""op8 finds texts again without writing them: by an address that copies with one doc_id share."""

from fauntrack.llm import ngram_join


def test_no_text_is_written_and_every_set_comes_once(spark, monkeypatch):
    near = [" ".join([*(f"w{k}" for k in range(40)), f"end{j}"]) for j in range(30)]
    rows = [(None, t) for t in near * 3] + [(5, t) for t in near * 2] + [(k, f"alone{k} " * 9) for k in range(10, 20)] + [(2, None), (2, " ")]
    written = {}
    kept = ngram_join.materialise

    def watch(df, name):
        out = kept(df, name)
        written.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(ngram_join, "materialise", watch)
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert not [name for name, some in written.items() for df in some if "text" in df.columns]
    (sets,) = written["ngram-sets"]
    assert sets.count() == sets.select("ent").distinct().count() == 40  # short sets are asked for too
    want = [(None, 37, 5)] * 90 + [(5, 37, 5)] * 60 + [(k, 5 if k else 0, k) for k in range(10, 20)] + [(2, 0, 2)] * 2
    alone = {k: (1, k) for k in range(10, 20)}
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(str, [(d, alone[d][0] if d in alone else n, c) for d, n, c in want]))
