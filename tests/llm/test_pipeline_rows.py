"""Pipeline stages with awkward rows: nulls, empty texts, repeats, clashing columns; the last two stages against plain versions."""

import collections

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from fauntrack.llm import mixing, packing
from tests.llm.brute import WORD, jaccard_classes, line_drops
from tests.llm.test_documents import ROWS

EXTRA = "key string, drop int, of string, away long, copies int, n_lines string, n_dropped string, kept_sha256 string, n_words string, taken int, size int, _of int, _h int, _row int, a int, ent int, label int, stays string, w int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in ROWS]
    rows += [(3, dict(ROWS)[3], "en", "s0", 1), (None, "a line that stands nowhere else, with words " * 3, "en", "s1", 1), (None, None, None, None, None), (3, None, "en", "s0", 0)]
    values = tuple(None for _ in EXTRA.split(", "))
    values = tuple(f"x{k}" if " string" in c else k for k, c in enumerate(EXTRA.split(", ")))
    return spark.createDataFrame([r + values for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def extras(df):
    names = [c.split(" ")[0] for c in EXTRA.split(", ")]
    return {tuple(r) for r in df.select(*names).distinct().collect()}


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stage_keeps_columns(spark, docs, name):
    out = dict(P.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert extras(out) == extras(docs) and out.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stage_of_no_rows(spark, docs, name):
    assert dict(P.STAGES)[name](spark, docs.limit(0), "").count() == 0


def test_line_and_ngram_stages(spark, docs):
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None and not (r["doc_id"] == 3 and r["text"] is None)]
    want = {i: t for i, t in line_drops(sorted(set(plain), key=lambda r: r[0])).items() if t == dict(plain)[i] or (t or "").strip(" \t\n\x0b\x0c\r")}
    cut = P.line_dedup(spark, docs, "").where("doc_id is not null and not (doc_id = 3 and text is null)")
    got = [(r["doc_id"], r["text"]) for r in cut.collect()]
    assert dict(got) == want and collections.Counter(i for i, _ in got)[3] == 2  # both rows of the repeated document
    one = P.ngram_jaccard(spark, docs, "").where("doc_id is not null").collect()
    stays = {i for i, n, c in jaccard_classes(sorted(set(plain), key=lambda r: r[0])) if i == c}
    assert {r["doc_id"] for r in one} == stays
    count = collections.Counter((r["doc_id"], r["text"]) for r in one)
    assert max(count.values()) == 1 and count[(3, None)] == (3 in stays)


def test_mix_stage(spark, docs):
    """Copies follow from the operator's own words taken, which test_mixing checks; what is taken adds up to the targets."""
    taken, size, target = collections.Counter(), collections.Counter(), {}
    for r in mixing.mix_sources(docs).collect():
        taken[r["doc_id"]] += r["taken"]
        size[r["doc_id"]] += r["size"]
        target[(r["source_size"], r["target"])] = r["target"]
    got = collections.Counter(r["doc_id"] for r in P.mix_to_weights(spark, docs, "").collect())
    rows = collections.Counter(r["doc_id"] for r in docs.collect() if WORD.search(r["text"] or ""))
    assert got == {i: rows[i] * max(1, int(taken[i] / size[i] + 0.5)) for i in rows if taken[i]}
    assert abs(sum(taken.values()) - sum(target.values())) <= 3 * mixing.BLOCK * len(target)


def test_packing_stage(spark, docs):
    out = P.best_fit_packing(spark, docs, "").collect()
    tokens = sum(len(packing._json_encoder(packing.VOCABULARY).encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r["length"] for r in out) == tokens
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    # as few as can be told: the bound, and a plain best-fit decreasing packing is not better
    lengths = sorted((r["length"] for r in out), reverse=True)
    room = []
    for n in lengths:
        fit = min((k for k in range(len(room)) if room[k] >= n), key=lambda k: room[k], default=None)
        if fit is None:
            room.append(2048 - n)
        else:
            room[fit] -= n
    assert -(-tokens // 2048) <= len(by) <= len(room)
    assert docs.where(F.col("text").isNull()).count() == sum(r["length"] == 1 and r["piece"] == 0 for r in out) - sum(r["text"] == "" for r in docs.collect())
