"""Token alignment against a brute force over byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fauntrack.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_alphabet():
    """The printable stand-in of each byte in a byte-level vocabulary, by its published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in plain):
        names[b] = chr(256 + k)
    return {v: k for k, v in names.items()}


def brute(models, rows):
    """(doc_id, text) rows to the contract's columns, offset by offset."""
    a_model, b_model = models
    alphabet = byte_alphabet()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        whole = " " + (text or "")
        a = a_model.encode(whole, add_special_tokens=False).ids
        a_bytes = [bytes(alphabet[c] for c in a_model.id_to_token(i)) for i in a]
        b = b_model.encode(text or "")
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != whole.encode() or b"".join(b_bytes) != whole.encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        a_ends, b_ends = ({sum(map(len, x[: k + 1])): k for k in range(len(x))} for x in (a_bytes, b_bytes))
        cuts = sorted(set(a_ends) & set(b_ends))
        groups, links, i, j = [], [], 0, 0
        for cut in cuts:
            groups.append((a[i : a_ends[cut] + 1], b[j : b_ends[cut] + 1]))
            links.append((a[a_ends[cut]], b[b_ends[cut]]))
            i, j = a_ends[cut] + 1, b_ends[cut] + 1
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, a, b, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def odd_rows():
    rng = random.Random(4)
    alphabet = ["a", "b", "  ", " ", "the", "ing", "\n", "\t", "é", "日", "👍", "\x00", "<0xAB>", "　", "Ⅷ", "<|endoftext|>", "don't", "1234", "▁", "​"]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "   "), (None, "the thing"), (None, "the thing"), (None, None), (7, "repeated id"), (204, "word " * 20_000), (205, "x" * 5_000), (206, "▁"), (207, "word \n"), (208, "<|endoftext|>")]
    return rows


def test_agrees_with_brute_force(spark, models):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(alignment.token_alignment(docs)) == brute(models, rows)


def test_documents_agree_with_brute_force(spark, sf_dir, models):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(alignment.op12_token_alignment(spark, sf_dir)) == brute(models, rows)


def test_clashing_columns_and_empty_table(spark, models):
    rows = [(1, "one two"), (2, "three")]
    docs = spark.createDataFrame([(*r, 9, 9, "x") for r in rows], "doc_id long, text string, row int, n_a int, pairs string")
    assert got(alignment.token_alignment(docs)) == brute(models, rows)
    assert got(alignment.token_alignment(docs.limit(0))) == []


def test_frequent_and_rare_pairs_give_the_same(spark, models, monkeypatch):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr("fauntrack.llm.lookup.HEAD_KEYS", 40)
    assert got(alignment.token_alignment(docs)) == brute(models, rows)


def test_groups_are_the_common_ends():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size = int(rng.integers(1, 40))
        ends = [np.append(np.flatnonzero(rng.random(size - 1) < 0.5) + 1, size) for _ in range(2)]
        of_a, of_b = alignment.groups(*(np.diff(e, prepend=0) for e in ends))
        common = np.intersect1d(*ends)
        assert list(of_a) == list(np.searchsorted(common, ends[0])) and list(of_b) == list(np.searchsorted(common, ends[1]))

