"""Alignment of two tokenizers' tokens over the same bytes.

Per document, the byte intervals of the B tokens are put into a static index
(sorted starts and ends) and each A token asks it by bisection for the B tokens
that it overlaps. An A token spans the gaps between these; a gap between B
tokens that no A token spans is a group boundary. All documents of a batch lie
on one byte axis: no token crosses from one to the next, so their borders are
boundaries too and one index serves the batch.

Counts of linked id pairs are over the whole corpus. Tasks write, beside the
document's own numbers, its distinct pairs with their counts; these are summed
by pair, ranked within each B id, and joined back (see lookup.py), so only
pairs, never texts or tokens, are shuffled.

Defined results: a null or empty text, one whose tokens do not give back its
bytes (such as one holding U+2581, which B reads as a space), and every text of
an empty table have no tokens: zeros and an empty digest. Rows are separate
documents even if their doc_id, null or not, repeats. Very long texts are cut
by nothing; one text is the least unit of a task's memory. Among pairs with the
same count each is the best of its B id. Extra columns, whatever their names,
are ignored. A special token's string within a text is plain text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pieces, table, text_buffer
from .lookup import join_counts

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k", "piece_bpe_32k"
#: Bytes of text that are aligned at a time (one longer text is aligned on its own).
PIECE_BYTES = 1 << 20


# ---------------------------------------------------------------- tokenizers


class ByteTokens:
    """Byte-level BPE: ids of a text, and the bytes of each id."""

    def __init__(self, vocabulary: str) -> None:
        from .packing import _encoder

        self.vocabulary, self.fast = vocabulary, _encoder(vocabulary)
        self.bytes = [self.fast.decode_single_token_bytes(k) for k in range(self.fast.max_token_value + 1)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            try:
                out.append(self.fast.encode_ordinary(text))
            except BaseException as e:  # the fast encoder's regex engine panics on very long runs
                if type(e).__name__ != "PanicException":
                    raise
                out.append(self._plain().encode(text, add_special_tokens=False).ids)
        return out

    @lru_cache(maxsize=1)  # noqa: B019  one object a worker
    def _plain(self):
        import public_tokenizers
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(public_tokenizers.path(f"{self.vocabulary}.json"))
        found.encode_special_tokens = True
        return found


class PieceTokens:
    """Piece BPE with byte fallback: ids of a text, which it begins with a blank of its own, and the bytes of each id."""

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{vocabulary}.model"))
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def _tokenizers(first: str, second: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(first), PieceTokens(second)


# ---------------------------------------------------------------- alignment


class IntervalIndex:
    """Static index of half-open intervals that are sorted and do not overlap."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray) -> None:
        self.starts, self.ends = starts, ends

    def stab(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query interval the first overlapped interval, and the one after the last."""
        return np.searchsorted(self.ends, start, side="right"), np.searchsorted(self.starts, end, side="left")


def groups(a_length: np.ndarray, b_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every A and every B token, from their lengths in bytes (one at least, equal sums)."""
    a_end, b_end = np.cumsum(a_length), np.cumsum(b_length)
    index = IntervalIndex(b_end - b_length, b_end)
    low, high = index.stab(a_end - a_length, a_end)
    n = len(b_length)
    # an A token that overlaps B tokens low..high-1 spans the gaps after each of them but the last
    spans = np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high - 1, minlength=n + 1))[:n]
    of_b = np.concatenate([[0], np.cumsum(spans == 0)])[:n] if n else np.zeros(0, np.int64)
    return of_b[low], of_b


def _digits(size: int) -> np.ndarray:
    """Row k holds the decimal digits of k, right after each other, then zeros."""
    text = np.array([str(k).encode() for k in range(size)])
    return text.view(np.uint8).reshape(size, -1)


class Aligner:
    """Aligns batches of texts; the tables of both vocabularies are made once a worker."""

    def __init__(self, a, b) -> None:
        self.a, self.b = a, b
        self.a_size, self.b_size = (np.array([len(x) for x in t.bytes]) for t in (a, b))
        digits = _digits(max(len(a.bytes), len(b.bytes)))
        self.names = np.concatenate([digits, np.zeros((len(digits), 1), np.uint8)], axis=1)
        self.name_size = (digits > 0).sum(axis=1)

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """The numbers of every text; pairs and times hold its distinct linked (A, B) ids and how often they are linked."""
        a_ids, b_ids = self.a.encode([" " + t for t in texts]), self.b.encode(texts)
        for k, t in enumerate(texts):
            whole = (" " + t).encode()
            if not t or b"".join([self.a.bytes[i] for i in a_ids[k]]) != whole or b"".join([self.b.bytes[i] for i in b_ids[k]]) != whole:
                a_ids[k], b_ids[k] = [], []
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a_ids, n_a), (b_ids, n_b)))
        of_a, of_b = groups(self.a_size[a], self.b_size[b])
        doc_b = np.repeat(np.arange(len(texts)), n_b)
        last_a, last_b = (np.flatnonzero(np.concatenate([g[1:] != g[:-1], [True]])) if len(g) else np.zeros(0, np.int64) for g in (of_a, of_b))
        doc = doc_b[last_b]
        n_groups = np.bincount(doc, minlength=len(texts))
        packed = np.sort(doc << 40 | a[last_a] << 20 | b[last_b])
        fresh = np.concatenate([[True], packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        times = np.diff(np.append(at, len(packed)))
        pairs = packed[at]
        cuts = np.searchsorted(pairs >> 40, np.arange(len(texts) + 1))
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": self._named(a, b, of_a, of_b, last_a, last_b, n_a + n_b), "pairs": pairs & ((1 << 40) - 1), "times": times, "cuts": cuts}

    def _named(self, a, b, of_a, of_b, last_a, last_b, size) -> list[str]:
        """Digest of each text's groups: A ids of a group, its B ids, then the next group."""
        n = len(a) + len(b)
        # tokens in the order of writing: those of earlier groups come first, in a group A before B
        a_before, b_before = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(last_a)))]) for g in (of_a, of_b))
        at_a, at_b = np.arange(len(a)) + b_before[of_a], np.arange(len(b)) + a_before[of_b + 1]
        ids, sign = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        sign[at_a[last_a]], sign[at_b[last_b]] = ord("|"), ord(";")
        ends = np.cumsum(size)
        filled = size > 0
        sign[ends[filled] - 1] = 0  # nothing follows a text's last id
        cells = self.names[ids]
        length = self.name_size[ids]
        cells[np.arange(n), length] = sign
        flat = cells[cells > 0].tobytes()
        byte_ends = np.concatenate([[0], np.cumsum(length + (sign > 0))])
        cuts = byte_ends[np.concatenate([[0], ends])]
        return [hashlib.sha256(flat[cuts[k] : cuts[k + 1]]).hexdigest() if filled[k] else "" for k in range(len(size))]


_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"


def _align(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*_tokenizers(first, second))
        for batch in batches:
            _, offsets = text_buffer(batch.column("text"))
            for start, end in pieces(offsets, PIECE_BYTES):
                part = batch.slice(start, end - start)
                got = aligner.align([x or "" for x in part.column("text").to_pylist()])
                cuts = pa.array(got.pop("cuts"), pa.int32())
                lists = {"pairs": pa.ListArray.from_arrays(cuts, pa.array(got["pairs"], pa.int64())), "times": pa.ListArray.from_arrays(cuts, pa.array(got["times"], pa.int32()))}
                yield pa.RecordBatch.from_pydict({"row": part.column("row"), "doc_id": part.column("doc_id"), **got, **lists})

    return run


def align_tokens(docs: DataFrame, first: str = BYTE_VOCABULARY, second: str = PIECE_VOCABULARY) -> DataFrame:
    """A written table with a row for each row of docs: its number (row), the counts, the digest of its groups, and its linked pairs.

    pairs holds A id * 2**20 + B id; times says how often each is linked in the document.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(numbered.mapInArrow(_align(first, second), _DDL), "alignment")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """A written table of linked id pairs: pair, docs (documents that hold it), links (corpus-wide), best (no pair of its B id has more)."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    pairs = materialise(each.groupBy("pair").agg(F.count("*").alias("docs"), F.sum("n").alias("links")), "alignment-pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 20) - 1))
    most = pairs.groupBy(b_id.alias("b_id")).agg(F.max("links").alias("most"))
    # a row for each B id, 2**20 at most: the other side is dealt by B id only if the vocabulary outgrows a broadcast
    return materialise(pairs.withColumn("b_id", b_id).join(F.broadcast(most), "b_id").select("pair", "docs", "links", (F.col("links") == F.col("most")).alias("best")), "alignment-counts")


def token_alignment(docs: DataFrame, first: str = BYTE_VOCABULARY, second: str = PIECE_VOCABULARY) -> DataFrame:
    """Alignment numbers of every document of docs (doc_id, text), with the corpus-wide counts of its links."""
    aligned = align_tokens(docs, first, second)
    each = aligned.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    sums = join_counts(each, pair_counts(aligned), "pair", "docs").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n").cast("long")).otherwise(F.lit(0).cast("long"))).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    # a group's tokens all have a byte at least, so each group ends with one A and one B token and is one link
    return aligned.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece vocabulary over all documents."""
    return token_alignment(table(spark, sf_dir, "documents"))
