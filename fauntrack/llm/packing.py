"""Best-fit packing of tokenised documents by linear grouping.

Lengths are integers up to the capacity, so the packing itself needs only the
histogram of lengths: at most CAPACITY counts reach the driver, whatever the
number of documents. There, large lengths are rounded up within groups of equal
cardinality, the configurations of these few sizes are optimised by column
generation, actual lengths replace the rounded ones, and the rest goes best-fit
decreasing into what is left. Bins of equal content are held as one class with
a count, so the plan's size depends on the number of lengths, not of documents.
A document's place follows from its rank among the pieces of its length, which
is computed in two levels (chunks, then sums over chunks).

Defined results: null or empty texts are one end token; repeated rows are
packed each on its own; an empty table gives an empty result; extra columns are
ignored; a very long text is cut like any other, by its own tokens; pieces of equal
length differ only in their place, which a hash decides. A string of an added
token (such as <|endoftext|>) in a text is that token, as the JSON tokenizer has it.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_for, materialise, table
from .mixing import CHUNK, _running

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 2048, 0
#: Groups of large lengths and the share of the capacity above which a length is large; the plan with fewest sequences wins.
SCHEMES = ((128, 0.45), (64, 0.45), (128, 1 / 3))
VOCABULARY = "byte_bpe_50k"


# ---------------------------------------------------------------- tokens


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """Encoder of a worker: the rank file of the same vocabulary, several times as fast as the JSON one."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _json_encoder(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


@lru_cache(maxsize=2)
def _added(vocabulary: str):
    """A pattern of the strings that the JSON tokenizer treats as one token each, wherever they stand; None if it has none.

    Only the list in the file is kept: a worker holds the whole JSON tokenizer in memory only if a text asks for it.
    """
    import public_tokenizers

    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
        found = [t["content"] for t in json.load(f)["added_tokens"]]
    return re.compile("|".join(map(re.escape, found))) if found else None


def encode(text: str, vocabulary: str = VOCABULARY, added: re.Pattern | None = None) -> list[int]:
    """Token ids of a text as `tokenizers` gives them with add_special_tokens=False.

    Texts that hold the string of an added token, and the very long runs on
    which the fast encoder's regex engine panics, go to the JSON tokenizer itself.
    added is the pattern of the added tokens, where the caller has it.
    """
    added = added or _added(vocabulary)
    if added is None or not added.search(text):
        try:
            return _encoder(vocabulary).encode_ordinary(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":
                raise
    return _json_encoder(vocabulary).encode(text, add_special_tokens=False).ids


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _tokenise(vocabulary: str, capacity: int):
    added = _added(vocabulary)  # read on the driver and sent along

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or "", vocabulary, added), END_ID], dtype="<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents over the capacity are cut, the first piece takes the remainder."""
    return docs.select("doc_id", "text").mapInArrow(_tokenise(vocabulary, capacity), _PIECES_DDL)


# ---------------------------------------------------------------- plan on the histogram


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: most value of sizes within the capacity."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        gain = best[c - sizes[fits]] + values[fits]
        k = int(np.argmax(gain))
        best[c] = best[c - 1]
        if gain[k] > best[c] + 1e-12:
            best[c], taken[c] = gain[k], fits[k]
    config, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
            continue
        config[taken[c]] += 1
        c -= sizes[taken[c]]
    return float(best[capacity]), config


def few_size_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations with whole counts, rounded down from the optimum of the relaxed problem."""
    m = len(sizes)
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    x = demand / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(m))
        value, config = _best_configuration(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, config.astype(float))
        able = direction > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        x = np.maximum(x - step * direction, 0)
        x[out] = step
        basis[:, out] = config
    return [(basis[:, j].round().astype(int), int(np.floor(x[j] + 1e-9))) for j in range(m) if x[j] >= 1 - 1e-9]


class _Bins:
    """Classes of equal bins: free space, count, and per item (length, first rank, offset)."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_free: dict[int, list[tuple[int, list]]] = defaultdict(list)
        self.frees: list[int] = []
        self.used: dict[int, int] = defaultdict(int)  # ranks of each length given out

    def put(self, free: int, count: int, items: list) -> None:
        if count:
            if not self.by_free[free]:
                bisect.insort(self.frees, free)
            self.by_free[free].append((count, items))

    def take(self, length: int, count: int) -> int:
        rank = self.used[length]
        self.used[length] += count
        return rank

    def add(self, length: int, count: int) -> None:
        """Best fit: each item goes where it leaves least; new bins open when none fits."""
        while count:
            k = bisect.bisect_left(self.frees, length)
            if k == len(self.frees):
                each = self.capacity // length
                for bins, inside in ((count // each, each), (1, count % each)):
                    if bins and inside:
                        items = [(length, self.take(length, bins), j * length) for j in range(inside)]
                        self.put(self.capacity - inside * length, bins, items)
                return
            free = self.frees[k]
            bins, items = self.by_free[free].pop()
            if not self.by_free[free]:
                self.frees.pop(k)
            here = min(bins, count)
            if here < bins:
                self.put(free, bins - here, [(ln, r + here, o) for ln, r, o in items])
            self.put(free - length, here, [*items, (length, self.take(length, here), self.capacity - free)])
            count -= here


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, schemes: tuple = SCHEMES) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go: rows (length, first rank, count, first sequence, offset), and the number of sequences."""
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    best = None
    for groups, large_share in schemes:
        found = linear_grouping(histogram, capacity, groups, large_share)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] <= least:
            break
    return best


def linear_grouping(histogram: dict[int, int], capacity: int, groups: int, large_share: float) -> tuple[np.ndarray, int]:
    """One plan: rounded groups, their configurations, actual lengths in their slots, the rest best-fit."""
    bins = _Bins(capacity)
    left = {k: v for k, v in histogram.items() if v}
    if capacity in left:
        n = left.pop(capacity)
        bins.put(0, n, [(capacity, bins.take(capacity, n), 0)])
    large = sorted((k for k in left if k > capacity * large_share), reverse=True)
    total = sum(left[k] for k in large)
    if total >= 4 * groups:
        # equal-cardinality groups of the sorted lengths, each rounded up to its largest
        runs: list[list[list[int]]] = [[]]
        room = target = -(-total // groups)
        for k in large:
            n = left[k]
            while n:
                if not room:
                    runs.append([])
                    room = target
                here = min(n, room)
                runs[-1].append([k, here])
                n -= here
                room -= here
        runs = [r for r in runs if r]
        sizes = np.array([r[0][0] for r in runs])
        # equal rounded sizes are one size
        merged: dict[int, list[list[int]]] = {}
        for s, r in zip(sizes, runs, strict=True):
            merged.setdefault(int(s), []).extend(r)
        sizes = np.array(list(merged))
        demand = np.array([sum(n for _, n in r) for r in merged.values()], float)
        supply = [list(map(list, r)) for r in merged.values()]
        for config, count in few_size_configurations(sizes, demand, capacity):
            slots = [g for g in range(len(sizes)) for _ in range(int(config[g]))]
            while count:
                # substitute actual lengths: as many bins as all slots can fill with the lengths at hand
                need: dict[int, int] = defaultdict(int)
                pick = []
                for g in slots:
                    rest = supply[g]
                    at, skip = 0, need[g]
                    while at < len(rest) and skip:
                        at, skip = at + 1, skip - 1
                    pick.append((g, at) if at < len(rest) else None)
                    need[g] += 1
                if not slots or any(p is None for p in pick):
                    # few different lengths are left in a group: let slots share one run
                    pick = [(g, 0) if supply[g] else None for g in slots]
                    if not slots or any(p is None for p in pick):
                        break
                share: dict[tuple[int, int], int] = defaultdict(int)
                for p in pick:
                    share[p] += 1
                here = min([count, *(supply[g][at][1] // k for (g, at), k in share.items())])
                if not here:
                    # a run is shorter than its slots: take single bins with what the next runs hold
                    here, taken = 1, []
                    for g in slots:
                        rest = supply[g]
                        if not rest:
                            break
                        taken.append(rest[0][0])
                        rest[0][1] -= 1
                        if not rest[0][1]:
                            rest.pop(0)
                    lengths = taken
                else:
                    lengths = [supply[g][at][0] for g, at in pick]
                    for (g, at), k in share.items():
                        supply[g][at][1] -= here * k
                    for g in set(slots):
                        supply[g] = [r for r in supply[g] if r[1]]
                items, offset = [], 0
                for length in lengths:
                    items.append((length, bins.take(length, here), offset))
                    offset += length
                bins.put(capacity - offset, here, items)
                count -= here
        for k in large:
            left.pop(k)
        for rest in supply:
            for k, n in rest:
                left[k] = left.get(k, 0) + n
    for k in sorted(left, reverse=True):
        bins.add(k, left[k])
    rows, sequence = [], 0
    for classes in bins.by_free.values():
        for count, items in classes:
            rows += [(length, rank, count, sequence, offset) for length, rank, offset in items]
            sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


# ---------------------------------------------------------------- places


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and offset."""
    spark = docs.sparkSession
    cut = materialise(token_pieces(docs, vocabulary, capacity).withColumns({"_h": F.xxhash64("doc_id", "piece", "ids_crc32"), "_row": F.monotonically_increasing_id()}), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = plan_packing(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan)  # bounded by the number of lengths, not by the documents
    ranked = cut.withColumn("chunk", F.pmod(F.shiftright("_h", 20), F.lit(blocks_for(sum(histogram.values()), CHUNK)))).withColumn("one", F.lit(1))
    ranked = _running(ranked, ["length"], "chunk", ["_h", "_row"], "one", "rank").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = (rows[:, 0] << 48) | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).cast(pa.int64()).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            sequence = rows[at, 3] + rank - rows[at, 1]
            out = [batch.column(k) for k in ("doc_id", "piece", "start")] + [pa.array(length), batch.column("ids_crc32"), pa.array(sequence), pa.array(rows[at, 4])]
            yield pa.record_batch(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
