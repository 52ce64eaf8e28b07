"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct 5-word shingles. Sets are put into bands of
similar size; for every band the feature domain is cut into first-level
partitions, each of them into three second-level ones, and every two of the
three (the enumerated subsets) give one signature. Two sets with J >= 0.8 whose
sizes meet in a band differ in at most k features, so among any k // 2 + 1
first-level partitions one has at most one difference, and one of its subsets
is equal in both sets. A set gives signatures of partitions in a fixed order
until k // 2 + 1 of them are free of empty subsets; empty subsets are never
emitted. The few sets that run out of partitions are flagged and compared with
each other by the exact second way.

Exact second way (flagged sets, and groups whose members are not all linked by
then): two sets with J >= 0.8 share a feature among the rarest
n - ceil(0.8 n) + 1 of either; rarity is counted over the sets that take part,
and any fixed order is correct.

Equal sets are one entity from the start, so exact copies cost one entry. They
are equal if two independent 64-bit numbers are; words are named by 64-bit
hashes without patterns that meet, shingles by those of their words.

Defined results: null or empty texts, and texts of white space, have an empty
set and stay alone; texts of fewer than five words have one shingle, the whole
sequence; repeated rows get the class of their set; a null doc_id keeps its row
and takes part, but names no class unless all of it are null; a very long text
is one set like any other; the smallest doc_id names a class, so ties cannot
differ between runs; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linkage as K
from .common import BATCH_ROWS, U64, hash_sample, join_hot, materialise, mix, mix_int, partitions, pieces, sized, strong_hash, table, text_buffer, text_totals

#: Words of a shingle; similarity is at least NUMERATOR / DENOMINATOR.
WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Growth of the size bands, spare first-level partitions, second-level partitions.
BAND, SPARE, SECOND = 1.5, 1.15, 3
#: Features for each bin of the sketch that bounds the difference of two sets from below, and least bins.
BIN_FEATURES, LEAST_BINS = 4, 16
#: Bounds of the sample on which features are judged frequent: texts, features of a text, features in all.
SAMPLE_SETS, SAMPLE_FEATURES, FREQUENT = 2000, 4096, 50_000
_CHUNK = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[[32, 9, 10, 11, 12, 13]] = True
_COEF = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of the texts in buf, and the text it belongs to."""
    buf = _LOWER[buf]
    inside = ~_IS_BREAK[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | edge[1:-1]][: len(buf)])
    ends = np.flatnonzero(inside & np.r_[~inside[1:] | edge[1:-1], True][-len(buf) :]) + 1 if len(buf) else starts
    return strong_hash(buf, starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and their offsets."""
    n = len(offsets) - 1
    h, of = word_hashes(buf, offsets)
    per = np.bincount(of, minlength=n)
    values, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= words:
        whole = of[words - 1 :] == of[: len(of) - words + 1]
        s = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            s += h[k : len(h) - words + 1 + k] * _COEF[k]
        values, owner = mix(s[whole]), of[: len(of) - words + 1][whole]
    few = np.flatnonzero((per > 0) & (per < words))
    if len(few):
        at = np.r_[0, np.cumsum(per)]
        short = np.array([_short(h[at[d] : at[d + 1]]) for d in few], np.uint64)
        values, owner = np.r_[values, short], np.r_[owner, few]
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    cut = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int64)
    for d in range(n):
        values[cut[d] : cut[d + 1]].sort()
    if len(values):
        new = np.r_[True, values[1:] != values[:-1]]
        new[cut[:-1][cut[:-1] < len(values)]] = True
        values, owner = values[new], owner[new]
        cut = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int64)
    return values, cut


def _short(h: np.ndarray) -> int:
    x = len(h) * 0x51_7CC1B727220A95
    for v in h.tolist():
        x = mix_int((x * 0x9E3779B97F4A7C15 + v) & 0xFFFFFFFFFFFFFFFF)
    return x


def set_ids(values: np.ndarray, cut: np.ndarray, seed: int = 0xA5A5A5A5DEADBEEF) -> np.ndarray:
    """One 64-bit number for each set: equal sets, equal numbers."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ U64(seed)), out=total[1:])
    n = np.diff(cut).astype(np.uint64)
    return np.where(n > 0, mix(total[cut[1:]] - total[cut[:-1]] + n * U64(0xC2B2AE3D27D4EB4F)), U64(0))


def set_tags(values: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """A second, independent number for each set, checked before two sets are called equal."""
    return [x.tobytes() for x in set_ids(values, cut, 0x3C79AC492BA7B653)]


def most_different(a, b) -> int:
    """Most features in which sets of sizes a and b with J >= 0.8 differ: (1 - J) / (1 + J) of a + b."""
    return (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


@lru_cache(maxsize=1)
def bands() -> np.ndarray:
    """Least sizes of the bands, over any size that an integer holds in practice."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.floor(out[-1] * BAND)))
    return np.array(out, np.int64)


def _known(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in the sorted array `known`, -1 where a value is not in it."""
    if not len(known):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def signatures(values: np.ndarray, cut: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number) pairs of all sets, and which sets ran out of partitions.

    Frequent features (passages that many unlike texts share) are left out of
    the domain: without them two sets differ in no more features than with
    them, so the bound k holds as before, and a shared passage makes no group.
    """
    n = np.diff(cut)
    rare = _known(values, frequent) < 0
    values = values[rare]
    cut = np.r_[0, np.cumsum(rare)][cut]
    low = bands()
    own = np.searchsorted(low, n, side="right") - 1
    failed = np.zeros(len(n), bool)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ U64(0x5BD1E9955BD1E995)), out=total[1:])
    sigs, owners = [], []
    for step in range(3):
        band = own + step
        # a smaller set takes part in the band of a larger one if their sizes can meet
        part = (n > 0) & ((step == 0) | (DENOMINATOR * n >= NUMERATOR * low[np.minimum(band, len(low) - 1)]))
        docs = np.flatnonzero(part)
        if not len(docs):
            continue
        size, band, left = n[docs], band[docs], np.diff(cut)[docs]
        upper = low[band + 1] - 1
        first = np.ceil(SPARE * (2 * upper * (DENOMINATOR - NUMERATOR) / (DENOMINATOR + NUMERATOR) / 2 + 1)).astype(np.int64)
        need = most_different(size, np.minimum(upper, size * DENOMINATOR // NUMERATOR)) // 2 + 1
        cells = first * SECOND
        base = np.r_[0, np.cumsum(cells)]
        span = np.repeat(np.arange(len(docs)), left)
        at = np.arange(left.sum()) - np.repeat(np.r_[0, np.cumsum(left)[:-1]], left) + np.repeat(cut[docs], left)
        cell = base[span] + (((values[at] >> U64(32)) * cells[span].astype(np.uint64)) >> U64(32)).astype(np.int64)
        count = np.bincount(cell, minlength=base[-1])
        # values are sorted, so the features of a cell stand together
        end = np.cumsum(count) - np.repeat(np.r_[0, np.cumsum(left)[:-1]], cells) + np.repeat(cut[docs], cells)
        begin = end - count
        sums = (total[end] - total[begin]).reshape(-1, SECOND)
        filled = count.reshape(-1, SECOND) > 0
        row_doc = np.repeat(np.arange(len(docs)), first)
        good = filled.sum(1) >= 2
        before = np.cumsum(good) - good
        row0 = np.r_[0, np.cumsum(first)[:-1]]
        before -= np.repeat(before[row0], first)
        use = np.flatnonzero(before < need[row_doc])
        failed[docs[np.bincount(row_doc, weights=good, minlength=len(docs)) < need]] = True
        sums, filled, who = sums[use], filled[use], docs[row_doc[use]]
        place = (band[row_doc[use]].astype(np.uint64) << U64(40)) + (use - row0[row_doc[use]]).astype(np.uint64) * U64(4)
        for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            some = filled[:, i] | filled[:, j]
            sigs.append(mix(mix(sums[some, i] + U64(k + 1)) * U64(0x9FB21C651E98DF25) + sums[some, j] + mix(place[some] + U64(k))))
            owners.append(who[some])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), failed
    return np.concatenate(sigs), np.concatenate(owners), failed


def sketches(values: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """Counts of each set's features in a power of two of bins, one byte each (255: that many or more)."""
    out = []
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        bins = LEAST_BINS
        while bins * BIN_FEATURES < e - s:
            bins *= 2
        out.append(np.minimum(np.bincount((values[s:e] & U64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes())
    return out


def _least_apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of features in which two sets differ; the finer sketch is folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if a.max() == 255 or b.max() == 255:
        return 0
    a, b = a.astype(np.int32), b.astype(np.int32)
    least = min(len(a), len(b))
    if len(a) > least:
        a = a.reshape(-1, least).sum(0)
    elif len(b) > least:
        b = b.reshape(-1, least).sum(0)
    return int(np.abs(a - b).sum())


def _sign(buckets: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column("text"))
            raw = batch.column("row").to_numpy().astype(">i8").tobytes()
            row = [raw[k : k + 8] for k in range(0, len(raw), 8)]
            sigs, ents = [], []
            for s, e in pieces(offsets, _CHUNK):
                values, cut = shingle_sets(buf[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s])
                ids = set_ids(values, cut)
                sig, owner, failed = signatures(values, cut, frequent)
                yield pa.record_batch(
                    [
                        pa.array(np.full(e - s, K.OWN, np.int32)), pa.array(failed.astype(np.int32)), batch.column("doc_id").slice(s, e - s).cast(pa.int64()),
                        pa.array(ids.view(np.int64)), pa.array(np.diff(cut)), pa.array([r + t + x for r, t, x in zip(row[s:e], set_tags(values, cut), sketches(values, cut), strict=True)], pa.binary()),
                    ],
                    schema=K.ROWS,
                )
                sigs.append(sig)
                ents.append(ids[owner])
                if sum(map(len, sigs)) > 600_000:
                    yield from K.pack_signatures(np.concatenate(sigs), np.concatenate(ents), buckets)
                    sigs, ents = [], []
            if sigs:
                yield from K.pack_signatures(np.concatenate(sigs), np.concatenate(ents), buckets)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ent, n, features (sorted 64-bit numbers) of the texts whose set is the one asked for."""
    for batch in batches:
        buf, offsets = text_buffer(batch.column("text"))
        asked, tags = batch.column("ent").to_numpy(), batch.column("tag").to_pylist()
        for s, e in pieces(offsets, _CHUNK):
            values, cut = shingle_sets(buf[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s])
            ids = set_ids(values, cut).view(np.int64)
            right = np.flatnonzero((ids == asked[s:e]) & np.array([x == y for x, y in zip(set_tags(values, cut), tags[s:e], strict=True)], bool))
            yield pa.record_batch([pa.array(ids[right]), pa.array(np.diff(cut)[right]), pa.array([values[cut[d] : cut[d + 1]].tobytes() for d in right], pa.binary())], names=["ent", "n", "features"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches leave J >= 0.8 possible."""
    for batch in batches:
        if not batch.num_rows:
            continue
        apart = np.array([_least_apart(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)])
        n, m = (batch.column(k).to_numpy() for k in ("na", "nb"))
        yield batch.select(["a", "b"]).filter(pa.array(apart <= most_different(n, m)))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with J >= 0.8, counted on the sets themselves."""
    for batch in batches:
        right = []
        for a, b in zip(batch.column("fa"), batch.column("fb"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            right.append(DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(right, pa.bool_()))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least SAMPLE_FEATURES features of each text."""
    for batch in batches:
        buf, offsets = text_buffer(batch.column("text"))
        for s, e in pieces(offsets, _CHUNK):
            values, cut = shingle_sets(buf[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s])
            yield pa.record_batch([pa.array([values[a : min(b, a + SAMPLE_FEATURES)].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["features"])


def frequent_features(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Sorted features that at least three unlike texts of a bounded sample share.

    Copies and near copies in the sample count once, so that the features of a
    large group of copies do not look like a shared passage. The choice decides
    cost only.
    """
    # the place keeps exact copies from being taken all or none
    placed = docs.where("text is not null").withColumn("place", F.monotonically_increasing_id())
    rows = hash_sample(placed, ["row", "place"], SAMPLE_SETS, n_docs).select("text").mapInArrow(_sample, "features binary").collect()
    seen: dict[int, int] = {}
    unlike = []
    for k, r in enumerate(rows):  # bounded by SAMPLE_SETS
        x = np.frombuffer(bytes(r["features"]), np.uint64)
        least = x[:16].tolist()
        before = [seen[v] for v in least if v in seen]
        if not before or 3 * max(map(before.count, before)) < len(least):
            unlike.append(x)
        for v in least:
            seen.setdefault(v, k)
    if not unlike:
        return np.zeros(0, np.uint64)
    known, times = np.unique(np.concatenate(unlike), return_counts=True)
    often = np.flatnonzero(times >= 3)
    often = np.sort(often[np.argsort(-times[often], kind="stable")[:FREQUENT]])
    return known[often]


#: A feature that this many sets of one Arrow batch share counts as common; common ones come last in every order.
COMMON = 16
_HIGHEST = np.uint32(0xFFFFFFFF)
#: Stands for no set of a batch; a batch has at most BATCH_ROWS sets.
_NO_SET = np.uint16(0xFFFF)
assert BATCH_ROWS < _NO_SET


def _features(buckets: int):
    """All features of a batch's sets by bucket, a set being a number within its batch; sizes and common features stay in one OWN row.

    A batch is named by its first set. Of a common feature only a flag travels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in batch.column("features")]
            ents = batch.column("ent").to_numpy().view(np.uint64)
            name, size = ents[:1], np.array(list(map(len, sets)), np.uint32)
            who = np.repeat(np.arange(len(sets), dtype=np.uint16), size)
            bucket, low = K.split(mix(np.concatenate(sets)), buckets)
            order = np.lexsort((low, bucket))
            bucket, low, who = bucket[order], low[order], who[order]
            first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1])])
            count = np.diff(np.r_[first, len(low)])
            common = np.repeat(count >= COMMON, count)
            own = (bucket[common] << U64(40)) | low[common]
            yield K.rows(K.OWN, a=name, n=len(sets), payload=[ents.tobytes() + size.tobytes() + who[common].tobytes() + own.tobytes()])
            flags = first[count >= COMMON]
            bucket = np.r_[bucket[~common], bucket[flags]]
            who, low = np.r_[who[~common], np.full(len(flags), _NO_SET)], np.r_[low[~common], low[flags]]
            order = np.argsort(bucket, kind="stable")
            bucket, who, low = bucket[order], who[order], low[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            yield K.rows(K.PAYLOAD, bucket=bucket[cut].astype(np.int32), payload=[name.tobytes() + who[i:j].tobytes() + np.ascontiguousarray(low[i:j].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes() for i, j in zip(cut, np.r_[cut[1:], len(bucket)], strict=True)])

    return run


def _frequencies(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Per batch, one row: its features in this bucket that other sets have too, with their frequency."""
    size = np.array([(len(p) - 8) // 7 for p in payloads])
    who = np.concatenate([np.frombuffer(p, np.uint16, n, 8) for p, n in zip(payloads, size, strict=True)])
    wide = np.zeros((len(who), 8), np.uint8)
    wide[:, :5] = np.concatenate([np.frombuffer(p, np.uint8, 5 * n, 8 + 2 * n) for p, n in zip(payloads, size, strict=True)]).reshape(-1, 5)
    low = wide.view(np.uint64).ravel()
    of = np.repeat(np.arange(len(payloads)), size)
    order = np.argsort(low, kind="stable")
    who, low, of = who[order], low[order], of[order]
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    count = np.diff(np.r_[first, len(low)])
    often = np.repeat(np.where(np.logical_or.reduceat(who == _NO_SET, first), _HIGHEST, count.astype(np.uint32)), count)
    real = (who != _NO_SET) & (often > 1)
    who, often, of, ids = who[real], often[real], of[real], (U64(bucket) << U64(40)) | low[real]
    order = np.argsort(of, kind="stable")
    who, often, of, ids = who[order], often[order], of[order], ids[order]
    cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
    names, out = [], []
    for i, j in zip(cut, np.r_[cut[1:], len(of)], strict=True) if len(of) else ():
        names.append(np.frombuffer(payloads[of[i]], np.uint64, 1)[0])
        out.append(who[i:j].tobytes() + often[i:j].tobytes() + ids[i:j].tobytes())
    if names:
        yield K.rows(K.OWN, a=np.array(names, np.uint64), n=np.zeros(len(names), np.int64), payload=out)


def _rarest(buckets: int):
    """Rows of a partition sorted by batch -> signatures of each set's rarest shared features within its prefix, and its share of features that no other set has."""

    def solve(count: int, head: bytes, told: list[bytes]) -> Iterator[pa.RecordBatch]:
        ents, size = np.frombuffer(head, np.uint64, count), np.frombuffer(head, np.uint32, count, 8 * count).astype(np.int64)
        n = (len(head) - 12 * count) // 10
        who, ids, often = [np.frombuffer(head, np.uint16, n, 12 * count)], [np.frombuffer(head, np.uint64, n, 12 * count + 2 * n)], [np.full(n, _HIGHEST)]
        for p in told:
            n = len(p) // 14
            who.append(np.frombuffer(p, np.uint16, n))
            often.append(np.frombuffer(p, np.uint32, n, 2 * n))
            ids.append(np.frombuffer(p, np.uint64, n, 6 * n))
        who, ids, often = np.concatenate(who), np.concatenate(ids), np.concatenate(often)
        order = np.lexsort((ids, often, who))
        who, ids = who[order], ids[order]
        shared = np.bincount(who, minlength=count)
        # features that a set has alone are rarer than all others
        keep = size - -(-NUMERATOR * size // DENOMINATOR) + 1 - (size - shared)
        rank = np.arange(len(who)) - np.repeat(np.r_[0, np.cumsum(shared)[:-1]], shared)
        near = rank < keep[who]
        order = np.lexsort((ids, who))
        yield K.rows(K.OWN, a=size, b=ents, n=size - shared, payload=sketches(mix(ids[order]), np.r_[0, np.cumsum(shared)]))
        yield from K.pack_signatures(mix(ids[near]), ents[who[near]], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count, head, told = None, 0, None, []
        for batch in batches:
            for name, n, payload in zip(batch.column("a").to_pylist(), batch.column("n").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if name != at:
                    if head is not None:
                        yield from solve(count, head, told)
                    at, head, told = name, None, []
                if n:
                    count, head = n, payload
                else:
                    told.append(payload)
        if head is not None:
            yield from solve(count, head, told)

    return run


def rare_groups(sets: DataFrame, buckets: int) -> DataFrame:
    """MEMBER and EDGE rows of sets that share one of the rarest features of either, and an OWN row a set: a its size, n the features that it has alone, payload a sketch of the others.

    sets is read from a written table, each set once. Features are ordered by their
    frequency among the given sets, common ones last, ties by number. Features
    that a set has alone come first and make no group, so sets that only share
    passages never meet. Frequencies come back as one row for a batch of sets
    and a bucket of features.
    """
    counted = K.by_bucket(sets.select("ent", "features").mapInArrow(_features(buckets), K.ROWS_DDL)).mapInArrow(K.each_bucket(_frequencies), K.ROWS_DDL)
    by_batch = counted.repartition(partitions(sets.sparkSession), "a").sortWithinPartitions("a")
    return K.exchange(by_batch.mapInArrow(_rarest(buckets), K.ROWS_DDL), "ngram-prefixes")


def _sketched(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs that sizes and sketches leave possible; only entities that stand in a pair are shuffled."""
    pairs = materialise(pairs.select("a", "b"), "ngram-near")

    def side(k: str) -> DataFrame:
        own = entities.join(sized(pairs.select(F.col(k).alias("_k")).distinct(), 16), F.col("ent") == F.col("_k"), "left_semi")
        return own.select(F.col("ent").alias(f"e{k}"), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))

    p = pairs.join(side("a"), F.col("a") == F.col("ea")).join(side("b"), F.col("b") == F.col("eb"))
    p = p.where(DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb")).select("a", "b", "na", "nb", "sa", "sb")
    return p.mapInArrow(_close, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a written table) with J >= 0.8; only sets that stand in a pair are shuffled."""

    def side(k: str) -> DataFrame:
        own = sets.join(sized(pairs.select(F.col(k).alias("_k")).distinct(), 16), F.col("ent") == F.col("_k"), "left_semi")
        return own.select(F.col("ent").alias(f"e{k}"), F.col("features").alias(f"f{k}"))

    p = pairs.join(side("a"), F.col("a") == F.col("ea")).join(side("b"), F.col("b") == F.col("eb")).select("a", "b", "fa", "fb")
    return p.mapInArrow(_linked, "a long, b long")


def _texts(docs: DataFrame, own: DataFrame, asked: DataFrame) -> DataFrame:
    """ent, tag, text of the rows that are asked for (a written table), each text once.

    Where several rows have an address, which are copies with one doc_id, their
    equal texts become one; only these are shuffled, after each task has done so
    with its own. Texts that share an address by chance both come, and the set
    tells which one was meant.
    """
    same = own.select("row").join(sized(asked.select("row"), 16), "row", "left_semi").groupBy("row").count().where("count > 1").select("row")
    same = materialise(same, "ngram-repeated")
    one = docs.join(sized(asked.join(sized(same, 16), "row", "left_anti"), 32), "row").select("ent", "tag", "text")
    if not same.limit(1).count():
        return one
    return one.union(docs.join(sized(asked.join(sized(same, 16), "row", "left_semi"), 32), "row").select("ent", "tag", "text").distinct())


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    # a hash of the row addresses its text, so that texts need not be written again; rows of one address are told apart in _texts()
    docs = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    size, n_docs = text_totals(docs)
    known = frequent_features(docs, n_docs)
    found = K.exchange(docs.mapInArrow(_sign(K.bucket_count(size // 2, docs), known), K.ROWS_DDL), "ngrams")
    own = found.where(F.col("kind") == K.OWN).select(F.col("a").alias("doc_id"), F.col("b").alias("ent"), "n", F.col("bucket").alias("failed"), F.conv(F.hex(F.substring("payload", 1, 8)), 16, -10).cast("long").alias("row"), F.substring("payload", 9, 8).alias("tag"), F.expr("substring(payload, 17)").alias("sketch"))
    members = found.where(F.col("kind") == K.MEMBER).select("a", "b")
    stars = K.star_pairs(found)
    # of two sets that share a name by chance, the one with the smaller tag is looked at
    entities = own.where("n > 0").groupBy("ent").agg(F.min(F.struct("tag", "row", "n", "failed", "sketch")).alias("x")).select("ent", "x.*")
    entities = materialise(entities, "ngram-entities")
    close = materialise(_sketched(stars, entities), "ngram-pairs")
    touched = close.select(F.col("a").alias("t")).union(close.select("b")).union(members.select("b")).union(entities.where("failed > 0").select("ent")).distinct()
    asked = entities.join(touched, F.col("ent") == F.col("t"), "left_semi").select("ent", "tag", "row")
    asked = materialise(asked, "ngram-asked")
    sets = materialise(_texts(docs, own, asked).mapInArrow(_sets, "ent long, n long, features binary"), "ngram-sets")
    links = materialise(_verified(close, sets), "ngram-links")
    labels = K.components(links, "ngram-labels")
    # groups that are not of one class, and flagged sets, by the exact second way: stars first, then pairs across classes
    rest = K.unsettled(members, labels).select(F.col("b").alias("ent")).union(entities.where("failed > 0").select("ent")).distinct()
    left = sets.join(sized(materialise(rest, "ngram-open"), 16), "ent", "left_semi")
    features = left.agg(F.sum("n")).first()[0]
    prefixes = rare_groups(left, K.bucket_count(int(features or 0) * 8, docs))
    alone = prefixes.where(F.col("kind") == K.OWN).select(F.col("b").alias("ent"), F.col("a").alias("n"), F.col("n").alias("slack"), F.col("payload").alias("sketch"))
    groups = materialise(prefixes.where(F.col("kind") == K.MEMBER).select(F.col("a").alias("key"), F.col("b").alias("ent")).distinct(), "ngram-keys")
    named = lambda: groups.join(labels, F.col("ent") == F.col("node"), "left").select("key", "ent", F.coalesce("label", "ent").alias("label"))
    # a group's centre is the set with the least of its own: what the others were made from, if anything was
    while True:
        stars = materialise(_sketched(K.center_pairs(named(), alone.select("ent", (F.col("slack") / F.col("n")).alias("score"))), entities), "ngram-pairs")
        found_ = materialise(_verified(stars, sets), "ngram-links")
        new = found_.count()
        if new:
            links = links.union(found_)
            labels = K.components(links, "ngram-labels")
        if 2 * new < stars.count() or not new:
            break
    reach = lambda n: n * DENOMINATOR // NUMERATOR
    across = materialise(K.cross_pairs(named(), alone, reach, most_different, _least_apart), "ngram-pairs")
    more = materialise(_verified(across, sets), "ngram-links")
    if more.limit(1).count():
        labels = K.components(links.union(more), "ngram-labels")
    linked = labels.join(entities.select(F.col("ent").alias("node"), "tag"), "node").select(F.col("node").alias("ent"), "tag", "label")
    some = own.where("n > 0").select("doc_id", "ent", "tag", "n")
    facts = K.spread(some, linked, F.col("doc_id"), "ngram").select("ent", "tag", "rows", "first")
    component = F.coalesce("first", "doc_id").alias("component_id")
    out = join_hot(some, facts, ["ent", "tag"], "rows", "left").select("doc_id", F.col("n").alias("n_shingles"), component)
    return out.union(own.where("n = 0").select("doc_id", "n", "doc_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents under five-word shingles and J >= 0.8."""
    return jaccard_classes(table(spark, sf_dir, "documents"))
