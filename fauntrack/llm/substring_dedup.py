"""Suffix-array dedup: bytes under 100-byte strings that also start earlier.

1. Every 100-byte window names an anchor: the leftmost least 32-byte hash in
   it. Equal windows have equal anchors, so a window can only repeat if its
   anchor's hash occurs at least twice; all other windows are settled.
2. Around each repeated anchor the context of its windows is sent to a shard by
   the anchor's hash (equal contexts of a block once). A shard collapses equal
   contexts to the earliest, builds the suffix array of the contexts by induced
   sorting and its permuted common prefixes, and so finds for every window
   whether an equal one starts earlier.
3. Each block of documents gets its answers back and removes the bytes.

Blocks and shards grow in number with the input and keep their size. The texts
are shuffled once; both passes over a block read the same exchange.

Defined results: null or empty texts have no bytes; texts under 100 bytes stay
whole; a null doc_id comes after all others; rows of one doc_id are separate
documents ordered by text, so of repeated rows the first stays; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, blocks_for, partitions, pieces, powers, prefix_hash, mix, strong_hash, table, text_buffer, text_bytes
from .suffix_array import common_prefixes, suffix_array

#: Bytes of a repeated string, and of the strings whose hashes name anchors.
LENGTH, GRAM = 100, 32
_SPAN = LENGTH - GRAM + 1  # grams of a window
#: Bytes of text in a block, and of contexts in one suffix array.
BLOCK_BYTES, SHARD_BYTES = 4_000_000, 2_000_000
_CHUNK = (1 << 19) - LENGTH
_BITS = -(-_SPAN // 8)  # bytes of a context's mask
_LAST = np.iinfo(np.int64).max
_CODEC = "zstd"


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, hash, and first and last window start of every anchor in a piece under 2**20 bytes."""
    none = np.zeros(0, np.int64)
    n = len(buf)
    if n < LENGTH:
        return none, none.astype(np.uint64), none, none
    prefix = prefix_hash(buf, seed=11)
    _, down = powers(n + 1)
    h = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    key = (h & ~U64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    low, width = key, 1
    while width * 2 <= _SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < _SPAN:
        low = np.minimum(low[: -(_SPAN - width)], low[_SPAN - width :])
    at = (low & U64((1 << 20) - 1)).astype(np.int64)  # one for each window start
    valid = np.zeros(len(at), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        valid[a : max(a, b - LENGTH + 1)] = True
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none.astype(np.uint64), none, none
    at = at[starts]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[new[1:], len(at)] - 1
    return at[new], h[at[new]] & ~U64(1), starts[new], starts[last]


def _cut_long(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, offsets) of pieces under 2**20 bytes; a longer text is cut so that each window is whole in one piece."""
    for s, e in pieces(offsets, _CHUNK):
        begin, end = int(offsets[s]), int(offsets[e])
        if end - begin <= _CHUNK:
            yield begin, end, offsets[s : e + 1] - begin
            continue
        while begin < end:
            stop = min(end, begin + _CHUNK)
            yield begin, stop, np.array([0, stop - begin])
            if stop == end:
                break
            begin = stop - LENGTH + 1


def _all_anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    parts = []
    for begin, end, own in _cut_long(offsets):
        at, h, lo, hi = anchors(buf[begin:end], own)
        parts.append((at + begin, h, lo + begin, hi + begin))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# ---------------------------------------------------------------- 1: repeated anchors

_HASHES = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> U64(40)) * U64(buckets)) >> U64(24)).astype(np.int64)


def _emit_hashes(buckets: int):
    """Payloads by bucket: blocks, counts, and the hashes of each block; the lowest bit says that the batch has it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column("text"))
            _, h, lo, _ = _all_anchors(buf, offsets)
            if not len(h):
                continue
            block = batch.column("block").to_numpy()[np.searchsorted(offsets, lo, side="right") - 1]
            order = np.argsort(h, kind="stable")
            h, block = h[order], block[order]
            same = h[1:] == h[:-1]
            twice = np.r_[False, same] | np.r_[same, False]
            bucket = _bucket(h, buckets)
            order = np.lexsort((h, block, bucket))
            bucket, block, h, twice = bucket[order], block[order], h[order], twice[order]
            keep = np.r_[True, (h[1:] != h[:-1]) | (block[1:] != block[:-1])]
            bucket, block, h, twice = bucket[keep], block[keep], h[keep], twice[keep]
            h = h | twice.astype(np.uint64)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            names, payloads = [], []
            for s, e in zip(cuts, np.r_[cuts[1:], len(h)], strict=True):
                new = np.flatnonzero(np.r_[True, block[s + 1 : e] != block[s : e - 1]])
                payloads.append(np.uint32(len(new)).tobytes() + block[s:e][new].astype(np.uint32).tobytes() + np.diff(np.r_[new, e - s]).astype(np.uint32).tobytes() + h[s:e].tobytes())
                names.append(bucket[s])
            yield pa.record_batch([pa.array(names, pa.int32()), pa.array(payloads, pa.binary())], schema=_HASHES)

    return run


def _repeated(held: list[bytes]) -> pa.RecordBatch | None:
    blocks, hashes = [], []
    for p in held:
        n = int(np.frombuffer(p, np.uint32, 1)[0])
        blocks.append(np.repeat(np.frombuffer(p, np.uint32, n, 4), np.frombuffer(p, np.uint32, n, 4 + 4 * n)))
        hashes.append(np.frombuffer(p, np.uint64, -1, 4 + 8 * n))
    block, h = np.concatenate(blocks), np.concatenate(hashes)
    twice, h = (h & U64(1)) > 0, h & ~U64(1)
    order = np.argsort(h)
    block, h, twice = block[order], h[order], twice[order]
    same = h[1:] == h[:-1]
    many = np.r_[False, same] | np.r_[same, False] | twice
    block, h = block[many], h[many]
    if not len(h):
        return None
    order = np.lexsort((h, block))
    block, h = block[order], h[order]
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    return pa.record_batch([pa.array(block[cuts].astype(np.int64)), pa.array([h[s:e].tobytes() for s, e in zip(cuts, np.r_[cuts[1:], len(h)], strict=True)], pa.binary())], names=["block", "payload"])


def _find_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held = None, []
    for batch in batches:
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if bucket != at and held:
                if (found := _repeated(held)) is not None:
                    yield found
                held = []
            at = bucket
            held.append(payload)
    if held and (found := _repeated(held)) is not None:
        yield found


# ---------------------------------------------------------------- 2: contexts of a block, and their shards

_ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
_ROWS_DDL = "block long, bucket int, payload binary"


def _pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as one compressed value."""
    names = [f"{k}:{a.dtype.str}:{len(a)}" for k, a in arrays.items()]
    head = ";".join(names).encode()
    raw = np.uint32(len(head)).tobytes() + head + b"".join(a.tobytes() for a in arrays.values())
    return np.uint64(len(raw)).tobytes() + pa.compress(raw, codec=_CODEC, asbytes=True)


def _open(payload: bytes) -> dict[str, np.ndarray]:
    size = int(np.frombuffer(payload, np.uint64, 1)[0])
    raw = pa.decompress(payload[8:], decompressed_size=size, codec=_CODEC, asbytes=True)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    at, out = 4 + n, {}
    for name in raw[4:at].decode().split(";"):
        key, kind, count = name.split(":")
        out[key] = np.frombuffer(raw, kind, int(count), at)
        at += out[key].nbytes
    return out


def _ordered(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The documents of a block by doc_id and text: bytes, offsets, doc_id (null last), number within doc_id, doc_id as it was."""
    ids = docs.column("doc_id").combine_chunks().cast(pa.int64())
    docs = docs.set_column(docs.schema.get_field_index("doc_id"), "doc_id", ids)
    order = np.argsort(ids.fill_null(_LAST).to_numpy(zero_copy_only=False), kind="stable")
    key = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)[order]
    if len(key) > 1 and (key[1:] == key[:-1]).any():
        texts = docs.column("text").to_pylist()
        all_keys = ids.fill_null(_LAST).to_pylist()
        order = np.array(sorted(range(len(texts)), key=lambda k: (all_keys[k], texts[k] or "")))
    docs = docs.take(pa.array(order))
    buf, offsets = text_buffer(docs.column("text"))
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    at = np.arange(len(key))
    sub = at - np.maximum.accumulate(np.where(first, at, 0)) if len(key) else at
    return buf, offsets, key, sub, docs.column("doc_id").combine_chunks()


def _contexts(buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Contexts of the block's repeated anchors by shard, and the list of their occurrences for the block itself."""
        if not docs.num_rows or not answers.num_rows:
            return _ROWS.empty_table()
        block = docs.column("block")[0].as_py()
        known = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in answers.column("payload").to_pylist()]))
        buf, offsets, key, sub, _ = _ordered(docs)
        at, h, lo, hi = _all_anchors(buf, offsets)
        found = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(h) else np.zeros(0, bool)
        at, h, lo, hi = at[found], h[found], lo[found], hi[found]
        if not len(h):
            return _ROWS.empty_table()
        # equal contexts: same bytes around the same anchor
        text = np.empty(len(h), np.uint64)
        for s in range(0, len(h), 1 << 13):
            text[s : s + (1 << 13)] = _context_hash(buf, at[s : s + (1 << 13)], lo[s : s + (1 << 13)], hi[s : s + (1 << 13)])
        order = np.lexsort((at, text, h))  # positions rise with doc_id, so the first is the earliest
        at, h, lo, hi, text = at[order], h[order], lo[order], hi[order], text[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]
        local = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        doc = np.searchsorted(offsets, lo, side="right") - 1
        rows_block, rows_bucket, payloads = [block], [-1], [_pack(at=at, lo=lo, hi=hi, local=local.astype(np.int64), new=new)]
        bucket = _bucket(h[first], buckets)  # h is sorted, so buckets rise as local numbers do
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for s, e in zip(cuts, np.r_[cuts[1:], len(first)], strict=True):
            f = first[s:e]
            size = hi[f] + LENGTH - lo[f]
            bytes_ = buf[np.repeat(lo[f] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
            payloads.append(_pack(h=h[f], text=text[f], doc=key[doc[f]], sub=sub[doc[f]].astype(np.int64), pos=at[f] - offsets[doc[f]], before=(at[f] - lo[f]).astype(np.uint8), size=size.astype(np.uint8), bytes=bytes_))
            rows_block.append(block)
            rows_bucket.append(int(bucket[s]))
        return pa.table([pa.array(rows_block, pa.int64()), pa.array(rows_bucket, pa.int32()), pa.array(payloads, pa.binary())], schema=_ROWS)

    return run


def _context_hash(buf: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    size = hi + LENGTH - lo
    start = np.r_[0, np.cumsum(size)]
    part = buf[np.repeat(lo - start[:-1], size) + np.arange(start[-1])]
    # equality is concluded from this name and the anchor's hash together, so it must not meet by pattern
    return mix(strong_hash(part, start[:-1], start[1:], seed=23) + mix((size * 256 + at - lo).astype(np.uint64)))


def repeated_windows(context_bytes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For contexts in order of their places: mask (contexts x 69) of windows that an earlier context has too.

    Windows of two contexts can be equal only at the same distance from the
    anchor, so it is the order of the contexts that says which one is earlier.
    """
    n = len(size)
    starts = np.r_[0, np.cumsum(size + 1)][:-1]
    text = np.full(int((size + 1).sum()), 255, np.uint8)  # 255 is in no UTF-8 text: it parts the contexts
    owner = np.repeat(np.arange(n), size)
    text[np.arange(len(context_bytes)) + owner] = context_bytes
    order = suffix_array(text, 256)
    lanes = max(1, min(len(text) // 64, 1 << 13))
    prefix = common_prefixes(text, order, LENGTH, lanes)
    # windows in suffix order; neighbours with a common prefix of 100 bytes are one group
    windows = size - LENGTH + 1
    window_of = np.full(len(text), -1, np.int64)
    where = np.repeat(starts, windows) + np.arange(windows.sum()) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows)
    window_of[where] = np.repeat(np.arange(n), windows)
    ordered = order[window_of[order] >= 0]
    # between two windows in order stand only suffixes that are no windows; the least prefix between them counts
    low = np.minimum.reduceat(prefix[order], np.flatnonzero(np.r_[True, window_of[order[:-1]] >= 0]))[: len(ordered)] if len(ordered) else np.zeros(0)
    group = np.cumsum(np.r_[True, low[1:] < LENGTH]) - 1 if len(ordered) else np.zeros(0, np.int64)
    who = window_of[ordered]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, n, np.int64)
    np.minimum.at(least, group, who)
    mask = np.zeros((n, _SPAN), bool)
    late = who > least[group]
    mask[who[late], ordered[late] - starts[who[late]]] = True
    return mask


def _solve(held: list[tuple[int, bytes]], bucket: int) -> Iterator[pa.RecordBatch]:
    parts = [_open(p) for _, p in held]
    counts = np.array([len(p["h"]) for p in parts])
    all_ = {k: np.concatenate([p[k] for p in parts]) for k in ("h", "text", "doc", "sub", "pos", "before", "size")}
    size = all_["size"].astype(np.int64)
    begin = np.concatenate([np.r_[0, np.cumsum(p["size"].astype(np.int64))[:-1]] for p in parts]) + np.repeat(np.r_[0, np.cumsum([len(p["bytes"]) for p in parts])[:-1]], counts)
    raw = np.concatenate([p["bytes"] for p in parts])
    order = np.lexsort((all_["pos"], all_["sub"], all_["doc"], all_["text"], all_["h"]))
    h, text = all_["h"][order], all_["text"][order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]
    firsts = order[new]  # earliest occurrence of each distinct context
    distinct = np.empty(len(order), np.int64)
    distinct[order] = np.cumsum(new) - 1
    is_first = np.zeros(len(order), bool)
    is_first[firsts] = True
    # an anchor with one distinct context has no rival: its first occurrence stays, all others go
    hf = all_["h"][firsts]
    alike = hf[1:] == hf[:-1]
    rivals = np.flatnonzero(np.r_[False, alike] | np.r_[alike, False])
    every = np.zeros((len(firsts), _BITS), np.uint8)
    firsts, hf = firsts[rivals], hf[rivals]
    mask = np.zeros((len(firsts), _SPAN), bool)
    # shards of whole anchor groups, contexts in order of their places
    ends = np.flatnonzero(np.r_[hf[1:] != hf[:-1], True]) + 1
    bytes_to = np.cumsum(size[firsts] + 1)
    start = 0
    while start < len(firsts):
        most = (bytes_to[start - 1] if start else 0) + SHARD_BYTES
        k = max(int(np.searchsorted(bytes_to[ends - 1], most, side="right")) - 1, int(np.searchsorted(ends, start, side="right")))
        end = int(ends[min(k, len(ends) - 1)])
        ids = np.arange(start, end)
        f = firsts[ids]
        ids = ids[np.lexsort((all_["pos"][f], all_["sub"][f], all_["doc"][f]))]
        f = firsts[ids]
        span = size[f]
        bytes_ = raw[np.repeat(begin[f] - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(span.sum())]
        mask[ids] = repeated_windows(bytes_, span)
        start = end
    every[rivals] = np.packbits(mask, axis=1, bitorder="little")
    at = 0
    for (block, _), n in zip(held, counts, strict=True):
        own = slice(at, at + n)
        at += n
        yield pa.record_batch([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_pack(first=is_first[own], bits=every[distinct[own]].ravel())], pa.binary())], schema=_ROWS)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held = None, []
    for batch in batches:
        for block, bucket, payload in zip(*(batch.column(k).to_pylist() for k in ("block", "bucket", "payload")), strict=True):
            if bucket < 0:
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], schema=_ROWS)
                continue
            if bucket != at and held:
                yield from _solve(held, at)
                held = []
            at = bucket
            held.append((block, payload))
    if held:
        yield from _solve(held, at)


# ---------------------------------------------------------------- 3: removal

_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(with_text: bool):
    schema = _RESULT if with_text else pa.schema(list(_RESULT)[:-1])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        buf, offsets, _, _, ids = _ordered(docs)
        cover = np.zeros(len(buf) + 1, np.int32)
        if answers.num_rows:
            got = sorted(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True))
            own = _open(got[0][1])
            solved = [_open(p) for _, p in got[1:]]
            first = np.concatenate([x["first"] for x in solved])
            bits = np.concatenate([x["bits"] for x in solved]).reshape(len(first), -1)
            local, lo, hi = own["local"], own["lo"], own["hi"]
            partly = own["new"] & first[local]
            np.add.at(cover, lo[~partly], 1)
            np.add.at(cover, hi[~partly] + LENGTH, -1)
            some = np.flatnonzero(partly)
            some = some[bits[local[some]].any(axis=1)]
            if len(some):
                row, col = np.nonzero(np.unpackbits(bits[local[some]], axis=1, count=_SPAN, bitorder="little"))
                start = lo[some[row]] + col
                np.add.at(cover, start, 1)
                np.add.at(cover, start + LENGTH, -1)
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        out: list[tuple] = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            g = gone[a:b]
            n = int(np.count_nonzero(g))
            kept = (buf[a:b][~g] if n else buf[a:b]).tobytes()
            out.append((b - a, n, int(np.count_nonzero(g[1:] & ~g[:-1])) + int(b > a and g[0]), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        columns = list(zip(*out, strict=True))
        return pa.table([ids, *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=False))], schema=schema)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with_text adds the kept bytes."""
    spark = docs.sparkSession
    size = text_bytes(docs)
    blocks = blocks_for(size, BLOCK_BYTES, partitions(spark))
    hash_buckets = blocks_for(size // 4, 2 * BLOCK_BYTES, partitions(spark))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"))
    by_block = dealt.groupBy("block")
    by_bucket = dealt.mapInArrow(_emit_hashes(hash_buckets), "bucket int, payload binary").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    repeated = by_bucket.mapInArrow(_find_repeated, "block long, payload binary")
    contexts = by_block.cogroup(repeated.groupBy("block")).applyInArrow(_contexts(2 * blocks), _ROWS_DDL)
    shard = F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(-1 - F.col("block"))
    solved = contexts.repartition(partitions(spark), shard).sortWithinPartitions("bucket").mapInArrow(_shards, _ROWS_DDL)
    return by_block.cogroup(solved.groupBy("block")).applyInArrow(_remove(with_text), _RESULT_DDL + (", kept binary" if with_text else ""))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents without those under repeated 100-byte strings."""
    return remove_repeats(table(spark, sf_dir, "documents"))
