"""Line dedup: a segment-partition edit join of lines, and documents without repeated lines.

A line, stripped of white space at its ends, is an entity by a 128-bit digest of
its bytes (64 bits name it, the others are its tag, checked before two lines are
called equal; of two lines that share a name by chance, only the first one's
near lines are looked for). It is
cut into EDITS + 1 segments; a line within EDITS edits must hold one of them
unchanged, at a place that the length difference bounds. Each line is indexed
under its own segments and probes, for every length down to its own less EDITS,
the substrings at the places that the multi-match rule leaves (12 keys in all).
Lines that share a key are verified by a banded bit-parallel edit distance, many
pairs at a time. Edits are counted in UTF-8 bytes.

Classes are connected components of links. Of each class the first occurrence
stays, by doc_id and line number; every later one is dropped.

Defined results: lines under LEAST_BYTES bytes repeat only lines of the same
bytes, and blank lines are never dropped; null or empty texts have no lines to
drop; a very long line is one entity like any other; rows with the same doc_id
and text are one document and are treated alike; other rows of one doc_id are
ordered by a hash of their texts; a null doc_id comes before all others; an
empty table gives an empty result; the operator keeps all extra columns but
n_lines, n_dropped and kept_sha256, which its own replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linkage as K
from .common import BROADCAST_BYTES, U64, free_name, join_hot, materialise, mix, pieces, prefix_hash, span_hash, table, text_buffer, text_bytes

#: Most edits between linked lines, and bytes under which only equal lines are linked.
EDITS, LEAST_BYTES = 2, 24
_CHUNK = 1 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every stripped line that is not blank, its text, and its number there."""
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    starts = starts[np.searchsorted(starts, offsets[0]) :]
    text = np.searchsorted(offsets, starts, side="right") - 1
    # an empty text has the start of its successor; a break at the very end of a text starts a line at the next one's start
    per = np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=len(offsets) - 1) + 1
    text = np.repeat(np.arange(len(offsets) - 1), per)
    first = np.r_[0, np.cumsum(per)[:-1]]
    number = np.arange(per.sum()) - np.repeat(first, per)
    starts = np.empty(per.sum(), np.int64)
    is_first = number == 0
    starts[is_first] = offsets[:-1]
    starts[~is_first] = breaks + 1
    ends = np.empty_like(starts)
    is_last = np.r_[is_first[1:], True]
    ends[is_last] = offsets[1:]
    ends[~is_last] = breaks
    for side in (0, 1):
        live = np.flatnonzero(ends > starts)
        while len(live):
            at = starts[live] if side == 0 else ends[live] - 1
            live = live[_BLANK[buf[at]]]
            if side == 0:
                starts[live] += 1
            else:
                ends[live] -= 1
            live = live[ends[live] > starts[live]]
    some = ends > starts
    return starts[some], ends[some], text[some], number[some]


def segment_keys(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, edits: int = EDITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of lines, with the line numbers they belong to: own segments and the substrings that shorter lines may hold."""
    length = ends - starts
    parts = edits + 1
    for less in range(edits + 1):
        other = length - less
        for i in range(parts):
            a, b = i * other // parts, (i + 1) * other // parts
            # left-side and right-side bounds of the shift that the edits before and after the segment allow
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                ok = np.flatnonzero((a + shift >= 0) & (b + shift <= length) & (b > a) & (other > 0))
                h = span_hash(prefix, starts[ok] + a[ok] + shift, starts[ok] + b[ok] + shift)
                yield mix(h + mix((other[ok] * 16 + i).astype(np.uint64))), ok


def _sign(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column("text"))
            sigs, ents = [], []
            for s, e in pieces(offsets, _CHUNK):
                part, off = buf[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]
                starts, ends, text, number = line_spans(part, off)
                if not len(starts):
                    continue
                prefix = prefix_hash(part)
                raw, at = part.tobytes(), pa.array(text)
                names = [hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids = np.frombuffer(b"".join(names), np.uint64)[::2].copy()
                doc, of = (batch.column(c).slice(s, e - s).take(at) for c in ("doc_id", "of"))
                yield pa.record_batch([pa.array(np.full(len(ids), K.OWN, np.int32)), pa.array(number.astype(np.int32)), doc, pa.array(ids.view(np.int64)), of, pa.array([x[8:] for x in names], pa.binary())], schema=K.ROWS)
                _, one = np.unique(ids, return_index=True)
                one = one[ends[one] - starts[one] >= LEAST_BYTES]  # shorter lines are linked by their bytes alone
                for sig, of in segment_keys(prefix, starts[one], ends[one]):
                    sigs.append(sig)
                    ents.append(ids[one[of]])
                if sum(map(len, sigs)) > 600_000:
                    yield from K.pack_signatures(np.concatenate(sigs), np.concatenate(ents), buckets)
                    sigs, ents = [], []
            if sigs:
                yield from K.pack_signatures(np.concatenate(sigs), np.concatenate(ents), buckets)

    return run


def within_edits(first: list[bytes], second: list[bytes], edits: int = EDITS) -> np.ndarray:
    """Whether each pair is within `edits` edits: one bit-parallel band of rows a column, all pairs side by side."""
    n = len(first)
    out = np.zeros(n, bool)
    if not n:
        return out
    flat = [np.frombuffer(b"".join(x), np.uint8) for x in (first, second)]
    size = [np.array(list(map(len, x)), np.int64) for x in (first, second)]
    base = [np.r_[0, np.cumsum(x)[:-1]] for x in size]
    swap = size[0] < size[1]  # rows: the longer one
    rows, cols = np.where(swap, size[1], size[0]), np.where(swap, size[0], size[1])
    text = np.concatenate([flat[0], flat[1], np.zeros(1, np.uint8)])
    row0 = np.where(swap, base[1] + len(flat[0]), base[0])
    col0 = np.where(swap, base[0], base[1] + len(flat[0]))
    live = np.flatnonzero((rows - cols <= edits))
    one = U64(1)
    top = U64(63)
    vp = np.full(len(live), (0xFFFFFFFFFFFFFFFF << (63 - edits)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    vn = np.zeros(len(live), np.uint64)
    score = np.full(len(live), edits, np.int64)
    m, w, r0, c0 = rows[live], cols[live], row0[live], col0[live]
    last = len(text) - 1
    j = 0
    while len(live):
        ended = w <= j
        if ended.any():
            out[live[ended & (score <= edits)]] = True
            go = ~ended
            live, vp, vn, score, m, w, r0, c0 = live[go], vp[go], vn[go], score[go], m[go], w[go], r0[go], c0[go]
            continue
        c = text[c0 + j]
        match = np.zeros(len(live), np.uint64)
        for t in range(2 * edits + 1):
            row = j - edits + t
            inside = (row < m) if row >= 0 else np.zeros(len(live), bool)
            match |= ((text[np.minimum(r0 + max(row, 0), last)] == c) & inside).astype(np.uint64) << U64(63 - 2 * edits + t)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        # the bottom of the band runs down the diagonal until it meets the last row, then along it
        diagonal = j + edits < m
        score += np.where(diagonal, 1 - ((d0 >> top) & one).astype(np.int64), 0)
        along = ~diagonal
        if along.any():
            bit = np.where(along, 63 - (j + edits - m + 1), 0).astype(np.uint64)
            score += np.where(along, ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64), 0)
        d0 >>= one
        vp = hn | ~(d0 | hp)
        vn = d0 & hp
        j += 1
        if j % 16 == 0:
            go = score <= 3 * edits  # along the last row a score falls by 2 * edits at most
            if not go.all():
                live, vp, vn, score, m, w, r0, c0 = live[go], vp[go], vn[go], score[go], m[go], w[go], r0[go], c0[go]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            ok = within_edits(part.column("fa").to_pylist(), part.column("fb").to_pylist())
            yield part.select(["a", "b"]).filter(pa.array(ok))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ent, tag, line, n and a sketch (counts of bytes in 64 bins, at most 255) of the line numbers asked for."""
    for batch in batches:
        ents, tags, lines = [], [], []
        for text, asked in zip(batch.column("text"), batch.column("asked").to_pylist(), strict=True):
            cut = (text.as_py() or "").encode().split(b"\n")
            for x in asked:
                ents.append(x["ent"])
                tags.append(x["tag"])
                lines.append(cut[x["line"]].strip(b" \t\n\x0b\x0c\r"))
        sketch = [np.minimum(np.bincount(np.frombuffer(x, np.uint8) & 63, minlength=64), 255).astype(np.uint8).tobytes() for x in lines]
        yield pa.record_batch([pa.array(ents, pa.int64()), pa.array(tags, pa.binary()), pa.array(lines, pa.binary()), pa.array(list(map(len, lines)), pa.int64()), pa.array(sketch, pa.binary())], names=["ent", "tag", "line", "n", "sketch"])


def _cut(names: dict[str, str]):
    """Texts without the lines in the column names["drop"], and the digest columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone = [], [], []
            for text, drop in zip(batch.column("text"), batch.column(names["drop"]).to_pylist(), strict=True):
                t = text.as_py()
                if t is None:
                    kept.append(None)
                    total.append(0)
                    gone.append(0)
                    continue
                if not drop:
                    kept.append(t)
                    total.append(t.count("\n") + 1)
                    gone.append(0)
                    continue
                lines, away = t.split("\n"), set(drop)
                kept.append("\n".join(x for k, x in enumerate(lines) if k not in away))
                total.append(len(lines))
                gone.append(len(away))
            digest = [hashlib.sha256((t or "").encode()).hexdigest() for t in kept]
            rest = [k for k in batch.schema.names if k not in ("text", names["drop"])]
            yield pa.record_batch([*(batch.column(k) for k in rest), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=[*rest, "text", "n_lines", "n_dropped", "kept_sha256"])

    return run


def line_repeats(docs: DataFrame) -> DataFrame:
    """doc, of (hash of the text) and line of every occurrence but the first of each class; docs needs doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("of"))
    found = K.exchange(docs.mapInArrow(_sign(K.bucket_count(text_bytes(docs) // 3, docs)), K.ROWS_DDL), "lines")
    own = found.where(F.col("kind") == K.OWN).select(F.col("a").alias("doc"), F.col("n").alias("of"), F.col("bucket").alias("line"), F.col("b").alias("ent"), F.col("payload").alias("tag"))
    members = found.where(F.col("kind") == K.MEMBER).select("a", "b")
    stars = materialise(K.star_pairs(found), "line-stars")
    touched = members.select(F.col("b").alias("t")).union(stars.select("a")).union(stars.select("b")).distinct()
    places = own.groupBy("ent").agg(F.min(F.struct("doc", "of", "line", "tag")).alias("at")).join(touched, F.col("ent") == F.col("t"), "left_semi")
    asked = materialise(places.groupBy(F.col("at.doc").alias("_doc"), F.col("at.of").alias("_of")).agg(F.collect_list(F.struct("ent", F.col("at.line").alias("line"), F.col("at.tag").alias("tag"))).alias("asked")), "line-places")
    few = F.broadcast(asked) if _bytes_in(asked, "asked", 32) <= BROADCAST_BYTES else asked
    lines = docs.join(few, docs["doc_id"].eqNullSafe(F.col("_doc")) & (docs["of"] == F.col("_of"))).select("text", "asked")
    lines = materialise(lines.mapInArrow(_lines, "ent long, tag binary, line binary, n long, sketch binary"), "line-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda k: lines.select(F.col("ent").alias(f"e{k}"), F.col("line").alias(f"f{k}"))
        p = pairs.join(side("a"), F.col("a") == F.col("ea")).join(side("b"), F.col("b") == F.col("eb")).select("a", "b", "fa", "fb")
        return p.where(F.abs(F.octet_length("fa") - F.octet_length("fb")) <= EDITS).mapInArrow(_verify, "a long, b long")

    links = materialise(verified(stars), "line-links")
    labels = K.components(links, "line-labels")
    open_ = materialise(K.unsettled(members, labels).select(F.col("a").alias("key"), F.col("b").alias("ent"), "label"), "line-open")
    more = materialise(verified(K.cross_pairs(open_, lines.withColumn("slack", F.lit(0)), lambda n: n + EDITS, lambda n, m: np.full(np.broadcast(n, m).shape, 2 * EDITS))), "line-links")
    if more.limit(1).count():
        labels = K.components(links.union(more), "line-labels")
    linked = labels.join(lines.select(F.col("ent").alias("node"), "tag"), "node").select(F.col("node").alias("ent"), "tag", "label")
    named = K.spread(own, linked, F.struct("doc", "of", "line"), "line")
    again = join_hot(own, named.select("ent", "tag", "rows", "first"), ["ent", "tag"], "rows")
    return again.where(~F.struct("doc", "of", "line").eqNullSafe(F.col("first"))).select("doc", "of", "line")


def _bytes_in(table_: DataFrame, column: str, bytes_each: int) -> int:
    """Bytes that a table of one list a row takes."""
    return 64 * table_.count() + bytes_each * (table_.agg(F.sum(F.size(column))).first()[0] or 0)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text cut, and n_lines, n_dropped, kept_sha256 beside it."""
    docs = docs.drop("n_lines", "n_dropped", "kept_sha256")
    drop, doc, of = (free_name(docs, x) for x in ("_drop", "_doc", "_of"))
    later = line_repeats(docs)
    gone = materialise(later.groupBy("doc", "of").agg(F.collect_set("line").alias(drop)), "line-drop")
    size = _bytes_in(gone, drop, 4)
    gone = gone.select(F.col("doc").alias(doc), F.col("of").alias(of), drop)
    gone = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    out = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[doc]) & (F.xxhash64(docs["text"]) == gone[of]), "left").drop(doc, of)
    schema = docs.drop("text").schema.add("text", "string").add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
    return out.mapInArrow(_cut({"drop": drop}), schema).select(*docs.columns, "n_lines", "n_dropped", "kept_sha256")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that repeat an earlier line up to two edits."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "kept_sha256", "text")
