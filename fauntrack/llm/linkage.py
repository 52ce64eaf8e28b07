"""Signature groups -> verified links -> classes: the part that all similarity joins here share.

A join gives packed signatures per entity (a distinct set or a distinct line).
Signatures are exchanged as 5-byte values in binary payloads, one row per
(Arrow batch, bucket), so that a shuffle moves few rows. A signature that many
entities of one batch share travels once, with a flag, and its members are
listed on the spot: a hot signature costs one entry a batch, not one a row.

From the groups come star edges (least member to each other member), which are
verified and turned into classes. A group whose members all belong to one class
is settled; the members of the others are compared again, exactly, by the
join's own second way, and only across classes. An entity's 64-bit name is
checked by a second one (its tag) before two rows are called equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks_for, join_hot, materialise, mix, partitions

#: Bits of a signature in a payload; the highest one says that a batch listed more members itself.
BITS = 39
_FLAG = U64(1) << U64(BITS)
_LOW = _FLAG - U64(1)
#: A batch lists the members of a signature itself from this number on.
LOCAL_GROUP = 6
#: Bytes of signatures that a bucket should hold.
BUCKET_BYTES = 4_000_000

ROWS_DDL = "kind int, bucket int, a long, b long, n long, payload binary"
ROWS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])
#: Kinds of rows: payload of signatures; member (b) of a group (a); star edge a-b; anything the join adds for itself.
PAYLOAD, MEMBER, EDGE, OWN = 0, 1, 2, 3


def rows(kind: int, bucket=0, a=0, b=0, n=0, payload=None, count: int | None = None) -> pa.RecordBatch:
    """One batch of exchange rows; scalars are repeated."""
    size = count if count is not None else max(len(x) for x in (bucket, a, b, n, payload) if x is not None and not np.isscalar(x))
    full = lambda x, t: pa.array(np.full(size, x) if np.isscalar(x) else (x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == np.uint64 else x), t)
    return pa.record_batch([full(kind, pa.int32()), full(bucket, pa.int32()), full(a, pa.int64()), full(b, pa.int64()), full(n, pa.int64()), pa.array([None] * size if payload is None else payload, pa.binary())], schema=ROWS)


def bucket_count(units: int, df: DataFrame) -> int:
    """Buckets for `units` bytes of signatures: in proportion to the input, at least two a shuffle partition."""
    return blocks_for(units, BUCKET_BYTES, 2 * partitions(df.sparkSession))


def pack_signatures(sig: np.ndarray, ent: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Payload rows of one batch of (signature, entity) pairs, and its own groups for hot signatures."""
    if not len(sig):
        return
    bucket, low = split(sig, buckets)
    order = np.lexsort((ent, low, bucket))
    bucket, low, ent = bucket[order], low[order], ent[order]
    same = (bucket[1:] == bucket[:-1]) & (low[1:] == low[:-1])
    keep = np.r_[True, ~(same & (ent[1:] == ent[:-1]))]
    bucket, low, ent = bucket[keep], low[keep], ent[keep]
    first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1])])
    count = np.diff(np.r_[first, len(low)])
    hot = count >= LOCAL_GROUP
    if hot.any():
        of = np.repeat(np.arange(len(first)), count)
        member = hot[of] & (np.arange(len(low)) != first[of])
        gid = (bucket[member] << U64(40)) | low[member]
        yield rows(MEMBER, a=gid, b=ent[member])
        pair = np.unique(np.stack([ent[first[of[member]]], ent[member]]), axis=1)
        yield rows(EDGE, a=np.ascontiguousarray(pair[0]), b=np.ascontiguousarray(pair[1]))
        low[first[hot]] |= _FLAG
        bucket, low, ent = bucket[~member], low[~member], ent[~member]
    yield pack_lists(bucket, low, ent)


def pack_lists(bucket: np.ndarray, low: np.ndarray, ent: np.ndarray) -> pa.RecordBatch:
    """One payload row a bucket; within it, an entity's number stands once before its signatures."""
    order = np.lexsort((ent, bucket))
    bucket, low, ent = bucket[order], low[order], ent[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[cuts[1:], len(bucket)]
    names, payloads = [], []
    for s, e in zip(cuts, ends, strict=True):
        who = ent[s:e]
        new = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        times = np.diff(np.r_[new, e - s]).astype(np.uint32)
        five = low[s:e].view(np.uint8).reshape(-1, 8)[:, :5]
        payloads.append(np.uint32(len(new)).tobytes() + who[new].tobytes() + times.tobytes() + np.ascontiguousarray(five).tobytes())
        names.append(int(bucket[s]))
    return rows(PAYLOAD, bucket=np.array(names, np.int32), payload=payloads)


def split(sig: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and low bits of signatures."""
    return ((sig >> U64(40)) * U64(buckets)) >> U64(24), sig & _LOW


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, np.uint32, 1)[0])
    who = np.frombuffer(payload, np.uint64, n, 4)
    times = np.frombuffer(payload, np.uint32, n, 4 + 8 * n)
    raw = np.frombuffer(payload, np.uint8, -1, 4 + 12 * n).reshape(-1, 5)
    low = np.zeros((len(raw), 8), np.uint8)
    low[:, :5] = raw
    return low.view(np.uint64).ravel(), np.repeat(who, times)


def _groups(bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
    parts = [unpack(p) for p in payloads]
    low, ent = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    sig = low & _LOW
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    near = np.zeros(len(sig), bool)
    near[1:] |= sig[1:] == sig[:-1]
    near[:-1] |= sig[1:] == sig[:-1]
    near |= low[order] >= _FLAG
    order, sig = order[near], sig[near]
    if not len(sig):
        return
    ent, flag = ent[order], low[order] >= _FLAG
    order = np.lexsort((ent, sig))
    sig, ent, flag = sig[order], ent[order], flag[order]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    flagged = np.logical_or.reduceat(flag, first)
    of = np.cumsum(np.r_[False, sig[1:] != sig[:-1]])
    keep = np.r_[True, (sig[1:] != sig[:-1]) | (ent[1:] != ent[:-1])]
    sig, ent, of = sig[keep], ent[keep], of[keep]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    count = np.diff(np.r_[first, len(of)])
    # groups of the same members are one group, unless batches have listed more members under its name
    name = (U64(bucket) << U64(40)) | sig[first]
    members = np.add.reduceat(mix(ent), first) ^ count.astype(np.uint64)
    members |= U64(1) << U64(63)
    name = np.where(flagged, name, members)
    chosen = np.zeros(len(first), bool)
    chosen[np.unique(name, return_index=True)[1]] = True
    chosen &= flagged | (count > 1)
    at = chosen[of]
    if at.any():
        yield rows(MEMBER, a=name[of[at]], b=ent[at])
    other = at & (np.arange(len(of)) != first[of])
    if other.any():
        pair = np.unique(np.stack([ent[first[of[other]]], ent[other]]), axis=1)
        yield rows(EDGE, a=np.ascontiguousarray(pair[0]), b=np.ascontiguousarray(pair[1]))


def each_bucket(solve: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]]):
    """Runs solve over the payloads of every bucket of a partition sorted by kind and bucket; other rows pass through."""
    return lambda batches: _by_bucket(batches, solve)


def _by_bucket(batches: Iterator[pa.RecordBatch], solve=None) -> Iterator[pa.RecordBatch]:
    solve = solve or _groups
    at, held = None, []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        for k in np.flatnonzero(kind == PAYLOAD):
            bucket = batch.column("bucket")[int(k)].as_py()
            if bucket != at and held:
                yield from solve(at, held)
                held = []
            at = bucket
            held.append(batch.column("payload")[int(k)].as_py())
        rest = kind != PAYLOAD
        if rest.any():
            yield batch.filter(pa.array(rest))
    if held:
        yield from solve(at, held)


def exchange(signed: DataFrame, name: str) -> DataFrame:
    """Rows of a signature pass -> materialised MEMBER, EDGE and OWN rows."""
    return materialise(by_bucket(signed).mapInArrow(_by_bucket, ROWS_DDL), name)


def by_bucket(signed: DataFrame) -> DataFrame:
    """Rows dealt by bucket (payloads) or at large (others), each partition sorted for each_bucket."""
    dealt = signed.repartition(partitions(signed.sparkSession), F.when(F.col("kind") == PAYLOAD, F.col("bucket").cast("long")).otherwise(F.xxhash64("a", "b")))
    return dealt.sortWithinPartitions("kind", "bucket")


def star_pairs(found: DataFrame) -> DataFrame:
    """Star edges worth verifying first: of each entity, to its least centre and to the one with the least hash.

    Two a row at most, whatever the groups; what they leave unlinked stays open
    for the exact second way of the join.
    """
    e = found.where(F.col("kind") == EDGE).groupBy("b").agg(F.min("a").alias("a1"), F.min_by("a", F.xxhash64("a")).alias("a2"))
    return e.select("b", F.explode(F.array_distinct(F.array("a1", "a2"))).alias("a")).select("a", "b")


#: Up to this many counted edges (16 bytes each) one task finds the components; beyond it they are found by rounds of joins.
ONE_TASK_EDGES = 1_000_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "label"])


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """node, label (least node of its component) for the nodes of edges a-b, which are a written table.

    Few edges (their number is checked) go through one task. Otherwise: least-label propagation with pointer jumping; every round is written to the
    shared folder. Rounds grow with the logarithm of a component's diameter on
    the star-like graphs at hand, and stop only when nothing changes.
    """
    if edges.count() <= ONE_TASK_EDGES:
        return materialise(edges.select("a", "b").coalesce(1).mapInArrow(_union_find, "node long, label long"), name)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, f"{name}-edges")
    degree = materialise(both.groupBy("b").agg(F.count("*").alias("degree")), f"{name}-degrees")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), name)
    while True:
        # a hub has many edges, and a large class many nodes: both joins keep such keys out of one task
        facts = materialise(degree.join(labels.withColumnRenamed("node", "b"), "b"), f"{name}-told")
        told = join_hot(both, facts, ["b"], "degree").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(told, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        new = materialise(new, f"{name}-near")
        sizes = new.groupBy("label").agg(F.count("*").alias("nodes"))
        roots = materialise(sizes.join(labels.select(F.col("node").alias("label"), F.col("label").alias("jump")), "label"), f"{name}-roots")
        new = materialise(join_hot(new, roots, ["label"], "nodes", "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")), name)
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def unsettled(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of groups that hold more than one class: group a, entity b and its label, each once."""
    named = groups.distinct().join(labels, groups["b"] == labels["node"], "left").select("a", "b", F.coalesce("label", "b").alias("label"))
    mixed = named.groupBy("a").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("a", "n")
    return join_hot(named, materialise(mixed, "mixed-groups"), ["a"], "n").select("a", "b", "label")


def center_pairs(keyed: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Star edges inside keys of several labels, from each member to its key's centre, where their labels differ.

    keyed: key, ent, label. The centre of a key is the member with the least
    score (scores: ent, score; the least hash if there are none): two edges a
    member at most, whatever the groups.
    """
    own = keyed if scores is None else keyed.join(scores, "ent", "left")
    place = F.struct(F.lit(0) if scores is None else F.coalesce("score", F.lit(0)), F.xxhash64("ent"), F.col("ent"), F.col("label"))
    centre = own.groupBy("key").agg(F.min(place).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    centre = materialise(centre.select("key", "n", F.col("c.ent").alias("centre"), F.col("c.label").alias("of")), "centres")
    e = join_hot(keyed, centre, ["key"], "n").where("label <> of").groupBy("ent").agg(F.min("centre").alias("c1"), F.min_by("centre", F.xxhash64("centre")).alias("c2"))
    return e.select(F.col("ent").alias("b"), F.explode(F.array_distinct(F.array("c1", "c2"))).alias("a")).select("a", "b")


def _folded(sketch: list[bytes], most: int = 64) -> np.ndarray:
    """Sketches folded to one common width."""
    width = min([most, *map(len, sketch)])
    return np.stack([np.frombuffer(x, np.uint8).reshape(-1, width).sum(0, dtype=np.int32) for x in sketch]).astype(np.int16)


#: Members of a key that one unit of comparison holds on either side; larger keys are cut into several units.
BLOCK_MEMBERS = 2048
#: Orders of keys that name the one key under which a pair is given.
_ORDERS = (0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x5851F42D4C957F2D, 0x369DEA0F31A53F85, 0x7A6D76E9E3E0B6A3, 0x02B6C1F5A9D83E47, 0x4C15F2E1B7A96D0B, 0x61E9A53C0D7F4B29)


def cross_pairs(keyed: DataFrame, facts: DataFrame, reach: Callable, bound: Callable, exact: Callable | None = None) -> DataFrame:
    """Distinct pairs a-b of different labels within a key that may be linked, by sketches; keyed: key, ent, label, facts: ent, n, sketch, slack.

    Keys whose members share one label are dropped first. In the others, members
    that are not of the key's largest class are compared with all members, in
    units of BLOCK_MEMBERS on either side, in numpy: reach(n) is the largest
    size worth comparing, bound(n, m) the most by which folded sketches may
    differ, less the slack of both members (what each has that no other member
    of any key has; a sketch with a full bin counts as no difference), and
    exact, if given, looks at the pair's two sketches again. Only pairs that
    pass leave, and mostly once: each entity carries the first of its keys in eight orders, and a pair
    whose entities agree on a first key is given under that key alone.
    """

    def across(key: int, probe: list[tuple], build: list[tuple]) -> tuple[list[int], list[int]]:
        build.sort(key=lambda x: (x[2], x[0]))
        ent = [np.array([x[0] for x in g], np.int64) for g in (probe, build)]
        label = [np.array([x[1] for x in g], np.int64) for g in (probe, build)]
        n = [np.array([x[2] for x in g], np.int64) for g in (probe, build)]
        flat = _folded([x[3] for x in probe] + [x[3] for x in build])
        flat = flat[: len(probe)], flat[len(probe) :]
        full = [np.array([max(x[3]) == 255 for x in g]) for g in (probe, build)]
        slack = [np.array([x[4] for x in g], np.int64) for g in (probe, build)]
        first = [np.array([x[6:] for x in g], np.int64) for g in (probe, build)]
        minor = np.array([x[5] for x in build])
        step = max(1, 2_000_000 // (len(build) * flat[0].shape[1]))
        out_a, out_b = [], []
        for s in range(0, len(probe), step):
            at = slice(s, min(len(probe), s + step))
            low, high = np.minimum(n[0][at, None], n[1][None]), np.maximum(n[0][at, None], n[1][None])
            # two members outside the largest class meet twice; the smaller one's turn counts
            ok = (label[0][at, None] != label[1][None]) & (high <= reach(low)) & (~minor[None] | (ent[0][at, None] < ent[1][None]))
            owned, open_ = np.zeros(ok.shape, bool), ok.copy()
            for k, order in enumerate(_ORDERS):
                same = open_ & (first[0][at, None, k] == first[1][None, :, k])
                owned |= same & (first[0][at, None, k] == (key ^ order))
                open_ &= ~same
            ok &= owned | open_
            some = np.flatnonzero(ok.any(0))
            if not len(some):
                continue
            apart = np.abs(flat[0][at, None] - flat[1][None, some]).sum(2, dtype=np.int32)
            apart[full[0][at, None] | full[1][None, some]] = 0
            left = bound(n[0][at, None], n[1][None, some]) - slack[0][at, None] - slack[1][None, some]
            ok = ok[:, some] & (apart <= left)
            for i, j in zip(*np.nonzero(ok), strict=True):
                x, y = probe[s + i], build[some[j]]
                if exact is None or exact(x[3], y[3]) <= left[i, j]:
                    out_a.append(min(x[0], y[0]))
                    out_b.append(max(x[0], y[0]))
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, probe, build = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if probe and build:
                a, b = across(at[0], probe, build)
                if a:
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, i, j, asks, answers, *member in zip(*(batch.column(c).to_pylist() for c in _UNIT), strict=True):
                if (key, i, j) != at:
                    yield from close()
                    at, probe, build = (key, i, j), [], []
                if asks:
                    probe.append(tuple(member))
                if answers:
                    build.append(tuple(member))
        yield from close()

    by_label = keyed.groupBy("key", "label").agg(F.count("*").alias("c"))
    stats = by_label.groupBy("key").agg(F.max_by("label", "c").alias("top"), F.sum("c").alias("n"), F.max("c").alias("most"), F.count("*").alias("labels")).where("labels > 1")
    stats = materialise(stats.select("key", "top", "n", F.ceil(F.col("n") / BLOCK_MEMBERS).alias("gb"), F.ceil((F.col("n") - F.col("most")) / BLOCK_MEMBERS).alias("gp")), "cross-keys")
    own = join_hot(keyed, stats, ["key"], "n").withColumn("minor", F.col("label") != F.col("top"))
    own = materialise(own, "cross-members")
    firsts = own.groupBy("ent").agg(*[F.min(F.col("key").bitwiseXOR(F.lit(order))).alias(f"m{k}") for k, order in enumerate(_ORDERS)])
    own = own.join(firsts.join(facts.select("ent", "n", "sketch", "slack"), "ent"), "ent")
    zero, to = F.lit(0).cast("long"), lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    chunk = lambda c: F.pmod(F.xxhash64("ent"), F.col(c))
    one = (F.col("gb") == 1) & (F.col("gp") == 1)
    units = own.where(one).withColumns({"i": zero, "j": zero, "asks": F.col("minor"), "answers": F.lit(True)})
    builds = own.where(~one).withColumns({"i": to("gp"), "j": chunk("gb"), "asks": F.lit(False), "answers": F.lit(True)})
    probes = own.where(~one & F.col("minor")).withColumns({"i": chunk("gp"), "j": to("gb"), "asks": F.lit(True), "answers": F.lit(False)})
    dealt = units.unionByName(builds).unionByName(probes).select(*_UNIT).repartition(partitions(keyed.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


_UNIT = ["key", "i", "j", "asks", "answers", "ent", "label", "n", "sketch", "slack", "minor", *(f"m{k}" for k in range(len(_ORDERS)))]


def spread(own: DataFrame, linked: DataFrame, place: Column, name: str) -> DataFrame:
    """ent, tag, rows, first, total: for every distinct (ent, tag) of own, the least place and the rows of its class.

    An entity is what (ent, tag) says: two that share ent by chance differ in
    tag and stay apart. linked: ent, tag, label of the linked ones. Rows are
    counted before anything is joined, so that no key is hot but for classes of
    many distinct entities, which join_hot spreads.
    """
    distinct = own.groupBy("ent", "tag").agg(F.count("*").alias("rows"), F.min(place).alias("at"))
    c2 = F.when(F.col("label").isNull(), F.col("tag"))
    classed = distinct.join(linked, ["ent", "tag"], "left").withColumns({"c1": F.coalesce("label", "ent"), "c2": F.coalesce(c2, F.lit(b""))}).drop("label")
    classed = materialise(classed, f"{name}-distinct")
    classes = classed.groupBy("c1", "c2").agg(F.min("at").alias("first"), F.sum("rows").alias("total"), F.count("*").alias("members")).where("total > 1")
    return materialise(join_hot(classed, materialise(classes, f"{name}-classes"), ["c1", "c2"], "members").select("ent", "tag", "rows", "first", "total"), f"{name}-named")
