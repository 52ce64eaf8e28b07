"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in an order shuffled by a hash, form a stream of
words that is cut into blocks of BLOCK words and may run twice. Slot t of the
schedule takes the point frac(t * golden ratio) of the cumulative target
shares, which names its source; its rank among the slots of that source names
the block. Ranks and stream positions are computed in two levels (small chunks,
then sums over chunks), so that a source with most of the rows is spread.

Defined results: null or empty texts have size 0 and take 0; a null source is a
source of its own, last in order; an empty table or one without words gives
targets of 0; repeated doc_ids share no state (each row has its own place); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK_REGEX, blocks_for, materialise, partitions, table

#: Words of a block, share of all words that the mix takes, most repeats of a source.
BLOCK, SHARE, REPEATS = 64, 1.5, 2
WEIGHTS = (3, 1, 2)
#: Slots of a chunk, and documents of a chunk of a stream.
CHUNK = 4096
_GOLDEN = 0.6180339887498949


def n_words(column: str = "text"):
    """Words of a text, without keeping them."""
    return F.expr(f"CAST(regexp_count(coalesce({column}, ''), '[^ \\\\x09-\\\\x0D]+') AS BIGINT)")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size -> weight and target by water filling, in closed form.

    Target = min(repeats * size, level * weight) with the level at which the
    targets sum to share * all words. Sources sorted by repeats * size / weight
    fill up one after another, so the level follows from prefix sums. One row
    for each source is all that meets here.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-32"), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_n") - 1) % len(weights) + 1).cast("int")).cast("double")
    d = sizes.withColumn("_n", F.row_number().over(order)).withColumn("weight", w)
    d = d.withColumn("_cap", F.col("source_size") * float(repeats)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    by = Window.orderBy("_ratio", "_n")
    all_rows = Window.partitionBy()
    d = d.withColumn("_before", F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    d = d.withColumn("_rest", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("_all", F.sum("source_size").over(all_rows) * float(share))
    d = d.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_rest"))
    # the first source that the level does not fill decides
    d = d.withColumn("_at", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_n", "_level"))).over(all_rows)["_level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_at"), F.lit(float("inf"))) * F.col("weight"))
    return d.select("source", "source_size", F.col("_n").alias("source_no"), target.alias("target"))


def _running(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all earlier rows of `keys`, ordered by chunk and then by `order`: two levels."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, chunk, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    df = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(starts, [*keys, chunk]).withColumn(name, F.col("_start") + F.col("_in")).drop("_start", "_in")


def schedule(spark: SparkSession, sources: DataFrame, n_slots: int, block: int = BLOCK) -> DataFrame:
    """slot -> source_no and rank: golden-ratio points through the cumulative targets.

    The cumulative shares (one small row per source) travel as one sorted array
    in a single row; a binary search is not needed for the few sources there are,
    but the row grows with sources only, never with documents.
    """
    acc = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    shares = sources.where("target > 0").withColumn("_to", F.sum("target").over(acc) / F.sum("target").over(Window.partitionBy()))
    bounds = shares.agg(F.array_sort(F.collect_list(F.struct("_to", "source_no"))).alias("b"))
    slots = spark.range(0, n_slots, 1, blocks_for(n_slots, 250_000, 1)).select(F.col("id").alias("slot"), F.expr(f"(id * CAST({_GOLDEN} AS DOUBLE)) % 1").alias("point"))
    named = slots.withColumn("b", bounds.scalar()).select("slot", F.expr("coalesce(get(filter(b, x -> x._to > point), 0).source_no, try_element_at(b, -1).source_no)").alias("source_no"))
    named = named.withColumn("chunk", F.floor(F.col("slot") / CHUNK)).withColumn("one", F.lit(1))
    return _running(named, ["source_no"], "chunk", ["slot"], "one", "rank").select("source_no", "rank", "slot")


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document row."""
    spark = docs.sparkSession
    sized = materialise(docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("doc_id", "text").alias("_h"), F.monotonically_increasing_id().alias("_row")), "mix")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    total = sized.agg(F.sum("size").alias("w"), F.count("*").alias("n")).first()
    words, n_docs = int(total["w"] or 0), int(total["n"])
    sources = materialise(source_targets(by_source.drop("_docs"), weights, share, repeats), "sources")
    full = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"]).drop("source")
    n_slots = round(words * share / block)
    if not n_slots:
        # fewer words than half a block: every source takes whole words in stream order
        n_slots = 1 if words else 0
    chunks = blocks_for(n_docs, CHUNK)
    streamed = full.withColumn("chunk", F.pmod(F.shiftright("_h", 20), F.lit(chunks)))
    streamed = _running(streamed, ["source_no"], "chunk", ["_h", "doc_id", "_row"], "size", "start")
    # a document's words stand at [start, start + size) of the first run and again source_size later
    run = F.explode(F.array(*[F.lit(k) for k in range(repeats)])).alias("run")
    placed = streamed.select("*", run).withColumn("from", F.col("start") + F.col("run") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size"))
    cut = placed.where("size > 0").select("_row", "source_no", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))).alias("rank"))
    # a rank has one slot at most; the ranks of a source that slots ask for are 0 .. n - 1
    slots = schedule(spark, sources, n_slots, block).select("source_no", "rank")
    cut = cut.repartition(partitions(spark), "source_no", "rank")
    part = F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block)
    took = cut.join(slots, ["source_no", "rank"]).groupBy("_row").agg(F.sum(part).alias("taken"))
    out = full.join(took, "_row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture over all documents: target of the source and words taken per document."""
    return mix_sources(table(spark, sf_dir, "documents"))
