"""Keeps release-recapture pairs current as detection files arrive.

    python -m jobs.detection_pairs SOURCE TARGET CHECKPOINT [--config FILE]

SOURCE is a Parquet table of detections to which files are added: a folder, or a
pattern of paths. A file stream with a checkpoint takes the files that no run
has taken. Each batch of it

1. is written to TARGET/detections, partitioned by bucket (a hash of the tag) and
   batch, with dynamic partition overwrite: a batch that is repeated after a
   failure replaces itself;
2. has the pairs of the buckets that it touches made anew from all detections of
   these buckets, and written over them in TARGET/pairs. A detection that comes
   late is thus put between its neighbours, whose pair it replaces.

Run again, it takes nothing and leaves everything as it is. Detections without
an id, a tag, a time or a unit make no pairs (the log tells how many); of rows
with the same id and tag the one of the first batch counts, then the earliest.
A source without rows leaves no table, and the result has no rows.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from fauntrack.operators import telemetry
from jobs import settings

LOG = settings.logger("jobs.detection_pairs")
DETECTIONS = "id string, tagid string, ts timestamp, s_idx int, bucket int, batch long"
PAIRS = "tagid string, tag long, release int, recapture int, rel_ts timestamp, rec_ts timestamp, k int, bucket int"


@dataclass(frozen=True)
class Settings:
    id: str = "event_id"
    tag: str = "user_id"
    time: str = "ts"
    unit: str = "CAST(get_json_object(props, '$.k') AS INT) + 1"
    step_seconds: float = 3600.0
    chunk: str = "month"
    buckets: int = 64
    files_per_batch: int = 0


def _detections(rows: DataFrame, s: Settings) -> DataFrame:
    """The detections of source rows, with the bucket of their tag."""
    d = rows.select(F.expr(s.id).cast("string").alias("id"), F.expr(s.tag).cast("string").alias("tagid"), F.expr(s.time).cast("timestamp").alias("ts"), F.expr(s.unit).cast("int").alias("s_idx"))
    return d.withColumn("bucket", F.pmod(F.xxhash64("tagid"), F.lit(s.buckets)).cast("int"))


def _once(detections: DataFrame) -> DataFrame:
    """One row for each tag and id."""
    w = Window.partitionBy("tagid", "id").orderBy("batch", "ts", "s_idx")
    return detections.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def _part(s: Settings):
    """Takes one batch of the stream: stores it, and makes the pairs of its buckets anew."""

    def take(rows: DataFrame, batch: int, target: str) -> None:
        spark = rows.sparkSession
        ok = F.concat(*[F.col(c).cast("string") for c in ("id", "tagid", "ts", "s_idx")]).isNotNull()
        seen = Observation()
        found = _detections(rows, s).withColumn("batch", F.lit(batch).cast("long")).observe(seen, F.count("*").alias("n"), F.count_if(~ok).alias("bad"))
        # the source is read once; from here on the batch is read where it was written
        out = found.where(ok).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4)))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{target}/detections")
        stored = spark.read.schema(DETECTIONS).parquet(f"{target}/detections")
        touched = {r["bucket"]: r["n"] for r in stored.where(F.col("batch") == batch).groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row a bucket
        LOG.info("batch %s: %s detections read, %s of them without id, tag, time or unit; %s written to %s/detections", batch, seen.get["n"], seen.get["bad"], sum(touched.values()), target)
        if not touched:
            return
        again = _once(stored.where(F.col("bucket").isin(list(touched))))
        pairs = telemetry.pair_in_chunks(again, s.step_seconds, s.chunk, tie="id").withColumn("bucket", F.pmod(F.xxhash64("tagid"), F.lit(s.buckets)).cast("int"))
        pairs.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{target}/pairs")
        LOG.info("batch %s: pairs of %s buckets written to %s/pairs", batch, len(touched), target)

    return take


def read_pairs(spark: SparkSession, target: str) -> DataFrame:
    """The pairs as they stand."""
    try:
        return spark.read.schema(PAIRS).parquet(f"{target}/pairs").drop("bucket")
    except Exception as e:  # no detection has come yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], PAIRS).drop("bucket")


def run(spark: SparkSession, source: str, target: str, checkpoint: str, s: Settings | None = None) -> DataFrame:
    """Takes what is new in source, and returns the pairs as they stand then."""
    s = s or Settings()
    take = _part(s)
    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    if s.files_per_batch:
        stream = stream.option("maxFilesPerTrigger", s.files_per_batch)
    query = stream.parquet(source).writeStream.foreachBatch(lambda rows, batch: take(rows, batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("%s batches taken from %s", sum(p["numInputRows"] > 0 for p in query.recentProgress), source)
    return read_pairs(spark, target)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.detection_pairs", description="Keeps release-recapture pairs current as detection files arrive.")
    for name in ("source", "target", "checkpoint"):
        p.add_argument(name)
    p.add_argument("--config")
    a = p.parse_args(argv)
    settings.log_to_terminal()
    spark = SparkSession.builder.appName("detection_pairs").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a.source, a.target, a.checkpoint, settings.load(Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
