"""The store is written once per state of its sources; streaming pairs in any order are the batch's."""

import time

import pytest
from pyspark.sql import functions as F

from fauntrack.plans import fixtures
from fauntrack.sources import assimilate
from fauntrack.streaming import live


def test_store_is_written_once(spark, tmp_path):
    at = f"file://{tmp_path}"
    write = lambda name, n: spark.range(n).withColumn("lon", F.col("id") / 2).write.mode("overwrite").parquet(f"{at}/in/{name}.parquet")
    write("tagging", 3)
    write("units", 4)
    sources = {k: f"{at}/in/{k}.parquet" for k in ("tagging", "units")}
    store = f"{at}/store"
    assert assimilate.status(spark, sources, store) == {"fresh": [], "stale": [], "absent": ["tagging", "units"], "missing": []}
    assert assimilate.assimilate(spark, sources, store) == {"written": ["tagging", "units"], "skipped": []}
    assert {k: (v.count(), v.columns) for k, v in assimilate.read(spark, store).items()} == {"tagging": (3, ["id", "lon"]), "units": (4, ["id", "lon"])}
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*") if p.is_file()}
    assert assimilate.assimilate(spark, sources, store) == {"written": [], "skipped": ["tagging", "units"]}
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*") if p.is_file()}
    time.sleep(1.1)
    write("units", 5)
    assert assimilate.status(spark, sources, store)["stale"] == ["units"]
    # a run that is cut off between data and manifest leaves the old table
    half = assimilate.fingerprint(spark, sources["units"])["digest"][:16]
    spark.range(1).write.parquet(f"{store}/units/{half}")
    assert assimilate.read(spark, store)["units"].count() == 4
    assert assimilate.assimilate(spark, sources, store) == {"written": ["units"], "skipped": ["tagging"]}
    assert {k: v.count() for k, v in assimilate.read(spark, store).items()} == {"tagging": 3, "units": 5}
    with pytest.raises(FileNotFoundError, match="gone"):
        assimilate.assimilate(spark, sources | {"gone": f"{at}/in/gone.parquet"}, store)


def test_shuffled_stream_gives_the_batch_pairs(spark, sf_dir, tmp_path):
    """Rows up to half a day out of order, ties included, in eight files; a last row far ahead lets the watermark pass."""
    det = fixtures.detections(spark, sf_dir).select("tagid", F.date_trunc("minute", "ts").alias("ts"), "s_idx").cache()
    late = F.unix_seconds("ts") + F.pmod(F.xxhash64("tagid", "ts"), F.lit(43_200))
    rows = det.withColumn("_at", late).orderBy("_at").toPandas()
    for k in range(8):
        part = rows.iloc[k * len(rows) // 8 : (k + 1) * len(rows) // 8].drop(columns="_at")
        spark.createDataFrame(part, det.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    end = spark.createDataFrame([(-1, 1)], "tagid long, s_idx int").select("tagid", (F.lit(rows["ts"].max()) + F.expr("INTERVAL 9 DAYS")).cast("timestamp").alias("ts"), "s_idx")
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(det.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.ordered_pairs(stream, late="1 day").writeStream.format("memory").queryName("ordered_pairs").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got = sorted(map(tuple, spark.table("ordered_pairs").collect()))
    from fauntrack.operators import telemetry

    want = telemetry.pair_consecutive(telemetry.index_detections(det, "tagid", "ts", "s_idx"), 3600.0).select("tagid", "release", "recapture", "k")
    assert got == sorted(map(tuple, want.collect()))
