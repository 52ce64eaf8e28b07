"""The jobs over growing input, run again, and against the library's own pairs and DuckDB."""

import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from fauntrack.operators import telemetry
from fauntrack.plans import fixtures
from jobs import detection_pairs, movement_report, queries, settings
from tests.test_catalog import rows

PAIR = ("tagid", "tag", "release", "recapture", "k")


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").cache()


def all_pairs(df):
    return sorted(tuple(r) for r in df.select(F.col("tagid").cast("string").alias("tagid"), F.col("tag").cast("long").alias("tag"), "release", "recapture", "k").collect())


def plain(events):
    """All pairs by the one-window operator; ties go by id as a string, as in the job."""
    d = events.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("tagid"), F.col("ts").cast("timestamp").alias("ts"), (F.get_json_object("props", "$.k").cast("int") + 1).alias("s_idx"))
    return all_pairs(telemetry.pair_consecutive(telemetry.index_detections(d.dropna(), "tagid", "ts", "id"), 3600.0))


@pytest.mark.parametrize("name", ["job1_detection_pairs", "job2_movement_report"])
def test_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert rows(got) == rows(want)


def test_pairs_over_growing_input(spark, events, tmp_path):
    """Parts in no order of time: late detections come between earlier ones; the second run takes only what is new."""
    source, target, mark = (f"file://{tmp_path}/{x}" for x in ("source", "target", "mark"))
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    s = detection_pairs.Settings(buckets=5)
    seen = events.limit(0)
    for k in range(3):
        new = events.where(part == k)
        new.coalesce(2).write.mode("append").parquet(source)
        seen = seen.unionByName(new)
        got = detection_pairs.run(spark, source, target, mark, s)
        assert all_pairs(got) == plain(seen)
    stored = spark.read.schema(detection_pairs.DETECTIONS).parquet(f"{target}/detections")
    assert {r["batch"]: r["n"] for r in stored.groupBy("batch").agg(F.count("*").alias("n")).collect()} == {k: events.where(part == k).count() for k in range(3)}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "target").rglob("part-*")}
    assert all_pairs(detection_pairs.run(spark, source, target, mark, s)) == plain(events)
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "target").rglob("part-*")}  # nothing new, nothing written


def test_a_repeated_batch_replaces_itself(spark, events, tmp_path):
    target = f"file://{tmp_path}/target"
    take = detection_pairs._part(detection_pairs.Settings(buckets=3))
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))
    for k in (0, 1, 1):
        take(events.where(half == k), k, target)
    assert all_pairs(detection_pairs.read_pairs(spark, target)) == plain(events)


def test_bad_and_repeated_detections(spark, tmp_path):
    source, target, mark = (f"file://{tmp_path}/{x}" for x in ("source", "target", "mark"))
    s = detection_pairs.Settings(id="id", tag="who", time="t", unit="u", buckets=2, files_per_batch=1)
    first = [(1, "a", 0, 5), (2, "a", 7200, 6), (None, "a", 1, 1), (3, None, 1, 1), (4, "a", None, 1), (5, "a", 9, None), (6, "b", 5, 1), (7, "ü b", 0, 1)]
    second = [(1, "a", 99999, 9), (2, "a", 7200, 6), (8, "a", 3600 * 50, 7), (9, "a", 3600, 8), (10, "a", 3600, 4), (11, "b", 5, 2)]
    for part in (first, second):
        df = spark.createDataFrame([(i, w, u) + (None if t is None else t,) for i, w, t, u in part], "id int, who string, u int, sec long")
        df.select("id", "who", (F.timestamp_seconds("sec")).cast("timestamp_ntz").alias("t"), "u", F.lit("clash").alias("tagid"), F.lit(9).alias("bucket")).coalesce(1).write.mode("append").parquet(source)
        got = detection_pairs.run(spark, source, target, mark, s)
    assert all_pairs(got) == [("a", 1, 5, 4, 1), ("a", 2, 4, 8, 1), ("a", 3, 8, 6, 1), ("a", 4, 6, 7, 48), ("b", 1, 2, 1, 1)]


def test_no_detections(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([], "event_id long, user_id long, ts timestamp_ntz, props string").write.parquet(f"{at}/source")
    assert detection_pairs.run(spark, f"{at}/source", f"{at}/target", f"{at}/mark").count() == 0


def test_hot_tags_are_paired_in_chunks(spark, events):
    """Whatever the chunk, the pairs are those of one window a tag; one tag holds a third of the rows."""
    d = events.select("event_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id")).alias("tagid"), F.col("ts").cast("timestamp").alias("ts"), (F.get_json_object("props", "$.k").cast("int") + 1).alias("s_idx"))
    want = all_pairs(telemetry.pair_consecutive(telemetry.index_detections(d, "tagid", "ts", "event_id"), 3600.0))
    for chunk in ("year", "month", "day", "hour"):
        assert all_pairs(telemetry.pair_in_chunks(d, 3600.0, chunk)) == want


def test_report_by_months(spark, events, sf_dir, tmp_path):
    """A month that is written again replaces itself and leaves the others; csv and parquet hold the same."""
    at = f"file://{tmp_path}"
    fixtures.units(spark, sf_dir).select("s_idx", "lon", "lat", "hsi").write.parquet(f"{at}/units")
    events.write.parquet(f"{at}/events")
    whole = movement_report.run(spark, f"{at}/events", f"{at}/units", f"{at}/report")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(whole)
    months = sorted({r["month"] for r in whole.select("month").distinct().collect()})
    one = movement_report.Settings(months=(months[0],), format="csv")
    part = movement_report.run(spark, f"{at}/events", f"{at}/units", f"{at}/part", one)
    assert key(part) == [r for r in want if r[-1] == months[0]]
    if len(months) > 1:
        again = movement_report.run(spark, f"{at}/events", f"{at}/units", f"{at}/report", movement_report.Settings(months=(months[-1],)))
        assert key(again) == want
    assert key(movement_report.run(spark, f"{at}/events", f"{at}/units", f"{at}/report")) == want


def test_command_lines_read_settings(tmp_path, monkeypatch):
    for kind, name in ((detection_pairs.Settings, "detection_pairs"), (movement_report.Settings, "movement_report")):
        s = settings.load(kind, f"{queries.__file__.rsplit('/', 1)[0]}/{name}.toml")
        assert {k: list(v) if isinstance(v, tuple) else v for k, v in vars(s).items()} == {k: list(v) if isinstance(v, tuple) else v for k, v in vars(kind()).items()}
    bad = tmp_path / "bad.toml"
    bad.write_text("buckets = 3\nbucket = 4\n")
    with pytest.raises(ValueError, match="bucket"):
        settings.load(detection_pairs.Settings, str(bad))


def test_jobs_import_nothing_of_the_text_operators():
    code = "import sys, jobs.queries; assert not any(m == 'corpus_pipeline' or m.startswith('fauntrack.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=queries.__file__.rsplit("/jobs/", 1)[0])
