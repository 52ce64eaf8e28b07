import pytest
from pyspark.sql import functions as F

from fauntrack import config
from fauntrack.plans import fixtures
from fauntrack.sources import readers
from fauntrack.streaming import live


def test_settings_round_trip_and_precedence(tmp_path):
    s = config.override(config.Settings(), {"depth_range": "400:20", "path_methods": "astar,viterbi", "n_agents": "7"})
    assert s.depth_range == (20.0, 400.0) and s.path_methods == ("astar", "viterbi") and s.n_agents == 7
    (tmp_path / "c.toml").write_text(config.save(s))
    assert config.load(str(tmp_path / "c.toml")) == s
    assert config.arguments(["--config", str(tmp_path / "c.toml"), "--n-agents", "100"]).n_agents == 100
    for bad in ({"no_such": 1}, {"depth_barrier_mode": "x"}, {"path_methods": "y"}):
        with pytest.raises(ValueError):
            config.override(s, bad)


def test_polygons(spark, tmp_path):
    assert readers.wkt_rings("MULTIPOLYGON(((0 0, 2 0, 2 2, 0 0)),((5 5, 6 5, 6 6, 5 5)))")[1][0] == (5.0, 5.0)
    (tmp_path / "p.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}}]}')
    r = readers.read_polygons(spark, str(tmp_path / "p.geojson"))
    assert r.count() == 4 and r.columns == ["region", "seq", "x", "y"]
    t = spark.createDataFrame([("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", "decoy")], "wkt_geo string, wkt_planar string")
    assert readers.rings_from_table(t).count() == 5
    with pytest.raises(ValueError, match="rds"):
        readers.read_table(spark, "x.rds")
    with pytest.raises(ValueError, match="labels"):
        readers.read_regions(spark, ["a"], [])


def test_store(spark, tmp_path, sf_dir):
    u = fixtures.units(spark, sf_dir)
    readers.write_store({"units": u}, str(tmp_path / "s"))
    assert readers.read_store(spark, str(tmp_path / "s"))["units"].count() == 100


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    det = fixtures.detections(spark, sf_dir).select("tagid", "ts", "s_idx", "value").orderBy("ts").coalesce(1)
    det.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(det.schema).parquet(str(tmp_path / "in"))
    q = live.pairs(stream).writeStream.format("memory").queryName("live_pairs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("live_pairs").groupBy().agg(F.count("*").alias("n"), F.sum("k").alias("k")).first()
    want = fixtures.pairs(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("k").alias("k")).first()
    assert (got["n"], got["k"]) == (want["n"], want["k"])
    v = live.visits(stream).writeStream.format("memory").queryName("live_visits").outputMode("append").trigger(availableNow=True).start()
    v.awaitTermination(120)
    assert spark.table("live_visits").count() > 0
