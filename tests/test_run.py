import json

import pytest
from pyspark.sql import functions as F

from fauntrack import __main__, config
from fauntrack.plans import fixtures, run


def test_run_from_a_csv(spark, sf_dir, tmp_path):
    d = fixtures.detections(spark, sf_dir).join(fixtures.units(spark, sf_dir).select("s_idx", "lon", "lat"), "s_idx")
    d.select("tagid", F.date_format("ts", "yyyy-MM-dd").alias("date"), "lon", "lat").coalesce(1).write.csv(f"{tmp_path}/t.csv", header=True)
    s = config.load(tagging_file=f"{tmp_path}/t.csv", output_dir=f"{tmp_path}/out", diagnostics="paths,ecology", hex_radius_km=15.0, max_paths=20)
    out = run.run(spark, s)
    assert set(out) == {"detections", "units", "edges", "pairs", "kernel", "paths", "statistics", "residence"}
    assert out["detections"].count() == 1000 and out["pairs"].count() == 985
    assert abs(out["kernel"].agg(F.sum("p")).first()[0] - out["units"].count()) < 1e-6


def test_command_line_errors(capsys):
    assert __main__.main([]) == 1 and __main__.main(["--tagging-file", "x.csv", "--time-interval", "hourly"]) == 1


def test_settings_are_applied_or_refused(spark, sf_dir, tmp_path):
    d = fixtures.detections(spark, sf_dir).join(fixtures.units(spark, sf_dir).select("s_idx", "lon", "lat"), "s_idx")
    d.select("tagid", F.date_format("ts", "yyyy-MM-dd").alias("date"), "lon", "lat").coalesce(1).write.csv(f"{tmp_path}/t.csv", header=True)
    west, south, east, north = -62.6, 44.3, -61.4, 45.0
    ring = {"type": "Polygon", "coordinates": [[[west, south], [east, south], [east, north], [west, north], [west, south]]]}
    (tmp_path / "p.geojson").write_text(json.dumps(ring))
    s = config.load(tagging_file=f"{tmp_path}/t.csv", output_dir=f"{tmp_path}/out", polygon_file=f"{tmp_path}/p.geojson", bbox=(west, south, east, north), bbox_padding_deg=0.0, time_interval="weekly", diagnostics="agents,corridors", hex_radius_km=15.0, kappa=1.0)
    out = run.run(spark, s)
    assert set(out) == {"detections", "units", "edges", "pairs", "kernel", "trajectories", "corridor_use"}
    u = out["units"].agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    assert west <= u[0] and u[1] <= east and south <= u[2] and u[3] <= north
    det = out["detections"]
    assert det.groupBy("tagid", F.date_trunc("week", "ts")).count().where("count > 1").count() == 0 and det.count() > 0
    assert out["trajectories"].select("tagid").distinct().count() == out["pairs"].count()
    assert abs(out["corridor_use"].agg(F.sum("prob")).first()[0]) > 0
    with pytest.raises(ValueError, match="depth"):
        run.run(spark, config.load(tagging_file="x.csv", depth_range="20:400"))
