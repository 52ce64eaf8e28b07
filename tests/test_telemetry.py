import datetime as dt

import pytest
from pyspark.sql import functions as F

from fauntrack.functions import geo
from fauntrack.operators import ecology, habitat, kernel, mesh, telemetry


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_validation_names_the_tag(spark):
    ok = spark.createDataFrame([("a", 0, at(0)), ("a", 1, at(1))], "tagid string, tag int, ts timestamp")
    assert telemetry.validate_telemetry(ok).count() == 2
    for bad in ([("b", 1, at(0))], [("b", 0, at(0)), ("b", 0, at(1))], [("b", 0, at(2)), ("b", 1, at(1))]):
        with pytest.raises(ValueError, match="'b'"):
            telemetry.validate_telemetry(spark.createDataFrame(bad, "tagid string, tag int, ts timestamp"))
    with pytest.raises(ValueError, match="missing"):
        telemetry.validate_telemetry(ok.drop("ts"))


def test_pair_units_in_range(spark):
    p = spark.createDataFrame([(1, 2), (3, 9)], "release int, recapture int")
    with pytest.raises(ValueError, match="1..5"):
        telemetry.validate_pair_units(p, 5)
    assert telemetry.validate_pair_units(p, 9).count() == 2


def test_cleaning_and_pairable(spark):
    d = spark.createDataFrame([("a", 0, at(0), 1.0, 1.0), ("a", 1, at(1), float("nan"), 1.0), ("b", 0, at(0), 1.0, 1.0), (None, 0, at(0), 1.0, 1.0)], "tagid string, tag int, ts timestamp, lon double, lat double")
    c = telemetry.clean(d)
    assert c.count() == 2 and telemetry.pairable(c).count() == 0


def test_dates_in_mixed_spellings(spark):
    d = spark.createDataFrame([("2020-02-30",), ("2020/2/9",), ("25/12/2019",), ("12-25-2019",), ("3/4/2019",), ("2020.5",), ("0",), ("1000000000",), ("x",), (None,)], "t string")
    got = [r[0] for r in d.select(geo.flexible_date("t")).collect()]
    assert got[0] is None and got[1] == dt.date(2020, 2, 9) and got[2] == got[3] == dt.date(2019, 12, 25)
    assert got[4] == dt.date(2019, 3, 4) and got[5] == dt.date(2020, 7, 2) and got[6] == dt.date(1970, 1, 1)
    assert got[7] == dt.date(2001, 9, 9) and got[8] is None and got[9] is None


def test_haversine_and_bearing(spark):
    r = spark.range(1).select(geo.haversine_m(F.lit(-63.0), F.lit(44.0), F.lit(-62.0), F.lit(44.0)).alias("m"), geo.haversine_m(F.lit(float("nan")), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("n"), geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("b"), geo.bearing_deg(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("z")).first()
    assert 70_000 < r["m"] < 90_000 and r["n"] != r["n"] and r["b"] == pytest.approx(90) and r["z"] is None


def test_kernel_rows_sum_to_one(spark):
    u = spark.createDataFrame([(k, 0.2 * k, False) for k in range(1, 6)], "s_idx int, hsi double, is_land boolean")
    e = spark.createDataFrame([(a, b, 1.0) for a in range(1, 6) for b in (a - 1, a + 1) if 1 <= b <= 5], "src int, dst int, w double")
    for g, r, a in ((0, 0.1, 0), (0, 0.9, 1), (10, 0.5, 0.5), (-10, 0.5, 0.5), (1, 0.5, 0.5)):
        rows = kernel.row_sums(kernel.static(u, e, float(g), r, float(a))).collect()
        assert len(rows) == 5 and all(x["total"] == pytest.approx(1) and x["least"] >= 0 for x in rows)


def test_sanitise_all_missing(spark):
    d = spark.createDataFrame([(1, float("nan")), (2, float("inf"))], "s_idx int, hsi double")
    assert [r["hsi"] for r in habitat.sanitise(d).collect()] == [0.0, 0.0]


def test_prune_renumbers(spark):
    u = mesh.hex_lattice(spark, 3, 3, 1.0)
    kept, e = mesh.prune(u, mesh.lattice_edges(u), F.col("s_idx") % 2 == 1)
    assert sorted(r["s_idx"] for r in kept.collect()) == [1, 2, 3, 4, 5]
    assert all(1 <= r["src"] <= 5 and 1 <= r["dst"] <= 5 for r in e.collect())


def test_regression_and_t_tail(spark):
    xy = list(zip([95, 102, 108, 115, 120, 125, 130, 135, 140, 145], [10, 12, 15, 18, 20, 24, 28, 30, 33, 36], strict=True))
    r = ecology.trait_regression(spark.createDataFrame([(float(a), float(b)) for a, b in xy], "x double, y double"), "x", "y").first()
    assert r["slope"] > 0 and r["r2"] > 0.9 and ecology.t_tail(r["t"], r["n"] - 2) < 0.01
    assert ecology.t_tail(2.228, 10) == pytest.approx(0.05, abs=1e-3)


def test_groups_and_habitat_have_the_expected_values(spark):
    d = spark.createDataFrame([(1, "M", "mature"), (2, "F", "mature"), (3, "F", "immature"), (4, None, "mature"), (5, "M", None)], "id int, sex string, mat string")
    got = telemetry.group_ids(d.withColumn("label", telemetry.group_label(F.col("sex"), F.col("mat")))).orderBy("id").collect()
    assert [(r["label"], r["group"]) for r in got] == [("male", 3), ("female", 1), ("immature", 2), ("unknown", 4), ("unknown", 4)]
    h = spark.createDataFrame([(6.0, 150.0), (9.0, 150.0), (3.0, 15.0), (3.0, 150.0), (3.0, -150.0), (10.0, 150.0), (5.0, 400.0)], "t double, z double")
    got = [round(r[0], 4) for r in h.select(geo.habitat_suitability("t", "z")).collect()]
    assert got == [0.2433, 0.0017, 0.0, 0.8808, 0.8808, 0.0, 0.0]
