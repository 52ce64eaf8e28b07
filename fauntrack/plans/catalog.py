"""Registry of the movement-analytics queries: each applies operators to the fixture tables; SQL where SQL can express it.

Results that carry doubles are rounded to six digits, so that two engines that
sum in different orders agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fauntrack.functions import geo
from fauntrack.operators import dynamics, ecology, electric, grids, habitat, kernel, markov, mesh, posterior, resample, telemetry
from fauntrack.plans import fixtures as X

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
N = 100


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c, name: str | None = None):
    """Rounded to six digits, without a negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return (geo.rounded(col, 6) + 0.0).alias(name or c)


def q6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def kern(s: SparkSession, d: str, rho=0.3) -> DataFrame:
    return kernel.static(X.units(s, d), X.edges(s, d), 1.0, rho, 0.5)


# ------------------------------------------------------------------ telemetry


@query(X.with_sql("det", body="SELECT tagid, CAST(tag AS INT) AS tag, s_idx, epoch_us(ts) AS us FROM det"))
def detections(s, d):
    return X.detections(s, d).select("tagid", "tag", "s_idx", F.unix_micros("ts").alias("us"))


@query(X.with_sql("pairs", body="SELECT tagid, CAST(tag AS INT) AS tag, release, recapture, k FROM pairs"))
def pairs(s, d):
    return X.pairs(s, d).select("tagid", "tag", "release", "recapture", "k")


@query(X.with_sql("det", body="SELECT * FROM (SELECT tagid, lag(s_idx) OVER w AS release, s_idx AS recapture, CAST(greatest(1, round_even((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400e6, 0)) AS INT) AS k FROM det WINDOW w AS (PARTITION BY tagid ORDER BY tag)) WHERE release IS NOT NULL"))
def pairs_daily(s, d):
    return telemetry.pair_consecutive(X.detections(s, d), 86400).select("tagid", "release", "recapture", "k")


@query(X.with_sql("det", body="SELECT tagid, count(*) FILTER (tag = 0) AS releases FROM det GROUP BY tagid HAVING releases <> 1 OR min(ts) FILTER (tag > 0) <= max(ts) FILTER (tag = 0)"))
def validate_telemetry(s, d):
    return telemetry.telemetry_faults(X.detections(s, d)).select("tagid", "releases")


def _bucket(interval: str, expr: str) -> None:
    sql = X.with_sql("det", body=f", b AS (SELECT tagid, {expr} AS bucket, count(*) AS n, avg(value) AS value, arg_min(s_idx, struct_pack(a := ts, b := tag)) AS s_idx FROM det GROUP BY 1, 2), c AS (SELECT *, count(*) OVER (PARTITION BY tagid) AS m FROM b) SELECT tagid, bucket, n, {q6('value', 'value')}, s_idx, CAST(row_number() OVER (PARTITION BY tagid ORDER BY bucket) - 1 AS INT) AS tag FROM c WHERE m >= 2")
    query(sql, f"bucket_{interval}")(lambda s, d: telemetry.bucket_time(X.detections(s, d), interval).select("tagid", "bucket", "n", r6("value"), "s_idx", "tag"))


_bucket("daily", "CAST(ts AS DATE)")
_bucket("weekly", "CAST(date_trunc('week', ts) AS DATE)")
_bucket("biweekly", "DATE '1990-01-01' + CAST(14 * (date_diff('day', DATE '1990-01-01', CAST(ts AS DATE)) // 14) AS INT)")
_bucket("monthly", "CAST(date_trunc('month', ts) AS DATE)")

# least() ignores nulls here, so a missing point is asked for first
_HAV = "CASE WHEN {a} IS NOT NULL THEN 2 * 6378137.0 * atan2(sqrt(least(1.0, {a})), sqrt(1 - least(1.0, {a}))) END"


def hav(lon1, lat1, lon2, lat2) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return _HAV.format(a=a)


def located(s, d) -> DataFrame:
    return X.detections(s, d).join(X.units(s, d).select("s_idx", "lon", "lat", "x", "y"), "s_idx")


_LOC = ", loc AS (SELECT det.*, u.lon, u.lat, u.x, u.y FROM det JOIN units u ON u.s_idx = det.s_idx)"


@query(X.with_sql("det", "units", body=f"{_LOC}, l AS (SELECT *, last_value(lon) OVER w AS ll, last_value(lat) OVER w AS la, last_value(ts) OVER w AS lt FROM loc WINDOW w AS (PARTITION BY tagid ORDER BY ts, tag ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), f AS (SELECT tagid, tag, max({hav('lon', 'lat', 'll', 'la')}) OVER (PARTITION BY tagid ORDER BY ts, tag ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= 20000 AS inside, (epoch_us(lt) - epoch_us(ts)) / 86400e6 AS left_days FROM l) SELECT tagid, CAST(tag AS INT) AS tag, inside AND coalesce(max(left_days) FILTER (inside) OVER (PARTITION BY tagid), -1) >= 0.5 AS is_dead FROM f"))
def dead_tags(s, d):
    return telemetry.flag_dead(located(s, d), days=0.5, metres=20000.0).select("tagid", "tag", "is_dead")


@query(X.with_sql("det", "units", body=f"{_LOC}, m AS (SELECT *, lag(lon) OVER w AS o1, lag(lat) OVER w AS a1 FROM loc WINDOW w AS (PARTITION BY tagid ORDER BY ts, tag)) SELECT tagid, count(*) AS n, {q6('(max(epoch_us(ts)) - min(epoch_us(ts))) / 86400e6', 'days')}, round(coalesce(sum({hav('o1', 'a1', 'lon', 'lat')}), 0.0), 3) + 0.0 AS metres, {q6('arg_max(value, struct_pack(a := ts, b := tag)) - arg_min(value, struct_pack(a := ts, b := tag))', 'growth')} FROM m GROUP BY tagid"))
def tag_summary(s, d):
    t = telemetry.summarize_tags(located(s, d))
    return t.select("tagid", "n", r6("days"), (geo.rounded("metres", 3) + 0.0).alias("metres"), r6("growth"))


@query("WITH c AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS sex, CASE c_mktsegment WHEN 'BUILDING' THEN 'immature' WHEN 'MACHINERY' THEN NULL ELSE 'mature' END AS mat FROM customer), l AS (SELECT c_custkey, CASE WHEN mat = 'immature' THEN 'immature' WHEN mat = 'mature' AND sex = 'M' THEN 'male' WHEN mat = 'mature' AND sex = 'F' THEN 'female' ELSE 'unknown' END AS label FROM c) SELECT c_custkey, label, CAST(dense_rank() OVER (ORDER BY label) AS INT) AS \"group\" FROM l")
def group_label(s, d):
    m, seg = F.col("c_nationkey") % 3, F.col("c_mktsegment")
    sex, mat = F.when(m == 0, "M").when(m == 1, "F"), F.when(seg == "BUILDING", "immature").when(seg != "MACHINERY", "mature")
    return telemetry.group_ids(X.table(s, d, "customer").select("c_custkey", telemetry.group_label(sex, mat).alias("label")))


@query(X.with_sql("det", "units", body=", mo AS (SELECT s_idx, 2023 AS year, CAST(m AS INT) AS month, hsi * m / 12 AS h FROM units, range(1, 13) t(m) WHERE s_idx % 3 <> 0) SELECT tagid, CAST(tag AS INT) AS tag, round(coalesce(mo.h, u.hsi, 0.5), 6) + 0.0 AS hsi FROM det LEFT JOIN mo ON mo.s_idx = det.s_idx AND mo.year = greatest(2023, least(2023, year(ts))) AND mo.month = month(ts) LEFT JOIN units u ON u.s_idx = det.s_idx"))
def hsi_lookup_clamped(s, d):
    u = X.units(s, d)
    m = u.where("s_idx % 3 <> 0").select("s_idx", F.lit(2023).alias("year"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), "hsi").withColumn("hsi", F.col("hsi") * F.col("month") / 12)
    return telemetry.hsi_at_month(X.detections(s, d), m, u.select("s_idx", "hsi")).select("tagid", "tag", r6("hsi"))


# ------------------------------------------------------------------ scalars


@query(X.with_sql("units", "edges", body=f"SELECT src, dst, round({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 3) + 0.0 AS metres FROM edges JOIN units a ON a.s_idx = src JOIN units b ON b.s_idx = dst"))
def haversine(s, d):
    e = _ends(s, d)
    return e.select("src", "dst", (geo.rounded(geo.haversine_m("lon1", "lat1", "lon2", "lat2"), 3) + 0.0).alias("metres"))


def _ends(s, d) -> DataFrame:
    u = X.units(s, d)
    at = lambda n, k: u.select(F.col("s_idx").alias(n), F.col("lon").alias(f"lon{k}"), F.col("lat").alias(f"lat{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    return X.edges(s, d).join(at("src", 1), "src").join(at("dst", 2), "dst")


@query(X.with_sql("units", body="SELECT s_idx, round(radians(lon + 63.0) * 6371.0 * cos(radians(44.0)), 6) + 0.0 AS px, round(radians(lat - 44.0) * 6371.0, 6) + 0.0 AS py FROM units"))
def project_xy(s, d):
    x, y = geo.to_xy_km("lon", "lat", -63.0, 44.0)
    return X.units(s, d).select("s_idx", r6(x, "px"), r6(y, "py"))


_BEAR = "((degrees(atan2((b.lon - a.lon) * cos(radians(a.lat)), b.lat - a.lat)) + 360.0) % 360.0)"


@query(X.with_sql("units", "edges", body=f"SELECT src, dst, CAST(least(8, floor({_BEAR} / 45.0) + 1) AS INT) AS sector, round({_BEAR}, 4) AS bearing FROM edges JOIN units a ON a.s_idx = src JOIN units b ON b.s_idx = dst"))
def bearing_bin(s, d):
    e = _ends(s, d).withColumn("b", geo.bearing_deg("lon1", "lat1", "lon2", "lat2"))
    return e.select("src", "dst", geo.heading_bin("b", 8).alias("sector"), geo.rounded("b", 4).alias("bearing"))


@query("SELECT o_orderkey, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / CASE WHEN (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 THEN 366.0 ELSE 365.0 END, 6) AS dy FROM orders")
def decimal_year(s, d):
    return X.table(s, d, "orders").select("o_orderkey", geo.rounded(geo.decimal_year("o_orderdate"), 6).alias("dy"))


_FORM = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS VARCHAR) WHEN 3 THEN '13/02/2020' ELSE 'n/a' END"


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN DATE '2020-02-13' WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def flexible_date(s, d):
    o, day = X.table(s, d, "orders"), F.col("o_orderdate").cast("date")
    m = F.col("o_orderkey") % 5
    t = F.when(m == 0, F.date_format(day, "yyyy-MM-dd")).when(m == 1, F.date_format(day, "yyyy/MM/dd")).when(m == 2, F.datediff(day, F.lit("1970-01-01")).cast("string")).when(m == 3, "13/02/2020").otherwise("n/a")
    return o.select("o_orderkey", t.alias("t")).select("o_orderkey", geo.flexible_date("t").alias("day"))


@query("""SELECT event_id, round(least(1.0, greatest(0.0, 1 / (1 + exp(t - 5.0)) * CASE WHEN t >= 10.0 THEN 0.0 WHEN t > 5.0 THEN 0.5 * (1 + cos(pi() * (t - 5.0) / 5.0)) ELSE 1.0 END
 * exp(-0.5 * pow((z - 150.0) / 50.0, 2)) * CASE WHEN z <= 20.0 OR z >= 400.0 THEN 0.0 WHEN z < 150.0 THEN 0.5 * (1 - cos(pi() * (z - 20.0) / 130.0)) ELSE 0.5 * (1 + cos(pi() * (z - 150.0) / 250.0)) END)), 6) + 0.0 AS hsi
 FROM (SELECT event_id, (value % 12.0) AS t, (CAST(json_extract(props, '$.k') AS INT) * 4.0) AS z FROM events)""")
def habitat_suitability(s, d):
    e = X.table(s, d, "events").select("event_id", (F.col("value") % 12.0).alias("t"), (F.get_json_object("props", "$.k").cast("int") * 4.0).alias("z"))
    return e.select("event_id", r6(geo.habitat_suitability("t", "z"), "hsi"))


@query("SELECT v, d, round(least(1.0, greatest(0.0, v / (v + d + 1e-6))), 9) AS alpha, round(least(0.95, greatest(0.01, 1 / (1 + v + d + 1e-6))), 9) AS rho FROM (VALUES (0.05), (0.2), (0.5), (0.9)) a(v), (VALUES (0.01), (0.1), (0.4), (1.0)) b(d)".replace("SELECT v, d", "SELECT CAST(v AS DOUBLE) AS v, CAST(d AS DOUBLE) AS d"))
def alpha_rho_grid(s, d):
    g = s.range(1).select(F.explode(F.array(*map(F.lit, (0.05, 0.2, 0.5, 0.9)))).alias("v")).select("v", F.explode(F.array(*map(F.lit, (0.01, 0.1, 0.4, 1.0)))).alias("d"))
    a, r = geo.alpha_rho("v", "d")
    return g.select("v", "d", geo.rounded(a, 9).alias("alpha"), geo.rounded(r, 9).alias("rho"))


@query(X.with_sql("units", body=", h AS (SELECT s_idx, CASE WHEN s_idx % 7 = 0 THEN NULL ELSE hsi * 1.2 END AS v FROM units) SELECT s_idx, round(least(1.0, greatest(0.0, coalesce(v, (SELECT avg(v) FROM h)))), 6) + 0.0 AS hsi FROM h"))
def sanitise_hsi(s, d):
    bad = F.when(F.col("s_idx") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("hsi") * 1.2)
    return habitat.sanitise(X.units(s, d).select("s_idx", bad.alias("hsi"))).select("s_idx", r6("hsi"))


@query(X.with_sql("units", body="SELECT s_idx, round(1.5 * sqrt(3.0) * 100.0, 6) AS area FROM units"))
def polygon_area(s, d):
    return X.units(s, d).select("s_idx", r6(geo.ring_area(mesh.hex_ring(F.col("x"), F.col("y"), 10.0)), "area"))


_RINGS = [(1, 1, -5.0, -5.0), (1, 2, 60.0, -5.0), (1, 3, 75.0, 50.0), (1, 4, 20.0, 65.0), (2, 1, 80.0, 40.0), (2, 2, 160.0, 45.0), (2, 3, 120.0, 140.0)]
_RINGS_SQL = "rings AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {c!r}, {e!r})" for a, b, c, e in _RINGS) + ") t(region, seq, x, y)), segs AS (SELECT region, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM rings WINDOW w AS (PARTITION BY region ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), inside AS (SELECT s_idx, segs.region FROM units, segs WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0) GROUP BY 1, 2 HAVING count(*) % 2 = 1)"


def rings(s) -> DataFrame:
    return s.createDataFrame(_RINGS, "region int, seq int, x double, y double")


@query(X.with_sql("units", body=f", {_RINGS_SQL} SELECT s_idx, CAST(region AS INT) AS region FROM inside"))
def point_in_polygon(s, d):
    return mesh.in_polygons(X.units(s, d), rings(s)).select("s_idx", "region")


@query(X.with_sql("units", body=f", {_RINGS_SQL} SELECT units.s_idx, CAST(coalesce(min(inside.region), 0) AS INT) AS region FROM units LEFT JOIN inside USING (s_idx) GROUP BY 1"))
def region_map(s, d):
    return mesh.region_map(X.units(s, d), rings(s))


@query(X.with_sql("units", body="SELECT s_idx, round(coalesce((lead(hsi) OVER c - lag(hsi) OVER c) / 2, 0.0), 6) + 0.0 AS vx, round(coalesce((lead(hsi) OVER r - lag(hsi) OVER r) / 2, 0.0), 6) + 0.0 AS vy FROM units WINDOW c AS (PARTITION BY row ORDER BY col), r AS (PARTITION BY col ORDER BY row)"))
def velocity_field(s, d):
    from pyspark.sql import Window

    c, r = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    g = lambda w: F.coalesce((F.lead("hsi").over(w) - F.lag("hsi").over(w)) / 2, F.lit(0.0))
    return X.units(s, d).select("s_idx", r6(g(c), "vx"), r6(g(r), "vy"))


# ------------------------------------------------------------------ mesh


@query(X.with_sql("units", body=f"SELECT s_idx, row, col, {q6('x', 'x')}, {q6('y', 'y')}, {q6('hsi', 'hsi')}, is_land, CAST(region AS INT) AS region FROM units"))
def hex_units(s, d):
    return X.units(s, d).select("s_idx", "row", "col", r6("x"), r6("y"), r6("hsi"), "is_land", "region")


@query(X.with_sql("units", "edges", body="SELECT src, dst FROM edges"))
def hex_edges(s, d):
    return X.edges(s, d).select("src", "dst")


@query(X.with_sql("units", body=f"SELECT a.s_idx AS src, b.s_idx AS dst FROM units a JOIN units b ON a.s_idx <> b.s_idx AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= sqrt(3.0) * 10.0 * 1.05"))
def edges_within(s, d):
    return mesh.edges_within(X.units(s, d), mesh.SQRT3 * 10.0 * 1.05).select("src", "dst")


@query(X.with_sql("units", "edges", body=", n AS (SELECT s_idx AS old_idx, CAST(row_number() OVER (ORDER BY s_idx) AS INT) AS s_idx FROM units WHERE NOT is_land) SELECT a.s_idx AS src, b.s_idx AS dst FROM edges JOIN n a ON a.old_idx = src JOIN n b ON b.old_idx = dst"))
def prune_reindex(s, d):
    return mesh.prune(X.units(s, d), X.edges(s, d), ~F.col("is_land"))[1].select("src", "dst")


@query(X.with_sql("units", "edges", body="SELECT src, dst FROM edges WHERE src NOT IN (SELECT s_idx FROM units WHERE is_land) AND dst NOT IN (SELECT s_idx FROM units WHERE is_land)"))
def land_barrier(s, d):
    return mesh.land_barrier(X.units(s, d), X.edges(s, d))[1].select("src", "dst")


_T = "((b{0}x - a{0}x) * (c{0}y - a{0}y) - (b{0}y - a{0}y) * (c{0}x - a{0}x))"


def _turn(a, b, c) -> str:
    (ax, ay), (bx, by), (cx, cy) = a, b, c
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


_P, _Q, _V, _W = ("a.x", "a.y"), ("b.x", "b.y"), ("x1", "y1"), ("x2", "y2")


@query(X.with_sql("units", "edges", body=f", {_RINGS_SQL}, mid AS (SELECT src, dst, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y FROM edges JOIN units a ON a.s_idx = src JOIN units b ON b.s_idx = dst), gone AS (SELECT src, dst FROM (SELECT src, dst, region FROM mid, segs WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1) UNION SELECT src, dst FROM edges JOIN units a ON a.s_idx = src JOIN units b ON b.s_idx = dst, segs WHERE {_turn(_P, _Q, _V)} * {_turn(_P, _Q, _W)} < 0 AND {_turn(_V, _W, _P)} * {_turn(_V, _W, _Q)} < 0) SELECT src, dst FROM edges WHERE (src, dst) NOT IN (SELECT (src, dst) FROM gone)"))
def sever_crossing_edges(s, d):
    return mesh.sever_crossing(X.edges(s, d), X.units(s, d), rings(s)).select("src", "dst")


@query(X.with_sql("units", "edges", body=", o AS (SELECT s_idx FROM units WHERE is_land), n AS (SELECT dst AS t, src AS n, w FROM edges WHERE dst IN (SELECT s_idx FROM o) AND src NOT IN (SELECT s_idx FROM o)), p AS (SELECT a.n AS src, b.n AS dst, l.w FROM n a JOIN n b ON a.t = b.t AND a.n < b.n JOIN (SELECT t, min(w) AS w FROM n GROUP BY t) l ON l.t = a.t WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = a.n AND e.dst = b.n)), q AS (SELECT src, dst, sum(w) AS w FROM p GROUP BY 1, 2) SELECT src, dst, w FROM q UNION ALL SELECT dst, src, w FROM q"))
def bridge_edges(s, d):
    return mesh.bridge_basins(X.edges(s, d), X.units(s, d).where("is_land").select("s_idx"))


@query(X.with_sql("units", "edges", recursive=True, body=", g AS (SELECT src, dst FROM edges WHERE src % 10 <> 5 AND dst % 10 <> 5), r AS (SELECT s_idx, s_idx AS reach FROM units UNION SELECT r.s_idx, g.dst FROM r JOIN g ON g.src = r.reach) SELECT s_idx, CAST(min(reach) AS INT) AS component FROM r GROUP BY s_idx"))
def connected_components(s, d):
    return mesh.components(X.units(s, d), X.edges(s, d).where("src % 10 <> 5 AND dst % 10 <> 5"))


@query(X.with_sql("units", "edges", recursive=True, body=", r AS (SELECT 1 AS s_idx, 0 AS hops UNION SELECT dst, hops + 1 FROM r JOIN edges ON src = s_idx WHERE hops < 8) SELECT CAST(s_idx AS INT) AS s_idx, CAST(min(hops) AS INT) AS hops FROM r GROUP BY s_idx"))
def bfs_hops(s, d):
    return mesh.hops(X.edges(s, d), 1, 8)


@query(X.with_sql("units", body="SELECT round(least(min(lon) - 0.25, -65.48), 6) AS west, round(least(min(lat) - 0.25, 43.04), 6) AS south, round(greatest(max(lon) + 0.25, -57.32), 6) AS east, round(greatest(max(lat) + 0.25, 47.27), 6) AS north FROM units"))
def bbox_union(s, d):
    return mesh.bbox_union(X.units(s, d), 0.25, (-65.48, 43.04, -57.32, 47.27)).select(*[geo.rounded(c, 6).alias(c) for c in ("west", "south", "east", "north")])


@query(X.with_sql("units", body=f", e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(x) AS cx, avg(y) AS cy, sqrt(3.0) * 7.0 AS dx, 10.5 AS dy FROM units), c AS (SELECT r, cx + dx * c + CASE WHEN r % 2 <> 0 THEN dx / 2 ELSE 0.0 END AS x, cy + dy * r AS y FROM e, range(-100, 101) t(r), range(-100, 101) u(c) WHERE r BETWEEN floor((y0 - 7.0 - cy) / dy) AND ceil((y1 + 7.0 - cy) / dy) AND c BETWEEN floor((x0 - 7.0 - cx) / dx) AND ceil((x1 + 7.0 - cx) / dx)) SELECT CAST(row_number() OVER (ORDER BY y, x) AS INT) AS s_idx, {q6('x', 'x')}, {q6('y', 'y')} FROM c"))
def hex_cover(s, d):
    return mesh.hex_cover(s, X.units(s, d), 7.0).select("s_idx", r6("x"), r6("y"))


@query(X.with_sql("units", body=f", {_RINGS_SQL}, cor AS (SELECT s_idx, n, x + 10.0 * cos(radians(30 + 60 * n)) AS px, y + 10.0 * sin(radians(30 + 60 * n)) AS py FROM units, range(6) t(n)), inc AS (SELECT s_idx, n FROM cor, segs WHERE (y1 > py) <> (y2 > py) AND px < x1 + (py - y1) * (x2 - x1) / nullif(y2 - y1, 0) GROUP BY s_idx, n, segs.region HAVING count(*) % 2 = 1), sh AS (SELECT s_idx, count(DISTINCT n) AS c FROM inc GROUP BY 1) SELECT units.s_idx, (units.s_idx IN (SELECT s_idx FROM inside) OR coalesce(c, 0) >= 3) AS is_land FROM units LEFT JOIN sh ON sh.s_idx = units.s_idx"))
def land_units(s, d):
    return mesh.land_units(X.units(s, d), rings(s)).select("s_idx", "is_land")


# ------------------------------------------------------------------ joins and resampling


def _points(s, d) -> DataFrame:
    return X.table(s, d, "events").select(F.col("event_id").alias("id"), (F.pmod(F.col("event_id") * 37, F.lit(1800)) / 10.0).alias("x"), (F.pmod(F.col("event_id") * 91, F.lit(1400)) / 10.0).alias("y"))


@query(X.with_sql("units", body=", p AS (SELECT event_id AS id, ((event_id * 37) % 1800) / 10.0 AS x, ((event_id * 91) % 1400) / 10.0 AS y FROM events), d AS (SELECT p.id, u.s_idx, sqrt(pow(p.x - u.x, 2) + pow(p.y - u.y, 2)) AS d FROM p, units u WHERE NOT u.is_land) SELECT id, round(min(d), 6) + 0.0 AS distance FROM d GROUP BY id"))
def nn_snap(s, d):
    return resample.snap(_points(s, d), X.units(s, d), 10.5).select("id", r6("distance"))


_COARSE = "coarse AS (SELECT s_idx + 1000 AS t, x + 3.3 AS tx, y + 1.7 AS ty FROM units WHERE s_idx % 4 = 0)"
_KNN = f", {_COARSE}, dd AS (SELECT t, s_idx, sqrt(pow(tx - x, 2) + pow(ty - y, 2)) AS d FROM coarse, units), k4 AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d, s_idx) AS r FROM dd QUALIFY r <= 4), wt AS (SELECT t AS target, s_idx AS source, (1 / (d * d)) / sum(1 / (d * d)) OVER (PARTITION BY t) AS w FROM k4)"


def _coarse(s, d) -> DataFrame:
    return X.units(s, d).where("s_idx % 4 = 0").select((F.col("s_idx") + 1000).alias("s_idx"), (F.col("x") + 3.3).alias("x"), (F.col("y") + 1.7).alias("y"))


@query(X.with_sql("units", body=f"{_KNN} SELECT target, source, round(w, 6) + 0.0 AS w FROM wt"))
def knn_idw_transfer(s, d):
    return resample.knn_weights(_coarse(s, d), X.units(s, d)).select("target", "source", r6("w"))


@query(X.with_sql("units", body=f"{_KNN} SELECT target AS s_idx, round(sum(w * hsi), 6) + 0.0 AS hsi, round(sqrt(sum(w * 0.01 * y * y)), 6) + 0.0 AS sd FROM wt JOIN units ON s_idx = source GROUP BY target"))
def reshard_field(s, d):
    f = X.units(s, d).select("s_idx", "hsi", (0.1 * F.col("y")).alias("sd"))
    return resample.reshard(f, resample.knn_weights(_coarse(s, d), X.units(s, d)), ("hsi",), ("sd",)).select("s_idx", r6("hsi"), r6("sd"))


@query(X.with_sql("det", body="SELECT s_idx, round(avg(value), 6) + 0.0 AS mean, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(stddev_samp(value), 6) + 0.0 AS sd, round(quantile_cont(value, 0.025), 6) + 0.0 AS lower, round(quantile_cont(value, 0.975), 6) + 0.0 AS upper FROM det GROUP BY s_idx"))
def summarize_samples(s, d):
    return resample.summarize_samples(X.detections(s, d)).select("s_idx", *[r6(c) for c in ("mean", "median", "sd", "lower", "upper")])


@query(X.with_sql("pairs", "units", body=", m AS (SELECT a.s_idx AS old, arg_min(b.s_idx, struct_pack(d := round(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2), 9), s := b.s_idx)) AS nw FROM units a, units b WHERE a.is_land AND NOT b.is_land GROUP BY 1) SELECT coalesce(m.nw, release) AS release, coalesce(m2.nw, recapture) AS recapture, count(*) AS n FROM pairs LEFT JOIN m ON m.old = release LEFT JOIN m m2 ON m2.old = recapture GROUP BY 1, 2"))
def snap_pruned_endpoints(s, d):
    u = X.units(s, d).withColumn("lon", F.col("lon"))
    return resample.snap_pruned(X.pairs(s, d), u, "NOT is_land").groupBy("release", "recapture").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ habitat


def _yearly(s, d) -> DataFrame:
    return X.units(s, d).select("s_idx", F.explode(F.array(F.lit(2020), F.lit(2021), F.lit(2022))).alias("year"), "hsi").withColumn("hsi", F.col("hsi") * (1 + 0.05 * (F.col("year") - 2020)))


@query(X.with_sql("units", body=", y AS (SELECT s_idx, CAST(yr AS INT) AS year, hsi * (1 + 0.05 * (yr - 2020)) AS h1 FROM units, range(2020, 2023) t(yr)), z AS (SELECT *, coalesce(lead(h1) OVER w, h1) AS h2, coalesce(lag(h1) OVER w, h1) AS h0 FROM y WINDOW w AS (PARTITION BY s_idx ORDER BY year)), q AS (SELECT *, (dayofyear(make_date(CAST(year AS BIGINT), m, 15)) - 244) / 365.25 AS u FROM z, range(1, 13) t(m)) SELECT s_idx, year, CAST(m AS INT) AS month, round(least(1.0, greatest(0.0, CASE WHEN u >= 0 THEN h1 + u * (h2 - h1) ELSE h1 - u * (h0 - h1) END)), 6) + 0.0 AS hsi FROM q"))
def hsi_monthly_interp(s, d):
    return habitat.monthly(_yearly(s, d)).select("s_idx", "year", "month", r6("hsi"))


@query(X.with_sql("units", "edges", body=", n AS (SELECT src, sum(w * hsi) / sum(w) AS m FROM edges JOIN units ON s_idx = dst GROUP BY src) SELECT s_idx, round(coalesce(hsi - m, 0.0), 6) + 0.0 AS difference, round(coalesce(hsi / m - 1, 0.0), 6) + 0.0 AS ratio, round(coalesce(ln(hsi / m), 0.0), 6) + 0.0 AS log_ratio FROM units LEFT JOIN n ON src = s_idx"))
def hsi_advantage(s, d):
    u, e = X.units(s, d), X.edges(s, d)
    out = None
    for form in ("difference", "ratio", "log_ratio"):
        a = habitat.advantage(u, e, form).select("s_idx", r6("advantage", form))
        out = a if out is None else out.join(a, "s_idx")
    return out


@query(X.with_sql("units", "edges", body=", n AS (SELECT s_idx, hsi - m AS a FROM (SELECT src, sum(w * hsi) / sum(w) AS m FROM edges JOIN units ON s_idx = dst GROUP BY src) JOIN units ON src = s_idx) SELECT s_idx, round(least(0.999, greatest(0.0, 0.3 + 0.5 * a)), 6) AS plain, round(least(0.999, greatest(0.0, 1 / (1 + exp(-(ln(0.3 / 0.7) + 0.5 * a))))), 6) AS logit FROM n"))
def residency(s, d):
    a = habitat.advantage(X.units(s, d), X.edges(s, d))
    return a.select("s_idx", geo.rounded(habitat.residency(0.3, F.col("advantage"), 0.5), 6).alias("plain"), geo.rounded(habitat.residency(0.3, F.col("advantage"), 0.5, "exp_difference"), 6).alias("logit"))


@query()
def hsi_infill(s, d):
    return habitat.infill(X.units(s, d), X.edges(s, d), "s_idx % 3 = 0").select("s_idx", r6("hsi"))


# ------------------------------------------------------------------ kernels


@query(X.with_sql("kernel", body=f"SELECT src, dst, {q6('p', 'p')} FROM kernel"))
def kernel_static(s, d):
    return kern(s, d).select("src", "dst", r6("p"))


@query(X.with_sql("kernel", body="SELECT src, round(sum(p), 9) AS total, count(*) AS n FROM kernel GROUP BY src"))
def kernel_rowsum_check(s, d):
    return kernel.row_sums(kern(s, d)).select("src", geo.rounded("total", 9).alias("total"), "n")


@query(X.with_sql("units", "edges", body=", st AS (SELECT CAST(step AS INT) AS step, s_idx, hsi * (1 + 0.1 * step) AS h, is_land FROM units, range(1, 4) t(step)), e AS (SELECT a.step, src, dst, w, w * exp(greatest(-25.0, least(25.0, b.h - a.h))) AS t FROM edges JOIN st a ON a.s_idx = src AND NOT a.is_land JOIN st b ON b.s_idx = dst AND b.step = a.step AND NOT b.is_land), m AS (SELECT step, src, dst, 0.7 * (0.5 * t / sum(t) OVER z + 0.5 * w / sum(w) OVER z) AS p FROM e WINDOW z AS (PARTITION BY step, src)) SELECT step, src, dst, round(p, 6) + 0.0 AS p FROM m UNION ALL SELECT st.step, s_idx, s_idx, round(1 - coalesce(o, 0.0), 6) + 0.0 FROM st LEFT JOIN (SELECT step, src, sum(p) AS o FROM m GROUP BY 1, 2) x ON x.step = st.step AND x.src = s_idx"))
def kernel_dynamic(s, d):
    u = X.units(s, d).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("hsi", F.col("hsi") * (1 + 0.1 * F.col("step")))
    return kernel.static(u, X.edges(s, d), 1.0, 0.3, 0.5, ("step",)).select("step", "src", "dst", r6("p"))


@query(X.with_sql("units", "edges", body=", v AS (SELECT src, dst, (exp(hsi) + 0.1) * w AS v FROM edges JOIN units ON s_idx = dst UNION ALL SELECT s_idx, s_idx, exp(hsi) FROM units) SELECT src, dst, round(v / sum(v) OVER (PARTITION BY src), 6) + 0.0 AS p FROM v"))
def kernel_suitability(s, d):
    return kernel.suitability(X.units(s, d), X.edges(s, d)).select("src", "dst", r6("p"))


@query(X.with_sql("units", "edges", body="SELECT src, dst, round(exp(hsi) / sum(exp(hsi)) OVER (PARTITION BY src), 6) + 0.0 AS p FROM edges JOIN units ON s_idx = dst"))
def kernel_directed(s, d):
    return kernel.directed(X.units(s, d), X.edges(s, d)).select("src", "dst", r6("p"))


_PERS = ", k0 AS (SELECT src, dst, p, CASE WHEN src = dst THEN NULL ELSE (degrees(atan2((b.lon - a.lon) * cos(radians(a.lat)), b.lat - a.lat)) + 360.0) % 360.0 END AS b FROM kernel JOIN units a ON a.s_idx = src JOIN units b ON b.s_idx = dst), k1 AS (SELECT src, CAST(h AS INT) AS h_src, dst, CASE WHEN src = dst THEN CAST(h AS INT) ELSE CAST(least(6, floor(b / 60.0) + 1) AS INT) END AS h_dst, p * CASE WHEN src = dst THEN exp(1.0) ELSE exp(cos(radians(b - (h - 1) * 60.0))) END AS v FROM k0, range(1, 7) t(h)), k2 AS (SELECT src, h_src, dst, h_dst, v / sum(v) OVER (PARTITION BY src, h_src) AS p FROM k1)"


@query(X.with_sql("kernel", body=f"{_PERS} SELECT src, h_src, dst, h_dst, round(p, 6) + 0.0 AS p FROM k2"))
def kernel_persistent(s, d):
    return kernel.persistent(kern(s, d), X.units(s, d)).select("src", "h_src", "dst", "h_dst", r6("p"))


@query(X.with_sql("kernel", body=f"{_PERS} SELECT src, dst, round(sum(p) / 6, 6) + 0.0 AS p FROM k2 GROUP BY 1, 2"))
def persistent_marginal(s, d):
    return kernel.unit_marginal(kernel.persistent(kern(s, d), X.units(s, d)), 6).select("src", "dst", r6("p"))


@query()
def kernel_resolvent(s, d):
    return markov.resolvent(kern(s, d), N).select("src", "dst", r6("p"))


@query(X.with_sql("kernel", body=", k2 AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM kernel a JOIN kernel b ON b.src = a.dst GROUP BY 1, 2), k3 AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM kernel a JOIN k2 b ON b.src = a.dst GROUP BY 1, 2) SELECT src, dst, round(p / sum(p) OVER (PARTITION BY src), 6) + 0.0 AS p FROM k3"))
def kernel_power(s, d):
    return markov.power(kern(s, d), 3).select("src", "dst", r6("p"))


# ------------------------------------------------------------------ propagation and inference

_SWEEP = ", rel AS (SELECT DISTINCT release FROM pairs), sw AS (SELECT release, release AS node, CAST(1 AS DOUBLE) AS p, 0 AS step FROM rel UNION ALL SELECT s.release, k.dst, sum(s.p * k.p), s.step + 1 FROM sw s JOIN kernel k ON k.src = s.node WHERE s.step < 24 GROUP BY s.release, k.dst, s.step + 1), obs AS (SELECT release, recapture, k, count(*) AS n FROM pairs GROUP BY 1, 2, 3), pr AS (SELECT o.release, o.recapture, o.k, n, coalesce(p, 0.0) AS p FROM obs o LEFT JOIN sw ON sw.release = o.release AND sw.node = o.recapture AND sw.step = o.k)"


@query(X.with_sql("pairs", "kernel", recursive=True, body=f"{_SWEEP} SELECT release, recapture, k, n, round(p, 6) + 0.0 AS p FROM pr"))
def kstep_prob(s, d):
    return markov.kstep(X.pairs(s, d), kern(s, d), N).select("release", "recapture", "k", "n", r6("p"))


@query(X.with_sql("pairs", "kernel", recursive=True, body=f"{_SWEEP} SELECT CAST(sum(n) AS BIGINT) AS n_pairs, CAST(coalesce(sum(n) FILTER (p > 0), 0) AS BIGINT) AS n_reachable, round(sum(n * ln(p)) FILTER (p > 0), 4) AS loglik FROM pr"))
def loglik(s, d):
    r = markov.log_likelihood(markov.kstep(X.pairs(s, d), kern(s, d), N))
    return r.select("n_pairs", F.col("n_reachable").cast("long").alias("n_reachable"), geo.rounded("loglik", 4).alias("loglik"))


@query(X.with_sql("kernel", body=", m AS (SELECT CAST(a.region AS INT) AS from_region, CAST(b.region AS INT) AS to_region, sum(p) AS m FROM kernel JOIN units a ON a.s_idx = src JOIN units b ON b.s_idx = dst GROUP BY 1, 2) SELECT from_region, to_region, round(m / sum(m) OVER (PARTITION BY from_region), 6) + 0.0 AS p FROM m"))
def regional_connectivity(s, d):
    return markov.regional(kern(s, d), X.units(s, d)).select("from_region", "to_region", r6("p"))


@query(X.with_sql("pairs", "kernel", body=", f AS (SELECT CAST(a.region AS INT) AS from_region, CAST(b.region AS INT) AS to_region, count(*) AS n, avg(k) AS mean_k, avg(coalesce(p, 0.0)) AS mean_p FROM pairs JOIN units a ON a.s_idx = release JOIN units b ON b.s_idx = recapture LEFT JOIN kernel ON src = release AND dst = recapture GROUP BY 1, 2) SELECT from_region, to_region, n, round(mean_k, 6) AS mean_k, round(mean_p, 6) + 0.0 AS mean_p FROM f"))
def region_flow(s, d):
    """Flow between regions with mean steps and mean one-step probability."""
    # the events are counted by (release, recapture, k) before anything is joined to them
    obs = X.pairs(s, d).groupBy("release", "recapture").agg(F.count("*").alias("c"), F.sum("k").alias("ks"))
    u = X.units(s, d)
    p = obs.join(kern(s, d).toDF("release", "recapture", "p"), ["release", "recapture"], "left")
    p = p.join(u.select(F.col("s_idx").alias("release"), F.col("region").alias("from_region")), "release").join(u.select(F.col("s_idx").alias("recapture"), F.col("region").alias("to_region")), "recapture")
    g = p.groupBy("from_region", "to_region").agg(F.sum("c").alias("n"), F.sum("ks").alias("ks"), F.sum(F.col("c") * F.coalesce("p", F.lit(0.0))).alias("ps"))
    return g.select("from_region", "to_region", "n", geo.rounded(F.col("ks") / F.col("n"), 6).alias("mean_k"), r6(F.col("ps") / F.col("n"), "mean_p"))


@query(X.with_sql("units", body=", st AS (SELECT s_idx, CAST(region + 1 AS INT) AS region FROM units), z AS (SELECT region, count(*) AS c FROM st GROUP BY 1)" + ", me AS (SELECT a.s_idx AS src, b.s_idx AS dst FROM units a JOIN units b ON a.row = b.row AND abs(a.col - b.col) = 1), ke AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS p FROM me), m AS (SELECT a.region AS from_region, b.region AS to_region, sum(p) / (any_value(z1.c) * any_value(z2.c)) AS m FROM ke JOIN st a ON a.s_idx = src JOIN st b ON b.s_idx = dst JOIN z z1 ON z1.region = a.region JOIN z z2 ON z2.region = b.region GROUP BY 1, 2) SELECT from_region, to_region, round(m / sum(m) OVER (PARTITION BY from_region), 6) + 0.0 AS p FROM m"))
def stock_connectivity(s, d):
    from pyspark.sql import Window

    u = X.units(s, d)
    a, b = u.select(F.col("s_idx").alias("src"), "row", F.col("col").alias("c1")), u.select(F.col("s_idx").alias("dst"), "row", F.col("col").alias("c2"))
    k = a.join(b, "row").where("abs(c1 - c2) = 1").select("src", "dst", (1.0 / F.count("*").over(Window.partitionBy("src"))).alias("p"))
    return markov.regional(k, u.select("s_idx", (F.col("region") + 1).alias("region")), per_unit=True).select("from_region", "to_region", r6("p"))


def _draws(s, d) -> DataFrame:
    e = X.table(s, d, "events")
    return e.select((F.col("event_id") % 4).alias("chain"), F.floor(F.col("event_id") / 4).alias("draw"), F.col("value").alias("velocity"), (F.col("event_id") % 3 == 0).alias("accepted"))


@query("SELECT event_id % 4 AS chain, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS acceptance, count(DISTINCT round(value, 9)) AS n_distinct, (avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END) <= 0.01 OR count(DISTINCT round(value, 9)) <= 1) AS frozen FROM events GROUP BY 1")
def chain_health(s, d):
    return markov.chain_health(_draws(s, d)).select("chain", geo.rounded("acceptance", 6).alias("acceptance"), "n_distinct", "frozen")


@query()
def mh_chain(s, d):
    return markov.metropolis(X.pairs(s, d), X.units(s, d), X.edges(s, d), N, chains=2, draws=10, warmup=5).select("chain", "draw", r6("velocity"), r6("gamma"), "accepted")


# ------------------------------------------------------------------ paths, corridors, agents, circuits


def _few(s, d) -> DataFrame:
    """Distinct event transitions between marine units: the work is per distinct transition, whatever the number of events."""
    land = X.units(s, d).where("is_land").select("s_idx")
    p = X.pairs(s, d)
    p = p.join(land.toDF("release"), "release", "left_anti").join(land.toDF("recapture"), "recapture", "left_anti")
    return p.select("release", "recapture", "k").distinct()


#: The events of _few() as a table o.
_FEW_SQL = "o AS (SELECT DISTINCT release, recapture, k FROM pairs WHERE release NOT IN (SELECT s_idx FROM units WHERE is_land) AND recapture NOT IN (SELECT s_idx FROM units WHERE is_land))"

_COST = "me AS (SELECT src, dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) * (1 + 3 * pow(1 - a.hsi, 2) + 1 + 3 * pow(1 - b.hsi, 2)) / 2 AS c FROM edges JOIN units a ON a.s_idx = src AND NOT a.is_land JOIN units b ON b.s_idx = dst AND NOT b.is_land)"


@query(X.with_sql("units", "edges", recursive=True, body=f", {_COST}, r AS (SELECT s_idx AS node, CAST(0 AS DOUBLE) AS cost, 0 AS i FROM units WHERE s_idx = 2 UNION ALL (SELECT node, min(cost), any_value(i) + 1 FROM (SELECT node, cost, i FROM r UNION ALL SELECT dst, cost + c, i FROM r JOIN me ON src = node) WHERE i < 40 GROUP BY node)) SELECT CAST(node AS INT) AS recapture, round(min(cost), 6) + 0.0 AS cost FROM r GROUP BY node"))
def least_cost_distance(s, d):
    u = X.units(s, d)
    e = u.select(F.lit(2).alias("release"), F.col("s_idx").alias("recapture"))
    return markov.paths(e, markov.least_cost(u, X.edges(s, d)), N).where("cost < double('infinity')").select("recapture", r6("cost"))


@query()
def astar_paths(s, d):
    return markov.paths(_few(s, d), markov.least_cost(X.units(s, d), X.edges(s, d)), N).select("release", "recapture", r6("cost"), "hops")


@query(X.with_sql("pairs", "kernel", recursive=True, body=", rel AS (SELECT DISTINCT release FROM pairs WHERE release NOT IN (SELECT s_idx FROM units WHERE is_land)), v AS (SELECT release, release AS node, CAST(0 AS DOUBLE) AS s, 0 AS step FROM rel UNION ALL SELECT v.release, k.dst, max(v.s + ln(k.p)), v.step + 1 FROM v JOIN kernel k ON k.src = v.node AND k.p > 1e-12 WHERE v.step < 24 GROUP BY v.release, k.dst, v.step + 1), o AS (SELECT DISTINCT release, recapture, k FROM pairs WHERE release NOT IN (SELECT s_idx FROM units WHERE is_land) AND recapture NOT IN (SELECT s_idx FROM units WHERE is_land)) SELECT o.release, o.recapture, o.k, round(v.s, 6) + 0.0 AS logp FROM o JOIN v ON v.release = o.release AND v.node = o.recapture AND v.step = o.k"))
def exact_k_path_cost(s, d):
    return markov.exact_walks(_few(s, d), kern(s, d), N).where("logp IS NOT NULL AND NOT isnan(logp)").select("release", "recapture", "k", r6("logp"))


@query(X.with_sql("pairs", "units", "edges", recursive=True, body=f", {_COST}, {_FEW_SQL}, r AS (SELECT DISTINCT release, release AS node, CAST(0 AS DOUBLE) AS cost, 0 AS i FROM o UNION ALL (SELECT release, node, min(cost), any_value(i) + 1 FROM (SELECT release, node, cost, i FROM r UNION ALL SELECT release, dst, cost + c, i FROM r JOIN me ON src = node) WHERE i < 40 GROUP BY release, node)), b AS (SELECT release, node, min(cost) AS cost FROM r GROUP BY 1, 2) SELECT DISTINCT o.release, o.recapture, round(b.cost, 6) + 0.0 AS cost FROM o JOIN b ON b.release = o.release AND b.node = o.recapture"))
def astar_cost(s, d):
    p = markov.paths(_few(s, d), markov.least_cost(X.units(s, d), X.edges(s, d)), N)
    return p.where("cost < double('infinity')").select("release", "recapture", r6("cost"))


def _changing(s, d) -> DataFrame:
    """Units at three steps: the habitat grows by a tenth each."""
    return X.units(s, d).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("hsi", F.col("hsi") * (1 + 0.1 * F.col("step")))


_KDYN = "st AS (SELECT CAST(step AS INT) AS step, s_idx, hsi * (1 + 0.1 * step) AS h, is_land FROM units, range(1, 4) t(step)), ed AS (SELECT a.step, src, dst, w, w * exp(greatest(-25.0, least(25.0, b.h - a.h))) AS t FROM edges JOIN st a ON a.s_idx = src AND NOT a.is_land JOIN st b ON b.s_idx = dst AND b.step = a.step AND NOT b.is_land), md AS (SELECT step, src, dst, 0.7 * (0.5 * t / sum(t) OVER z + 0.5 * w / sum(w) OVER z) AS p FROM ed WINDOW z AS (PARTITION BY step, src)), kd AS (SELECT step, src, dst, p FROM md UNION ALL SELECT st.step, s_idx, s_idx, 1 - coalesce(o, 0.0) FROM st LEFT JOIN (SELECT step, src, sum(p) AS o FROM md GROUP BY 1, 2) x ON x.step = st.step AND x.src = s_idx)"


@query(X.with_sql("pairs", "units", "edges", recursive=True, body=f", {_KDYN}, {_FEW_SQL}, v AS (SELECT DISTINCT release, release AS node, CAST(0 AS DOUBLE) AS s, 0 AS t FROM o UNION ALL SELECT v.release, q.dst, max(v.s + ln(q.p)), v.t + 1 FROM v JOIN kd q ON q.src = v.node AND q.step = least(3, v.t + 1) AND q.p > 1e-15 WHERE v.t < 24 GROUP BY v.release, q.dst, v.t + 1), h AS (SELECT src, max(CASE WHEN step = 1 THEN ln(p) END) AS a, max(CASE WHEN step = 2 THEN ln(p) END) AS b, max(CASE WHEN step = 3 THEN ln(p) END) AS c FROM kd WHERE src = dst GROUP BY src) SELECT o.release, o.recapture, o.k, round(CASE WHEN o.release = o.recapture THEN a + CASE WHEN o.k >= 2 THEN b ELSE 0 END + greatest(0, o.k - 2) * c ELSE v.s END, 6) + 0.0 AS logp FROM o JOIN v ON v.release = o.release AND v.node = o.recapture AND v.t = o.k JOIN h ON h.src = o.release"))
def dynamic_walks(s, d):
    k = kernel.static(_changing(s, d), X.edges(s, d), 1.0, 0.3, 0.5, ("step",))
    return dynamics.dynamic_walks(_few(s, d), k, N).where("logp IS NOT NULL").select("release", "recapture", "k", r6("logp"))


@query(X.with_sql("pairs", "units", "edges", recursive=True, body=f", {_KDYN}, {_FEW_SQL}, f AS (SELECT DISTINCT release, release AS node, CAST(1 AS DOUBLE) AS p, 0 AS t FROM o UNION ALL SELECT f.release, q.dst, sum(f.p * q.p), f.t + 1 FROM f JOIN kd q ON q.src = f.node AND q.step = least(3, f.t + 1) WHERE f.t < 24 GROUP BY f.release, q.dst, f.t + 1), b AS (SELECT DISTINCT recapture AS v, k, recapture AS node, CAST(1 AS DOUBLE) AS p, k AS t FROM o UNION ALL SELECT b.v, b.k, q.src, sum(b.p * q.p), b.t - 1 FROM b JOIN kd q ON q.dst = b.node AND q.step = least(3, b.t) WHERE b.t > 0 GROUP BY b.v, b.k, q.src, b.t - 1), z AS (SELECT o.*, coalesce(f.p, 0.0) AS z FROM o LEFT JOIN f ON f.release = o.release AND f.node = o.recapture AND f.t = o.k), c AS (SELECT f.node, sum(f.p * b.p / z / (z.k + 1)) AS c FROM z JOIN f ON f.release = z.release AND f.t <= z.k JOIN b ON b.v = z.recapture AND b.k = z.k AND b.t = f.t AND b.node = f.node WHERE z > 1e-15 GROUP BY 1 UNION ALL SELECT f.node, sum(f.p / 2 / (z.k + 1)) FROM z JOIN f ON f.release = z.release AND f.t <= z.k WHERE z <= 1e-15 GROUP BY 1 UNION ALL SELECT b.node, sum(b.p / 2 / (z.k + 1)) FROM z JOIN b ON b.v = z.recapture AND b.k = z.k WHERE z <= 1e-15 GROUP BY 1) SELECT CAST(node AS INT) AS s_idx, round(sum(c), 4) AS intensity FROM c GROUP BY node"))
def dynamic_corridor(s, d):
    k = kernel.static(_changing(s, d), X.edges(s, d), 1.0, 0.3, 0.5, ("step",))
    return dynamics.dynamic_corridors(_few(s, d), k, N).groupBy("s_idx").agg(geo.rounded(F.sum("intensity"), 4).alias("intensity"))


@query(X.with_sql("pairs", "units", "edges", recursive=True, body=f", {_FEW_SQL}, ph AS (SELECT CAST(step AS INT) AS step, s_idx, x, y, 1 + 3 * pow(1 - least(1.0, hsi * (1 + 0.1 * step)), 2) AS f FROM units, range(1, 4) t(step) WHERE NOT is_land), mv AS (SELECT a.step, src, dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, (a.f + b.f) / 2 AS f FROM edges JOIN ph a ON a.s_idx = src JOIN ph b ON b.s_idx = dst AND b.step = a.step), co AS (SELECT step, src, dst, d * f AS c FROM mv UNION ALL SELECT ph.step, s_idx, s_idx, 0.5 * coalesce(n.d, 1.0) * ph.f FROM ph LEFT JOIN (SELECT step, src, min(d) AS d FROM mv GROUP BY 1, 2) n ON n.step = ph.step AND n.src = s_idx), v AS (SELECT DISTINCT release, release AS node, CAST(0 AS DOUBLE) AS cost, 0 AS t FROM o UNION ALL SELECT v.release, q.dst, min(v.cost + q.c), v.t + 1 FROM v JOIN co q ON q.src = v.node AND q.step = least(3, v.t + 1) WHERE v.t < 24 GROUP BY v.release, q.dst, v.t + 1) SELECT o.release, o.recapture, o.k, round(v.cost, 6) + 0.0 AS cost FROM o JOIN v ON v.release = o.release AND v.node = o.recapture AND v.t = o.k"))
def dynamic_paths(s, d):
    u = _changing(s, d).withColumn("hsi", F.least(F.lit(1.0), "hsi"))
    return dynamics.dynamic_paths(_few(s, d), dynamics.step_costs(u, X.edges(s, d)), N).where("cost IS NOT NULL").select("release", "recapture", "k", r6("cost"))


@query(X.with_sql("pairs", "units", "kernel", recursive=True, body=f", {_FEW_SQL}, t AS (SELECT DISTINCT recapture AS v, recapture AS node, CAST(1 AS DOUBLE) AS p, 0 AS i FROM o UNION ALL SELECT t.v, q.src, 0.9 * sum(t.p * q.p), t.i + 1 FROM t JOIN kernel q ON q.dst = t.node WHERE t.i < 600 GROUP BY t.v, q.src, t.i + 1), x AS (SELECT v, node, -ln(greatest(1e-15, sum(p))) AS volt FROM t GROUP BY 1, 2) SELECT DISTINCT o.release, o.recapture, round(a.volt - b.volt, 6) + 0.0 AS resistance FROM o JOIN x a ON a.v = o.recapture AND a.node = o.release JOIN x b ON b.v = o.recapture AND b.node = o.recapture"))
def directed_resistance(s, d):
    c = dynamics.directed_circuits(_few(s, d), kern(s, d), N, alpha=0.9)
    return c.where("resistance < double('infinity')").select("release", "recapture", r6("resistance"))


@query()
def mark_recapture_bridge_paths(s, d):
    """One sampled walk a pair between marine units, joined into tracks."""
    land = X.units(s, d).where("is_land").select("s_idx")
    p = X.pairs(s, d).join(land.toDF("release"), "release", "left_anti").join(land.toDF("recapture"), "recapture", "left_anti")
    return dynamics.reconstructed_tracks(p, dynamics.bridge_samples(p, kern(s, d), N))


@query()
def stochastic_paths(s, d):
    return markov.stochastic_paths(_few(s, d), X.units(s, d), X.edges(s, d), N, draws=5).select("release", "recapture", "s_idx", r6("visit_prob"), r6("mean_cost"))


@query(X.with_sql("kernel", recursive=True, body=", ev AS (SELECT 2 AS u, 25 AS v, 6 AS k UNION ALL SELECT 13, 45, 8), f AS (SELECT u, v, k, u AS node, CAST(1 AS DOUBLE) AS p, 0 AS t FROM ev UNION ALL SELECT f.u, f.v, f.k, q.dst, sum(f.p * q.p), f.t + 1 FROM f JOIN kernel q ON q.src = f.node WHERE f.t < f.k GROUP BY f.u, f.v, f.k, q.dst, f.t + 1), b AS (SELECT u, v, k, v AS node, CAST(1 AS DOUBLE) AS p, 0 AS t FROM ev UNION ALL SELECT b.u, b.v, b.k, q.src, sum(b.p * q.p), b.t + 1 FROM b JOIN kernel q ON q.dst = b.node WHERE b.t < b.k GROUP BY b.u, b.v, b.k, q.src, b.t + 1), c AS (SELECT f.u, f.v, f.k, f.t, f.node, f.p * b.p AS m FROM f JOIN b ON b.u = f.u AND b.v = f.v AND b.k = f.k AND b.node = f.node AND b.t = f.k - f.t), n AS (SELECT *, m / sum(m) OVER (PARTITION BY u, v, k, t) AS prob FROM c) SELECT u AS release, v AS recapture, k, t AS tau, node AS s_idx, round(prob, 6) + 0.0 AS prob FROM n WHERE prob > 1e-5"))
def corridor_bridge(s, d):
    e = s.createDataFrame([(2, 25, 6), (13, 45, 8)], "release int, recapture int, k int")
    return markov.corridors(e, kern(s, d), N).where("prob > 1e-5").select("release", "recapture", "k", "tau", "s_idx", r6("prob"))


@query()
def corridor_all(s, d):
    return markov.corridor_use(_few(s, d), kern(s, d), N).select("s_idx", geo.rounded("prob", 4).alias("prob"))


@query()
def steady_corridor(s, d):
    return markov.steady_corridors(_few(s, d), kern(s, d), N).groupBy("s_idx").agg(F.sum("prob").alias("prob")).select("s_idx", r6("prob"))


@query()
def viterbi_hmm(s, d):
    return markov.smooth_states(X.detections(s, d), kern(s, d), X.units(s, d), N).select("tagid", "step", "s_idx", r6("prob"), "observed")


@query()
def agents(s, d):
    u = X.units(s, d).where("NOT is_land")
    return markov.agents(u.select(F.col("s_idx").cast("long").alias("tagid"), F.col("s_idx").alias("start_node"), F.lit(25).alias("n_steps")), kern(s, d), N)


_WALK = "wk AS (SELECT tagid, s_idx AS mesh_unit FROM det)"


@query(X.with_sql("det", "units", body=", v AS (SELECT s_idx AS u, count(DISTINCT tagid) AS visits, count(*) AS r FROM det GROUP BY 1) SELECT units.s_idx AS unit_id, coalesce(visits, 0) AS visits, round(coalesce(visits, 0) / (SELECT count(DISTINCT tagid) FROM det), 6) AS visit_probability, round(coalesce(r / visits, 0.0), 6) AS mean_dwell_steps FROM units LEFT JOIN v ON u = units.s_idx"))
def space_use(s, d):
    w = X.detections(s, d).select("tagid", F.col("s_idx").alias("mesh_unit"))
    return markov.space_use(w, X.units(s, d)).select("unit_id", "visits", geo.rounded("visit_probability", 6).alias("visit_probability"), geo.rounded("mean_dwell_steps", 6).alias("mean_dwell_steps"))


_COND = ", c AS (SELECT src, dst, w * exp(0.5 * (a.hsi + b.hsi)) AS c FROM edges JOIN units a ON a.s_idx = src AND NOT a.is_land JOIN units b ON b.s_idx = dst AND NOT b.is_land)"


@query(X.with_sql("units", "edges", body=f"{_COND} SELECT src, dst, round(-c, 6) + 0.0 AS l FROM c UNION ALL SELECT src, src, round(sum(c), 6) + 0.0 FROM c GROUP BY src"))
def laplacian(s, d):
    return markov.laplacian(markov.conductance(X.units(s, d), X.edges(s, d))).select("src", "dst", r6("l"))


@query(X.with_sql("units", "edges", body=f"{_COND}, s AS (SELECT units.s_idx, coalesce(sum(c), 0.0) * greatest(1e-3, 1 - any_value(hsi)) AS score FROM units LEFT JOIN c ON src = s_idx GROUP BY 1), q AS (SELECT quantile_cont(score, 0.9) AS cut FROM s WHERE score > 1e-9) SELECT s_idx, round(score, 6) + 0.0 AS score, score > 1e-9 AND score >= cut AS is_pinch FROM s, q"))
def pinchpoints(s, d):
    c = markov.conductance(X.units(s, d), X.edges(s, d)).groupBy(F.col("src").alias("s_idx")).agg(F.sum("c").alias("density"))
    j = X.units(s, d).select("s_idx", (1 - F.col("hsi")).alias("resistance")).join(c, "s_idx", "left").na.fill(0.0, ["density"])
    return markov.pinch_points(j).select("s_idx", r6("score"), "is_pinch")


@query()
def circuit_current(s, d):
    return electric.current_use(_few(s, d), markov.conductance(X.units(s, d), X.edges(s, d)), N).select("s_idx", r6("current"))


@query()
def effective_resistance(s, d):
    return electric.resistances(_few(s, d), markov.conductance(X.units(s, d), X.edges(s, d)), N).select("release", "recapture", r6("resistance"))


# ------------------------------------------------------------------ statistics and report tables


@query(X.with_sql("det", "units", body=f"{_LOC}, st AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS dd FROM loc WINDOW w AS (PARTITION BY tagid ORDER BY tag)), e AS (SELECT tagid, count(*) AS n, coalesce(sum(dd), 0.0) AS length, sqrt(pow(arg_max(x, tag) - arg_min(x, tag), 2) + pow(arg_max(y, tag) - arg_min(y, tag), 2)) AS displacement FROM st GROUP BY tagid), f AS (SELECT *, CASE WHEN length <= 0.01 THEN 1.0 ELSE least(1.0, displacement / length) END AS efficiency FROM e) SELECT tagid, n, {q6('length', 'length')}, {q6('displacement', 'displacement')}, {q6('efficiency', 'efficiency')}, CASE WHEN efficiency >= 0.7 THEN 'directed' WHEN efficiency >= 0.3 THEN 'mixed' ELSE 'resident' END AS bout FROM f"))
def movement_stats(s, d):
    p = ecology.path_statistics(located(s, d))
    return p.select("tagid", "n", r6("length"), r6("displacement"), r6("efficiency"), "bout")


_CIRC = "b AS (SELECT avg(sin(radians(value))) AS s, avg(cos(radians(value))) AS c, count(*) AS n FROM events), r AS (SELECT n, s, c, sqrt(s * s + c * c) AS r FROM b)"


@query(f"WITH {_CIRC} SELECT n, round((degrees(atan2(s, c)) + 360.0) % 360.0, 4) AS mean_bearing, round(r, 6) AS resultant, round(n * r * r, 4) AS z FROM r")
def circular_stats(s, d):
    e = X.table(s, d, "events").select(F.col("value").alias("bearing"))
    return ecology.circular(e).select("n", geo.rounded("mean_bearing", 4).alias("mean_bearing"), geo.rounded("resultant", 6).alias("resultant"), geo.rounded("z", 4).alias("z"))


@query(X.with_sql("det", body=", t AS (SELECT tagid, (max(epoch_us(ts)) - min(epoch_us(ts))) / 86400e6 AS days, count(*) AS n FROM det GROUP BY 1 HAVING count(*) > 1), v AS (SELECT s_idx, sum(days / (n - 1)) AS days FROM det JOIN t USING (tagid) GROUP BY 1) SELECT s_idx, round(days, 4) AS days, round(days / sum(days) OVER (), 6) AS share FROM v"))
def residence_time(s, d):
    return ecology.residence(X.detections(s, d)).select("s_idx", geo.rounded("days", 4).alias("days"), geo.rounded("share", 6).alias("share"))


@query("SELECT coalesce(CAST(month(l_shipdate) AS INT), 0) AS month, coalesce(CAST(quarter(l_shipdate) AS INT), 0) AS quarter, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY GROUPING SETS ((1), (2), ())".replace("GROUPING SETS ((1), (2), ())", "GROUPING SETS ((CAST(month(l_shipdate) AS INT)), (CAST(quarter(l_shipdate) AS INT)), ())"))
def phenology_grouping_sets(s, d):
    p = ecology.phenology(X.table(s, d, "lineitem"), F.month("l_shipdate"), F.col("l_quantity"))
    return p.select(F.coalesce("month", F.lit(0)).alias("month"), F.coalesce("quarter", F.lit(0)).alias("quarter"), "n", geo.rounded("mean", 6).alias("mean"))


@query("SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def trait_ols(s, d):
    t = ecology.trait_regression(X.table(s, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return t.select("l_returnflag", "n", geo.rounded("slope", 4).alias("slope"), geo.rounded("intercept", 3).alias("intercept"), geo.rounded("r2", 6).alias("r2"))


_FLOW = ", f AS (SELECT CAST(a.region AS INT) AS from_region, CAST(b.region AS INT) AS to_region, count(*) AS n FROM pairs JOIN units a ON a.s_idx = release JOIN units b ON b.s_idx = recapture GROUP BY 1, 2)"


@query(X.with_sql("pairs", "units", body=f"{_FLOW} SELECT from_region, to_region, n, round(n / sum(n) OVER (), 6) AS share, round(n / sum(n) OVER (PARTITION BY from_region), 6) AS rate FROM f"))
def stock_flows(s, d):
    return ecology.flows(X.pairs(s, d), X.units(s, d)).select("from_region", "to_region", "n", geo.rounded("share", 6).alias("share"), geo.rounded("rate", 6).alias("rate"))


@query(X.with_sql("pairs", "units", body=f"{_FLOW}, r AS (SELECT from_region AS region, CASE WHEN from_region <> to_region THEN n ELSE 0 END AS o, 0 AS i, CASE WHEN from_region = to_region THEN n ELSE 0 END AS own FROM f UNION ALL SELECT to_region, 0, CASE WHEN from_region <> to_region THEN n ELSE 0 END, 0 FROM f) SELECT region, CAST(sum(i) AS BIGINT) AS inflow, CAST(sum(o) AS BIGINT) AS outflow, CAST(sum(i) - sum(o) AS BIGINT) AS net, round(sum(own) / (sum(own) + sum(o)), 6) AS retention FROM r GROUP BY region"))
def flow_balance(s, d):
    b = ecology.flow_balance(ecology.flows(X.pairs(s, d), X.units(s, d)))
    return b.select("region", "inflow", "outflow", "net", geo.rounded("retention", 6).alias("retention"))


@query(X.with_sql("pairs", body="SELECT release, recapture, count(*) AS n FROM pairs GROUP BY 1, 2 ORDER BY n DESC, release, recapture LIMIT 15"))
def flow_topk(s, d):
    return X.pairs(s, d).groupBy("release", "recapture").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "release", "recapture").limit(15)


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(24, greatest(0, floor((value - lo) / ((hi - lo) / 25)))) AS INT) AS bin, count(*) AS n FROM events, e GROUP BY 1")
def histogram(s, d):
    return ecology.histogram(X.table(s, d, "events"), "value", 25)


@query("WITH t AS (SELECT value AS v FROM events), s AS (SELECT count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM t), g AS (SELECT lo + i * (hi - lo) / 59 AS x, 1.06 * sd * pow(n, -0.2) AS bw, n FROM s, range(60) r(i)) SELECT round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - v) / bw, 2))) / any_value(n * bw * sqrt(2 * pi())), 6) + 0.0 AS density FROM g, t GROUP BY x")
def kde(s, d):
    return ecology.density(X.table(s, d, "events"), "value").select(geo.rounded("x", 6).alias("x"), r6("density"))


@query(X.with_sql("units", "edges", body=f"SELECT CAST(floor(({_BEAR} + 11.25) / 22.5) % 16 AS INT) AS sector, count(*) AS n FROM edges JOIN units a ON a.s_idx = src JOIN units b ON b.s_idx = dst GROUP BY 1"))
def windrose(s, d):
    e = _ends(s, d).withColumn("b", geo.bearing_deg("lon1", "lat1", "lon2", "lat2"))
    return e.groupBy(ecology.sector("b", 16).alias("sector")).agg(F.count("*").alias("n"))


@query(X.with_sql("det", "units", body=f"{_LOC} SELECT CAST(round_even(lon / 0.18, 0) AS INT) AS cx, CAST(round_even(lat / 0.15, 0) AS INT) AS cy, count(*) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM loc WHERE tag = 0 GROUP BY 1, 2"))
def release_clusters(s, d):
    r = located(s, d).where("tag = 0").withColumn("bearing", F.lit(0.0))
    return ecology.release_clusters(r).select("cx", "cy", "n", geo.rounded("lon", 6).alias("lon"), geo.rounded("lat", 6).alias("lat"))


@query(X.with_sql("det", "units", body=", o AS (SELECT s_idx, count(*) / (SELECT count(*) FROM det) AS p FROM det GROUP BY 1), q AS (SELECT s_idx, hsi / (SELECT sum(hsi) FROM units) AS p FROM units) SELECT round(avg(pow(coalesce(o.p, 0) - coalesce(q.p, 0), 2)), 9) AS brier, round(sum(CASE WHEN o.p > 1e-10 AND q.p > 1e-10 THEN o.p * ln(o.p / q.p) END), 6) AS kl FROM o FULL JOIN q USING (s_idx)"))
def ppc_brier_kl(s, d):
    det, u = X.detections(s, d), X.units(s, d)
    o = det.groupBy("s_idx").agg(F.count("*").alias("c"))
    o = o.select("s_idx", (F.col("c") / o.agg(F.sum("c")).scalar()).alias("p"))
    q = u.select("s_idx", (F.col("hsi") / u.agg(F.sum("hsi")).scalar()).alias("p"))
    return ecology.brier_kl(o, q).select(geo.rounded("brier", 9).alias("brier"), geo.rounded("kl", 6).alias("kl"))


@query(X.with_sql("pairs", "units", "edges", body=", dg AS (SELECT src AS s_idx, count(*) AS deg FROM edges GROUP BY 1), v AS (SELECT recapture AS s_idx, count(*) AS c FROM pairs GROUP BY 1) SELECT s_idx, round(c / deg, 6) AS bottleneck FROM v JOIN dg USING (s_idx)"))
def bottleneck_index(s, d):
    deg = X.edges(s, d).groupBy(F.col("src").alias("s_idx")).agg(F.count("*").alias("deg"))
    v = X.pairs(s, d).groupBy(F.col("recapture").alias("s_idx")).agg(F.count("*").alias("c"))
    return v.join(deg, "s_idx").select("s_idx", geo.rounded(F.col("c") / F.col("deg"), 6).alias("bottleneck"))


# ------------------------------------------------------------------ draws, grids, adaptive meshes


def _parameters(s) -> DataFrame:
    return s.createDataFrame([(k, 0.4 + 0.02 * k, 0.3 + 0.01 * k, 0.8 + 0.1 * k) for k in range(5)], "draw int, alpha double, rho double, gamma double")


@query()
def posterior_circuit(s, d):
    e = _few(s, d)
    return posterior.summarize_draws(posterior.circuit_draws(e, X.units(s, d), X.edges(s, d), N, draws=5), "density").select("s_idx", r6("mean"), r6("sd"), r6("lower"), r6("upper"), r6("pinch_prob"))


@query()
def resistance_covariance(s, d):
    c = posterior.resistance_covariance(markov.conductance(X.units(s, d), X.edges(s, d)), N, form="matern32")
    return c.select("s_idx", "other", r6("covariance"))


@query()
def path_credible_intervals(s, d):
    p = posterior.path_draws(_few(s, d), X.units(s, d), X.edges(s, d), _parameters(s), N)
    return posterior.path_intervals(p).select("release", "recapture", r6("mean"), "n_waypoints", "modal_waypoint")


@query()
def bayesian_ensemble(s, d):
    p = posterior.ensemble_use(_few(s, d), X.units(s, d), X.edges(s, d), _parameters(s), N)
    return p.select("s_idx", geo.rounded("prob", 4).alias("prob"))


@query()
def predictive_check(s, d):
    return posterior.predictive_check(X.pairs(s, d), kern(s, d), N, draws=10).select("draw", geo.rounded("brier", 9).alias("brier"), r6("kl"))


@query()
def persistence_gain(s, d):
    return posterior.persistence_gain(X.pairs(s, d), kern(s, d), X.units(s, d), N).select("kappa", r6("loglik"), r6("baseline"), r6("gain"), "is_best", "improves")


@query()
def bathymetry(s, d):
    return grids.bathymetry(s, -64.0, -62.0, 43.0, 45.0, 0.05).select("i", "j", r6("depth"), r6("slope"), "is_land")


@query()
def water_column(s, d):
    w = grids.water_column(grids.bathymetry(s, -64.0, -62.0, 43.0, 45.0, 0.1), [0, 10, 20, 50, 100, 200])
    return w.select("i", "j", "lev", r6("temperature"), r6("density"))


@query()
def area_weighted_transfer(s, d):
    return grids.area_weights(_coarse(s, d), X.units(s, d), 12.0, 10.0).select("target", "source", r6("w"))


@query()
def adaptive_mesh(s, d):
    return grids.adaptive_mesh(X.units(s, d), "is_land OR row < 2", 10.0, 5.0).select("s_idx", r6("x"), r6("y"), "radius_km", "is_fine")


@query()
def reconnect_components(s, d):
    return grids.reconnect(X.units(s, d), X.edges(s, d), "row NOT IN (4)")[0]


@query(X.with_sql("units", "edges", body=f"SELECT CAST(floor(({_BEAR} + 22.5) / 45.0) % 8 AS INT) AS sector, count(*) AS n FROM edges JOIN units a ON a.s_idx = src JOIN units b ON b.s_idx = dst GROUP BY 1"))
def sector8(s, d):
    e = _ends(s, d).withColumn("b", geo.bearing_deg("lon1", "lat1", "lon2", "lat2"))
    return e.groupBy(ecology.sector("b", 8).alias("sector")).agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_flow(spark, sf_dir)


# the queries of this module register themselves with the functions above
from fauntrack.plans import inference  # noqa: E402, F401
