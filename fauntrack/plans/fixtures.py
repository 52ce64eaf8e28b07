"""Domain tables over the generic event tables: detections, units, edges, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fauntrack.functions import geo
from fauntrack.operators import mesh, telemetry

LON0, LAT0, RADIUS = -63.0, 44.0, 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: tagid, ts, unit and number within the tag."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("tagid"), "event_type", "value", (F.get_json_object("props", "$.k").cast("int") + 1).alias("s_idx"))
    return telemetry.index_detections(e, "tagid", "ts", "event_id")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 x 10 lattice with habitat from mean event values, land flags and regions."""
    e = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    v = e.groupBy("k").agg(F.avg("value").alias("v"))
    span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lattice = mesh.hex_lattice(spark, 10, 10, RADIUS)
    lon, lat = geo.to_lonlat("x", "y", LON0, LAT0)
    u = lattice.join(v, lattice["s_idx"] - 1 == v["k"], "left").withColumn("_s", F.struct(span.select("lo").scalar().alias("lo"), span.select("hi").scalar().alias("hi")))
    hsi = 0.1 + 0.8 * (F.col("v") - F.col("_s.lo")) / (F.col("_s.hi") - F.col("_s.lo"))
    return u.select("s_idx", "row", "col", "x", "y", lon.alias("lon"), lat.alias("lat"), hsi.alias("hsi"), (((F.col("s_idx") - 1) * 37) % 100 < 8).alias("is_land"), F.floor(F.col("row") / 4).cast("int").alias("region"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.lattice_edges(mesh.hex_lattice(spark, 10, 10, RADIUS))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.pair_consecutive(detections(spark, sf_dir), unit_seconds=3600, most=24)


#: The same tables as DuckDB CTEs; each query's SQL starts with the ones it needs.
SQL = {
    "det": "det AS (SELECT user_id AS tagid, event_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS INT) + 1 AS s_idx, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tag FROM events)",
    "units": """uv AS (SELECT CAST(json_extract(props, '$.k') AS INT) AS k, avg(value) AS v FROM events GROUP BY 1),
us AS (SELECT min(v) AS lo, max(v) AS hi FROM uv),
u0 AS (SELECT CAST(range AS INT) AS k, CAST(range // 10 AS INT) AS r, CAST(range % 10 AS INT) AS c FROM range(100)),
units AS (SELECT u0.k + 1 AS s_idx, r AS row, c AS col, sqrt(3.0) * 10.0 * c + CASE WHEN r % 2 = 1 THEN sqrt(3.0) * 5.0 ELSE 0.0 END AS x, 15.0 * r AS y,
 0.1 + 0.8 * (v - lo) / (hi - lo) AS hsi, (u0.k * 37) % 100 < 8 AS is_land, r // 4 AS region,
 -63.0 + degrees((sqrt(3.0) * 10.0 * c + CASE WHEN r % 2 = 1 THEN sqrt(3.0) * 5.0 ELSE 0.0 END) / (6371.0 * cos(radians(44.0)))) AS lon, 44.0 + degrees(15.0 * r / 6371.0) AS lat
 FROM u0 LEFT JOIN uv ON u0.k = uv.k, us)""",
    "edges": "edges AS (SELECT a.s_idx AS src, b.s_idx AS dst, 1.0 AS w FROM units a JOIN units b ON (a.row = b.row AND abs(a.col - b.col) = 1) OR (abs(a.row - b.row) = 1 AND b.col - a.col IN (CASE WHEN a.row % 2 = 0 THEN -1 ELSE 0 END, CASE WHEN a.row % 2 = 0 THEN 0 ELSE 1 END)))",
    "pairs": "pairs AS (SELECT * FROM (SELECT tagid, tag, lag(s_idx) OVER w AS release, s_idx AS recapture, CAST(greatest(1, least(24, round_even((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3600e6, 0))) AS INT) AS k, lag(ts) OVER w AS rel_ts, ts AS rec_ts, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us FROM det WINDOW w AS (PARTITION BY tagid ORDER BY tag)) WHERE release IS NOT NULL AND us >= 0)",
    "kernel": """me AS (SELECT src, dst, w FROM edges WHERE src NOT IN (SELECT s_idx FROM units WHERE is_land) AND dst NOT IN (SELECT s_idx FROM units WHERE is_land)),
ke AS (SELECT src, dst, w, w * exp(greatest(-25.0, least(25.0, 1.0 * (b.hsi - a.hsi)))) AS t FROM me JOIN units a ON a.s_idx = src JOIN units b ON b.s_idx = dst),
km AS (SELECT src, dst, 0.7 * (0.5 * t / sum(t) OVER (PARTITION BY src) + 0.5 * w / sum(w) OVER (PARTITION BY src)) AS p FROM ke),
kept AS (SELECT * FROM km WHERE p > 1e-12),
kernel AS (SELECT src, dst, p FROM kept UNION ALL SELECT s_idx, s_idx, 1.0 - coalesce(m.o, 0.0) FROM units LEFT JOIN (SELECT src, sum(p) AS o FROM kept GROUP BY src) m ON m.src = s_idx)""",
}
_NEEDS = {"det": [], "units": [], "edges": ["units"], "pairs": ["det"], "kernel": ["units", "edges"]}


def with_sql(*names: str, body: str, recursive: bool = False) -> str:
    """body after the CTEs that it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS[name]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    head = ",\n".join(SQL[n] for n in order)
    body = body.strip()
    if body.startswith(","):
        return f"WITH {'RECURSIVE ' * recursive}{head}{body}"
    return f"WITH {'RECURSIVE ' * recursive}{head}\n{body}"
