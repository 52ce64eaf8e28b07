"""The jobs as queries: each runs twice over the whole tables into a new folder, and returns the output as it stands then."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fauntrack.plans import fixtures
from jobs import detection_pairs, movement_report


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one of the session; a temporary one only in local mode without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared or 'file://' + tempfile.mkdtemp(prefix='fauntrack-')}/{name}-{uuid.uuid4().hex}"


def job1_detection_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all events in hours, whatever their number."""
    at = _folder(spark, "job1")
    for _ in range(2):
        # a stream takes a folder or a pattern, and this table may be one file
        out = detection_pairs.run(spark, f"{sf_dir}/events.parque[t]", f"{at}/target", f"{at}/checkpoint")
    return out.select("tagid", "tag", "release", "recapture", F.unix_micros("rel_ts").alias("rel_us"), F.unix_micros("rec_ts").alias("rec_us"), "k")


def job2_movement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all events on the fixture mesh, whose units are written first."""
    at = _folder(spark, "job2")
    fixtures.units(spark, sf_dir).select("s_idx", "lon", "lat", "hsi").write.parquet(f"{at}/units")
    for _ in range(2):
        out = movement_report.run(spark, f"{sf_dir}/events.parquet", f"{at}/units", f"{at}/report")
    return out.withColumns({c: F.unix_micros(c) for c in ("release_date", "recapture_date")})


JOB1_SQL = """WITH d AS (SELECT CAST(user_id AS VARCHAR) AS tagid, ts, CAST(json_extract(props, '$.k') AS INT) + 1 AS s_idx, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) - 1 AS tag FROM events),
 p AS (SELECT tagid, tag, lag(s_idx) OVER w AS release, s_idx AS recapture, epoch_us(lag(ts) OVER w) AS rel_us, epoch_us(ts) AS rec_us FROM d WINDOW w AS (PARTITION BY tagid ORDER BY tag))
 SELECT tagid, tag, release, recapture, rel_us, rec_us, CAST(greatest(1, round_even((rec_us - rel_us) / 3600e6, 0)) AS INT) AS k FROM p WHERE release IS NOT NULL"""


def _hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * 6378.137 * atan2(sqrt(least(1.0, {a})), sqrt(1 - least(1.0, {a}))))"


_ROUND = {c: f"round({c}, {n}) + 0.0 AS {c}" for c, n in movement_report.DIGITS.items()}
JOB2_SQL = fixtures.with_sql(
    "det",
    "units",
    body=f""", p AS (SELECT tagid, tag, lag(s_idx) OVER w AS release, s_idx AS recapture, lag(ts) OVER w AS rel_ts, ts AS rec_ts FROM det WINDOW w AS (PARTITION BY tagid ORDER BY tag)),
s AS (SELECT CAST(tagid AS VARCHAR) AS tagid, tag, rel_ts, rec_ts, strftime(rel_ts, '%Y-%m') AS month, a.lon AS lon0, a.lat AS lat0, a.hsi AS hsi0, b.lon AS lon1, b.lat AS lat1, b.hsi AS hsi1, {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS km FROM p JOIN units a ON a.s_idx = release JOIN units b ON b.s_idx = recapture),
g AS (SELECT tagid, month, min(rel_ts) AS t0, max(rec_ts) AS t1, arg_min(lon0, tag) AS start_lon, arg_min(lat0, tag) AS start_lat, arg_max(lon1, tag) AS end_lon, arg_max(lat1, tag) AS end_lat, sum(km) AS total_dist_km, (arg_min(hsi0, tag) + sum(hsi1)) / (count(*) + 1) AS mean_hsi FROM s GROUP BY 1, 2),
h AS (SELECT *, (epoch_us(t1) - epoch_us(t0)) / 86400e6 AS duration_days, {_hav('start_lon', 'start_lat', 'end_lon', 'end_lat')} AS displacement_km FROM g),
r AS (SELECT *, CASE WHEN total_dist_km > 0.01 THEN least(1.0, displacement_km / total_dist_km) ELSE 1.0 END AS efficiency, CASE WHEN displacement_km > 0.01 THEN total_dist_km / displacement_km ELSE 1.0 END AS tortuosity, CASE WHEN duration_days > 0.1 THEN total_dist_km / duration_days ELSE 0.0 END AS velocity_km_day, degrees(atan2(end_lon - start_lon, end_lat - start_lat)) AS b FROM h),
q AS (SELECT *, CASE WHEN b < 0 THEN b + 360 ELSE b END AS bearing_deg, CASE WHEN efficiency >= 0.7 THEN 'Directed / Migratory' WHEN efficiency >= 0.3 THEN 'Exploratory / Search' ELSE 'Resident / Encamped' END AS primary_behavior FROM r)
SELECT tagid, epoch_us(t0) AS release_date, epoch_us(t1) AS recapture_date, {', '.join(_ROUND.values())}, primary_behavior, month FROM q""",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_detection_pairs": job1_detection_pairs, "job2_movement_report": job2_movement_report}


def oracle_sql() -> dict[str, str]:
    return {"job1_detection_pairs": JOB1_SQL, "job2_movement_report": JOB2_SQL}
