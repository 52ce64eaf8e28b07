"""Movement summary by tag and month of release, and its totals by region, as a partitioned table.

    python -m jobs.movement_report DETECTIONS UNITS TARGET [--config FILE]

DETECTIONS is a Parquet table of detections, UNITS one of mesh units (s_idx, lon,
lat, hsi). A tag's detections of consecutive times are steps; the steps that
begin in a month are its path of that month. A row tells where and when the path
starts and ends, its days, length, displacement, efficiency (displacement by
length, 1 for a path of up to 10 m), tortuosity (length by displacement, 1 for
one of up to 10 m), kilometres a day (0 for up to 0.1 days), mean habitat of all
its fixes, bearing, and kind of behaviour by its efficiency.

With `months` in the settings only these months are written, over what was there
(dynamic partition overwrite), from detections since the first of them; without
it the whole table is replaced. Either way a second run writes the same rows.
Detections without a tag, time or unit and steps from or to a unit that UNITS
lacks make no path.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fauntrack.functions import geo
from fauntrack.operators import telemetry
from jobs import settings

LOG = settings.logger("jobs.movement_report")
#: How times stand in text formats: with microseconds.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
#: Units up to this many are sent to all tasks; a larger mesh is joined by shuffle.
MOST_UNITS = 100_000
# The columns of the report, and its kinds of behaviour from an efficiency on.
COLUMNS = ("tagid", "release_date", "recapture_date", "start_lon", "start_lat", "end_lon", "end_lat", "duration_days", "total_dist_km", "displacement_km", "efficiency", "tortuosity", "velocity_km_day", "mean_hsi", "bearing_deg", "primary_behavior")
BEHAVIOUR = ((0.70, "Directed / Migratory"), (0.30, "Exploratory / Search"), (0.0, "Resident / Encamped"))


@dataclass(frozen=True)
class Settings:
    tag: str = "user_id"
    time: str = "ts"
    unit: str = "CAST(get_json_object(props, '$.k') AS INT) + 1"
    tie: str = "event_id"
    chunk: str = "month"
    months: tuple[str, ...] = ()
    format: str = "parquet"

    def __post_init__(self) -> None:
        if self.format not in ("parquet", "orc", "json", "csv"):
            raise ValueError(f"format: {self.format!r} is not parquet, orc, json or csv")


def paths(steps: DataFrame, units: DataFrame) -> DataFrame:
    """The report's rows, unrounded, with the month, from steps (release, recapture, rel_ts, rec_ts, tag) and units."""
    at = lambda end, n: units.select(F.col("s_idx").alias(end), *[F.col(c).alias(f"{c}{n}") for c in ("lon", "lat", "hsi")])
    d = steps.join(at("release", 0), "release").join(at("recapture", 1), "recapture")
    d = d.withColumn("month", F.date_format("rel_ts", "yyyy-MM")).withColumn("km", geo.haversine_m("lon0", "lat0", "lon1", "lat1") / 1000)
    first = lambda c: F.min_by(c, "tag").alias(c)
    last = lambda c: F.max_by(c, "tag").alias(c)
    g = d.groupBy("tagid", "month").agg(F.min("rel_ts").alias("t0"), F.max("rec_ts").alias("t1"), *[first(c) for c in ("lon0", "lat0", "hsi0")], *[last(c) for c in ("lon1", "lat1")], F.sum("km").alias("total"), F.sum("hsi1").alias("habitat"), F.count("*").alias("n"))
    g = g.withColumn("days", (F.unix_micros("t1") - F.unix_micros("t0")) / 86400e6).withColumn("net", geo.haversine_m("lon0", "lat0", "lon1", "lat1") / 1000)
    g = g.withColumn("efficiency", F.when(F.col("total") > 0.01, geo.clamp(F.col("net") / F.col("total"), 0.0, 1.0)).otherwise(1.0))
    bearing = F.degrees(F.atan2(F.col("lon1") - F.col("lon0"), F.col("lat1") - F.col("lat0")))
    kind = F.lit(BEHAVIOUR[-1][1])
    for least, name in reversed(BEHAVIOUR[:-1]):
        kind = F.when(F.col("efficiency") >= least, name).otherwise(kind)
    return g.select(
        "tagid", F.col("t0").alias("release_date"), F.col("t1").alias("recapture_date"), F.col("lon0").alias("start_lon"), F.col("lat0").alias("start_lat"), F.col("lon1").alias("end_lon"), F.col("lat1").alias("end_lat"),
        F.col("days").alias("duration_days"), F.col("total").alias("total_dist_km"), F.col("net").alias("displacement_km"), "efficiency", F.when(F.col("net") > 0.01, F.col("total") / F.col("net")).otherwise(1.0).alias("tortuosity"),
        F.when(F.col("days") > 0.1, F.col("total") / F.col("days")).otherwise(0.0).alias("velocity_km_day"), ((F.col("hsi0") + F.col("habitat")) / (F.col("n") + 1)).alias("mean_hsi"), F.when(bearing < 0, bearing + 360).otherwise(bearing).alias("bearing_deg"), kind.alias("primary_behavior"), "month",
    )


#: Digits of the report's numbers.
DIGITS = {"start_lon": 4, "start_lat": 4, "end_lon": 4, "end_lat": 4, "duration_days": 1, "total_dist_km": 2, "displacement_km": 2, "efficiency": 4, "tortuosity": 2, "velocity_km_day": 3, "mean_hsi": 3, "bearing_deg": 1}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(geo.rounded(c, DIGITS[c]) + 0.0).alias(c) if c in DIGITS else F.col(c) for c in df.columns])


def _ddl() -> str:
    return ", ".join(f"{c} {'string' if c in ('tagid', 'primary_behavior') else 'timestamp' if c.endswith('_date') else 'double'}" for c in COLUMNS) + ", month string"


def _options(s: Settings) -> dict:
    return {"timestampFormat": TIME_FORMAT, "header": True} if s.format in ("csv", "json") else {}


def read_report(spark: SparkSession, target: str, s: Settings | None = None) -> DataFrame:
    """The report as it stands."""
    s = s or Settings()
    return spark.read.schema(_ddl()).format(s.format).options(**_options(s)).load(target)


def run(spark: SparkSession, detections: str, units: str, target: str, s: Settings | None = None) -> DataFrame:
    """Writes the report, and returns it as it stands then."""
    s = s or Settings()
    raw = spark.read.parquet(detections)
    d = raw.select(F.expr(s.tag).cast("string").alias("tagid"), F.expr(s.time).cast("timestamp").alias("ts"), F.expr(s.unit).cast("int").alias("s_idx"), F.expr(s.tie).alias("tie"))
    if s.months:  # a step of these months begins in them
        d = d.where(F.col("ts") >= F.to_timestamp(F.lit(f"{min(s.months)}-01")))
    mesh = spark.read.parquet(units).select("s_idx", "lon", "lat", "hsi")
    n_units = mesh.count()
    LOG.info("read %s detections from %s and %s units from %s", raw.count(), detections, n_units, units)
    steps = telemetry.pair_in_chunks(d, chunk=s.chunk, tie="tie")
    report = rounded(paths(steps, F.broadcast(mesh) if n_units <= MOST_UNITS else mesh))
    mode = "dynamic" if s.months else "static"
    if s.months:
        report = report.where(F.col("month").isin(list(s.months)))
    out = report.repartition("month", F.pmod(F.xxhash64("tagid"), F.lit(8)))
    out.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("month").format(s.format).options(**_options(s)).save(target)
    written = read_report(spark, target, s)
    for r in written.groupBy("month").agg(F.count("*").alias("n")).orderBy("month").collect():  # a row a month
        LOG.info("%s rows for %s under %s%s", r["n"], r["month"], target, "" if not s.months or r["month"] in s.months else " (as it was)")
    return written


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.movement_report", description="Movement summary by tag and month of release.")
    for name in ("detections", "units", "target"):
        p.add_argument(name)
    p.add_argument("--config")
    a = p.parse_args(argv)
    settings.log_to_terminal()
    spark = SparkSession.builder.appName("movement_report").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a.detections, a.units, a.target, settings.load(Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
