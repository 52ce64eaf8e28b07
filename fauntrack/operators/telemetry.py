"""Telemetry: indexing, pairing, bucketing, dead tags, activity and validation. Everything windows by tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fauntrack.functions import geo

#: Names under which detection tables carry the needed columns, most specific first (fixed values).
TIME_NAMES = ("timestamp", "ts", "datetime", "date_time", "date", "time")
LON_NAMES, LAT_NAMES = ("lon", "longitude", "long", "x"), ("lat", "latitude", "y")
TAG_NAMES = ("tagid", "tag_id", "aid", "id")
UNIT_NAMES = ("s_idx", "auid", "unit_id", "mesh_unit", "unit")


def detect_column(df: DataFrame, names: tuple[str, ...], given: str | None = None, required: bool = True) -> str | None:
    """The column to use: the given one, else the first candidate present, ignoring case."""
    if given is not None:
        if given not in df.columns:
            raise ValueError(f"column {given!r} is not among {df.columns}")
        return given
    lower = {c.lower(): c for c in reversed(df.columns)}
    for n in names:
        if n in lower:
            return lower[n]
    if required:
        raise ValueError(f"none of {list(names)} is among {df.columns}")
    return None


def index_detections(df: DataFrame, tag: str, ts: str, tie: str) -> DataFrame:
    """Adds `tag`: the number of a detection within its tag, from 0, by time."""
    w = Window.partitionBy(tag).orderBy(ts, tie)
    return df.withColumn("tag", F.row_number().over(w) - 1)


def clean(df: DataFrame) -> DataFrame:
    """Drops dead animals and rows without a usable place, tag or time."""
    if "is_dead" in df.columns:
        df = df.where(~F.coalesce("is_dead", F.lit(False)))
    need = [c for c in ("tagid", "tag", "ts") if c in df.columns]
    df = df.dropna(subset=need)
    for c in ("lon", "lat"):
        if c in df.columns:
            df = df.where(geo.finite(c))
    return df


def pairable(df: DataFrame) -> DataFrame:
    """Rows of tags that have both a release (tag = 0) and a recapture."""
    ok = df.groupBy("tagid").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo = 0 AND hi > 0").select("tagid")
    return df.join(ok, "tagid", "left_semi")


def time_steps(seconds: Column, unit_seconds: float) -> Column:
    """Whole steps between two times, at least 1, halves to even."""
    return F.greatest(F.lit(1), F.rint(seconds / unit_seconds).cast("int"))


def pair_consecutive(det: DataFrame, unit_seconds: float = 3600, most: int | None = None) -> DataFrame:
    """Consecutive detections of a tag as release and recapture; steps back in time are no pairs."""
    w = Window.partitionBy("tagid").orderBy("tag")
    us = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    d = det.select("tagid", "tag", F.lag("s_idx").over(w).alias("release"), F.col("s_idx").alias("recapture"), F.lag("ts").over(w).alias("rel_ts"), F.col("ts").alias("rec_ts"), us.alias("us"))
    k = F.rint(F.col("us") / (unit_seconds * 1e6))
    k = F.greatest(F.lit(1.0), k if most is None else F.least(F.lit(float(most)), k))
    return d.where("release IS NOT NULL AND us >= 0").withColumn("k", k.cast("int"))


def pair_in_chunks(det: DataFrame, unit_seconds: float = 3600, chunk: str = "month", tie: str = "event_id") -> DataFrame:
    """The pairs of pair_consecutive() and the number of each recapture, without one task per tag.

    Detections (tagid, ts, s_idx and a tie breaker) are windowed by tag and
    calendar chunk (any unit of date_trunc), so a tag that is seen very often is
    spread over tasks; only a row a tag and chunk (its detections, its last one)
    is windowed by tag alone, and gives each chunk the number and the detection
    that it continues from. Rows without a tag, time or unit are left out; ties
    in time go by the tie breaker.
    """
    d = det.dropna(subset=["tagid", "ts", "s_idx"]).select("tagid", "ts", "s_idx", F.col(tie).alias("_tie"), F.date_trunc(chunk, "ts").alias("_chunk"))
    w = Window.partitionBy("tagid", "_chunk").orderBy("ts", "_tie")
    inside = d.select("tagid", "_chunk", "ts", "s_idx", F.row_number().over(w).alias("_n"), F.lag("s_idx").over(w).alias("_unit"), F.lag("ts").over(w).alias("_ts"))
    ends = d.groupBy("tagid", "_chunk").agg(F.count("*").alias("_count"), F.max_by(F.struct("ts", "s_idx"), F.struct("ts", "_tie")).alias("_last"))
    by_tag = Window.partitionBy("tagid").orderBy("_chunk")
    before = ends.select("tagid", "_chunk", F.coalesce(F.sum("_count").over(by_tag.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("_last").over(by_tag).alias("_from"))
    both = inside.join(before, ["tagid", "_chunk"])
    first = F.col("_n") == 1
    rel_ts = F.when(first, F.col("_from.ts")).otherwise(F.col("_ts"))
    release = F.when(first, F.col("_from.s_idx")).otherwise(F.col("_unit"))
    out = both.select("tagid", (F.col("_before") + F.col("_n") - 1).alias("tag"), release.alias("release"), F.col("s_idx").alias("recapture"), rel_ts.alias("rel_ts"), F.col("ts").alias("rec_ts"))
    return out.where("release IS NOT NULL").withColumn("k", time_steps((F.unix_micros("rec_ts") - F.unix_micros("rel_ts")) / 1e6, unit_seconds))


def bucket_of(ts: str, interval: str) -> Column:
    """Start of the bucket: month, week (Monday), 14 days from 1990-01-01, day, or the time itself."""
    t = F.col(ts)
    if interval == "monthly":
        return F.trunc(t, "month")
    if interval == "weekly":
        return F.date_trunc("week", t).cast("date")
    if interval == "biweekly":
        epoch = F.lit("1990-01-01").cast("date")
        return F.date_add(epoch, (F.floor(F.datediff(t.cast("date"), epoch) / 14) * 14).cast("int"))
    if interval == "daily":
        return t.cast("date")
    raise ValueError(f"interval {interval!r}: one of monthly, weekly, biweekly, daily")


def bucket_time(det: DataFrame, interval: str, means: tuple[str, ...] = ("value",)) -> DataFrame:
    """One row per tag and bucket; tags with one bucket only go, the others are numbered anew."""
    if interval == "raw":
        return det
    d = det.withColumn("bucket", bucket_of("ts", interval))
    d = d.groupBy("tagid", "bucket").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in means], F.min("tag").alias("first_tag"), F.min_by("s_idx", F.struct("ts", "tag")).alias("s_idx"), F.min("ts").alias("first_ts"))
    w = Window.partitionBy("tagid")
    d = d.withColumn("_n", F.count("*").over(w)).where("_n >= 2").drop("_n")
    return d.withColumn("tag", F.row_number().over(w.orderBy("bucket")) - 1)


def flag_dead(det: DataFrame, days: float = 30.0, metres: float = 50.0) -> DataFrame:
    """Flags the last cluster of a tag that never leaves `metres` of its last fix and lasts `days` or more."""
    w = Window.partitionBy("tagid").orderBy("ts", "tag")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = lambda c: F.last(c).over(whole)
    d = det.withColumn("_d", geo.haversine_m("lon", "lat", last("lon"), last("lat"))).withColumn("_d", F.when(geo.finite("_d"), F.col("_d")).otherwise(float("inf")))
    d = d.withColumn("_far", F.max("_d").over(w.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("_left", (F.unix_micros(last("ts")) - F.unix_micros("ts")) / 86400e6).withColumn("_in", F.col("_far") <= metres)
    span = F.max(F.when(F.col("_in"), F.col("_left"))).over(Window.partitionBy("tagid"))
    return d.withColumn("is_dead", F.col("_in") & (F.coalesce(span, F.lit(-1.0)) >= days)).drop("_d", "_far", "_left", "_in")


def summarize_tags(det: DataFrame) -> DataFrame:
    """Per tag: detections, days from first to last, path length in metres along time order."""
    w = Window.partitionBy("tagid").orderBy("ts", "tag")
    d = det.withColumn("_m", geo.haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat"))
    return d.groupBy("tagid").agg(F.count("*").alias("n"), ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 86400e6).alias("days"), F.coalesce(F.sum(F.when(geo.finite("_m"), F.col("_m"))), F.lit(0.0)).alias("metres"), (F.max_by("value", F.struct("ts", "tag")) - F.min_by("value", F.struct("ts", "tag"))).alias("growth"))


def telemetry_faults(det: DataFrame) -> DataFrame:
    """Tags that break a rule: no or several releases, a negative number, a recapture not later than the release."""
    d = det.groupBy("tagid").agg(F.count_if(F.col("tag") == 0).alias("releases"), F.count_if(F.col("tag") < 0).alias("negative"), F.max(F.when(F.col("tag") == 0, F.col("ts"))).alias("rel"), F.min(F.when(F.col("tag") > 0, F.col("ts"))).alias("rec"))
    return d.where((F.col("releases") != 1) | (F.col("negative") > 0) | (F.col("rec") <= F.col("rel")))


def validate_telemetry(det: DataFrame) -> DataFrame:
    """det itself; raises with the first offending tag if a rule is broken."""
    need = {"tagid", "tag", "ts"} - set(det.columns)
    if need:
        raise ValueError(f"missing columns: {sorted(need)}")
    bad = telemetry_faults(det).orderBy("tagid").limit(1).collect()
    if bad:
        raise ValueError(f"telemetry of tag {bad[0]['tagid']!r} breaks a rule: {bad[0].asDict()}")
    return det


def validate_pair_units(pairs: DataFrame, n_units: int) -> DataFrame:
    """pairs itself; raises naming the first five with an endpoint outside 1..n_units."""
    bad = pairs.where(~F.col("release").between(1, n_units) | ~F.col("recapture").between(1, n_units))
    first = bad.limit(6).collect()
    if first:
        raise ValueError(f"endpoints outside 1..{n_units}: {[r.asDict() for r in first[:5]]}" + (f", {bad.count() - 5} more" if len(first) > 5 else ""))
    return pairs


def hsi_at_month(det: DataFrame, monthly: DataFrame, climate: DataFrame) -> DataFrame:
    """Habitat of the unit in the month; years outside the table take its nearest year, gaps the unit's mean, else 0.5."""
    years = monthly.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    d = det.withColumn("_y", F.greatest(years.select("lo").scalar(), F.least(years.select("hi").scalar(), F.year("ts")))).withColumn("_m", F.month("ts"))
    m = monthly.select(F.col("s_idx").alias("_s"), F.col("year").alias("_yy"), F.col("month").alias("_mm"), F.col("hsi").alias("_h"))
    c = climate.select(F.col("s_idx").alias("_c"), F.col("hsi").alias("_hc"))
    d = d.join(m, (F.col("s_idx") == F.col("_s")) & (F.col("_y") == F.col("_yy")) & (F.col("_m") == F.col("_mm")), "left").join(c, F.col("s_idx") == F.col("_c"), "left")
    return d.withColumn("hsi", F.coalesce(F.when(geo.finite("_h"), F.col("_h")), F.when(geo.finite("_hc"), F.col("_hc")), F.lit(0.5))).drop("_y", "_m", "_s", "_yy", "_mm", "_h", "_c", "_hc")


def group_label(sex: Column, mat: Column) -> Column:
    """Demographic group: immature, or male or female of the mature ones by sex M or F (fixed spellings); all others are unknown."""
    mature = mat == "mature"
    return F.when(mat == "immature", "immature").when(mature & (sex == "M"), "male").when(mature & (sex == "F"), "female").otherwise("unknown")


def group_ids(df: DataFrame, label: str = "label") -> DataFrame:
    """df with `group`: the place of its label, from 1, among the labels that occur (four at most)."""
    found = df.agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return df.withColumn("group", F.array_position(found.scalar(), F.col(label)).cast("int"))
