"""Report tables as the analyses export them: fixed columns and digits, one CSV table each, written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fauntrack.functions import geo

from . import readers

# Columns and digits of the reports (None: as it is).
REPORTS = {
    "stock_connectivity_summary": {"source_region": None, "sink_region": None, "connectivity": 6, "flow_count": None, "flow_rate": 6},
    "stock_connectivity_credible_intervals": {"source_region": None, "sink_region": None, "mean_conn": 6, "lower_ci": 6, "upper_ci": 6},
    "path_credible_intervals": {"tagid": None, "release_site": None, "recapture_site": None, "path_length_mean": 2, "path_length_lower": 2, "path_length_upper": 2, "path_length_sd": 2, "n_waypoints": None, "modal_waypoint": None},
    "space_use": {"unit_id": None, "visit_probability": 6, "visits": None, "mean_dwell_steps": 4},
    "persistence_gain": {"kappa": None, "loglik": 6, "baseline": 6, "gain": 6, "is_best": None, "improves": None},
}


def report(df: DataFrame, name: str) -> DataFrame:
    """df with the columns of the report, in its order and with its digits; a missing column is an error that names it."""
    columns = REPORTS[name]
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.select(*[F.col(c) if n is None else (geo.rounded(c, n) + 0.0).alias(c) for c, n in columns.items()])


def connectivity_summary(connectivity: DataFrame, pairs: DataFrame, regions: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """source_region, sink_region, connectivity, flow_count, flow_rate for every two regions.

    connectivity: from_region, to_region, p; regions: s_idx, region (0 and null:
    none); labels: region, label, or none for the numbers. The rate is the
    connectivity times the share of all observed moves. Regions that nothing
    connects are rows of zeros.
    """
    r = regions.where("region > 0").select("s_idx", "region")
    every = r.agg(F.array_sort(F.collect_set("region")).alias("x"))  # one row; regions are few
    grid = every.select("x", F.explode("x").alias("from_region")).select("from_region", F.explode("x").alias("to_region"))
    at = lambda end, c: r.select(F.col("s_idx").alias(end), F.col("region").alias(c))
    moves = pairs.groupBy("release", "recapture").agg(F.count("*").alias("n")).join(at("release", "from_region"), "release").join(at("recapture", "to_region"), "recapture").groupBy("from_region", "to_region").agg(F.sum("n").alias("n"))
    d = grid.join(connectivity, ["from_region", "to_region"], "left").join(moves, ["from_region", "to_region"], "left").select("from_region", "to_region", F.coalesce("p", F.lit(0.0)).alias("connectivity"), F.coalesce("n", F.lit(0)).alias("flow_count"))
    d = d.withColumn("flow_rate", F.col("connectivity") * F.col("flow_count") / (F.sum("flow_count").over(Window.partitionBy()) + 1e-10))
    if labels is not None:
        for c in ("from_region", "to_region"):
            d = d.join(labels.select(F.col("region").alias(c), F.col("label").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", F.col(c).cast("string"))).drop(f"_{c}")
    return d.withColumnsRenamed({"from_region": "source_region", "to_region": "sink_region"})


def path_summary(intervals: DataFrame, pairs: DataFrame) -> DataFrame:
    """The columns of path_credible_intervals for every pair, from path_intervals() by (release, recapture)."""
    own = intervals.withColumnsRenamed({"mean": "path_length_mean", "sd": "path_length_sd", "lower": "path_length_lower", "upper": "path_length_upper"})
    return pairs.select("tagid", "release", "recapture").join(own, ["release", "recapture"]).withColumnsRenamed({"release": "release_site", "recapture": "recapture_site"})


def export(df: DataFrame, name: str, folder: str) -> str:
    """Writes a report as CSV with a header under folder, over what was there, and returns its path."""
    path = f"{folder}/{name}"
    readers.export_csv(report(df, name), path)
    return path
