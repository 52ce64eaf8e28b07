"""Transition kernels as normalised edge tables (src, dst, p)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fauntrack.functions import geo


def _with_habitat(edges: DataFrame, units: DataFrame, marine: bool = True) -> DataFrame:
    u = units.where("NOT is_land") if marine and "is_land" in units.columns else units
    a = u.select(F.col("s_idx").alias("src"), F.col("hsi").alias("h_src"))
    b = u.select(F.col("s_idx").alias("dst"), F.col("hsi").alias("h_dst"))
    return edges.join(a, "src").join(b, "dst")


def static(units: DataFrame, edges: DataFrame, gamma: float = 1.0, rho: float | Column = 0.3, alpha: float | Column = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """The habitat-driven kernel; keys (draw, step, ...) stand in both tables for many kernels at once.

    Land and units without a marine neighbour keep all their mass.
    """
    k = list(keys)
    u = units.select(*k, "s_idx", "hsi", "is_land", F.least(F.lit(0.999), F.greatest(F.lit(0.0), rho if isinstance(rho, Column) else F.lit(rho))).alias("rho"))
    marine = u.where("NOT is_land")
    e = edges.join(marine.select(*k, F.col("s_idx").alias("src"), F.col("hsi").alias("h_src"), "rho"), [*[c for c in k if c in edges.columns], "src"])
    e = e.join(marine.select(*k, F.col("s_idx").alias("dst"), F.col("hsi").alias("h_dst")), [*k, "dst"])
    w = Window.partitionBy(*k, "src")
    a = geo.clamp(alpha if isinstance(alpha, Column) else F.lit(alpha), 0.0, 1.0)
    e = e.withColumn("t", F.col("w") * F.exp(geo.clamp(gamma * (F.col("h_dst") - F.col("h_src")), -25.0, 25.0)))
    p = (1 - F.col("rho")) * (a * F.col("t") / F.sum("t").over(w) + (1 - a) * F.col("w") / F.sum("w").over(w))
    out = e.select(*k, "src", "dst", p.alias("p")).where("p > 1e-12")
    gone = out.groupBy(*k, "src").agg(F.sum("p").alias("o"))
    stay = u.select(*k, F.col("s_idx").alias("src")).join(gone, [*k, "src"], "left").select(*k, "src", F.col("src").alias("dst"), (1 - F.coalesce("o", F.lit(0.0))).alias("p"))
    return out.unionByName(stay)


def suitability(units: DataFrame, edges: DataFrame, beta: float = 1.0, diffusion: float = 0.1, relationship: str = "exponential") -> DataFrame:
    """Weights f(h) for staying and (f(h_dst) + diffusion) w for moving, normalised by row."""
    f = {"exponential": lambda h: F.exp(beta * h), "logistic": lambda h: 1 / (1 + F.exp(-beta * h)), "linear": lambda h: F.greatest(F.lit(0.01), beta * h)}[relationship]
    move = edges.join(units.select(F.col("s_idx").alias("dst"), "hsi"), "dst").select("src", "dst", ((f(F.col("hsi")) + diffusion) * F.col("w")).alias("v"))
    stay = units.select(F.col("s_idx").alias("src"), F.col("s_idx").alias("dst"), f(F.col("hsi")).alias("v"))
    return move.unionByName(stay).select("src", "dst", (F.col("v") / F.sum("v").over(Window.partitionBy("src"))).alias("p"))


def directed(units: DataFrame, edges: DataFrame, gamma: float = 1.0) -> DataFrame:
    """exp(gamma h_dst) over the neighbours, normalised; edge weights do not count."""
    e = edges.join(units.select(F.col("s_idx").alias("dst"), "hsi"), "dst").withColumn("v", F.exp(gamma * F.col("hsi")))
    return e.select("src", "dst", (F.col("v") / F.sum("v").over(Window.partitionBy("src"))).alias("p"))


def persistent(kernel: DataFrame, units: DataFrame, kappa: float = 1.0, headings: int = 6) -> DataFrame:
    """Kernel over (unit, heading): moves weighed by the turn, a stay keeps its heading."""
    at = lambda n: units.select(F.col("s_idx").alias(n), F.col("lon").alias(f"lon_{n}"), F.col("lat").alias(f"lat_{n}"))
    k = kernel.join(at("src"), "src").join(at("dst"), "dst")
    k = k.withColumn("b", geo.bearing_deg("lon_src", "lat_src", "lon_dst", "lat_dst")).withColumn("h_src", F.explode(F.sequence(F.lit(1), F.lit(headings))))
    theta = (F.col("h_src") - 1) * (360.0 / headings)
    stay = F.col("src") == F.col("dst")
    v = F.col("p") * F.when(stay, F.exp(F.lit(kappa))).otherwise(F.exp(kappa * F.cos(F.radians(F.col("b") - theta))))
    k = k.withColumn("v", v).withColumn("h_dst", F.when(stay, F.col("h_src")).otherwise(geo.heading_bin("b", headings)))
    return k.select("src", "h_src", "dst", "h_dst", (F.col("v") / F.sum("v").over(Window.partitionBy("src", "h_src"))).alias("p"))


def unit_marginal(kernel: DataFrame, headings: int) -> DataFrame:
    """Average of a (unit, heading) kernel over headings."""
    return kernel.groupBy("src", "dst").agg((F.sum("p") / headings).alias("p"))


def row_sums(kernel: DataFrame) -> DataFrame:
    return kernel.groupBy("src").agg(F.sum("p").alias("total"), F.min("p").alias("least"), F.count("*").alias("n"))


def log_clip() -> float:
    return math.log(1e-12)
