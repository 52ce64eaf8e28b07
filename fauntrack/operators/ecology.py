"""Movement statistics and report tables: group-wise aggregates, windows and grouping sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fauntrack.functions import geo


def path_statistics(steps: DataFrame) -> DataFrame:
    """Per tag: planar length and displacement, efficiency, tortuosity, bout and bearing, from ordered fixes (x, y)."""
    w = Window.partitionBy("tagid").orderBy("tag")
    s = steps.withColumn("_d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    ends = s.groupBy("tagid").agg(F.count("*").alias("n"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"), F.min_by("x", "tag").alias("x0"), F.min_by("y", "tag").alias("y0"), F.max_by("x", "tag").alias("x1"), F.max_by("y", "tag").alias("y1"))
    d = ends.withColumn("displacement", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    eff = F.when(F.col("length") <= 0.01, 1.0).otherwise(geo.clamp(F.try_divide("displacement", "length"), 0.0, 1.0))
    tort = F.when(F.col("displacement") <= 0.01, 1.0).otherwise(F.try_divide("length", "displacement"))
    d = d.withColumns({"efficiency": eff, "tortuosity": tort, "bearing": F.pmod(F.degrees(F.atan2(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), F.lit(360.0))})
    bout = F.when(F.col("efficiency") >= 0.7, "directed").when(F.col("efficiency") >= 0.3, "mixed").otherwise("resident")
    return d.select("tagid", "n", "length", "displacement", "efficiency", "tortuosity", "bearing", bout.alias("bout"))


def circular(paths: DataFrame, bearing: str = "bearing") -> DataFrame:
    """One row: circular mean, mean resultant length, concentration (three branches), Rayleigh z and p."""
    b = F.radians(bearing)
    a = paths.agg(F.count(bearing).alias("n"), F.avg(F.sin(b)).alias("s"), F.avg(F.cos(b)).alias("c")).withColumn("r", F.hypot("s", "c"))
    r = F.col("r")
    kappa = F.when(r < 0.53, 2 * r + r**3 + 5 * r**5 / 6).when(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r)).otherwise(F.try_divide(F.lit(1.0), r**3 - 4 * r**2 + 3 * r))
    z = F.col("n") * r * r
    n = F.col("n").cast("double")
    p = F.exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z**2 + 76 * z**3 - 9 * z**4) / (288 * n * n))
    return a.select("n", F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0)).alias("mean_bearing"), r.alias("resultant"), kappa.alias("kappa"), z.alias("z"), geo.clamp(p, 0.0, 1.0).alias("p"))


def residence(det: DataFrame) -> DataFrame:
    """s_idx, days, share: a tag's duration spread evenly over its visits."""
    d = det.groupBy("tagid").agg(((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 86400e6).alias("days"), F.count("*").alias("n")).where("n > 1")
    v = det.join(d, "tagid").groupBy("s_idx").agg(F.sum(F.col("days") / (F.col("n") - 1)).alias("days"))
    return v.withColumn("share", F.col("days") / F.sum("days").over(Window.partitionBy()))


def phenology(pairs: DataFrame, month: Column, value: Column) -> DataFrame:
    """month, quarter, n, mean by month, by quarter and in all: one pass over grouping sets."""
    d = pairs.select(month.alias("month"), F.ceil(month / 3).cast("int").alias("quarter"), value.alias("v"))
    return d.groupingSets([("month",), ("quarter",), ()], "month", "quarter").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def trait_regression(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least squares of y on x: n, slope, intercept, r2, standard error and t of the slope."""
    c = F.col
    agg = [F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")]
    d = (df.groupBy(*by) if by else df.groupBy()).agg(*agg)
    se = F.sqrt(F.greatest(F.lit(0.0), c("syy") - c("slope") * c("sxy")) / (c("n") - 2) / c("sxx"))
    return d.where("n >= 3").withColumn("se", se).select(*(by or []), "n", "slope", "intercept", geo.clamp("r2", 0.0, 1.0).alias("r2"), "se", F.try_divide("slope", "se").alias("t"))


def t_tail(t: float, df: int) -> float:
    """Two-sided tail of Student's t by the regularised incomplete beta (continued fraction)."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
    p = front * h / a
    return 1 - p if flip else p


def flows(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """from_region, to_region, n, share of all and of the origin."""
    a, b = regions.select(F.col("s_idx").alias("release"), F.col("region").alias("from_region")), regions.select(F.col("s_idx").alias("recapture"), F.col("region").alias("to_region"))
    f = pairs.join(a, "release").join(b, "recapture").groupBy("from_region", "to_region").agg(F.count("*").alias("n"))
    return f.select("from_region", "to_region", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), (F.col("n") / F.sum("n").over(Window.partitionBy("from_region"))).alias("rate"))


def flow_balance(flow: DataFrame) -> DataFrame:
    """region, inflow, outflow, net, retention."""
    f = flow.select(F.explode(F.array(F.struct(F.col("from_region").alias("region"), F.col("n").alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("to_region").alias("region"), F.lit(0).cast("long").alias("o"), F.col("n").alias("i")))).alias("f"), (F.col("from_region") == F.col("to_region")).alias("own"))
    d = f.groupBy("f.region").agg(F.sum(F.when(~F.col("own"), F.col("f.i")).otherwise(0)).alias("inflow"), F.sum(F.when(~F.col("own"), F.col("f.o")).otherwise(0)).alias("outflow"), F.sum(F.when(F.col("own"), F.col("f.o")).otherwise(0)).alias("kept"))
    return d.select("region", "inflow", "outflow", (F.col("inflow") - F.col("outflow")).alias("net"), F.try_divide("kept", F.col("kept") + F.col("outflow")).alias("retention"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (from 0), n of equal-width bins over the range; the last bin holds the maximum."""
    e = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (e.select("hi").scalar() - e.select("lo").scalar()) / bins
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.coalesce(F.try_divide(F.col(value) - e.select("lo").scalar(), width), F.lit(0.0))).cast("int")))
    return df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, value: str, points: int = 60) -> DataFrame:
    """x, density: Gaussian kernel density on an even grid, bandwidth 1.06 sd n^-0.2; meant for draw tables."""
    s = df.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    g = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select("n", (1.06 * F.col("sd") * F.pow("n", F.lit(-0.2))).alias("bw"), (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x"))
    grid = g.agg(F.collect_list(F.struct("x", "bw", "n")).alias("g"))  # one row of `points` entries
    d = df.select(F.col(value).alias("v")).withColumn("g", F.explode(grid.scalar()))
    u = (F.col("g.x") - F.col("v")) / F.col("g.bw")
    return d.groupBy("g.x").agg((F.sum(F.exp(-0.5 * u * u)) / F.first(F.col("g.n") * F.col("g.bw") * math.sqrt(2 * math.pi))).alias("density"))


def release_clusters(places: DataFrame) -> DataFrame:
    """Releases binned to cells of 0.18 by 0.15 degrees, halves to even: mean place, n and circular mean bearing."""
    b = F.radians("bearing")
    d = places.groupBy(F.rint(F.col("lon") / 0.18).cast("int").alias("cx"), F.rint(F.col("lat") / 0.15).cast("int").alias("cy"))
    return d.agg(F.count("*").alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.pmod(F.degrees(F.atan2(F.avg(F.sin(b)), F.avg(F.cos(b)))), F.lit(360.0)).alias("bearing"))


def sector(bearing: str, sectors: int) -> Column:
    """Centred sector number (0 is north)."""
    return F.pmod(F.floor((F.col(bearing) + 180.0 / sectors) / (360.0 / sectors)), F.lit(sectors)).cast("int")


def brier_kl(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: mean squared difference and KL divergence of two unit distributions (s_idx, p); cells over 1e-10 count for KL."""
    j = observed.select("s_idx", F.col("p").alias("o")).join(predicted.select("s_idx", F.col("p").alias("q")), "s_idx", "full")
    o, q = F.coalesce("o", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    return j.agg(F.avg(F.pow(o - q, 2)).alias("brier"), F.coalesce(F.sum(F.when((o > 1e-10) & (q > 1e-10), o * F.log(o / q))), F.lit(0.0)).alias("kl"))
