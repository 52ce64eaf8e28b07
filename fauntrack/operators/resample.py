"""Nearest-unit snapping, k-nearest transfer and field resharding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fauntrack.functions import geo

#: Unit tables up to this many rows may be broadcast; their count is checked, beyond it joins run on a grid.
SMALL_UNITS = 20_000


def _active(units: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Units that are not land and have a neighbour; all units if none is."""
    u = units.where("NOT is_land") if "is_land" in units.columns else units
    if edges is not None:
        u = u.join(edges.select(F.col("src").alias("s_idx")).distinct(), "s_idx", "left_semi")
    return u if u.limit(1).count() else units


def snap(points: DataFrame, units: DataFrame, cell: float, edges: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(key, s_idx, distance) of the nearest active unit of each point (x, y); ties to the smaller s_idx.

    Points and units meet in grid cells of the given size and the eight around
    (an exact answer whenever a unit stands within one cell size); the few
    points without such a unit look through all units, which are broadcast only
    if their number has been checked; more units are searched again in ever
    larger cells until every point has one. Points without finite coordinates
    have no row.
    """
    u = _active(units, edges).select("s_idx", F.col("x").alias("ux"), F.col("y").alias("uy"))
    grid = lambda c: F.floor(F.col(c) / cell)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = u.withColumn("o", around).select("s_idx", "ux", "uy", (grid("ux") + F.col("o.i")).alias("gx"), (grid("uy") + F.col("o.j")).alias("gy"))
    p = points.where(geo.finite("x") & geo.finite("y")).select(F.col(key).alias("_k"), "x", "y").withColumns({"gx": grid("x"), "gy": grid("y")})
    d = F.hypot(F.col("x") - F.col("ux"), F.col("y") - F.col("uy"))
    near = p.join(spread, ["gx", "gy"]).withColumn("d", d).where(F.col("d") <= cell).groupBy("_k").agg(F.min(F.struct("d", "s_idx")).alias("b"))
    rest = p.join(near.select("_k"), "_k", "left_anti")
    if u.count() <= SMALL_UNITS:
        found = _nearest(rest.select("_k", "x", "y"), u, 1)
        far = found.select(F.col("_k"), F.struct("d", "s_idx").alias("b"))
    elif not rest.limit(1).count():
        far = near
    else:
        far = snap(rest.select(F.col("_k").alias(key), "x", "y"), units, cell * 4, edges, key).select(F.col(key).alias("_k"), F.struct(F.col("distance").alias("d"), "s_idx").alias("b"))
    return (near if far is near else near.union(far)).select(F.col("_k").alias(key), F.col("b.s_idx").alias("s_idx"), F.col("b.d").alias("distance"))


def _nearest(points: DataFrame, units: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(_k, r, s_idx, d) of the k nearest units (s_idx, ux, uy) of points (_k, x, y), ties (to `digits`) to the smaller s_idx; the units travel as one checked array."""
    u = units.orderBy("s_idx").toPandas()
    shared = points.sparkSession.sparkContext.broadcast((u["s_idx"].to_numpy("int32"), u["ux"].to_numpy(float), u["uy"].to_numpy(float)))
    kind = points.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, ux, uy = shared.value
        step = max(1, 2_000_000 // max(1, len(ids)))
        for pdf in batches:
            for s in range(0, len(pdf), step):
                part = pdf.iloc[s : s + step]
                d = np.hypot(part["x"].to_numpy()[:, None] - ux, part["y"].to_numpy()[:, None] - uy)
                best = np.argsort(d if digits is None else np.round(d, digits), axis=1, kind="stable")[:, :k]
                n = best.shape[1]
                yield pd.DataFrame({"_k": np.repeat(part["_k"].to_numpy(), n), "r": np.tile(np.arange(1, n + 1, dtype="int32"), len(part)), "s_idx": ids[best.ravel()], "d": np.take_along_axis(d, best, 1).ravel()})

    return points.mapInPandas(run, f"_k {kind}, r int, s_idx int, d double")


def knn_weights(target: DataFrame, source: DataFrame, k: int = 4, power: float = 2.0) -> DataFrame:
    """(target, source, w): inverse-distance weights of the k nearest sources, rows sum to 1; an exact hit takes all.

    source is a mesh (checked to be small); targets may be many.
    """
    if source.count() > SMALL_UNITS:
        raise ValueError("the source mesh is too large for a broadcast; reshard it in parts")
    near = _nearest(target.select(F.col("s_idx").alias("_k"), "x", "y"), source.select("s_idx", F.col("x").alias("ux"), F.col("y").alias("uy")), k)
    all_ = near.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("r", "s_idx", "d"))).alias("a"))  # k entries
    raw = F.when(F.col("a")[0]["d"] < 1e-9, F.transform("a", lambda x: F.when(x["r"] == 1, 1.0).otherwise(0.0))).otherwise(F.transform("a", lambda x: 1 / F.pow(x["d"], F.lit(power))))
    w = all_.withColumn("raw", raw).withColumn("total", F.aggregate("raw", F.lit(0.0), lambda t, x: t + x))
    w = w.select(F.col("_k").alias("target"), "total", F.explode(F.arrays_zip(F.col("a.s_idx").alias("source"), "raw")).alias("z"))
    return w.select("target", F.col("z.source").alias("source"), (F.col("z.raw") / F.col("total")).alias("w"))


def reshard(field: DataFrame, weights: DataFrame, columns: tuple[str, ...], sd: tuple[str, ...] = ()) -> DataFrame:
    """Fields (s_idx, columns) carried to the targets; standard deviations combine as the root of the mean variance."""
    j = weights.join(field, weights["source"] == field["s_idx"])
    return j.groupBy("target").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns], *[F.sqrt(F.sum(F.col("w") * F.col(c) * F.col(c))).alias(c) for c in sd]).withColumnRenamed("target", "s_idx")


def summarize_samples(samples: DataFrame, value: str = "value", alpha: float = 0.05) -> DataFrame:
    """Per unit: mean, median, sd and the two quantiles."""
    return samples.groupBy("s_idx").agg(F.avg(value).alias("mean"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.stddev_samp(value).alias("sd"), F.expr(f"percentile({value}, {alpha / 2})").alias("lower"), F.expr(f"percentile({value}, {1 - alpha / 2})").alias("upper"))


def snap_pruned(pairs: DataFrame, units: DataFrame, keep: str) -> DataFrame:
    """Endpoints on pruned units move to the nearest retained unit by squared degrees; ties to the smaller s_idx."""
    kept = units.where(keep)
    if not kept.limit(1).count():
        raise ValueError("no unit is kept")
    away = units.where(f"NOT ({keep})").select(F.col("s_idx").alias("_k"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    moved = _nearest(away, kept.select("s_idx", F.col("lon").alias("ux"), F.col("lat").alias("uy")), 1, digits=9).select(F.col("_k").alias("old"), F.col("s_idx").alias("new"))
    for c in ("release", "recapture"):
        pairs = pairs.join(moved.select(F.col("old").alias("_o"), F.col("new").alias("_n")), F.col(c) == F.col("_o"), "left")
        pairs = pairs.withColumn(f"{c}_orig", F.col(c)).withColumn(c, F.coalesce("_n", c)).drop("_o", "_n")
    return pairs
