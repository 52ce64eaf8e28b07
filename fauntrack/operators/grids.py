"""Gridded sources and area-weighted transfer: synthetic bathymetry, water columns, polygon overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the water column: gravity, reference density, thermal and haline coefficients.
GRAVITY, RHO0, THERMAL, HALINE = 9.81, 1027.0, 0.2, 0.8


def bathymetry(spark: SparkSession, west: float, east: float, south: float, north: float, step: float, seed: int = 1) -> DataFrame:
    """i, j, lon, lat, elevation, depth, slope, is_land of a synthetic shelf with a bank, a basin and two metres of roughness."""
    nx, ny = round((east - west) / step) + 1, round((north - south) / step) + 1
    g = spark.range(ny).select(F.col("id").cast("int").alias("j")).select("j", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("i"))
    u, v = F.col("i") / max(1, nx - 1), F.col("j") / max(1, ny - 1)
    noise = (F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 4
    bank = 60 * F.exp(-(F.pow(u - 0.35, 2) + F.pow(v - 0.4, 2)) / 0.02)
    basin = -80 * F.exp(-(F.pow(u - 0.7, 2) + F.pow(v - 0.6, 2)) / 0.03)
    g = g.select("i", "j", (west + F.col("i") * step).alias("lon"), (south + F.col("j") * step).alias("lat"), (40 - 260 * (1 - v) + bank + basin + noise).alias("elevation"))
    g = g.withColumn("depth", F.greatest(F.lit(0.0), -F.col("elevation")))
    a, b = Window.partitionBy("j").orderBy("i"), Window.partitionBy("i").orderBy("j")
    d = lambda w, metres: F.coalesce((F.lead("elevation").over(w) - F.lag("elevation").over(w)) / (2 * step * metres), F.lit(0.0))
    return g.withColumn("slope", F.hypot(d(a, 111320.0 * F.cos(F.radians("lat"))), d(b, F.lit(110540.0)))).withColumn("is_land", F.col("elevation") >= 0)


def water_column(bathy: DataFrame, depths: list[float]) -> DataFrame:
    """i, j, lev, depth_m, temperature, salinity, density, n2: linear equation of state; NaN below the bed."""
    lev = F.posexplode(F.array(*map(F.lit, map(float, depths))))
    d = bathy.select("i", "j", "depth", lev).withColumnsRenamed({"pos": "lev", "col": "depth_m"})
    d = d.withColumn("temperature", 4 + 8 * F.exp(-F.col("depth_m") / 40)).withColumn("salinity", 32 + 2.5 * (1 - F.exp(-F.col("depth_m") / 80)))
    d = d.withColumn("density", RHO0 - THERMAL * (F.col("temperature") - 10) + HALINE * (F.col("salinity") - 34))
    w = Window.partitionBy("i", "j").orderBy("lev")
    dz = F.coalesce(F.lead("depth_m").over(w), "depth_m") - F.coalesce(F.lag("depth_m").over(w), "depth_m")
    dr = F.coalesce(F.lead("density").over(w), "density") - F.coalesce(F.lag("density").over(w), "density")
    d = d.withColumn("n2", F.greatest(F.lit(1e-7), F.coalesce(GRAVITY / RHO0 * F.try_divide(dr, dz), F.lit(1e-7))))
    below = F.col("depth_m") > F.col("depth")
    return d.select("i", "j", "lev", "depth_m", *[F.when(below, F.lit(float("nan"))).otherwise(F.col(c)).alias(c) for c in ("temperature", "salinity", "density", "n2")])


def nearest_level(column: DataFrame, depth: float) -> DataFrame:
    """The slice of the level closest to a depth."""
    best = column.agg(F.min_by("lev", F.struct(F.abs(F.col("depth_m") - depth), "lev"))).first()[0]
    return column.where(F.col("lev") == best)


def _clip(ring: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex ring (both counter-clockwise)."""
    out = ring
    for a, b in zip(other, np.roll(other, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt, s2 = np.roll(out, -1, axis=0), np.roll(side, -1)
        pts = []
        for p, q, s, t in zip(out, nxt, side, s2, strict=True):
            if s >= 0:
                pts.append(p)
            if (s >= 0) != (t >= 0):
                pts.append(p + (q - p) * s / (s - t))
        out = np.array(pts).reshape(-1, 2)
    return out


def _area(r: np.ndarray) -> float:
    return 0.0 if len(r) < 3 else abs(float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum())) / 2


def area_weights(target: DataFrame, source: DataFrame, r_target: float, r_source: float) -> DataFrame:
    """target, source, w: shares of each target hexagon's overlap; candidates meet on grid cells, targets without overlap take the nearest source."""
    cell = r_target + r_source
    grid = lambda df: df.withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)})
    t = grid(target.select(F.col("s_idx").alias("target"), "x", "y"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    s = grid(source.select(F.col("s_idx").alias("source"), "x", "y")).withColumn("o", around).select("source", F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    corners = np.radians(30 + 60 * np.arange(6))
    unit = np.stack([np.cos(corners), np.sin(corners)], axis=1)

    def overlap(batches):
        for pdf in batches:
            a = [_area(_clip(np.array([x, y]) + r_target * unit, np.array([sx, sy]) + r_source * unit)) for x, y, sx, sy in zip(pdf["x"], pdf["y"], pdf["sx"], pdf["sy"], strict=True)]
            yield pd.DataFrame({"target": pdf["target"], "source": pdf["source"], "d": np.hypot(pdf["x"] - pdf["sx"], pdf["y"] - pdf["sy"]), "a": a})

    c = t.join(s, ["gx", "gy"]).select("target", "source", "x", "y", "sx", "sy").mapInPandas(overlap, "target int, source int, d double, a double")
    w = Window.partitionBy("target")
    c = c.withColumn("total", F.sum("a").over(w)).withColumn("r", F.row_number().over(w.orderBy("d", "source")))
    share = F.when(F.col("total") > 0, F.col("a") / F.col("total")).otherwise(F.when(F.col("r") == 1, 1.0).otherwise(0.0))
    return c.select("target", "source", share.alias("w")).where("w > 0")


def adaptive_mesh(coarse: DataFrame, refine: str, r_coarse: float, r_fine: float) -> DataFrame:
    """Coarse units where `refine` is false, and a fine lattice over the others: s_idx, x, y, radius_km, is_fine.

    Fine centres are those of a fine lattice whose nearest coarse centre is
    refined; centres closer than 0.6 fine spacings to a kept coarse one go.
    """
    spark = coarse.sparkSession
    fine_r = min(r_fine, 0.75 * r_coarse)
    from . import mesh, resample

    fine = mesh.hex_cover(spark, coarse, fine_r).select(F.col("s_idx").alias("id"), "x", "y")
    near = resample.snap(fine, coarse.drop("is_land"), 2 * r_coarse)
    keep = coarse.where(f"NOT ({refine})").select(F.col("s_idx").alias("c"))
    inside = near.join(keep, near["s_idx"] == keep["c"], "left_anti").where(F.col("distance") <= r_coarse)
    f = fine.join(inside.select("id"), "id", "left_semi").select("x", "y", F.lit(fine_r).alias("radius_km"), F.lit(True).alias("is_fine"))
    u = coarse.where(f"NOT ({refine})").select("x", "y", F.lit(r_coarse).alias("radius_km"), F.lit(False).alias("is_fine"))
    return u.union(f).withColumn("s_idx", F.row_number().over(Window.orderBy("is_fine", "y", "x")))


def reconnect(units: DataFrame, edges: DataFrame, kept: str, most_bridge: int = 64) -> tuple[DataFrame, int, int]:
    """Kept units plus the cheapest bridges of dropped ones that tie each smaller part to the largest: (s_idx, added), linked, unlinked.

    One mesh, 0-1 shortest paths on its CSR arrays.
    """
    from collections import deque

    from . import graphs as G

    u = units.select("s_idx", F.expr(kept).alias("keep")).orderBy("s_idx").toPandas()  # mesh-sized
    n = int(u["s_idx"].max())
    g, keep = G.collect_csr(edges.select("src", "dst", "w"), n, "w"), np.zeros(n, bool)
    keep[u["s_idx"][u["keep"]].to_numpy() - 1] = True
    added, linked, budget = np.zeros(n, bool), 0, most_bridge

    def parts(mask):
        left, out = set(np.flatnonzero(mask).tolist()), []
        while left:
            s, todo = {min(left)}, [min(left)]
            while todo:
                for j in g.row(todo.pop())[0].tolist():
                    if mask[j] and j not in s:
                        s.add(j)
                        todo.append(j)
            left -= s
            out.append(sorted(s))
        return sorted(out, key=lambda p: (-len(p), p[0]))

    while len(p := parts(keep)) > 1:
        cost, before, todo = {i: 0 for i in p[0]}, {}, deque(p[0])
        while todo:
            i = todo.popleft()
            for j in g.row(i)[0].tolist():
                c = cost[i] + (not keep[j])
                if c < cost.get(j, 1 << 30):
                    cost[j], before[j] = c, i
                    (todo.append if not keep[j] else todo.appendleft)(j)
        best = min(((cost[part[0]], k) for k, part in enumerate(p[1:], 1) if part[0] in cost), default=None)
        if best is None or best[0] > budget:
            break
        i = p[best[1]][0]
        while i in before:
            if not keep[i]:
                keep[i] = added[i] = True
                budget -= 1
            i = before[i]
        linked += 1
    unlinked = sum(map(len, parts(keep)[1:]))
    rows = [(int(i) + 1, bool(added[i])) for i in np.flatnonzero(keep)]
    return units.sparkSession.createDataFrame(rows, "s_idx int, added boolean"), linked, unlinked
