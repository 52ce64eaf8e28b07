"""Habitat fields: monthly interpolation, local advantage, residency, infill."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fauntrack.functions import geo


def sanitise(df: DataFrame, column: str = "hsi") -> DataFrame:
    """Values that are not finite become the mean of the finite ones (0 if none); all are clamped to [0, 1]."""
    mean = df.agg(F.avg(F.when(geo.finite(column), F.col(column))).alias("m"))
    return df.withColumn(column, geo.clamp(F.coalesce(F.when(geo.finite(column), F.col(column)), mean.scalar(), F.lit(0.0)), 0.0, 1.0))


def monthly(yearly: DataFrame, reference_day: int = 244) -> DataFrame:
    """s_idx, year, month, hsi at mid-month, linear between yearly anchors; constant beyond the first and the last."""
    w = Window.partitionBy("s_idx").orderBy("year")
    y = yearly.select("s_idx", "year", F.col("hsi").alias("h1"), F.lag("hsi").over(w).alias("h0"), F.lead("hsi").over(w).alias("h2"))
    m = y.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    day = F.dayofyear(F.make_date(F.col("year"), F.col("month"), F.lit(15)))
    u = (day - 1) / 365.25 - (reference_day - 1) / 365.25
    ahead, behind = F.coalesce("h2", "h1"), F.coalesce("h0", "h1")
    v = F.when(u >= 0, F.col("h1") + u * (ahead - F.col("h1"))).otherwise(F.col("h1") - u * (behind - F.col("h1")))
    return m.select("s_idx", "year", "month", geo.clamp(v, 0.0, 1.0).alias("hsi"))


#: Forms of the local advantage: plain ones and their exponential aliases (fixed values).
ADVANTAGE_FORMS = ("difference", "ratio", "log_ratio", "exp_difference", "exp_ratio", "exp_log_ratio")


def advantage(units: DataFrame, edges: DataFrame, form: str = "difference") -> DataFrame:
    """s_idx, advantage of a unit's habitat over the weighted mean of its neighbours; 0 where there is none."""
    if form not in ADVANTAGE_FORMS:
        raise ValueError(f"form {form!r}: one of {ADVANTAGE_FORMS}")
    h = units.select(F.col("s_idx").alias("dst"), "hsi")
    near = edges.join(h, "dst").groupBy(F.col("src").alias("s_idx")).agg((F.sum(F.col("w") * F.col("hsi")) / F.sum("w")).alias("near"))
    d = units.select("s_idx", "hsi").join(near, "s_idx", "left")
    kind = form.removeprefix("exp_")
    a = {"difference": F.col("hsi") - F.col("near"), "ratio": F.try_divide("hsi", "near") - 1, "log_ratio": F.when((F.col("hsi") > 0) & (F.col("near") > 0), F.log(F.col("hsi") / F.col("near")))}[kind]
    return d.select("s_idx", F.coalesce(F.when(geo.finite(a), a), F.lit(0.0)).alias("advantage"))


def residency(rho: float, advantage: Column, coupling: float, form: str = "difference") -> Column:
    """Residency shifted by advantage: additive for plain forms, on the logit for exponential ones; no coupling, no change."""
    if coupling == 0:
        return F.lit(rho)
    if form.startswith("exp_"):
        z = geo.clamp(np.log(rho / (1 - rho)) + coupling * advantage, -20.0, 20.0)
        out = 1 / (1 + F.exp(-z))
    else:
        out = rho + coupling * advantage
    return F.when(geo.finite(advantage), geo.clamp(out, 0.0, 0.999)).otherwise(rho)


def infill(units: DataFrame, edges: DataFrame, known: str, rho: float = 0.95, baseline: float = 0.1, decay: float = 50.0) -> DataFrame:
    """Habitat of unknown units from the known ones: a damped graph solve, one group, numpy; decay to the baseline away from data.

    A mesh is one group of at most a few ten thousand units; many meshes (months,
    draws) are many groups and run side by side through the column `mesh`.
    """
    u = units if "mesh" in units.columns else units.withColumn("mesh", F.lit(0))
    if "mesh" in edges.columns:
        e = edges
    elif "mesh" not in units.columns:
        e = edges.withColumn("mesh", F.lit(0))
    else:  # one set of edges for all meshes: repeated for each, so that every group has its own
        meshes = [r["mesh"] for r in units.select("mesh").distinct().collect()]  # months or draws
        e = edges.withColumn("mesh", F.explode(F.array(*map(F.lit, meshes))))

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("s_idx").reset_index(drop=True)
        at = {s: k for k, s in enumerate(a["s_idx"])}
        n = len(a)
        w = np.zeros((n, n))
        for s, d, x in zip(b["src"], b["dst"], b["w"], strict=True):
            w[at[s], at[d]] += x
        have, h = a["known"].to_numpy(bool), a["hsi"].to_numpy(float).copy()
        miss = np.flatnonzero(~have)
        if have.any() and len(miss):
            mean = float(np.quantile(h[have], baseline))
            deg = w.sum(1)
            left = np.diag(deg[miss]) - rho * w[np.ix_(miss, miss)]
            right = rho * w[np.ix_(miss, np.flatnonzero(have))] @ h[have] + (1 - rho) * deg[miss] * mean
            alone = deg[miss] == 0
            left[alone, alone], right[alone] = 1.0, mean
            h[miss] = np.linalg.solve(left, right)
            xy = a[["x", "y"]].to_numpy(float)
            far = miss[(w[miss][:, have] > 0).sum(1) == 0]
            if len(far):
                d = np.hypot(*(xy[far, None] - xy[None, have]).transpose(2, 0, 1))
                near = d.argmin(1)
                blend = np.exp(-d[np.arange(len(far)), near] / decay)
                h[far] = blend * h[have][near] + (1 - blend) * mean
        return pd.DataFrame({"mesh": a["mesh"], "s_idx": a["s_idx"], "hsi": np.clip(np.nan_to_num(h), 0, 1)})

    left = u.select(F.col("mesh").cast("int").alias("mesh"), "s_idx", "x", "y", F.col("hsi").cast("double").alias("hsi"), F.expr(known).alias("known")).groupBy("mesh")
    return left.cogroup(e.select(F.col("mesh").cast("int").alias("mesh"), "src", "dst", "w").groupBy("mesh")).applyInPandas(solve, "mesh int, s_idx int, hsi double")
