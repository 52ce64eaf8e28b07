"""Lines of sight between units: which straight lines stay off land, shorter paths along them, and nodes that paths can start from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mesh, resample

#: Most ring sides that are sent to the tasks; more are an error, since a side must be at hand wherever a path goes.
MOST_SIDES = 5_000_000


def navigable(units: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """s_idx, node, distance: the unit itself if it is not land and has an edge, else the nearest such unit (planar, ties to the smaller number)."""
    linked = edges.select(F.col("src").alias("s_idx")).union(edges.select("dst")).distinct().withColumn("_e", F.lit(True))
    u = units.join(linked, "s_idx", "left").withColumn("_ok", ~F.col("is_land") & F.coalesce("_e", F.lit(False)))
    own = u.where("_ok").select("s_idx", F.col("s_idx").alias("node"), F.lit(0.0).alias("distance"))
    near = resample.snap(u.where("NOT _ok").select(F.col("s_idx").alias("id"), "x", "y"), u.where("_ok").select("s_idx", "x", "y"), cell)
    return own.unionByName(near.select(F.col("id").cast("int").alias("s_idx"), F.col("s_idx").alias("node"), "distance"))


class Sides:
    """Sides of rings, sorted by their lower end, so that a path looks only at those that its height can meet."""

    def __init__(self, region: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> None:
        low = np.minimum(y1, y2)
        order = np.argsort(low, kind="stable")
        self.low, self.high = low[order], np.maximum(y1, y2)[order]
        self.region, self.x1, self.y1, self.x2, self.y2 = (v[order] for v in (region, x1, y1, x2, y2))

    def near(self, x: np.ndarray, y: np.ndarray) -> Sides:
        """The sides that lines between the given points may cross, or that lie beside them to the right."""
        end = np.searchsorted(self.low, y.max(), side="right")
        keep = np.flatnonzero((self.high[:end] >= y.min()) & (np.maximum(self.x1[:end], self.x2[:end]) >= x.min()))
        return Sides(*(v[keep] for v in (self.region, self.x1, self.y1, self.x2, self.y2)))

    def blocked(self, x: float, y: float, to_x: np.ndarray, to_y: np.ndarray) -> np.ndarray:
        """Whether the line to each point crosses a side properly or has its middle in a ring (even-odd, region by region)."""
        if not len(self.low):
            return np.zeros(len(to_x), bool)
        px, py, qx, qy = x, y, to_x[:, None], to_y[:, None]
        turn = lambda ax, ay, bx, by, cx, cy: (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        crossed = (turn(px, py, qx, qy, self.x1, self.y1) * turn(px, py, qx, qy, self.x2, self.y2) < 0) & (turn(self.x1, self.y1, self.x2, self.y2, px, py) * turn(self.x1, self.y1, self.x2, self.y2, qx, qy) < 0)
        mx, my = (px + qx) / 2, (py + qy) / 2
        dy = np.where(self.y1 == self.y2, np.inf, self.y2 - self.y1)
        hit = ((self.y1 > my) != (self.y2 > my)) & (mx < self.x1 + (my - self.y1) * (self.x2 - self.x1) / dy)
        regions = np.unique(self.region)
        inside = np.zeros(len(to_x), bool)
        for r in regions:
            inside |= hit[:, self.region == r].sum(1) % 2 == 1
        return crossed.any(1) | inside


def shortened(x: np.ndarray, y: np.ndarray, sides: Sides) -> list[int]:
    """Places of a path that stay: from each the farthest later one in sight is next, else the one after it."""
    near, out, at = sides.near(x, y), [0], 0
    while at < len(x) - 1:
        ahead = np.arange(len(x) - 1, at + 1, -1)
        seen = np.flatnonzero(~near.blocked(x[at], y[at], x[ahead], y[ahead]))
        at = int(ahead[seen[0]]) if len(seen) else at + 1
        out.append(at)
    return out


def smooth_paths(paths: DataFrame, units: DataFrame, rings: DataFrame) -> DataFrame:
    """paths (with nodes, an array of unit numbers) with smooth, its nodes after greedy shortcuts that stay off the rings, and the planar lengths before and after.

    Paths are the parallel unit; units and the sides of the rings travel to the
    tasks, their number checked. A path of up to two nodes, or one with a unit
    that the mesh lacks, keeps its nodes; the latter has null lengths, as has an
    empty one.
    """
    sides = mesh.ring_segments(rings)
    n = sides.count()
    if n > MOST_SIDES:
        raise ValueError(f"{n} sides of rings: more than {MOST_SIDES}")
    place = units.select("s_idx", "x", "y").orderBy("s_idx").toPandas()  # mesh-sized
    shared = paths.sparkSession.sparkContext.broadcast((Sides(*(sides.toPandas()[c].to_numpy() for c in ("region", "x1", "y1", "x2", "y2"))), place["s_idx"].to_numpy(), place["x"].to_numpy(), place["y"].to_numpy()))
    added = {"smooth": "array<int>", "length": "double", "smooth_length": "double"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides, ids, ux, uy = shared.value
        for pdf in batches:
            rows = []
            for nodes in pdf["nodes"]:
                at = np.searchsorted(ids, np.array(nodes if nodes is not None else [], int))
                known = len(at) > 0 and (at < len(ids)).all() and (ids[np.minimum(at, len(ids) - 1)] == np.array(nodes)).all()
                if not known:
                    rows.append((None if nodes is None else list(nodes), None, None))
                    continue
                x, y = ux[at], uy[at]
                keep = shortened(x, y, sides) if len(at) > 2 else list(range(len(at)))
                size = lambda k, x=x, y=y: float(np.hypot(np.diff(x[k]), np.diff(y[k])).sum())
                rows.append(([int(nodes[k]) for k in keep], size(np.arange(len(at))), size(np.array(keep))))
            yield pdf.assign(**{c: pd.Series([r[k] for r in rows], index=pdf.index, dtype=object if k == 0 else float) for k, c in enumerate(added)})

    kept = paths.drop(*added)
    return kept.mapInPandas(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{c} {t}" for c, t in added.items()]))
