"""Hexagonal meshes as tables of units and edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQRT3 = math.sqrt(3.0)


def hex_lattice(spark: SparkSession, rows: int, cols: int, radius: float) -> DataFrame:
    """Offset lattice of pointy hexagons: s_idx (from 1), row, col, x, y."""
    k = spark.range(rows * cols).select(F.col("id").cast("int").alias("k"))
    row, col = F.floor(F.col("k") / cols).cast("int"), (F.col("k") % cols).cast("int")
    x = SQRT3 * radius * F.col("col") + F.when(F.col("row") % 2 == 1, SQRT3 * radius / 2).otherwise(0.0)
    return k.select((F.col("k") + 1).alias("s_idx"), row.alias("row"), col.alias("col")).withColumns({"x": x, "y": 1.5 * radius * F.col("row")})


def hex_cover(spark: SparkSession, points: DataFrame, radius: float) -> DataFrame:
    """Lattice over the extent of points (x, y), padded by one radius, centred on their mean; numbered by y, then x."""
    e = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.avg("x"), F.avg("y")).first()
    if e[0] is None:
        raise ValueError("no points to cover")
    dx, dy = SQRT3 * radius, 1.5 * radius
    lo = lambda v, c, d: math.floor((v - radius - c) / d)
    hi = lambda v, c, d: math.ceil((v + radius - c) / d)
    rows = spark.range(lo(e[2], e[5], dy), hi(e[3], e[5], dy) + 1).select(F.col("id").alias("row"))
    cells = rows.select("row", F.explode(F.sequence(F.lit(lo(e[0], e[4], dx)), F.lit(hi(e[1], e[4], dx)))).alias("col"))
    x = e[4] + dx * F.col("col") + F.when(F.pmod("row", F.lit(2)) == 1, dx / 2).otherwise(0.0)
    cells = cells.withColumns({"x": x, "y": e[5] + dy * F.col("row")})
    return cells.withColumn("s_idx", F.row_number().over(Window.orderBy("y", "x"))).select("s_idx", "row", "col", "x", "y")


def hex_ring(x: Column, y: Column, radius: float) -> Column:
    """The six corners at 30 + 60 n degrees."""
    return F.array(*[F.struct((x + radius * math.cos(math.radians(30 + 60 * n))).alias("x"), (y + radius * math.sin(math.radians(30 + 60 * n))).alias("y")) for n in range(6)])


def hex_area(radius: float) -> float:
    return 1.5 * SQRT3 * radius * radius


def lattice_edges(units: DataFrame) -> DataFrame:
    """Six neighbours by the offset rule, both directions, weight 1: an equi-join on generated neighbour cells."""
    odd = F.pmod("row", F.lit(2)) == 1
    cell = lambda dr, dc: F.struct((F.col("row") + dr).alias("r"), (F.col("col") + dc).alias("c"))
    near = F.when(odd, F.array(cell(0, -1), cell(0, 1), cell(-1, 0), cell(-1, 1), cell(1, 0), cell(1, 1))).otherwise(F.array(cell(0, -1), cell(0, 1), cell(-1, -1), cell(-1, 0), cell(1, -1), cell(1, 0)))
    a = units.select(F.col("s_idx").alias("src"), F.explode(near).alias("n")).select("src", F.col("n.r").alias("row"), F.col("n.c").alias("col"))
    return a.join(units.select(F.col("s_idx").alias("dst"), "row", "col"), ["row", "col"]).select("src", "dst", F.lit(1.0).alias("w"))


def edges_within(units: DataFrame, distance: float) -> DataFrame:
    """Pairs of units up to a distance apart: grid cells of that size and their eight neighbours, then the exact test."""
    u = units.select("s_idx", "x", "y", F.floor(F.col("x") / distance).alias("gx"), F.floor(F.col("y") / distance).alias("gy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = u.withColumn("o", around).select(F.col("s_idx").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    j = a.join(u, ["gx", "gy"]).where(F.col("src") != F.col("s_idx"))
    return j.where(F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")) <= distance).select("src", F.col("s_idx").alias("dst"), F.lit(1.0).alias("w"))


def prune(units: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Units that stay, numbered anew from 1 (old number in old_idx), and the edges among them."""
    kept = units.where(keep).withColumnRenamed("s_idx", "old_idx").withColumn("s_idx", F.row_number().over(Window.orderBy("old_idx")))
    number = kept.select("old_idx", "s_idx")
    a, b = number.toDF("src", "_a"), number.toDF("dst", "_b")
    return kept, edges.join(a, "src").join(b, "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "w")


def land_barrier(units: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that touch land go, and land has no habitat."""
    land = units.where("is_land").select("s_idx")
    e = edges.join(land, edges["src"] == land["s_idx"], "left_anti")
    e = e.join(land, e["dst"] == land["s_idx"], "left_anti")
    return units.withColumn("hsi", F.when(F.col("is_land"), 0.0).otherwise(F.col("hsi"))), e


def ring_segments(rings: DataFrame) -> DataFrame:
    """region, x1, y1, x2, y2 from long vertices (region, seq, x, y), closed."""
    w = Window.partitionBy("region").orderBy("seq")
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rings.select("region", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead("x").over(w), first("x")).alias("x2"), F.coalesce(F.lead("y").over(w), first("y")).alias("y2"))


def in_polygons(points: DataFrame, rings: DataFrame, key: str = "s_idx") -> DataFrame:
    """(key, region) of the polygons that hold a point, by the even-odd rule.

    A segment meets a point only in the horizontal strips it spans: points and
    segments are joined on strips, so no point meets all segments.
    """
    strip = 10.0
    seg = ring_segments(rings).withColumn("s", F.explode(F.sequence(F.floor(F.least("y1", "y2") / strip), F.floor(F.greatest("y1", "y2") / strip))))
    p = points.select(F.col(key).alias("_k"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.floor(F.col("y") / strip).alias("s"))
    hit = p.join(seg, "s").where(((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))) & (F.col("_x") < F.col("x1") + (F.col("_y") - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))))
    return hit.groupBy("_k", "region").agg(F.count("*").alias("n")).where("n % 2 = 1").select(F.col("_k").alias(key), "region")


def region_map(units: DataFrame, rings: DataFrame) -> DataFrame:
    """The first region that holds each unit's centre, 0 for none."""
    inside = in_polygons(units, rings).groupBy("s_idx").agg(F.min("region").alias("region"))
    return units.select("s_idx").join(inside, "s_idx", "left").select("s_idx", F.coalesce("region", F.lit(0)).alias("region"))


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return (F.col(bx) - F.col(ax)) * (F.col(cy) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(cx) - F.col(ax))


def sever_crossing(edges: DataFrame, units: DataFrame, rings: DataFrame) -> DataFrame:
    """Edges whose segment meets no polygon side properly and whose middle is in no polygon."""
    at = lambda n: units.select(F.col("s_idx").alias(n), F.col("x").alias(f"x_{n}"), F.col("y").alias(f"y_{n}"))
    e = edges.join(at("src"), "src").join(at("dst"), "dst")
    middle = e.select(F.struct("src", "dst").alias("e"), ((F.col("x_src") + F.col("x_dst")) / 2).alias("x"), ((F.col("y_src") + F.col("y_dst")) / 2).alias("y"))
    inside = in_polygons(middle, rings, "e").select("e.src", "e.dst")
    strip = 10.0
    seg = ring_segments(rings).withColumn("s", F.explode(F.sequence(F.floor(F.least("y1", "y2") / strip), F.floor(F.greatest("y1", "y2") / strip))))
    es = e.withColumn("s", F.explode(F.sequence(F.floor(F.least("y_src", "y_dst") / strip), F.floor(F.greatest("y_src", "y_dst") / strip))))
    a, b = _turn("x_src", "y_src", "x_dst", "y_dst", "x1", "y1"), _turn("x_src", "y_src", "x_dst", "y_dst", "x2", "y2")
    c, d = _turn("x1", "y1", "x2", "y2", "x_src", "y_src"), _turn("x1", "y1", "x2", "y2", "x_dst", "y_dst")
    cross = es.join(seg, "s").where((a * b < 0) & (c * d < 0)).select("src", "dst")
    return edges.join(inside.union(cross).distinct(), ["src", "dst"], "left_anti")


def bridge_basins(edges: DataFrame, out: DataFrame) -> DataFrame:
    """For every out-of-depth unit: join each two of its in-depth neighbours that are not adjacent, at the unit's least weight."""
    near = edges.join(out.select(F.col("s_idx").alias("dst")), "dst").select(F.col("dst").alias("t"), F.col("src").alias("n"), "w")
    near = near.join(out.select(F.col("s_idx").alias("n")), "n", "left_anti")
    least = near.groupBy("t").agg(F.min("w").alias("least"))
    a, b = near.select("t", F.col("n").alias("src")), near.select("t", F.col("n").alias("dst"))
    new = a.join(b, "t").where("src < dst").join(edges.select("src", "dst"), ["src", "dst"], "left_anti").join(least, "t").groupBy("src", "dst").agg(F.sum("least").alias("w"))
    return new.union(new.select("dst", "src", "w"))


def hops(edges: DataFrame, start: int, most: int) -> DataFrame:
    """Units within `most` hops of a start, with the least number of hops: one join a ring."""
    seen = edges.sparkSession.range(1).select(F.lit(start).cast("int").alias("s_idx"), F.lit(0).alias("hops"))
    front = seen
    for h in range(1, most + 1):
        front = front.join(edges, front["s_idx"] == edges["src"]).select(F.col("dst").alias("s_idx")).distinct().join(seen, "s_idx", "left_anti").withColumn("hops", F.lit(h))
        seen = seen.union(front)
        if h % 4 == 0:
            seen = _cut(seen)
            front = seen.where(F.col("hops") == h)
    return seen


def components(units: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """s_idx, component: the least unit reachable; least-label propagation with pointer jumping."""
    label = _cut(units.select("s_idx", F.col("s_idx").alias("label")))
    for _ in range(most):
        near = edges.join(label, edges["dst"] == label["s_idx"]).groupBy("src").agg(F.min("label").alias("near"))
        new = label.join(near, label["s_idx"] == near["src"], "left").select("s_idx", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = label.select(F.col("s_idx").alias("j"), F.col("label").alias("to"))
        new = _cut(new.join(jump, F.col("label") == F.col("j"), "left").select("s_idx", "old", F.least("label", "to").alias("label")))
        label = new.select("s_idx", "label")
        if not new.where("label <> old").limit(1).count():
            return label.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        import tempfile

        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fauntrack-"))
    return df.checkpoint()


def bbox_union(points: DataFrame, pad: float, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """West, south, east, north of padded points and given bounds, within the globe."""
    b = bounds or (180.0, 90.0, -180.0, -90.0)
    return points.agg(
        F.greatest(F.lit(-180.0), F.least(F.min("lon") - pad, F.lit(b[0]))).alias("west"),
        F.greatest(F.lit(-90.0), F.least(F.min("lat") - pad, F.lit(b[1]))).alias("south"),
        F.least(F.lit(180.0), F.greatest(F.max("lon") + pad, F.lit(b[2]))).alias("east"),
        F.least(F.lit(90.0), F.greatest(F.max("lat") + pad, F.lit(b[3]))).alias("north"),
    )


def land_units(units: DataFrame, rings: DataFrame | None = None, threshold: float | None = None, radius: float = 10.0, fraction: float = 0.5) -> DataFrame:
    """units with is_land: depth at or below the threshold, centre in a polygon, or at least half the corners in one."""
    flags = units.select("s_idx", (F.col("depth") <= threshold if threshold is not None and "depth" in units.columns else F.lit(False)).alias("shallow"))
    if rings is None:
        return units.drop("is_land").join(flags, "s_idx").withColumnRenamed("shallow", "is_land")
    centre = in_polygons(units, rings).select("s_idx").distinct().withColumn("centre", F.lit(True))
    corners = units.select("s_idx", F.posexplode(hex_ring(F.col("x"), F.col("y"), radius))).select(F.struct("s_idx", "pos").alias("c"), F.col("col.x").alias("x"), F.col("col.y").alias("y"))
    share = in_polygons(corners, rings, "c").select("c").distinct().groupBy(F.col("c.s_idx").alias("s_idx")).agg(F.count("*").alias("inside"))
    d = flags.join(centre, "s_idx", "left").join(share, "s_idx", "left")
    d = d.select("s_idx", (F.col("shallow") | F.coalesce("centre", F.lit(False)) | (F.coalesce("inside", F.lit(0)) >= math.ceil(6 * fraction))).alias("is_land"))
    return units.drop("is_land").join(d, "s_idx")


def hex_mesh_in(spark: SparkSession, rings: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Units (s_idx, row, col, x, y) of the lattice about the origin whose centres lie in a ring of any region, numbered by y, then x, and their edges.

    The lattice is generated over the extent of the rings; rows are dealt over
    tasks, and centres meet ring sides by strips. Vertices that are not finite
    count for nothing; rings without a centre in them give an empty mesh.
    """
    r = rings.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    e = r.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if e[0] is None:
        raise ValueError("no vertices to fill")
    dx, dy = SQRT3 * radius, 1.5 * radius
    rows = spark.range(math.floor((e[2] - radius) / dy), math.ceil((e[3] + radius) / dy) + 1).select(F.col("id").cast("int").alias("row"))
    cells = rows.select("row", F.explode(F.sequence(F.lit(math.floor((e[0] - radius - dx / 2) / dx)), F.lit(math.ceil((e[1] + radius) / dx)))).alias("col"))
    x = dx * F.col("col") + F.when(F.pmod("row", F.lit(2)) == 1, dx / 2).otherwise(0.0)
    cells = cells.withColumns({"x": x, "y": dy * F.col("row"), "cell": F.struct("row", "col")})
    inside = in_polygons(cells, r, "cell").select("cell").distinct()
    units = cells.join(inside, "cell").drop("cell").withColumn("s_idx", F.row_number().over(Window.orderBy("row", "col"))).select("s_idx", "row", "col", "x", "y")
    return units, lattice_edges(units)
