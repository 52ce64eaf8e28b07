"""Readers: tables by extension, polygon files as ring tables, and the Parquet store with its manifest."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fauntrack.operators.telemetry import LAT_NAMES, LON_NAMES, detect_column

#: Names of polygon groups and of well-known-text columns (fixed values).
GROUP_NAMES = ("region", "group", "ring", "polygon", "auid", "id")
WKT_NAMES = ("wkt_geo", "wkt", "geometry", "geom")
RINGS_DDL = "region int, seq int, x double, y double"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, ORC, CSV (header), JSON lines by extension; other formats are an error that names them."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind in ("rds", "rda", "rdata", "qs", "jld2"):
        raise ValueError(f"{path}: convert {kind} files to Parquet or CSV first")
    raise ValueError(f"{path}: unknown table format {kind!r}")


def rings_from_table(df: DataFrame, order: str | None = None) -> DataFrame:
    """Ring vertices (region, seq, x, y) from a long table of vertices or a table with a WKT column."""
    wkt = next((c for c in df.columns if c.lower() in WKT_NAMES), None)
    if wkt:
        rows = df.select(wkt).where(f"{wkt} IS NOT NULL").toPandas()[wkt]  # polygon tables are mesh-sized
        return rings_from_lists(df.sparkSession, [r for text in rows for r in wkt_rings(text)])
    x, y = detect_column(df, LON_NAMES), detect_column(df, LAT_NAMES)
    group = detect_column(df, GROUP_NAMES, required=False)
    from pyspark.sql import Window

    seq = F.col(order) if order else F.monotonically_increasing_id()
    region = F.dense_rank().over(Window.orderBy(F.col(group))) if group else F.lit(1)
    d = df.select(region.cast("int").alias("region"), seq.alias("_s"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return d.withColumn("seq", F.row_number().over(Window.partitionBy("region").orderBy("_s"))).select("region", "seq", "x", "y")


def rings_from_lists(spark: SparkSession, rings: list[list[tuple[float, float]]]) -> DataFrame:
    rows = [(k + 1, s + 1, float(p[0]), float(p[1])) for k, ring in enumerate(rings) for s, p in enumerate(ring)]
    return spark.createDataFrame(rows, RINGS_DDL)


def wkt_rings(text: str) -> list[list[tuple[float, float]]]:
    """Rings of POLYGON, MULTIPOLYGON and GEOMETRYCOLLECTION texts; rings of fewer than four points are dropped."""
    out = []
    for part in re.findall(r"\(([^()]+)\)", text):
        pts = [tuple(map(float, p.split()[:2])) for p in part.split(",") if len(p.split()) >= 2]
        if len(pts) >= 4:
            out.append(pts)
    return out


def geojson_rings(text: str) -> list[list[tuple[float, float]]]:
    """Rings of any GeoJSON object, nested ones included."""
    out: list[list[tuple[float, float]]] = []

    def walk(x) -> None:
        if isinstance(x, dict):
            kind = x.get("type")
            if kind == "FeatureCollection":
                for f in x.get("features") or []:
                    walk(f)
            elif kind == "Feature":
                walk(x.get("geometry"))
            elif kind == "GeometryCollection":
                for g in x.get("geometries") or []:
                    walk(g)
            elif kind in ("Polygon", "MultiPolygon"):
                coords(x.get("coordinates") or [])

    def coords(c) -> None:
        if c and isinstance(c[0], (list, tuple)) and c[0] and isinstance(c[0][0], (int, float)):
            out.append([(p[0], p[1]) for p in c])
        else:
            for part in c:
                coords(part)

    walk(json.loads(text))
    return out


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Rings of a GeoJSON, WKT, CSV or Parquet file."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("geojson", "wkt"):
        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        return rings_from_lists(spark, geojson_rings(text) if kind == "geojson" else wkt_rings(text))
    return rings_from_table(read_table(spark, path))


def read_regions(spark: SparkSession, files: list[str], labels: list[str]) -> DataFrame:
    """Rings of several files, one region number and label a file."""
    if len(files) != len(labels):
        raise ValueError(f"{len(files)} files and {len(labels)} labels")
    out = None
    for k, (path, label) in enumerate(zip(files, labels, strict=True), 1):
        r = read_polygons(spark, path).withColumn("region", F.lit(k)).withColumn("label", F.lit(label))
        out = r if out is None else out.unionByName(r)
    return out


def write_store(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes the tables under path as Parquet, with a manifest of names, rows and columns; the manifest is returned."""
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, df.sparkSession.read.parquet(f"{path}/{name}").count(), ",".join(df.columns)))
    spark = next(iter(tables.values())).sparkSession
    m = spark.createDataFrame(rows, "name string, n_rows long, columns string")
    m.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return m


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a store; one that the manifest names and that is missing is an error."""
    return {r["name"]: spark.read.parquet(f"{path}/{r['name']}") for r in spark.read.parquet(f"{path}/manifest").collect()}


def export_csv(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """CSV with fixed rounding by column."""
    for c, n in (digits or {}).items():
        df = df.withColumn(c, F.round(c, n))
    df.write.mode("overwrite").csv(path, header=True)
