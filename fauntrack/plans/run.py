"""A whole run from settings: ingest, mesh, kernel, diagnostics, and a store of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fauntrack.config import Settings
from fauntrack.functions import geo
from fauntrack.operators import agents, ecology, kernel, markov, mesh, posterior, resample, telemetry
from fauntrack.sources import readers


def prepare(spark: SparkSession, s: Settings) -> DataFrame:
    """Clean, indexed detections with tagid, ts, lon, lat, tag from the tagging file."""
    raw = readers.read_table(spark, s.tagging_file)
    tag, ts = telemetry.detect_column(raw, telemetry.TAG_NAMES), telemetry.detect_column(raw, telemetry.TIME_NAMES)
    lon, lat = telemetry.detect_column(raw, telemetry.LON_NAMES), telemetry.detect_column(raw, telemetry.LAT_NAMES)
    when = F.to_timestamp(geo.flexible_date(ts)) if dict(raw.dtypes)[ts] == "string" else F.col(ts).cast("timestamp")
    d = raw.select(F.col(tag).alias("tagid"), when.alias("ts"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), *[c for c in ("value", "is_dead") if c in raw.columns])
    d = telemetry.clean(d.withColumn("tag", F.lit(0)))
    if s.bbox:
        west, south, east, north = s.bbox
        pad = s.bbox_padding_deg
        d = d.where(F.col("lon").between(west - pad, east + pad) & F.col("lat").between(south - pad, north + pad))
    return telemetry.pairable(telemetry.index_detections(d.drop("tag"), "tagid", "ts", "lon"))


def build_mesh(spark: SparkSession, det: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Units (with is_land and habitat) and edges over the detections' extent."""
    c = det.agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).first()
    x, y = geo.to_xy_km("lon", "lat", c["lon"], c["lat"])
    if s.polygon_file:
        planar = geo.to_xy_km("x", "y", c["lon"], c["lat"])
        u, _ = mesh.hex_mesh_in(spark, readers.read_polygons(spark, s.polygon_file).select("region", "seq", planar[0].alias("x"), planar[1].alias("y")), s.hex_radius_km)
    else:
        u = mesh.hex_cover(spark, det.select(x.alias("x"), y.alias("y")), s.hex_radius_km)
    lon, lat = geo.to_lonlat("x", "y", c["lon"], c["lat"])
    u = u.withColumns({"lon": lon, "lat": lat, "is_land": F.lit(False)})
    e = mesh.edges_within(u, mesh.SQRT3 * s.hex_radius_km * 1.05)
    if s.land_polygon_files:
        rings = readers.read_regions(spark, list(s.land_polygon_files), list(s.land_polygon_files)).select("region", "seq", *[v.alias(k) for k, v in zip("xy", geo.to_xy_km("x", "y", c["lon"], c["lat"]), strict=True)])
        u = mesh.land_units(u, rings, radius=s.hex_radius_km)
        e = mesh.sever_crossing(e, u, rings)
    if s.hsi_file:
        u = u.join(readers.read_table(spark, s.hsi_file).select("s_idx", "hsi"), "s_idx", "left").na.fill(0.5, ["hsi"])
    else:
        u = u.withColumn("hsi", F.lit(0.5))
    return mesh.land_barrier(u, e)


def _chosen(pairs: DataFrame, most: int | None) -> DataFrame:
    """All pairs, or the first so many by a hash of tag and number: the same ones in every run."""
    if most is None:
        return pairs
    return pairs.orderBy(F.xxhash64("tagid", "tag"), "tagid", "tag").limit(most)


def run(spark: SparkSession, s: Settings) -> dict[str, DataFrame]:
    """Result tables of a run, written to the output store and returned.

    Barriers by depth are refused: a run reads no depths.
    """
    if s.depth_barrier_mode != "hsi_only" or s.depth_range is not None:
        raise ValueError("depth_barrier_mode and depth_range are not applied by a run; close units by land_polygon_files")
    det = prepare(spark, s)
    u, e = build_mesh(spark, det, s)
    c = det.agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).first()
    x, y = geo.to_xy_km("lon", "lat", c["lon"], c["lat"])
    placed = det.withColumns({"x": x, "y": y, "id": F.xxhash64("tagid", "tag")})
    placed = placed.join(resample.snap(placed, u, s.hex_radius_km, e).select("id", "s_idx"), "id")
    if s.time_interval != "raw":  # a row a tag and bucket, at the unit of its first detection
        b = telemetry.bucket_time(placed, s.time_interval, ())
        placed = b.select("tagid", "tag", F.col("first_ts").alias("ts"), "s_idx", F.xxhash64("tagid", "tag").alias("id")).join(u.select("s_idx", "lon", "lat", "x", "y"), "s_idx")
    pairs = telemetry.pair_consecutive(placed, unit_seconds=86400)
    k = kernel.static(u, e)
    n = u.count()
    out = {"detections": placed.drop("id"), "units": u, "edges": e, "pairs": pairs, "kernel": k}
    if "paths" in s.diagnostics:
        if "astar" in s.path_methods:
            out["paths"] = markov.paths(_chosen(pairs, s.max_paths), markov.least_cost(u, e), n)
        if "viterbi" in s.path_methods:
            out["states"] = markov.smooth_states(placed, k, u, n)
    if "corridors" in s.diagnostics:
        out["corridor_use"] = markov.corridor_use(pairs, k, n)
    if "validation" in s.diagnostics:
        chain = markov.metropolis(pairs, u, e, n, draws=s.n_samples, warmup=s.n_warmup, seed=s.seed)
        out["chain"], out["predictive_check"] = chain, posterior.predictive_check(pairs, k, n, seed=s.seed)
    if "agents" in s.diagnostics:
        if s.n_agents is None:
            starts = pairs.select(F.xxhash64("tagid", "tag").alias("tagid"), F.col("release").alias("start_node"), F.col("k").alias("n_steps"))
            out["trajectories"] = agents.heading_agents(starts, k, u, n, s.kappa, s.seed)
        else:
            out["trajectories"] = agents.forward_agents(pairs, k, u, n, s.n_agents, s.kappa, s.seed)
    if "circuit" in s.diagnostics:
        out["laplacian"] = markov.laplacian(markov.conductance(u, e))
    if "ecology" in s.diagnostics:
        out["statistics"] = ecology.path_statistics(placed)
        out["residence"] = ecology.residence(placed)
    readers.write_store(out, s.output_dir)
    return readers.read_store(spark, s.output_dir)
