"""Takes source tables into a store once: a source that has not changed since is skipped, a changed one is written anew beside the old.

A source's state is told by its files' paths, sizes and times, as Spark lists
them. The data of each state lie in a folder of their own; a row of the manifest
says which folder holds a table. It is written after the data, so a run that is
cut off leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers

MANIFEST = "name string, digest string, folder string, files long, bytes long, newest timestamp, n_rows long, columns string"


def _missing(e: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e)


def fingerprint(spark: SparkSession, path: str) -> dict | None:
    """digest, files, bytes and newest time of the files under path; None if there are none. Contents are not read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
        one = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
        # the sum over files of their digests' halves does not hang on their order
        half = lambda k: F.sum(F.conv(F.substring(one, k, 15), 16, 10).cast("decimal(38,0)"))
        r = files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"), F.sha2(F.concat_ws("|", half(1).cast("string"), half(16).cast("string"), half(31).cast("string")), 256).alias("digest")).first()
    except Exception as e:
        if _missing(e):
            return None
        raise
    return r.asDict() if r["files"] else None


def manifest(spark: SparkSession, store: str) -> dict[str, dict]:
    """The manifest's rows by table; empty for a new store."""
    try:
        return {r["name"]: r.asDict() for r in spark.read.schema(MANIFEST).parquet(f"{store}/manifest").collect()}  # a row a table
    except Exception as e:
        if _missing(e):
            return {}
        raise


def status(spark: SparkSession, sources: dict[str, str], store: str) -> dict[str, list[str]]:
    """Names of the sources that are fresh in the store, stale, absent from it, or missing themselves."""
    known, out = manifest(spark, store), {"fresh": [], "stale": [], "absent": [], "missing": []}
    for name, path in sources.items():
        now = fingerprint(spark, path)
        kind = "missing" if now is None else "absent" if name not in known else "fresh" if known[name]["digest"] == now["digest"] else "stale"
        out[kind].append(name)
    return out


def assimilate(spark: SparkSession, sources: dict[str, str], store: str) -> dict[str, list[str]]:
    """Writes what is stale or absent, and tells names written and skipped; a missing source is an error before anything is written."""
    found = {name: fingerprint(spark, path) for name, path in sources.items()}
    missing = [name for name, now in found.items() if now is None]
    if missing:
        raise FileNotFoundError(f"no files for {', '.join(missing)}: {[sources[x] for x in missing]}")
    known, written = manifest(spark, store), []
    for name, now in found.items():
        if name in known and known[name]["digest"] == now["digest"]:
            continue
        folder = f"{store}/{name}/{now['digest'][:16]}"
        df = readers.read_table(spark, sources[name])
        df.write.mode("overwrite").parquet(folder)
        rows = spark.read.parquet(folder).count()
        row = spark.createDataFrame([(name, now["digest"], folder, now["files"], now["bytes"], now["newest"], rows, ",".join(df.columns))], MANIFEST)
        row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(f"{store}/manifest")
        written.append(name)
    return {"written": written, "skipped": [n for n in sources if n not in written]}


def read(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """The tables of the store as the manifest names them."""
    return {name: spark.read.parquet(r["folder"]) for name, r in manifest(spark, store).items()}
