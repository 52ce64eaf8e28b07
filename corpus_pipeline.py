"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, source mixing, packing.

Each stage takes the documents that its predecessor kept, written as Parquet in
the shared folder and read again, so that a lost executor never reaches back
over a stage. Stages 1 to 4 return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fauntrack.llm.common import free_name, materialise, sized, table
from fauntrack.llm.line_dedup import dedup_lines
from fauntrack.llm.mixing import mix_sources
from fauntrack.llm.ngram_join import jaccard_classes
from fauntrack.llm.packing import pack
from fauntrack.llm.quality import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects: null and empty texts go, rows are judged one by one, all columns stay."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats; those that lose all their text go.

    Null and empty texts have no lines to lose and stay; rows with the same
    doc_id and text are one document, and all of them are cut alike; n_chars,
    where there is such a column, follows the text; other columns stay, but for
    the three that the operator adds and that do not leave.
    """
    # columns of the documents that bear the operator's names travel under others
    own = {c: free_name(docs, f"_{c}") for c in docs.columns if c.lower() in ("n_lines", "n_dropped", "kept_sha256")}
    cut = dedup_lines(docs.withColumnsRenamed(own)).where((F.col("n_dropped") == 0) | (F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")) != ""))
    cut = cut.drop("n_lines", "n_dropped", "kept_sha256").withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id.

    Texts without words are in no class and stay, as do rows whose doc_id is
    null; of rows with the same doc_id and the same text with words one stays,
    of rows with the same doc_id and unlike texts all that their classes keep.
    """
    found = materialise(jaccard_classes(docs), "pipeline-classes")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    by_id = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(stays).alias("stays"), F.count_if(F.col("n_shingles") > 0).alias("n"))
    name = free_name(docs, "_of")
    facts = materialise(by_id.where(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias(name), "stays"), "pipeline-away")
    away, again = (sized(facts.where(x).select(name), 8) for x in (~F.col("stays"), F.col("stays")))
    kept = docs.join(away, docs["doc_id"] == F.col(name), "left_anti")
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\x09-\\x0D]")
    one_row = kept.join(again, kept["doc_id"] == F.col(name), "left_semi").where(has_words).dropDuplicates(["doc_id", "text"])
    return kept.join(again, (kept["doc_id"] == F.col(name)) & has_words, "left_anti").unionByName(one_row)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole number and at least once; what it takes no word of goes.

    Null and empty texts have no words and go; rows of one doc_id share what
    the mix takes of them; the other columns are repeated as they are.
    """
    of, copies, copy = (free_name(docs, x) for x in ("_of", "_copies", "_copy"))
    mixed = mix_sources(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("taken") > 0, F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size")).cast("int"))).otherwise(0)
    mixed = materialise(mixed.select(F.col("doc_id").alias(of), times.alias(copies)).where(F.col(copies) > 0), "pipeline-mix")
    some = docs.where(F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\x09-\\x0D]"))
    out = some.join(sized(mixed, 24), some["doc_id"].eqNullSafe(F.col(of)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as sequences of at most 2048 tokens, a row a piece; every copy of a document is packed on its own."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_to_weights", mix_to_weights),
    ("best_fit_packing", best_fit_packing),
]

#: Edit joins, PartEnum classes and tokenisation are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
