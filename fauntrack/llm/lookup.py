"""Joining many small rows to a table of corpus counts without a hot task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least one in this many of all rows is broadcast, so at most so many keys are, whatever the input.
HEAD_KEYS = 1 << 17


def join_counts(rows: DataFrame, facts: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """rows joined on `key` to facts, a written table with one row a key.

    weight is the column of facts that tells how many of rows have the key. Keys
    with a HEAD_KEYS-th of all rows or more are broadcast (there are HEAD_KEYS at
    most); rows of the others are shuffled, none of whose keys is frequent. Where
    facts has no more than HEAD_KEYS rows, all of it is broadcast. how is inner
    or left; rows with a null key meet nothing.
    """
    n, total = facts.agg(F.count("*"), F.sum(weight)).first()
    if n <= HEAD_KEYS:
        return rows.join(F.broadcast(facts), key, how)
    frequent = F.col(weight) * HEAD_KEYS >= total
    head = facts.where(frequent)
    tail = rows.join(F.broadcast(head.select(key)), key, "left_anti").join(facts.where(~frequent), key, how)
    return rows.join(F.broadcast(head), key).unionByName(tail)
