"""Joins of many rows with a lookup table of any size, with no key's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a lookup table that are sent to every executor: some tens of MB at most.
SENT = 200_000


def attach(left: DataFrame, right: DataFrame, key: str, sent: int = SENT) -> DataFrame:
    """The rows of ``left`` with the columns of their row of ``right``, which has distinct values of ``key``; nulls are equal.

    A ``right`` of ``sent`` rows or fewer is broadcast.  A longer one is joined by a shuffle, but for keys that hold more than
    one part in as many as there are shuffle partitions of ``left``: by their definition they are no more than that, so their
    rows of ``right`` are broadcast.  Both ways give the same rows.  The tables are read more than once: pass written ones.
    """
    other = right.withColumnRenamed(key, "__key")
    on = F.col(key).eqNullSafe(F.col("__key"))
    if right.count() <= sent:
        return left.join(F.broadcast(other), on).drop("__key")
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = left.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n"))
    hot = F.broadcast(counts.where(F.col("__n") > max(1, left.count() // parts)).select("__hot"))
    few = other.join(hot, F.col("__key").eqNullSafe(F.col("__hot")), "left_semi")
    ours = left.join(F.broadcast(few), on)
    rest = left.join(hot, F.col(key).eqNullSafe(F.col("__hot")), "left_anti").join(other, on)
    return ours.unionByName(rest).drop("__key")

