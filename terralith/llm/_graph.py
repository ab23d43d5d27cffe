"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import deleted, written


HUBS = 1024


def with_least(edges: DataFrame, least: DataFrame, column: str) -> DataFrame:
    """``edges`` (u, ...) joined with ``least`` (u, n, ``column``), n being u's number of rows in ``edges``.

    A node with more than 1 / HUBS of all rows is a hub.  There are fewer than HUBS hubs, whatever the table, so their rows of
    ``least`` are broadcast; the other nodes are joined by key, and none of them has more rows than that.
    """
    most = max(1, edges.count() // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", F.col(column).alias("__hub")))
    rest = least.where(F.col("n") <= most).select("u", F.col(column).alias("__rest"))
    marked = edges.join(hubs, "u", "left")
    far = marked.where("__hub IS NOT NULL").withColumnRenamed("__hub", column)
    near = marked.where("__hub IS NULL").drop("__hub").join(rest, "u").withColumnRenamed("__rest", column)
    return far.unionByName(near)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for all nodes that have a link to another node; a component is named by its least node.

    Alternates large-star and small-star steps until the links no longer change; every round is written to the shared folder,
    and the round before is deleted.  The number of rounds grows with the logarithm of the longest path.  Nothing is gathered by
    node: minima are summed up before the shuffle, and a hub's links stay where they are (see ``with_least``).
    """
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", "n", F.least("u", "m").alias("m"))
        down = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
        large = written(with_least(down, least, "m").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_least(large, low, "m").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        before, edges = edges, written(small, "links")
        deleted(before, large)
        # done once every node has one link, to a node that has none of its own
        if edges.groupBy("u").count().where("count > 1").isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
