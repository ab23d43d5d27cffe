"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key.  Within its source, rows are ordered by key: key ranges are first summed as groups, the
sums of the ranges are accumulated, and each range then accumulates its own rows, so no task sees a whole source.  A source's
budget in whole words is cut exactly: full epochs, then the rows in key order, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, source: str, size: str, cycle: int = 3, cap: int = 3) -> DataFrame:
    """(source, source_size, target), one row a source, from a column of sizes.

    Sources by code point, null last, weigh 1 to ``cycle``, repeating.  Targets share the sum of all sizes by weight, none
    above ``cap`` times its source.  With w the weights and c the caps, ordered by c/w, the water level is the largest of
    (total - caps before) / (weights from here on); it is reached where the first uncapped source begins.
    """
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1).withColumn("cap", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    levelled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return levelled.select("source", "source_size", F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, size: str, id_col: str = "doc_id", source: str = "source", seed: str = "mix", ranges: int | None = None, cycle: int = 3, cap: int = 3) -> DataFrame:
    """``docs`` with source_size, target and taken: the words that the mix takes of each row, repeats counted.

    ``size`` names a long column of sizes.  Columns of these names in ``docs`` are replaced.  Null sources form a source of
    their own; null ids are keyed as text 'null'; rows that agree in id and size are interchangeable, so reruns agree.  An
    empty table gives an empty mix.  ``ranges`` (where it isn't given: two for each shuffle partition, 256 at least) splits every
    source's keys, so that a hot source is dealt to many tasks; rows without an id have one key and are split by their size.
    """
    docs = docs.drop("source_size", "target", "taken")
    ranges = ranges or max(256, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    keyed = docs.withColumn("__key", key).withColumn("__range", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * ranges / 2**32).cast("int"))
    # the key of rows without an id parts its range: those below it, these rows by size, those above it
    nameless = F.md5(F.lit(f"{seed}:null"))
    keyed = keyed.withColumn("__part", F.when(F.col(id_col).isNull(), F.col(size)).when(F.col("__key") > nameless, 1 << 62).otherwise(-1).cast("long"))
    sums = keyed.groupBy(F.col(source).alias("source"), "__range", "__part").agg(F.sum(size).alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("__range", "__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__earlier", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    targets = source_targets(sums, "source", "range_size", cycle, cap)
    plan = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(F.col("o.source").alias("__source"), F.col("o.__range").alias("__r"), F.col("o.__part").alias("__p"), "__earlier", "source_size", "target")
    here = Window.partitionBy(source, "__range", "__part").orderBy("__key", F.col(id_col).asc_nulls_last(), size).rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("__before", F.coalesce(F.sum(size).over(here), F.lit(0)))
    placed = run.join(plan, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__range") == F.col("__r")) & (F.col("__part") == F.col("__p")))
    budget, total = F.round("target").cast("long"), F.col("source_size")
    epochs = F.when(total > 0, F.floor(budget / F.greatest(total, F.lit(1)))).otherwise(0).cast("long")
    rest = budget - epochs * total
    taken = epochs * F.col(size) + F.greatest(F.lit(0), F.least(F.col(size), rest - F.col("__earlier") - F.col("__before")))
    return placed.withColumn("taken", taken.cast("long")).drop("__key", "__range", "__part", "__source", "__r", "__p", "__earlier", "__before")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM t),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM w WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / CAST(weight AS DOUBLE), source ASC NULLS LAST)),
g AS (SELECT source, source_size, least(weight * (SELECT max(level) FROM l), CAST(3 * source_size AS DOUBLE)) AS target FROM l),
b AS (SELECT source, source_size, target, CAST(round(target) AS BIGINT) AS budget,
             CASE WHEN source_size > 0 THEN CAST(floor(CAST(round(target) AS BIGINT) / greatest(source_size, 1)) AS BIGINT) ELSE 0 END AS epochs FROM g),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p.doc_id, p.source, p.size, b.source_size, b.target,
       CAST(b.epochs * p.size + greatest(0, least(p.size, b.budget - b.epochs * b.source_size - p.before)) AS BIGINT) AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""
