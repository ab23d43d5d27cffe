"""Statistics of bands and objects: moments, quantiles, histogram entropy, correlation, spectral indices, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terralith.sources.parts import settled


def valid(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def melted(pixels: DataFrame, bands: list[str], *keys: str) -> DataFrame:
    """(keys, band, x): one row for each valid value."""
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("x")) for b in bands)))
    return pixels.select(*keys, each.alias("e")).select(*keys, "e.band", "e.x").where(valid(F.col("x")))


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of [low, high], the last one closed; 0 if all values are equal."""
    return F.least(F.coalesce(F.floor(F.try_divide(x - low, high - low) * bins), F.lit(0)), F.lit(bins - 1))


def moments(x: Column) -> list[Column]:
    """Skewness and excess kurtosis of a population; 0 for up to 2 values or equal ones."""
    rule = lambda m: F.when(F.count(x) > 2, F.coalesce(m, F.lit(0.0))).otherwise(0.0)
    return [rule(F.skewness(x)), rule(F.kurtosis(x))]


def band_statistics(pixels: DataFrame, bands: list[str], bins: int = 256) -> DataFrame:
    """A row a band: mean, population variance and deviation, skewness and excess kurtosis (null if constant), histogram
    entropy in bits, number of valid values.  A band without valid values has no row."""
    long = melted(pixels, bands)
    x = F.col("x")
    base = long.groupBy("band").agg(F.avg(x).alias("media"), F.var_pop(x).alias("varianza"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("asimetria"), F.kurtosis(x).alias("curtosis"), F.count(x).alias("total_pixeles"), F.min(x).alias("low"), F.max(x).alias("high"))
    binned = long.join(F.broadcast(base.select("band", "low", "high", "total_pixeles")), "band").groupBy("band", bin_of(x, F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"), F.first("total_pixeles").alias("total"))
    p = F.col("n") / F.col("total")
    entropy = binned.groupBy("band").agg(F.abs(F.sum(-p * F.log2(p))).alias("entropia"))
    return base.drop("low", "high").join(F.broadcast(entropy), "band")


#: Rows of an object and band from which its quantiles are found by selection, in many tasks.
LARGE = 1_000_000
#: Values that one task puts in order, so that its memory does not grow with the input.
PER_TASK = 1_000_000
RANGES = 256


def quantiles(rows: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by, q0, q1 ...): exact quantiles of x, interpolated between ranks, with no task that holds a group.

    Values are counted by ranges that approximate quantiles cut, equal values as one; the counts say which ranges hold the ranks
    that are asked for, and only those ranges are put in order, each for itself.
    """
    rows = rows.where("x IS NOT NULL")
    cuts = rows.groupBy(by).agg(F.percentile_approx("x", [k / RANGES for k in range(1, RANGES)], 4 * RANGES).alias("cuts"))
    ranged = rows.join(cuts, by).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("x"))))
    values = ranged.groupBy(*by, "range", "x").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    counts = values.groupBy(*by, "range").agg(F.sum("n").alias("n")).withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(by))})
    place = lambda q: q * (F.col("total") - 1)
    ends = [F.struct(F.lit(2 * i + up).alias("which"), (f(place(q))).cast("long").alias("rank")) for i, q in enumerate(shares) for up, f in enumerate((F.floor, F.ceil))]
    asked = counts.withColumn("e", F.explode(F.array(*ends))).where((F.col("e.rank") >= F.col("before")) & (F.col("e.rank") < F.col("before") + F.col("n")))
    asked = asked.select(*by, "range", "total", "before", "e.which", "e.rank")
    order = Window.partitionBy(*by, "range").orderBy("x")
    needed = values.join(asked.select(*by, "range").distinct(), [*by, "range"], "left_semi")
    inside = needed.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    hits = inside.join(asked, [*by, "range"]).where((F.col("before") + F.col("upto") > F.col("rank")) & (F.col("before") + F.col("upto") - F.col("n") <= F.col("rank")))
    at = lambda w: F.max(F.when(F.col("which") == w, F.col("x")))
    found = hits.groupBy(by).agg(F.first("total").alias("total"), *(at(w).alias(f"v{w}") for w in range(2 * len(shares))))
    part = lambda q: place(q) - F.floor(place(q))
    return found.select(*by, *(((1 - part(q)) * F.col(f"v{2 * i}") + part(q) * F.col(f"v{2 * i + 1}")).alias(f"q{i}") for i, q in enumerate(shares)))


def object_band_statistics(pixels: DataFrame, bands: list[str], key: str = "objeto_id", bins: int = 16, large: int = LARGE) -> DataFrame:
    """A row for each object and band: n, mean, median, std, min, max, p25, p75, skew, kurt, mad, entropy.

    One shuffle by object and band carries the windows and both groupings.  Objects of more than ``large`` rows, of which there
    are few by nature, take sums, histograms and ``quantiles`` instead, which spread over all tasks; the results are the same.
    """
    counts = pixels.groupBy(key).agg(F.count("*").alias("n")).persist()
    few, total = counts.agg(F.count_if(F.col("n") > large), F.coalesce(F.sum("n"), F.lit(0))).head()
    parts = -(-total * len(bands) // PER_TASK)
    if not few:
        return _small_objects(melted(pixels, bands, key), key, bins, parts)
    sizes = counts.where(F.col("n") > large).select(key)
    mark = F.broadcast(sizes) if few <= 100_000 else sizes
    small = _small_objects(melted(pixels.join(mark, key, "left_anti"), bands, key), key, bins, parts)
    return small.unionByName(_large_objects(melted(pixels.join(mark, key, "left_semi"), bands, key), key, bins))


def _large_objects(long: DataFrame, key: str, bins: int) -> DataFrame:
    by, x = [key, "band"], F.col("x")
    skew, kurt = moments(x)
    base = long.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), skew.alias("skew"), kurt.alias("kurt"))
    binned = long.join(base.select(*by, "min", "max", F.col("n").alias("total")), by).groupBy(*by, bin_of(x, F.col("min"), F.col("max"), bins).alias("bin")).agg(F.count("*").alias("c"), F.first("total").alias("total"))
    share = F.col("c") / F.col("total")
    entropy = binned.groupBy(by).agg(F.abs(F.sum(-share * F.log2(share))).alias("entropy"))
    q = quantiles(long, by, [0.25, 0.5, 0.75]).select(*by, F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"))
    apart = long.join(q.select(*by, "median"), by).select(*by, F.abs(x - F.col("median")).alias("x"))
    mad = quantiles(apart, by, [0.5]).select(*by, F.col("q0").alias("mad"))
    whole = base.join(q, by).join(mad, by).join(entropy, by)
    return whole.select(*by, "n", "mean", "median", "std", "min", "max", "p25", "p75", "skew", "kurt", "mad", "entropy")


def _small_objects(values: DataFrame, key: str, bins: int, parts: int) -> DataFrame:
    if parts > int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        values = values.repartition(parts, key, "band")
    by = Window.partitionBy(key, "band")
    x = F.col("x")
    long = values.withColumns({"m": F.median(x).over(by), "low": F.min(x).over(by), "high": F.max(x).over(by)})
    placed = long.withColumn("bin", bin_of(x, F.col("low"), F.col("high"), bins))
    placed = placed.withColumn("share", F.count("*").over(Window.partitionBy(key, "band", "bin")) / F.count("*").over(by))
    skew, kurt = moments(x)
    return placed.groupBy(key, "band").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.first("m").alias("median"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.percentile(x, F.lit(0.25)).alias("p25"), F.percentile(x, F.lit(0.75)).alias("p75"), skew.alias("skew"), kurt.alias("kurt"),
        F.median(F.abs(x - F.col("m"))).alias("mad"), F.abs(F.avg(-F.log2("share"))).alias("entropy"),
    )


def normalized_index(pixels: DataFrame, a: str, b: str, name: str, key: str = "objeto_id") -> DataFrame:
    """Mean, population deviation, least and greatest (a - b) / (a + b) by object, 0 where the sum is 0; rows without a valid
    value of both are left out."""
    d = F.col(a) + F.col(b)
    ratio = F.when(d != 0, (F.col(a) - F.col(b)) / F.when(d != 0, d)).otherwise(0.0)
    rows = pixels.where(valid(F.col(a)) & valid(F.col(b))).select(key, ratio.alias("v"))
    return rows.groupBy(key).agg(F.avg("v").alias(f"{name}_mean"), F.stddev_pop("v").alias(f"{name}_std"), F.min("v").alias(f"{name}_min"), F.max("v").alias(f"{name}_max"))


def ndvi(pixels: DataFrame, nir: str, red: str, key: str = "objeto_id") -> DataFrame:
    return normalized_index(pixels, nir, red, "ndvi", key)


def ndwi(pixels: DataFrame, green: str, nir: str, key: str = "objeto_id") -> DataFrame:
    return normalized_index(pixels, green, nir, "ndwi", key)


def safe_corr(a: str, b: str) -> Column:
    """Pearson's r over rows that hold both; null if either is constant."""
    both = valid(F.col(a)) & valid(F.col(b))
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def gram(rows: DataFrame, columns: list[str], centre: dict[str, float]) -> DataFrame:
    """(i, j, n, sa, sb, saa, sbb, sab): for each two columns (i <= j) sums over the rows that hold both.

    Each task adds up matrices of its rows, about a centre that keeps digits; one row a column and task is shuffled.
    """
    shift = np.array([centre[c] for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(columns)
        n, sa, saa, sab = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1) - shift
            m = np.isfinite(x).astype(float)
            x = np.where(m > 0, x, 0)
            n += m.T @ m
            sa += x.T @ m
            saa += (x * x).T @ m
            sab += x.T @ x
        out = [pa.array(list(v), pa.list_(pa.float64())) for v in (n, sa, sa.T, saa, saa.T, sab)]
        yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), *out], names=["i", "n", "sa", "sb", "saa", "sbb", "sab"])

    names = ["n", "sa", "sb", "saa", "sbb", "sab"]
    parts = rows.select(*(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(run, "i int, " + ", ".join(f"{c} array<double>" for c in names))
    cells = parts.select("i", F.posexplode(F.arrays_zip(*names)).alias("j", "v")).where("i <= j")
    return cells.groupBy("i", "j").agg(*(F.sum(f"v.{c}").alias(c) for c in names))


def wide_pearson(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``pearson`` for many columns: sums of matrices instead of an aggregate for each pair."""
    clean = lambda c: F.when(valid(F.col(c)), F.col(c).cast("double"))
    means = rows.agg(*(F.avg(clean(c)).alias(c) for c in columns)).head().asDict()
    flat = rows.agg(*((F.min(clean(c)) == F.max(clean(c))).alias(c) for c in columns)).head().asDict()
    s = gram(rows, columns, {c: m or 0.0 for c, m in means.items()}).where("i < j")
    top = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    spread = lambda a, b: F.greatest(F.col(a) - F.col(b) * F.col(b) / F.col("n"), F.lit(0.0))
    r = F.try_divide(top, F.sqrt(spread("saa", "sa")) * F.sqrt(spread("sbb", "sb")))
    constant = F.array(*(F.lit(bool(flat[c])) for c in columns))
    names = F.array(*map(F.lit, columns))
    return s.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.when(~constant[F.col("i")] & ~constant[F.col("j")] & (F.col("n") > 0), r).alias("r"))


WIDE = 16  # more columns than this are correlated by matrices


def pearson(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for i < j, all from one aggregation."""
    if len(columns) > WIDE:
        return wide_pearson(rows, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*(safe_corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("e")).select("e.*")


def average_ranks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x, rank): the average rank of each distinct value of a column; a value counts as often as it occurs.

    Distinct values are cut into ranges and put in order within them, so no task holds a column.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns)))
    values = settled(rows.select(each.alias("e")).groupBy("e.column", "e.x").agg(F.count("*").alias("n")), "values")
    cuts = values.groupBy("column").agg(F.percentile_approx("x", [k / RANGES for k in range(1, RANGES)], 4 * RANGES).alias("cuts"))  # a row for each column
    ranged = values.join(F.broadcast(cuts), "column").withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    earlier = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    before = ranged.groupBy("column", "range").agg(F.sum("n").alias("n")).select("column", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("column", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("upto", inside).join(F.broadcast(before), ["column", "range"]).select("column", "x", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


BROADCAST = 200_000  # distinct values of a column whose ranks go to all tasks


def spearman(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for i < j by average ranks, over rows without a missing value.  Ranks are those of distinct values, joined to the rows."""
    full = rows.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    ranks = settled(average_ranks(full, columns), "ranks")
    many = {r["column"] for r in ranks.groupBy("column").agg(F.count("*").alias("n")).where(F.col("n") > BROADCAST).collect()}
    for c in columns:
        one = ranks.where(F.col("column") == c).select(F.col("x").alias("__x"), F.col("rank").alias("__rank"))
        joined = full.join(one if c in many else F.broadcast(one), F.col(c) == F.col("__x"))
        full = joined.withColumn(c, F.col("__rank")).drop("__x", "__rank")
    return pearson(full, columns)


def mean_abs_correlation(correlations: DataFrame, n: int) -> DataFrame:
    """Mean |r| off the diagonal, undefined r counting as 0; 0 for one column."""
    return correlations.agg(F.coalesce(F.sum(F.abs("r")) * 2 / F.lit(max(1, n * (n - 1))), F.lit(0.0)).alias("mean_abs_correlation"))


def positional(pixels: DataFrame, bands: list[str], order: list[str]) -> DataFrame:
    """(k, bands): valid values of each band numbered in order and put side by side, cut to the shortest band: pixels are
    mis-paired where the bands' gaps differ.

    A number is the place among the values that agree in the first column of ``order`` (a raster's row, an object), after all
    values that come earlier in it: what one window holds is one such row, and one number for each.
    """
    out = None
    for b in bands:
        one = pixels.where(valid(F.col(b))).select(*order, b)
        strips = one.groupBy(order[0]).agg(F.count("*").alias("__n"))
        earlier = F.coalesce(F.sum("__n").over(Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:]))
        numbered = one.withColumn("__k", inside).join(strips.select(order[0], earlier.alias("__before")), order[0])
        one = numbered.select((F.col("__before") + F.col("__k")).alias("k"), b)
        out = one if out is None else out.join(one, "k")
    return out


def standardized(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores by population deviation (0: 1)."""
    s = rows.agg(*(f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("m", F.avg), ("s", F.stddev_pop))))
    joined = rows.crossJoin(F.broadcast(s))  # one row
    scaled = {c: (F.col(c) - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0) for i, c in enumerate(columns)}
    return joined.withColumns(scaled).select(rows.columns)


def covariance(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, sample covariance, rows): in one aggregation, or for many columns by sums of matrices."""
    if len(columns) > WIDE:
        return wide_covariance(rows, columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    r = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).head()
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] or 0.0
    return np.array([r[f"m{i}"] or 0.0 for i in range(len(columns))]), cov, r["n"]


def wide_covariance(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """``covariance`` for many columns, whose aggregates would be too many for one plan; a row for each two columns is collected."""
    clean = lambda c: F.when(valid(F.col(c)), F.col(c).cast("double"))
    one = rows.agg(F.count("*").alias("n"), *(F.avg(clean(c)).alias(f"m{i}") for i, c in enumerate(columns))).head()
    means = np.array([one[f"m{i}"] or 0.0 for i in range(len(columns))])
    cov = np.zeros((len(columns), len(columns)))
    for r in gram(rows, columns, dict(zip(columns, means.tolist(), strict=True))).collect():
        if r["n"] > 1:
            cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = (r["sab"] - r["sa"] * r["sb"] / r["n"]) / (r["n"] - 1)
    return means, cov, one["n"]


def components(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit vectors as columns) of standardised columns, greatest first, signs set by the largest loading."""
    _, cov, _ = covariance(rows, columns)
    d = np.sqrt(np.diag(cov))
    d[d == 0] = 1
    values, vectors = np.linalg.eigh(cov / np.outer(d, d))
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    return np.maximum(values, 0), vectors * np.where(signs == 0, 1, signs)


def pca(rows: DataFrame, columns: list[str], share: float = 0.95) -> DataFrame:
    """(component, ratio, cumulative, effective_dim): shares of the variance of the standardised columns."""
    values, _ = components(rows.dropna(subset=columns), columns)
    total = values.sum() or 1.0
    spark = rows.sparkSession
    table = spark.createDataFrame([(k + 1, float(v / total)) for k, v in enumerate(values)], "component int, ratio double")
    run = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as columns
    table = table.withColumn("cumulative", F.sum("ratio").over(run))
    reached = F.min(F.when(F.col("cumulative") >= share - 1e-12, F.col("component"))).over(Window.partitionBy(F.lit(0)))
    return table.withColumn("effective_dim", F.coalesce(reached, F.lit(1)))


def loadings(rows: DataFrame, columns: list[str], first: int = 3) -> DataFrame:
    """(component, variable, loading) of the first components."""
    _, vectors = components(rows.dropna(subset=columns), columns)
    return rows.sparkSession.createDataFrame([(k + 1, c, float(vectors[i, k])) for k in range(min(first, len(columns))) for i, c in enumerate(columns)], "component int, variable string, loading double")
