"""How well classes separate in a feature table: collinearity, mutual information, clusters, correspondence, distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terralith.operators.stats import WIDE, components, pearson, standardized, valid
from terralith.sources.parts import settled


RANGES = 64  # of a variable's values, in mutual information


class MissingValuesError(ValueError):
    """Features hold nulls or NaN and no policy says what to do."""


def feature_columns(features: DataFrame, key: str = "objeto_id", clase: str = "clase") -> list[str]:
    """Columns whose sample deviation is above 0, in the table's order; keys and what is no number are left out."""
    numeric = [c for c, t in features.dtypes if t in ("double", "float", "int", "bigint") and c not in (key, clase)]
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = features.agg(*(F.stddev_samp(clean(c)).alias(c) for c in numeric)).head() if numeric else {}
    return [c for c in numeric if row[c] is not None and row[c] > 0]


def without_missing(features: DataFrame, columns: list[str], nulls: str = "error") -> DataFrame:
    """``nulls``: "error" raises MissingValuesError, "drop" drops the rows, "mean" fills in the column's mean."""
    numbers = features.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns})
    if nulls == "drop":
        return numbers.dropna(subset=columns)
    if nulls == "mean":
        row = numbers.agg(*(F.avg(c).alias(c) for c in columns)).head().asDict()
        return numbers.fillna({c: v for c, v in row.items() if v is not None}, subset=columns)
    row = numbers.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).head().asDict()
    if bad := [c for c, n in row.items() if n]:
        raise MissingValuesError(f"missing values in {', '.join(bad)}")
    return numbers


def collinear_pairs(features: DataFrame, columns: list[str], threshold: float = 0.85) -> DataFrame:
    """(a, b, r) with |r| above the threshold."""
    return pearson(features, columns).where(F.abs("r") > threshold)


def redundant_ratio(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.agg((F.count("*") / F.lit(max(1, n))).alias("redundant_ratio"))


def mutual_information(features: DataFrame, columns: list[str], clase: str = "clase", k: int = 3) -> DataFrame:
    """(variable, mi) by Ross's nearest-neighbour estimator, all columns in one job.

    All is done for a distinct value of a column and class, which counts as often as it occurs.  A column's values are cut into RANGES
    ranges, and no window is wider than one of them: in one dimension the k-th neighbour of the own class is among the k values on either
    side in the class's order, and a range gets the k last values of those before it and the k first of those behind it.  The number
    of points nearer than that neighbour comes from bounds that are sorted in among the points.  digamma at whole numbers is a
    harmonic sum.  Missing values, and values that are alone in their class, are left out.
    """
    long = features.select(F.col(clase).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns))).alias("e")).select(F.coalesce(F.concat(F.lit("="), F.col("y").cast("string")), F.lit("")).alias("y"), "e.*").where("x IS NOT NULL")
    values = settled(long.groupBy("variable", "y", "x").agg(F.count("*").alias("times")), "values")
    cuts = values.groupBy("variable").agg(F.percentile_approx("x", [k / RANGES for k in range(1, RANGES)], 1000).alias("cuts"))  # a row for each column
    values = values.join(F.broadcast(cuts), "variable").select("variable", "y", "x", "times", range_of(F.col("x")).alias("range"))

    group = ["variable", "y", "range"]
    order = Window.partitionBy(*group).orderBy("x")
    seen = F.struct("x", "times")
    rows = values.withColumns({"around": F.filter(F.array(*(f(seen, d).over(order) for f in (F.lag, F.lead) for d in range(1, k + 1))), lambda v: v.isNotNull())})
    rows = rows.withColumns({"head": F.lag("x", k).over(order).isNull(), "tail": F.lead("x", k).over(order).isNull()})
    ends = rows.where("head OR tail").groupBy(*group).agg(F.collect_list(F.when(F.col("head"), seen)).alias("heads"), F.collect_list(F.when(F.col("tail"), seen)).alias("tails"))  # 2k values at most
    by_class = Window.partitionBy("variable", "y").orderBy("range")  # a row for each range that holds something
    beside = F.concat(F.flatten(F.collect_list("tails").over(by_class.rowsBetween(-k, -1))), F.flatten(F.collect_list("heads").over(by_class.rowsBetween(1, k))))
    sizes = values.groupBy("variable", "y").agg(F.sum("times").alias("nc")).where("nc > 1")
    rows = rows.join(ends.select(*group, beside.alias("beside")), group).join(sizes, ["variable", "y"])

    own = F.struct(F.col("x"), (F.col("times") - 1).alias("times"))  # the value itself, where it stands again
    far = F.array_sort(F.transform(F.concat(F.array(own), "around", "beside"), lambda v: F.struct(F.abs(v["x"] - F.col("x")).alias("d"), v["times"].alias("times"))))
    rows = rows.withColumns({"kk": F.least(F.lit(k), F.col("nc") - 1), "far": far})
    # the first value up to which kk points are counted
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d"))
    step = lambda s, e: F.when(s["n"] >= F.col("kk"), s).otherwise(F.struct((s["n"] + e["times"]).alias("n"), e["d"].alias("d")))
    rows = rows.withColumn("kth", F.aggregate("far", start, step))
    rows = rows.withColumn("b", nearer_than("x", "kth.d"))
    rows = settled(rows.select("variable", "y", "x", "times", "kk", "nc", "b.low", "b.high"), "neighbours")
    # marks: points add their number; a bound counts the points below (upper) or up to it (lower)
    mark = lambda at, turn, sign: F.struct(at.alias("at"), F.lit(turn).alias("turn"), F.lit(sign).alias("sign"))
    marks = rows.select("variable", "y", "x", F.explode(F.array(mark(F.col("low"), 2, -1), mark(F.col("high"), 0, 1))).alias("m"), F.lit(0).cast("long").alias("times")).select("variable", "y", "x", "times", "m.*")
    marks = marks.unionByName(values.select("variable", "y", "x", "times", F.col("x").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("sign")))
    ranged = marks.join(F.broadcast(cuts), "variable").withColumn("range", range_of(F.col("at"))).drop("cuts")
    earlier = F.coalesce(F.sum("points").over(Window.partitionBy("variable").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = ranged.groupBy("variable", "range").agg(F.sum("times").alias("points")).withColumn("before", earlier).drop("points")
    inside = F.sum("times").over(Window.partitionBy("variable", "range").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("inside", inside).where("sign <> 0").join(before, ["variable", "range"])
    m = placed.groupBy("variable", "y", "x").agg(F.greatest(F.sum((F.col("before") + F.col("inside")) * F.col("sign")), F.lit(1)).alias("m"))
    counts = rows.select("variable", "y", "x", "times", "kk", "nc").join(m, ["variable", "y", "x"])
    terms = counts.select("variable", F.lit(1).alias("one"), F.explode(F.array(*(F.struct(F.col(c).cast("long").alias("n"), (F.lit(s) * F.col("times")).alias("s")) for c, s in (("kk", 1), ("nc", -1), ("m", -1))))).alias("t")).groupBy("variable", "t.n").agg(F.sum("t.s").alias("s"))
    total = counts.groupBy("variable").agg(F.sum("times").alias("total"))
    psi = lambda n: digamma(n)
    means = terms.join(total, "variable").groupBy("variable").agg(F.first("total").alias("total"), F.sum(psi(F.col("n")) * F.col("s") / F.col("total")).alias("v"))
    return means.select("variable", F.greatest(psi(F.col("total")) + F.col("v"), F.lit(0.0)).alias("mi"))


def range_of(x: Column) -> Column:
    """How many of the column ``cuts`` (in order, RANGES - 1) lie below: first of each eighth one, then of those between."""
    eighths = F.size(F.filter(F.transform(F.sequence(F.lit(8), F.lit(RANGES - 8), F.lit(8)), lambda i: F.get("cuts", i - 1)), lambda c: c < x))
    return eighths * 8 + F.size(F.filter(F.slice("cuts", eighths * 8 + 1, 7), lambda c: c < x))


def last_at(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The greatest double q up to x with x - q >= d, by bisection over the doubles in order: the difference is rounded, x - d too."""

    def number(q: np.ndarray) -> np.ndarray:
        bits = q.view(np.int64)
        return np.where(bits < 0, -(bits & np.int64(2**63 - 1)), bits)

    def double(k: np.ndarray) -> np.ndarray:
        return np.where(k < 0, -np.abs(k).view(float), np.abs(k).view(float))

    with np.errstate(over="ignore"):
        low, high = number(x - 2 * d), number(x + 0.0)  # holds at low, and nowhere above high
        high = np.maximum(low, high) + 1
        for _ in range(66):
            wide = low + 1 < high
            if not wide.any():
                break
            mid = (low >> 1) + (high >> 1) + (low & high & 1)  # their difference may be beyond 64 bits
            held = x - double(mid) >= d
            low, high = np.where(wide & held, mid, low), np.where(wide & ~held, mid, high)
        return double(low)


def nearer_than(x: str, d: str) -> Column:
    """(low, high): of all doubles, just those between them differ from x by less than d when differences are rounded."""

    @F.pandas_udf("low double, high double")
    def bounds(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            v, w = a.to_numpy(float), b.to_numpy(float)
            yield pd.DataFrame({"low": last_at(v, w), "high": -last_at(-v, w)})

    return bounds(x, d)


def digamma(n: Column) -> Column:
    """At whole numbers; exact sums up to 64, an asymptotic series (to 1e-16) beyond."""
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4))) - 1 / (252 * F.pow(x, F.lit(6)))
    small = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(64)).cast("int")), F.lit(-0.5772156649015329), lambda s, i: s + F.when(i < n, 1 / i).otherwise(0.0))
    return F.when(n <= 64, small).otherwise(series)


def ranked(mi: DataFrame, columns: list[str]) -> DataFrame:
    """By falling information; ties in the columns' order."""
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("variable"))
    return mi.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mi"), place)))


def prune_collinear(features: DataFrame, columns: list[str], clase: str = "clase", threshold: float = 0.85) -> list[str]:
    """Columns that stay when of each collinear pair, taken in column order, the less informative one goes (a tie: the later).

    Once a column has lost, its other pairs are left alone.  One correlation and one information job; the rest is over columns.
    """
    pairs = {(r["a"], r["b"]) for r in collinear_pairs(features, columns, threshold).collect()}
    mi = {r["variable"]: r["mi"] for r in mutual_information(features, columns, clase).collect()}
    gone: set[str] = set()
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            if a in gone:
                break
            if b not in gone and (a, b) in pairs:
                gone.add(b if mi.get(a, 0.0) >= mi.get(b, 0.0) else a)
    return [c for c in columns if c not in gone]


def elbow(inertia: DataFrame) -> DataFrame:
    """(k, inertia, gap, selected): distance from the line between the first and last k; the first of the greatest wins."""
    ends = inertia.agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min_by("inertia", "k").alias("i0"), F.max_by("inertia", "k").alias("i1"), F.count("*").alias("n"))
    rows = inertia.crossJoin(F.broadcast(ends))  # one row
    a, b = F.col("i1") - F.col("i0"), F.col("k0") - F.col("k1")
    c = F.col("k1") * F.col("i0") - F.col("k0") * F.col("i1")
    norm = F.sqrt(a * a + b * b)
    gap = F.coalesce(F.try_divide(F.abs(a * F.col("k") + b * F.col("inertia") + c), norm), F.lit(0.0))
    rows = rows.select("k", "inertia", F.when(F.col("n") < 3, 0.0).otherwise(gap).alias("gap"))
    best = F.max(F.struct(F.round("gap", 12).alias("g"), (-F.col("k")).alias("k"))).over(Window.partitionBy(F.lit(0)))  # a row for each k
    return rows.withColumn("selected", -best["k"] == F.col("k"))


def square_gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0)


def first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of the sample, each drawn in proportion to its squared distance from the nearest one drawn before."""
    rng = np.random.default_rng(seed)
    centres = sample[[rng.integers(len(sample))]]
    while len(centres) < k:
        gap = square_gaps(sample, centres).min(1)
        at = rng.choice(len(sample), p=gap / gap.sum()) if gap.sum() > 0 else rng.integers(len(sample))
        centres = np.vstack([centres, sample[at]])
    return centres


def cluster_sums(rows: DataFrame, columns: list[str], centres: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple[float, float, np.ndarray]]:
    """By run and cluster: members, their squared distances and their sum, for all runs in one pass over ``rows`` (x, the columns
    in one array)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(columns))
            for run, c in centres.items():
                gap = square_gaps(x, c)
                at = gap.argmin(1)
                hot = np.eye(len(c))[at]
                n, cost, t = total.get(run, (0, 0.0, 0.0))
                total[run] = n + hot.sum(0), cost + gap.min(1) @ hot, t + hot.T @ x
        for run, (n, cost, t) in total.items():
            each = np.column_stack([n, cost, t])
            at = np.full(each.size, run, np.int32), np.repeat(np.arange(len(n), dtype=np.int32), each.shape[1]), np.tile(np.arange(each.shape[1], dtype=np.int32), len(n))
            yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(each.ravel())], names=["run", "k", "i", "x"])

    parts = rows.mapInArrow(sums, "run int, k int, i int, x double")
    # a row for each run, cluster and column, whatever the number of objects
    found = parts.groupBy("run", "k", "i").agg(F.sum("x").alias("x")).toArrow().sort_by([("run", "ascending"), ("k", "ascending"), ("i", "ascending")])
    runs, ks, x = (found[c].to_numpy() for c in ("run", "k", "x"))
    width = len(columns) + 2
    return {(int(runs[j]), int(ks[j])): (x[j], x[j + 1], x[j + 2 : j + width]) for j in range(0, len(x), width)}


def fitted_centres(rows: DataFrame, columns: list[str], centres: dict[int, np.ndarray], steps: int = 100, tol: float = 1e-4) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """(centres, inertia) by run, after Lloyd's steps that all runs take together; a run rests when no centre moves further than
    ``tol``.  A cluster without members keeps its centre."""
    centres, active = dict(centres), set(centres)
    for _ in range(steps):
        if not active:
            break
        found = cluster_sums(rows, columns, {run: centres[run] for run in active})
        for run in sorted(active):
            old = centres[run]
            new = np.stack([found[run, k][2] / found[run, k][0] if found[run, k][0] else c for k, c in enumerate(old)])
            centres[run] = new
            if np.sqrt(((new - old) ** 2).sum(1)).max() <= tol:
                active.discard(run)
    found = cluster_sums(rows, columns, centres)
    return centres, {run: sum(found[run, k][1] for k in range(len(c))) for run, c in centres.items()}


def kmeans(features: DataFrame, columns: list[str], key: str = "objeto_id", most: int = 8, starts: int = 10, seed: int = 42, sample: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(k, inertia, silhouette, davies_bouldin, gap, selected) for k from 2, and (key, cluster) of the selected k.

    Columns are standardised; of ``starts`` runs the one with the least inertia counts (a tie: the first).  All runs of all k take
    their steps together, so a fit reads the rows as often as the slowest run has steps.  First centres are drawn from ``sample``
    rows taken by the hash of their key; every step, inertia and measure is over all rows.  A missing value is an error.
    """
    rows = standardized(features.select(key, *columns), columns).persist()
    complete = F.lit(True)
    for c in columns:
        complete = complete & valid(F.col(c).cast("double"))
    n, full = rows.agg(F.count("*"), F.count(F.when(complete, 1))).head()
    if full < n:
        raise MissingValuesError(f"{n - full} of {n} rows have missing values")
    ks = range(2, min(most, n - 1) + 1)
    if not ks:
        empty = features.sparkSession.createDataFrame([], "k int, inertia double, silhouette double, davies_bouldin double, gap double, selected boolean")
        return empty, rows.select(key, F.lit(0).alias("cluster"))
    some = rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).select(*columns).limit(sample).toPandas().to_numpy(float)
    arrays = rows.select(F.array(*(F.col(c).cast("double") for c in columns)).alias("x")).persist()
    centres, inertia = fitted_centres(arrays, columns, {k * starts + s: first_centres(some, k, seed + s) for k in ks for s in range(starts)})
    arrays.unpersist()
    best = {k: min(range(k * starts, (k + 1) * starts), key=lambda run: (inertia[run], run)) for k in ks}
    names = [f"cluster_{k}" for k in ks]

    def assign(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            x = pdf[columns].to_numpy(float)
            yield pdf.assign(**{f"cluster_{k}": square_gaps(x, centres[run]).argmin(1).astype("int32") for k, run in best.items()})

    labelled = rows.mapInPandas(assign, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), *(f"{c} int" for c in names)])).persist()
    shape = {r["label_of"]: r["silhouette"] for r in silhouettes(labelled, columns, names, key).collect()}
    out = [(k, float(inertia[best[k]]), shape[f"cluster_{k}"], davies_bouldin(labelled, columns, f"cluster_{k}").head()["davies_bouldin"]) for k in ks]
    table = features.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double, davies_bouldin double")
    chosen = table.join(elbow(table).select("k", "gap", "selected"), "k")
    k = chosen.where("selected").head()["k"]
    return chosen, labelled.select(key, F.col(f"cluster_{k}").alias("cluster"))


def plain_gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows to rows by one product of matrices; those that are small against the rows' lengths, which would lose
    their digits, by differences."""
    lengths = (x * x).sum(1)[:, None] + (y * y).sum(1)
    square = np.maximum(lengths - 2 * x @ y.T, 0)
    i, j = np.nonzero(square <= 1e-6 * lengths)
    for k in range(0, len(i), 1 << 15):
        part = slice(k, k + (1 << 15))
        square[i[part], j[part]] = ((x[i[part]] - y[j[part]]) ** 2).sum(1)
    return np.sqrt(square, out=square)


PER_BLOCK = 16_000


def silhouettes(labelled: DataFrame, columns: list[str], labels: list[str], key: str = "objeto_id", blocks: int = 16) -> DataFrame:
    """(label_of, silhouette): for each column of labels the mean silhouette with Euclidean distances; objects alone in their
    cluster count 0.

    The measure needs the distance of every two objects, once for all labels.  Objects are cut into blocks; each two blocks are
    a task, which takes their distances once for both sides and gives an object's sums by cluster in one array, so pairs are never rows.
    """
    told = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in labels}
    sizes = {c: {r["k"]: r["n"] for r in labelled.groupBy(told[c].alias("k")).agg(F.count("*").alias("n")).collect()} for c in labels}  # a row for each cluster
    if not all(sizes.values()):
        return labelled.sparkSession.createDataFrame([], "label_of string, silhouette double")
    names = {c: sorted(v) for c, v in sizes.items()}
    first = dict(zip(labels, np.cumsum([0, *(len(v) for v in names.values())]).tolist()))
    width = sum(map(len, names.values()))
    blocks = max(blocks, -(-sum(sizes[labels[0]].values()) // PER_BLOCK))
    place = lambda c: (F.array_position(F.array(*map(F.lit, names[c])), told[c]) - 1 + first[c]).cast("int")
    base = labelled.select(F.col(key).alias("id"), F.array(*map(place, labels)).alias("at"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("own"))
    dealt = base.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"u": F.least("own", "other"), "v": F.greatest("own", "other")}).drop("other")

    def sums(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(columns))
        at = table.column("at").combine_chunks().flatten().to_numpy().reshape(-1, len(labels))
        hot = np.zeros((len(x), width))
        hot[np.arange(len(x))[:, None], at] = 1
        u = table.column("u")[0].as_py()
        a, b = np.flatnonzero(own == u), np.flatnonzero(own != u)
        same = u == table.column("v")[0].as_py()
        b = a if same else b
        total = np.zeros((len(x), width))
        z, theirs = x[b], hot[b]
        for k in range(0, len(a), 256):
            part = a[k : k + 256]
            d = plain_gaps(x[part], z)
            total[part] += d @ theirs
            if not same:
                total[b] += d.T @ hot[part]
        ends = pa.array(np.arange(0, total.size + 1, width, dtype=np.int32))
        return pa.table({"id": table.column("id"), "s": pa.ListArray.from_arrays(ends, pa.array(total.ravel()))})

    parts = dealt.select(F.col("id").cast("long").alias("id"), "at", "x", "own", "u", "v").groupBy("u", "v").applyInArrow(sums, "id long, s array<double>")
    by = parts.groupBy("id").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)))
    rows = base.select(F.col("id").cast("long").alias("id"), "at").join(by, "id")
    each = []
    for i, c in enumerate(labels):
        own = F.col("at")[i]
        near = [(first[c] + k, sizes[c][name]) for k, name in enumerate(names[c])]
        a = F.coalesce(*(F.when((own == j) & F.lit(n > 1), F.col(f"s{j}") / (n - 1 or 1)) for j, n in near))
        b = F.array_min(F.array(*(F.when(own != j, F.col(f"s{j}") / n) for j, n in near)))
        s = F.when(a.isNull(), 0.0).otherwise(F.try_divide(b - a, F.greatest(a, b)))
        each.append(F.struct(F.lit(c).alias("label_of"), F.coalesce(s, F.lit(0.0)).alias("s")))
    return rows.select(F.explode(F.array(*each)).alias("e")).groupBy("e.label_of").agg(F.avg("e.s").alias("silhouette"))


def silhouette(labelled: DataFrame, columns: list[str], label: str, key: str = "objeto_id", blocks: int = 16) -> DataFrame:
    """One row: the mean silhouette by one column of labels (null if there are no objects)."""
    return silhouettes(labelled, columns, [label], key, blocks).agg(F.max("silhouette").alias("silhouette"))


def davies_bouldin(labelled: DataFrame, columns: list[str], label: str) -> DataFrame:
    """One row: the mean over clusters of the worst ratio of summed spreads to the distance of centroids."""
    x = F.array(*(F.col(c).cast("double") for c in columns))
    centre = labelled.groupBy(F.col(label).alias("k")).agg(F.array(*(F.avg(c) for c in columns)).alias("m"))
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    spread = labelled.select(F.col(label).alias("k"), x.alias("x")).join(centre, "k").groupBy("k").agg(F.avg(gap(F.col("x"), F.col("m"))).alias("s"), F.first("m").alias("m"))
    a, b = spread.alias("a"), spread.alias("b")  # a row for each cluster
    ratio = F.try_divide(F.col("a.s") + F.col("b.s"), gap(F.col("a.m"), F.col("b.m")))
    worst = a.join(b, F.col("a.k") != F.col("b.k")).groupBy("a.k").agg(F.max(F.coalesce(ratio, F.lit(0.0))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def crosstab(labelled: DataFrame, clase: str = "clase", cluster: str = "cluster") -> DataFrame:
    """(clase, cluster, n) of all combinations, zeros too."""
    counts = labelled.groupBy(clase, cluster).agg(F.count("*").alias("n"))
    grid = labelled.select(clase).distinct().crossJoin(labelled.select(cluster).distinct())  # classes by clusters
    return grid.join(counts, [clase, cluster], "left").fillna(0, subset=["n"])


def purity(labelled: DataFrame, clase: str = "clase", cluster: str = "cluster") -> DataFrame:
    """(clase, n, entropy, purity): natural-log entropy of a class over clusters, and its largest share."""
    counts = labelled.groupBy(clase, cluster).agg(F.count("*").alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy(clase))
    return counts.withColumn("p", p).groupBy(clase).agg(F.sum("k").alias("n"), F.abs(F.sum(-F.col("p") * F.log("p"))).alias("entropy"), F.max("p").alias("purity"))


def global_purity(labelled: DataFrame, clase: str = "clase", cluster: str = "cluster") -> DataFrame:
    counts = labelled.groupBy(clase, cluster).agg(F.count("*").alias("k"))
    best = counts.groupBy(cluster).agg(F.max("k").alias("best"), F.sum("k").alias("n"))
    return best.agg((F.sum("best") / F.sum("n")).alias("global_purity"))


def class_moments(rows: DataFrame, columns: list[str], turn: np.ndarray, clase: str) -> DataFrame:
    """(k, n, m, c): by class the rows, and of ``columns`` times ``turn`` the means and the upper half of the sample covariance.

    Each task adds up a matrix for each class.  Rows with a missing value count in n alone.
    """
    d = turn.shape[1]
    upper = np.triu_indices(d)

    def merged(one: tuple, two: tuple) -> tuple:
        (_, f1, m1, c1), (_, f2, m2, c2) = one, two
        f, gap = f1 + f2, m2 - m1
        return one[0] + two[0], f, m1 + gap * (f2 / max(1, f)), c1 + c2 + np.outer(gap, gap) * (f1 * f2 / max(1, f))

    def of(n: int, z: np.ndarray) -> tuple:
        m = z.mean(0) if len(z) else np.zeros(d)
        return n, len(z), m, (z - m).T @ (z - m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            x = np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))], 1)
            names = batch.column("k").dictionary_encode()
            at, full = names.indices.to_numpy(zero_copy_only=False), np.isfinite(x).all(1)
            for i, k in enumerate(names.dictionary.to_pylist()):
                one = of(int((at == i).sum()), x[(at == i) & full] @ turn)
                total[k] = merged(total[k], one) if k in total else one
        out = [[k, n, f, m.tolist(), c.ravel().tolist()] for k, (n, f, m, c) in total.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(PARTS, r)) for r in out], schema=pa.schema(list(zip(PARTS, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))))))

    def add(table: pa.Table) -> pa.Table:
        total = None
        for r in table.to_pylist():
            one = r["n"], r["full"], np.array(r["m"]), np.array(r["c"]).reshape(d, d)
            total = one if total is None else merged(total, one)
        n, f, m, c = total
        return pa.table({"k": table.column("k")[:1], "n": pa.array([n]), "m": pa.array([m.tolist()]), "c": pa.array([(c[upper] / max(1, f - 1)).tolist()])})

    named = rows.where(F.col(clase).isNotNull()).select(F.col(clase).cast("string").alias("k"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    parts = named.mapInArrow(run, "k string, n long, full long, m array<double>, c array<double>")
    return parts.groupBy("k").applyInArrow(add, "k string, n long, m array<double>, c array<double>")  # a row for each task and class


PARTS = ("k", "n", "full", "m", "c")


def class_distances(features: DataFrame, columns: list[str], clase: str = "clase", dimensions: int | None = None, ridge: float = 1e-4) -> DataFrame:
    """(a, b, mahalanobis, bhattacharyya) of each two classes, in the space of the first principal components (all columns as
    they are, if ``dimensions`` is None).  Class means and covariances come from one aggregation, or, for many columns, one pass."""
    if dimensions is None and len(columns) <= WIDE:
        d = len(columns)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        stats = features.groupBy(F.col(clase).alias("k")).agg(F.count("*").alias("n"), F.array(*(F.avg(c) for c in columns)).alias("m"), F.array(*(F.coalesce(F.covar_samp(columns[i], columns[j]), F.lit(0.0)) for i, j in pairs)).alias("c"))
    elif dimensions is None:
        d = len(columns)
        stats = class_moments(features, columns, np.eye(d), clase)
    else:
        d = min(max(1, dimensions), len(columns))
        stats = class_moments(standardized(features, columns), columns, components(features, columns)[1][:, :d], clase)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def measure(batches):  # noqa: ANN001, ANN202
        upper = tuple(np.array(pairs).T)

        def full(c: np.ndarray) -> np.ndarray:
            m = np.zeros((d, d))
            m[upper] = c
            return m + np.triu(m, 1).T + ridge * np.eye(d)

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                s1, s2, delta = full(r.c1), full(r.c2), np.asarray(r.m1) - np.asarray(r.m2)
                pooled, mean = (r.n1 * s1 + r.n2 * s2) / (r.n1 + r.n2), (s1 + s2) / 2
                maha = float(np.sqrt(max(0.0, delta @ np.linalg.solve(pooled, delta))))
                logs = [np.linalg.slogdet(m)[1] for m in (mean, s1, s2)]
                out.append((r.a, r.b, maha, float(max(0.0, delta @ np.linalg.solve(mean, delta) / 8 + 0.5 * (logs[0] - 0.5 * (logs[1] + logs[2]))))))
            yield pd.DataFrame(out, columns=["a", "b", "mahalanobis", "bhattacharyya"])

    one = stats.select(F.col("k").alias("a"), F.col("n").alias("n1"), F.col("m").alias("m1"), F.col("c").alias("c1"))
    two = stats.select(F.col("k").alias("b"), F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("c").alias("c2"))
    return one.join(two, F.col("a") < F.col("b")).mapInPandas(measure, "a string, b string, mahalanobis double, bhattacharyya double")  # a row for each class


def mean_mahalanobis(distances: DataFrame) -> DataFrame:
    """Mean over all ordered pairs of classes; 0 for one class."""
    return distances.agg(F.coalesce(F.avg("mahalanobis"), F.lit(0.0)).alias("mean_mahalanobis"))
