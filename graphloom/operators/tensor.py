"""Tensor operators as table operators.

A tensor of any rank is a long table of index columns and a value; a vector may
also be an array column.  Reductions, scans, sorts, lookups, products and shape
changes are group-bys, windows, joins and index arithmetic over these.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.store import numbered, ship

# Reductions


def log_sum_exp(x: Column, by: list[str]) -> Column:
    """Window form: max + log of the sum of exponentials of what is left."""
    w = Window.partitionBy(*by)
    top = F.max(x).over(w)
    return top + F.log(F.sum(F.exp(x - top)).over(w))


def reductions(x: Column, unbiased: bool = True) -> dict[str, Column]:
    """Aggregates by name."""
    return {
        "sum": F.sum(x), "mean": F.avg(x), "prod": F.product(x),
        "std": F.stddev_samp(x) if unbiased else F.stddev_pop(x), "var": F.var_samp(x) if unbiased else F.var_pop(x),
        "norm": F.sqrt(F.sum(x * x)), "min": F.min(x), "max": F.max(x), "all": F.bool_and(x != 0), "any": F.bool_or(x != 0),
    }


def reduce_dims(t: DataFrame, by: Sequence[str], ops: Sequence[str], value: str = "v", unbiased: bool = True) -> DataFrame:
    """Reduces all other dimensions."""
    known = reductions(F.col(value), unbiased)
    plain = [known[o].alias(o) for o in ops if o != "logsumexp"]
    if "logsumexp" not in ops:
        return t.groupBy(*by).agg(*plain)
    # Sums of exponentials for each stretch of 512, relative to its upper end: no join with the greatest value.
    x = F.col(value).cast("double")
    level = F.ceil(x / 512.0)
    parts = t.groupBy(*by, level.alias("_l")).agg(F.sum(F.exp(x - level * 512.0)).alias("_e"))
    lse = parts.groupBy(*by).agg(F.max("_l").alias("_t"), F.collect_list(F.struct("_l", "_e")).alias("_p"))
    total = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["_e"] * F.exp((p["_l"] - F.col("_t")) * 512.0))
    lse = lse.select(*by, (F.col("_t") * 512.0 + F.log(total)).alias("logsumexp"))
    if not plain:
        return lse
    out = t.groupBy(*by).agg(*plain)
    return out.join(lse, list(by)) if by else out.crossJoin(lse)


def arg_extremes(t: DataFrame, by: Sequence[str], index: str, value: str = "v") -> DataFrame:
    """First places of the least and greatest values."""
    low, high = F.min(F.struct(F.col(value), F.col(index))), F.min(F.struct((-F.col(value)).alias("n"), F.col(index)))
    return t.groupBy(*by).agg(low[index].alias("argmin"), high[index].alias("argmax"))


def kth_value(t: DataFrame, by: Sequence[str], k: int, value: str = "v", index: str = "i") -> DataFrame:
    """The k-th smallest, from 1."""
    w = Window.partitionBy(*by).orderBy(value, index)
    return t.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == k).select(*by, F.col(value).alias("kth"), F.col(index).alias("index"))


def medians(t: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """Lower median and mode (ties: the smallest)."""
    return t.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("median"), F.mode(value, deterministic=True).alias("mode"))


def unique(t: DataFrame, value: str = "v") -> DataFrame:
    """Distinct values in order with counts and the number that each gets (inverse)."""
    counted = t.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return numbered(counted, "inverse", value)


def unique_consecutive(t: DataFrame, by: Sequence[str], order: str, value: str = "v") -> DataFrame:
    """Runs of equal neighbours: (by, run, value, n)."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = t.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy(*by, "run", value).agg(F.count(F.lit(1)).alias("n"))


def bincount(t: DataFrame, value: str, weight: str | None = None, minlength: int = 0) -> DataFrame:
    """(bin, n) for every bin from 0 to the greatest value, or minlength - 1."""
    counted = t.groupBy(F.col(value).cast("long").alias("bin")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    top = counted.agg(F.greatest(F.coalesce(F.max("bin"), F.lit(-1)), F.lit(minlength - 1)).alias("top"))
    bins = top.where("top >= 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"))).alias("bin"))
    return bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(t: DataFrame, value: str, bins: int = 100, low: float = 0.0, high: float = 0.0) -> DataFrame:
    """(bin, n): equal widths; what lies outside is dropped, the greatest falls in the last bin.

    Equal bounds mean the data's range; if that is a point, one less and one more.
    """
    if low == high:
        low, high = (float(x) for x in t.agg(F.min(value), F.max(value)).first())
    if low == high:
        low, high = low - 1, high + 1
    x = F.col(value).cast("double")
    inside = t.where((x >= low) & (x <= high))
    place = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counted = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = t.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def trapezoid(t: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Integral of y over x, points in order of x."""
    w = Window.partitionBy(*by).orderBy(x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return t.select(*by, area.alias("_a")).groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("integral"))


# Scans


def cumulative(t: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "v") -> DataFrame:
    """Adds cumsum and cumprod along an order within each group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("cumsum", F.sum(value).over(w)).withColumn("cumprod", F.product(value).over(w))


def softmax(t: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """Adds softmax and log_softmax within each group."""
    w = Window.partitionBy(*by)
    shifted = F.col(value) - F.max(value).over(w)
    return t.withColumn("_s", shifted).withColumn("softmax", F.exp("_s") / F.sum(F.exp("_s")).over(w)).withColumn("log_softmax", F.col("_s") - F.log(F.sum(F.exp("_s")).over(w))).drop("_s")


def unfold(t: DataFrame, by: Sequence[str], order: str, size: int, step: int, value: str = "v") -> DataFrame:
    """Windows of a size at every step: (by, window, values)."""
    w = Window.partitionBy(*by).orderBy(order)
    ahead = w.rowsBetween(0, size - 1)
    rows = t.withColumn("_p", F.row_number().over(w) - 1).withColumn("values", F.collect_list(value).over(ahead))
    return rows.where((F.size("values") == size) & (F.col("_p") % step == 0)).select(*by, (F.col("_p") / step).cast("int").alias("window"), "values")


def roll(t: DataFrame, index: str, n: int, shift: int) -> DataFrame:
    return t.withColumn(index, F.pmod(F.col(index) + shift, F.lit(n)))


def flip(t: DataFrame, index: str, n: int) -> DataFrame:
    return t.withColumn(index, F.lit(n - 1) - F.col(index))


def rot90(t: DataFrame, rows: int, cols: int, i: str = "i", j: str = "j") -> DataFrame:
    """A quarter turn, counter-clockwise."""
    return t.select(*(c for c in t.columns if c not in (i, j)), (F.lit(cols - 1) - F.col(j)).alias(i), F.col(i).alias(j))


def renorm(t: DataFrame, by: Sequence[str], most: float, p: float = 2.0, value: str = "v") -> DataFrame:
    """Slices of more than a norm are scaled down to it."""
    norm = F.pow(F.sum(F.pow(F.abs(F.col(value)), F.lit(p))).over(Window.partitionBy(*by)), F.lit(1 / p))
    return t.withColumn(value, F.col(value) * F.least(F.lit(1.0), F.lit(most) / norm))


# Sorts


def sort_values(t: DataFrame, by: Sequence[str], value: str = "v", index: str = "i", descending: bool = False) -> DataFrame:
    """(by, pos, value, index): a stable sort with its argsort."""
    w = Window.partitionBy(*by).orderBy(F.desc(value) if descending else F.asc(value), index)
    return t.select(*by, (F.row_number().over(w) - 1).alias("pos"), F.col(value).alias("sorted"), F.col(index).alias("argsort"))


def top_k(t: DataFrame, by: Sequence[str], k: int, value: str = "v", index: str = "i", largest: bool = True) -> DataFrame:
    return sort_values(t, by, value, index, largest).where(F.col("pos") < k)


# Lookups and keyed updates


def gather(base: DataFrame, index: DataFrame, on: str = "i") -> DataFrame:
    """Rows of a base at indices, one for each."""
    return index.join(base, on)


def scatter_add(base: DataFrame, updates: DataFrame, on: str = "i", value: str = "v") -> DataFrame:
    """Base values plus the sums of updates at their indices."""
    sums = updates.groupBy(on).agg(F.sum(value).alias("_u"))
    return base.join(sums, on, "left").withColumn(value, F.col(value) + F.coalesce("_u", F.lit(0.0))).drop("_u")


def index_put(base: DataFrame, updates: DataFrame, on: str = "i", value: str = "v") -> DataFrame:
    """Base values replaced at indices (of several updates, the greatest)."""
    new = updates.groupBy(on).agg(F.max(value).alias("_u"))
    return base.join(new, on, "left").withColumn(value, F.coalesce("_u", value)).drop("_u")


def embedding_bag(table: DataFrame, bags: DataFrame, mode: str = "sum", index: str = "i", bag: str = "bag", vec: str = "embedding", weight: str | None = None) -> DataFrame:
    """One vector a bag from rows looked up by index: sum, mean or max."""
    w = F.col(weight) if weight else F.lit(1.0)
    flat = bags.join(table, index).select(bag, w.alias("_w"), F.posexplode(vec).alias("dim", "x"))
    x = F.col("x").cast("double")
    value = {"sum": F.sum(x * F.col("_w")), "mean": F.avg(x), "max": F.max(x)}[mode]
    dims = flat.groupBy(bag, "dim").agg(value.alias("v"))
    return dims.groupBy(bag).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("v"))


# Masks


def masked_select(t: DataFrame, mask: Column) -> DataFrame:
    return t.where(mask)


def masked_fill(t: DataFrame, mask: Column, fill: float, value: str = "v") -> DataFrame:
    return t.withColumn(value, F.when(mask, F.lit(fill)).otherwise(F.col(value)))


def masked_scatter(t: DataFrame, mask: Column, source: DataFrame, order: Sequence[str], value: str = "v", source_order: str = "i") -> DataFrame:
    """Masked places take the source's values one after another."""
    hit = numbered(t.where(mask), "_k", *order)
    feed = numbered(source, "_k", source_order).select("_k", F.col(value).alias("_new"))
    return hit.join(feed, "_k").withColumn(value, F.col("_new")).drop("_k", "_new").unionByName(t.where(~mask))


def nonzero(t: DataFrame, value: str = "v") -> DataFrame:
    return t.where(F.col(value) != 0).drop(value)


# Products


def coalesce(t: DataFrame, index: Sequence[str] = ("i", "j"), value: str = "v") -> DataFrame:
    """Sums of equal coordinates."""
    return t.groupBy(*index).agg(F.sum(value).alias(value))


def sparse_mask(t: DataFrame, mask: DataFrame, index: Sequence[str] = ("i", "j")) -> DataFrame:
    return t.join(mask.select(*index).distinct(), list(index), "left_semi")


def sparse_mul(a: DataFrame, b: DataFrame, index: Sequence[str] = ("i", "j"), value: str = "v") -> DataFrame:
    return a.join(b.withColumnRenamed(value, "_b"), list(index)).withColumn(value, F.col(value) * F.col("_b")).drop("_b")


def contract(a: DataFrame, b: DataFrame, on: Sequence[str], value: str = "v") -> DataFrame:
    """Tensor contraction over shared index columns: a join and a sum; the rest stays."""
    free = [c for c in a.columns if c not in (*on, value)] + [c for c in b.columns if c not in (*on, value)]
    joined = a.join(b.withColumnRenamed(value, "_b"), list(on))
    product = F.sum(F.col(value) * F.col("_b")).alias(value)
    return joined.groupBy(*free).agg(product) if free else joined.agg(product)


def matmul(a: DataFrame, b: DataFrame, value: str = "v") -> DataFrame:
    """(i, k) by (k, j)."""
    return contract(a, b, ["k"], value)


def cartesian(*tables: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """Every combination of the tables' rows; the result's size is checked first."""
    n = int(np.prod([float(t.count()) for t in tables]))
    if n > bound:
        raise ValueError(f"{n} combinations")
    return reduce(lambda x, y: x.crossJoin(F.broadcast(y)), tables)


def meshgrid(*axes: DataFrame, value: str = "v", bound: int = 10_000_000) -> DataFrame:
    """Of axes (i, value): a row for each point, with its places i0, i1, ... and coordinates x0, x1, ..."""
    named = [t.select(F.col("i").alias(f"i{k}"), F.col(value).alias(f"x{k}")) for k, t in enumerate(axes)]
    out = cartesian(*named, bound=bound)
    return out.select(*(f"i{k}" for k in range(len(axes))), *(f"x{k}" for k in range(len(axes))))


def combinations(t: DataFrame, r: int, column: str, with_replacement: bool = False, bound: int = 10_000_000) -> DataFrame:
    """Ordered-up combinations of r values; the result's size is checked first."""
    n = t.count()
    if (total := math.comb(n + r - 1 if with_replacement else n, r)) > bound:
        raise ValueError(f"{total} combinations")
    out = t.select(F.col(column).alias("c0"))
    for k in range(1, r):
        new = t.select(F.col(column).alias(f"c{k}"))
        out = out.join(new, F.col(f"c{k - 1}") <= F.col(f"c{k}") if with_replacement else F.col(f"c{k - 1}") < F.col(f"c{k}"))
    return out


# Shapes


def narrow(t: DataFrame, index: str, start: int, length: int) -> DataFrame:
    return t.where(F.col(index).between(start, start + length - 1)).withColumn(index, F.col(index) - start)


def select(t: DataFrame, index: str, at: int) -> DataFrame:
    return t.where(F.col(index) == at).drop(index)


def transpose(t: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    return t.select(F.col(j).alias(i), F.col(i).alias(j), *(c for c in t.columns if c not in (i, j)))


def reshape(t: DataFrame, index: Sequence[str], sizes: Sequence[int], new: Sequence[str], new_sizes: Sequence[int], value: str = "v") -> DataFrame:
    """Indices through the flat position."""
    flat = reduce(lambda a, x: a * x[1] + F.col(x[0]).cast("long"), zip(index, sizes), F.lit(0).cast("long"))
    rows = t.select(flat.alias("_f"), value)
    cols, rest = [], 1
    for name, n in reversed(list(zip(new, new_sizes))):
        cols.append((F.floor(F.col("_f") / rest).cast("long") % n).alias(name))
        rest *= n
    return rows.select(*reversed(cols), value)


def repeat(t: DataFrame, index: str, n: int, times: int) -> DataFrame:
    return t.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(index, F.col(index) + F.col("_k") * n).drop("_k")


def repeat_interleave(t: DataFrame, index: str, times: int) -> DataFrame:
    return t.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(index, F.col(index) * times + F.col("_k")).drop("_k")


def concat(a: DataFrame, b: DataFrame, index: str, n: int) -> DataFrame:
    """b behind a along an index of a's size n."""
    return a.unionByName(b.withColumn(index, F.col(index) + n))


def stack(tables: Sequence[DataFrame], index: str = "s") -> DataFrame:
    return reduce(DataFrame.unionByName, [t.withColumn(index, F.lit(k)) for k, t in enumerate(tables)])


def chunk(t: DataFrame, index: str, n: int, chunks: int) -> DataFrame:
    """Adds the number of the chunk, all of one size but the last."""
    size = -(-n // chunks)
    return t.withColumn("chunk", F.floor(F.col(index) / size).cast("int")).withColumn(index, F.col(index) % size)


def to_dense(t: DataFrame, rows: int, value: str = "v") -> DataFrame:
    """(i, array) of a sparse table of columns 0 .. rows - 1."""
    listed = F.map_from_entries(F.collect_list(F.struct("j", value)))
    return t.groupBy("i").agg(listed.alias("m")).select("i", F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda j: F.coalesce(F.try_element_at("m", j.cast(t.schema["j"].dataType)), F.lit(0.0))).alias("row"))


def to_sparse(t: DataFrame, vec: str = "row") -> DataFrame:
    return t.select("i", F.posexplode(vec).alias("j", "v")).where("v != 0")


def one_hot(x: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == x).cast("int"))


def tril(t: DataFrame, k: int = 0) -> DataFrame:
    return t.where(F.col("j") - F.col("i") <= k)


def triu(t: DataFrame, k: int = 0) -> DataFrame:
    return t.where(F.col("j") - F.col("i") >= k)


def trace(t: DataFrame, value: str = "v") -> DataFrame:
    return t.where("i = j").agg(F.sum(value).alias("trace"))


def diagonal(t: DataFrame, value: str = "v") -> DataFrame:
    return t.where("i = j").select("i", value)


def cross(a: Column, b: Column) -> Column:
    """Cross product of two arrays of three."""
    x, y = (lambda k: a[k]), (lambda k: b[k])
    return F.array(x(1) * y(2) - x(2) * y(1), x(2) * y(0) - x(0) * y(2), x(0) * y(1) - x(1) * y(0))


# Generators


def arange(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    n = max(0, -(-(end - start) // step))
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * step).alias("v"))


def linspace(spark: SparkSession, start: float, end: float, n: int) -> DataFrame:
    step = (end - start) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * step).alias("v"))


def logspace(spark: SparkSession, start: float, end: float, n: int, base: float = 10.0) -> DataFrame:
    return linspace(spark, start, end, n).select("i", F.pow(F.lit(base), "v").alias("v"))


def full(spark: SparkSession, n: int, value: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(float(value)).alias("v"))


def eye(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def random(spark: SparkSession, n: int, kind: str = "uniform", seed: int = 0, **kw) -> DataFrame:
    """uniform, normal, randint(high), bernoulli(p), poisson(rate), randperm."""
    base = spark.range(n).select(F.col("id").alias("i"))
    u = F.rand(seed)
    if kind == "uniform":
        return base.withColumn("v", u)
    if kind == "normal":
        return base.withColumn("v", F.randn(seed))
    if kind == "randint":
        return base.withColumn("v", F.floor(u * kw["high"]).cast("long"))
    if kind == "bernoulli":
        return base.withColumn("v", (u < kw["p"]).cast("int"))
    if kind == "randperm":
        return numbered(base.withColumn("_u", u), "v", "_u").drop("_u")
    if kind == "poisson":
        rate = float(kw["rate"])

        @F.pandas_udf("long")
        def draw(i: pd.Series) -> pd.Series:
                    return pd.Series([np.random.default_rng((seed, int(k))).poisson(rate) for k in i])

        return base.withColumn("v", draw("i"))
    raise ValueError(kind)


def multinomial(weights: DataFrame, n: int, seed: int = 0, index: str = "i", weight: str = "w") -> DataFrame:
    """n draws without replacement by weight: the largest exponential keys."""
    key = F.log(F.rand(seed)) / F.col(weight)
    return weights.where(F.col(weight) > 0).withColumn("_k", key).orderBy(F.desc("_k")).limit(n).select(index)


# Linear algebra: one small matrix a row, an Arrow batch of them in one stacked call.

_LINALG = {
    "det": lambda m: np.linalg.det(m)[:, None],
    "inverse": np.linalg.inv,
    "cholesky": np.linalg.cholesky,
    "singular_values": lambda m: np.linalg.svd(m, compute_uv=False),
    "eigenvalues": np.linalg.eigvalsh,
    "qr_r": lambda m: np.linalg.qr(m)[1],
    "pinverse": np.linalg.pinv,
}


def _stacked(values: list, f, shape: tuple[int, ...]) -> list:
    """f of arrays of one size all together; where it fails, one by one, and null for those that fail alone."""
    out: list = [None] * len(values)
    sizes: dict[int, list[int]] = {}
    for k, x in enumerate(values):
        if x is not None:
            sizes.setdefault(len(x), []).append(k)
    for at in sizes.values():
        block = np.array([values[k] for k in at], float).reshape(len(at), *shape)
        try:
            made = f(block).reshape(len(at), -1).tolist()
        except np.linalg.LinAlgError:
            made = []
            for m in block:
                try:
                    made.append(f(m[None]).ravel().tolist())
                except np.linalg.LinAlgError:
                    made.append(None)
        for k, x in zip(at, made):
            out[k] = x
    return out


def linalg(name: str, flat: Column, rows: int) -> Column:
    """A function of a matrix given as a flat array; singular ones give null."""
    ship(SparkSession.active())
    f = _LINALG[name]

    @F.pandas_udf("array<double>")
    def apply(m: pd.Series) -> pd.Series:
        return pd.Series(_stacked(list(m), f, (rows, -1)), dtype=object)

    return apply(flat)


def solve(flat: Column, right: Column, least_squares: bool = False) -> Column:
    """x of m x = y for each row; by the pseudo-inverse if the squares are to be least; null where there is none."""
    ship(SparkSession.active())

    @F.pandas_udf("array<double>")
    def apply(m: pd.Series, b: pd.Series) -> pd.Series:
        out: list = [None] * len(m)
        for n in {len(y) for y in b if y is not None}:
            at = [k for k, y in enumerate(b) if y is not None and len(y) == n and m.iloc[k] is not None]
            both = [np.concatenate([m.iloc[k], b.iloc[k]]) for k in at]

            def one(block, n=n):
                x, y = block[:, 0, :-n].reshape(len(block), n, -1), block[:, 0, -n:, None]
                return np.linalg.pinv(x) @ y if least_squares else np.linalg.solve(x, y)

            for k, x in zip(at, _stacked(both, one, (1, -1))):
                out[k] = x
        return pd.Series(out, dtype=object)

    return apply(flat, right)


def _transform(arrays: list, f) -> list:
    """f on arrays of one length all together."""
    out: list = [None] * len(arrays)
    sizes: dict[int, list[int]] = {}
    for k, x in enumerate(arrays):
        if x is not None:
            sizes.setdefault(len(x), []).append(k)
    for n, at in sizes.items():
        made = f(np.array([arrays[k] for k in at], float).reshape(len(at), n))
        for k, x in zip(at, made):
            out[k] = x
    return out


def rfft(values: Column) -> Column:
    """(re, im) of the real transform of each array."""
    ship(SparkSession.active())

    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def apply(v: pd.Series) -> pd.DataFrame:
        out = _transform(list(v), lambda x: np.fft.rfft(x, axis=1) if x.shape[1] else np.zeros((len(x), 0), complex))
        return pd.DataFrame({"re": [None if o is None else o.real.tolist() for o in out], "im": [None if o is None else o.imag.tolist() for o in out]})

    return apply(values)


def stft(values: Column, size: int, hop: int) -> Column:
    """Magnitudes of the short-time transform of each array: a list of frames."""
    ship(SparkSession.active())

    @F.pandas_udf("array<array<double>>")
    def apply(v: pd.Series) -> pd.Series:
        def every(x):
            if x.shape[1] < size:
                return [[] for _ in x]
            frames = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop]
            return np.abs(np.fft.rfft(frames, axis=2)).tolist()

        return pd.Series(_transform(list(v), every), dtype=object)

    return apply(values)
