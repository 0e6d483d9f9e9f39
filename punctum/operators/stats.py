"""Weighted and group-wise statistics, tests and corrections."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def weighted_corr(df: DataFrame, a: str, b: str, w: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, corr): weighted Pearson correlation in one aggregation over ``by``; NULL where a side doesn't vary."""
    x, y, v = F.col(a).cast("double"), F.col(b).cast("double"), F.col(w).cast("double")
    s = df.groupBy(*by).agg(*(F.sum(e).alias(n) for n, e in (("sw", v), ("sx", v * x), ("sy", v * y), ("sxx", v * x * x), ("syy", v * y * y), ("sxy", v * x * y))))
    mx, my = F.col("sx") / F.col("sw"), F.col("sy") / F.col("sw")
    cov, vx, vy = F.col("sxy") / F.col("sw") - mx * my, F.col("sxx") / F.col("sw") - mx * mx, F.col("syy") / F.col("sw") - my * my
    return s.select(*by, (cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0))).alias("corr"))


def scaled(df: DataFrame, c: str, by: Sequence[str], out: str, top: float = 1.0) -> DataFrame:
    """``df`` with ``out``, the column ``c`` scaled to 0..top within ``by``; NULL where all values are equal."""
    ends = df.groupBy(*by).agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
    joined = df.join(ends, list(by)) if by else df.crossJoin(ends)
    return joined.withColumn(out, (F.col(c) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * top).drop("__lo", "__hi")


def average_rank(df: DataFrame, c: str, by: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``, the rank of ``c`` from 1 within ``by``, ties at the average of their places.

    Counts of the distinct values are accumulated, not rows ordered, so copies cost nothing. NULLs in ``by`` or ``c`` drop out.
    """
    k = list(by)
    n = df.groupBy(*k, c).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*k).orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn(out, upto - F.col("__n") + (F.col("__n") + 1) / 2).drop("__n")
    return df.join(n, [*k, c])


def weighted_spearman(df: DataFrame, a: str, b: str, w: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, corr): ``weighted_corr`` of the average ranks."""
    ranked = average_rank(average_rank(df.select(*by, a, b, w), a, by, "__ra"), b, by, "__rb")
    return weighted_corr(ranked, "__ra", "__rb", w, by)


def adjusted(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with bh and bonferroni within ``by``, at most 1; a NULL or NaN p-value counts for none and has none."""
    by = list(by)
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    d = df.withColumn("__ok", ok)
    w = Window.partitionBy(*by, "__ok")
    d = d.withColumns({"__m": F.count(F.lit(1)).over(w), "__place": F.row_number().over(w.orderBy(p))})
    step = F.col(p) * F.col("__m") / F.col("__place")
    d = d.withColumn("__step", step)
    back = w.orderBy("__place").rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumns({"bh": F.when(F.col("__ok"), F.least(F.min("__step").over(back), F.lit(1.0))), "bonferroni": F.when(F.col("__ok"), F.least(F.col(p) * F.col("__m"), F.lit(1.0)))})
    return d.drop("__ok", "__m", "__place", "__step")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * f


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic; NaN stays NaN."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return float("nan")
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(a, b) for a, b in zip(t.astype(float), df.astype(float))])


@F.pandas_udf(DoubleType())
def z_p_value(z: pd.Series) -> pd.Series:
    return z.astype(float).map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)))


def t_test(df: DataFrame, value: Column, sample: str, first: str, second: str, by: Sequence[str]) -> DataFrame:
    """(by, t, df, p): equal-variance two-sample t-test; NULL statistics where a sample has under two rows or nothing varies."""
    x = df.withColumn("__x", value)
    agg = []
    for s, n in ((first, "1"), (second, "2")):
        v = F.when(F.col(sample) == s, F.col("__x"))
        agg += [F.count(v).alias(f"n{n}"), F.avg(v).alias(f"m{n}"), F.var_samp(v).alias(f"v{n}")]
    g = x.groupBy(*by).agg(*agg)
    dof = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    t = (F.col("m1") - F.col("m2")) / F.nullif(F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))), F.lit(0.0))
    ok = (F.col("n1") > 1) & (F.col("n2") > 1)
    out = g.select(*by, F.when(ok, t).alias("t"), dof.cast("double").alias("df"))
    return out.withColumn("p", F.when(F.col("t").isNotNull(), t_p_value("t", "df")))


def rank_sum(df: DataFrame, value: str, sample: str, first: str, second: str, by: Sequence[str]) -> DataFrame:
    """(by, z, p): Wilcoxon rank-sum test of two samples, normal approximation without a tie correction."""
    d = average_rank(df.where(F.col(sample).isin(first, second)), value, by, "__rank")
    one = F.col(sample) == first
    g = d.groupBy(*by).agg(F.sum(F.when(one, F.col("__rank"))).alias("s"), F.count(F.when(one, 1)).cast("double").alias("n1"), F.count(F.when(~one, 1)).cast("double").alias("n2"))
    n1, n2 = F.col("n1"), F.col("n2")
    z = (F.col("s") - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    out = g.where("n1 > 0 AND n2 > 0").select(*by, z.alias("z"))
    return out.withColumn("p", z_p_value("z"))


def linear_model(df: DataFrame, y: Column, terms: dict[str, Column], by: Sequence[str], *, enough: Column | None = None) -> DataFrame:
    """(by, term, beta, se, p): least squares of ``y`` on an intercept and ``terms``, from group sums of products.

    NULL where the terms don't determine the coefficients, where no degree of freedom is left, or where the aggregate
    condition ``enough`` fails. Only the sums of a group leave the aggregation.
    """
    names = ["intercept", *terms]
    x = [F.lit(1.0), *(c.cast("double") for c in terms.values())]
    k = len(x)
    d = df.select(*by, y.cast("double").alias("__y"), *(c.alias(f"__x{i}") for i, c in enumerate(x)), *([enough.alias("__e")] if enough is not None else []))
    cols = [F.col(f"__x{i}") for i in range(k)]
    sums = [F.sum(cols[i] * cols[j]) for i in range(k) for j in range(k)]
    g = d.groupBy(*by).agg(F.array(*sums).alias("xx"), F.array(*(F.sum(c * F.col("__y")) for c in cols)).alias("xy"), F.sum(F.col("__y") * F.col("__y")).alias("yy"), F.count(F.lit(1)).alias("n"), (F.min("__e") if enough is not None else F.lit(True)).alias("ok"))

    @F.pandas_udf("array<struct<term: string, beta: double, se: double, p: double>>")
    def solve(xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series, ok: pd.Series) -> pd.Series:
        out = []
        for a, b, c, m, fine in zip(xx, xy, yy, n, ok):
            a, b = np.asarray(a, float).reshape(k, k), np.asarray(b, float)
            rows = [{"term": t, "beta": None, "se": None, "p": None} for t in names]
            if fine and m > k and np.linalg.matrix_rank(a) == k:
                inv = np.linalg.inv(a)
                beta = inv @ b
                rss = max(float(c - beta @ b), 0.0)
                se = np.sqrt(np.diag(inv) * rss / (m - k))
                for r, be, s in zip(rows, beta, se):
                    r.update(beta=float(be), se=float(s), p=t_tail(float(be / s), m - k) if s > 0 else None)
            out.append(rows)
        return pd.Series(out)

    return g.select(*by, F.explode(solve("xx", "xy", "yy", "n", "ok")).alias("r")).select(*by, "r.*")


#: P(X <= k) of a Poisson number of mean 1, up to where doubles tell it from 1: draws beyond have no chance at 53 bits.
_COPIES = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(24)])
#: Rows times resamples drawn at once.
_DRAWS = 1 << 21


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap_mean(df: DataFrame, value: str, row_id: str, by: Sequence[str], *, resamples: int = 500, seed: int = 0, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(by, low, high): percentile interval of the mean by the Poisson bootstrap.

    Every row draws its number of copies for each resample from a hash of its id, so rows stay where they are, groups of
    any size need no gathering, and a repeated run gives the same interval. Batches are summed by group and resample
    before the shuffle; no row is multiplied. Rows with a NULL or NaN value count for nothing.
    """
    keys = list(by)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = rows.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), F.xxhash64(F.lit(seed), F.col(row_id)).alias("h"), F.col(value).cast("double").alias("v"))
    names = [f"k{i}" for i in range(len(keys))]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = _mixed(np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            for _, g in batch.groupby(names, dropna=False, sort=False) if names else [(None, batch)]:
                n, total = np.zeros(resamples), np.zeros(resamples)
                h, v = g["h"].to_numpy().view(np.uint64), g["v"].to_numpy()
                for at in np.array_split(np.arange(len(g)), len(g) * resamples // _DRAWS + 1):
                    u = (_mixed(h[at, None] ^ salt[None]) >> np.uint64(11)) * 2.0**-53
                    copies = np.searchsorted(_COPIES, u, "right")
                    n += copies.sum(axis=0)
                    total += (copies * v[at, None]).sum(axis=0)
                yield pd.DataFrame({**{c: [g[c].iloc[0]] * resamples for c in names}, "b": np.arange(resamples), "n": n, "total": total})

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names), "b int, n double, total double"])
    means = rows.mapInPandas(partial, schema).groupBy(*names, "b").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    out = means.groupBy(*names).agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))
    return out.select(*(F.col(a).alias(c) for a, c in zip(names, keys)), "low", "high")


def profile_correlation(first: DataFrame, second: DataFrame, genes: DataFrame, rows: DataFrame) -> DataFrame:
    """(gene, corr): Pearson correlation over all ``rows`` of each gene's counts in two profiles (sphere_id, target, n).

    Absent entries are 0; they enter by the number of rows alone, so nothing dense is made. 1 where a side doesn't vary.
    """
    x = first.select("sphere_id", "target", F.col("n").cast("double").alias("x"))
    y = second.select("sphere_id", "target", F.col("n").cast("double").alias("y"))
    pairs = x.join(y, ["sphere_id", "target"], "full").fillna(0.0, ["x", "y"])
    s = pairs.groupBy("target").agg(*(F.sum(e).alias(n) for n, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")), ("sxy", F.col("x") * F.col("y")))))
    s = s.crossJoin(rows.agg(F.count(F.lit(1)).cast("double").alias("m")))
    spread = lambda a, b, c: F.col("m") * F.col(a) - F.col(b) * F.col(c)
    corr = spread("sxy", "sx", "sy") / F.nullif(F.sqrt(spread("sxx", "sx", "sx") * spread("syy", "sy", "sy")), F.lit(0.0))
    return genes.select(F.col("gene")).distinct().join(s.select(F.col("target").alias("gene"), corr.alias("corr")), "gene", "left").select("gene", F.coalesce("corr", F.lit(1.0)).alias("corr"))


def t_test_against_rest(expr: DataFrame, labels: DataFrame, row_id: str, label: str) -> DataFrame:
    """(label, target, t, df, p): Welch's t-test of each label's values (row_id, target, value) against those of all other rows.

    Absent values are 0 and enter by the number of rows. NULL where a side has under two rows or nothing varies.
    """
    size = labels.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("n1"))
    total = labels.agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = expr.join(labels.select(row_id, label), row_id).groupBy(label, "target").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("q1"))
    both = sums.groupBy("target").agg(F.sum("s1").alias("s"), F.sum("q1").alias("q"))
    g = size.crossJoin(both).crossJoin(total).join(sums, [label, "target"], "left").fillna(0.0, ["s1", "q1"])
    n2 = F.col("n") - F.col("n1")
    g = g.withColumns({"n2": n2, "m1": F.col("s1") / F.col("n1"), "m2": (F.col("s") - F.col("s1")) / F.nullif(n2, F.lit(0.0))})
    var = lambda q, n, m: F.greatest(q - n * m * m, F.lit(0.0)) / F.nullif(n - 1, F.lit(0.0)) / F.nullif(n, F.lit(0.0))
    g = g.withColumns({"e1": var(F.col("q1"), F.col("n1"), F.col("m1")), "e2": var(F.col("q") - F.col("q1"), F.col("n2"), F.col("m2"))})
    e = F.col("e1") + F.col("e2")
    t = (F.col("m1") - F.col("m2")) / F.nullif(F.sqrt(e), F.lit(0.0))
    dof = e * e / F.nullif(F.col("e1") * F.col("e1") / (F.col("n1") - 1) + F.col("e2") * F.col("e2") / (F.col("n2") - 1), F.lit(0.0))
    ok = (F.col("n1") > 1) & (F.col("n2") > 1)
    out = g.select(label, "target", F.when(ok, t).alias("t"), F.when(ok, dof).alias("df"))
    return out.withColumn("p", F.when(F.col("t").isNotNull(), t_p_value("t", "df")))


def pairwise_rand(labels: DataFrame, runs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, first, second, ari): adjusted Rand index of every two of the label columns ``runs``, in one job."""
    k = list(by)
    pairs = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).alias("a"), F.col(b).alias("b")) for i, a in enumerate(runs) for b in runs[i + 1 :]]
    n2 = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    each = [*k, "first", "second"]
    cells = labels.select(*k, F.explode(F.array(*pairs)).alias("p")).select(*k, "p.*").groupBy(*each, "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    side = lambda c, name: cells.groupBy(*each, c).agg(F.sum("n").alias("n")).groupBy(*each).agg(n2("n").alias(name))
    s = cells.groupBy(*each).agg(n2("n").alias("i"), F.sum("n").alias("total")).join(side("a", "x"), each).join(side("b", "y"), each)
    expected = F.col("x") * F.col("y") / F.nullif(F.col("total") * (F.col("total") - 1) / 2, F.lit(0.0))
    top = (F.col("x") + F.col("y")) / 2 - expected
    return s.select(*each, F.when(F.coalesce(top, F.lit(0.0)) == 0, 1.0).otherwise((F.col("i") - expected) / top).alias("ari"))


def cluster_number_sweep(df: DataFrame, features: Sequence[str], numbers: Sequence[int], row_id: str, *, seeds: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """(k, inertia, silhouette, mean_ari): k-means for each number of clusters.

    Inertia and silhouette are those of the first seed, mean_ari the mean agreement of every two seeds. Only models,
    of k centres each, come to the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    from punctum.plans.shared import written_once

    spark = df.sparkSession
    v = VectorAssembler(inputCols=list(features), outputCol="v").transform(written_once(df.select(row_id, *features), "features")).select(row_id, "v")
    out = []
    for k in numbers:
        labels = v
        for i, seed in enumerate(seeds):
            model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol=f"s{i}").fit(v)
            labels = model.transform(labels)
            if i == 0:
                inertia = model.summary.trainingCost
        silhouette = ClusteringEvaluator(featuresCol="v", predictionCol="s0").evaluate(labels)
        ari = pairwise_rand(labels, [f"s{i}" for i in range(len(seeds))]).agg(F.avg("ari")).first()[0]
        out.append((k, float(inertia), float(silhouette), ari))
    return spark.createDataFrame(out, "k int, inertia double, silhouette double, mean_ari double")


def mixture_labels(df: DataFrame, features: Sequence[str], k: int, seed: int, row_id: str) -> DataFrame:
    """(row_id, cluster, probability) by a mixture of ``k`` Gaussians on the columns ``features``."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=list(features), outputCol="__v").transform(df)
    model = GaussianMixture(k=k, seed=seed, featuresCol="__v", predictionCol="cluster", probabilityCol="__p").fit(v)
    return model.transform(v).select(row_id, "cluster", F.array_max(vector_to_array("__p")).alias("probability"))


def topic_shares(expr: DataFrame, genes: Sequence[str], k: int, seed: int, row_id: str) -> DataFrame:
    """(row_id, shares): shares of ``k`` topics of the counts (row_id, target, n), by latent Dirichlet allocation."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    wide = expr.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("target", F.col("n").cast("double")))).alias("m"))  # an entry for each gene of a fixed panel
    v = wide.select(row_id, array_to_vector(F.transform(F.array(*map(F.lit, genes)), lambda g: F.coalesce(F.element_at("m", g), F.lit(0.0)))).alias("features"))
    return LDA(k=k, seed=seed, maxIter=10).fit(v).transform(v).select(row_id, vector_to_array("topicDistribution").alias("shares"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari): adjusted Rand index of two labellings, from their contingency table; 1 where both are trivial."""
    n2 = lambda c: c * (c - 1) / 2
    both = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    index = both.agg(F.sum(n2(F.col("n"))).alias("i"), F.sum("n").alias("total"))
    one = lambda c, name: both.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(n2(F.col("n"))).alias(name))
    s = index.crossJoin(one(a, "x")).crossJoin(one(b, "y"))
    expected = F.col("x") * F.col("y") / n2(F.col("total"))
    top = (F.col("x") + F.col("y")) / 2 - expected
    return s.select(F.when(top == 0, 1.0).otherwise((F.col("i") - expected) / top).alias("ari"))


def kmeans_labels(df: DataFrame, features: Sequence[str], k: int, seed: int, row_id: str) -> DataFrame:
    """(row_id, cluster) by k-means on the columns ``features``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=list(features), outputCol="__v").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v).transform(v).select(row_id, "cluster")


def principal_components(df: DataFrame, features: Sequence[str], k: int, row_id: str) -> DataFrame:
    """(row_id, pc): the first ``k`` principal components."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=list(features), outputCol="__v").transform(df)
    return PCA(k=k, inputCol="__v", outputCol="__pc").fit(v).transform(v).select(row_id, vector_to_array("__pc").alias("pc"))
