"""Clock drift between brokers (DRF)."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.timeutil import micros
from tidewatch.operators.joins import attach
from tidewatch.operators.quantiles import exact_quantiles, value_counts

# Brokers, median of the broker whose clock is right (ms), first seed.
BROKERS = 3
REFERENCE_MS = 35.28
SEED = 42


def drift_ms(df: DataFrame, source: str, broker: str, out: str = "drift_ms") -> DataFrame:
    return df.withColumn(out, (micros(broker) - micros(source)) / 1e3)


def _vectors(df: DataFrame, col: str) -> DataFrame:
    return VectorAssembler(inputCols=[col], outputCol="_features", handleInvalid="keep").transform(df)


def fit_drift(df: DataFrame, col: str = "drift_ms", k: int = BROKERS, seeds: int = 10) -> GaussianMixtureModel:
    """Gaussian mixture with one component per broker, the best of several starts.

    The fit sees every row: equal values are counted first and weigh in with
    their count, so the iterations run over distinct values only. The starts are jobs side by
    side over the one persisted table of counts, which has a part per core, however many a
    shuffle has: every part sends a result to the driver in each of up to 1000 iterations.
    """
    counts = value_counts(df, [], col).withColumn("_w", F.col("_c").cast("double"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    points = _vectors(counts, "_v").select("_features", "_w").repartition(cores).persist()
    try:
        points.count()

        def fit(i: int) -> GaussianMixtureModel:
            return GaussianMixture(featuresCol="_features", weightCol="_w", k=k, seed=SEED + i).fit(points)

        with ThreadPoolExecutor(seeds) as pool:
            models = list(pool.map(fit, range(seeds)))
        return max(models, key=lambda m: m.summary.logLikelihood)  # the first of equal ones
    finally:
        points.unpersist()


def assign_clusters(df: DataFrame, model: GaussianMixtureModel, col: str = "drift_ms") -> DataFrame:
    """Adds `cluster`, the most likely component of every row, numbered by the components'
    means from the smallest; null where there is no drift."""
    means = [float(g.mean[0]) for g in model.gaussians]
    place = {c: i for i, c in enumerate(sorted(range(len(means)), key=means.__getitem__))}
    number = F.element_at(F.array(*[F.lit(place[c]) for c in range(len(means))]), F.col("_cluster").cast("int") + 1)
    out = model.setPredictionCol("_cluster").setProbabilityCol("").transform(_vectors(df, col))
    known = F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))
    return out.select(*df.columns, F.when(known, number).alias("cluster"))


def cluster_medians(df: DataFrame, col: str = "drift_ms", cluster: str = "cluster") -> DataFrame:
    return exact_quantiles(df, [cluster], col, [0.5]).select(
        cluster, "n", F.col("q")[0].alias("median_ms")
    )


def offsets(medians: DataFrame, reference_ms: float = REFERENCE_MS, cluster: str = "cluster") -> DataFrame:
    """Offset of every cluster from the one whose median is nearest to the reference."""
    nearest = medians.orderBy(F.abs(F.col("median_ms") - reference_ms), cluster).limit(1).select("median_ms")
    return medians.withColumn("offset_ms", F.col("median_ms") - nearest.scalar())


def compensate(
    df: DataFrame,
    col: str = "drift_ms",
    cluster: str = "cluster",
    *,
    mode: str = "reference",
    reference_ms: float = REFERENCE_MS,
    out: str = "corrected_ms",
) -> DataFrame:
    """Subtract each cluster's offset, or with mode `center` its own median."""
    table = offsets(cluster_medians(df, col, cluster), reference_ms, cluster)
    take = {"reference": "offset_ms", "center": "median_ms"}[mode]
    table = table.select(cluster, F.col(take).alias("_take"))
    return attach(df, table, [cluster], few_groups=True).withColumn(out, F.col(col) - F.col("_take")).drop("_take")


def crosstab(df: DataFrame, a: str, b: str, b_values: Sequence) -> DataFrame:
    """Row counts of two labels, one column per value of `b`, 0 where there are none."""
    wide = df.groupBy(a).pivot(b, list(b_values)).count().na.fill(0)
    return wide.select(a, *[F.col(str(v)).alias(f"{b}_{v}") for v in b_values])


def iqr(df: DataFrame, col: str, by: Sequence[str] = (), *, few_groups: bool = False) -> DataFrame:
    """Typical jitter: the inter-quartile range."""
    q = exact_quantiles(df, by, col, [0.25, 0.75])
    return q.select(*by, (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
