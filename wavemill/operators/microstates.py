"""Microstates: runs of equal labels, their durations, coverage and transitions, field power and template shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators import kernels, preprocessing
from wavemill.operators.spectral import entropy
from wavemill.plans.shared import written

MIN_SEGMENT = 10


def zscore(samples: DataFrame, keys: tuple[str, ...] = ("subject", "ch")) -> DataFrame:
    """x less its channel's mean over its standard deviation; null where a channel doesn't vary."""
    s = samples.groupBy(*keys).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return samples.join(s, list(keys)).withColumn("x", F.try_divide(F.col("x") - F.col("m"), F.col("sd"))).drop("m", "sd")


def runs(labels: DataFrame) -> DataFrame:
    """Maximal runs of one state: (subject, state, start, end, length), the end excluded."""
    w = Window.partitionBy("subject").orderBy("n")
    new = F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(1))
    marked = labels.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("subject", "run", "state").agg(F.min("n").alias("start"), (F.max("n") + 1).alias("end"), F.count("*").alias("length")).drop("run")


def segments(labels: DataFrame, least: int = MIN_SEGMENT) -> DataFrame:
    return runs(labels).where(F.col("length") >= least)


def durations(segs: DataFrame, sfreq: float) -> DataFrame:
    d = F.col("length") / F.lit(sfreq)
    return segs.groupBy("subject").agg(F.count("*").alias("total_segments"), F.avg(d).alias("mean_segment_duration"), F.stddev_pop(d).alias("std_segment_duration"), F.min(d).alias("min_segment_duration"), F.max(d).alias("max_segment_duration"))


def _grid(labels: DataFrame, n_states: int) -> DataFrame:
    """Every subject with every state, so that absent states count as zero."""
    return labels.select("subject").distinct().select("subject", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))).alias("state"))


def coverage(labels: DataFrame, n_states: int) -> DataFrame:
    per = labels.groupBy("subject", "state").agg(F.count("*").alias("c"))
    total = labels.groupBy("subject").agg(F.count("*").alias("n"))
    return _grid(labels, n_states).join(per, ["subject", "state"], "left").join(total, "subject").select("subject", "state", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("coverage"))


def occurrence(labels: DataFrame, n_states: int, sfreq: float, least: int) -> DataFrame:
    """Kept segments a second of each state."""
    per = segments(labels, least).groupBy("subject", "state").agg(F.count("*").alias("c"))
    total = labels.groupBy("subject").agg((F.count("*") / F.lit(sfreq)).alias("seconds"))
    return _grid(labels, n_states).join(per, ["subject", "state"], "left").join(total, "subject").select("subject", "state", (F.coalesce("c", F.lit(0)) / F.col("seconds")).alias("frequency"))


def transitions(labels: DataFrame, n_states: int) -> DataFrame:
    """Share of each next state after each state, dense; rows of states that never come are zero."""
    w = Window.partitionBy("subject").orderBy("n")
    steps = labels.select("subject", F.col("state").alias("a"), F.lead("state").over(w).alias("b")).where("b is not null").groupBy("subject", "a", "b").agg(F.count("*").alias("c"))
    sums = steps.groupBy("subject", "a").agg(F.sum("c").alias("total"))
    grid = _grid(labels, n_states).withColumnRenamed("state", "a").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
    return grid.join(steps, ["subject", "a", "b"], "left").join(sums, ["subject", "a"], "left").select("subject", "a", "b", F.coalesce(F.try_divide("c", "total"), F.lit(0.0)).alias("p"))


def transition_entropy(trans: DataFrame) -> DataFrame:
    """Row entropies, self-transition of each state, and the entropy of the whole matrix normalised to one."""
    w = Window.partitionBy("subject")
    rows = trans.withColumn("all", F.sum("p").over(w))
    per = rows.groupBy("subject", F.col("a").alias("state")).agg(F.sum(entropy(F.col("p"), F.lit(1.0))).alias("transition_entropy"), F.sum(F.when(F.col("a") == F.col("b"), F.col("p"))).alias("self_transition"), F.sum(entropy(F.col("p"), F.col("all"))).alias("part"))
    return per.withColumn("global_transition_entropy", F.sum("part").over(w)).drop("part")


def field_power(samples: DataFrame) -> DataFrame:
    """Standard deviation over channels at each time."""
    return samples.groupBy("subject", "n").agg(F.stddev_pop("x").alias("gfp"))


def field_power_stats(gfp: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean, deviation and maximum of field power by state and, with a null state, overall."""
    return gfp.join(labels, ["subject", "n"]).rollup("subject", "state").agg(F.avg("gfp").alias("mean_gfp"), F.stddev_pop("gfp").alias("std_gfp"), F.max("gfp").alias("max_gfp"), F.grouping_id().alias("g")).where("g <= 1").drop("g")


def topographic(templates: DataFrame) -> DataFrame:
    """Moments of each template (state, ch, v), and the entropy of its values scaled to 0..1."""
    w = Window.partitionBy("state")
    scaled = F.try_divide(F.col("v") - F.min("v").over(w), F.max("v").over(w) - F.min("v").over(w))
    rows = templates.withColumn("q", scaled).withColumn("total", F.sum("q").over(w))
    return rows.groupBy("state").agg(F.avg("v").alias("mean_amplitude"), F.stddev_pop("v").alias("std_amplitude"), F.max("v").alias("max_amplitude"), F.min("v").alias("min_amplitude"), F.sum(entropy(F.col("q"), F.col("total"))).alias("topographic_entropy"))


def cluster(samples: DataFrame, n_states: int = 4, n_init: int = 10, max_iter: int = 1000, seed: int = 42) -> tuple[DataFrame, list[list[float]]]:
    """Labels (subject, n, state) of time points and templates (a row for each state) in channel space.

    Time points become rows of z-scored channels, centred and projected on min(2 k, channels) principal components; k-means
    is fitted from ``n_init`` seeds and the cheapest kept. States are numbered by falling size, so numbers don't depend
    on the seed.
    """
    channels = sorted(r["ch"] for r in samples.select("ch").distinct().collect())
    wide = written(samples.groupBy("subject", "n").pivot("ch", channels).agg(F.first("x")).na.drop(), "time-points")
    mean = wide.agg(*[F.avg(c).alias(c) for c in channels]).first()
    centred = wide.select("subject", "n", array_to_vector(F.array(*[F.col(c) - F.lit(mean[c]) for c in channels])).alias("v"))
    pca = PCA(k=min(2 * n_states, len(channels)), inputCol="v", outputCol="features").fit(centred)
    points = pca.transform(centred).select("subject", "n", "features")
    best = _cheapest(points, n_states, n_init, max_iter, seed)
    back = pca.pc.toArray()
    return points.select("subject", "n", _nearest(best)(vector_to_array("features")).alias("state")), [[float(v) + mean[c] for c, v in zip(channels, back @ centre)] for centre in best]


#: Centres have settled when none moves further, as for pyspark.ml's k-means.
SETTLED = 1e-4


def _cheapest(points: DataFrame, k: int, n_init: int, max_iter: int, seed: int) -> np.ndarray:
    """The centres of the cheapest of ``n_init`` runs of k-means, by falling size.

    The runs start at the centres that pyspark.ml draws for their seeds and move together: a round of all that haven't settled is one
    job over the points, which are packed into matrices once. The sums of each task, of a few numbers a centre, reach the driver.
    """
    vectors = points.select("features").persist()
    try:
        runs = [np.array(KMeans(k=k, seed=seed + i, maxIter=0).fit(vectors).clusterCenters()) for i in range(n_init)]
    finally:
        vectors.unpersist()
    blocks = written(points.select(vector_to_array("features").alias("xs")).mapInArrow(_packed, "x binary"), "time-point-blocks").persist()
    try:
        going = list(range(n_init))
        for _ in range(max_iter):
            if not going:
                break
            left = []
            for i, (sums, n, _) in zip(going, _gathered(blocks, [runs[i] for i in going])):
                new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], runs[i])
                if ((new - runs[i]) ** 2).sum(axis=1).max() > SETTLED**2:
                    left.append(i)
                runs[i] = new
            going = left
        found = _gathered(blocks, runs)
    finally:
        blocks.unpersist()
    at = min(range(n_init), key=lambda i: found[i][2])
    return runs[at][np.argsort(-found[at][1], kind="stable")]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("xs").flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary())], names=["x"])


def _gathered(blocks: DataFrame, runs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each run's centres: the sums and the numbers of the points nearest to each, and the sum of their squared distances."""
    dim, every = runs[0].shape[1], np.concatenate(runs)
    ends = np.cumsum([len(r) for r in runs])
    half = (every * every).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, cost = np.zeros(every.shape), np.zeros(len(every)), np.zeros(len(ends))
        for batch in batches:
            for raw in batch.column("x").to_pylist():
                x = np.frombuffer(raw).reshape(-1, dim)
                apart, own = half - x @ every.T, np.arange(len(x))
                for i, end in enumerate(ends):
                    start = end - len(runs[i])
                    near = start + apart[:, start:end].argmin(axis=1)
                    held = np.zeros((len(x), end - start))
                    held[own, near - start] = 1
                    sums[start:end] += held.T @ x
                    n[start:end] += held.sum(axis=0)
                    cost[i] += (x * x).sum() + 2 * apart[own, near].sum()
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([sums.ravel(), n, cost])], pa.list_(pa.float64()))], names=["part"])

    total = np.sum([r["part"] for r in blocks.mapInArrow(run, "part array<double>").collect()] or [np.zeros(every.size + len(every) + len(ends))], axis=0)
    sums, n, cost = total[: every.size].reshape(every.shape), total[every.size : every.size + len(every)], total[every.size + len(every) :]
    return [(sums[end - len(r) : end], n[end - len(r) : end], float(c)) for r, end, c in zip(runs, ends, cost)]


def _nearest(centres: np.ndarray):
    """The number of the centre nearest to each vector."""

    @F.pandas_udf("int")
    def nearest(xs: pd.Series) -> pd.Series:
        x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, centres.shape[1]))
        return pd.Series(((centres * centres).sum(axis=1)[None] / 2 - x @ centres.T).argmin(axis=1).astype(np.int32))

    return nearest


def prepared(samples: DataFrame, fs: float, lo: float = 2.0, hi: float = 20.0, method: str = "iir") -> DataFrame:
    """Samples (subject, ch, n, x, numbered without gaps) filtered to the microstates' band, then z-scores by channel."""
    filtered = kernels.bandpass(preprocessing.packed(samples), lo, min(hi, fs / 2 * 0.99), fs, method)
    return zscore(preprocessing.unpacked(filtered))


def analyse(samples: DataFrame, fs: float, n_states: int = 4, least: int = MIN_SEGMENT, **options) -> tuple[DataFrame, DataFrame]:
    """The whole flow of a recording's microstates: filter, z-scores, clusters; then by (subject, state) the coverage and the
    kept segments a second, and the templates (state, ch, v) in channel space."""
    ready = written(prepared(samples, fs), "microstate-input")
    labels, centres = cluster(ready, n_states, **options)
    channels = sorted(r["ch"] for r in ready.select("ch").distinct().collect())
    templates = samples.sparkSession.createDataFrame([(k, c, float(v)) for k, row in enumerate(centres) for c, v in zip(channels, row)], "state int, ch string, v double")
    return coverage(labels, n_states).join(occurrence(labels, n_states, fs, least), ["subject", "state"]), templates


def packed_vector(col: str):
    return vector_to_array(F.col(col))
