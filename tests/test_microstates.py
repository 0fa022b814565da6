"""Clusters of time points: runs of k-means that move together against single ones."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wavemill.operators import microstates


def cloud(n=240):
    r = np.random.default_rng(3)
    return (r.normal(0, 3, (5, 3))[r.integers(5, size=n)] + r.normal(0, 0.8, (n, 3))).tolist()


def test_runs_that_move_together_end_like_single_ones(spark):
    x = cloud()
    points = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "n long, xs array<double>").select("n", array_to_vector("xs").alias("features")).persist()
    models = [KMeans(k=4, seed=42 + i, maxIter=1000).fit(points) for i in range(4)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    got = microstates._cheapest(points, 4, 4, 1000, 42)
    order = np.argsort([-n for n in best.summary.clusterSizes], kind="stable")
    assert np.allclose(got, np.array(best.clusterCenters())[order], atol=1e-6)
    points.unpersist()


def test_runs_of_k_means_share_their_jobs(spark):
    """Ten runs took a job for each step of each one; together they take about as many as the longest."""
    rows = [(str(i % 2), f"c{c}", i, v) for i, x in enumerate(np.random.default_rng(5).normal(0, 1, (1200, 6)).tolist()) for c, v in enumerate(x)]
    samples = spark.createDataFrame(rows, "subject string, ch string, n long, x double")
    group = "shared rounds"
    spark.sparkContext.setJobGroup(group, group)
    try:
        labels, centres = microstates.cluster(samples, 4)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 300, jobs
    counts = [r["c"] for r in labels.groupBy("state").agg(F.count("*").alias("c")).orderBy("state").collect()]
    assert sum(counts) == 1200 and counts == sorted(counts, reverse=True) and len(centres) == 4
