"""Row layouts of the data model, and conversions between its long and packed forms.

samples   (subject, task, ch_idx, ch, n, x)                  one row for each sample of each channel
marks     (subject, task, sample, prev, code)                event marks
epochs    (subject, epoch, code, ch_idx, ch, k, t, x)        event-locked segments
psd       (subject, ch_idx, f_idx, freq, p)                  spectra
features  (subject, task, ftype, name, value)                the feature store, long
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = "subject string, task string, ch_idx int, ch string, n bigint, x double"
MARKS = "subject string, task string, sample bigint, prev int, code int"
EPOCHS = "subject string, task string, epoch bigint, code int, ch_idx int, ch string, k int, t double, x double"
PSD = "subject string, task string, ch_idx int, f_idx int, freq double, p double"
FEATURES = "subject string, task string, ftype string, name string, value double"
VALIDATION = "subject string, passed boolean, issues array<string>, quality_metrics map<string,double>"


def pack(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Long samples to one array ``xs`` for each key, in order of n: the form that kernels take."""
    return samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("s")).select(*keys, F.col("s.x").alias("xs"))


def unpack(packed: DataFrame, keys: list[str]) -> DataFrame:
    return packed.select(*keys, F.posexplode("xs").alias("n", "x")).withColumn("n", F.col("n").cast("long"))
