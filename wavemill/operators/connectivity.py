"""Functional connectivity between channels of a recording, as an edge list (keys, i, j, w) with i < j.

Sums over pairs of channels are products of matrices, a block of times at once (``pairsums``), never joins of the samples with
themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators import kernels, preprocessing
from wavemill.operators.ica import _blocks_of, blocks
from wavemill.operators.pairsums import joint_codes, phasors
from wavemill.operators.quality import gram, pearson
from wavemill.plans.shared import written

N_BINS = 20
METHODS = ("plv", "correlation", "coherence", "mutual_information", "mutual_info")


def plv(phases: DataFrame) -> DataFrame:
    """Length of the mean of exp(i (x - y)) over time, of phases (subject, n, ch, x)."""
    return phasors(phases, ["subject"]).select("subject", "i", "j", (F.hypot("re", "im") / F.col("n")).alias("w"))


def correlation(samples: DataFrame) -> DataFrame:
    return gram(samples, ["subject"], row="n", name="ch", value="x").select("subject", "i", "j", F.abs(pearson()).alias("w"))


def bins(samples: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """Codes 1..n_bins of n_bins equal edges from each channel's least to its greatest value; only the greatest gets the last."""
    s = samples.groupBy("subject", "ch").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    code = F.coalesce(F.least(F.lit(n_bins), F.floor(F.try_divide(F.col("x") - F.col("lo"), (F.col("hi") - F.col("lo")) / (n_bins - 1))).cast("int") + 1), F.lit(1))
    return samples.join(s, ["subject", "ch"]).withColumn("code", code).drop("lo", "hi")


def mutual_information(samples: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """Mutual information (nats) of channels' codes: H(i) + H(j) - H(i, j), from counts of joint codes."""
    joint = written(joint_codes(bins(samples, n_bins), ["subject"], n_bins), "joint-codes")

    def h(*cols: str) -> DataFrame:
        part = joint.groupBy("subject", "i", "j", *cols).agg(F.sum("c").alias("c"))
        return part.groupBy("subject", "i", "j").agg((F.ln(F.sum("c")) - F.sum(F.col("c") * F.ln("c")) / F.sum("c")).alias("h_" + "_".join(cols)))

    both = h("x").join(h("y"), ["subject", "i", "j"]).join(h("x", "y"), ["subject", "i", "j"])
    return both.select("subject", "i", "j", (F.col("h_x") + F.col("h_y") - F.col("h_x_y")).alias("w"))


#: Samples in a block of ``coherence``, at least a segment.
SPECTRUM_BLOCK = 4096


def coherence(samples: DataFrame, fs: float = 1000.0, nperseg: int = 256, noverlap: int | None = None) -> DataFrame:
    """Mean over frequency of |Pxy|^2 / (Pxx Pyy) of samples (subject, ch, n, x), n from 0 without gaps; a recording shorter
    than ``nperseg`` is one segment. A channel that lacks a value in a segment counts as silent there.

    Cross-spectra are sums over segments. Recordings are cut into blocks with a segment's margin; each segment is taken where it
    begins, tasks add up what they hold of a recording, and rows of the summed matrices (channel x all channels and frequencies)
    meet by (subject, channel).
    """
    cut = blocks(samples, max(SPECTRUM_BLOCK, nperseg), nperseg)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for b in _blocks_of(batch):
                span = b.x.shape[1]
                n = nperseg if b.lead or span >= nperseg else span
                hop = n - (n // 2 if noverlap is None else min(noverlap, n - 1))
                own = np.arange(b.n0, b.n0 + b.core)
                starts = own[(own % hop == 0) & (own - b.n0 + b.lead + n <= span)] - b.n0 + b.lead
                if n < 2 or not len(starts):
                    continue
                window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
                x = b.x[:, starts[:, None] + np.arange(n)]
                f = np.fft.rfft(np.nan_to_num((x - x.mean(axis=2, keepdims=True)) * window))
                key = b.subject, tuple(b.channels), n
                g = np.einsum("isf,jsf->ijf", np.conj(f), f)
                held[key] = held[key] + g if key in held else g
        out = [(subject, ch, list(channels), g[i].tobytes()) for (subject, channels, _), g in held.items() for i, ch in enumerate(channels)]
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)], names=["subject", "i", "channels", "g"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, {}

        def told(done: list) -> pa.RecordBatch:
            out = [(*k, ch, got[k[1]].real.tolist(), (np.abs(v) ** 2).tolist()) for k, got in done for ch, v in got.items()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["subject", "i", "j", "own", "cross"])

        for batch in batches:
            done = []
            for subject, i, channels, g in zip(*(batch.column(c).to_pylist() for c in ("subject", "i", "channels", "g"))):
                if (subject, i) != key:
                    if key is not None:
                        done.append((key, sums))
                    key, sums = (subject, i), {}
                for ch, row in zip(channels, np.frombuffer(g, complex).reshape(len(channels), -1)):
                    sums[ch] = sums[ch] + row if ch in sums else row
            yield told(done)
        if key is not None:
            yield told([(key, sums)])

    parts = cut.mapInArrow(cross, "subject string, i string, channels array<string>, g binary").repartition("subject", "i").sortWithinPartitions("subject", "i")
    spectra = parts.mapInArrow(summed, "subject string, i string, j string, own array<double>, cross array<double>")
    rows = written(spectra, "cross-spectra")
    own = rows.where("i = j").select("subject", F.col("i").alias("j"), F.col("own").alias("other"))
    share = F.transform(F.arrays_zip("cross", "own", "other"), lambda z: F.when(z["own"] * z["other"] > 0, z["cross"] / (z["own"] * z["other"])))
    known = F.array_compact(share)
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known))
    return rows.where("i < j").join(own, ["subject", "j"]).select("subject", "i", "j", mean.alias("w"))


def matrix(samples: DataFrame, method: str, **options) -> DataFrame:
    """Edges by a method's name; samples hold phases for plv."""
    table = {"plv": plv, "correlation": correlation, "coherence": coherence, "mutual_information": mutual_information, "mutual_info": mutual_information}
    if method not in table:
        raise ValueError(f"unknown method {method}; one of {', '.join(METHODS)}")
    return table[method](samples, **options)


def by_band(samples: DataFrame, fs: float, bands: list[tuple[str, float, float]], method: str = "plv", filter_method: str = "iir", **options) -> DataFrame:
    """Edges (subject, band, i, j, w) of samples (subject, ch, n, x, numbered without gaps): for each band the channels are
    filtered, for plv turned into phases, and compared by the method."""
    channels = preprocessing.packed(samples)
    out = None
    for band, lo, hi in bands:
        filtered = kernels.bandpass(channels, lo, hi, fs, filter_method)
        edges = matrix(preprocessing.unpacked(kernels.phases(filtered) if method == "plv" else filtered), method, **options)
        edges = edges.select("subject", F.lit(band).alias("band"), "i", "j", "w")
        out = edges if out is None else out.unionByName(edges)
    if out is None:
        raise ValueError("no bands")
    return out


def coupling(one: DataFrame, two: DataFrame) -> DataFrame:
    """Cross-frequency coupling: the mean over i <> j of the phase locking of channel i in one band and j in the other.

    With the channels' unit phasors packed by time, one pass sums all pairs; the diagonal is left out.
    """
    a = one.groupBy("subject", "n").agg(F.array_sort(F.collect_list(F.struct("ch", "x"))).alias("a"))
    b = two.groupBy("subject", "n").agg(F.array_sort(F.collect_list(F.struct("ch", "x"))).alias("b"))
    rows = a.join(b, ["subject", "n"]).select("subject", F.explode("a").alias("p"), "b").select("subject", "p", F.explode("b").alias("q")).where("p.ch <> q.ch")
    d = F.col("p.x") - F.col("q.x")
    return rows.groupBy("subject", F.col("p.ch").alias("i"), F.col("q.ch").alias("j")).agg(F.hypot(F.avg(F.cos(d)), F.avg(F.sin(d))).alias("w")).groupBy("subject").agg(F.avg("w").alias("coupling"))


def global_synchronization(phases: DataFrame) -> DataFrame:
    """Mean over time of the length of the channels' mean phasor."""
    at = phases.groupBy("subject", "n").agg(F.hypot(F.avg(F.cos("x")), F.avg(F.sin("x"))).alias("r"))
    return at.groupBy("subject").agg(F.avg("r").alias("global_synchronization"))


def matrix_stats(edges: DataFrame, n_nodes: int, threshold: float = 0.5) -> DataFrame:
    """Statistics over all n x n cells, the zero diagonal included; density_cells counts ordered cells."""
    n2 = float(n_nodes * n_nodes)
    s = edges.groupBy("subject").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("ss"), F.max("w").alias("hi"), F.min("w").alias("lo"), F.count_if(F.col("w") > threshold).alias("over"))
    mean = 2 * F.col("s") / n2
    return s.select(
        "subject", mean.alias("mean_connectivity"), F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("ss") / n2 - mean * mean)).alias("std_connectivity"), F.greatest(F.col("hi"), F.lit(0.0)).alias("max_connectivity"),
        F.least(F.col("lo"), F.lit(0.0)).alias("min_connectivity"), (2 * F.col("over") / F.lit(n_nodes * (n_nodes - 1) / 2)).alias("density_cells"),
    )


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("subject", F.col("i").alias("a"), F.col("j").alias("b"), "w").union(edges.select("subject", F.col("j").alias("a"), F.col("i").alias("b"), "w"))


def node_strength(edges: DataFrame) -> DataFrame:
    per = both_ways(edges).groupBy("subject", "a").agg(F.sum("w").alias("s"))
    return per.groupBy("subject").agg(F.avg("s").alias("mean_node_strength"), F.stddev_pop("s").alias("std_node_strength"), F.max("s").alias("max_node_strength"))
