"""Independent components of recordings that are spread over tasks, and the removal of eye and heart artefacts.

A recording is cut into blocks of ``BLOCK`` samples of all its channels, with margins for filters; no task holds more than a
block. Everything that is fitted is a sum over blocks, added up in the tasks and then on the driver, which holds at most ``WAVE``
recordings' matrices (components x channels) at a time:

* means and the channels' Gram matrix, for whitening;
* each fixed-point step of FastICA (log-cosh contrast, symmetric decorrelation) over the recordings that still move;
* the eye score of a component: its correlation with the EOG channels, both filtered to 1-10 Hz;
* the heart score: beats are the greatest filtered ECG values within a refractory time that reach a threshold; the score is
  Kuiper's statistic of the component's 8-16 Hz phases across beats, the greatest over lags around the beat.

Filters have finite taps shorter than the margins, and beats are judged within margins, so results don't depend on the cuts.

Cases: samples are (subject, ch, n, x). A frame in which a channel of the recording is missing, null or not finite takes no
part in fitting and stays as it is. A recording that doesn't allow a fit (fewer than two complete frames, or no varying
channel) stays as it is and has no components. A named EOG or ECG channel that a recording lacks gives no score there. EOG and
ECG channels are no part of the decomposition and stay as they are. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.plans.shared import written

BLOCK, WAVE = 4096, 1000
EYE_BAND, HEART_BAND = (1.0, 10.0), (8.0, 16.0)
EYE_LIMIT, HEART_LIMIT, KUIPER_LIMIT = 3.0, 0.25, 2.8
#: Seconds between beats at least, and around a beat; lags and phase bins of the heart score; deviations above the mean of a beat.
REFRACTORY, AROUND, LAGS, PHASE_BINS, BEAT_DEVIATIONS = 0.4, 0.3, 33, 64, 2.5
_BLOCKS = "subject string, n0 long, lead int, core int, channels array<string>, data binary"


def band_taps(lo: float, hi: float, fs: float, one_sided: bool = False) -> np.ndarray:
    """Taps of a band-pass of two cycles of its low edge; one-sided ones give the analytic signal of the band."""
    hi = min(hi, 0.45 * fs)
    half = int(np.ceil(1.5 * fs / lo))
    k = np.arange(-half, half + 1)
    low = np.sinc((hi - lo) / fs * k) * (hi - lo) / fs * np.hamming(len(k))
    wave = 2 * np.pi * (lo + hi) / 2 / fs * k
    return 2 * low * (np.exp(1j * wave) if one_sided else np.cos(wave))


def _filtered(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Rows filtered without delay; beyond the ends the signal is zero, missing values count as zero."""
    x = np.where(np.isfinite(x), x, 0.0)
    size = 1 << int(np.ceil(np.log2(x.shape[1] + len(taps))))
    at = len(taps) // 2
    return np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(taps, size))[:, at : at + x.shape[1]]


def blocks(samples: DataFrame, size: int, pad: int) -> DataFrame:
    """Blocks with margins of ``pad`` samples, as matrices (channels x samples), written into the shared folder.

    A row: n0 the first own sample, lead the samples before it, core the own ones. A pad beyond the size reaches over several blocks.
    """
    own = F.floor(F.col("n") / size)
    reach = -(-pad // size)
    near = F.filter(F.sequence(own - reach, own + reach), lambda b: (F.col("n") >= b * size - pad) & (F.col("n") < (b + 1) * size + pad))
    rows = samples.where("subject is not null and ch is not null and n is not null").select("subject", "ch", "n", F.col("x").cast("double").alias("x"), F.explode(near).alias("b"))
    channels = rows.groupBy("subject", "b", "ch").agg(F.collect_list(F.struct("n", F.coalesce("x", F.lit(float("nan"))).alias("x"))).alias("p"))
    packed = channels.groupBy("subject", "b").agg(F.array_sort(F.collect_list(F.struct("ch", F.col("p.n").alias("ns"), F.col("p.x").alias("xs")))).alias("rows"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for subject, b, got in zip(*(batch.column(c).to_pylist() for c in ("subject", "b", "rows"))):
                least, most = min(min(r["ns"]) for r in got), max(max(r["ns"]) for r in got)
                first, last = max(least, b * size), min(most + 1, (b + 1) * size)
                if first >= last:
                    continue
                x = np.full((len(got), most - least + 1), np.nan)
                for k, r in enumerate(got):
                    x[k, np.array(r["ns"], np.int64) - least] = r["xs"]
                out.append((subject, first, first - least, last - first, [r["ch"] for r in got], x.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.binary()))],
                names=["subject", "n0", "lead", "core", "channels", "data"],
            )

    return written(packed.mapInArrow(matrices, _BLOCKS), "ica-blocks")


@dataclass
class Block:
    subject: str
    n0: int
    lead: int
    core: int
    channels: list[str]
    x: np.ndarray

    def rows(self, names: list[str]) -> np.ndarray:
        """The named channels, missing ones as nan, margins included."""
        at = {c: k for k, c in enumerate(self.channels)}
        return np.stack([self.x[at[c]] if c in at else np.full(self.x.shape[1], np.nan) for c in names]) if names else np.zeros((0, self.x.shape[1]))

    def own(self, x: np.ndarray) -> np.ndarray:
        return x[..., self.lead : self.lead + self.core]


def _blocks_of(batch: pa.RecordBatch) -> Iterator[Block]:
    for subject, n0, lead, core, channels, data in zip(*(batch.column(c).to_pylist() for c in ("subject", "n0", "lead", "core", "channels", "data"))):
        yield Block(subject, n0, lead, core, channels, np.frombuffer(data).reshape(len(channels), -1))


def _summed(cut: DataFrame, part: Callable[[Block], np.ndarray | None]) -> dict[str, np.ndarray]:
    """Sums over the blocks of each recording; each task adds up its own before anything leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, np.ndarray] = {}
        for batch in batches:
            for block in _blocks_of(batch):
                v = part(block)
                if v is not None:
                    got[block.subject] = got[block.subject] + v if block.subject in got else v
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array([v.tobytes() for v in got.values()], pa.binary())], names=["subject", "v"])

    out: dict[str, np.ndarray] = {}
    for subject, v in cut.mapInArrow(run, "subject string, v binary").collect():
        v = np.frombuffer(v)
        out[subject] = out[subject] + v if subject in out else v
    return out


@dataclass
class Fitted:
    """Of one recording: channels, means, sources = unmix @ (x - mean), x = mix @ sources + mean + rest."""

    channels: list[str]
    mean: np.ndarray
    unmix: np.ndarray
    mix: np.ndarray
    frames: int
    eye: np.ndarray = field(default_factory=lambda: np.zeros(0))
    heart: np.ndarray = field(default_factory=lambda: np.zeros(0))
    beats: int = 0

    def sources(self, x: np.ndarray) -> np.ndarray:
        return self.unmix @ (x - self.mean[:, None])

    def removed(self) -> list[int]:
        bad = set()
        if len(self.eye):
            z = (self.eye - self.eye.mean()) / (self.eye.std() or 1.0)
            bad |= {k for k in range(len(z)) if z[k] > EYE_LIMIT or self.eye[k] > 0.9}
        if len(self.heart):
            limit = max(HEART_LIMIT, KUIPER_LIMIT / np.sqrt(max(1, self.beats)))
            bad |= {k for k in range(len(self.heart)) if self.heart[k] >= limit}
        return sorted(bad)


def _complete(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x).all(axis=0)


def _decorrelated(w: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(w)
    return u @ v


def fit(cut: DataFrame, channels: dict[str, list[str]], n: int, max_iter: int, seed: int, tol: float) -> dict[str, Fitted]:
    """FastICA of every recording of the blocks; those that don't allow it are left out."""

    def moments(b: Block) -> np.ndarray | None:
        if b.subject not in channels:
            return None
        x = b.own(b.rows(channels[b.subject]))
        x = x[:, _complete(x)]
        return np.concatenate([[x.shape[1]], x.sum(axis=1), (x @ x.T).ravel()])

    out, state = {}, {}
    for subject, v in _summed(cut, moments).items():
        c = len(channels[subject])
        frames, total, gram = v[0], v[1 : c + 1], v[c + 1 :].reshape(c, c)
        if frames < 2:
            continue
        mean = total / frames
        value, vector = np.linalg.eigh(gram / frames - np.outer(mean, mean))
        k = min(n, int((value > max(value.max() * 1e-10, 1e-300)).sum()))
        if not k:
            continue
        value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
        vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(k)])
        start = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))[0]
        state[subject] = mean, (vector / np.sqrt(value)).T, vector * np.sqrt(value), start, int(frames)
    moving = set(state)
    for _ in range(max_iter):
        if not moving:
            break
        step = {s: (state[s][0], state[s][1], state[s][3]) for s in moving}

        def fixed_point(b: Block, step=step) -> np.ndarray | None:
            if b.subject not in step:
                return None
            mean, white, w = step[b.subject]
            x = b.own(b.rows(channels[b.subject]))
            z = white @ (x[:, _complete(x)] - mean[:, None])
            g = np.tanh(w @ z)
            return np.concatenate([(g @ z.T).ravel(), (1 - g * g).sum(axis=1)])

        for subject, v in _summed(cut, fixed_point).items():
            mean, white, colour, w, frames = state[subject]
            k = len(w)
            new = _decorrelated((v[: k * k].reshape(k, k) - v[k * k :][:, None] * w) / frames)
            state[subject] = mean, white, colour, new, frames
            if np.max(np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1)) < tol:
                moving.discard(subject)
    for subject, (mean, white, colour, w, frames) in state.items():
        out[subject] = Fitted(channels[subject], mean, w @ white, colour @ w.T, frames)
    return out


def _score_eyes(cut: DataFrame, fitted: dict[str, Fitted], eog: list[str], fs: float) -> None:
    taps = band_taps(*EYE_BAND, fs)

    def products(b: Block) -> np.ndarray | None:
        f = fitted.get(b.subject)
        if f is None or not any(c in b.channels for c in eog):
            return None
        s = b.own(_filtered(f.sources(b.rows(f.channels)), taps).real)
        e = b.own(_filtered(b.rows(eog), taps).real)
        return np.concatenate([[s.shape[1]], s.sum(1), (s * s).sum(1), e.sum(1), (e * e).sum(1), (e @ s.T).ravel()])

    for subject, v in _summed(cut, products).items():
        f, m = fitted[subject], len(eog)
        k = len(f.unmix)
        n, s1, s2, e1, e2, es = v[0], *np.split(v[1:], np.cumsum([k, k, m, m]))
        cov = es.reshape(m, k) / n - np.outer(e1, s1) / n**2
        spread = np.sqrt(np.maximum(0, e2 / n - (e1 / n) ** 2))[:, None] * np.sqrt(np.maximum(0, s2 / n - (s1 / n) ** 2))
        f.eye = np.abs(np.divide(cov, spread, out=np.zeros_like(cov), where=spread > 0)).max(axis=0)


def beats_of(envelope: np.ndarray, least: float, apart: int) -> np.ndarray:
    """Where a value reaches ``least`` and is the greatest (the first of equals) within ``apart`` samples on both sides."""
    high = np.flatnonzero(envelope >= least)
    return np.array([k for k in high if envelope[k] > envelope[max(0, k - apart) : k].max(initial=-1) and envelope[k] >= envelope[k : k + apart + 1].max()], np.int64)


def kuiper(counts: np.ndarray) -> np.ndarray:
    """Kuiper's statistic against the even distribution, of counts over the circle (last axis)."""
    total = counts.sum(axis=-1, keepdims=True)
    gap = np.cumsum(counts, axis=-1) / np.maximum(1, total) - np.arange(1, counts.shape[-1] + 1) / counts.shape[-1]
    return np.where(total[..., 0] > 0, gap.max(axis=-1) - gap.min(axis=-1), 0)


def _score_hearts(cut: DataFrame, fitted: dict[str, Fitted], ecg: str, fs: float) -> None:
    heart, phase = band_taps(*HEART_BAND, fs), band_taps(*HEART_BAND, fs, one_sided=True)
    lags = np.unique(np.round(np.linspace(-AROUND, AROUND, LAGS) * fs).astype(int))

    def envelope(b: Block) -> np.ndarray:
        return np.abs(_filtered(b.rows([ecg]), heart).real[0])

    def level(b: Block) -> np.ndarray | None:
        if b.subject not in fitted or ecg not in b.channels:
            return None
        e = b.own(envelope(b))
        return np.array([len(e), e.sum(), (e * e).sum()])

    least = {}
    for subject, (n, s1, s2) in _summed(cut, level).items():
        least[subject] = s1 / n + BEAT_DEVIATIONS * np.sqrt(max(0, s2 / n - (s1 / n) ** 2))

    def phases(b: Block) -> np.ndarray | None:
        if b.subject not in least or ecg not in b.channels or least[b.subject] <= 0:
            return None
        f = fitted[b.subject]
        at = beats_of(envelope(b), least[b.subject], int(REFRACTORY * fs))
        at = at[(at >= b.lead) & (at < b.lead + b.core)]
        at = at[(at + lags[0] >= 0) & (at + lags[-1] < b.x.shape[1])]
        k = len(f.unmix)
        counts = np.zeros((k, len(lags), PHASE_BINS))
        if len(at):
            angle = np.angle(_filtered(f.sources(b.rows(f.channels)), phase))[:, at[:, None] + lags]
            bins = np.minimum(PHASE_BINS - 1, ((angle + np.pi) / (2 * np.pi) * PHASE_BINS).astype(int))
            np.add.at(counts, (np.arange(k)[:, None, None], np.arange(len(lags))[None, None], bins), 1)
        return np.concatenate([[len(at)], counts.ravel()])

    for subject, v in _summed(cut, phases).items():
        f = fitted[subject]
        f.beats = int(v[0])
        f.heart = kuiper(v[1:].reshape(len(f.unmix), len(lags), PHASE_BINS)).max(axis=1)


def margin(fs: float, eog: bool, ecg: bool) -> int:
    """Samples that filters and beats reach beyond a block."""
    heart = len(band_taps(*HEART_BAND, fs)) // 2 + int(max(REFRACTORY, AROUND) * fs) + 2
    return max(len(band_taps(*EYE_BAND, fs)) // 2 if eog else 0, heart if ecg else 0)


def clean(samples: DataFrame, fs: float, eog: list[str] = (), ecg: str | None = None, n: int = 15, max_iter: int = 200, seed: int = 42, tol: float = 1e-4, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Samples without the components of eyes and heart, with ``removed`` their number; and what was found: (subject,
    component, eye, heart, beats, removed), scores null where there was no channel to score by."""
    spark = samples.sparkSession
    aside = set(eog) | ({ecg} if ecg else set())
    cut = blocks(samples, block, margin(fs, bool(eog), ecg is not None))
    waves = max(1, -(-cut.select("subject").distinct().count() // WAVE))
    cleaned, found = [], []
    for wave in range(waves):
        part = cut if waves == 1 else cut.where(F.pmod(F.xxhash64("subject"), F.lit(waves)) == wave)
        names = part.select("subject", F.explode("channels").alias("ch")).distinct().groupBy("subject").agg(F.array_sort(F.collect_list("ch")).alias("channels"))
        channels = {r["subject"]: [c for c in r["channels"] if c not in aside] for r in names.collect()}
        fitted = fit(part, {s: c for s, c in channels.items() if c}, n, max_iter, seed, tol)
        if eog and fitted:
            _score_eyes(part, fitted, list(eog), fs)
        if ecg and fitted:
            _score_hearts(part, fitted, ecg, fs)
        for subject, f in sorted(fitted.items()):
            bad = f.removed()
            found += [(subject, k, float(f.eye[k]) if len(f.eye) else None, float(f.heart[k]) if len(f.heart) else None, f.beats, k in bad) for k in range(len(f.unmix))]
        unmixing = {s: (f.channels, f.mean, f.unmix[b], f.mix[:, b], len(b)) for s, f in fitted.items() for b in (f.removed(),)}
        cleaned.append(part.mapInArrow(_applied(unmixing), "subject string, ch string, n0 long, xs array<double>, removed int"))
    out = cleaned[0]
    for more in cleaned[1:]:
        out = out.unionByName(more)
    long = out.select("subject", "ch", "n0", "removed", F.posexplode("xs").alias("k", "x")).where("x is not null")
    kinds = "subject string, component int, eye double, heart double, beats int, removed boolean"
    return long.select("subject", "ch", (F.col("n0") + F.col("k")).alias("n"), "x", "removed"), spark.createDataFrame(found, kinds)


def _applied(unmixing: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _blocks_of(batch):
                x = b.own(b.x).copy()
                names, mean, unmix, mix, removed = unmixing.get(b.subject, ([], None, None, None, 0))
                at = [b.channels.index(c) for c in names if c in b.channels]
                if removed and len(at) == len(names):
                    whole = _complete(x[at])
                    part = x[np.ix_(at, whole)]
                    x[np.ix_(at, whole)] = part - mix @ (unmix @ (part - mean[:, None]))
                values = pa.array(x.ravel(), pa.float64(), mask=np.isnan(x.ravel()))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                k = len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.subject] * k), pa.array(b.channels), pa.array([b.n0] * k, pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array([removed] * k, pa.int32())],
                    names=["subject", "ch", "n0", "xs", "removed"],
                )

    return run
