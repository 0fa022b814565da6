"""Small numpy kernels for signals shaped (channels, samples); operators run them on Arrow batches inside Spark tasks."""

from __future__ import annotations

import numpy as np


def butter_bandpass(lo: float, hi: float, fs: float, order: int = 4) -> np.ndarray:
    """Second-order sections (order x 6) of a Butterworth band-pass: analog prototype, band-pass transform, bilinear map.

    Sections keep low bands stable at high sampling rates, where one high-order polynomial diverges.
    """
    if not 0 < lo < hi < fs / 2:
        raise ValueError("need 0 < lo < hi < fs / 2")
    warp = 2 * fs * np.tan(np.pi * np.array([lo, hi]) / fs)
    width, middle = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(proto * proto - middle * middle)
    poles = np.concatenate([proto + root, proto - root])
    digital = (2 * fs + poles) / (2 * fs - poles)
    upper = digital[digital.imag > 0]
    upper = upper[np.argsort(np.abs(upper))]
    sos = np.array([[1.0, 0.0, -1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in upper])
    at = np.sqrt(lo * hi)
    gain = np.abs(response(sos, np.array([2 * np.arctan(middle / (2 * fs))])))[0] if at else 1.0
    sos[:, :3] /= gain ** (1 / len(sos))
    return sos


def notch(f0: float, fs: float, q: float = 30.0) -> np.ndarray:
    """One section that takes out f0 with a bandwidth of f0 / q."""
    w = 2 * np.pi * f0 / fs
    alpha = np.sin(w) / (2 * q)
    return np.array([[1, -2 * np.cos(w), 1, 1 + alpha, -2 * np.cos(w), 1 - alpha]]) / np.array([1 + alpha])


def response(sos: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Frequency response at angular frequencies (radians a sample)."""
    z = np.exp(-1j * w)
    out = np.ones(len(w), complex)
    for b0, b1, b2, a0, a1, a2 in sos:
        out *= (b0 + b1 * z + b2 * z * z) / (a0 + a1 * z + a2 * z * z)
    return out


def fir_bandpass(lo: float, hi: float, fs: float, taps: int | None = None) -> np.ndarray:
    """Hamming-windowed sinc taps of an odd number, as long as the low edge asks for unless given."""
    n = (taps or int(3.3 * fs / max(min(lo, 2.0), 0.25))) | 1
    k = np.arange(n) - n // 2
    h = (2 * hi / fs * np.sinc(2 * hi / fs * k) - 2 * lo / fs * np.sinc(2 * lo / fs * k)) * np.hamming(n)
    return h


def odd_extension(x: np.ndarray, pad: int) -> np.ndarray:
    return np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)


def _zero_phase_plan(sos: np.ndarray, n: int) -> tuple[int, np.ndarray]:
    """Padding and gain of zero-phase filtering of n samples."""
    slowest = max(np.sqrt(abs(s[5] / s[3])) for s in sos)
    pad = min(n - 1, max(27, int(np.ceil(np.log(1e-12) / np.log(min(slowest, 0.999999))))))
    size = 1 << int(np.ceil(np.log2(n + 3 * max(pad, 0))))
    return pad, np.abs(response(sos, 2 * np.pi * np.arange(size // 2 + 1) / size)) ** 2


def zero_phase(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """Forward and backward filtering: the squared magnitude of the response, applied by FFT to an odd extension."""
    x = np.atleast_2d(np.asarray(x, float))
    n = x.shape[1]
    pad, gain = _zero_phase_plan(sos, n)
    if pad < 1:
        return x * 0
    size = 2 * (len(gain) - 1)
    return np.fft.irfft(np.fft.rfft(odd_extension(x, pad), size) * gain, size)[:, pad : pad + n]


def zero_phase_kernel(sos: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The circular kernel, and the padding, by which ``zero_phase`` filters n samples."""
    pad, gain = _zero_phase_plan(sos, n)
    return np.fft.irfft(gain), pad


def fir_filter(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Linear-phase filtering with the delay taken out."""
    x = np.atleast_2d(np.asarray(x, float))
    pad = min(len(taps) // 2, x.shape[1] - 1)
    wide = odd_extension(x, pad) if pad else x
    size = 1 << int(np.ceil(np.log2(wide.shape[1] + len(taps))))
    y = np.fft.irfft(np.fft.rfft(wide, size) * np.fft.rfft(taps, size), size)
    at = pad + len(taps) // 2
    return y[:, at : at + x.shape[1]]


def _one_sided(n: int) -> np.ndarray:
    double = np.zeros(n)
    double[0] = 1
    double[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        double[n // 2] = 1
    return double


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal by a one-sided spectrum."""
    x = np.atleast_2d(np.asarray(x, float))
    return np.fft.ifft(np.fft.fft(x) * _one_sided(x.shape[1]))


def analytic_kernel(n: int) -> np.ndarray:
    """The circular kernel that makes n samples analytic."""
    return np.fft.ifft(_one_sided(n))


def _segments(x: np.ndarray, nperseg: int, noverlap: int) -> np.ndarray:
    """Windowed spectra (channels, segments, frequencies) of mean-free overlapping segments."""
    x = np.atleast_2d(np.asarray(x, float))
    cut = np.lib.stride_tricks.sliding_window_view(x, nperseg, axis=1)[:, :: nperseg - noverlap]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    return np.fft.rfft((cut - cut.mean(axis=2, keepdims=True)) * window)


def csd(x: np.ndarray, y: np.ndarray, fs: float, nperseg: int = 256, noverlap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cross-spectral density, averaged over segments: periodic Hann window, density scaling, one-sided."""
    n = min(nperseg, np.atleast_2d(x).shape[1])
    over = n // 2 if noverlap is None else min(noverlap, n - 1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    p = (np.conj(_segments(x, n, over)) * _segments(y, n, over)).mean(axis=1) / (fs * (window**2).sum())
    p[:, 1 : None if n % 2 else -1] *= 2
    return np.arange(n // 2 + 1) * fs / n, p


def welch(x: np.ndarray, fs: float, nperseg: int = 256, noverlap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    f, p = csd(x, x, fs, nperseg, noverlap)
    return f, p.real


def fast_ica(x: np.ndarray, n: int = 15, max_iter: int = 200, seed: int = 42, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sources (n, samples), mixing matrix (channels, n) and channel means by symmetric FastICA with the log-cosh contrast."""
    mean = x.mean(axis=1, keepdims=True)
    c = x - mean
    value, vector = np.linalg.eigh(c @ c.T / c.shape[1])
    n = min(n, int((value > value.max() * 1e-10).sum()))
    value, vector = value[::-1][:n], vector[:, ::-1][:, :n]
    white = (vector / np.sqrt(value)).T
    z = white @ c
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]
    for _ in range(max_iter):
        g = np.tanh(w @ z)
        new = g @ z.T / z.shape[1] - (1 - g * g).mean(axis=1)[:, None] * w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.max(np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1)) < tol
        w = new
        if done:
            break
    return w @ z, (vector * np.sqrt(value)) @ w.T, mean


def remove_components(x: np.ndarray, reference: np.ndarray, limit: float = 3.0, n: int = 15, seed: int = 42) -> tuple[np.ndarray, list[int]]:
    """x without the independent components whose correlation with a reference (EOG, ECG) stands out by z-score."""
    s, mix, mean = fast_ica(x, n, seed=seed)
    r = np.abs([np.corrcoef(row, reference)[0, 1] for row in s])
    z = (r - r.mean()) / (r.std() or 1.0)
    bad = [k for k in range(len(r)) if z[k] > limit or r[k] > 0.9]
    keep = s.copy()
    keep[bad] = 0
    return mix @ keep + mean + (x - mean - mix @ s), bad


def phase_locking(phase: np.ndarray) -> np.ndarray:
    """|mean exp(i (p_i - p_j))| of channels' phases, zero on the diagonal."""
    u = np.exp(1j * phase)
    out = np.abs(u @ u.conj().T) / phase.shape[1]
    np.fill_diagonal(out, 0.0)
    return out


def betweenness(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """Normalised betweenness of an unweighted graph, by breadth-first path counts and back-accumulated dependencies."""
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    total = np.zeros(n)
    for s in range(n):
        depth, paths, order = [-1] * n, np.zeros(n), [s]
        depth[s], paths[s] = 0, 1
        for v in order:
            for w in near[v]:
                if depth[w] < 0:
                    depth[w] = depth[v] + 1
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        share = np.zeros(n)
        for w in reversed(order[1:]):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            total[w] += share[w]
    return total / ((n - 1) * (n - 2)) if n > 2 else total
