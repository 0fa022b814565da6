import numpy as np
import pytest

from wavemill.functions import dsp

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("lo,hi,fs", [(0.5, 4, 1000), (8, 13, 250), (2, 20, 64), (30, 45, 500)])
def test_bandpass_passes_half_power_at_its_edges(lo, hi, fs):
    h = np.abs(dsp.response(dsp.butter_bandpass(lo, hi, fs), 2 * np.pi * np.array([lo, np.sqrt(lo * hi), hi]) / fs))
    assert h[0] == pytest.approx(2**-0.5, abs=1e-6) and h[2] == pytest.approx(2**-0.5, abs=1e-6)
    assert h[1] == pytest.approx(1, abs=0.02)


def test_bandpass_is_stable_and_refuses_bad_edges():
    assert all(s[5] < 1 for s in dsp.butter_bandpass(0.5, 4, 1000))
    with pytest.raises(ValueError):
        dsp.butter_bandpass(10, 5, 100)


def test_zero_phase_keeps_a_sine_in_band_in_place():
    t = np.arange(4000) / 250
    x = np.sin(2 * np.pi * 10 * t)
    y = dsp.zero_phase(x[None] + 5, dsp.butter_bandpass(5, 20, 250))[0]
    assert np.abs(y - x)[500:-500].max() < 0.01


def test_notch_takes_its_frequency_out():
    t = np.arange(5000) / 250
    y = dsp.zero_phase(np.sin(2 * np.pi * 50 * t)[None], dsp.notch(50, 250))[0]
    assert np.abs(y[1500:-1500]).max() < 0.01


def test_fir_has_unit_gain_in_band():
    h = dsp.fir_bandpass(5, 20, 250)
    w = np.exp(-2j * np.pi * np.outer([10, 60], np.arange(len(h))) / 250) @ h
    assert abs(w[0]) == pytest.approx(1, abs=0.02) and abs(w[1]) < 0.01


def test_welch_of_a_sine_integrates_to_its_power():
    t = np.arange(2000) / 200
    f, p = dsp.welch(np.sin(2 * np.pi * 20 * t), 200, 200)
    assert f[p[0].argmax()] == 20
    assert p[0].sum() * (f[1] - f[0]) == pytest.approx(0.5, abs=0.01)


def test_phase_of_a_cosine_is_linear():
    t = np.arange(256) / 256
    phase = np.unwrap(np.angle(dsp.analytic(np.cos(2 * np.pi * 8 * t))[0]))
    assert np.allclose(np.diff(phase), 2 * np.pi * 8 / 256)


def test_phase_locking_is_symmetric_and_bounded():
    p = RNG.uniform(-3, 3, (4, 500))
    p[1] = p[0] + 0.7
    m = dsp.phase_locking(p)
    assert np.allclose(m, m.T) and m[0, 1] == pytest.approx(1) and (m <= 1 + 1e-12).all()


def test_ica_finds_and_removes_the_reference():
    t = np.arange(3000) / 250
    sources = np.stack([np.sign(np.sin(2 * np.pi * 1.3 * t)), np.sin(2 * np.pi * 9 * t), RNG.laplace(size=3000)])
    x = RNG.standard_normal((5, 3)) @ sources
    y, bad = dsp.remove_components(x, sources[0], 3.0)
    assert len(bad) == 1
    assert max(abs(np.corrcoef(row, sources[0])[0, 1]) for row in y) < 0.15


def test_betweenness_of_a_star_and_a_path():
    assert dsp.betweenness(4, [(0, 1), (0, 2), (0, 3)]).tolist() == [1, 0, 0, 0]
    assert dsp.betweenness(3, [(0, 1), (1, 2)]).tolist() == [0, 1, 0]
