import numpy as np
import pytest

from pulseforge.functions import dsp


@pytest.mark.parametrize(("order", "corner", "kind"), [(2, 0.5, "high"), (2, (5.0, 15.0), "band"), (3, (20.0, 60.0), "band"), (4, 30.0, "low"), (3, 30.0, "low")])
def test_butterworth_magnitude(order, corner, kind):
    fs = 250.0
    sos = dsp.butter(order, corner, fs, kind)
    f = np.linspace(0.05, 120, 800)
    w = np.tan(np.pi * f / fs)
    if kind == "band":
        a, b = np.tan(np.pi * np.array(corner) / fs)
        ratio = (w * w - a * b) / (w * (b - a))
    else:
        c = np.tan(np.pi * corner / fs)
        ratio = w / c if kind == "low" else c / w
    assert np.allclose(np.abs(dsp.response(sos, f, fs)), 1 / np.sqrt(1 + ratio ** (2 * order)), atol=1e-6)
    with pytest.raises(ValueError):
        dsp.butter(2, 200.0, 250.0)


def slow(s, x):
    y = np.zeros(len(x))
    for n in range(len(x)):
        y[n] = s[0] * x[n] + (s[1] * x[n - 1] - s[4] * y[n - 1] if n else 0) + (s[2] * x[n - 2] - s[5] * y[n - 2] if n > 1 else 0)
    return y


def test_blocked_recursion_equals_the_loop():
    rng = np.random.default_rng(0)
    for n in (1, 2, 63, 64, 65, 300):
        x = rng.normal(size=n)
        want = x
        sos = dsp.butter(2, (5.0, 15.0), 250.0, "band")
        for s in sos:
            want = slow(s, want)
        assert np.allclose(dsp.sosfilt(sos, x), want, atol=1e-10)


def test_zero_phase_and_leaky():
    t = np.arange(5000) / 250
    x = np.sin(2 * np.pi * 10 * t)
    y = dsp.filtfilt(dsp.butter(2, (5.0, 15.0), 250.0, "band"), x)
    assert np.abs(y[500:-500] - x[500:-500] * np.abs(dsp.response(dsp.butter(2, (5.0, 15.0), 250.0, "band"), [10.0], 250.0)[0]) ** 2).max() < 2e-3
    const = np.full(400, 3.0)
    assert np.allclose(dsp.filtfilt(dsp.butter(2, 20.0, 250.0, "low"), const), 3.0)
    a = 0.001 / 0.011
    want, y0 = [], 0.0
    for v in x[:50]:
        y0 = a * v + (1 - a) * y0
        want.append(y0)
    assert np.allclose(dsp.leaky(x[:50], 1000.0), want)


def test_resampling():
    t = np.arange(2000) / 1000
    x = np.sin(2 * np.pi * 7 * t)
    y = dsp.resample_poly(x, 250, 1000)
    assert len(y) == 500 and np.abs(y[50:-50] - np.sin(2 * np.pi * 7 * np.arange(500) / 250)[50:-50]).max() < 0.01
    y = dsp.resample_poly(x[:500], 3, 2)
    assert len(y) == 750 and np.abs(y[80:-80] - np.sin(2 * np.pi * 7 * np.arange(750) / 1500)[80:-80]).max() < 0.01
    whole = np.cos(2 * np.pi * 5 * np.arange(100) / 100)
    assert np.allclose(dsp.resample_fft(whole, 160), np.cos(2 * np.pi * 5 * np.arange(160) / 160), atol=1e-9)
    assert np.allclose(dsp.resample_fft(dsp.resample_fft(whole, 160), 100), whole, atol=1e-9)


def test_spectra_peaks_spline_delay():
    fs = 100.0
    x = np.sin(2 * np.pi * 1.0 * np.arange(1000) / fs)
    f, p = dsp.periodogram(x, fs)
    assert f[np.argmax(p)] == 1.0 and abs(np.sum(p) * (f[1] - f[0]) - np.var(x)) < 1e-9
    f, p = dsp.welch(x, fs, 200)
    assert f[np.argmax(p)] == 1.0
    assert dsp.find_peaks(np.array([0, 1, 0, 2, 2, 2, 0, 3, 0]), 1).tolist() == [1, 4, 7]
    assert dsp.find_peaks(np.array([0, 1, 0, 2, 0, 3, 0]), 3).tolist() == [1, 5]
    at = np.array([0.0, 0.7, 1.1, 2.0, 3.5])
    cube = lambda v: v**3 - 2 * v + 1
    assert np.allclose(dsp.cubic_spline(at, cube(at), np.linspace(0, 3.5, 20)), cube(np.linspace(0, 3.5, 20)))
    noise = np.random.default_rng(1).normal(size=3000)
    delay, r = dsp.cross_delay(noise[250:], noise[:-250], fs, 10.0)
    assert delay == 2.5 and r > 0.85
    env = dsp.analytic_envelope((1 + 0.5 * np.sin(2 * np.pi * np.arange(1000) / 500)) * np.cos(2 * np.pi * 0.1 * np.arange(1000)))
    assert abs(env.max() - 1.5) < 0.02
