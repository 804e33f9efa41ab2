"""Kernels and transforms against plain loops and their closed forms."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from burstline.functions import kernels as k


def response(taps, f, fs):
    return np.abs(np.exp(-2j * np.pi * np.outer(np.asarray(f) / fs, np.arange(len(taps)))) @ taps)


def test_bandpass_of_101_taps():
    taps = k.bandpass_taps(1500)
    assert len(taps) == 101 and np.allclose(taps, taps[::-1])
    assert np.abs(response(taps, np.linspace(150, 250, 200), 1500) - 1).max() < 0.025
    assert response(taps, [*np.linspace(0, 125, 200), *np.linspace(275, 750, 300)], 1500).max() < 0.025


def test_packaged_kernel_is_40_db_down():
    taps = k.packaged_kernel()
    assert len(taps) == 318 and np.allclose(taps, taps[::-1])
    assert np.abs(response(taps, np.linspace(150, 250, 400), 1500) - 1).max() < 0.01
    assert 20 * np.log10(response(taps, [*np.linspace(0, 140, 400), *np.linspace(260, 750, 800)], 1500).max()) < -40


def test_low_frequency_has_no_band():
    with pytest.raises(ValueError):
        k.bandpass_taps(500)


def test_zero_phase_is_forward_and_backward():
    rng = np.random.default_rng(1)
    taps, x = rng.standard_normal(21), rng.standard_normal(300)
    pad = 63
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    # Inside the padding the start-up of a causal filter has died away after len(taps) samples.
    forward = np.convolve(wide, taps)[: len(wide)]
    backward = np.convolve(forward[::-1], taps)[: len(wide)][::-1]
    assert np.allclose(k.zero_phase(x, taps)[: 300 - 1], backward[pad : pad + 299], atol=1e-9)
    with pytest.raises(ValueError):
        k.zero_phase(x[:63], taps)


@given(st.integers(1, 40_000))
@settings(max_examples=60, deadline=None)
def test_fast_length(n):
    def smooth(m):
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        return m == 1

    m = n
    while not smooth(m):
        m += 1
    assert k.fast_length(n) == m


@pytest.mark.parametrize("n", [1, 2, 7, 225, 700])
def test_envelope_matches_closed_form(n):
    x = np.random.default_rng(n).standard_normal(n)
    size = k.fast_length(n)
    xp = np.pad(x, (0, size - n))
    h = np.zeros(size)
    for i in range(size):
        for j in range(size):
            d = i - j
            if size % 2 == 0:
                h[i] += (2 / size / np.tan(np.pi * d / size)) * xp[j] if d % 2 else 0
            elif d:
                h[i] += (1 / np.tan(np.pi * d / size) - np.cos(np.pi * d) / np.sin(np.pi * d / size)) / size * xp[j]
    assert np.allclose(k.envelope(x), np.sqrt(xp**2 + h**2)[:n], atol=1e-10)


def test_envelope_scales_and_follows_amplitude():
    t = np.arange(3000) / 1500
    x = 3 * np.sin(2 * np.pi * 200 * t)
    assert np.allclose(k.envelope(x)[200:-200], 3, atol=0.05)
    assert np.allclose(k.envelope(2.5 * x), 2.5 * k.envelope(x))


def test_gaussian_kernel_and_convolution():
    w = k.gaussian_kernel(0.004, 1500)
    assert len(w) == 97 and abs(w.sum() - 1) < 1e-12
    x = np.random.default_rng(0).standard_normal(60_000)
    long = k.gaussian_kernel(0.1, 1500)
    assert np.allclose(k.convolve(x, long), np.convolve(x, long, "same"), atol=1e-9)
    short = np.ones(5)
    assert k.convolve(short, w).max() < 1 and len(k.convolve(short, w)) == 5


@pytest.mark.parametrize(("name", "low", "high"), [(0.5, -1.5, -0.5), (1.0, -2.5, -1.5)])
def test_noise_spectra(name, low, high):
    x = k.coloured_noise(16_384, name, np.random.default_rng(3))
    power = np.abs(np.fft.rfft(x)) ** 2
    f = np.arange(len(power))
    slope = np.polyfit(np.log(f[10:4000]), np.log(power[10:4000]), 1)[0]
    assert low < slope < high and abs(k.mean_square(x) - 1) < 1e-9
    assert len(k.coloured_noise(7, name, np.random.default_rng(3))) == 7
