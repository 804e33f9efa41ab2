"""Kernels and whole-signal transforms in NumPy: filter design, convolution, analytic envelope."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Band of interest, sampling frequency of the packaged kernel and the lowest one it serves (Hz).
BAND = (150.0, 250.0)
KERNEL_FREQUENCY, KERNEL_LOWEST = 1500.0, 1200.0
#: sd of a normal distribution over its median absolute deviation.
MAD_TO_SD = 1 / 0.6744897501960817


def gaussian_kernel(sigma: float, sampling_frequency: float, truncate: float = 8.0) -> np.ndarray:
    """Weights of a normal curve of `sigma` seconds, cut at `truncate` deviations, summing to one."""
    sd = float(sigma) * float(sampling_frequency)
    radius = int(truncate * sd + 0.5)
    if sd <= 0:
        return np.ones(1)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sd) ** 2)
    return w / w.sum()


def remez(taps: int, bands: list[tuple[float, float]], gains: list[float], sampling_frequency: float, density: int = 16) -> np.ndarray:
    """Taps of the minimax linear-phase FIR filter, by exchange of extremal frequencies."""
    odd = taps % 2 == 1
    m = (taps + 1) // 2
    grid, want, weight = [], [], []
    step = 0.5 / (density * m)
    for (a, b), g in zip(bands, gains, strict=True):
        low, high = a / sampling_frequency, b / sampling_frequency
        if not odd:
            high = min(high, 0.5 - step)
        f = np.linspace(low, high, max(int(round((high - low) / step)) + 1, 4))
        grid.append(f)
        want.append(np.full(len(f), float(g)))
    f, d = np.concatenate(grid), np.concatenate(want)
    w = np.ones(len(f))
    if not odd:  # an even length has a factor cos(pi f), taken out of the target
        d, w = d / np.cos(np.pi * f), np.cos(np.pi * f)
    x = np.cos(2 * np.pi * f)
    edges = np.cumsum([0, *(len(g) for g in grid)])
    extremes = np.linspace(0, len(f) - 1, m + 1).round().astype(int)
    for _ in range(100):
        xe, sign = x[extremes], (-1.0) ** np.arange(m + 1)
        basis = np.cos(np.outer(np.arccos(np.clip(xe, -1, 1)), np.arange(m)))
        solved = np.linalg.solve(np.column_stack([basis, sign / w[extremes]]), d[extremes])
        cosines, level = solved[:-1], abs(solved[-1])
        error = w * (np.cos(np.outer(np.arccos(np.clip(x, -1, 1)), np.arange(m))) @ cosines - d)
        peaks = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            e = error[a:b]
            left, right = np.append(-np.inf, e[:-1] * np.sign(e[1:])), np.append(e[1:] * np.sign(e[:-1]), -np.inf)
            size = np.abs(e)
            peaks += [a + i for i in range(len(e)) if size[i] >= left[i] and size[i] >= right[i]]
        runs: list[int] = []
        for i in peaks:  # of neighbours of one sign only the largest
            if runs and np.sign(error[i]) == np.sign(error[runs[-1]]):
                if abs(error[i]) > abs(error[runs[-1]]):
                    runs[-1] = i
            else:
                runs.append(i)
        while len(runs) > m + 1:
            runs.pop(0 if abs(error[runs[0]]) <= abs(error[runs[-1]]) else -1)
        if len(runs) < m + 1:
            break
        new = np.asarray(runs)
        if np.array_equal(new, extremes) or np.abs(error[new]).max() - level < 1e-9:
            extremes = new
            break
        extremes = new
    if odd:
        half = cosines / 2
        half[0] = cosines[0]
        return np.concatenate([half[:0:-1], half])
    # cos(pi f) * sum a_k cos(2 pi k f) has terms at half steps.
    half = np.zeros(m)
    half[0] = cosines[0] + (cosines[1] / 2 if m > 1 else 0)
    for k in range(1, m):
        half[k] = (cosines[k] + (cosines[k + 1] if k + 1 < m else 0)) / 2
    return np.concatenate([half[::-1], half]) / 2


def bandpass_taps(sampling_frequency: float) -> np.ndarray:
    """101 taps that pass 150 to 250 Hz, with 25 Hz on either side to fall off."""
    if sampling_frequency <= 550:
        raise ValueError("the band needs a sampling frequency above 550 Hz")
    nyquist = sampling_frequency / 2
    return remez(101, [(0, BAND[0] - 25), BAND, (BAND[1] + 25, nyquist)], [0, 1, 0], sampling_frequency)


@cache
def packaged_kernel() -> np.ndarray:
    """Our own 318 taps for 1500 Hz: 150 to 250 Hz passed, 40 dB down 10 Hz away; designed on first use."""
    return remez(318, [(0, BAND[0] - 10), BAND, (BAND[1] + 10, KERNEL_FREQUENCY / 2)], [0, 1, 0], KERNEL_FREQUENCY)


def convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same-length convolution with zeros outside; by FFT where that is less work."""
    n, k = len(x), len(kernel)
    if n == 0:
        return np.zeros(0)
    if n * k < 1 << 22 or k < 64:
        full = np.convolve(x, kernel)
    else:
        size = fast_length(n + k - 1)
        full = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(kernel, size), size)[: n + k - 1]
    return full[(k - 1) // 2 : (k - 1) // 2 + n]


def zero_phase(x: np.ndarray, taps: np.ndarray, begins: bool = True, ends: bool = True) -> np.ndarray:
    """The filter forward and backward over the signal reflected oddly by three lengths at each end: one symmetric kernel.

    Where x is a part of a signal that doesn't begin or end with it there is no reflection, and the values next to that side, within a kernel's length, are of no use.
    """
    pad = 3 * len(taps)
    if begins and ends and len(x) <= pad:
        raise ValueError(f"{len(x)} samples are too few for {len(taps)} taps: more than {pad} are needed")
    reach = min(pad, len(x) - 1)
    before = 2 * x[0] - x[reach:0:-1] if begins else x[:0]
    after = 2 * x[-1] - x[-2 : -reach - 2 : -1] if ends else x[:0]
    return convolve(np.concatenate([before, x, after]), np.convolve(taps, taps[::-1]))[len(before) : len(before) + len(x)]


def fast_length(n: int) -> int:
    """The least number of factors 2, 3 and 5 that is not below n."""
    best = 1 << (n - 1).bit_length() if n > 1 else 1
    five = 1
    while five < best:
        three = five
        while three < best:
            rest = -(-n // three)
            best = min(best, three * (1 << (rest - 1).bit_length() if rest > 1 else 1))
            three *= 3
        five *= 5
    return best


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal of x padded with zeros to a fast length."""
    n = len(x)
    if n == 0:
        return np.zeros(0)
    size = fast_length(n)
    spectrum = np.fft.fft(x, size)
    gain = np.zeros(size)
    gain[0] = 1
    gain[1 : (size + 1) // 2] = 2
    if size % 2 == 0:
        gain[size // 2] = 1
    return np.abs(np.fft.ifft(spectrum * gain))[:n]


def mean_square(x: np.ndarray) -> float:
    return float(np.mean(np.abs(x) ** 2))


def coloured_noise(n: int, power: float, rng: np.random.Generator) -> np.ndarray:
    """n samples whose amplitudes fall as frequency to the -power (0 white, 1/2 pink, 1 brown), of mean square one."""
    if n == 0:
        return np.zeros(0)
    if power == 0:
        return rng.standard_normal(n)
    bins = n // 2 + 1 + n % 2
    spectrum = (rng.standard_normal(bins) + 1j * rng.standard_normal(bins)) / np.arange(1, bins + 1) ** power
    y = np.fft.irfft(spectrum)[: n + n % 2][:n]
    size = mean_square(y)
    return y / np.sqrt(size) if size else np.full(n, np.nan)
