"""Array kernels of the spike detector: they see one bounded chunk of one trace."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: Fixed values of the detector (readings, or multiples of a scale).
HALF_WINDOW = 5
SPIKE_WIDTH = 3
MAD_TO_SIGMA = 1.4826
CANDIDATE_SCALES = 4.0
CONFIRM_SCALES = 6.0
#: Sizes are counted in so many bins an octave; values up to LEAST are nothing.
BINS, LEAST = 8, 1e-9


def rolling_median(values: np.ndarray, half: int) -> np.ndarray:
    """Median over the readings i-half .. i+half, the edges mirrored."""
    if len(values) == 0:
        return values.astype(float)
    padded = np.pad(values, (half, half), mode="reflect" if len(values) > half else "edge")
    return np.median(sliding_window_view(padded, 2 * half + 1), axis=1)


def noise_scale(values: np.ndarray) -> float:
    """Noise of a trace from its second differences, at least half its usual smallest step."""
    if len(values) < 3:
        return 0.0
    steps = np.abs(np.diff(values))
    steps = steps[steps > 1e-9]
    resolution = float(np.percentile(steps, 1)) if len(steps) else 0.0
    bends = np.abs(values[:-2] - 2 * values[1:-1] + values[2:])
    return max(MAD_TO_SIGMA * float(np.median(bends)) / 6**0.5, 0.5 * resolution)


def size_bins(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithmic bins and how many sizes each has; -32768 is the bin of those that are nothing."""
    some = sizes > LEAST
    bins = np.full(len(sizes), -32768)
    bins[some] = np.floor(np.log2(sizes[some]) * BINS)
    return np.unique(bins, return_counts=True)


def own_sizes(values: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bends at and steps to the core readings, their neighbours taken from the halo."""
    steps = np.abs(np.diff(values))[core[1:]]
    bends = np.abs(values[:-2] - 2 * values[1:-1] + values[2:])[core[1:-1]] if len(values) > 2 else np.zeros(0)
    return bends, steps


def local_rate(values: np.ndarray, half: int = 8) -> np.ndarray:
    """Usual change per reading around each reading."""
    if len(values) < 2:
        return np.zeros(len(values))
    return rolling_median(np.append(np.abs(np.diff(values)), 0.0)[: len(values)], half)


def hampel(values: np.ndarray, half: int = HALF_WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each reading from its window's median, and the window's MAD; the window's own slope is taken out.

    The slope is the median of the window's steps: without that, a ramp's MAD would be the ramp's and hide its spikes.
    """
    n = len(values)
    mode = "reflect" if n > half else "edge"
    if mode == "edge":
        middle = np.median(values)
        return np.abs(values - middle), np.full(n, np.median(np.abs(values - middle)))
    # mirrored through the end points, so that a ramp goes on beyond them
    padded = np.pad(values, (half, half), mode="reflect", reflect_type="odd")
    windows = sliding_window_view(padded, 2 * half + 1)
    slope = np.median(np.diff(windows, axis=1), axis=1)
    level = windows - slope[:, None] * np.arange(-half, half + 1)[None, :]
    middle = np.median(level, axis=1)
    return np.abs(values - middle), np.median(np.abs(level - middle[:, None]), axis=1)


def spike_mask(seconds: np.ndarray, values: np.ndarray, noise: float | None = None) -> np.ndarray:
    """Readings in blocks of one to three that stand off from both sides.

    Hampel candidates (distance from the rolling median against the window's MAD, at least the trace's noise and the
    present rate) are confirmed against the nearest two readings on either side that are no candidates: each reading of
    the block must lie outside the hull of those four, and far from the straight line between the sides.
    """
    n = len(values)
    mask = np.zeros(n, dtype=bool)
    if n < 5:
        return mask
    noise = noise_scale(values) if noise is None else noise
    rate = local_rate(values)
    away, mad = hampel(values)
    floor = np.maximum(noise, rate)
    candidate = away > CANDIDATE_SCALES * np.maximum(MAD_TO_SIGMA * mad, floor * 0.75)
    if not candidate.any():
        return mask
    starts = np.flatnonzero(candidate & ~np.append(False, candidate[:-1]))
    ends = np.flatnonzero(candidate & ~np.append(candidate[1:], False))
    sound = np.flatnonzero(~candidate)
    if len(sound) < 4:
        return mask
    for first, last in zip(starts, ends):
        if last - first >= SPIKE_WIDTH:
            continue
        at = np.searchsorted(sound, first)
        left, right = sound[max(0, at - 2) : at], sound[at : at + 2]
        if len(left) == 0 or len(right) == 0:
            continue
        near = values[np.concatenate([left, right])]
        block = values[first : last + 1]
        scale = floor[first : last + 1].max()
        outside = np.maximum(block - near.max(), near.min() - block)
        a, b = left[-1], right[0]
        line = values[a] + (values[b] - values[a]) * (np.arange(first, last + 1) - a) / (b - a)
        if outside.min() > 2 * scale and np.abs(block - line).min() > CONFIRM_SCALES * scale:
            mask[first : last + 1] = True
    return mask
