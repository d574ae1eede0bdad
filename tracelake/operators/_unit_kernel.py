"""Array kernels of the unit detector: exact penalised segmentation of one bounded chunk of one trace."""

from __future__ import annotations

import numpy as np

from tracelake.operators._spike_kernel import local_rate, noise_scale, rolling_median

UNITS = ("C", "F", "K", "dC")
#: celsius = scale * reading + offset.
SCALE = np.array([1.0, 1 / 1.8, 1.0, 0.1])
OFFSET = np.array([0.0, -32 / 1.8, -273.15, 0.0])
#: Costs are in nats: a unit change costs CHANGE, a level shift that no mapping explains at most JUMP.
CHANGE = 8.0
JUMP = 14.0
SETPOINT_WEIGHT = 0.3
SETPOINT_LOG_SCALE = 0.06
RANGE_WEIGHT = 0.5
LOW_C, HIGH_C, RANGE_SLACK = -90.0, 150.0, 30.0
FROZEN_RUN = 6
#: A unit holds for at least so many readings; a level that shorter is another is no unit.
MIN_STRETCH = 40
HOLE_SLOTS = 5.0
#: What a level shift counts across a hole or at the end of a frozen run, where the level may have moved meanwhile.
HOLE_WEIGHT = 0.25
N = len(UNITS)


def to_celsius(values: np.ndarray) -> np.ndarray:
    """Readings as °C under each unit, one row per unit."""
    return SCALE[:, None] * values[None, :] + OFFSET[:, None]


def emission(values: np.ndarray, setpoint: np.ndarray) -> np.ndarray:
    """Cost of each reading under each unit: log-ratio to the setpoint in absolute temperature, and range."""
    celsius = to_celsius(values)
    excess = np.maximum(celsius - HIGH_C, LOW_C - celsius)
    cost = RANGE_WEIGHT * np.clip(excess / RANGE_SLACK, 0, 1)
    has = np.isfinite(setpoint)
    if has.any():
        with np.errstate(invalid="ignore"):
            kelvin = np.maximum(celsius[:, has] + 273.15, 1.0)
            log_shift = np.abs(np.log(kelvin / np.maximum(setpoint[has] + 273.15, 1.0)))
        cost[:, has] += SETPOINT_WEIGHT * np.minimum(log_shift / SETPOINT_LOG_SCALE, 1)
    repeated = np.append(False, values[1:] == values[:-1])
    cost[:, repeated] *= 0.1  # a frozen value tells little more than once
    cost[3, values != np.round(values)] += 0.4  # tenths are stored as whole counts
    return cost


def frozen(values: np.ndarray, at_least: int = FROZEN_RUN) -> np.ndarray:
    """Readings inside runs of at least so many equal readings."""
    n = len(values)
    if n == 0:
        return np.zeros(0, dtype=bool)
    edges = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    lengths = np.diff(np.append(edges, n))
    return np.repeat(lengths >= at_least, lengths)


def sane(values: np.ndarray, noise: float | None = None) -> np.ndarray:
    """Readings that are no short spike (median of seven)."""
    if len(values) < 7:
        return np.ones(len(values), dtype=bool)
    scale = np.maximum(noise_scale(values) if noise is None else noise, local_rate(values))
    return np.abs(values - rolling_median(values, 3)) <= 8 * scale + 1e-9


def bursts(values: np.ndarray, noise: float) -> np.ndarray:
    """Readings of blocks shorter than MIN_STRETCH that jump away and back again: faults, as no unit holds so briefly."""
    n = len(values)
    inside = np.zeros(n, dtype=bool)
    rate = local_rate(values)
    scale = np.maximum(noise, rate)
    steps = np.abs(np.diff(values))
    jumps = np.flatnonzero(steps > 8 * np.minimum(scale[1:], scale[:-1]) + 1e-9) + 1
    k = 0
    while k < len(jumps):
        begin = jumps[k]
        allowed = 4 * scale[begin - 1] + 1e-9
        for m in range(k + 1, len(jumps)):
            end = jumps[m]
            if end - begin >= MIN_STRETCH:
                break
            if abs(values[end] - values[begin - 1]) <= allowed + (end - begin) * min(rate[begin - 1], rate[end]):
                if np.abs(values[begin:end] - values[begin - 1]).min() > allowed:
                    inside[begin:end] = True
                    k = m
                break
        k += 1
    return inside


def jump_costs(before: np.ndarray, after: np.ndarray, scale: np.ndarray, informative: np.ndarray) -> np.ndarray:
    """Cost [i, a, b] of the level shift at i when the unit goes from a to b."""
    gap = np.abs(to_celsius(after).T[:, None, :] - to_celsius(before).T[:, :, None])
    tolerance = 4 * scale[:, None, None] * np.maximum(SCALE[:, None], SCALE[None, :])[None] + 0.1
    changed = (1 - np.eye(N))[None]
    # of places at which a change explains all, the one where it does so best
    cost = np.clip(gap / tolerance - 1, 0, JUMP) + changed * np.clip(gap / tolerance, 0, 1) ** 2
    cost[~informative] *= HOLE_WEIGHT
    return cost + CHANGE * changed


def changes(
    seconds: np.ndarray, values: np.ndarray, interval: float, noise: float | None = None, rows: np.ndarray | None = None, context: tuple | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Readings at which the unit may change, and the cost [k, a, b] of going from a to b there.

    These are all level shifts that can be seen, the ends of holes and of frozen runs (where nothing can be seen), and
    every MIN_STRETCH-th reading. Given rows, the emissions, the cheapest place between two of these is added for every
    pair of units, so that nothing between them can be cheaper for a change. context: local rates, frozen readings and
    steps across no hole, if they are known from a wider view.
    """
    n = len(values)
    if context is None:
        close = np.diff(seconds) <= HOLE_SLOTS * interval if interval > 0 else np.ones(n - 1, dtype=bool)
        context = local_rate(values), frozen(values), close
    rate, stuck, close = context
    scale = np.maximum(noise_scale(values) if noise is None else noise, rate)
    shift = np.abs(np.diff(values)) > 4 * np.minimum(scale[1:], scale[:-1]) + 1e-9
    informative = close & ~(stuck[1:] | stuck[:-1])
    at = np.flatnonzero(shift | ~close | (stuck[1:] != stuck[:-1]) | (np.arange(1, n) % MIN_STRETCH == 0)) + 1
    # a step beside others of its size belongs to a ramp, however short
    steps = np.abs(np.diff(values, prepend=values[0], append=values[-1]))
    beside = np.maximum(steps[:-2], steps[2:]) if n > 1 else np.zeros(0)
    cost = lambda k: jump_costs(values[k - 1], values[k], np.maximum(np.maximum(scale[k - 1], scale[k]), beside[k - 1]), informative[k - 1])
    if rows is not None and n > 2:
        places = np.arange(1, n)
        jumps, gone = cost(places), np.cumsum(rows, axis=1)[:, :-1]
        blocks = np.unique(np.concatenate([[0], at[at < n - 1]]))  # blocks of the places 1 .. n-1, by index place - 1
        extra = []
        for a in range(N):
            for b in range(N):
                if a != b:
                    total = gone[a] - gone[b] + jumps[:, a, b]
                    least = np.repeat(np.minimum.reduceat(total, blocks), np.diff(np.append(blocks, n - 1)))
                    hit = np.flatnonzero(total <= least)
                    of_block = np.searchsorted(blocks, hit, side="right")
                    extra.append(hit[np.append(True, of_block[1:] != of_block[:-1])] + 1)
        at = np.unique(np.concatenate([at, *extra]))
    return at, cost(at)


def segment(
    seconds: np.ndarray, values: np.ndarray, setpoint: np.ndarray, interval: float, noise: float | None = None, least: int = 1, refine: bool = False,
    rows: np.ndarray | None = None, context: tuple | None = None,
):
    """Cheapest segmentation for every pair of first and last unit, each stretch between two changes at least `least` readings.

    Exact dynamic program over the readings at which a change may be (see changes; refine adds the cheapest places in
    between), the costs in between taken from prefix sums. The first and the last stretch may be shorter: they go on
    outside. Returns (cost[first, last], paths[first][last]) where a path is a list of (index of its first reading, unit).
    """
    n = len(values)
    rows = emission(values, setpoint) if rows is None else rows
    at, transition = changes(seconds, values, interval, noise, rows if refine else None, context)
    total = np.concatenate([np.zeros((N, 1)), np.cumsum(rows, axis=1)], axis=1)
    bounds = np.concatenate([[0], at, [n]])
    spans = (total[:, bounds[1:]] - total[:, bounds[:-1]]).T
    blocks = len(at) + 1
    same = np.arange(N)
    staying = transition[:, same, same]
    moving = transition.copy()
    moving[:, same, same] = np.inf
    # cost of staying in a unit up to the end of each block, from which stays over several blocks are differences
    stay = np.cumsum(spans + np.vstack([np.zeros((1, N)), staying]), axis=0)
    # the first block at whose end a stretch that begins with block k + 1 is long enough
    arrives = np.minimum(np.searchsorted(bounds[1:], at + least), blocks - 1)
    state = np.full((N, N), np.inf)
    np.fill_diagonal(state, spans[0])
    waiting = np.full((blocks, N, N), np.inf)  # [block, first, unit]: arrivals of stretches that have become long enough
    came = np.full((blocks, N, N), -1, dtype=np.int64)  # candidate * N + unit before, -1 for staying
    for k in range(len(at)):
        options = state[:, :, None] + moving[k][None]
        before = options.argmin(axis=1)
        end = int(arrives[k])
        value = options.min(axis=1) + (stay[end] - stay[k + 1] + spans[k + 1])[None]
        better = value < waiting[end]
        waiting[end][better] = value[better]
        came[end][better] = (k * N + before)[better]
        state = state + (staying[k] + spans[k + 1])[None]
        arrived = waiting[k + 1] < state
        came[k + 1][~arrived] = -1
        state = np.where(arrived, waiting[k + 1], state)
    paths = [[[] for _ in range(N)] for _ in range(N)]
    turns = [[np.flatnonzero(came[:, f, u] >= 0) for u in range(N)] for f in range(N)]
    for first in range(N):
        for last in range(N):
            unit, block, found = last, blocks - 1, []
            while True:
                own = turns[first][unit]
                place = int(np.searchsorted(own, block, side="right")) - 1
                if place < 0:
                    break
                candidate, before = divmod(int(came[own[place], first, unit]), N)
                found.append((int(at[candidate]), unit))
                unit, block = before, candidate
            paths[first][last] = [(0, first), *reversed(found)]
    return state, paths


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).min(axis=1)


def compose(costs: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Cost [first, last] of a chain of pieces: costs [k, first, last], shifts [k, last of k, first of k + 1]."""
    total = costs[0]
    for k in range(1, len(costs)):
        total = min_plus(min_plus(total, shifts[k - 1]), costs[k])
    return total


def descend(costs: np.ndarray, shifts: np.ndarray, first: int, last: int) -> list[tuple[int, int]]:
    """First and last unit of each piece on the cheapest chain that begins with first and ends with last."""
    total, back = costs[0][first], []
    for k in range(1, len(costs)):
        entered = total[:, None] + shifts[k - 1]
        whole = entered.min(axis=0)[:, None] + costs[k]
        back.append((entered.argmin(axis=0), whole.argmin(axis=0)))
        total = whole.min(axis=0)
    pairs = []
    for came, through in reversed(back):
        begin = int(through[last])
        pairs.append((begin, last))
        last = int(came[begin])
    return [(first, last), *reversed(pairs)]
