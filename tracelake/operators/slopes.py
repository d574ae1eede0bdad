"""Theil-Sen slopes of ramps: exact medians of all pairwise slopes, without making the pairs of a long ramp."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelake.operators._groups import groups, numbers

#: Up to so many rows all pairs are looked at in memory; above, slopes are selected by counting.
DIRECT_ROWS = 1500
SUSTAINED_SECONDS = 60.0
_SCHEMA = pa.schema(
    [("trace_id", pa.string()), ("region_no", pa.int64()), ("robust", pa.float64()), ("sustained", pa.float64()), ("endpoint", pa.float64())]
)


def _inversions(order: np.ndarray) -> int:
    """Pairs i < j with order[i] > order[j], by merging."""
    count, width, now = 0, 1, order.copy()
    while width < len(now):
        for a in range(0, len(now), 2 * width):
            left, right = now[a : a + width], now[a + width : a + 2 * width]
            if len(right):
                count += int((len(left) - np.searchsorted(left, right, side="right")).sum())
                now[a : a + 2 * width] = np.sort(np.concatenate([left, right]), kind="stable")
        width *= 2
    return count


def _pairs_at_most(t: np.ndarray, x: np.ndarray, slope: float, later: np.ndarray) -> int:
    """Pairs of rows with different times whose slope is at most the given one."""
    height = x - slope * t
    # x_j - x_i <= slope (t_j - t_i) with t_j > t_i: the height falls or stays
    order = np.lexsort((later, -height))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return _inversions(rank[np.argsort(later, kind="stable")][::-1])


def theil_sen(t: np.ndarray, x: np.ndarray) -> float:
    """Median slope of all pairs of rows with different times, per minute; 0 if there is none."""
    if len(t) <= DIRECT_ROWS:
        i, j = np.triu_indices(len(t), 1)
        dt = t[j] - t[i]
        ahead = dt > 0
        return float(np.median((x[j] - x[i])[ahead] / dt[ahead]) * 60) if ahead.any() else 0.0
    order = np.lexsort((x, t))
    t, x = t[order], x[order]
    starts = np.flatnonzero(np.append(True, np.diff(t) > 0))
    sizes = np.diff(np.append(starts, len(t)))
    pairs = len(t) * (len(t) - 1) // 2 - int((sizes * (sizes - 1) // 2).sum())
    if pairs == 0:
        return 0.0
    same = np.flatnonzero(np.append(True, (np.diff(t) > 0) | (np.diff(x) != 0)))
    copies = np.diff(np.append(same, len(t)))
    equal = int((copies * (copies - 1) // 2).sum())  # pairs of one time and value: no pairs, but counted below as level ones
    low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
    rise = np.maximum(np.abs(high[1:] - low[:-1]), np.abs(low[1:] - high[:-1])) / np.diff(t[starts])
    steps, later = rise.max(), np.arange(len(t))

    def at_most(slope: float) -> int:
        # of one time, the rows of smaller height first: then none of their pairs falls
        place = np.lexsort((x - slope * t, t))
        return _pairs_at_most(t[place], x[place], slope, later) - equal

    def select(k: int) -> float:
        low, high = -steps - 1e-12, steps + 1e-12
        while np.nextafter(low, high) < high and high - low > 1e-13 * max(1.0, abs(low), abs(high)):
            middle = (low + high) / 2
            if at_most(middle) >= k:
                high = middle
            else:
                low = middle
        return high

    return (select((pairs + 1) // 2) + select(pairs // 2 + 1)) / 2 * 60


def sustained_slope(t: np.ndarray, x: np.ndarray, interval: float) -> float:
    """The slope of smallest size over all runs of SUSTAINED_SECONDS, the first of equals."""
    window = max(3, int(SUSTAINED_SECONDS / interval))
    if window >= len(t):
        return theil_sen(t, x)
    best = None
    if window <= 128 and (np.diff(t) > 0).all():
        i, j = np.triu_indices(window, 1)
        rows = np.arange(window)
        medians = []
        for a in range(0, len(t) - window + 1, 128):
            at = np.arange(a, min(a + 128, len(t) - window + 1))[:, None] + rows[None, :]
            tt, xx = t[at], x[at]
            medians.append(np.median((xx[:, j] - xx[:, i]) / (tt[:, j] - tt[:, i]), axis=1) * 60)
        slopes = np.concatenate(medians)
        return float(slopes[np.abs(slopes).argmin()])
    for a in range(len(t) - window + 1):
        slope = theil_sen(t[a : a + window], x[a : a + window])
        if best is None or abs(slope) < abs(best):
            best = slope
    return best


def _slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, bounds in groups(batches, ("trace_id", "region_no")):
        t, x, si = (numbers(table, n) for n in ("t", "x", "si"))
        out: list[list] = [[] for _ in _SCHEMA]
        for a, b in zip(bounds[:-1], bounds[1:]):
            tail = max(3, (b - a) // 10)
            row = (
                table["trace_id"][int(a)].as_py(), table["region_no"][int(a)].as_py(), theil_sen(t[a:b], x[a:b]),
                sustained_slope(t[a:b], x[a:b], float(si[a])), theil_sen(t[b - tail : b], x[b - tail : b]),
            )
            for column, value in zip(out, row):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _SCHEMA)], schema=_SCHEMA)


def ramp_slopes(rows: DataFrame) -> DataFrame:
    """trace_id, region_no, robust, sustained, endpoint (°C per minute) of each ramp; rows: trace_id, region_no, row_idx, t, x, si.

    One ramp is one group: its length is that of a temperature ramp, not of a trace, and its pairs are never rows.
    """
    ordered = rows.repartition("trace_id", "region_no").sortWithinPartitions("trace_id", "region_no", "row_idx")
    return ordered.mapInArrow(_slopes, "trace_id string, region_no long, robust double, sustained double, endpoint double")
