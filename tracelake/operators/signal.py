"""Canonical trace and its windowed signals: Hampel filter, rolling median, MAD and slope, derivative, direction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators._groups import groups, numbers, salted_join
from tracelake.operators._slots import finite, micros
from tracelake.session import materialize

#: Fixed values of the signal stage.
HAMPEL_HALF, HAMPEL_SIGMAS, MAD_TO_SIGMA, MAD_FLOOR = 5, 3.0, 1.4826, 1e-10
ROLLING_SECONDS, MOVING_C_PER_MIN, LEAST_SECONDS = 30.0, 0.1, 10.0
CHUNK_ROWS = 8192
_SCHEMA = pa.schema(
    [("trace_id", pa.string()), ("row_idx", pa.int64()), ("t", pa.float64()), ("x", pa.float64()), ("sp", pa.float64()), ("spike", pa.bool_())]
    + [(n, pa.float64()) for n in ("clean", "med", "mad", "ls", "rs", "d2", "tm", "d", "dn")]
    + [("dir", pa.string())]
)
_DDL = "trace_id string, row_idx long, t double, x double, sp double, spike boolean, clean double, med double, mad double, ls double, rs double, d2 double, tm double, d double, dn double, dir string"


def canonical_trace(trace_rows: DataFrame) -> DataFrame:
    """trace_id, row_idx, ts, t, elapsed_minutes, x, sp, missing: one row per arrival number.

    t is seconds since the first row's time; a missing temperature (null, NaN) becomes 0.0 and is marked; a
    setpoint that is no number is null. Rows delivered twice count once (the first delivery); rows without trace_id,
    row_idx or ts drop out.
    """
    rows = trace_rows.filter("trace_id is not null and row_idx is not null and ts is not null").groupBy("trace_id", "row_idx").agg(
        F.min(F.struct("ingested_at", "ts", finite("temperature_c_raw").alias("x"), finite("setpoint_c").alias("sp"))).alias("r")
    )
    first = rows.groupBy("trace_id").agg(F.min_by(micros("r.ts"), "row_idx").alias("t0"))
    joined = salted_join(rows, first, "trace_id", F.col("row_idx"))
    t = (micros("r.ts") - F.col("t0")) / F.lit(1e6)
    return joined.select(
        "trace_id", "row_idx", F.col("r.ts").alias("ts"), t.alias("t"), (t / 60).alias("elapsed_minutes"), F.coalesce("r.x", F.lit(0.0)).alias("x"),
        F.col("r.sp").alias("sp"), F.col("r.x").isNull().alias("missing"),
    )


def _chunk_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk its rows, the times at its ends, and how often each positive step occurs."""
    schema = pa.schema(
        [("trace_id", pa.string()), ("chunk", pa.int64()), ("n", pa.int64()), ("first_t", pa.float64()), ("last_t", pa.float64()), ("step", pa.list_(pa.float64())), ("times", pa.list_(pa.int64()))]
    )
    for table, bounds in groups(batches, ("trace_id", "chunk")):
        t, out = numbers(table, "t"), {f.name: [] for f in schema}
        for a, b in zip(bounds[:-1], bounds[1:]):
            steps = np.diff(t[a:b])
            values, counts = np.unique(steps[steps > 0], return_counts=True)
            for name, x in zip(out, (table["trace_id"][int(a)].as_py(), table["chunk"][int(a)].as_py(), b - a, t[a], t[b - 1], values, counts)):
                out[name].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)


def trace_frames(canonical: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per trace: n, si (median of the positive steps, 1.0 if none), half (of the rolling frame) and mb (rows of LEAST_SECONDS).

    Steps are counted by value in chunks, those from chunk to chunk added, and the median is read from the counts in order,
    so a trace's rows meet in no task.
    """
    cells = canonical.select("trace_id", F.floor(F.col("row_idx") / chunk_rows).cast("long").alias("chunk"), "row_idx", "t")
    ordered = cells.repartition("trace_id", "chunk").sortWithinPartitions("trace_id", "chunk", "row_idx")
    chunks = materialize(ordered.mapInArrow(_chunk_steps, "trace_id string, chunk long, n long, first_t double, last_t double, step array<double>, times array<long>"))
    across = F.col("first_t") - F.lag("last_t").over(Window.partitionBy("trace_id").orderBy("chunk"))
    between = chunks.select("trace_id", across.alias("step"), F.lit(1).cast("long").alias("times")).filter("step > 0")
    inside = chunks.select("trace_id", F.explode(F.arrays_zip("step", "times")).alias("s")).select("trace_id", "s.step", "s.times")
    counts = inside.unionByName(between).groupBy("trace_id", "step").agg(F.sum("times").alias("times"))
    whole = Window.partitionBy("trace_id")
    told = counts.withColumn("upto", F.sum("times").over(whole.orderBy("step"))).withColumn("all", F.sum("times").over(whole))
    # the step at rank (n - 1) div 2 and at n div 2, from 0
    at = lambda rank: F.min(F.when(F.col("upto") > F.expr(rank), F.col("step")))
    middle = told.groupBy("trace_id").agg(((at("(`all` - 1) div 2") + at("`all` div 2")) / 2).alias("middle"))
    sizes = chunks.groupBy("trace_id").agg(F.sum("n").alias("n"))
    frames = sizes.join(middle, "trace_id", "left").select("trace_id", "n", F.coalesce("middle", F.lit(1.0)).alias("si"))
    half = F.floor(F.greatest(F.lit(3), F.floor(F.lit(ROLLING_SECONDS) / F.col("si"))) / 2).cast("long")
    return frames.withColumn("half", half).withColumn("mb", F.greatest(F.lit(5), F.floor(F.lit(LEAST_SECONDS) / F.col("si"))).cast("long"))


def _framed(values: np.ndarray, half: int) -> np.ndarray:
    """Median over i-half .. i+half, the frame cut at the ends; NaN anywhere in the frame gives NaN."""
    n = len(values)
    out = np.empty(n)
    if n > 2 * half:
        out[half : n - half] = np.median(sliding_window_view(values, 2 * half + 1), axis=1)
    for i in [i for i in range(n) if i < half or i >= n - half or n <= 2 * half]:
        out[i] = np.median(values[max(0, i - half) : i + half + 1])
    return out


def _framed_mad(values: np.ndarray, middle: np.ndarray, half: int) -> np.ndarray:
    """Median distance from the frame's own median."""
    n = len(values)
    out = np.empty(n)
    if n > 2 * half:
        frames = sliding_window_view(values, 2 * half + 1)
        out[half : n - half] = np.median(np.abs(frames - middle[half : n - half, None]), axis=1)
    for i in [i for i in range(n) if i < half or i >= n - half or n <= 2 * half]:
        out[i] = np.median(np.abs(values[max(0, i - half) : i + half + 1] - middle[i]))
    return out


def signals(t: np.ndarray, x: np.ndarray, half: int, mb: int) -> dict[str, np.ndarray]:
    """All signals of one stretch of rows in order of arrival."""
    n = len(x)
    middle = _framed(x, HAMPEL_HALF)
    spread = np.maximum(_framed_mad(x, middle, HAMPEL_HALF), MAD_FLOOR)
    spike = np.abs(x - middle) > HAMPEL_SIGMAS * MAD_TO_SIGMA * spread
    med = _framed(x, half)
    back, ahead = np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)
    dt = t[ahead] - t[back]
    with np.errstate(invalid="ignore", divide="ignore"):
        ls = np.where(dt > 0, (x[ahead] - x[back]) / dt * 60, np.nan)
        rs = _framed(ls, half)
        d2 = np.where(dt > 0, (rs[ahead] - rs[back]) / dt, np.nan)
    d2[:1] = d2[n - 1 :] = np.nan
    tm = np.full(n, np.nan)
    if n > mb:
        tm[mb:] = np.median(sliding_window_view(np.abs(np.nan_to_num(rs)), mb), axis=1)[: n - mb]
    d = np.append(np.nan, np.diff(t))
    return {"d": d, "dn": np.append(d[1:], np.nan), "spike": spike, "clean": np.where(spike, middle, x), "med": med, "mad": _framed_mad(x, med, half), "ls": ls, "rs": rs, "d2": d2, "tm": tm}


def _signal_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, bounds in groups(batches, ("trace_id", "chunk")):
        own = table["core"].to_numpy()
        t, x, half, mb = (numbers(table, n) for n in ("t", "x", "half", "mb"))
        parts = [signals(t[a:b], x[a:b], int(half[a]), int(mb[a])) for a, b in zip(bounds[:-1], bounds[1:])]
        whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        rs = whole["rs"]
        direction = np.where(rs > MOVING_C_PER_MIN, "HEATING", np.where(rs < -MOVING_C_PER_MIN, "COOLING", "STABLE")).astype(object)
        direction[np.isnan(rs)] = None
        columns = {n: table[n].combine_chunks() for n in ("trace_id", "row_idx", "t", "x", "sp")}
        columns |= {k: pa.array(v, from_pandas=True) for k, v in whole.items()} | {"dir": pa.array(direction, type=pa.string())}
        batch = pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in _SCHEMA], schema=_SCHEMA)
        yield batch.filter(pa.array(own))


def trace_signals(canonical: DataFrame, frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every canonical row with spike, clean, med, mad, ls, rs, d2, tm (median of the mb slopes before), d and dn (time since the row before, until the next) and dir.

    The frames' size depends on the trace, which window frames cannot; a kernel works on chunks of chunk_rows rows with
    as many copied rows on either side as the frames reach, so a trace of any length is spread over tasks.
    """
    halo = F.col("mb") + F.col("half") + HAMPEL_HALF + 3
    joined = salted_join(canonical.select("trace_id", "row_idx", "t", "x", "sp"), frames.select("trace_id", "half", "mb"), "trace_id", F.col("row_idx"))
    width = F.greatest(F.lit(chunk_rows), 4 * halo)
    placed = joined.withColumn("_home", F.floor(F.col("row_idx") / width).cast("long")).withColumn("_in", F.pmod("row_idx", width))
    before, after = F.when(F.col("_in") < halo, F.col("_home") - 1), F.when(F.col("_in") >= width - halo, F.col("_home") + 1)
    copies = placed.withColumn("chunk", F.explode(F.array_compact(F.array(F.col("_home"), before, after))))
    cells = copies.select("trace_id", "chunk", "row_idx", "t", "x", "sp", "half", "mb", (F.col("chunk") == F.col("_home")).alias("core"))
    ordered = cells.repartition("trace_id", "chunk").sortWithinPartitions("trace_id", "chunk", "row_idx")
    return ordered.mapInArrow(_signal_batches, _DDL)


def _rises(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("trace_id", pa.string()), ("at", pa.int64())])
    for table, bounds in groups(batches, ("trace_id", "chunk")):
        own, (rows, step, thr, mc, n) = table["core"].to_numpy(), (numbers(table, c) for c in ("row_idx", "step", "thr", "mc", "n"))
        traces, at = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            width = int(mc[a])
            if b - a < width:
                continue
            sums = np.cumsum(step[a:b])
            least = sliding_window_view(sums, width).min(axis=1) - (sums - step[a:b])[: b - a - width + 1]
            last = len(least)
            hit = np.flatnonzero((least > thr[a : a + last]) & own[a : a + last] & (rows[a : a + last] + width - 1 <= n[a : a + last] - 1))
            if len(hit):
                traces.append(table["trace_id"][int(a)].as_py())
                at.append(int(rows[a + hit[0]]))
        yield pa.RecordBatch.from_arrays([pa.array(traces, type=pa.string()), pa.array(at, type=pa.int64())], schema=schema)


def sustained_start(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per trace the first row from which on all sums of the next mc steps exceed thr (process_start), else n - 1.

    rows: trace_id, row_idx, step, thr, mc, n. The sums begin at the row itself, so chunks of rows with mc copied rows after
    them tell the same as the whole trace.
    """
    width = F.greatest(F.lit(chunk_rows), 4 * F.col("mc")).cast("long")
    placed = rows.withColumn("_home", F.floor(F.col("row_idx") / width).cast("long"))
    before = F.when((F.pmod("row_idx", width) < F.col("mc")) & (F.col("_home") > 0), F.col("_home") - 1)
    copies = placed.withColumn("chunk", F.explode(F.array_compact(F.array(F.col("_home"), before))))
    cells = copies.select(
        "trace_id", "chunk", "row_idx", F.col("step").cast("double").alias("step"), F.col("thr").cast("double").alias("thr"), F.col("mc").cast("long").alias("mc"),
        F.col("n").cast("long").alias("n"), (F.col("chunk") == F.col("_home")).alias("core"),
    )
    found = cells.repartition("trace_id", "chunk").sortWithinPartitions("trace_id", "chunk", "row_idx").mapInArrow(_rises, "trace_id string, at long")
    whole = rows.groupBy("trace_id").agg(F.max("n").alias("n"))
    first = found.groupBy("trace_id").agg(F.min("at").alias("at"))
    return whole.join(first, "trace_id", "left").select("trace_id", F.coalesce("at", F.col("n") - 1).cast("long").alias("process_start"))
