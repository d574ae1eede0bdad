"""Irregular readings onto a regular grid: harmonic regression with trend, residuals bridged between endpoints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators._groups import salted_join, sized_join
from tracelake.operators._slots import CHUNK_SLOTS, readings, slot_of, trace_params
from tracelake.session import materialize

HARMONICS = 3
RIDGE = 1e-6
PIECE_SLOTS = 16384


def _basis(place: np.ndarray, harmonics: int) -> np.ndarray:
    """Constant, trend, and cosine and sine of each harmonic of the trace's length; place runs from 0 to 1."""
    angles = 2 * np.pi * place[:, None] * np.arange(1, harmonics + 1)
    return np.column_stack([np.ones(len(place)), place, np.cos(angles), np.sin(angles)])


def _basis_sql(place: Column, coefficients: Column, harmonics: int) -> Column:
    value = coefficients[0] + coefficients[1] * place
    for k in range(1, harmonics + 1):
        angle = place * F.lit(2 * math.pi * k)
        value = value + coefficients[1 + k] * F.cos(angle) + coefficients[1 + harmonics + k] * F.sin(angle)
    return value


def _chunk_equations(harmonics: int):
    """Per chunk: its share of the normal equations, its first and last observation, and the holes in between."""
    schema = pa.schema(
        [
            ("trace_id", pa.string()), ("chunk", pa.int64()), ("lo_slot", pa.int64()), ("hi_slot", pa.int64()),
            ("first_slot", pa.int64()), ("first_y", pa.float64()), ("last_slot", pa.int64()), ("last_y", pa.float64()),
            ("sums", pa.list_(pa.float64())), ("a_slot", pa.list_(pa.int64())), ("a_y", pa.list_(pa.float64())),
            ("b_slot", pa.list_(pa.int64())), ("b_y", pa.list_(pa.float64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cells")
            inner, bounds = cells.flatten(), cells.offsets.to_numpy()
            bounds = bounds - bounds[0]
            slots, ys = inner.field("slot").to_numpy(), inner.field("y").to_numpy(zero_copy_only=False)
            lo, hi = batch.column("lo_slot").to_numpy(), batch.column("hi_slot").to_numpy()
            out: dict[str, list] = {name: [] for name in schema.names[4:]}
            for i in range(batch.num_rows):
                y = ys[bounds[i] : bounds[i + 1]]
                has = np.isfinite(y)
                x, y = slots[bounds[i] : bounds[i + 1]][has], y[has]
                basis = _basis((x - lo[i]) / max(hi[i] - lo[i], 1), harmonics)
                out["sums"].append(np.concatenate([(basis.T @ basis).ravel(), basis.T @ y]))
                ends = (int(x[0]), float(y[0]), int(x[-1]), float(y[-1])) if len(x) else (None,) * 4
                for name, value in zip(("first_slot", "first_y", "last_slot", "last_y"), ends):
                    out[name].append(value)
                hole = np.flatnonzero(np.diff(x) > 1)
                for name, value in (("a_slot", x[hole]), ("a_y", y[hole]), ("b_slot", x[hole + 1]), ("b_y", y[hole + 1])):
                    out[name].append(value)
            keys = [batch.column(n) for n in ("trace_id", "chunk", "lo_slot", "hi_slot")]
            rest = [pa.array(out[f.name], type=f.type) for f in list(schema)[4:]]
            yield pa.RecordBatch.from_arrays([k.cast(f.type) for k, f in zip(keys, schema)] + rest, schema=schema)

    return run


_EQUATIONS_DDL = (
    "trace_id string, chunk long, lo_slot long, hi_slot long, first_slot long, first_y double, last_slot long, last_y double, "
    "sums array<double>, a_slot array<long>, a_y array<double>, b_slot array<long>, b_y array<double>"
)


def _solver(harmonics: int):
    size = 2 + 2 * harmonics

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        def one(flat) -> list[float]:
            flat = np.asarray(flat, dtype=float)
            left, right = flat[: size * size].reshape(size, size), flat[size * size :]
            ridge = RIDGE * max(left[0, 0], 1.0) * np.eye(size)
            ridge[0, 0] = 0.0 if left[0, 0] else 1.0
            return np.linalg.lstsq(left + ridge, right, rcond=None)[0].tolist()

        return sums.map(one)

    return solve


def regular_grid(
    trace_rows: DataFrame, harmonics: int = HARMONICS, chunk_slots: int = CHUNK_SLOTS, observed: bool = True
) -> DataFrame:
    """One row per trace and grid slot: (trace_id, slot, value, fill_method).

    A reading's slot is floor(e / s + 0.5), e its seconds since the reading of the lowest row_idx and s the interval
    most rows carry. The grid runs from the first to the last slot with a reading. fill_method is 'observed' (mean of
    the slot's temperatures), 'bridged' (between two observed slots), 'extended' (only one side observed) or
    'unfillable' (the trace has no temperature; value null). Null and NaN temperatures are none; repeated rows and
    timestamps share a slot; rows without trace_id or ts are left out; an empty table gives an empty grid.
    observed=False gives the slots without temperature only.

    Distribution: slots are aggregated by (trace, slot) with partial sums, packed by chunks of bounded length, and each
    chunk gives its share of the normal equations (written once, as several steps read it, like the packed chunks where the
    observed slots are wanted, too); those are summed by (trace, position). Holes leave a chunk as
    (endpoints) only, so what is joined with the coefficients is small, and long holes are expanded in pieces.
    """
    rows = readings(trace_rows)
    placed = sized_join(rows.drop("interval", "setpoint"), trace_params(rows, chunk_slots), "trace_id", F.col("row_idx"))
    placed = placed.withColumn("slot", slot_of())
    chunk = F.floor((F.col("slot") - F.col("lo_slot")) / F.col("width")).cast("long")
    cells = placed.groupBy("trace_id", chunk.alias("chunk"), "lo_slot", "hi_slot", "slot").agg(F.avg("value").alias("y"))
    packed = cells.groupBy("trace_id", "chunk", "lo_slot", "hi_slot").agg(
        F.sort_array(F.collect_list(F.struct("slot", "y"))).alias("cells")
    )
    packed = materialize(packed) if observed else packed
    chunks = materialize(packed.mapInArrow(_chunk_equations(harmonics), _EQUATIONS_DDL))

    sums = chunks.select("trace_id", "lo_slot", "hi_slot", F.posexplode("sums")).groupBy("trace_id", "lo_slot", "hi_slot", "pos")
    flat = sums.agg(F.sum("col").alias("total")).groupBy("trace_id", "lo_slot", "hi_slot")
    solved = flat.agg(F.sort_array(F.collect_list(F.struct("pos", "total"))).alias("t"))
    solved = solved.select("trace_id", "lo_slot", "hi_slot", F.transform("t", lambda x: x["total"]).alias("sums"))
    model = solved.select(
        "trace_id", "lo_slot", "hi_slot", F.col("sums")[0].alias("n_observed"), _solver(harmonics)("sums").alias("coefficients")
    )

    inner = chunks.select("trace_id", F.explode(F.arrays_zip("a_slot", "a_y", "b_slot", "b_y")).alias("h")).select("trace_id", "h.*")
    order = Window.partitionBy("trace_id").orderBy("chunk")
    ends = chunks.filter(F.col("first_slot").isNotNull()).select(
        "trace_id", "lo_slot", "hi_slot", "first_slot", "first_y", "last_slot", "last_y",
        F.lag(F.struct("last_slot", "last_y")).over(order).alias("before"),
        F.lead("chunk").over(order).alias("following"),
    )
    none_long, none_double = F.lit(None).cast("long"), F.lit(None).cast("double")
    between = ends.select(
        "trace_id",
        F.coalesce("before.last_slot", F.col("lo_slot") - 1).alias("a_slot"),
        F.col("before.last_y").alias("a_y"),
        F.col("first_slot").alias("b_slot"),
        F.col("first_y").alias("b_y"),
    )
    trailing = ends.filter(F.col("following").isNull()).select(
        "trace_id", F.col("last_slot").alias("a_slot"), F.col("last_y").alias("a_y"),
        (F.col("hi_slot") + 1).alias("b_slot"), none_double.alias("b_y"),
    )
    bare = model.filter(F.col("n_observed") == 0).select(
        "trace_id", (F.col("lo_slot") - 1).alias("a_slot"), none_double.alias("a_y"),
        (F.col("hi_slot") + 1).alias("b_slot"), none_double.alias("b_y"),
    )
    holes = inner.unionByName(between).unionByName(trailing).unionByName(bare).filter(F.col("b_slot") - F.col("a_slot") > 1)
    pieces = holes.withColumn(
        "piece", F.explode(F.expr(f"sequence(0L, (b_slot - a_slot - 2) div {PIECE_SLOTS})"))
    )
    joined = salted_join(pieces, model, "trace_id", F.xxhash64("a_slot", "piece"))
    start = F.col("a_slot") + 1 + F.col("piece") * PIECE_SLOTS
    missing = joined.withColumn("slot", F.explode(F.sequence(start, F.least(start + (PIECE_SLOTS - 1), F.col("b_slot") - 1))))

    length = F.greatest(F.col("hi_slot") - F.col("lo_slot"), F.lit(1))
    fitted = lambda at: _basis_sql((F.col(at) - F.col("lo_slot")) / length, F.col("coefficients"), harmonics)
    left, right = F.col("a_y") - fitted("a_slot"), F.col("b_y") - fitted("b_slot")
    share = (F.col("slot") - F.col("a_slot")) / (F.col("b_slot") - F.col("a_slot"))
    bridge = F.coalesce(left * (1 - share) + right * share, left, right)
    filled = missing.select("trace_id", "slot", (fitted("slot") + bridge).alias("value"), "a_y", "b_y").select(
        "trace_id", "slot", "value",
        F.when(F.col("value").isNull(), "unfillable")
        .when(F.col("a_y").isNotNull() & F.col("b_y").isNotNull(), "bridged")
        .otherwise("extended")
        .alias("fill_method"),
    )
    if not observed:
        return filled
    slots = packed.select("trace_id", F.explode("cells").alias("c")).select("trace_id", "c.slot", F.col("c.y").alias("value"))
    seen = slots.filter(F.col("value").isNotNull()).withColumn("fill_method", F.lit("observed"))
    return seen.unionByName(filled)


def missing_slots(trace_rows: DataFrame) -> DataFrame:
    """The grid's slots without temperature (trace_id, slot), as the operator filled or marked them."""
    filled = regular_grid(trace_rows, observed=False)
    return filled.filter(F.col("value").isNotNull() | (F.col("fill_method") == "unfillable")).select("trace_id", "slot")
