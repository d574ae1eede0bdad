"""Implausible spikes in measurements: Hampel filter per trace, stuck values by run length, physical bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import _spike_kernel as kernel
from tracelake.operators import _unit_kernel
from tracelake.operators._slots import HALO_SLOTS, chunked
from tracelake.operators.units import chunk_rows, units_of, with_units
from tracelake.session import materialize

#: Physically impossible: below absolute zero, or outside these bounds (far outside -100 to 200 °C).
LOWEST_C, HIGHEST_C = -150.0, 300.0
STUCK_RUN = 20
STUCK_RATIO = 2
#: Runs under this length can never decide whether another is stuck.
SHORT_RUN = STUCK_RUN // STUCK_RATIO
_DDL = "trace_id string, chunk long, fault string, place int, value double, n long, touches_left boolean, touches_right boolean, rows array<long>"


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=int)
    return edges, np.append(edges[1:], len(values))


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: the rows of spikes and of impossible readings, and the runs of equal readings that may matter."""
    schema = pa.schema(
        [
            ("trace_id", pa.string()), ("chunk", pa.int64()), ("fault", pa.string()), ("place", pa.int32()), ("value", pa.float64()),
            ("n", pa.int64()), ("touches_left", pa.bool_()), ("touches_right", pa.bool_()), ("rows", pa.list_(pa.int64())),
        ]
    )
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        noises = batch.column("noise").to_numpy()
        for i, (us, rows, values, cores, start_us, start_row, unit) in chunk_rows(batch, ("us", "row_idx", "value", "core", "start_us", "start_row", "unit")):
            key = (batch.column("trace_id")[i].as_py(), batch.column("chunk")[i].as_py())

            def put(*row) -> None:
                for name, x in zip(out, (*key, *row)):
                    out[name].append(x)

            units = units_of(us, rows, start_us, start_row, unit)
            celsius = _unit_kernel.SCALE[units] * values + _unit_kernel.OFFSET[units]
            impossible = (celsius < LOWEST_C) | (celsius > HIGHEST_C)
            found = rows[impossible & cores]
            if len(found):
                put("impossible", 0, None, len(found), None, None, found)
            fine = np.flatnonzero(~impossible)
            spikes = kernel.spike_mask(us[fine] / 1e6, values[fine], float(noises[i]))
            found = rows[fine[spikes & cores[fine]]]
            if len(found):
                put("spike", 0, None, len(found), None, None, found)
            own = fine[cores[fine]]
            starts, ends = _runs(values[own])
            for place, (s, e) in enumerate(zip(starts, ends)):
                if e - s >= SHORT_RUN or s == 0 or e == len(own):
                    put("run", place, float(values[own[s]]), e - s, s == 0, e == len(own), rows[own[s:e]])
        if out["n"]:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)


def faulty_readings(trace_rows: DataFrame, file_metadata: DataFrame) -> DataFrame:
    """Faulty readings with what is wrong: (trace_id, row_idx, fault), fault 'spike', 'stuck' or 'impossible'.

    A reading may have several faults, each once. Rows without temperature (null, NaN, infinite), trace_id or ts
    are neither faults nor neighbours; rows delivered twice count once; neighbours are neighbours in time. Each
    chunk is judged with a halo of HALO_SLOTS sampling slots; runs of equal readings are joined across chunks, so
    their length does not depend on the cut. A run is stuck from STUCK_RUN readings on if it is more than
    STUCK_RATIO times as long as every shorter run of its trace (impossible readings aside). Empty tables give an
    empty result.
    """
    chunks = with_units(chunked(trace_rows, halo=HALO_SLOTS), trace_rows, file_metadata)
    found = materialize(chunks.mapInArrow(_faults, _DDL))
    single = found.filter(F.col("fault") != "run").select("trace_id", F.explode("rows").alias("row_idx"), "fault")
    # runs inside a chunk are whole; the up to two at each chunk's edges may go on in the next
    runs = found.filter(F.col("fault") == "run").select("trace_id", "chunk", "place", "value", "n", "touches_left", "touches_right")
    order = Window.partitionBy("trace_id").orderBy("chunk", "place")
    at_edge = F.col("touches_left") | F.col("touches_right")
    goes_on = (
        F.col("touches_left")
        & F.lag("touches_right").over(order)
        & (F.lag("value").over(order) == F.col("value"))
        & (F.lag("chunk").over(order) != F.col("chunk"))
    )
    edges = runs.filter(at_edge).withColumn("begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    edges = edges.withColumn("run", F.sum("begins").over(order)).withColumn("length", F.sum("n").over(Window.partitionBy("trace_id", "run")))
    whole = edges.select("trace_id", "chunk", "place", "length", "begins").unionByName(
        runs.filter(~at_edge).select("trace_id", "chunk", "place", F.col("n").alias("length"), F.lit(1).alias("begins"))
    )
    whole = materialize(whole.filter(F.col("length") >= SHORT_RUN))
    lengths = whole.filter("begins = 1").groupBy("trace_id", "length").agg(F.count(F.lit(1)).alias("n"))
    shorter = F.lag("length").over(Window.partitionBy("trace_id").orderBy("length"))
    bound = (
        lengths.withColumn("shorter", F.coalesce(shorter, F.lit(0)))
        .filter((F.col("length") >= STUCK_RUN) & (F.col("length") > STUCK_RATIO * F.col("shorter")))
        .groupBy("trace_id")
        .agg(F.min("length").alias("bound"))
    )
    stuck_runs = whole.join(bound, "trace_id").filter(F.col("length") >= F.col("bound")).select("trace_id", "chunk", "place")
    rows = found.filter(F.col("fault") == "run").select("trace_id", "chunk", "place", "rows")
    stuck = rows.join(stuck_runs, ["trace_id", "chunk", "place"]).select("trace_id", F.explode("rows").alias("row_idx"), F.lit("stuck").alias("fault"))
    return single.unionByName(stuck).filter(F.col("row_idx") >= 0)


def faulty_rows(trace_rows: DataFrame, file_metadata: DataFrame) -> DataFrame:
    """Each faulty reading once (trace_id, row_idx)."""
    return faulty_readings(trace_rows, file_metadata).select("trace_id", "row_idx").distinct()
