"""Sampling slots of a trace and bounded chunks of slots, the unit of work of the trace operators.

A trace can hold a third of all rows, so no operator hands a whole trace to one task: rows are cut into chunks of
about CHUNK_SLOTS sampling slots, with a halo of copied rows where neighbours across the cut matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators._groups import sized_join
from tracelake.session import materialize

CHUNK_SLOTS = 4096
HALO_SLOTS = 64
#: Readings a slot may have on average before chunks get narrower.
ROWS_PER_SLOT = 4


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ that means UTC (the session zone is UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def finite(value: str) -> Column:
    """NaN and null are both no value; infinities neither."""
    column = F.col(value)
    return F.when(~F.isnan(column) & (F.abs(column) < F.lit(float("inf"))), column)


def slot_of(us: str = "us") -> Column:
    return F.floor((F.col(us) - F.col("t0_us")) / F.lit(1e6) / F.col("interval_s") + F.lit(0.5)).cast("long")


def trace_params(rows: DataFrame, chunk_slots: int = CHUNK_SLOTS) -> DataFrame:
    """One row per trace: start, sampling interval, first and last slot, chunk width and number of rows; written once.

    rows: trace_id, row_idx, us, interval. The start is the time of the lowest row_idx; the interval is the value
    most rows carry (smaller on ties; null, NaN and values of 0 or less don't count), else the mean spacing, else 1.
    Grouped twice, by (trace, interval) and by trace, so a hot trace is pre-aggregated before each shuffle.
    """
    valid = F.when(F.col("interval") > 0, finite("interval"))
    by_value = rows.groupBy("trace_id", valid.alias("interval")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.coalesce(F.col("row_idx"), F.lit(2**62)), "us")).alias("head"),
        F.min("us").alias("lo_us"),
        F.max("us").alias("hi_us"),
    )
    per_trace = by_value.groupBy("trace_id").agg(
        F.max(F.when(F.col("interval").isNotNull(), F.struct("n", (-F.col("interval")).alias("minus")))).alias("mode"),
        F.min("head").alias("head"),
        F.min("lo_us").alias("lo_us"),
        F.max("hi_us").alias("hi_us"),
        F.sum("n").alias("n_rows"),
    )
    mean_step = (F.col("hi_us") - F.col("lo_us")) / F.greatest(F.col("n_rows") - 1, F.lit(1)) / F.lit(1e6)
    started = per_trace.select(
        "trace_id",
        F.col("head.us").alias("t0_us"),
        F.coalesce(-F.col("mode.minus"), F.when(mean_step > 0, mean_step), F.lit(1.0)).alias("interval_s"),
        "lo_us",
        "hi_us",
        "n_rows",
    )
    span = F.col("hi_slot") - F.col("lo_slot") + 1
    # an interval that is told too long would pile many readings onto a slot: chunks are bounded in rows, too
    pieces = F.greatest(F.round(span / F.lit(chunk_slots)), F.ceil(F.col("n_rows") / F.lit(ROWS_PER_SLOT * chunk_slots)), F.lit(1))
    return materialize(
        started.withColumn("lo_slot", slot_of("lo_us"))
        .withColumn("hi_slot", slot_of("hi_us"))
        .withColumn("width", F.ceil(span / pieces).cast("long"))
        .select("trace_id", "t0_us", "interval_s", "lo_slot", "hi_slot", "width", "n_rows")
    )


def readings(trace_rows: DataFrame) -> DataFrame:
    """The columns the trace operators read; rows without trace_id or ts have no place in time and drop out."""
    return trace_rows.select(
        "trace_id",
        "row_idx",
        micros("ts").alias("us"),
        finite("temperature_c_raw").alias("value"),
        F.col("sample_interval_seconds").alias("interval"),
        *([finite("setpoint_c").alias("setpoint")] if "setpoint_c" in trace_rows.columns else []),
    ).filter(F.col("trace_id").isNotNull() & F.col("us").isNotNull())


def chunked(trace_rows: DataFrame, halo: int = 0, chunk_slots: int = CHUNK_SLOTS) -> DataFrame:
    """Readings with a temperature, by (trace_id, chunk) on one task each and in order of time, copies of the halo included."""
    rows = readings(trace_rows)
    joined = sized_join(rows.filter(F.col("value").isNotNull()).drop("interval"), trace_params(rows, chunk_slots), "trace_id", F.col("row_idx"))
    place = slot_of() - F.col("lo_slot")
    cells = joined.withColumn("_place", place).withColumn("chunk", F.floor(F.col("_place") / F.col("width")).cast("long"))
    if halo:
        inside = F.pmod(F.col("_place"), F.col("width"))
        last = F.floor((F.col("hi_slot") - F.col("lo_slot")) / F.col("width")).cast("long")
        before = F.when((inside < halo) & (F.col("chunk") > 0), F.col("chunk") - 1)
        after = F.when((inside >= F.col("width") - halo) & (F.col("chunk") < last), F.col("chunk") + 1)
        cells = cells.withColumn("_home", F.col("chunk")).withColumn(
            "chunk", F.explode(F.array_compact(F.array(F.col("chunk"), before, after)))
        )
        core = F.col("chunk") == F.col("_home")
    else:
        core = F.lit(True)
    keep = cells.select(
        "trace_id", "chunk", F.coalesce("row_idx", F.lit(-1)).alias("row_idx"), "us", "value", "setpoint", "interval_s", core.alias("core")
    )
    return keep.repartition("trace_id", "chunk").sortWithinPartitions("trace_id", "chunk", "us", "row_idx")
