"""The flags of a trace while it is being recorded: Structured Streaming with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"
GAP_INTERVALS, DUPLICATE_SECONDS = 3.0, 0.001
#: A trace that is silent for so long (event time) is forgotten.
IDLE_MS = 24 * 3600 * 1000
_OUT = "trace_id string, row_idx long, ts timestamp, flag string"
_STATE = "last_s double, interval_s double"


def windowed_statistics(stream: DataFrame, length: str = "1 minute", late: str = LATE) -> DataFrame:
    """Readings, mean, lowest and highest temperature per trace and window of event time; later than late is dropped."""
    value = F.when(~F.isnan("temperature_c_raw"), F.col("temperature_c_raw"))
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("trace_id", F.window("at", length).alias("w")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean_c"), F.min(value).alias("min_c"), F.max(value).alias("max_c")
    ).select("trace_id", F.col("w.start").alias("window_start"), "n", "mean_c", "min_c", "max_c")


def _flag(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last, interval = state.get if state.exists else (np.nan, np.nan)
    whole = pd.concat(list(frames), ignore_index=True).sort_values("row_idx", kind="stable")
    now = whole["at"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
    step = whole["sample_interval_seconds"].astype("float64").to_numpy()
    known = pd.Series(np.append(interval, np.where(step > 0, step, np.nan))).ffill().to_numpy()[1:]
    gone = now - np.append(last, now[:-1])
    flag = np.select([gone < 0, gone < DUPLICATE_SECONDS, gone > GAP_INTERVALS * known], ["OUT_OF_ORDER", "DUPLICATE_TIMESTAMP", "GAP"], "")
    told = flag != ""
    yield pd.DataFrame({"trace_id": key[0], "row_idx": whole["row_idx"].to_numpy()[told], "ts": whole["at"].to_numpy()[told], "flag": flag[told]})
    state.update((float(now[-1]), float(known[-1])))
    state.setTimeoutTimestamp(max(int(now.max() * 1000), state.getCurrentWatermarkMs()) + IDLE_MS)


def live_flags(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Gaps, repeated and out-of-order times, in order of arrival; the state of a trace is its last time and interval.

    Rows of one micro-batch are put in order of row_idx; a row that arrives in a later batch counts as arriving then.
    """
    timed = stream.filter("trace_id is not null and row_idx is not null and ts is not null").withColumn("at", F.col("ts").cast("timestamp"))
    keyed = timed.withWatermark("at", late).select("trace_id", "row_idx", "at", "sample_interval_seconds").groupBy("trace_id")
    return keyed.applyInPandasWithState(_flag, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
