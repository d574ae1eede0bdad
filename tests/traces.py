"""Small trace tables for tests."""

from datetime import datetime, timedelta

SCHEMA = (
    "trace_id string, row_idx long, ts timestamp_ntz, temperature_c_raw double, setpoint_c double, sample_interval_seconds double,"
    " channel string, source_file string, ingested_at timestamp_ntz, chunk string, us string, slot string, _salt int"
)
META = "source_file string, logger_id string, file_seq int, header_row_index int, header_note string, detected_temperature_unit string, ingested_at timestamp_ntz"
START = datetime(2024, 1, 1)


def rows(spark, cells, trace="f#Temp", interval=10.0):
    """cells: (row_idx, seconds, temperature[, setpoint]); the last columns clash with names the operators use inside."""
    out = []
    for cell in cells:
        row_idx, seconds, value = cell[:3]
        setpoint = cell[3] if len(cell) > 3 else None
        ts = None if seconds is None else START + timedelta(seconds=seconds)
        source, _, channel = (trace or "#").partition("#")
        out.append((trace, row_idx, ts, value, setpoint, interval, channel, source, START, "x", "y", "z", 1))
    return spark.createDataFrame(out, SCHEMA)


def metadata(spark, *files):
    return spark.createDataFrame([(f, "L1", i, 0, note, guess, START) for i, (f, note, guess) in enumerate(files)], META)
