"""Queries p1 to p6: the general data-pipeline operators on their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.operators import drift, grid, rawlines, spikes, stamps, units
from tracelake.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(names: str, operator: Callable[..., DataFrame]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return operator(*[table(spark, folder, name) for name in names.split()])

    return query


def _stamps(operator: Callable[..., DataFrame]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        tables = [table(spark, folder, name) for name in ("reading_stamps", "file_metadata", "loggers")]
        return operator(*tables, dictionary_folder=stamps.session_dictionary(spark))

    return query


_LINES = "raw_lines file_metadata raw_traces channel_catalog"


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on("trace_rows", grid.missing_slots),
        "p1_grid": _on("trace_rows", grid.regular_grid),
        "p2_found": _on("raw_traces file_metadata channel_catalog", drift.schema_changes),
        "p2_report": _on("raw_traces file_metadata channel_catalog", drift.schema_report),
        "p2_table": _on("raw_traces channel_catalog", drift.rescued_table),
        "p3_found": _on("trace_rows file_metadata", spikes.faulty_rows),
        "p3_faults": _on("trace_rows file_metadata", spikes.faulty_readings),
        "p4_found": _on("trace_rows file_metadata", units.foreign_readings),
        "p4_celsius": _on("trace_rows file_metadata", units.readings_in_celsius),
        "p5_found": _on(_LINES, rawlines.rejected_lines),
        "p5_rejects": _on(_LINES, rawlines.reject_report),
        "p5_rows": _on(_LINES, rawlines.valid_rows),
        "p5_counts": _on(_LINES, rawlines.usable_counts),
        "p6_found": _stamps(stamps.reading_instants),
        "p6_stamps": _stamps(stamps.normalised_stamps),
    }


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can express on whole tables; tests hold the others against brute force."""
    return {
        "p1_found": """
            WITH r AS (SELECT trace_id, row_idx, epoch_us(ts) AS us, sample_interval_seconds AS si, temperature_c_raw AS v FROM trace_rows WHERE trace_id IS NOT NULL AND ts IS NOT NULL),
            p AS (SELECT trace_id, arg_min(us, row_idx) AS t0 FROM r GROUP BY trace_id),
            m AS (SELECT trace_id, arg_max(si, (n, -si)) AS s FROM (SELECT trace_id, si, count(*) AS n FROM r WHERE si > 0 AND NOT isnan(si) GROUP BY trace_id, si) q GROUP BY trace_id),
            x AS (SELECT r.trace_id, CAST(floor((us - t0) / 1e6 / s + 0.5) AS BIGINT) AS slot, coalesce(isfinite(v), false) AS has FROM r JOIN p ON p.trace_id = r.trace_id JOIN m ON m.trace_id = r.trace_id),
            b AS (SELECT trace_id, min(slot) AS lo, max(slot) AS hi FROM x GROUP BY trace_id),
            g AS (SELECT trace_id, unnest(range(lo, hi + 1)) AS slot FROM b)
            SELECT g.trace_id, g.slot FROM g LEFT JOIN (SELECT DISTINCT trace_id, slot FROM x WHERE has) o ON o.trace_id = g.trace_id AND o.slot = g.slot WHERE o.slot IS NULL""",
    }
