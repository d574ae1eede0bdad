"""Queries of the trace analysis: every operator on the whole of trace_rows, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.functions.profiles import REPORT_ONLY, STANDARD, Profile
from tracelake.operators.signal import canonical_trace, sustained_start, trace_frames, trace_signals
from tracelake.operators.slopes import ramp_slopes
from tracelake.plans.checks import independent
from tracelake.plans.stages import DUCK_SOURCES, PROFILED, STAGES, Dialect, doubles, needs, render
from tracelake.session import fingerprint, still_there, table, use_utc, write_shared

Query = Callable[[SparkSession, str], DataFrame]


def _r(columns: str, digits: int = 6) -> str:
    """Columns rounded for comparison, under their own or the given name.

    Means of readings of three decimals often lie halfway; a nudge, above the noise of sums taken in another order and far
    below the last digit, rounds those up on either engine.
    """
    out = []
    for part in columns.split(", "):
        expr, _, name = part.partition(" AS ")
        out.append(f"round({expr} + 1e-{digits + 3}, {digits}) AS {name or expr}")
    return ", ".join(out)


def _half_up(columns: str, digits: int) -> str:
    """Columns rounded for a report, halves up on either engine."""
    out = []
    for part in columns.split(", "):
        expr, _, name = part.partition(" AS ")
        out.append(f"floor(round({expr}, 6) * 1e{digits} + 5e-1) / 1e{digits} AS {name or expr}")
    return ", ".join(out)


def _n(columns: str) -> str:
    """Columns as BIGINT."""
    out = []
    for part in columns.split(", "):
        expr, _, name = part.partition(" AS ")
        out.append(f"CAST({expr} AS BIGINT) AS {name or expr}")
    return ", ".join(out)


_RANK = "CASE worst WHEN 4 THEN 'FAIL' WHEN 3 THEN 'INCONCLUSIVE' WHEN 2 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END"
_RESULT = f"trace_id, region_id, requirement, {_r('measured, required')}, status"

#: Colours of regions on a chart.
COLOURS = {
    "HEATING_RAMP": "#FF8C00", "COOLING_RAMP": "#4169E1", "HOT_DWELL": "#228B22", "COLD_DWELL": "#32CD32", "AMBIENT_START": "#808080", "HOT_OVERSHOOT": "#DC143C",
    "COLD_OVERSHOOT": "#0000CD", "HOT_CORRECTION": "#FF6347", "COLD_CORRECTION": "#4682B4", "RECOVERY": "#9370DB", "TRANSIENT": "#DAA520", "UNKNOWN": "#696969",
}
_COLOUR = "CASE g.label " + " ".join(f"WHEN '{label}' THEN '{colour}'" for label, colour in COLOURS.items()) + " END"

#: The last SELECT of each query.
SELECTS: dict[str, str] = {
    "canonical_trace": f"SELECT trace_id, row_idx, {_r('t AS elapsed_seconds, elapsed_minutes, x AS temperature_c, sp AS setpoint_c')}, missing FROM can",
    "elapsed_time": f"SELECT trace_id, row_idx, {_r('t AS elapsed_seconds')} FROM can",
    "sample_interval": f"SELECT trace_id, {_n('n')}, {_r('si AS sample_interval_s')} FROM par",
    "hampel_spikes": "SELECT trace_id, row_idx FROM sig WHERE spike",
    "hampel_clean": f"SELECT trace_id, row_idx, {_r('clean AS analysis_signal_c')} FROM sig",
    "rolling_median": f"SELECT trace_id, row_idx, {_r('med AS rolling_median_c')} FROM sig",
    "rolling_mad": f"SELECT trace_id, row_idx, {_r('mad AS rolling_mad_c')} FROM sig",
    "local_slope": f"SELECT trace_id, row_idx, {_r('ls AS local_slope', 4)} FROM sig",
    "rolling_slope": f"SELECT trace_id, row_idx, {_r('rs AS rolling_slope', 4)} FROM sig",
    "second_derivative": f"SELECT trace_id, row_idx, {_r('d2 AS second_derivative', 4)} FROM sig",
    "direction": "SELECT trace_id, row_idx, dir AS direction_of_travel FROM sig",
    "quality_flags": "SELECT trace_id, row_idx, concat_ws(',', CASE WHEN spike THEN 'SPIKE' END, CASE WHEN gap_next THEN 'GAP' END, CASE WHEN dup THEN 'DUPLICATE_TIMESTAMP' END, CASE WHEN ooo THEN 'OUT_OF_ORDER' END) AS flags FROM flg",
    "preprocess_report": f"SELECT trace_id, {_n('n, n_spikes, n_gaps, n_dup, n_ooo')}, {_r('si, irregular, duration, noise_floor, mad_baseline, slope_noise, gap_density, continuity')} FROM rep",
    "data_quality": f"SELECT trace_id, status, {_r('missing_pct, duplicate_pct, irregular_pct, duration')}, {_n('n_ooo, n_gaps, n_spikes')}, ramp_data, notes FROM qlt",
    "quality_gate": "SELECT trace_id, status, blocked, blocks_pass_fail, affected FROM gate",
    "ambient_end": f"SELECT trace_id, {_n('ambient_end')} FROM bnd0",
    "process_end": f"SELECT trace_id, {_n('process_end')} FROM bnd0",
    "cusum_start": f"SELECT trace_id, {_n('process_start')} FROM cus",
    "boundaries": f"SELECT trace_id, {_n('n, ambient_end, process_start, process_end, recovery_start, usable_end')}, partial_edges FROM bnd",
    "setpoints": f"SELECT trace_id, mode, {_r('hot, cold, ambient_c')} FROM spt",
    "adaptive_constants": f"SELECT trace_id, {_r('noise, slope_noise, stable_slope, stable_variance, ramp_slope, overshoot, correction, cluster_c, min_region, ramp_deviation, dwell_deviation')} FROM adc",
    "tolerance": f"SELECT trace_id, parameter_name, {_r('tolerance_c')}, tolerance_source FROM tol",
    "region_runs": f"SELECT trace_id, {_n('run_no, start_row, end_row')}, d0 AS direction, {_r('duration')} FROM rrn",
    "regions": f"SELECT trace_id, region_id, label, {_n('start_row, end_row, n_rows')}, {_r('duration, mean_x, std_x, min_x, max_x, target')} FROM reg",
    "evidence_fusion": f"SELECT trace_id, region_id, {_r('ramp_score, dwell_score, overshoot_score, correction_score, transient_score, unknown_score, margin', 9)}, ambiguous, confidence FROM evd",
    "ramp_envelope": f"SELECT trace_id, region_id, {_n('env_start, env_end, env_stop')} FROM env",
    "ramp_monotonicity": f"SELECT trace_id, region_id, {_r('monotonicity')} FROM vrm",
    "ramp_stalls": f"SELECT trace_id, region_id, {_r('stall_s')}, {_n('reversals')} FROM vrm",
    "valid_ramps": f"SELECT trace_id, region_id, direction, {_n('env_start, env_stop, n_rows, reversals, excluded_rows')}, {_r('duration, monotonicity, stall_s')} FROM vrm",
    "ramp_excluded_rows": "SELECT r.trace_id, r.region_id, r.row_idx FROM rmr r JOIN vrm v ON v.trace_id = r.trace_id AND v.region_no = r.region_no WHERE r.row_idx NOT BETWEEN v.env_start AND v.env_stop",
    "theil_sen": f"SELECT trace_id, region_id, {_r('robust AS slope_c_per_min', 4)} FROM rmm",
    "min_sustained_slope": f"SELECT trace_id, region_id, {_r('sustained', 4)} FROM rmm",
    "endpoint_slope": f"SELECT trace_id, region_id, {_r('endpoint', 4)} FROM rmm",
    "ramp_robust": f"SELECT trace_id, region_id, {_r('median_rolling, slope_mad, jitter', 4)} FROM rmm",
    "ramp_taper": f"SELECT trace_id, region_id, {_r('taper', 4)} FROM rmm",
    "ramp_linearity": f"SELECT trace_id, region_id, {_r('linearity', 4)} FROM rmm",
    "ramp_metrics": f"SELECT trace_id, region_id, direction, {_r('duration, stall_s, robust, sustained, endpoint, median_rolling, slope_mad, jitter, taper, linearity', 4)} FROM rmm",
    "dwell_basic": f"SELECT trace_id, region_id, label, {_r('mean_x, std_x, range_x, deviation')} FROM dwm",
    "dwell_time_in_band": f"SELECT trace_id, region_id, {_r('in_band_s, in_band_pct')} FROM dwm",
    "dwell_overshoot": f"SELECT trace_id, region_id, {_r('overshoot, overshoot_s')} FROM dwm",
    "dwell_settling": f"SELECT trace_id, region_id, {_r('settling_s')} FROM dwm",
    "dwell_oscillation": f"SELECT trace_id, region_id, {_n('oscillations')} FROM dwm",
    "dwell_stability": f"SELECT trace_id, region_id, {_r('stability')} FROM dwm",
    "dwell_metrics": f"SELECT trace_id, region_id, label, {_r('duration, mean_x, std_x, range_x, deviation, in_band_s, in_band_pct, overshoot, overshoot_s, settling_s, stability')}, {_n('oscillations')} FROM dwm",
    "cycle_boundaries": f"SELECT trace_id, {_n('cycle_no, first_region, last_region')} FROM cyb",
    "cycles": f"SELECT trace_id, cycle_id, status, {_n('n_regions, heat, cool, hot, cold, start_row, end_row')}, {_r('duration, dwell_s')} FROM cyc",
    "cycle_drift": f"SELECT trace_id, cycle_id, {_r('drift')} FROM cyc",
    "cycle_metrics": f"SELECT trace_id, cycle_id, {_r('duration, heat_avg, heat_min, cool_avg, cool_max, jitter, taper, stability, overshoot, ramp_s, dwell_s', 8)} FROM cym",
    "cycle_metrics_own": f"SELECT trace_id, cycle_id, {_r('duration, heat_avg, heat_min, cool_avg, cool_max, jitter, taper, stability, overshoot, ramp_s, dwell_s', 8)} FROM cyo",
    "validate_ramps": f"SELECT {_RESULT} FROM res WHERE requirement LIKE 'RAMP_RATE%'",
    "validate_sustained": "SELECT trace_id, region_id, sustained_ok FROM sus",
    "validate_dwell_duration": f"SELECT {_RESULT} FROM res WHERE requirement = 'DWELL_DURATION'",
    "validate_setpoint": f"SELECT {_RESULT} FROM res WHERE requirement = 'SETPOINT_DEVIATION'",
    "validate_overshoot": f"SELECT trace_id, region_id, {_r('overshoot')}, overshoot_within AS within FROM dwl",
    "validate_settling": f"SELECT trace_id, region_id, {_r('settling_s')}, settling_within AS within FROM dwl",
    "validate_cycle_count": "SELECT trace_id, CAST(complete_cycles AS BIGINT) AS complete_cycles, enough FROM cyn",
    "validate_sequence": "SELECT trace_id, CAST(found AS BIGINT) AS phases_found, missing = '' AS in_sequence, missing FROM seq",
    "validation_results": f"SELECT {_RESULT} FROM res",
    "phase_conformance": f"SELECT trace_id, region_id, {_RANK} AS worst_status, worst >= 2 AS anomaly FROM phs",
    "overall_status": f"SELECT trace_id, {_n('phases, passed, failed, anomalies')}, {_r('conformance_pct', 4)}, status FROM ovr",
    "metric_distribution": f"SELECT trace_id, metric, {_r('mean_v, std_v, min_v, max_v', 7)} FROM dst",
    "cycle_drift_detect": f"SELECT trace_id, drift_detected, {_r('heating_slope, cooling_slope, dwell_stability, cycle_duration', 4)} FROM drf",
    "consistency_score": f"SELECT trace_id, {_r('score', 4)} FROM cns",
    "anomalies": f"SELECT g.trace_id, g.region_id, g.label, {_r('mean_x')} FROM reg g JOIN phs p ON p.trace_id = g.trace_id AND p.region_id = g.region_id WHERE p.worst >= 2",
    "phase_table": f"SELECT g.trace_id, CAST(row_number() OVER (PARTITION BY g.trace_id ORDER BY g.start_row) AS BIGINT) AS phase_no, g.label, {_half_up('g.target AS target_c', 1)}, {_half_up('r.robust AS slope_c_per_min', 2)}, {_half_up('w.mean_x AS mean_c, w.deviation AS deviation_c', 1)}, {_half_up('g.duration / 60 AS minutes', 1)}, CASE WHEN p.worst >= 2 THEN 'ANOMALY' ELSE 'OK' END AS verdict FROM reg g LEFT JOIN rmm r ON r.trace_id = g.trace_id AND r.region_no = g.region_no LEFT JOIN dwm w ON w.trace_id = g.trace_id AND w.region_no = g.region_no LEFT JOIN phs p ON p.trace_id = g.trace_id AND p.region_id = g.region_id",
    "ramp_summary": f"SELECT {_RESULT} FROM res WHERE requirement LIKE '%RAMP_RATE%'",
    "cycle_summary": f"SELECT trace_id, cycle_id, status, {_n('n_regions')}, {_r('duration')} FROM cyc",
    "overshoot_summary": f"SELECT trace_id, region_id, label, {_r('overshoot, overshoot_s')} FROM dwm WHERE overshoot > 0",
    "region_overlay": f"SELECT g.trace_id, g.region_id, g.label, {_r('g.start_t AS x0, g.end_t AS x1')}, CASE WHEN p.worst >= 2 THEN 'anomaly' ELSE 'normal' END AS shade, {_COLOUR} AS colour FROM reg g LEFT JOIN phs p ON p.trace_id = g.trace_id AND p.region_id = g.region_id",
    "chart_annotations": f"SELECT r.trace_id, r.region_id, r.requirement, r.status, {_r('s.t AS x_seconds')} FROM res r JOIN reg g ON g.trace_id = r.trace_id AND g.region_id = r.region_id JOIN sig s ON s.trace_id = g.trace_id AND s.row_idx = CAST(floor((g.start_row + g.end_row) / 2) AS BIGINT) WHERE r.status <> 'PASS' AND r.requirement <> 'DWELL_DURATION'",
    "executive_summary": f"SELECT trace_id, status, reason, recommendation, {_r('conformance_pct, hot_target_c, cold_target_c, hours, dwell_tolerance_c, ramp_tolerance_c')}, {_n('regions, ramps, cycles, anomalies')} FROM exs",
    "report_sections": f"SELECT trace_id, CAST(section_no AS BIGINT) AS section_no, section, item, {_r('value')}, note FROM sec",
    "trace_chart": f"SELECT trace_id, series, {_r('x_seconds, y_c')}, {_n('layer')} FROM crt",
    "audit_log": f"SELECT trace_id, {_n('step')}, module, action, subject, decision, {_r('threshold')}, {_n('rows_used, rows_excluded')}, severity FROM aud",
    "adaptive_clamped": f"SELECT trace_id, parameter, {_r('derived, value')}, was_clamped FROM acl",
    "audit_head": f"SELECT trace_id, region_id, requirement, status FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY region_id, requirement) AS seq FROM res) q WHERE seq <= 50",
}
#: Stages written when they are made, as others read them several times; the rest is part of its reader's plan.
CUT = frozenset("rep bth bnd0 amb bnd spt adc rrn mrg rgr reg env vrm vrr rmm dwm cyb cyc cym cyo res phs".split())


class TraceAnalysis:
    """The stages of one data set on Spark, each written stage made at most once and only when something reads it.

    Like the pipeline it stands for, it makes a stage from the finished stages before it: written to the shared folder,
    a stage's plan stays as small as one step, and a lost executor costs the running step only. What is not written is
    part of the statement that reads it, and every statement reads the written stages anew, so no plan depends on which
    queries ran before.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.made: dict[tuple[str, Profile | None], tuple[str, StructType]] = {}

    def stage(self, name: str, profile: Profile = STANDARD) -> DataFrame:
        """A written stage, made if it is not there yet."""
        key = (name, profile if name in PROFILED else None)
        if key not in self.made or not still_there(self.spark, self.made[key][0]):
            df = self._source(name) if name in DUCK_SOURCES else self.run(STAGES[name](Dialect(duck=False, profile=profile)), profile)
            self.made[key] = (write_shared(df), df.schema)
        path, schema = self.made[key]
        return self.spark.read.schema(schema).parquet(path)

    def _source(self, name: str) -> DataFrame:
        if name == "can":
            return canonical_trace(table(self.spark, self.folder, "trace_rows"))
        if name == "par":
            return trace_frames(self.stage("can"))
        if name == "sig":
            return trace_signals(self.stage("can"), self.stage("par"))
        if name == "cus":
            return sustained_start(self.run("SELECT * FROM cst"))
        return ramp_slopes(self.stage("vrr").select("trace_id", "region_no", "row_idx", "t", "x", "si"))

    def run(self, select: str, profile: Profile = STANDARD) -> DataFrame:
        """A SELECT over stages: the written ones as tables, the others put in front of it."""
        dialect = Dialect(duck=False, profile=profile)
        tables: dict[str, DataFrame] = {}
        inline: list[tuple[str, str]] = []

        def visit(sql: str) -> None:
            for name in needs(sql):
                if name in tables or any(n == name for n, _ in inline):
                    continue
                if name in CUT or name in DUCK_SOURCES:
                    tables[name] = self.stage(name, profile)
                else:
                    body = STAGES[name](dialect)
                    visit(body)
                    inline.append((name, body))

        visit(select)
        parts = [f"{n} AS (SELECT * FROM {{{n}}})" for n in tables] + [f"{n} AS ({body})" for n, body in inline]
        return self.spark.sql(doubles(f"WITH {', '.join(parts)} {select}" if parts else select), **tables)


_analyses: dict[tuple, TraceAnalysis] = {}


def forget() -> None:
    """Make all stages anew when they are next read."""
    _analyses.clear()


def analysis(spark: SparkSession, folder: str, select: str, profile: Profile = STANDARD) -> DataFrame:
    """A SELECT over the stages of a folder's trace_rows.

    Stages are shared by the queries of a session as long as the files are the same (names, lengths and times).
    """
    use_utc(spark)
    key = (spark.sparkContext.applicationId, folder, fingerprint(spark, f"{folder}/trace_rows.parquet"))
    if key not in _analyses:
        _analyses.clear()
        _analyses[key] = TraceAnalysis(spark, folder)
    return _analyses[key].run(select, profile)


#: Queries that are also there under the profile that only reports.
REPORTED = ("tolerance", "validation_results", "overall_status", "validate_sequence", "validate_cycle_count")


def queries() -> dict[str, Query]:
    out = {name: (lambda s, d, select=select: analysis(s, d, select)) for name, select in SELECTS.items()}
    out["result_json"] = result_json
    return out | {f"{name}_report_only": (lambda s, d, select=SELECTS[name]: analysis(s, d, select, REPORT_ONLY)) for name in REPORTED}


def result_json(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON object a trace: summary, phases and results; what is null is left out."""
    summary = analysis(spark, folder, "SELECT * FROM exs")
    phases = analysis(spark, folder, SELECTS["phase_table"])
    results = analysis(spark, folder, SELECTS["validation_results"])
    each = lambda df, name: df.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "trace_id"]))).alias(name))
    whole = summary.join(each(phases.select("trace_id", "phase_no", *[c for c in phases.columns if c not in ("trace_id", "phase_no")]), "phases"), "trace_id", "left")
    whole = whole.join(each(results, "results"), "trace_id", "left")
    return whole.select("trace_id", F.to_json(F.struct(*[c for c in whole.columns])).alias("result"))


def oracle_sql() -> dict[str, str]:
    def sql(name: str, profile: Profile) -> str:
        return render(SELECTS[name], Dialect(duck=True, profile=profile), independent(profile))

    return {name: sql(name, STANDARD) for name in SELECTS} | {f"{name}_report_only": sql(name, REPORT_ONLY) for name in REPORTED}
