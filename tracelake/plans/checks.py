"""Statements for DuckDB that say anew, in other terms, what stages of the analysis compute; results are compared with these.

They are written from the definitions of runs, regions, cycles, requirements and conformance, not from the stages: runs by
islands and ranks instead of running sums, last long runs by an as-of join, cycles by correlated look-ups, statuses by lists.
"""

from __future__ import annotations

from tracelake.functions.profiles import Profile


def _runs() -> str:
    return """
    WITH filled AS (
      SELECT *, count(dir) OVER (PARTITION BY trace_id ORDER BY row_idx) AS seen FROM slp),
    told AS (
      SELECT trace_id, row_idx, t, x, sp, s, si, CASE WHEN seen = 0 THEN 'STABLE' ELSE max(dir) OVER (PARTITION BY trace_id, seen) END AS d0 FROM filled),
    islands AS (
      SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY row_idx) - row_number() OVER (PARTITION BY trace_id, d0 ORDER BY row_idx) AS island FROM told),
    begun AS (SELECT *, min(row_idx) OVER (PARTITION BY trace_id, d0, island) AS first_row FROM islands)
    SELECT trace_id, row_idx, t, x, sp, s, si, d0, dense_rank() OVER (PARTITION BY trace_id ORDER BY first_row) AS run_no FROM begun"""


def _merged() -> str:
    return """
    WITH kept AS (SELECT r.trace_id, r.run_no, r.d0 FROM rrn r JOIN adc c USING (trace_id) WHERE r.duration >= c.min_region),
    told AS (
      SELECT r.trace_id, r.run_no, coalesce(k.d0, r.d0) AS d1
      FROM rrn r ASOF LEFT JOIN kept k ON k.trace_id = r.trace_id AND r.run_no >= k.run_no),
    islands AS (
      SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY run_no) - row_number() OVER (PARTITION BY trace_id, d1 ORDER BY run_no) AS island FROM told),
    begun AS (SELECT *, min(run_no) OVER (PARTITION BY trace_id, d1, island) AS first_run FROM islands)
    SELECT trace_id, run_no, d1, dense_rank() OVER (PARTITION BY trace_id ORDER BY first_run) AS region_no FROM begun"""


def _regions() -> str:
    return """
    WITH own AS (
      SELECT trace_id, region_no, any_value(d1) AS d1, min(row_idx) AS start_row, max(row_idx) AS end_row, count(*) AS n_rows, arg_min(t, row_idx) AS start_t, arg_max(t, row_idx) AS end_t,
             avg(x) AS mean_x, stddev_pop(x) AS std_x, min(x) AS min_x, max(x) AS max_x
      FROM rgr GROUP BY ALL),
    near AS (
      SELECT own.*, end_t - start_t AS duration, p.hot, p.cold, p.ambient_c, b.process_start, b.usable_end, c.min_region, abs(mean_x - p.hot) AS off_hot, abs(mean_x - p.cold) AS off_cold,
             greatest(c.cluster_c, 5.0) AS reach
      FROM own JOIN bnd b USING (trace_id) JOIN spt p USING (trace_id) JOIN adc c USING (trace_id)),
    named AS (
      SELECT *, CASE WHEN d1 IN ('HEATING', 'COOLING') THEN d1 || '_RAMP'
                     WHEN process_start >= end_row THEN 'AMBIENT_START'
                     WHEN start_row > usable_end THEN 'RECOVERY'
                     WHEN off_hot <= reach AND off_hot <= off_cold THEN 'HOT_DWELL'
                     WHEN off_cold <= reach THEN 'COLD_DWELL'
                     WHEN duration < min_region + min_region THEN 'TRANSIENT' ELSE 'UNKNOWN' END AS label
      FROM near)
    SELECT *, 'R' || right('0000' || region_no, greatest(4, length(CAST(region_no AS VARCHAR)))) AS region_id,
           CASE WHEN label = 'HOT_DWELL' THEN hot WHEN label = 'COLD_DWELL' THEN cold WHEN label = 'AMBIENT_START' THEN ambient_c END AS target
    FROM named"""


def _cycle_bounds() -> str:
    before = "(SELECT arg_max(p.label, p.region_no) FROM reg p WHERE p.trace_id = g.trace_id AND p.region_no < g.region_no AND p.label IN ('HOT_DWELL', 'COLD_DWELL'))"
    return f"""
    WITH dwells AS (SELECT g.trace_id, g.region_no, g.label, {before} AS earlier FROM reg g WHERE g.label IN ('HOT_DWELL', 'COLD_DWELL')),
    starts AS (SELECT trace_id, region_no FROM dwells WHERE label = 'HOT_DWELL' AND earlier IS DISTINCT FROM 'HOT_DWELL'),
    ends AS (SELECT trace_id, region_no FROM dwells WHERE label = 'COLD_DWELL' AND earlier = 'HOT_DWELL'),
    whole AS (SELECT trace_id, min(region_no) AS lo, max(region_no) AS hi, bool_or(label = 'HOT_DWELL') AS has_hot FROM reg GROUP BY trace_id)
    SELECT s.trace_id, rank() OVER (PARTITION BY s.trace_id ORDER BY s.region_no) AS cycle_no, s.region_no AS first_region,
           coalesce((SELECT min(e.region_no) FROM ends e WHERE e.trace_id = s.trace_id AND e.region_no > s.region_no), w.hi) AS last_region
    FROM starts s JOIN whole w USING (trace_id)
    UNION ALL SELECT trace_id, 1, lo, hi FROM whole WHERE NOT has_hot"""


def _results(p: Profile) -> str:
    return f"""
    WITH fine AS (SELECT trace_id FROM gate WHERE NOT (blocked OR blocks_pass_fail)),
    ramps AS (
      SELECT trace_id, region_id, 'RAMP_RATE_' || direction AS requirement, CASE direction WHEN 'COOLING' THEN abs(robust) ELSE robust END AS measured,
             CASE direction WHEN 'COOLING' THEN abs(sustained) ELSE sustained END AS kept, CASE direction WHEN 'COOLING' THEN {p.cooling_rate!r} ELSE {p.heating_rate!r} END * 1e0 AS required
      FROM rmm SEMI JOIN fine USING (trace_id)),
    dwells AS (SELECT w.* FROM dwm w SEMI JOIN fine USING (trace_id) WHERE label IN ('HOT_DWELL', 'COLD_DWELL')),
    usual AS (SELECT trace_id, median(duration) AS middle, sqrt(var_pop(duration)) AS spread FROM reg WHERE label LIKE '%\\_DWELL' ESCAPE '\\' GROUP BY trace_id),
    allowed AS (SELECT trace_id, {'dwell_deviation' if p.dwell_deviation is None else repr(float(p.dwell_deviation))} * 1e0 AS most FROM adc)
    SELECT trace_id, region_id, requirement, measured, required, CASE WHEN measured >= required THEN CASE WHEN kept >= required * {p.sustained_ratio!r} THEN 'PASS' ELSE 'PASS_WITH_WARNINGS' END ELSE 'FAIL' END AS status FROM ramps
    UNION ALL SELECT trace_id, region_id, 'DWELL_DURATION', duration, middle, CASE WHEN abs(duration - middle) > {p.duration_sigmas!r} * spread THEN 'FAIL' ELSE 'PASS' END FROM dwells JOIN usual USING (trace_id)
    UNION ALL SELECT trace_id, region_id, 'SETPOINT_DEVIATION', deviation, most, CASE WHEN deviation > most THEN 'FAIL' ELSE 'PASS' END FROM dwells JOIN allowed USING (trace_id)"""


def _phases() -> str:
    return """
    SELECT trace_id, region_id, CASE WHEN list_contains(all_, 'FAIL') THEN 4 WHEN list_contains(all_, 'INCONCLUSIVE') THEN 3 WHEN list_contains(all_, 'PASS_WITH_WARNINGS') THEN 2 ELSE 1 END AS worst
    FROM (SELECT trace_id, region_id, list(status) AS all_ FROM res WHERE status IN ('FAIL', 'INCONCLUSIVE', 'PASS_WITH_WARNINGS', 'PASS') GROUP BY ALL) q"""


def _overall(p: Profile) -> str:
    return f"""
    WITH seen AS (SELECT trace_id, list(worst) AS w FROM phs GROUP BY trace_id),
    counted AS (
      SELECT g.*, coalesce(len(w), 0) AS phases, coalesce(len(list_filter(w, lambda v: v < 3)), 0) AS passed, coalesce(len(list_filter(w, lambda v: v = 4)), 0) AS failed,
             coalesce(len(list_filter(w, lambda v: v > 1)), 0) AS anomalies
      FROM gate g LEFT JOIN seen USING (trace_id)),
    share AS (SELECT *, CASE WHEN phases = 0 THEN 0e0 ELSE 1e2 * passed / phases END AS conformance_pct FROM counted)
    SELECT trace_id, phases, passed, failed, anomalies, conformance_pct,
           CASE WHEN blocked OR blocks_pass_fail THEN 'INCONCLUSIVE' WHEN conformance_pct < {p.conformance_pct!r} THEN 'FAIL' ELSE 'PASS' END AS status
    FROM share"""


def _sequence(p: Profile) -> str:
    expected = "[" + ", ".join(f"'{x}'" for x in p.sequence) + "]"
    return f"""
    WITH labels AS (SELECT trace_id, list(label ORDER BY region_no) AS own, {expected} AS expected FROM reg GROUP BY trace_id),
    walked AS (SELECT trace_id, expected, list_reduce(list_prepend(0, list_transform(own, lambda l: list_position(expected, l))), lambda f, k: CASE WHEN k = f + 1 THEN k ELSE f END) AS found FROM labels)
    SELECT trace_id, found, array_to_string(list_slice(expected, found + 1, len(expected)), ', ') AS missing FROM walked"""


def independent(profile: Profile) -> dict[str, str]:
    """Statements by the name of the stage they stand for."""
    return {
        "run": _runs(), "mrg": _merged(), "reg": _regions(), "cyb": _cycle_bounds(), "res": _results(profile), "phs": _phases(), "ovr": _overall(profile),
        "seq": _sequence(profile),
    }
