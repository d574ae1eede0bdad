"""The trace analysis as named relational stages, written once for Spark SQL and once more rendered for DuckDB.

A stage is a SELECT over other stages; rendering puts what it needs in front as common table expressions. On Spark the
signal stages (can, par, sig, slopes) are DataFrames made by operators; on DuckDB they have SQL of their own below.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from tracelake.functions.profiles import STANDARD, Profile

W = "PARTITION BY trace_id ORDER BY row_idx"
#: Adaptive bounds and other fixed values of the analysis.
BOUNDS = {
    "noise": (0.01, 2.0), "slope_noise": (0.05, 5.0), "stable_slope": (0.1, 8.0), "stable_variance": (0.02, 3.0), "ramp_slope": (0.3, 20.0),
    "overshoot": (0.1, 10.0), "correction": (0.05, 5.0), "cluster": (0.5, 15.0), "min_region": (5.0, 120.0),
}
RAMP_SECONDS, RAMP_MONOTONICITY, REVERSAL, BAND_C, SETTLING_C, DRIFT = 30.0, 0.7, 1.5, 5.0, 3.0, 0.5


class Dialect:
    """What the two engines spell differently."""

    def __init__(self, duck: bool, profile: Profile = STANDARD) -> None:
        self.duck, self.profile = duck, profile

    def quantile(self, expr: str, p: float, where: str = "") -> str:
        head = f"quantile_cont({expr}, {p})" if self.duck else f"percentile({expr}, {p}D)"
        return head + (f" FILTER (WHERE {where})" if where else "")

    def median(self, expr: str, where: str = "") -> str:
        return self.quantile(expr, 0.5, where)

    def last_known(self, expr: str, over: str) -> str:
        head = f"last_value({expr} IGNORE NULLS)" if self.duck else f"last_value({expr}) IGNORE NULLS"
        return f"{head} OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def fixed(self, expr: str) -> str:
        return f"printf('%.1f', {expr})" if self.duck else f"format_string('%.1f', {expr})"

    def floor(self, expr: str) -> str:
        return f"CAST(floor({expr}) AS BIGINT)"

    def ceil(self, expr: str) -> str:
        return f"CAST(ceil({expr}) AS BIGINT)"

    def clamp(self, name: str, expr: str) -> str:
        low, high = BOUNDS[name]
        return f"greatest({self.number(low)}, least({self.number(high)}, {expr}))"

    @staticmethod
    def number(value: float) -> str:
        return f"CAST({value} AS DOUBLE)"


def _flags(d: Dialect) -> str:
    gap = lambda step: f"{step} >= 0.001 AND {step} > 3 * par.si"
    return f"""
    SELECT sig.trace_id, row_idx, t, x, spike, d, d < 0 AS ooo, d >= 0 AND d < 0.001 AS dup, {gap('d')} AS gap, {gap('dn')} AS gap_next, par.si
    FROM sig JOIN par ON par.trace_id = sig.trace_id"""


def _report(d: Dialect) -> str:
    return f"""
    SELECT f.trace_id, f.n, f.si, f.n_spikes, f.n_gaps, f.n_dup, f.n_ooo, f.irregular, f.duration,
           m.noise_floor, m.mad_baseline, m.noise_floor / f.si * 120 AS slope_noise,
           f.n_gaps / CAST(f.n AS DOUBLE) AS gap_density, 1 - f.n_gaps / CAST(f.n AS DOUBLE) AS continuity
    FROM (SELECT trace_id, count(*) AS n, max(si) AS si, sum(CASE WHEN spike THEN 1 ELSE 0 END) AS n_spikes,
                 sum(CASE WHEN gap THEN 1 ELSE 0 END) AS n_gaps, sum(CASE WHEN dup THEN 1 ELSE 0 END) AS n_dup,
                 sum(CASE WHEN ooo THEN 1 ELSE 0 END) AS n_ooo,
                 CASE WHEN count(*) < 2 THEN 0.0 ELSE sum(CASE WHEN abs(d - si) > 0.5 * si THEN 1 ELSE 0 END) / CAST(count(*) - 1 AS DOUBLE) END AS irregular,
                 max_by(t, row_idx) - min_by(t, row_idx) AS duration
          FROM flg GROUP BY trace_id) f
    JOIN (SELECT trace_id, coalesce({d.median('mad', 'row_idx < 100')}, 0.0) AS noise_floor, {d.median('mad')} AS mad_baseline
          FROM sig GROUP BY trace_id) m ON m.trace_id = f.trace_id"""


def _quality(d: Dialect, most_spikes: int = 10, least_seconds: float = 60) -> str:
    missing, dup, gap = "gap_density * 100", "n_dup * 100.0 / n", "CASE WHEN n_gaps > 0 THEN si ELSE 0.0 END"
    severe = f"({missing} > 10 OR {dup} > 2 OR n_ooo > n * 0.1 OR duration < {least_seconds})"
    unclear = f"({gap} > 60 OR n_spikes > {2 * most_spikes})"
    warned = f"({missing} > 5 OR {dup} > 1 OR n_ooo > 0 OR {gap} > 30 OR n_spikes > {most_spikes})"
    over = lambda value, limit, text, tail="": (
        f"CASE WHEN {value} > 2 * {limit} THEN '{text} ' || {d.fixed(value)} || '{tail} exceeds 2x threshold' WHEN {value} > {limit} THEN '{text} ' || {d.fixed(value)} || '{tail} exceeds threshold' END"
    )
    notes = f"""concat_ws('; ', {over(missing, 5, 'Missing data', '%')}, {over(dup, 1, 'Duplicate timestamps', '%')},
        CASE WHEN n_ooo > n * 0.1 THEN 'Out-of-order rows ' || n_ooo || ' exceeds 10%' WHEN n_ooo > 0 THEN n_ooo || ' out-of-order rows detected' END,
        {over(gap, 30, 'Gap duration', 's')}, CASE WHEN duration < {least_seconds} THEN 'Process duration ' || {d.fixed('duration')} || 's below minimum' END,
        CASE WHEN n_spikes > {2 * most_spikes} THEN 'Spike count ' || n_spikes || ' exceeds 2x threshold' WHEN n_spikes > {most_spikes} THEN 'Spike count ' || n_spikes || ' exceeds threshold' END)"""
    return f"""
    SELECT trace_id, CASE WHEN {severe} THEN 'INVALID' WHEN {unclear} THEN 'INCONCLUSIVE' WHEN {warned} THEN 'WARNING' ELSE 'ACCEPTABLE' END AS status,
           {missing} AS missing_pct, {dup} AS duplicate_pct, n_ooo, irregular * 100 AS irregular_pct, n_gaps, n_spikes, duration, continuity >= 0.8 AS ramp_data,
           CASE WHEN {notes} = '' THEN 'No quality issues detected' ELSE {notes} END AS notes
    FROM rep"""


def _gate(d: Dialect) -> str:
    return f"""
    SELECT trace_id, status, notes,
           status = 'INVALID' AND NOT (notes LIKE '%Spike count%' AND notes NOT LIKE '%Process duration%') AS blocked,
           status = 'INCONCLUSIVE' AS blocks_pass_fail, CASE WHEN status = 'INCONCLUSIVE' THEN 'ALL' ELSE '' END AS affected
    FROM ({_quality(d, 200, 10)}) q"""


def _slope_rows(d: Dialect) -> str:
    return f"""
    SELECT sig.trace_id, row_idx, t, x, sp, coalesce(rs, 0.0) AS s, tm, dir, n, si, mb, greatest(3, {d.ceil('10 / si')}) AS mc
    FROM sig JOIN par ON par.trace_id = sig.trace_id"""


def _thresholds(d: Dialect) -> str:
    half = f"greatest(0.1, 0.5 * {d.median('abs(s)')})"
    return f"""
    SELECT trace_id, max(n) AS n, max(si) AS si, max(mb) AS mb, max(mc) AS mc, {half} AS end_thr,
           greatest(0.1, 3 * {d.median('abs(s)', 'row_idx < 100')}) AS start_thr
    FROM slp GROUP BY trace_id"""


def _ends(d: Dialect) -> str:
    return f"""
    SELECT b.trace_id, max(b.n) AS n, max(b.si) AS si, max(b.mc) AS mc,
           CASE WHEN max(b.n) < 10 THEN 0
                ELSE coalesce(min(CASE WHEN s.row_idx >= b.mb AND s.tm > b.start_thr THEN s.row_idx END) - max(b.mb), least({d.floor('max(b.n) / 4')}, 100)) END AS ambient_end,
           CASE WHEN max(b.n) < 10 THEN max(b.n) - 1
                ELSE coalesce(least(max(CASE WHEN s.row_idx > b.mb AND s.tm > b.end_thr THEN s.row_idx END) + max(b.mb), max(b.n) - 1), max(b.n) - 1) END AS process_end
    FROM slp s JOIN bth b ON b.trace_id = s.trace_id GROUP BY b.trace_id"""


def _ambient(d: Dialect) -> str:
    return f"""
    SELECT m.trace_id, max(m.drift) AS drift, greatest(0.01, {d.median('abs(s.s - m.drift)')}) AS amb_mad, max(m.ambient_c) AS ambient_c
    FROM (SELECT s.trace_id, max(greatest(1, e.ambient_end)) AS rows_, {d.median('s.s')} AS drift, {d.median('s.x')} AS ambient_c
          FROM slp s JOIN bnd0 e ON e.trace_id = s.trace_id WHERE s.row_idx < greatest(1, e.ambient_end) GROUP BY s.trace_id) m
    JOIN slp s ON s.trace_id = m.trace_id AND s.row_idx < m.rows_ GROUP BY m.trace_id"""


def _cusum_steps(d: Dialect) -> str:
    bound = "CASE WHEN r.slope_noise > 0 THEN greatest(2 * r.slope_noise, least(10 * r.slope_noise, 5 * a.amb_mad)) ELSE greatest(0.1, least(5.0, 5 * a.amb_mad)) END"
    return f"""
    SELECT s.trace_id, s.row_idx, s.n, s.mc, abs(s.s) - abs(a.drift) AS step, {bound} AS thr
    FROM slp s JOIN amb a ON a.trace_id = s.trace_id JOIN rep r ON r.trace_id = s.trace_id"""


def _boundaries(d: Dialect) -> str:
    return f"""
    SELECT trace_id, n, si, ambient_end, ambient_c, process_start, process_end, recovery_start, coalesce(recovery_start, process_end) AS usable_end,
           concat_ws(',', CASE WHEN process_start > 0 AND before_max > 0.5 THEN '0' END,
                     CASE WHEN process_end < n - 1 AND after_max > 0.5 THEN CAST(process_end AS STRING) END) AS partial_edges
    FROM (SELECT e.trace_id, max(e.n) AS n, max(e.si) AS si, max(e.ambient_end) AS ambient_end, max(a.ambient_c) AS ambient_c, max(c.process_start) AS process_start, max(e.process_end) AS process_end,
                 CASE WHEN max(e.process_end) < max(e.n) - 10 AND {d.median('abs(s.s)', 's.row_idx >= e.process_end')} < 0.1 THEN max(e.process_end) END AS recovery_start,
                 max(CASE WHEN s.row_idx < c.process_start THEN abs(s.s) END) AS before_max, max(CASE WHEN s.row_idx >= e.process_end THEN abs(s.s) END) AS after_max
          FROM slp s JOIN bnd0 e ON e.trace_id = s.trace_id JOIN cus c ON c.trace_id = s.trace_id JOIN amb a ON a.trace_id = s.trace_id GROUP BY e.trace_id) q"""


def _plateaus(d: Dialect) -> str:
    return f"""
    SELECT trace_id, level, max_by(t, row_idx) - min_by(t, row_idx) AS held, max(least_held) AS least_held
    FROM (SELECT *, sum(CASE WHEN level = before THEN 0 ELSE 1 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
          FROM (SELECT *, lag(level) OVER ({W}) AS before
                FROM (SELECT s.trace_id, s.row_idx, s.t, round(s.sp, 1) AS level, {d.clamp('min_region', '10 * b.si')} AS least_held
                      FROM slp s JOIN bnd b ON b.trace_id = s.trace_id WHERE s.sp IS NOT NULL AND s.row_idx BETWEEN b.process_start AND b.usable_end) q) q) q
    GROUP BY trace_id, level, run"""


def _setpoints(d: Dialect) -> str:
    return f"""
    SELECT b.trace_id, CASE WHEN a.hot IS NOT NULL THEN 'MODE_A' ELSE 'MODE_B' END AS mode, b.ambient_c,
           coalesce(a.hot, CASE WHEN m.hot - m.cold > greatest(0.5, 0.1 * m.span) THEN m.hot ELSE m.middle END, b.ambient_c) AS hot,
           coalesce(a.cold, CASE WHEN m.hot - m.cold > greatest(0.5, 0.1 * m.span) THEN m.cold ELSE m.middle END, b.ambient_c) AS cold
    FROM bnd b
    LEFT JOIN (SELECT trace_id, coalesce(max(CASE WHEN held >= least_held THEN level END), max(level)) AS hot,
                      coalesce(min(CASE WHEN held >= least_held THEN level END), min(level)) AS cold FROM plt GROUP BY trace_id) a ON a.trace_id = b.trace_id
    LEFT JOIN (SELECT q.trace_id, {d.median('q.x', 'q.x > p.split')} AS hot, {d.median('q.x', 'q.x <= p.split')} AS cold, {d.median('q.x')} AS middle, max(p.span) AS span
               FROM stb q JOIN (SELECT trace_id, ({d.quantile('x', 0.05)} + {d.quantile('x', 0.95)}) / 2 AS split, {d.quantile('x', 0.95)} - {d.quantile('x', 0.05)} AS span
                                FROM stb GROUP BY trace_id) p ON p.trace_id = q.trace_id GROUP BY q.trace_id) m ON m.trace_id = b.trace_id"""


def _stable(d: Dialect) -> str:
    return "SELECT s.trace_id, s.row_idx, s.x FROM slp s JOIN bnd b ON b.trace_id = s.trace_id WHERE s.dir = 'STABLE' AND s.row_idx BETWEEN b.process_start AND b.usable_end"


def _constants(d: Dialect) -> str:
    return f"""
    SELECT *, stable_variance * 1.5 AS ramp_deviation, stable_variance * 2.0 AS dwell_deviation
    FROM (SELECT trace_id, noise, slope_noise, {d.clamp('stable_slope', 'slope_noise * 3')} AS stable_slope, {d.clamp('stable_variance', 'noise * 2')} AS stable_variance,
                 {d.clamp('ramp_slope', 'CASE WHEN length_s > 0 AND hot > cold THEN (hot - cold) / (length_s / 60) * 0.15 ELSE 1.0 END')} AS ramp_slope,
                 {d.clamp('overshoot', 'noise * 4')} AS overshoot, {d.clamp('correction', 'noise * 2')} AS correction,
                 {d.clamp('cluster', 'CASE WHEN hot > cold THEN (hot - cold) * 0.1 ELSE 5.0 END')} AS cluster_c, {d.clamp('min_region', 'si * 10')} AS min_region
          FROM (SELECT r.trace_id, r.si, {d.clamp('noise', 'r.noise_floor')} AS noise, {d.clamp('slope_noise', d.clamp('noise', 'r.noise_floor') + ' / r.si * 120')} AS slope_noise,
                       (b.process_end - b.process_start) * r.si AS length_s, p.hot, p.cold
                FROM rep r JOIN bnd b ON b.trace_id = r.trace_id JOIN spt p ON p.trace_id = r.trace_id) q) q"""


def _tolerance(d: Dialect) -> str:
    # an explicit tolerance of the profile wins over the derived one
    explicit = {"ramp_deviation": d.profile.ramp_deviation, "dwell_setpoint_deviation": d.profile.dwell_deviation}
    derived = {"ramp_deviation": "ramp_deviation", "dwell_setpoint_deviation": "dwell_deviation"}
    return " UNION ALL ".join(
        f"SELECT trace_id, '{name}' AS parameter_name, {derived[name] if value is None else d.number(value)} AS tolerance_c, '{'ADAPTIVE_DERIVED' if value is None else 'EXPLICIT_PROFILE'}' AS tolerance_source FROM adc"
        for name, value in explicit.items()
    )


def _runs(d: Dialect) -> str:
    return f"""
    SELECT trace_id, row_idx, t, x, sp, s, si, d0, sum(CASE WHEN d0 = before THEN 0 ELSE 1 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_no
    FROM (SELECT *, lag(d0) OVER ({W}) AS before FROM (SELECT *, coalesce({d.last_known('dir', W)}, 'STABLE') AS d0 FROM slp) q) q"""


def _region_runs(d: Dialect) -> str:
    return """
    SELECT trace_id, run_no, max(d0) AS d0, min(row_idx) AS start_row, max(row_idx) AS end_row, max_by(t, row_idx) - min_by(t, row_idx) AS duration
    FROM run GROUP BY trace_id, run_no"""


def _merged(d: Dialect) -> str:
    over = "PARTITION BY trace_id ORDER BY run_no"
    return f"""
    SELECT trace_id, run_no, d1, sum(CASE WHEN d1 = before THEN 0 ELSE 1 END) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS region_no
    FROM (SELECT *, lag(d1) OVER ({over}) AS before
          FROM (SELECT q.*, coalesce({d.last_known('CASE WHEN long_ THEN d0 END', over)}, d0) AS d1
                FROM (SELECT r.trace_id, r.run_no, r.d0, r.duration >= c.min_region AS long_ FROM rrn r JOIN adc c ON c.trace_id = r.trace_id) q) q) q"""


def _region_rows(d: Dialect) -> str:
    return """
    SELECT r.trace_id, m.region_no, m.d1, r.row_idx, r.t, r.x, r.s, r.si, r.d0
    FROM run r JOIN mrg m ON m.trace_id = r.trace_id AND m.run_no = r.run_no"""


def _regions(d: Dialect) -> str:
    near = "greatest(c.cluster_c, 5.0)"
    label = f"""CASE WHEN q.d1 = 'HEATING' THEN 'HEATING_RAMP' WHEN q.d1 = 'COOLING' THEN 'COOLING_RAMP' WHEN q.end_row <= b.process_start THEN 'AMBIENT_START'
        WHEN q.start_row > b.usable_end THEN 'RECOVERY' WHEN abs(q.mean_x - p.hot) <= abs(q.mean_x - p.cold) AND abs(q.mean_x - p.hot) <= {near} THEN 'HOT_DWELL'
        WHEN abs(q.mean_x - p.cold) <= {near} THEN 'COLD_DWELL' WHEN q.duration < 2 * c.min_region THEN 'TRANSIENT' ELSE 'UNKNOWN' END"""
    return f"""
    SELECT *, 'R' || lpad(CAST(region_no AS STRING), 4, '0') AS region_id,
           CASE label WHEN 'HOT_DWELL' THEN hot WHEN 'COLD_DWELL' THEN cold WHEN 'AMBIENT_START' THEN ambient_c END AS target
    FROM (SELECT q.*, {label} AS label, p.hot, p.cold, p.ambient_c
          FROM (SELECT trace_id, region_no, max(d1) AS d1, min(row_idx) AS start_row, max(row_idx) AS end_row, count(*) AS n_rows, min_by(t, row_idx) AS start_t,
                       max_by(t, row_idx) AS end_t, max_by(t, row_idx) - min_by(t, row_idx) AS duration, avg(x) AS mean_x, stddev_pop(x) AS std_x, min(x) AS min_x, max(x) AS max_x
                FROM rgr GROUP BY trace_id, region_no) q
          JOIN bnd b ON b.trace_id = q.trace_id JOIN spt p ON p.trace_id = q.trace_id JOIN adc c ON c.trace_id = q.trace_id) q"""


def _evidence(d: Dialect) -> str:
    """Weighted evidence of each region for each kind of region; every feature is a number from 0 to 1.

    Of a ramp's 15 weighted features all but one are there (gaps inside a region count for nothing, weight 0.01); rising and
    falling exclude each other, so a ramp reaches 0.84 at most.
    """
    unit = lambda e: f"greatest(0.0, least(1.0, {e}))"
    share = lambda condition: f"avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)"
    dwell = lambda label: f"CASE WHEN {label} IN ('HOT_DWELL', 'COLD_DWELL', 'AMBIENT_START') THEN 1.0 ELSE 0.0 END"
    over = "PARTITION BY g.trace_id ORDER BY g.region_no"
    names = "ramp dwell overshoot correction transient unknown".split()
    scores = [f"{n}_score" for n in names]
    others = lambda own: ", ".join(x for x in scores if x != own)
    second = " ".join(f"WHEN {x} = best THEN greatest({others(x)})" for x in scores)
    return f"""
    SELECT trace_id, region_id, {', '.join(scores)}, best, best - second AS margin, best - second < 0.1 AS ambiguous,
           CASE WHEN best >= 0.8 THEN 'HIGH' WHEN best >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
    FROM (SELECT *, CASE {second} END AS second
          FROM (SELECT *, greatest({', '.join(scores)}) AS best
                FROM (SELECT *, 0.3 * (1 - long_enough) + 0.2 * (1 - steep) + 0.2 * wide + 0.15 * (1 - bounded) + 0.15 * (1 - greatest(ramp_score, dwell_score)) AS transient_score,
                             0.3 * (1 - greatest(ramp_score, dwell_score)) + 0.3 * (1 - abs(ramp_score - dwell_score)) + 0.2 * (1 - steady) * (1 - steep) + 0.2 * (1 - close_) * (1 - greatest(up, down)) AS unknown_score
                      FROM (SELECT *, 0.15 * up + 0.15 * down + 0.1 * leaves + 0.1 * arrives + 0.1 * one_way + 0.08 * steep + 0.05 * calm_end + 0.05 * steady + 0.07 * long_enough + 0.03 * (1 - back)
                                      + 0.04 * bounded + 0.03 * greatest(up, down) + 0.02 * arrives * next_long + 0.02 * leaves * before_long AS ramp_score,
                                   0.2 * steady + 0.2 * close_ + 0.15 * long_enough + 0.15 * in_band + 0.1 * (1 - wide) + 0.1 * clustered + 0.05 * bounded + 0.05 * still AS dwell_score,
                                   CASE WHEN off <= 0 THEN 0.0 ELSE 0.25 * {unit('off / 5')} + 0.15 + 0.15 * returns + 0.1 * long_enough + 0.1 * bounded + 0.15 * wavers + 0.1 * (1 - {unit('settling_s / 300')}) END AS overshoot_score,
                                   CASE WHEN off <= 0 THEN 0.0 ELSE 0.2 * returns + 0.2 * wavers + 0.15 * steady + 0.15 * (1 - {unit('settling_s / 300')}) + 0.15 * bounded + 0.15 * long_enough END AS correction_score
                            FROM (SELECT q.*, n.leaves, n.arrives, n.before_long, n.next_long, (n.leaves + n.arrives) / 2 AS bounded, coalesce(w.overshoot, 0.0) AS off, coalesce(w.settling_s, 0.0) AS settling_s,
                                         {unit('coalesce(w.oscillations, 0) / 3.0')} AS wavers, CASE WHEN w.in_band_s > 0 THEN 1.0 ELSE 0.0 END AS returns, 1 - {unit('coalesce(n.next_overshoot, 0.0) / 5')} AS calm_end
                                  FROM (SELECT g.trace_id, g.region_no, max(g.region_id) AS region_id, {unit('max(g.duration) / 60')} AS long_enough, {unit('1 - max(g.std_x) / 3')} AS steady, {unit('(max(g.max_x) - min(g.min_x)) / 12')} AS wide,
                                               coalesce({unit('1 - max(abs(g.mean_x - g.target)) / 5')}, 0.0) AS close_, CASE WHEN max(g.target) IS NOT NULL THEN 1.0 ELSE 0.0 END AS clustered,
                                               coalesce(avg(CASE WHEN abs(r.x - g.target) <= {BAND_C} THEN 1.0 ELSE 0.0 END), 0.0) AS in_band, {share("r.d0 = 'STABLE'")} AS still,
                                               {share('r.s > 0.1')} AS up, {share('r.s < -0.1')} AS down, greatest({share('r.s > 0')}, {share('r.s < 0')}) AS one_way, least({share('r.s > 0.1')}, {share('r.s < -0.1')}) AS back, {unit('abs(avg(r.s)) / 5')} AS steep
                                        FROM reg g JOIN rgr r ON r.trace_id = g.trace_id AND r.region_no = g.region_no GROUP BY g.trace_id, g.region_no) q
                                  JOIN (SELECT g.trace_id, g.region_no, {dwell(f"lag(g.label) OVER ({over})")} AS leaves,
                                               {dwell(f"lead(g.label) OVER ({over})")} AS arrives,
                                               coalesce({unit(f"lag(g.duration) OVER ({over}) / 60")}, 0.0) AS before_long,
                                               coalesce({unit(f"lead(g.duration) OVER ({over}) / 60")}, 0.0) AS next_long,
                                               lead(m.overshoot) OVER ({over}) AS next_overshoot
                                        FROM reg g LEFT JOIN dwm m ON m.trace_id = g.trace_id AND m.region_no = g.region_no) n ON n.trace_id = q.trace_id AND n.region_no = q.region_no
                                  LEFT JOIN dwm w ON w.trace_id = q.trace_id AND w.region_no = q.region_no) q) q) q) q) q"""


def _ramp_rows(d: Dialect) -> str:
    return f"""
    SELECT r.trace_id, r.region_no, g.region_id, r.row_idx, r.t, r.x, r.s, r.si, CASE WHEN g.label = 'HEATING_RAMP' THEN 1 ELSE -1 END AS sign_, p.noise_floor, p.slope_noise,
           g.start_row, g.end_row
    FROM rgr r JOIN reg g ON g.trace_id = r.trace_id AND g.region_no = r.region_no JOIN rep p ON p.trace_id = r.trace_id
    WHERE g.label IN ('HEATING_RAMP', 'COOLING_RAMP') AND g.n_rows >= 3 AND g.duration >= {RAMP_SECONDS}"""


def _envelope(d: Dialect) -> str:
    return """
    SELECT q.trace_id, q.region_no, max(q.region_id) AS region_id, max(q.first_) AS env_start, max(q.last_) AS env_end,
           CASE WHEN max(q.peak) < max(q.last_) AND max(q.sign_ * (q.peak_x - q.last_x)) > 3 * max(q.noise_floor) THEN max(q.peak) ELSE max(q.last_) END AS env_stop
    FROM (SELECT e.trace_id, e.region_no, max(e.region_id) AS region_id, max(e.first_) AS first_, max(e.last_) AS last_, max(r.sign_) AS sign_, max(r.noise_floor) AS noise_floor,
                 min(CASE WHEN r.sign_ * r.x = e.top THEN r.row_idx END) AS peak, max(e.top * r.sign_) AS peak_x, max(CASE WHEN r.row_idx = e.last_ THEN r.x END) AS last_x
          FROM (SELECT f.trace_id, f.region_no, max(f.region_id) AS region_id, max(f.first_) AS first_, max(f.last_) AS last_, max(r.sign_ * r.x) AS top
                FROM (SELECT trace_id, region_no, max(region_id) AS region_id, coalesce(min(CASE WHEN sign_ * s > slope_noise THEN row_idx END), max(start_row)) AS first_,
                             coalesce(max(CASE WHEN sign_ * s > slope_noise THEN row_idx END), max(end_row)) AS last_ FROM rmr GROUP BY trace_id, region_no) f
                JOIN rmr r ON r.trace_id = f.trace_id AND r.region_no = f.region_no AND r.row_idx BETWEEN f.first_ AND f.last_ GROUP BY f.trace_id, f.region_no) e
          JOIN rmr r ON r.trace_id = e.trace_id AND r.region_no = e.region_no AND r.row_idx BETWEEN e.first_ AND e.last_ GROUP BY e.trace_id, e.region_no) q
    GROUP BY q.trace_id, q.region_no"""


def _valid_rows(d: Dialect) -> str:
    over = "PARTITION BY r.trace_id, r.region_no ORDER BY r.row_idx"
    return f"""
    SELECT r.trace_id, r.region_no, r.region_id, r.row_idx, r.t, r.x, r.s, r.si, r.sign_, r.noise_floor, r.slope_noise, r.start_row, r.end_row, e.env_start, e.env_stop,
           row_number() OVER ({over}) - 1 AS i, count(*) OVER (PARTITION BY r.trace_id, r.region_no) AS m,
           lead(r.t) OVER ({over}) - r.t AS dt, lag(r.s) OVER ({over}) AS s_before
    FROM rmr r JOIN env e ON e.trace_id = r.trace_id AND e.region_no = r.region_no AND r.row_idx BETWEEN e.env_start AND e.env_stop"""


def _valid_ramps(d: Dialect) -> str:
    return f"""
    SELECT * FROM (
      SELECT trace_id, region_no, max(region_id) AS region_id, CASE WHEN max(sign_) > 0 THEN 'HEATING' ELSE 'COOLING' END AS direction, max(env_start) AS env_start, max(env_stop) AS env_stop,
             count(*) AS n_rows, max_by(t, row_idx) - min_by(t, row_idx) AS duration, avg(CASE WHEN sign_ * s > 0 THEN 1.0 ELSE 0.0 END) AS monotonicity,
             coalesce(sum(CASE WHEN abs(s) < slope_noise THEN dt END), 0.0) AS stall_s,
             sum(CASE WHEN sign_ * s < -noise_floor * {REVERSAL} AND sign_ * s_before > noise_floor * {REVERSAL} THEN 1 ELSE 0 END) AS reversals,
             max(end_row) - max(start_row) + 1 - count(*) AS excluded_rows
      FROM vrr0 GROUP BY trace_id, region_no) q
    WHERE n_rows >= 3 AND monotonicity >= {RAMP_MONOTONICITY}"""


def _valid_ramp_rows(d: Dialect) -> str:
    return "SELECT r.* FROM vrr0 r JOIN vrm v ON v.trace_id = r.trace_id AND v.region_no = r.region_no"


def _ramp_metrics(d: Dialect) -> str:
    return f"""
    SELECT q.trace_id, q.region_no, q.region_id, q.direction, q.duration, q.stall_s, q.robust, q.sustained, q.endpoint, q.median_rolling, q.slope_mad,
           CASE WHEN abs(q.robust) < 0.01 THEN 1.0 ELSE least(1.0, q.slope_mad / abs(q.robust)) END AS jitter,
           CASE WHEN q.n_rows < 4 OR abs(q.first_half) < 0.01 THEN 0.0 ELSE (q.first_half - q.second_half) / abs(q.first_half) END AS taper,
           CASE WHEN q.ss_tot < 1e-10 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - q.ss_res / q.ss_tot)) END AS linearity
    FROM (SELECT v.trace_id, v.region_no, max(v.region_id) AS region_id, max(v.direction) AS direction, max(v.duration) AS duration, max(v.stall_s) AS stall_s, max(v.n_rows) AS n_rows,
                 max(k.robust) AS robust, max(k.sustained) AS sustained, max(k.endpoint) AS endpoint, max(m.med_s) AS median_rolling, {d.median('abs(r.s - m.med_s)')} AS slope_mad,
                 max(m.first_half) AS first_half, max(m.second_half) AS second_half,
                 sum((r.x - (m.x0 + k.robust / 60 * (r.t - m.t0))) * (r.x - (m.x0 + k.robust / 60 * (r.t - m.t0)))) AS ss_res, sum((r.x - m.mean_x) * (r.x - m.mean_x)) AS ss_tot
          FROM vrr r JOIN vrm v ON v.trace_id = r.trace_id AND v.region_no = r.region_no JOIN slopes k ON k.trace_id = r.trace_id AND k.region_no = r.region_no
          JOIN (SELECT trace_id, region_no, {d.median('s')} AS med_s, {d.median('s', 'i < floor(m / 2)')} AS first_half, {d.median('s', 'i >= floor(m / 2)')} AS second_half, avg(x) AS mean_x,
                       min_by(x, row_idx) AS x0, min_by(t, row_idx) AS t0 FROM vrr GROUP BY trace_id, region_no) m ON m.trace_id = r.trace_id AND m.region_no = r.region_no
          GROUP BY v.trace_id, v.region_no) q"""


def _dwell_rows(d: Dialect) -> str:
    over = "PARTITION BY r.trace_id, r.region_no ORDER BY r.row_idx"
    return f"""
    SELECT r.trace_id, r.region_no, g.region_id, g.label, g.duration, g.target, r.row_idx, r.t, r.x, r.x - g.target AS off, g.start_t, lag(r.x - g.target) OVER ({over}) AS off_before,
           lead(r.t) OVER ({over}) - r.t AS dt, r.t - lag(r.t) OVER ({over}) AS dt_before
    FROM rgr r JOIN reg g ON g.trace_id = r.trace_id AND g.region_no = r.region_no
    WHERE g.label IN ('HOT_DWELL', 'COLD_DWELL', 'AMBIENT_START') AND g.n_rows >= 2"""


def _dwell_metrics(d: Dialect) -> str:
    beyond = f"CASE WHEN label = 'HOT_DWELL' THEN off > {SETTLING_C} WHEN label = 'COLD_DWELL' THEN off < -{SETTLING_C} ELSE false END"
    return f"""
    SELECT *, CASE WHEN duration > 0 THEN in_band_s / duration * 100 ELSE 0.0 END AS in_band_pct,
           ((1 - least(1.0, std_x / 3)) + (1 - least(1.0, range_x / 12))) / 2 AS stability
    FROM (SELECT trace_id, region_no, max(region_id) AS region_id, max(label) AS label, max(target) AS target, max(duration) AS duration, avg(x) AS mean_x, stddev_pop(x) AS std_x, max(x) - min(x) AS range_x,
                 CASE WHEN max(target) = 0 THEN 0.0 ELSE abs(avg(x) - max(target)) END AS deviation,
                 coalesce(sum(CASE WHEN abs(off) <= {BAND_C} THEN coalesce(dt, dt_before) END), 0.0) AS in_band_s,
                 CASE max(label) WHEN 'HOT_DWELL' THEN greatest(0.0, max(off)) WHEN 'COLD_DWELL' THEN greatest(0.0, -min(off)) ELSE 0.0 END AS overshoot,
                 coalesce(sum(CASE WHEN {beyond} THEN dt END), 0.0) AS overshoot_s,
                 CASE WHEN max(label) = 'AMBIENT_START' THEN 0.0 ELSE coalesce(min(CASE WHEN abs(off) <= {SETTLING_C} THEN t - start_t END), 0.0) END AS settling_s,
                 {d.floor('sum(CASE WHEN off * off_before < 0 THEN 1 ELSE 0 END) / 2')} AS oscillations
          FROM dwr GROUP BY trace_id, region_no) q"""


def _cycle_bounds(d: Dialect) -> str:
    over = "PARTITION BY trace_id ORDER BY region_no"
    return f"""
    SELECT a.trace_id, a.cycle_no, a.first_region, coalesce(min(b.region_no), max(z.last_region)) AS last_region
    FROM (SELECT trace_id, region_no AS first_region, row_number() OVER ({over}) AS cycle_no FROM dws WHERE label = 'HOT_DWELL' AND (before IS NULL OR before = 'COLD_DWELL')) a
    JOIN (SELECT trace_id, max(region_no) AS last_region FROM reg GROUP BY trace_id) z ON z.trace_id = a.trace_id
    LEFT JOIN (SELECT trace_id, region_no FROM dws WHERE label = 'COLD_DWELL' AND before = 'HOT_DWELL') b ON b.trace_id = a.trace_id AND b.region_no > a.first_region
    GROUP BY a.trace_id, a.cycle_no, a.first_region
    UNION ALL
    SELECT z.trace_id, 1, min(z.region_no), max(z.region_no) FROM reg z
    LEFT JOIN (SELECT trace_id FROM dws WHERE label = 'HOT_DWELL' GROUP BY trace_id) h ON h.trace_id = z.trace_id WHERE h.trace_id IS NULL GROUP BY z.trace_id"""


def _dwell_order(d: Dialect) -> str:
    return "SELECT trace_id, region_no, label, lag(label) OVER (PARTITION BY trace_id ORDER BY region_no) AS before FROM reg WHERE label IN ('HOT_DWELL', 'COLD_DWELL')"


def _cycles(d: Dialect) -> str:
    has = lambda label: f"sum(CASE WHEN g.label = '{label}' THEN 1 ELSE 0 END)"
    return f"""
    SELECT *, (duration - before) / CASE WHEN before > 0 THEN before END AS drift
    FROM (SELECT *, lag(duration) OVER (PARTITION BY trace_id ORDER BY cycle_no) AS before,
                 'C' || lpad(CAST(cycle_no AS STRING), 4, '0') AS cycle_id,
                 CASE WHEN heat > 0 AND cool > 0 AND hot + cold > 0 THEN 'COMPLETE' WHEN heat > 0 AND hot > 0 THEN 'PARTIAL' WHEN cool > 0 AND cold > 0 THEN 'PARTIAL'
                      WHEN heat + cool > 0 THEN 'PARTIAL' ELSE 'INVALID' END AS status
          FROM (SELECT c.trace_id, c.cycle_no, max(c.first_region) AS first_region, max(c.last_region) AS last_region, count(*) AS n_regions, max_by(g.end_t, g.region_no) - min_by(g.start_t, g.region_no) AS duration,
                       {has('HEATING_RAMP')} AS heat, {has('COOLING_RAMP')} AS cool, {has('HOT_DWELL')} AS hot, {has('COLD_DWELL')} AS cold, min(g.start_row) AS start_row, max(g.end_row) AS end_row,
                       sum(CASE WHEN g.label IN ('HOT_DWELL', 'COLD_DWELL') THEN g.duration ELSE 0.0 END) AS dwell_s
                FROM cyb c JOIN reg g ON g.trace_id = c.trace_id AND g.region_no BETWEEN c.first_region AND c.last_region GROUP BY c.trace_id, c.cycle_no) q
          WHERE n_regions >= 2) q"""


def _cycle_metrics(d: Dialect, own: bool = False) -> str:
    keys = "r.trace_id, c.cycle_no" if own else "r.trace_id"
    join = "JOIN cyc c ON c.trace_id = r.trace_id AND r.region_no BETWEEN c.first_region AND c.last_region" if own else ""
    match = " AND {0}.cycle_no = c.cycle_no" if own else ""
    return f"""
    SELECT c.trace_id, c.cycle_no, c.cycle_id, c.duration, coalesce(a.heat_avg, 0.0) AS heat_avg, coalesce(a.heat_min, 0.0) AS heat_min, coalesce(a.cool_avg, 0.0) AS cool_avg, coalesce(a.cool_max, 0.0) AS cool_max,
           coalesce(a.jitter, 0.0) AS jitter, coalesce(a.taper, 0.0) AS taper, coalesce(w.stability, 0.0) AS stability, coalesce(w.overshoot, 0.0) AS overshoot,
           coalesce(o.ramp_s, 0.0) AS ramp_s, c.dwell_s
    FROM cyc c
    LEFT JOIN (SELECT {keys}, avg(CASE WHEN r.robust > 0 THEN r.robust END) AS heat_avg, min(CASE WHEN r.robust > 0 THEN r.robust END) AS heat_min, avg(CASE WHEN r.robust < 0 THEN r.robust END) AS cool_avg,
                      max(CASE WHEN r.robust < 0 THEN r.robust END) AS cool_max, avg(r.jitter) AS jitter, avg(r.taper) AS taper FROM rmm r {join} GROUP BY {keys}) a ON a.trace_id = c.trace_id{match.format('a')}
    LEFT JOIN (SELECT {keys}, avg(r.stability) AS stability, max(r.overshoot) AS overshoot FROM dwm r {join} GROUP BY {keys}) w ON w.trace_id = c.trace_id{match.format('w')}
    LEFT JOIN (SELECT c.trace_id, c.cycle_no, sum(v.duration) AS ramp_s FROM cyc c JOIN vrm v ON v.trace_id = c.trace_id AND v.region_no BETWEEN c.first_region AND c.last_region
               GROUP BY c.trace_id, c.cycle_no) o ON o.trace_id = c.trace_id AND o.cycle_no = c.cycle_no"""


def _results(d: Dialect) -> str:
    # traces whose quality blocks a decision have no results
    p, least = d.profile, lambda side: f"CASE WHEN m.direction = 'HEATING' THEN {d.number(d.profile.heating_rate * side)} ELSE {d.number(d.profile.cooling_rate * side)} END"
    rate, kept = (f"CASE WHEN m.direction = 'HEATING' THEN m.{c} ELSE abs(m.{c}) END" for c in ("robust", "sustained"))
    return f"""
    SELECT q.trace_id, q.region_id, q.requirement, q.measured, q.required, q.status
    FROM (SELECT m.trace_id, m.region_id, 'RAMP_RATE_' || m.direction AS requirement, {rate} AS measured, {least(1.0)} AS required,
                 CASE WHEN {rate} < {least(1.0)} THEN 'FAIL' WHEN {kept} >= {least(p.sustained_ratio)} THEN 'PASS' ELSE 'PASS_WITH_WARNINGS' END AS status FROM rmm m
          UNION ALL
          SELECT w.trace_id, w.region_id, 'DWELL_DURATION', w.duration, q.med, CASE WHEN abs(w.duration - q.med) <= {d.number(p.duration_sigmas)} * q.sd THEN 'PASS' ELSE 'FAIL' END
          FROM dwm w JOIN (SELECT trace_id, {d.median('duration')} AS med, stddev_pop(duration) AS sd FROM reg WHERE label IN ('HOT_DWELL', 'COLD_DWELL') GROUP BY trace_id) q ON q.trace_id = w.trace_id
          WHERE w.label <> 'AMBIENT_START'
          UNION ALL
          SELECT w.trace_id, w.region_id, 'SETPOINT_DEVIATION', w.deviation, t.tolerance_c, CASE WHEN w.deviation <= t.tolerance_c THEN 'PASS' ELSE 'FAIL' END
          FROM dwm w JOIN tol t ON t.trace_id = w.trace_id AND t.parameter_name = 'dwell_setpoint_deviation' WHERE w.label <> 'AMBIENT_START') q
    JOIN gate g ON g.trace_id = q.trace_id WHERE NOT g.blocked AND NOT g.blocks_pass_fail"""


def _phases(d: Dialect) -> str:
    return """
    SELECT trace_id, region_id, max(CASE status WHEN 'FAIL' THEN 4 WHEN 'INCONCLUSIVE' THEN 3 WHEN 'PASS_WITH_WARNINGS' THEN 2 WHEN 'PASS' THEN 1 END) AS worst
    FROM res WHERE status <> 'NOT_APPLICABLE' GROUP BY trace_id, region_id"""


def _overall(d: Dialect) -> str:
    pct = "CASE WHEN coalesce(p.phases, 0) > 0 THEN p.passed * 1e2 / p.phases ELSE 0.0 END"
    return f"""
    SELECT g.trace_id, coalesce(p.phases, 0) AS phases, coalesce(p.passed, 0) AS passed, coalesce(p.failed, 0) AS failed, coalesce(p.anomalies, 0) AS anomalies, {pct} AS conformance_pct,
           CASE WHEN g.blocked OR g.blocks_pass_fail THEN 'INCONCLUSIVE' WHEN {pct} >= {d.number(d.profile.conformance_pct)} THEN 'PASS' ELSE 'FAIL' END AS status
    FROM gate g
    LEFT JOIN (SELECT trace_id, count(*) AS phases, sum(CASE WHEN worst <= 2 THEN 1 ELSE 0 END) AS passed, sum(CASE WHEN worst = 4 THEN 1 ELSE 0 END) AS failed,
                      sum(CASE WHEN worst >= 2 THEN 1 ELSE 0 END) AS anomalies FROM phs GROUP BY trace_id) p ON p.trace_id = g.trace_id"""


def _sustained(d: Dialect) -> str:
    least = f"CASE WHEN direction = 'HEATING' THEN {d.number(d.profile.heating_rate * d.profile.sustained_ratio)} ELSE {d.number(d.profile.cooling_rate * d.profile.sustained_ratio)} END"
    return f"SELECT trace_id, region_id, abs(sustained) >= {least} AS sustained_ok FROM rmm"


def _dwell_limits(d: Dialect) -> str:
    return f"""
    SELECT trace_id, region_id, overshoot, overshoot <= {d.number(d.profile.overshoot_c)} AS overshoot_within, settling_s, settling_s <= {d.number(d.profile.settling_s)} AS settling_within
    FROM dwm WHERE label <> 'AMBIENT_START'"""


def _cycle_count(d: Dialect) -> str:
    most = "true" if d.profile.most_cycles is None else f"coalesce(c.complete, 0) <= {d.profile.most_cycles}"
    return f"""
    SELECT g.trace_id, coalesce(c.complete, 0) AS complete_cycles, coalesce(c.complete, 0) >= {d.profile.least_cycles} AND {most} AS enough
    FROM gate g LEFT JOIN (SELECT trace_id, sum(CASE WHEN status = 'COMPLETE' THEN 1 ELSE 0 END) AS complete FROM cyc GROUP BY trace_id) c ON c.trace_id = g.trace_id"""


def _distribution(d: Dialect) -> str:
    parts = [
        ("ramp_shape", "rmm", "robust", "robust <> 0"), ("ramp_duration", "rmm", "stall_s", ""), ("robust_rate", "rmm", "robust", "robust <> 0"),
        ("dwell_duration", "reg", "duration", "label IN ('HOT_DWELL', 'COLD_DWELL')"), ("dwell_median", "dwm", "mean_x", ""), ("overshoot_magnitude", "dwm", "overshoot", ""),
        ("settling_time", "dwm", "settling_s", ""), ("cycle_duration", "cym", "duration", ""), ("jitter_score", "rmm", "jitter", ""), ("taper_score", "rmm", "taper", ""),
    ]
    return " UNION ALL ".join(
        f"SELECT trace_id, '{name}' AS metric, avg({c}) AS mean_v, stddev_pop({c}) AS std_v, min({c}) AS min_v, max({c}) AS max_v FROM {table}{' WHERE ' + where if where else ''} GROUP BY trace_id"
        for name, table, c, where in parts
    )


def _drift(d: Dialect) -> str:
    lag = lambda c: f"abs({c} - lag({c}) OVER (PARTITION BY trace_id ORDER BY cycle_no))"
    nonzero = lambda c: f"CASE WHEN lag({c}) OVER (PARTITION BY trace_id ORDER BY cycle_no) <> 0 THEN {lag(c)} END"
    return f"""
    SELECT trace_id, coalesce(avg(heating), 0.0) AS heating_slope, coalesce(avg(cooling), 0.0) AS cooling_slope, coalesce(avg(stab), 0.0) AS dwell_stability, coalesce(avg(dur), 0.0) AS cycle_duration,
           greatest(coalesce(max(heating), 0.0), coalesce(max(cooling), 0.0), coalesce(max(stab), 0.0), coalesce(max(dur), 0.0)) > {DRIFT} AS drift_detected
    FROM (SELECT trace_id, {nonzero('heat_avg')} AS heating, {nonzero('cool_avg')} AS cooling, {lag('stability')} AS stab, {lag('duration')} AS dur FROM cym) q GROUP BY trace_id"""


def _consistency(d: Dialect) -> str:
    part = lambda c, w: f"CASE WHEN sum(CASE WHEN {w} THEN 1 ELSE 0 END) > 1 THEN greatest(0.0, 1 - stddev_pop(CASE WHEN {w} THEN {c} END) / avg(CASE WHEN {w} THEN {c} END)) ELSE 1.0 END"
    return f"SELECT trace_id, ({part('heat_avg', 'heat_avg <> 0')} + {part('duration', 'duration > 0')}) / 2 AS score FROM cym GROUP BY trace_id"


def _sequence(d: Dialect) -> str:
    """Expected phases found in order, each after the one before (the earliest that fits), and those not found."""
    expected = d.profile.sequence
    sql = "SELECT trace_id, CAST(-1 AS BIGINT) AS at, 0 AS found FROM reg GROUP BY trace_id"
    for place, label in enumerate(expected):
        sql = f"""SELECT q.trace_id, max(q.at) AS at0, min(CASE WHEN g.label = '{label}' AND g.region_no > q.at THEN g.region_no END) AS next_, max(q.found) AS found0
            FROM ({sql}) q JOIN reg g ON g.trace_id = q.trace_id GROUP BY q.trace_id"""
        sql = f"SELECT trace_id, coalesce(next_, at0) AS at, found0 + CASE WHEN next_ IS NOT NULL AND found0 = {place} THEN 1 ELSE 0 END AS found FROM ({sql}) q"
    arms = " ".join(f"WHEN {k} THEN '{', '.join(expected[k:])}'" for k in range(len(expected) + 1))
    return f"SELECT trace_id, found, CASE found {arms} END AS missing FROM ({sql}) q"


def _clamped(d: Dialect) -> str:
    """Each adaptive constant before and after its bounds."""
    noise = d.clamp("noise", "r.noise_floor")
    span = "p.hot > p.cold"
    derived = {
        "noise": "r.noise_floor", "slope_noise": f"{noise} / r.si * 120", "stable_slope": "c.slope_noise * 3", "stable_variance": "c.noise * 2",
        "ramp_slope": f"CASE WHEN (b.process_end - b.process_start) * r.si > 0 AND {span} THEN (p.hot - p.cold) / ((b.process_end - b.process_start) * r.si / 60) * 0.15 ELSE 1.0 END",
        "overshoot": "c.noise * 4", "correction": "c.noise * 2", "cluster": f"CASE WHEN {span} THEN (p.hot - p.cold) * 0.1 ELSE 5.0 END", "min_region": "r.si * 10",
    }
    low, high = ("CASE parameter " + " ".join(f"WHEN '{name}' THEN {d.number(BOUNDS[name][k])}" for name in derived) + " END" for k in (0, 1))
    each = " UNION ALL ".join(
        f"SELECT r.trace_id, '{name}' AS parameter, {expr} AS derived FROM rep r JOIN bnd b ON b.trace_id = r.trace_id JOIN spt p ON p.trace_id = r.trace_id JOIN adc c ON c.trace_id = r.trace_id"
        for name, expr in derived.items()
    )
    return f"""
    SELECT trace_id, parameter, derived, greatest({low}, least({high}, derived)) AS value, derived < {low} OR derived > {high} AS was_clamped FROM ({each}) q"""


def _summary(d: Dialect) -> str:
    """One row a trace: what the report says first."""
    count = lambda table, name: f"(SELECT trace_id, count(*) AS {name} FROM {table} GROUP BY trace_id)"
    return f"""
    SELECT o.trace_id, o.status, o.conformance_pct, p.hot AS hot_target_c, p.cold AS cold_target_c, r.duration / 3600 AS hours, tw.tolerance_c AS dwell_tolerance_c, tr.tolerance_c AS ramp_tolerance_c,
           coalesce(g.regions, 0) AS regions, coalesce(v.ramps, 0) AS ramps, coalesce(c.cycles, 0) AS cycles, o.anomalies,
           CASE WHEN o.status = 'INCONCLUSIVE' THEN 'Data quality blocks pass/fail' WHEN o.status = 'PASS' THEN 'Conformance reaches the threshold' ELSE 'Conformance below the threshold' END AS reason,
           CASE WHEN o.conformance_pct >= 60 THEN 'CONFORMING' ELSE 'NON-CONFORMING' END AS recommendation
    FROM ovr o JOIN rep r ON r.trace_id = o.trace_id LEFT JOIN spt p ON p.trace_id = o.trace_id
    LEFT JOIN tol tw ON tw.trace_id = o.trace_id AND tw.parameter_name = 'dwell_setpoint_deviation' LEFT JOIN tol tr ON tr.trace_id = o.trace_id AND tr.parameter_name = 'ramp_deviation'
    LEFT JOIN {count('reg', 'regions')} g ON g.trace_id = o.trace_id LEFT JOIN {count('vrm', 'ramps')} v ON v.trace_id = o.trace_id LEFT JOIN {count('cyc', 'cycles')} c ON c.trace_id = o.trace_id"""


#: The report's sections in order: title, rows they come from, and the numbers of each row (name, expression), by a name for the row.
_SECTIONS: tuple[tuple[str, str, str, tuple[tuple[str, str], ...], str], ...] = (
    ("executive_summary", "exs", "'trace'", (("conformance_pct", "conformance_pct"), ("regions", "regions"), ("ramps", "ramps"), ("cycles", "cycles"), ("anomalies", "anomalies")), "status"),
    ("input_file_summary", "rep", "'trace'", (("rows", "n"), ("sample_interval_s", "si"), ("duration_s", "duration")), "''"),
    ("data_quality_summary", "qlt", "'trace'", (("missing_pct", "missing_pct"), ("duplicate_pct", "duplicate_pct"), ("spikes", "n_spikes"), ("gaps", "n_gaps")), "status"),
    ("process_boundary_summary", "bnd", "'trace'", (("ambient_end", "ambient_end"), ("process_start", "process_start"), ("process_end", "process_end")), "''"),
    ("setpoint_inference_summary", "spt", "'trace'", (("ambient_c", "ambient_c"), ("hot_c", "hot"), ("cold_c", "cold")), "mode"),
    ("region_classification_summary", "reg", "region_id", (("minutes", "duration / 60"), ("mean_c", "mean_x")), "label"),
    ("ramp_rate_validation_summary", "res", "region_id || ' ' || requirement", (("measured", "measured"), ("required", "required")), "status"),
    ("cycle_level_summary", "cyc", "cycle_id", (("regions", "n_regions"), ("duration_s", "duration")), "status"),
    ("overshoot_correction_summary", "dwm", "region_id", (("overshoot_c", "overshoot"), ("overshoot_s", "overshoot_s")), "label"),
    ("profile_consistency_summary", "cns", "'trace'", (("consistency_score", "score"),), "''"),
    ("visualisation", "rep", "'trace'", (("chart_rows", "n"),), "''"),
    ("audit_trail", "ovr", "'trace'", (("phases", "phases"), ("passed", "passed"), ("failed", "failed")), "status"),
    ("algorithm_appendix", "adc", "'trace'", (("noise", "noise"), ("slope_noise", "slope_noise"), ("min_region_s", "min_region")), "''"),
)


def _report_sections(d: Dialect) -> str:
    """The report as rows: section, item and its number; a section without rows for a trace has a note instead."""
    parts = []
    for number, (title, table, name, values, note) in enumerate(_SECTIONS, 1):
        where = " WHERE requirement LIKE 'RAMP_RATE%'" if title == "ramp_rate_validation_summary" else " WHERE overshoot > 0" if title == "overshoot_correction_summary" else ""
        for item, expr in values:
            parts.append(f"SELECT trace_id, {number} AS section_no, '{title}' AS section, {name} || ' {item}' AS item, CAST({expr} AS DOUBLE) AS value, {note} AS note FROM {table}{where}")
        parts.append(
            f"SELECT r.trace_id, {number}, '{title}', 'none', CAST(NULL AS DOUBLE), 'Not applicable' FROM rep r LEFT JOIN (SELECT DISTINCT trace_id FROM {table}{where}) h ON h.trace_id = r.trace_id WHERE h.trace_id IS NULL"
        )
    return " UNION ALL ".join(parts)


def _chart(d: Dialect) -> str:
    """The chart's lines as rows, the measured temperature on top; without a logged setpoint the inferred ones as straight lines."""
    whole = "SELECT trace_id, max(t) AS hi, count(sp) = 0 AS bare FROM sig GROUP BY trace_id"
    ends = f"(SELECT trace_id, 0.0 AS x, bare FROM ({whole}) w UNION ALL SELECT trace_id, hi AS x, bare FROM ({whole}) w)"
    lines = " UNION ALL ".join(
        f"SELECT p.trace_id, '{name} setpoint' AS series, e.x AS x_seconds, p.{name} AS y_c, 5 AS layer FROM spt p JOIN {ends} e ON e.trace_id = p.trace_id WHERE p.mode = 'MODE_B' AND e.bare"
        for name in ("hot", "cold")
    )
    return f"""
    SELECT trace_id, 'measured' AS series, t AS x_seconds, x AS y_c, 10 AS layer FROM sig
    UNION ALL SELECT trace_id, 'setpoint', t, sp, 8 FROM sig WHERE sp IS NOT NULL
    UNION ALL SELECT trace_id, 'analysis signal', t, clean, 5 FROM sig
    UNION ALL {lines}"""


def _audit(d: Dialect) -> str:
    """What each step decided, in the order of the steps."""
    none, whole = "CAST(NULL AS DOUBLE)", "'trace'"
    steps = [
        ("trace_builder", "build_canonical_trace", whole, "'SUCCESS'", none, "n", "0", "'INFO'", "rep"),
        ("signal_processor", "preprocess_trace", whole, "'SUCCESS'", "noise_floor", "n", "n_spikes", "'INFO'", "rep"),
        ("quality_gating", "assess_data_quality", whole, "q.status", none, "0", "0", "CASE WHEN q.blocked THEN 'ERROR' WHEN q.blocks_pass_fail THEN 'WARNING' ELSE 'INFO' END", "gate q"),
        ("process_boundaries", "detect_process_boundaries", whole, "'SUCCESS'", none, "usable_end - process_start + 1", "n - (usable_end - process_start + 1)", "'INFO'", "bnd"),
        ("setpoint_inference", "resolve_setpoints", whole, "mode", none, "0", "0", "'INFO'", "spt"),
        ("region_classification", "classify_region", "region_id", "label", none, "n_rows", "0", "'INFO'", "reg"),
        ("ramp_extractor", "isolate_valid_ramp", "region_id", "direction", "monotonicity", "n_rows", "excluded_rows", "'INFO'", "vrm"),
        ("cycle_detector", "detect_cycle", "cycle_id", "status", none, "end_row - start_row + 1", "0", "'INFO'", "cyc"),
        ("tolerance_resolver", "TOLERANCE_RESOLVED", "parameter_name", "tolerance_source", "tolerance_c", "0", "0", "'INFO'", "tol"),
        ("validation_rules", "validate_requirement", "region_id || ' ' || requirement", "status", "required", "0", "0", "'INFO'", "res"),
        ("aggregation", "aggregate_validation_status", whole, "status", "conformance_pct", "0", "0", "CASE WHEN status = 'INCONCLUSIVE' THEN 'WARNING' ELSE 'INFO' END", "ovr"),
    ]
    return " UNION ALL ".join(
        f"SELECT trace_id, {k} AS step, '{module}' AS module, '{action}' AS action, {subject} AS subject, {decision} AS decision, CAST({threshold} AS DOUBLE) AS threshold, {used} AS rows_used, {left} AS rows_excluded, {severity} AS severity FROM {table}"
        for k, (module, action, subject, decision, threshold, used, left, severity, table) in enumerate(steps, 1)
    )


STAGES: dict[str, Callable[[Dialect], str]] = {
    "flg": _flags, "rep": _report, "qlt": _quality, "gate": _gate, "slp": _slope_rows, "bth": _thresholds, "bnd0": _ends, "amb": _ambient, "cst": _cusum_steps,
    "bnd": _boundaries, "plt": _plateaus, "stb": _stable, "spt": _setpoints, "adc": _constants, "tol": _tolerance, "run": _runs, "rrn": _region_runs, "mrg": _merged,
    "rgr": _region_rows, "reg": _regions, "evd": _evidence, "rmr": _ramp_rows, "env": _envelope, "vrr0": _valid_rows, "vrm": _valid_ramps, "vrr": _valid_ramp_rows,
    "rmm": _ramp_metrics, "dwr": _dwell_rows, "dwm": _dwell_metrics, "dws": _dwell_order, "cyb": _cycle_bounds, "cyc": _cycles, "cym": _cycle_metrics,
    "cyo": lambda d: _cycle_metrics(d, own=True), "res": _results, "phs": _phases, "ovr": _overall, "cyn": _cycle_count, "sus": _sustained, "acl": _clamped, "exs": _summary, "sec": _report_sections, "crt": _chart, "aud": _audit, "dwl": _dwell_limits, "dst": _distribution, "seq": _sequence, "drf": _drift, "cns": _consistency,
}

_FRAME = "ROWS BETWEEN half PRECEDING AND half FOLLOWING"
#: Stages that depend on the profile.
PROFILED = frozenset("tol res phs ovr cyn seq sus dwl exs sec aud".split())
#: What operators make on Spark, as SQL for DuckDB.
DUCK_SOURCES = {
    "can": """
    SELECT trace_id, row_idx, ts, t, t / 60 AS elapsed_minutes, x, sp, missing
    FROM (SELECT trace_id, row_idx, ts, (epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY trace_id ORDER BY row_idx)) / 1e6 AS t,
                 CASE WHEN isfinite(temperature_c_raw) THEN temperature_c_raw ELSE 0.0 END AS x, CASE WHEN isfinite(setpoint_c) THEN setpoint_c END AS sp,
                 temperature_c_raw IS NULL OR NOT isfinite(temperature_c_raw) AS missing
          FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, row_idx ORDER BY ingested_at) AS nth FROM trace_rows WHERE trace_id IS NOT NULL AND row_idx IS NOT NULL AND ts IS NOT NULL) q WHERE nth = 1) q""",
    "par": """
    SELECT trace_id, n, si, CAST(floor(greatest(3, floor(30 / si)) / 2) AS BIGINT) AS half, CAST(greatest(5, floor(10 / si)) AS BIGINT) AS mb
    FROM (SELECT trace_id, count(*) AS n, coalesce(quantile_cont(d, 0.5) FILTER (WHERE d > 0), 1.0) AS si
          FROM (SELECT trace_id, t - lag(t) OVER (PARTITION BY trace_id ORDER BY row_idx) AS d FROM can) q GROUP BY trace_id) q""",
    "sig": f"""
    SELECT trace_id, row_idx, t, x, sp, spike, CASE WHEN spike THEN hmed ELSE x END AS clean, med, mad, ls, rs, d2, d, dn,
           CASE WHEN row_idx >= mb THEN median(abs(coalesce(rs, 0))) OVER ({W} ROWS BETWEEN mb PRECEDING AND 1 PRECEDING) END AS tm,
           CASE WHEN rs > 0.1 THEN 'HEATING' WHEN rs < -0.1 THEN 'COOLING' WHEN rs IS NOT NULL THEN 'STABLE' END AS dir
    FROM (SELECT *, CASE WHEN lag(t) OVER ({W}) IS NOT NULL AND lead(t) OVER ({W}) > lag(t) OVER ({W}) THEN (lead(rs) OVER ({W}) - lag(rs) OVER ({W})) / (lead(t) OVER ({W}) - lag(t) OVER ({W})) END AS d2
          FROM (SELECT *, abs(x - hmed) > 3 * 1.4826 * greatest(list_aggregate(list_transform(hlist, lambda v: abs(v - hmed)), 'median'), 1e-10) AS spike,
                       list_aggregate(list_transform(wlist, lambda v: abs(v - med)), 'median') AS mad, t - lag(t) OVER ({W}) AS d, lead(t) OVER ({W}) - t AS dn,
                       CASE WHEN count(ls) OVER ({W} {_FRAME}) = count(*) OVER ({W} {_FRAME}) THEN median(ls) OVER ({W} {_FRAME}) END AS rs
                FROM (SELECT q.*, median(x) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS hmed, list(x) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS hlist,
                             median(x) OVER ({W} {_FRAME}) AS med, list(x) OVER ({W} {_FRAME}) AS wlist,
                             CASE WHEN t_next > t_prev THEN (x_next - x_prev) / (t_next - t_prev) * 60 END AS ls
                      FROM (SELECT can.trace_id, row_idx, t, x, sp, half, mb, coalesce(lead(t) OVER (w), t) AS t_next, coalesce(lag(t) OVER (w), t) AS t_prev,
                                   coalesce(lead(x) OVER (w), x) AS x_next, coalesce(lag(x) OVER (w), x) AS x_prev
                            FROM can JOIN par ON par.trace_id = can.trace_id WINDOW w AS (PARTITION BY can.trace_id ORDER BY row_idx)) q) q) q) q""",
    "cus": f"""
    SELECT trace_id, coalesce(min(CASE WHEN ahead - (p - step) > thr AND row_idx + mc - 1 <= n - 1 THEN row_idx END), max(n) - 1) AS process_start
    FROM (SELECT *, min(p) OVER ({W} ROWS BETWEEN CURRENT ROW AND mc - 1 FOLLOWING) AS ahead
          FROM (SELECT *, sum(step) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM cst) q) q
    GROUP BY trace_id""",
    "slopes": """
    SELECT r.trace_id, r.region_no, r.robust, s.sustained, e.endpoint
    FROM (SELECT a.trace_id, a.region_no, coalesce(median((b.x - a.x) / (b.t - a.t)) * 60, 0) AS robust
          FROM vrr a JOIN vrr b ON b.trace_id = a.trace_id AND b.region_no = a.region_no AND b.i > a.i AND b.t > a.t GROUP BY ALL) r
    JOIN (SELECT a.trace_id, a.region_no, coalesce(median((b.x - a.x) / (b.t - a.t)) * 60, 0) AS endpoint
          FROM vrr a JOIN vrr b ON b.trace_id = a.trace_id AND b.region_no = a.region_no AND b.i > a.i AND b.t > a.t WHERE a.i >= a.m - greatest(3, floor(a.m / 10)) GROUP BY ALL) e
      ON e.trace_id = r.trace_id AND e.region_no = r.region_no
    JOIN (SELECT trace_id, region_no, arg_min(slope, (abs(slope), k)) AS sustained
          FROM (SELECT k.trace_id, k.region_no, k.i AS k, coalesce(median((b.x - a.x) / (b.t - a.t)) FILTER (WHERE b.t > a.t) * 60, 0) AS slope
                FROM (SELECT *, least(m, greatest(3, floor(60 / si))) AS w FROM vrr) k
                JOIN vrr a ON a.trace_id = k.trace_id AND a.region_no = k.region_no AND a.i >= k.i AND a.i < k.i + k.w
                JOIN vrr b ON b.trace_id = k.trace_id AND b.region_no = k.region_no AND b.i > a.i AND b.i < k.i + k.w
                WHERE k.i + k.w <= k.m GROUP BY ALL) q GROUP BY ALL) s ON s.trace_id = r.trace_id AND s.region_no = r.region_no""",
}


def needs(sql: str) -> list[str]:
    return [n for n in [*DUCK_SOURCES, *STAGES] if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]


def doubles(sql: str) -> str:
    """0.5 is a decimal on one engine and on the other, 0.5e0 a double on both."""
    return re.sub(r"(?<![\w.'%])\d+\.\d+(?![\w.'])", r"\g<0>e0", sql)


def render(select: str, dialect: Dialect, own: dict[str, str] | None = None) -> str:
    """The statement with all stages it needs in front; own statements stand for the stages of their names."""
    own = own or {}
    order: list[tuple[str, str]] = []
    seen: set[str] = set()

    def visit(sql: str) -> None:
        for name in needs(sql):
            if name not in seen:
                seen.add(name)
                body = own[name] if name in own else STAGES[name](dialect) if name in STAGES else DUCK_SOURCES[name]
                visit(body)
                order.append((name, body))

    visit(select)
    head = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in order) + "\n" if order else ""
    return doubles(head + select)
