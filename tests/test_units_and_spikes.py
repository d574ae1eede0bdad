import itertools

import numpy as np

from tests.traces import metadata, rows
from tracelake.operators import _spike_kernel as spike_kernel
from tracelake.operators import _unit_kernel as unit_kernel
from tracelake.operators.spikes import faulty_readings, faulty_rows
from tracelake.operators.units import foreign_readings, readings_in_celsius


def profile(n, seed=1, noise=0.1):
    """Cycles between 80 and -30 °C with ramps, and their setpoint."""
    rng = np.random.default_rng(seed)
    value, out, target = 22.0, [], 80.0
    for k in range(n):
        target = 80.0 if (k // 120) % 2 == 0 else -30.0
        value += np.clip(target - value, -3, 3)
        out.append((value + rng.normal(0, noise), target))
    return np.array(out)


def test_unit_change_is_found_with_and_without_setpoint(spark):
    p = profile(700)
    raw = np.where(np.arange(700) >= 330, p[:, 0] * 1.8 + 32, p[:, 0]).round(2)
    for setpoint in (p[:, 1], [None] * 700):
        df = rows(spark, [(k, 10 * k, float(raw[k]), None if setpoint[k] is None else float(setpoint[k])) for k in range(700)])
        got = {(r.row_idx, r.recorded_unit) for r in foreign_readings(df.union(df), metadata(spark, ("f", None, None))).collect()}
        assert {u for _, u in got} == {"F"}
        assert len({k for k, _ in got} ^ set(range(330, 700))) <= 3


def test_unit_from_name_note_and_values(spark):
    p = profile(300)[:, 0]
    kelvin = rows(spark, [(k, 10 * k, float(p[k] + 273.15)) for k in range(300)], trace="a#Temp (K)")
    tenths = rows(spark, [(k, 10 * k, float(round(p[k] * 10))) for k in range(300)], trace="b#Temp")
    plain = rows(spark, [(k, 10 * k, float(p[k])) for k in range(300)], trace="c#Temp offset")
    meta = metadata(spark, ("a", None, "C"), ("b", "analog inputs stored as integer tenths", "C"), ("c", None, "F"))
    got = readings_in_celsius(kelvin.union(tenths).union(plain), meta).collect()
    assert {(r.trace_id[0], r.recorded_unit) for r in got} == {("a", "K"), ("b", "dC"), ("c", "C")}
    assert all(abs(r.temperature_c - p[r.row_idx]) < 0.06 for r in got) and len(got) == 900


def test_segmentation_is_optimal_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = np.r_[rng.normal(20, 0.1, 5), rng.normal(rng.choice([68.0, 293.0, 20.0]), 0.1, 5), rng.normal(25, 0.1, 4)].round(2)
        setpoint = np.where(rng.random(14) < 0.5, 20.0, np.nan)
        cost, paths = unit_kernel.segment(np.arange(14.0), x, setpoint, 1.0)
        emission = unit_kernel.emission(x, setpoint)
        at, jump = unit_kernel.changes(np.arange(14.0), x, 1.0)
        if len(at) > 5:
            continue
        best = np.full((4, 4), np.inf)
        for units in itertools.product(range(4), repeat=len(at) + 1):
            spans = zip(units, [0, *at], [*at, 14])
            total = sum(emission[u, a:b].sum() for u, a, b in spans) + sum(jump[k, units[k], units[k + 1]] for k in range(len(at)))
            best[units[0], units[-1]] = min(best[units[0], units[-1]], total)
        assert np.allclose(np.nan_to_num(cost, posinf=1e9), np.nan_to_num(best, posinf=1e9))
        assert all(paths[a][b][0] == (0, a) for a in range(4) for b in range(4))


def faults(df, meta):
    out = {}
    for r in faulty_readings(df, meta).collect():
        out.setdefault(r.fault, set()).add(r.row_idx)
    return out


def test_spikes_stuck_and_impossible(spark):
    p = profile(900, noise=0.05)[:, 0].round(3)
    p[60], p[61] = p[60] + 30, p[61] - 28  # two readings, on a dwell
    p[250] += 45  # on a ramp
    p[500:530] = p[500]
    p[700:705] = -999.0
    df = rows(spark, [(k, 10 * k, float(p[k])) for k in range(900)])
    got = faults(df.union(df.limit(100)), metadata(spark, ("f", None, None)))
    assert got["spike"] == {60, 61, 250}
    assert got["stuck"] == set(range(500, 530))
    assert got["impossible"] == set(range(700, 705))
    assert faulty_rows(df, metadata(spark, ("f", None, None))).count() == 38


def test_steps_bends_and_late_rows_are_no_spikes(spark):
    p = np.r_[np.full(40, 20.0), 20 + 4.0 * np.arange(20), np.full(40, 96.0)] + np.random.default_rng(2).normal(0, 0.05, 100)
    cells = [(k, 10 * k, float(p[k])) for k in range(100) if k != 50] + [(100, 500, float(p[50]))]
    assert faults(rows(spark, cells), metadata(spark, ("f", None, None))) == {}


def test_stuck_runs_are_joined_across_chunks(spark, monkeypatch):
    from tracelake.operators import spikes

    rng = np.random.default_rng(4)
    p = 20 + rng.normal(0, 0.3, 400).round(3)
    p[90:140] = p[90]
    df = rows(spark, [(k, 10 * k, float(p[k])) for k in range(400)])
    whole = faults(df, metadata(spark, ("f", None, None)))
    plain = spikes.chunked
    monkeypatch.setattr(spikes, "chunked", lambda t, halo=0: plain(t, halo=halo, chunk_slots=100))
    assert faults(df, metadata(spark, ("f", None, None))) == whole
    assert whole["stuck"] == set(range(90, 140))


def test_nulls_and_empty_tables(spark):
    empty, meta = rows(spark, []), metadata(spark, ("f", None, None))
    assert faulty_readings(empty, meta).count() == foreign_readings(empty, meta).count() == 0
    odd = rows(spark, [(0, 0, None), (1, 10, float("nan")), (2, None, 3.0), (3, 30, 4.0), (None, 40, 5.0)])
    assert faulty_readings(odd, meta.limit(0)).count() == 0
    assert {r.row_idx for r in readings_in_celsius(odd, meta.limit(0)).collect()} <= {3, None}


def test_results_do_not_depend_on_the_cut(spark, monkeypatch):
    from tracelake.operators import spikes, units

    p = profile(1500, noise=0.05)
    raw = np.where((np.arange(1500) >= 600) & (np.arange(1500) < 1100), p[:, 0] * 1.8 + 32, p[:, 0]).round(2)
    raw[[300, 700, 701, 1203]] += 35
    raw[900:930] = raw[900]
    df, meta = rows(spark, [(k, 10 * k, float(raw[k])) for k in range(1500)]), metadata(spark, ("f", None, None))
    plain, seen = units.chunked, []
    for slots in (150, 400, 65536):
        for module in (spikes, units):
            monkeypatch.setattr(module, "chunked", lambda t, halo=0: plain(t, halo=halo, chunk_slots=slots))
        monkeypatch.setattr(units, "FANOUT", 3)
        seen.append(({tuple(r) for r in foreign_readings(df, meta).collect()}, {tuple(r) for r in faulty_readings(df, meta).collect()}))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) > 450 and len(seen[0][1]) >= 34


def test_segmentation_over_all_readings_with_least_stretches():
    """The cheapest path over every reading, stretches between changes at least so long, by a program that keeps their starts."""
    rng, n = np.random.default_rng(5), 12
    for _ in range(15):
        least = int(rng.integers(1, 5))
        x = np.r_[rng.normal(20, 0.1, 4), rng.normal(rng.choice([68.0, 293.0, 20.0]), 0.1, 4), rng.normal(25, 0.1, 4)].round(2)
        setpoint = np.where(rng.random(n) < 0.5, 20.0, np.nan)
        cost, paths = unit_kernel.segment(np.arange(float(n)), x, setpoint, 1.0, least=least, refine=True)
        emission = unit_kernel.emission(x, setpoint)
        unit_kernel_all = np.arange(1, n)
        rate, stuck = unit_kernel.local_rate(x), unit_kernel.frozen(x)
        scale = np.maximum(unit_kernel.noise_scale(x), rate)
        steps = np.abs(np.diff(x, prepend=x[0], append=x[-1]))
        jump = unit_kernel.jump_costs(x[:-1], x[1:], np.maximum(np.maximum(scale[:-1], scale[1:]), np.maximum(steps[:-2], steps[2:])), ~(stuck[1:] | stuck[:-1]))
        best = np.full((4, 4), np.inf)
        for first in range(4):
            state = {(first, 0): emission[first, 0]}
            for t in unit_kernel_all:
                new: dict = {}
                for (a, start), c in state.items():
                    for b in range(4):
                        if b == a or start == 0 or t - start >= least:
                            key, value = (b, start if a == b else t), c + jump[t - 1, a, b] + emission[b, t]
                            new[key] = min(new.get(key, np.inf), value)
                state = new
            for (b, _), c in state.items():
                best[first, b] = min(best[first, b], c)
        assert np.allclose(cost, best)
        assert all(paths[a][b][0] == (0, a) and paths[a][b][-1][1] == b for a in range(4) for b in range(4))


def test_composing_pieces_is_the_whole_chain():
    rng = np.random.default_rng(6)
    costs, shifts = rng.random((7, 4, 4)), rng.random((6, 4, 4))
    whole = unit_kernel.compose(costs, shifts)
    left, right = unit_kernel.compose(costs[:3], shifts[:2]), unit_kernel.compose(costs[3:], shifts[3:])
    assert np.allclose(whole, unit_kernel.compose(np.stack([left, right]), shifts[2:3]))
    pairs = unit_kernel.descend(costs, shifts, 1, 2)
    total = sum(costs[k][a, b] for k, (a, b) in enumerate(pairs)) + sum(shifts[k][pairs[k][1], pairs[k + 1][0]] for k in range(6))
    assert pairs[0][0] == 1 and pairs[-1][1] == 2 and np.isclose(total, whole[1, 2])
