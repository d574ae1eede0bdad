import math
import random

from tests.traces import rows
from tracelake.operators.grid import missing_slots, regular_grid


def slots(df):
    return {(r.trace_id, r.slot) for r in df.collect()}


def brute(cells, interval=10.0):
    start = min(cells)[1]
    at = [(math.floor((s - start) / interval + 0.5), v is not None and not math.isnan(v)) for _, s, v in cells]
    has = {k for k, ok in at if ok}
    return {k for k in range(min(k for k, _ in at), max(k for k, _ in at) + 1)} - has


def test_missing_slots_match_brute_force_over_many_chunks(spark):
    rng = random.Random(5)
    cells, t = [], 0.0
    for i in range(900):
        t += rng.choice([10, 10, 10, 11.5, 9, 40, 0, 300])
        cells.append((i, t, rng.choice([20.0, 21.0, None, float("nan"), 22.0])))
    want = {("f#Temp", k) for k in brute(cells)}
    frame = rows(spark, cells)
    filled = regular_grid(frame.union(frame), chunk_slots=16, observed=False)
    assert slots(filled) == want and filled.count() == len(want)
    assert slots(missing_slots(frame)) == want


def test_late_rows_may_lie_before_the_first_one(spark):
    df = rows(spark, [(0, 100, 1.0), (1, 110, 1.0), (2, 60, 1.0)])
    assert {s for _, s in slots(missing_slots(df))} == {-3, -2, -1}


def test_bridge_meets_both_endpoints_and_follows_the_season(spark):
    wave = lambda k: 20 + 0.01 * k + 5 * math.sin(2 * math.pi * k / 200)
    cells = [(k, 10 * k, wave(k)) for k in range(201) if not 80 <= k < 95]
    got = {r.slot: (r.value, r.fill_method) for r in regular_grid(rows(spark, cells), chunk_slots=64).collect()}
    assert len(got) == 201
    for k in range(80, 95):
        assert got[k][1] == "bridged" and abs(got[k][0] - wave(k)) < 0.05


def test_edges_without_temperature_and_empty_tables(spark):
    df = rows(spark, [(0, 0, None), (1, 10, 5.0), (2, 20, None), (3, 40, None)])
    got = {r.slot: r.fill_method for r in regular_grid(df).collect()}
    assert got == {0: "extended", 1: "observed", 2: "extended", 3: "extended", 4: "extended"}
    bare = {r.slot: (r.value, r.fill_method) for r in regular_grid(rows(spark, [(0, 0, None), (1, 20, float("nan"))])).collect()}
    assert bare == {k: (None, "unfillable") for k in range(3)}
    assert regular_grid(rows(spark, [])).count() == 0
    lost = rows(spark, [(0, None, 1.0)]).union(rows(spark, [(0, 0, 1.0)], trace=None))
    assert missing_slots(lost).count() == 0


def test_interval_is_the_one_most_rows_carry(spark):
    a = rows(spark, [(k, 10 * k, 1.0) for k in range(6)])
    b = rows(spark, [(6, 70, 1.0), (7, 80, 1.0)], interval=1.0).union(rows(spark, [(8, 90, 1.0)], interval=None))
    assert {s for _, s in slots(missing_slots(a.union(b)))} == {6}


def test_held_out_readings_are_met(spark):
    """Of a noisy cycle with trend a quarter of the readings is taken out in holes of up to 20 slots; the fill is measured there."""
    rng = random.Random(8)
    truth = {k: 20 + 0.005 * k + 30 * math.sin(2 * math.pi * k / 400) + 8 * math.cos(2 * math.pi * k / 200) for k in range(400)}
    out = {k for a in (30, 95, 150, 260, 330) for k in range(a, a + 20)}
    cells = [(k, 10 * k, v + rng.gauss(0, 0.1)) for k, v in truth.items() if k not in out]
    got = {r.slot: r.value for r in regular_grid(rows(spark, cells), chunk_slots=100).collect()}
    seen = {k: v for k, _, v in cells}
    before = {k: max(i for i in seen if i < k) for k in out}
    after = {k: min(i for i in seen if i > k) for k in out}
    line = {k: seen[before[k]] + (seen[after[k]] - seen[before[k]]) * (k - before[k]) / (after[k] - before[k]) for k in out}
    error = lambda fill: (sum((fill[k] - truth[k]) ** 2 for k in out) / len(out)) ** 0.5
    assert error(got) < 0.12 and error(got) < error(line) / 3  # the noise of the readings is 0.1
