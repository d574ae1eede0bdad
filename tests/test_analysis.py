"""Each stage against a plain restatement of its rule, and every query against its SQL, on small traces."""

import duckdb
import numpy as np
import pytest

from tests.traces import rows
from tracelake.operators.signal import canonical_trace, signals, sustained_start, trace_frames, trace_signals
from tracelake.operators.slopes import _inversions, sustained_slope, theil_sen
from tracelake.plans import texts, traces


def naive(t, x, half, mb):
    """The signals row by row."""
    n = len(x)
    cut = lambda v, i, k: v[max(0, i - k) : i + k + 1]
    spike, clean, med, mad, ls = [], [], [], [], []
    for i in range(n):
        w = cut(x, i, 5)
        m = np.median(w)
        spike.append(abs(x[i] - m) > 3 * 1.4826 * max(np.median(np.abs(w - m)), 1e-10))
        clean.append(m if spike[-1] else x[i])
        w = cut(x, i, half)
        med.append(np.median(w))
        mad.append(np.median(np.abs(w - med[-1])))
        a, b = max(i - 1, 0), min(i + 1, n - 1)
        ls.append((x[b] - x[a]) / (t[b] - t[a]) * 60 if t[b] > t[a] else np.nan)
    rs = [np.median(cut(np.array(ls), i, half)) for i in range(n)]
    d2 = [(rs[i + 1] - rs[i - 1]) / (t[i + 1] - t[i - 1]) if 0 < i < n - 1 and t[i + 1] > t[i - 1] else np.nan for i in range(n)]
    tm = [np.median(np.abs(np.nan_to_num(rs[i - mb : i]))) if i >= mb else np.nan for i in range(n)]
    return {"spike": spike, "clean": clean, "med": med, "mad": mad, "ls": ls, "rs": rs, "d2": d2, "tm": tm}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 200])
def test_signals_match_the_loop(n):
    rng = np.random.default_rng(n)
    t = np.cumsum(rng.choice([0, 1, 1, 2, -1, 30], n)).astype(float)
    x = rng.normal(20, 2, n).round(1)
    for half, mb in ((1, 5), (4, 6), (9, 5)):
        got, want = signals(t, x, half, mb), naive(t, x, half, mb)
        for name in want:
            assert np.allclose(np.asarray(got[name], float), np.asarray(want[name], float), equal_nan=True), name


def test_chunks_do_not_show(spark):
    rng = np.random.default_rng(1)
    cells = [(k, k + float(rng.random()), float(v)) for k, v in enumerate(rng.normal(20, 3, 600).cumsum().round(2))]
    canonical = canonical_trace(rows(spark, cells))
    frames = trace_frames(canonical)
    pick = lambda df: sorted(tuple(r) for r in df.drop("sp").fillna(-1.0).collect())
    assert pick(trace_signals(canonical, frames, chunk_rows=8)) == pick(trace_signals(canonical, frames))


def test_canonical_edges(spark):
    cells = [(0, 0, None), (1, 5, float("nan")), (2, 5, 3.0), (None, 9, 1.0), (3, None, 1.0)]
    df = rows(spark, cells)
    got = {r.row_idx: (r.t, r.x, r.missing) for r in canonical_trace(df.union(df)).collect()}
    assert got == {0: (0.0, 0.0, True), 1: (5.0, 0.0, True), 2: (5.0, 3.0, False)}
    assert canonical_trace(df.limit(0)).count() == 0 == trace_frames(canonical_trace(df.limit(0))).count()


def test_slopes_by_counting_match_all_pairs(monkeypatch):
    from tracelake.operators import slopes

    rng = np.random.default_rng(2)
    assert _inversions(np.array([3, 1, 2, 0, 0])) == 8
    for n in (2, 3, 50, 101):
        t, x = np.sort(rng.random(n) * 100), rng.normal(0, 5, n)
        want = theil_sen(t, x)
        monkeypatch.setattr(slopes, "DIRECT_ROWS", 0)
        assert abs(theil_sen(t, x) - want) < 1e-8 * max(1, abs(want))
        assert theil_sen(np.zeros(n), x) == 0.0
        monkeypatch.undo()
    for n in (5, 30, 120):  # times and values that repeat
        t, x = rng.integers(0, n // 2, n).astype(float), rng.integers(0, 4, n).astype(float)
        want = theil_sen(t, x)
        monkeypatch.setattr(slopes, "DIRECT_ROWS", 0)
        assert abs(theil_sen(t, x) - want) < 1e-8 * max(1, abs(want))
        monkeypatch.undo()
    assert sustained_slope(np.arange(10.0), np.r_[np.arange(5.0), np.full(5, 4.0)], 20.0) == 0.0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two traces of a few cycles, and a little of the text tables."""
    path = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(7)
    frames = []
    for trace, step in (("a#Temp", 10), ("b#Temp", 4)):
        value, cells = 21.03, []
        for k in range(700):
            target = 21.03 if k < 60 else 85.01 if (k // 130) % 2 == 0 else -40.02
            value += float(np.clip(target - value, -2.3, 2.3))
            if k % 97 != 5:
                cells.append((len(cells), step * k + 0.001 * int(rng.integers(0, 900)), round(value + float(rng.normal(0, 0.05)), 3), target if trace[0] == "a" else None))
        frames.append(rows(spark, cells, trace=trace, interval=float(step)))
    frames[0].union(frames[1]).drop("chunk", "us", "slot", "_salt").coalesce(1).write.parquet(f"{path}/trace_rows.parquet")
    lines = [("f", i, x) for i, x in enumerate(["head", "Time\tTemp C\tSP", "1.0\t20,5\t3", "2\tNaN\t\t", ""])] + [("g", 0, "a;b"), ("g", 1, "1;2"), ("h", 0, None)]
    spark.createDataFrame(lines, "source_file string, line_no int, line_text string").write.parquet(f"{path}/raw_lines.parquet")
    stamps = [(1, "f", 0, "31/12/2024 10:00:00"), (2, "g", 0, "45000.5"), (3, "h", 0, None), (4, "h", 1, "1700000000"), (5, "i", 0, "12.5"), (6, "j", 0, "05/06/2024"), (7, "k", 0, "2024-01-01T00:00:00.123456")]
    spark.createDataFrame(stamps, "reading_id long, source_file string, line_no int, stamp_text string").write.parquet(f"{path}/reading_stamps.parquet")
    spark.createDataFrame([("f", ["t", "Chamber Temp", "Temp SP"]), ("g", []), ("h", None)], "source_file string, column_names array<string>").write.parquet(f"{path}/raw_traces.parquet")
    return path


def same(spark, folder, module, names):
    duck = duckdb.connect()
    for name in ("trace_rows", "raw_lines", "reading_stamps", "raw_traces"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    queries, sql = module.queries(), module.oracle_sql()
    for name in names:
        got = queries[name](spark, folder)
        want = duck.execute(sql[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns), name
        plain = lambda v: None if v is None or v != v else round(float(v), 3) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v
        key = lambda r: tuple(str(x) for x in r)
        left = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
        right = sorted((tuple(plain(x) for x in r) for r in want.fetchall()), key=key)
        assert left == right, name


def test_every_trace_query_matches_its_sql(spark, folder):
    same(spark, folder, traces, list(traces.SELECTS))
    assert traces.queries()["cycles"](spark, folder).count() > 2 and traces.queries()["valid_ramps"](spark, folder).count() > 5


def test_queries_in_any_order_of_one_session(spark, folder):
    """Backwards, with stages made anew, and once more from the stages that are there."""
    traces.forget()
    same(spark, folder, traces, [*reversed(traces.SELECTS), *(f"{n}_report_only" for n in traces.REPORTED)])
    same(spark, folder, traces, ["validation_results", "regions", "phase_table", "tolerance"])


@pytest.mark.parametrize("chunk", [4, 50, 10_000])
def test_sustained_start_does_not_show_its_chunks(spark, chunk):
    rng = np.random.default_rng(3)
    cells, want = [], {}
    for trace in "abc":
        step, mc, n = rng.normal(-0.2, 1, 120).round(3), int(rng.integers(3, 9)), 120
        hit = [i for i in range(n - mc + 1) if np.cumsum(step[i : i + mc]).min() > 0.4]
        want[trace] = hit[0] if hit else n - 1
        cells += [(trace, k, float(step[k]), 0.4, mc, n) for k in range(n)]
    df = spark.createDataFrame(cells, "trace_id string, row_idx long, step double, thr double, mc long, n long")
    assert {r[0]: r[1] for r in sustained_start(df, chunk_rows=chunk).collect()} == want
    assert sustained_start(df.limit(0)).count() == 0


def test_text_queries_match_their_sql(spark, folder):
    same(spark, folder, texts, [n for n in texts.oracle_sql() if n not in ("column_detect", "columns_by_name")])
    got = {r.reading_id: (r.kind, str(r.ts)) for r in texts.queries()["parse_timestamps"](spark, folder).collect()}
    assert got[1] == ("DD/MM/YYYY HH:MM:SS", "2024-12-31 10:00:00") and got[2] == ("Excel serial date", "2023-03-15 12:00:00")
    assert got[4] == ("Epoch seconds", "2023-11-14 22:13:20") and got[5] == ("elapsed_seconds", "2000-01-01 00:00:12.500000") and got[3][0] == "unknown"
    assert got[6] == ("MM/DD/YYYY", "2024-05-06 00:00:00") and got[7][1] == "2024-01-01 00:00:00.123456"
