"""Columns by name and content, header rows, profiles and the session."""

import json
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from tracelake import session
from tracelake.functions.profiles import REPORT_ONLY, STANDARD, ProfileError, load_profile
from tracelake.operators import columns

VALUES = "source_file string, column string, place int, row_no int, text string, x int"


def by_content(frame: pd.DataFrame, least: int):
    """The same choice on a pandas frame, column after column."""
    key = lambda c: c.lower().replace(" ", "_")
    score = lambda c, words: sum(w in key(c) for w in words)
    number = {c: pd.to_numeric(frame[c], errors="coerce") for c in frame}
    time = next((c for c in frame if score(c, columns.TIME_WORDS)), None)
    if time is None:
        time = next((c for c in frame if frame[c].dropna().head(10).str.match(columns.TIMESTAMP).all() and frame[c].head(10).notna().any()), None)
    if time is None:
        rising = lambda v: (v.diff().dropna() >= 0).mean() > 0.99
        time = next((c for c in frame if number[c].notna().sum() > least and rising(number[c])), None)
    inside = lambda c: number[c].notna().sum() >= least and number[c].min() >= -100 and number[c].max() <= 200
    warm = []
    for c in frame:
        variance = number[c].dropna().head(1000).var()
        if c != time and inside(c) and (variance > 0.001 or score(c, columns.TEMPERATURE_WORDS)):
            warm.append((-score(c, columns.TEMPERATURE_WORDS), -variance, list(frame).index(c), c))
    temperature = min(warm)[3] if warm else next((c for c in frame if c != time and number[c].notna().sum() > least), None)
    meant = []
    for c in frame:
        if temperature is not None and c not in (time, temperature) and inside(c):
            r = number[c].corr(number[temperature])
            if r == r and abs(r) > 0.3:
                meant.append((-score(c, columns.SETPOINT_WORDS), -abs(r), list(frame).index(c), c))
    return time, temperature, min(meant)[3] if meant else None


def test_columns_by_content_against_pandas(spark):
    rng, n = np.random.default_rng(2), 40
    wave, noise = 20 + 30 * np.sin(np.arange(n) / 5), rng.normal(0, 1, n)
    text = lambda v: [None if i % 11 == 5 else f"{x:.3f}" for i, x in enumerate(v)]
    files = {
        "named": {"Elapsed": text(np.arange(n)), "SP": text(wave + 1), "Chamber Temp": text(wave + noise), "Fan": text(1000 + noise)},
        "bare": {"c0": [str(k) for k in range(n)], "c1": text(wave + noise), "c2": text(np.round(wave, -1)), "c3": ["ON"] * n},
        "stamps": {"a": ["x"] * n, "b": [f"2024-01-01 00:00:{k:02d}" for k in range(n)], "c": text(wave)},
        "flat": {"date": ["?"] * n, "Temp": ["20"] * n, "Target": ["20"] * n, "hot": text(500 + wave)},
        "words": {"x": ["a"] * n, "y": ["b"] * n},
    }
    cells = [(f, c, place, k, v, 0) for f, table in files.items() for place, (c, column) in enumerate(table.items()) for k, v in enumerate(column)]
    got = {r.source_file: tuple(r)[1:] for r in columns.columns_by_content(spark.createDataFrame(cells, VALUES)).collect()}
    assert got == {f: by_content(pd.DataFrame(table), 10) for f, table in files.items()}
    assert got["named"] == ("Elapsed", "Chamber Temp", "SP") and got["bare"] == ("c0", "c2", "c1") and got["words"] == (None, None, None)
    assert columns.columns_by_content(spark.createDataFrame([], VALUES)).count() == 0


def test_columns_by_name(spark):
    names = [("a", ["Date", "Temp 2", "temp"]), ("b", ["Elapsed s", "CH1", "Target", None]), ("c", []), ("d", None), ("e", ["Temperature (C)", "Time", "SV"])]
    got = {r[0]: tuple(r)[1:] for r in columns.columns_by_name(spark.createDataFrame(names, "source_file string, column_names array<string>")).collect()}
    none = (None, None, None)
    assert got == {"a": ("Date", "temp", None), "b": ("Elapsed s", "CH1", "Target"), "c": none, "d": none, "e": ("Time", "Temperature (C)", "SV")}


def test_header_rows(spark):
    files = {"a": ["Logger 1", "", "Time,Temp", "1,2"], "b": ["1,2", "x,y"], "c": ["one", "two"], "d": ["Time,Temp", "1,2"], "e": [None, "a,b"]}
    lines = spark.createDataFrame([(f, k, t) for f, text in files.items() for k, t in enumerate(text)], "source_file string, line_no int, line_text string")
    assert {r[0]: r[1] for r in columns.header_rows(lines).collect()} == {"a": 2, "b": 0, "c": 0, "d": 0, "e": 1}


def test_profiles(tmp_path):
    whole = {
        "profile_metadata": {"profile_name": "mine"}, "expected_process_sequence": {"expected_region_sequence": ["HOT_DWELL"], "hot_cycle_count_max": 7},
        "ramp_rate_requirements": {"required_heating_ramp_rate_c_per_min": 2, "required_cooling_ramp_rate_c_per_min": 3.5, "allowed_ramp_deviation_c": None},
        "dwell_requirements": {"allowed_setpoint_deviation_c": 1.5}, "setpoint_deviation_requirements": {"allowed_setpoint_deviation_c": 9},
        "overshoot_requirements": {"overshoot_failure_threshold_c": 4}, "settling_requirements": {"settling_time_limit_seconds": 60},
    }
    path = tmp_path / "p.json"
    path.write_text(json.dumps(whole))
    p = load_profile(str(path))
    assert (p.name, p.heating_rate, p.cooling_rate, p.sequence, p.most_cycles, p.settling_s) == ("mine", 2, 3.5, ("HOT_DWELL",), 7, 60)
    assert p.dwell_deviation == 1.5 and p.ramp_deviation is None and p.sustained_ratio == 0.8 and hash(p) != hash(STANDARD)
    assert REPORT_ONLY.dwell_deviation is None
    for broken in ({k: v for k, v in whole.items() if k != "settling_requirements"}, whole | {"overshoot_requirements": {"overshoot_failure_threshold_c": "x"}}, []):
        path.write_text(json.dumps(broken))
        with pytest.raises(ProfileError):
            load_profile(str(path))
    path.write_text("{")
    for bad in (path, tmp_path / "absent.json"):
        with pytest.raises(ProfileError):
            load_profile(str(bad))
    yaml = pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(whole))
    assert load_profile(str(tmp_path / "p.yaml")) == p


def test_a_cluster_must_name_its_shared_folder(spark, tmp_path):
    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda *_: None)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(cluster)
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    before = session.fingerprint(spark, path)
    spark.range(3).write.mode("overwrite").parquet(path)
    assert before != session.fingerprint(spark, path)
