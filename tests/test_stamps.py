from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from tracelake.operators import stamps as stamps_module
from tracelake.operators.stamps import normalised_stamps, reading_instants, stamp_dictionary

LOGGERS = [("B", "Europe/Berlin", None), ("S", "Europe/Berlin", "Clock left on standard time all year"), ("U", "Asia/Tokyo", "Clock set to UTC"), ("N", None, None), ("J", "America/St_Johns", "DST automatic")]


def tables(spark, stamps, files):
    loggers = spark.createDataFrame(LOGGERS, "logger_id string, tz_name string, clock_note string")
    meta = spark.createDataFrame([(f, lg, at) for f, lg, at in files], "source_file string, logger_id string, ingested_at timestamp_ntz")
    rows = [(i, f, n, t, "x") for i, (f, n, t) in enumerate(stamps)]
    return spark.createDataFrame(rows, "reading_id long, source_file string, line_no int, stamp_text string, rule string"), meta, loggers


def read(spark, stamps, files):
    rows, meta, loggers = tables(spark, stamps, files)
    got = {r.reading_id: r.utc_ms for r in reading_instants(rows.union(rows), meta, loggers).collect()}
    return [None if i not in got else datetime.fromtimestamp(got[i] / 1000, timezone.utc).replace(tzinfo=None) for i in range(len(stamps))]


def test_formats_zones_and_junk(spark):
    at = datetime(2024, 6, 10)
    cases = [
        ("b", "2024-06-01T12:00:00", datetime(2024, 6, 1, 10)), ("s", "2024-06-01 12:00:00,250", datetime(2024, 6, 1, 11, 0, 0, 250000)), ("u", "20240601T120000Z", datetime(2024, 6, 1, 12)),
        ("b", "Sat, 01 Jun 2024 12:00:00 -0230", datetime(2024, 6, 1, 14, 30)), ("u", "01-Jun-2024 12:00:00 EST", datetime(2024, 6, 1, 17)), ("u", "01-Jun-24 12:00:00", datetime(2024, 6, 1, 12)),
        ("b", "1717243200", datetime(2024, 6, 1, 12)), ("b", "1717243200123", datetime(2024, 6, 1, 12, 0, 0, 123000)), ("b", "1717243200123499", datetime(2024, 6, 1, 12, 0, 0, 123000)),
        ("u", "45444.5", datetime(2024, 6, 1, 12)), ("b", " 01.06.2024 12:00 ", datetime(2024, 6, 1, 10)), ("n", "2024-06-01T12:00:00", datetime(2024, 6, 1, 12)), ("gone", "2024-06-01T12:00:00", datetime(2024, 6, 1, 12)),
        ("u", "6/1/2024 12:08:51 AM", datetime(2024, 6, 1, 0, 8, 51)), ("b", "31/02/2024 25:10:00", None), ("b", "2024-13-45 10:00:00", None), ("b", None, None), ("b", "", None), ("b", "clock error", None),
        ("b", "0", None), ("b", "1970-01-01T00:00:00", None), ("b", "x" * 100_000, None),
    ]
    files = [(f, f.upper(), at) for f in "bsun"]
    got = read(spark, [(f, i, t) for i, (f, t, _) in enumerate(cases)], files)
    assert got == [w for _, _, w in cases]


def test_order_of_day_and_month(spark):
    stamps = [("b", 0, "03/04/2024 10:00:00"), ("b", 1, "13/04/2024 10:00:00"), ("u", 0, "03/04/2024 10:00:00"), ("s", 0, "03/04/2024 10:00:00"), ("n", 0, "03/04/2024 10:00:00 AM")]
    files = [("b", "B", datetime(2024, 4, 14)), ("u", "U", datetime(2024, 3, 5)), ("s", "S", datetime(2024, 4, 4)), ("n", "N", None)]
    assert [x and (x.month, x.day) for x in read(spark, stamps, files)] == [(4, 3), (4, 13), (3, 4), (4, 3), (3, 4)]


def test_repeated_and_skipped_hours(spark):
    for zone, logger, begin in (("Europe/Berlin", "B", datetime(2024, 10, 26, 22)), ("America/St_Johns", "J", datetime(2024, 11, 3, 2)), ("Europe/Berlin", "B", datetime(2024, 3, 30, 23))):
        instants = [begin + timedelta(minutes=10 * k) for k in range(36)]
        local = [i.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone)).strftime("%Y-%m-%dT%H:%M:%S") for i in instants]
        got = read(spark, [("f", k, t) for k, t in enumerate(local)], [("f", logger, begin + timedelta(days=1))])
        assert got == instants
    assert read(spark, [("f", 0, "2024-03-31T02:30:00")], [("f", "B", datetime(2024, 4, 1))]) == [datetime(2024, 3, 31, 1, 30)]


def test_dictionary_grows_by_new_strings_only(spark, tmp_path):
    folder = f"{tmp_path}/book"
    first = spark.createDataFrame([("2024-06-01T12:00:00", "UTC")] * 3, "text string, rule string")
    assert stamp_dictionary(first, folder).count() == 1
    more = first.union(spark.createDataFrame([("0", "UTC")], first.schema))
    assert stamp_dictionary(more, folder).count() == 2 == spark.read.parquet(folder).count()


def test_empty_tables(spark):
    assert normalised_stamps(*[t.limit(0) for t in tables(spark, [("b", 0, "x")], [("b", "B", datetime(2024, 1, 1))])]).count() == 0


def test_any_year_and_bounds_only_where_given(spark):
    cases = [("u", "2010-02-28T23:59:59", datetime(2010, 2, 28, 23, 59, 59)), ("u", "29/02/2028 00:00:01", datetime(2028, 2, 29, 0, 0, 1)), ("u", "31.12.2031 12:00", datetime(2031, 12, 31, 12)),
             ("u", "1900-03-01 00:00:00", datetime(1900, 3, 1)), ("u", "1900-02-29 00:00:00", None), ("u", "29/02/2100 10:00:00", None), ("u", "1956528000", datetime(2032, 1, 1))]
    stamps, files = [(f, i, t) for i, (f, t, _) in enumerate(cases)], [("u", "U", datetime(2032, 1, 2))]
    assert read(spark, stamps, files) == [w for _, _, w in cases]
    bounds = {"earliest_us": 1_262_304_000_000_000, "latest_us": 1_300_000_000_000_000}
    assert [r.reading_id for r in reading_instants(*tables(spark, stamps, files), **bounds).collect()] == [0]


def test_a_second_run_parses_nothing_new(spark, tmp_path):
    book = f"{tmp_path}/book"
    args = tables(spark, [("b", 0, "2024-06-01T12:00:00"), ("b", 1, "junk"), ("u", 0, "2024-06-01T12:00:00")], [("b", "B", datetime(2024, 6, 2)), ("u", "U", datetime(2024, 6, 2))])
    first = sorted(reading_instants(*args, dictionary_folder=book).collect())
    kept = spark.read.parquet(book).count()
    assert kept == 3 and sorted(reading_instants(*args, dictionary_folder=book).collect()) == first and spark.read.parquet(book).count() == kept


@pytest.mark.parametrize("kept", [False, True])
def test_nothing_that_grows_is_broadcast(spark, tmp_path, monkeypatch, kept):
    # all of it is below the threshold here, as packed tables are estimated to be at any size; 16 copies a file are made of it
    plans = []
    seen = lambda f: lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df)
    stamps, files = [("b", k, f"2024-06-01T12:0{k}:00") for k in range(4)], [("b", "B", datetime(2024, 6, 2))]
    names = ("reading_stamps", "file_metadata", "loggers")
    for name, df in zip(names, tables(spark, stamps, files), strict=True):
        df.write.parquet(f"{tmp_path}/{name}")
    args = [spark.read.parquet(f"{tmp_path}/{name}") for name in names]
    book = f"{tmp_path}/book" if kept else None
    if kept:
        stamp_dictionary(args[0].limit(1).selectExpr("stamp_text AS text", "'UTC' AS rule"), book)
    for name in ("parse_strings", "materialize"):
        monkeypatch.setattr(stamps_module, name, seen(getattr(stamps_module, name)))
    got = reading_instants(*args, dictionary_folder=book)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sorted(r.utc_ms for r in got.collect()) == [1717236000000 + 60000 * k for k in range(4)]
    plans.append(got._jdf.queryExecution().executedPlan().toString())  # as it ran
    assert "SortMergeJoin" in plans[-1] and not [p for p in plans if "Broadcast" in p]
