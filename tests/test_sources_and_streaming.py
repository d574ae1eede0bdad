import zipfile
from xml.etree import ElementTree

import pytest

from tests.traces import rows
from tracelake.plans.texts import header_scan
from tracelake.sources.ingest import InputFormatError, detect_encoding, load_log_file, load_trace_file
from tracelake.sources.sinks import html_report, write_csv, write_json, write_xlsx
from tracelake.streaming.live import live_flags, windowed_statistics


@pytest.mark.parametrize("separator", ["\t", ",", ";", "|"])
def test_ladder(spark, tmp_path, separator):
    path = tmp_path / "a.log"
    lines = ["Logger 1", "", "Time,Temp C,Note", "1.0,20.5,ok", "2.0,21.5,x,y", "3.0,22.5,ok", "short,1"]
    path.write_text("\n".join(x.replace(",", separator) for x in lines))
    df = load_trace_file(spark, str(path), channel="Temp C")
    assert df.columns == ["Time", "Temp C", "Note"] and [tuple(r) for r in df.collect()] == [("1.0", "20.5", "ok"), ("3.0", "22.5", "ok")]
    with pytest.raises(InputFormatError):
        load_trace_file(spark, str(path), channel="none")
    (tmp_path / "b.log").write_text("nothing\nhere")
    with pytest.raises(InputFormatError):
        load_trace_file(spark, str(tmp_path / "b.log"))


def test_log_and_encodings(spark, tmp_path):
    path = tmp_path / "c.log"
    path.write_bytes(b"\xef\xbb\xbf" + "Time\tTemp\tTür\n1\t20,5\tauf\n2\t21,5\tzu\n".encode())
    df = load_log_file(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [(1.0, 20.5, "auf"), (2.0, 21.5, "zu")] and detect_encoding(spark, str(path)) == "utf-8"
    (tmp_path / "d.log").write_bytes("Time\tTür\n1\tä\n".encode("latin-1"))
    assert load_trace_file(spark, str(tmp_path / "d.log")).columns == ["Time", "Tür"]


@pytest.mark.parametrize("separator", ["\t", ",", ";", "|"])
def test_rows_with_an_empty_last_field(spark, tmp_path, separator):
    path = tmp_path / "e.log"
    lines = ["Time,Temp,Remark", "1,20,ok", "2,21,", "3,22", "4,,", '5,23,""', "6,24,,", "6,24,x,,", ",,", '7,"a,b",']
    path.write_text("\n".join(x.replace(",", separator) for x in lines))
    got = [tuple(r) for r in load_trace_file(spark, str(path)).collect()]
    assert got == [("1", "20", "ok"), ("2", "21", None), ("4", None, None), ("5", "23", None), (None, None, None), ("7", f"a{separator}b", None)]
    path.write_text("\n".join(x.replace(",", separator) for x in lines[:5]))
    assert [tuple(r) for r in load_log_file(spark, str(path)).collect()] == [(1.0, 20.0, "ok"), (2.0, 21.0, None), (4.0, None, None)]


def test_header_after_a_long_preamble(spark):
    text = [*["note"] * 250, "Time\tTemp", "1\t20"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "source_file string, line_no int, line_text string")
    assert [tuple(r) for r in header_scan(lines).collect()] == [("f", 250)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], None)], "k int, v array<string>, n string")
    write_json(df, f"{tmp_path}/j")
    write_csv({"section": df}, f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/j").count() == 1 and spark.read.option("header", True).csv(f"{tmp_path}/c/section").first().v == '["a"]'
    write_xlsx({"a/b": df, "A_b": None}, f"{tmp_path}/book.xlsx")
    with zipfile.ZipFile(f"{tmp_path}/book.xlsx") as book:
        assert len(book.namelist()) == 6
        for name in book.namelist():
            ElementTree.fromstring(book.read(name))
        cells = [c.text for c in ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml")).iter() if c.text]
    assert cells == ["k", "v", "n", "1", "['a']"]
    page = html_report("<t>", {"one": df, "none": None})
    assert "&lt;t&gt;" in page and "Not applicable" in page


def test_live_flags_and_windows(spark, tmp_path):
    cells = [(0, 0, 20.0), (1, 10, 21.0), (2, 10, float("nan")), (3, 5, 22.0), (4, 100, 23.0)]
    rows(spark, cells).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("flags", live_flags(stream), "append"), ("windows", windowed_statistics(stream), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.processAllAvailable()
        query.stop()
    flags = {(r.row_idx, r.flag) for r in spark.table("flags").collect()}
    assert flags == {(2, "DUPLICATE_TIMESTAMP"), (3, "OUT_OF_ORDER"), (4, "GAP")}
    assert [(r.n, r.max_c) for r in spark.table("windows").orderBy("window_start").collect()] == [(3, 22.0), (1, 23.0)]


def test_data_equal_to_a_line_before_the_header_is_kept(spark, tmp_path):
    path = tmp_path / "f.log"
    path.write_text("a,b\n1,2\n\nTime,Temp\n3,4\nTime,Temp\n1,2\n")
    # the first two lines are a table of their own, which is read
    assert [tuple(r) for r in load_trace_file(spark, str(path)).collect()] == [("1", "2"), ("Time", "Temp"), ("3", "4"), ("Time", "Temp"), ("1", "2")]
    path.write_bytes("Tür\n\nTime\tTemp\n3\t4\nTime\tTemp\nTür\n5\t6\n".encode("latin-1"))
    assert [tuple(r) for r in load_trace_file(spark, str(path)).collect()] == [("3", "4"), ("Time", "Temp"), ("5", "6")]
