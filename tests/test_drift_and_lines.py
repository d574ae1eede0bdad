import json
import random

import pyarrow as pa
import numpy as np
import pytest

from tests.traces import metadata
from tracelake.functions.sensors import SensorNames
from tracelake.operators import rawlines
from tracelake.operators._tokens import Lines
from tracelake.operators.drift import rescued_table, schema_changes, schema_report

CATALOG = [("T_AIR", "Chamber Temp", "NUMERIC", ["Air Temp"]), ("RH", "Relative Humidity", "NUMERIC", ["Humidity"]), ("DOOR", "Door State", "STATE", ["Door Switch"]), ("NOTE", "Remark", "TEXT", None)]


def catalog(spark):
    return spark.createDataFrame(CATALOG, "sensor_code string, standard_name string, data_type string, known_aliases array<string>")


def traces(spark, files):
    cells = [(f, None if columns is None else ["t", *columns], [json.dumps(dict(t=i, **r)) for i, r in enumerate(records)], len(records), "c") for f, columns, records in files]
    return spark.createDataFrame(cells, "source_file string, column_names array<string>, records array<string>, row_count long, sensor string")


def test_names_of_sensors():
    k = SensorNames([(n, code) for code, standard, _, aliases in CATALOG for n in [standard, *(aliases or [])]])
    same = ("Chmb Tmp", "chamber_temp", "ChamberTemp", "AIR TEMP", "Air Temp (K)", "Chamber Temp_filtered", "Air.Temp offset", "Air Temp_1 [degC]")
    assert {k.code(n) for n in same} == {"T_AIR"}
    assert k.code("Relative Humid") == "RH" and k.code("Dor Stat") == "DOOR"
    assert k.code("Foo Bar") == k.code("foo_bar") == "?foobar" and k.code(" ") is None and k.code("Unnamed: 3") is None


def test_changes_between_files(spark):
    files = [
        ("a", ["Air Temp", "Humidity"], [{"Air Temp": 1.5, "Humidity": 40}]),
        ("b", ["Humidity", "Chmb Tmp", "Door State"], [{"Chmb Tmp": 1.5, "Humidity": None, "Door State": True}]),
        ("c", ["Chmb Tmp", "Humidity", "Door State"], [{"Chmb Tmp": 2, "Humidity": "40 %", "Door State": "ON"}, {"Chmb Tmp": "ERR"}, {"Chmb Tmp": 3}]),
        ("d", ["Chmb Tmp", "Door State", "", None], [{"Chmb Tmp": 1.0}]),
    ]
    meta = metadata(spark, *[(f, None, None) for f, _, _ in files])
    got = {tuple(r) for r in schema_changes(traces(spark, files), meta.union(meta), catalog(spark)).collect()}
    assert got == {
        ("b", "renamed", "Chmb Tmp"), ("b", "added", "Door State"), ("c", "retyped", "Humidity"), ("c", "retyped", "Door State"), ("d", "removed", "Humidity"),
    }
    assert schema_changes(traces(spark, []), meta, catalog(spark)).count() == 0


def test_rescue_and_replay(spark):
    files = [("a", ["Air Temp", "Door State", "Remark", "What"], [{"Air Temp": "21,5", "Door State": 1, "Remark": "ok", "What": 7}, {"Air Temp": "ERR", "Door State": None}])]
    strict = {r.record_no: r for r in rescued_table(traces(spark, files), catalog(spark), promote=False).collect()}
    assert strict[0].T_AIR is None and json.loads(strict[0]._rescued) == {"Air Temp": "21,5", "Door State": "1", "What": "7"}
    rows = {r.record_no: r for r in rescued_table(traces(spark, files), catalog(spark)).collect()}
    assert (rows[0].T_AIR, rows[0].DOOR, rows[0].NOTE, json.loads(rows[0]._rescued)) == (21.5, True, "ok", {"What": "7"})
    assert rows[1].T_AIR is None and json.loads(rows[1]._rescued) == {"Air Temp": "ERR"}
    bad = spark.createDataFrame([("a", ["t"], ["nonsense", "[1]", None], 3, "x")], "source_file string, column_names array<string>, records array<string>, row_count long, sensor string")
    assert rescued_table(bad, catalog(spark)).count() == 0


def test_empty_records_and_large_catalogs(spark):
    records = ["{}", '{"t": null, "Air Temp": null}', '{"t": 1, "Air Temp": NaN}', '{"t": 2, "Air Temp": 20, "What": null}', '{"": 7, "Air Temp": 21}']
    raw = spark.createDataFrame([("a", ["t", "Air Temp"], records, 5, "x")], "source_file string, column_names array<string>, records array<string>, row_count long, sensor string")
    got = {r.record_no: (r.time_text, r.T_AIR, r._rescued) for r in rescued_table(raw, catalog(spark)).collect()}
    assert got == {0: (None, None, "{}"), 1: (None, None, "{}"), 2: ("1", None, "{}"), 3: ("2", 20.0, "{}"), 4: (None, 21.0, '{"":"7"}')}
    many = spark.range(1001).selectExpr("concat('S', id) as sensor_code", "concat('S', id) as standard_name", "'NUMERIC' as data_type", "array('') as known_aliases")
    with pytest.raises(ValueError, match="more than 1000"):
        rescued_table(raw, many)


def scan(line, delimiter):
    """A tokenizer that reads one character after the other: fields, or None for broken quoting."""
    fields, i = [], 0
    while True:
        cell = ""
        if line[i : i + 1] == '"':
            i += 1
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"' and line[i + 1 : i + 2] == '"':
                    cell, i = cell + '"', i + 2
                elif line[i] == '"':
                    i += 1
                    break
                else:
                    cell, i = cell + line[i], i + 1
            while line[i : i + 1] == " ":
                i += 1
            if i < len(line) and line[i] != delimiter:
                return None
        else:
            while i < len(line) and line[i] != delimiter:
                if line[i] == '"':
                    return None
                cell, i = cell + line[i], i + 1
        fields.append(cell)
        if i >= len(line):
            return fields
        i += 1


def test_tokenizer_against_a_character_loop():
    rng = random.Random(1)
    lines = ["".join(rng.choice('ab"";; é') for _ in range(rng.choice([0, 3, 10, 40, 200]))) for _ in range(3000)] + ['"' + "x;" * 5000 + '";y', ""]
    got = Lines(pa.array(lines), np.full(len(lines), ord(";")))
    want = [scan(x, ";") for x in lines]
    assert [w is None for w in want] == got.broken.tolist()
    good = ~got.broken
    cells, counts = got.cells(good)
    flat = [c for w in want if w is not None for c in w]
    assert cells.to_pylist() == flat and counts.tolist() == [len(w) for w in want if w is not None]


def test_lines_with_reasons(spark):
    text = [
        "preamble", "t;Air Temp;Door State;Remark", "1.0;20,5;ON;ok", "", "# note", "t;Air Temp;Door State;Remark", '2;"20.5 C";off;"a ""b"" c"', "3;1.2E;ON;x", "4;20;ON",
        '5;"20;ON;x', '6;2"0;ON;x', "n/a;20;ON;x", "7;n/a;;-", "8;20;MAYBE;x", None, '9;"20"x;ON;x', " 10 ; +2.05E+01 ; 1 ; any;", "11;20;0;" + "long " * 20000,
    ]
    lines = spark.createDataFrame([("f", i, t, 1) for i, t in enumerate(text)], "source_file string, line_no int, line_text string, header_no int")
    meta = metadata(spark, ("f", None, None)).withColumn("header_row_index", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    args = (lines.union(lines), meta, traces(spark, []), catalog(spark))
    got = {r.line_no: r.reason for r in rawlines.rejected_lines(*args).collect()}
    assert got == {7: "invalid_value", 8: "column_count", 9: "broken_quoting", 10: "broken_quoting", 11: "invalid_value", 13: "invalid_value", 15: "broken_quoting", 16: "column_count"}
    at = {r.line_no: r.error_at for r in rawlines.reject_report(*args).collect()}
    # a bad cell begins there, a short line ends there, an open quote is missed at the end, a stray one stands there, a surplus field's delimiter
    assert at == {7: 2, 8: 7, 9: 10, 10: 3, 11: 0, 13: 5, 15: 6, 16: 25}
    rows = {r.line_no: r for r in rawlines.valid_rows(*args).collect()}
    assert set(rows) == {2, 6, 12, 17} and json.loads(rows[6].record) == {"t": "2", "Air Temp": "20.5 C", "Door State": "off", "Remark": 'a "b" c'}
    count = rawlines.usable_counts(*args).collect()
    assert [(r.data_row_count, r.usable_row_count) for r in count] == [(12, 4)]
    assert rawlines.rejected_lines(lines.limit(0), *args[1:]).count() == 0


def test_more_words_than_the_catalog_has():
    k = SensorNames([("SP_AIR", "SP_AIR"), ("Setpoint", "SP_AIR"), ("Humidity", "RH"), ("Oxygen", "O2")])
    assert k.code("SetPt") == "SP_AIR" and k.code("Set Temp") == "?settemp"


def test_kind_of_columns_the_catalog_lacks(spark):
    head = ["What", "Flag", "Text", "Never"]
    records = [dict(zip(head, r)) for r in ((1, True, "a", None), (2, False, "b", None), ("ERR", "??", 3, None), (None, None, None, None))]
    text = [";".join(["t", *head]), "1;5,5;ON;x;x", "2;#REF;ON;x;x", "3;5;MAYBE;x;x", "4;-;off;7;?"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "source_file string, line_no int, line_text string")
    meta = metadata(spark, ("f", None, None)).selectExpr("* except (header_row_index)", "0 as header_row_index")
    args = (lines, meta, traces(spark, [("g", head, records)]), catalog(spark))
    assert {(r.line_no, r.reason) for r in rawlines.rejected_lines(*args).collect()} == {(2, "invalid_value"), (3, "invalid_value")}
    assert {r.line_no for r in rawlines.valid_rows(*args).collect()} == {1, 4}
    assert [(r.data_row_count, r.usable_row_count) for r in rawlines.usable_counts(*args).collect()] == [(4, 2)]


def test_report_says_what_the_ingestion_did(spark):
    files = [("a", ["Air Temp"], [{"Air Temp": 1.5}]), ("b", ["Chmb Tmp", "What"], [{"Chmb Tmp": "21,5", "What": 1}, {"Chmb Tmp": "ERR"}, {"Chmb Tmp": 4}])]
    meta = metadata(spark, *[(f, None, None) for f, _, _ in files])
    got = {r.channel_name: (r.change_kind, r.sensor, r.typed, r.promoted, r.rescued) for r in schema_report(traces(spark, files), meta, catalog(spark)).collect()}
    assert got == {"Chmb Tmp": ("renamed", "T_AIR", 1, 1, 1), "What": ("added", None, 0, 0, 1)}
