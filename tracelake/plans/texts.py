"""Queries of the text loaders' operators on the whole of raw_lines, reading_stamps and the channel names, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import texts
from tracelake.operators import columns, drift
from tracelake.session import table

Query = Callable[[SparkSession, str], DataFrame]
HEAD_LINES = 20


def header_scan(raw_lines: DataFrame) -> DataFrame:
    """Per file the first line with at least two tab fields, none of them numeric, before one that begins with a number."""
    order = Window.partitionBy("source_file").orderBy("line_no")
    lines = raw_lines.filter("source_file is not null").select(
        "source_file", "line_no", F.split("line_text", "\t").alias("own"), F.split(F.lead("line_text").over(order), "\t").alias("following")
    )
    words = F.filter("own", lambda x: F.trim(x) != "")
    head = (F.size("own") >= 2) & (F.size("following") >= 2) & F.forall(words, lambda x: ~texts.is_numeric(x)) & (F.size(words) > 0)
    found = lines.filter(head & texts.is_numeric(F.col("following")[0]))
    return found.groupBy("source_file").agg(F.min("line_no").cast("long").alias("header_row"))


def detect_delimiter(raw_lines: DataFrame) -> DataFrame:
    """Per file the most frequent delimiter of the first five lines; ties go to the earlier of , tab ; |, none is a comma."""
    head = raw_lines.filter("source_file is not null and line_no < 5")
    counted = head.groupBy("source_file").agg(
        *[F.sum(F.coalesce(F.length("line_text") - F.length(F.translate("line_text", d, "")), F.lit(0))).alias(f"d{i}") for i, d in enumerate(texts.DELIMITERS)]
    )
    best = F.greatest(*[F.col(f"d{i}") for i in range(4)])
    choice = F.lit(",")
    for i, name in reversed(list(enumerate((",", "tab", ";", "|")))):
        choice = F.when((F.col(f"d{i}") == best) & (best > 0), name).otherwise(choice)
    return counted.select("source_file", choice.alias("delimiter"))


def data_start(raw_lines: DataFrame) -> DataFrame:
    """Per file the first of HEAD_LINES lines of which more than half of the non-empty fields are numbers, else 0."""
    fields = F.filter(F.split("line_text", "[,\t;|]"), lambda x: F.trim(x) != "")
    numeric = F.size(F.filter(fields, lambda x: texts.is_numeric(x)))
    lines = raw_lines.filter(f"source_file is not null and line_no < {HEAD_LINES}")
    hit = F.when((F.size(fields) > 0) & (numeric * 2 > F.size(fields)), F.col("line_no"))
    return lines.groupBy("source_file").agg(F.coalesce(F.min(hit), F.lit(0)).cast("long").alias("data_start"))


def stamp_formats(reading_stamps: DataFrame) -> DataFrame:
    """Per file the format of its first value."""
    first = reading_stamps.filter("source_file is not null").groupBy("source_file").agg(F.min_by("stamp_text", F.struct("line_no", "reading_id")).alias("v"))
    return first.select("source_file", texts.timestamp_format(F.col("v")).alias("timestamp_format"))


def parsed_stamps(reading_stamps: DataFrame) -> DataFrame:
    """Every value under its own format."""
    kind = texts.timestamp_format(F.col("stamp_text"))
    return reading_stamps.select("reading_id", kind.alias("kind"), texts.parse_timestamp(F.col("stamp_text"), kind).alias("ts")).distinct()


def column_detect(raw_traces: DataFrame) -> DataFrame:
    """Per file the first column whose name has a keyword of time, temperature and setpoint; time falls back to the first column."""
    key = lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("_"))
    first = lambda words: F.get(F.filter("column_names", lambda x: key(x).rlike(words)), F.lit(0))
    return raw_traces.filter("source_file is not null").select(
        "source_file",
        F.coalesce(first("time|elapsed|seconds|timestamp|date"), F.get("column_names", F.lit(0))).alias("time_column"),
        first("chamber|temp|air").alias("temperature_column"),
        first("setpoint|set_point|target|_sp$|^sp_").alias("setpoint_column"),
    )


def temp_convert(trace_rows: DataFrame) -> DataFrame:
    """Mean temperature of each channel in °C by the unit its name tells."""
    unit = texts.temperature_unit(F.col("channel"))
    value = F.when(~F.isnan("temperature_c_raw"), F.col("temperature_c_raw"))
    return trace_rows.filter("channel is not null").groupBy("channel").agg(
        F.first(unit).alias("unit"), F.round(F.avg(texts.to_celsius(value, unit)), 4).alias("mean_c"), F.count(value).alias("n")
    )


def trace_celsius(trace_rows: DataFrame) -> DataFrame:
    """Every row once with its temperature in °C by the unit its channel's name tells; null and NaN stay null."""
    value = F.when(~F.isnan("temperature_c_raw"), F.col("temperature_c_raw"))
    rows = trace_rows.filter("trace_id is not null and row_idx is not null and channel is not null").groupBy("trace_id", "row_idx", "channel").agg(F.min(value).alias("v"))
    unit = texts.temperature_unit(F.col("channel"))
    return rows.select("trace_id", "row_idx", unit.alias("unit"), F.round(texts.to_celsius(F.col("v"), unit), 4).alias("temperature_c"))


def content_columns(raw_traces: DataFrame, least: int = 3) -> DataFrame:
    """Columns by content of the few rows that raw_traces holds of each file (so few values are enough)."""
    cells = drift.cells(raw_traces).select("source_file", F.col("channel_name").alias("column"), F.col("record_no").alias("row_no"), F.expr("variant_get(value, '$', 'string')").alias("text"))
    head = raw_traces.filter("source_file is not null").select("source_file", F.posexplode("column_names").alias("place", "column")).groupBy("source_file", "column").agg(F.min("place").alias("place"))
    return columns.columns_by_content(cells.join(head, ["source_file", "column"]), least)


def is_numeric(raw_lines: DataFrame) -> DataFrame:
    """Per file how many comma-, tab-, semicolon- or bar-separated fields are numbers."""
    fields = raw_lines.filter("source_file is not null").select("source_file", F.explode(F.split("line_text", "[,\t;|]")).alias("f"))
    return fields.groupBy("source_file").agg(F.count(F.lit(1)).alias("fields"), F.count(F.when(texts.is_numeric(F.col("f")), 1)).alias("numbers"))


def queries() -> dict[str, Query]:
    on = lambda name, f: lambda s, d: f(table(s, d, name))
    return {
        "header_scan": on("raw_lines", header_scan),
        "detect_delimiter": on("raw_lines", detect_delimiter),
        "data_start": on("raw_lines", data_start),
        "is_numeric": on("raw_lines", is_numeric),
        "ts_format": on("reading_stamps", stamp_formats),
        "parse_timestamps": on("reading_stamps", parsed_stamps),
        "column_detect": on("raw_traces", column_detect),
        "temp_convert": on("trace_rows", temp_convert),
        "trace_celsius": on("trace_rows", trace_celsius),
        "columns_by_name": on("raw_traces", columns.columns_by_name),
        "columns_by_content": on("raw_traces", content_columns),
        "header_rows": on("raw_lines", columns.header_rows),
    }


_NUM = texts.NUMERIC.replace("'", "''")
_IS = lambda x: f"coalesce(regexp_matches(lower({x}), '{_NUM}'), false)"


def _format_sql(x: str) -> str:
    v = f"trim({x})"
    arms = " ".join(f"WHEN regexp_matches({v}, '{p}') THEN '{n}'" for n, p in texts.FORMAT_PATTERNS)
    first = f"TRY_CAST(split_part({v}, '/', 1) AS INTEGER) > 12"
    return f"""CASE WHEN {v} IS NULL OR {v} = '' THEN 'unknown' {arms}
        WHEN regexp_matches({v}, '{texts.SLASH_TIME}') THEN CASE WHEN {first} THEN 'DD/MM/YYYY HH:MM:SS' ELSE 'MM/DD/YYYY HH:MM:SS' END
        WHEN regexp_matches({v}, '{texts.SLASH_DATE}') THEN CASE WHEN {first} THEN 'DD/MM/YYYY' ELSE 'MM/DD/YYYY' END
        WHEN regexp_matches({v}, '{texts.WHOLE}') OR regexp_matches({v}, '{texts.DECIMAL}') THEN
             CASE WHEN TRY_CAST({v} AS DOUBLE) > 25569 AND TRY_CAST({v} AS DOUBLE) < 100000 THEN 'Excel serial date' WHEN TRY_CAST({v} AS DOUBLE) > 1e9 THEN 'Epoch seconds' ELSE 'elapsed_seconds' END
        ELSE 'unknown' END"""


def oracle_sql() -> dict[str, str]:
    split = "string_split_regex(line_text, '[,\t;|]')"
    key = "replace(lower(x), ' ', '_')"
    first = lambda words: f"list_filter(column_names, lambda x: regexp_matches({key}, '{words}'))[1]"
    counts = ", ".join(f"sum(coalesce(length(line_text) - length(replace(line_text, '{d}', '')), 0)) AS d{i}" for i, d in enumerate(texts.DELIMITERS))
    unit = "CASE WHEN regexp_matches(lower(channel), 'temp.*f|fahrenheit|°f|deg ?f') THEN 'F' WHEN regexp_matches(lower(channel), 'temp.*\\(?\\s*k\\)?$|kelvin|\\(k\\)') THEN 'K' ELSE 'C' END"
    value = "CASE WHEN NOT isnan(temperature_c_raw) THEN temperature_c_raw END"
    by_name = lambda patterns: "coalesce(" + ", ".join(f"list_filter(column_names, lambda x: regexp_matches(lower(x), '{p}'))[1]" for p in patterns) + ")"
    words = f"list_filter(f, lambda x: NOT {_IS('trim(x)')})"
    return {
        "trace_celsius": f"SELECT trace_id, row_idx, unit, round(CASE unit WHEN 'F' THEN (v - 32) * 5 / 9 WHEN 'K' THEN v - 273.15 ELSE v END, 4) AS temperature_c FROM (SELECT trace_id, row_idx, any_value({unit}) AS unit, min({value}) AS v FROM trace_rows WHERE trace_id IS NOT NULL AND row_idx IS NOT NULL AND channel IS NOT NULL GROUP BY trace_id, row_idx, channel) q",
        "columns_by_name": f"SELECT source_file, {by_name(columns.TIME_NAMES)} AS time_column, {by_name(columns.TEMPERATURE_NAMES)} AS temperature_column, {by_name(columns.SETPOINT_NAMES)} AS setpoint_column FROM raw_traces WHERE source_file IS NOT NULL",
        "header_rows": f"""
            SELECT source_file, CAST(CASE WHEN bool_or(line_no = 0 AND len(f) - len({words}) >= 2) THEN 0 ELSE coalesce(min(CASE WHEN len({words}) >= 2 THEN line_no END), 0) END AS BIGINT) AS header_rows
            FROM (SELECT source_file, line_no, list_filter(string_split(line_text, ','), lambda x: trim(x) <> '') AS f FROM raw_lines WHERE source_file IS NOT NULL AND line_no < 20) q GROUP BY source_file""",
        "header_scan": f"""
            SELECT source_file, CAST(min(line_no) AS BIGINT) AS header_row
            FROM (SELECT source_file, line_no, string_split(line_text, '\t') AS own, string_split(lead(line_text) OVER (PARTITION BY source_file ORDER BY line_no), '\t') AS following
                  FROM raw_lines WHERE source_file IS NOT NULL) q
            WHERE len(own) >= 2 AND len(following) >= 2 AND len(list_filter(own, lambda x: trim(x) <> '')) > 0
              AND len(list_filter(own, lambda x: trim(x) <> '' AND {_IS('x')})) = 0 AND {_IS('following[1]')} GROUP BY source_file""",
        "detect_delimiter": f"""
            SELECT source_file, CASE WHEN greatest(d0, d1, d2, d3) = 0 THEN ',' WHEN d0 = greatest(d0, d1, d2, d3) THEN ',' WHEN d1 = greatest(d0, d1, d2, d3) THEN 'tab'
                   WHEN d2 = greatest(d0, d1, d2, d3) THEN ';' ELSE '|' END AS delimiter
            FROM (SELECT source_file, {counts} FROM raw_lines WHERE source_file IS NOT NULL AND line_no < 5 GROUP BY source_file) q""",
        "data_start": f"""
            SELECT source_file, CAST(coalesce(min(CASE WHEN len(f) > 0 AND len(list_filter(f, lambda x: {_IS('x')})) * 2 > len(f) THEN line_no END), 0) AS BIGINT) AS data_start
            FROM (SELECT source_file, line_no, list_filter({split}, lambda x: trim(x) <> '') AS f FROM raw_lines WHERE source_file IS NOT NULL AND line_no < {HEAD_LINES}) q GROUP BY source_file""",
        "is_numeric": f"SELECT source_file, count(*) AS fields, count(CASE WHEN {_IS('f')} THEN 1 END) AS numbers FROM (SELECT source_file, unnest({split}) AS f FROM raw_lines WHERE source_file IS NOT NULL) q GROUP BY source_file",
        "ts_format": f"SELECT source_file, {_format_sql('v')} AS timestamp_format FROM (SELECT source_file, stamp_text AS v, row_number() OVER (PARTITION BY source_file ORDER BY line_no, reading_id) AS nth FROM reading_stamps WHERE source_file IS NOT NULL) q WHERE nth = 1",
        "column_detect": f"SELECT source_file, coalesce({first('time|elapsed|seconds|timestamp|date')}, column_names[1]) AS time_column, {first('chamber|temp|air')} AS temperature_column, {first('setpoint|set_point|target|_sp$|^sp_')} AS setpoint_column FROM raw_traces WHERE source_file IS NOT NULL",
        "temp_convert": f"SELECT channel, unit, round(avg(CASE unit WHEN 'F' THEN (v - 32) * 5 / 9 WHEN 'K' THEN v - 273.15 ELSE v END), 4) AS mean_c, count(v) AS n FROM (SELECT channel, {unit} AS unit, {value} AS v FROM trace_rows WHERE channel IS NOT NULL) q GROUP BY channel, unit",
    }
