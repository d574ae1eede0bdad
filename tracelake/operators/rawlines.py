"""Rows that fail to parse: typed rows of a file's lines, and the rest with the reason for failure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.sensors import sensor_of
from tracelake.operators._groups import salted_join
from tracelake.operators._tokens import Lines
from tracelake.operators.drift import UNIT_TEXT, cells

DELIMITERS = ("\t", ";", "|", ",")
NUMBER = rf"^\s*[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?\s*({UNIT_TEXT})?\s*$"
SECONDS = r"^\s*[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?\s*$"
STATE = r"(?i)^\s*(on|off|true|false|0|1)\s*$"
MISSING = r"(?i)^\s*(|-|nan|n/a)\s*$"
_DDL = "source_file string, line_no int, reason string, error_at long, cells array<string>"
_SCHEMA = pa.schema(
    [
        ("source_file", pa.string()), ("line_no", pa.int32()), ("reason", pa.string()), ("error_at", pa.int64()),
        ("cells", pa.list_(pa.large_string())),
    ]
)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        delimiter = np.array([ord(d) for d in batch.column("delimiter").to_pylist()], dtype=np.uint8)
        kinds = batch.column("kinds").to_pylist()
        wanted = np.array([len(k) for k in kinds])
        lines = Lines(batch.column("line_text"), delimiter)
        reason = np.full(n, None, dtype=object)
        reason[lines.fields != wanted] = "column_count"
        reason[lines.broken] = "broken_quoting"
        error_at = np.where(lines.broken, lines.error_at, np.where(lines.fields != wanted, lines.surplus_at(wanted), -1))
        good = np.array([r is None for r in reason])
        cells, counts = lines.cells(good)
        starts = np.concatenate([[0], np.cumsum(counts)])
        if len(cells):
            kind = np.frombuffer("".join(k for k, g in zip(kinds, good) if g).encode(), dtype=np.uint8)
            match = lambda pattern: pc.match_substring_regex(cells, pattern).to_numpy(zero_copy_only=False)
            missing, number, state = match(MISSING), match(NUMBER), match(STATE)
            fine = np.ones(len(cells), dtype=bool)
            fine[kind == ord("N")] = (missing | number)[kind == ord("N")]
            fine[kind == ord("S")] = (missing | state)[kind == ord("S")]
            fine[kind == ord("T")] = match(SECONDS)[kind == ord("T")]
            wrong = np.flatnonzero(~fine)
            line = np.searchsorted(starts, wrong, side="right") - 1
            places = np.flatnonzero(good)
            error_at[places[line[::-1]]] = lines.cell_starts(good)[wrong][::-1]
            reason[places[line]] = "invalid_value"
        valid = np.array([r is None for r in reason[good]])
        sizes = np.zeros(n, dtype=np.int64)
        sizes[np.flatnonzero(good)[valid]] = counts[valid]
        values = cells.filter(pa.array(np.repeat(valid, counts))) if len(cells) else cells
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32()), values)
        lists = pc.if_else(pa.array(sizes > 0), lists, pa.scalar(None, lists.type))
        columns = [batch.column("source_file"), batch.column("line_no"), pa.array(reason, type=pa.string()), pa.array(error_at), lists]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def file_plans(raw_lines: DataFrame, file_metadata: DataFrame, raw_traces: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per file: header line and its number, delimiter, names of the columns and a letter of kind for each.

    The header is the line at header_row_index, the delimiter the one that parts it into the most fields (the known
    column names break ties); T is the time column (the first), N a number, S a state, X any text. The kind is the
    sensor's; for a name the catalog lacks it is the type most of its values have in raw_traces, X if it has none.
    """
    files = file_metadata.filter(F.col("source_file").isNotNull()).groupBy("source_file").agg(F.min("header_row_index").alias("header_no"))
    headers = raw_lines.select("source_file", "line_no", "line_text").join(files, "source_file").filter(F.col("line_no") == F.col("header_no"))
    headers = headers.groupBy("source_file", "header_no").agg(F.min("line_text").alias("header"))
    traces = raw_traces.filter(F.col("source_file").isNotNull()).groupBy("source_file").agg(F.first("column_names", True).alias("names"))
    known = headers.join(traces, "source_file", "left").filter(F.col("header").isNotNull())
    count = lambda d: F.size(F.split("header", f"[{d}]" if d != "|" else "[|]"))
    fits = lambda d: F.when(count(d) == F.size("names"), 1).otherwise(0)
    best = F.array_max(F.array(*[F.struct(fits(d).alias("fits"), count(d).alias("n"), F.lit(-i).alias("at"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]))
    split = known.withColumn("delimiter", best["d"])
    bare = F.transform(
        F.split("header", F.concat(F.lit("["), F.col("delimiter"), F.lit("]"))),
        lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")),
    )
    split = split.withColumn("names", bare)
    resolve = sensor_of(catalog)
    columns = split.select("source_file", F.posexplode("names").alias("at", "name"))
    data_types = catalog.filter("sensor_code is not null").groupBy("sensor_code").agg(F.min("data_type").alias("data_type"))
    names = columns.select("name").distinct().withColumn("sensor_code", resolve("name")).join(data_types, "sensor_code", "left")
    counted = cells(raw_traces).filter("kind is not null").groupBy(F.trim("channel_name").alias("name"), "kind").agg(F.count(F.lit(1)).alias("n"))
    # on ties string comes before number, as any text is allowed then
    logged = counted.groupBy("name").agg(F.max_by("kind", F.struct("n", "kind")).alias("logged"))
    kind = (
        F.when(F.col("at") == 0, "T")
        .when(F.col("data_type") == "NUMERIC", "N")
        .when(F.col("data_type") == "STATE", "S")
        .when(F.col("data_type").isNotNull(), "X")
        .when(F.col("logged") == "number", "N")
        .when(F.col("logged") == "boolean", "S")
        .otherwise("X")
    )
    kinds = columns.join(names.join(logged, "name", "left"), "name", "left").select("source_file", "at", kind.alias("kind"))
    by_file = kinds.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("at", "kind"))).alias("k"))
    letters = by_file.select("source_file", F.array_join(F.transform("k", lambda x: x["kind"]), "").alias("kinds"))
    return split.join(letters, "source_file").select("source_file", "header_no", "header", "delimiter", "names", "kinds")


def judged_lines(raw_lines: DataFrame, file_metadata: DataFrame, raw_traces: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every data line: source_file, line_no, reason (null if valid), error_at, cells (of valid lines), names.

    Data lines follow the header and are not blank, no repeat of the header and don't start with #. reason is, the
    first that holds, broken_quoting, column_count or invalid_value; error_at is the byte of the line (in
    UTF-8) at which the quoting breaks, the surplus field's delimiter stands (or the line ends, with too few) or the first
    wrong cell begins, -1 for a valid line. A null line counts as blank; lines of files without metadata
    or header can't be judged and drop out; a line given twice comes out once; an empty table stays empty. The lines
    of one file are spread over tasks, however many it has.
    """
    plans = file_plans(raw_lines, file_metadata, raw_traces, catalog)
    lines = raw_lines.select("source_file", "line_no", "line_text").filter(F.col("line_text").isNotNull() & F.col("line_no").isNotNull())
    joined = salted_join(lines, plans.select("source_file", "header_no", "header", "delimiter", "kinds"), "source_file", F.col("line_no"))
    data = joined.filter(
        (F.col("line_no") > F.col("header_no"))
        & (F.regexp_replace("line_text", r"[\s\x{feff}]+", "") != "")
        & ~F.col("line_text").startswith("#")
        & (F.trim("line_text") != F.trim("header"))
    )
    ready = data.select("source_file", F.col("line_no").cast("int").alias("line_no"), "line_text", "delimiter", "kinds")
    return ready.mapInArrow(_judge, _DDL)


def rejected_lines(raw_lines: DataFrame, file_metadata: DataFrame, raw_traces: DataFrame, catalog: DataFrame) -> DataFrame:
    judged = judged_lines(raw_lines, file_metadata, raw_traces, catalog)
    return judged.filter("reason is not null").select("source_file", "line_no", "reason").distinct()


def reject_report(raw_lines: DataFrame, file_metadata: DataFrame, raw_traces: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rejected lines with the reason and the byte of the line it was found at (source_file, line_no, reason, error_at)."""
    judged = judged_lines(raw_lines, file_metadata, raw_traces, catalog)
    return judged.filter("reason is not null").select("source_file", "line_no", "reason", "error_at").distinct()


def valid_rows(raw_lines: DataFrame, file_metadata: DataFrame, raw_traces: DataFrame, catalog: DataFrame) -> DataFrame:
    """Valid lines as rows: source_file, line_no, elapsed_s, record (JSON object, missing values as null)."""
    judged = judged_lines(raw_lines, file_metadata, raw_traces, catalog).filter("reason is null").dropDuplicates(["source_file", "line_no"])
    plans = file_plans(raw_lines, file_metadata, raw_traces, catalog).select("source_file", "names")
    rows = salted_join(judged, plans, "source_file", F.col("line_no"))
    cell = lambda c: F.when(~c.rlike(MISSING), F.trim(c))
    numbered = F.transform("names", lambda name, i: F.when(F.array_position("names", name) == i + 1, name).otherwise(F.concat(name, F.lit("#"), i)))
    seconds = F.replace(F.trim(F.col("cells")[0]), F.lit(","), F.lit(".")).try_cast("double")
    record = F.map_from_arrays(numbered, F.transform("cells", cell))
    return rows.select("source_file", "line_no", seconds.alias("elapsed_s"), F.to_json(record).alias("record"))


def usable_counts(raw_lines: DataFrame, file_metadata: DataFrame, raw_traces: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per file: data_row_count and the right usable_row_count; files without data lines have none."""
    judged = judged_lines(raw_lines, file_metadata, raw_traces, catalog).select("source_file", "line_no", "reason").distinct()
    return judged.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("data_row_count"), F.count(F.when(F.col("reason").isNull(), 1)).alias("usable_row_count")
    )
