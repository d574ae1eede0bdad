"""Logged files as tables: delimiter, encoding and header are sniffed on the head, the body is read by Spark."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.texts import NUMERIC

HEAD_BYTES, HEAD_LINES, SKIP_LINES = 65536, 20, 5
#: Tried in this order; the first that gives two columns and a row of data is taken.
LADDER = (("\t", "utf-8"), (",", "utf-8"), (";", "utf-8"), ("|", "utf-8"), ("\t", "latin-1"), (",", "latin-1"), ("\t", "cp1252"))
BOMS = ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8"))


class InputFormatError(ValueError):
    """The file can't be read as a table."""


def _head(spark: SparkSession, path: str) -> bytes:
    """The first HEAD_BYTES of a file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readNBytes(HEAD_BYTES))
    finally:
        stream.close()


def detect_encoding(spark: SparkSession, path: str) -> str:
    """utf-16 or utf-8 by byte order mark, utf-8 without one."""
    head = _head(spark, path)
    return next((name for mark, name in BOMS if head.startswith(mark)), "utf-8")


def _rows(text: str, separator: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text), delimiter=separator))


def sniff(spark: SparkSession, path: str) -> tuple[str, str, int]:
    """Separator, encoding and number of lines before the header.

    A rung fits if, after skipping lines, the header has two or more distinct non-numeric names and the next line as many fields.
    """
    head = _head(spark, path)
    encodings = [detect_encoding(spark, path)] if any(head.startswith(m) for m, _ in BOMS) else None
    for separator, encoding in LADDER:
        if encodings and encoding not in encodings and encodings != ["utf-16"]:
            continue
        try:
            text = head.decode(encodings[0] if encodings else encoding, errors="strict" if encoding == "utf-8" and len(head) < HEAD_BYTES else "ignore")
        except UnicodeDecodeError:
            continue
        rows = _rows(text.lstrip("﻿"), separator)[: HEAD_LINES + SKIP_LINES]
        for skip in range(min(SKIP_LINES + 1, len(rows))):
            names = rows[skip]
            fits = len(names) >= 2 and len(set(names)) == len(names) and not any(re.match(NUMERIC, n.lower()) for n in names)
            if fits and len(rows) > skip + 1 and len(rows[skip + 1]) == len(names):
                return separator, encodings[0] if encodings else encoding, skip
    raise InputFormatError(f"{path}: no separator and encoding give a table")


def load_trace_file(spark: SparkSession, path: str, channel: str | None = None) -> DataFrame:
    """All columns of a delimited file as text; lines with another number of fields are dropped.

    An unknown channel is an error. The lines up to the header are skipped by their number in the file.
    """
    separator, encoding, skip = sniff(spark, path)
    text = _head(spark, path).decode(encoding, errors="ignore").lstrip("﻿")
    names = _rows(text, separator)[skip]
    if channel is not None and channel not in names:
        raise InputFormatError(f"{path}: no channel {channel!r}")
    lines = spark.read.option("encoding", encoding.replace("latin-1", "iso-8859-1")).option("lineSep", "\n").csv(path, sep="\x01", quote="", escape="").toDF("line") if encoding != "utf-8" else spark.read.text(path).toDF("line")
    # lines are numbered from the start of the file's first block; an empty line of a csv read has no row, so those before the header don't count
    numbered = lines.select("line", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    begin = numbered.filter("block = 0").agg(F.min("id")).first()[0] or 0  # one number
    if encoding != "utf-8":
        skip -= sum(line.strip("\r\ufeff") == "" for line in text.split("\n")[:skip])
    own = (F.col("block") > 0) | (F.col("id") > begin + skip)
    body = numbered.filter(own).withColumn("line", F.regexp_replace("line", "^\ufeff|\r$", "")).filter(F.trim("line") != "")
    # Spark marks a line with another number of fields as corrupt; an empty field and an absent one are both null
    fields = F.from_csv("line", ", ".join(f"`c{i}` string" for i in range(len(names))) + ", `bad` string", {"sep": separator, "columnNameOfCorruptRecord": "bad"})
    parsed = body.select(fields.alias("f")).filter("f.bad is null")
    return parsed.select(*[F.col(f"f.c{i}").alias(n) for i, n in enumerate(names)])


def load_log_file(spark: SparkSession, path: str) -> DataFrame:
    """A tab log: text fields as they are, numbers (decimal comma allowed) as doubles where a whole column is numeric."""
    table = load_trace_file(spark, path)
    numeric = lambda n: F.replace(F.col(f"`{n}`"), F.lit(","), F.lit(".")).try_cast("double")
    checks = table.agg(*[(F.count(numeric(n)) == F.count(f"`{n}`")).alias(n) for n in table.columns]).first()
    return table.select(*[numeric(n).alias(n) if checks[n] else F.col(f"`{n}`") for n in table.columns])
