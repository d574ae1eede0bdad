"""Which column of a file holds time, temperature and setpoint: by prioritised names, and by what the columns contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of names, tried one after the other over all columns.
TEMPERATURE_NAMES = ("^temp$", "^temperature$", "temp.*c", "temperature.*c", r"^tc\d*$", r"^ch\d+$", "temp", "temperature")
SETPOINT_NAMES = ("setpoint", "set.*point", "sp$", "target", "sv$")
TIME_NAMES = ("^time$", "^timestamp$", "^datetime$", "^date.*time$", "^elapsed", "time", "date")
#: Words that speak for a column, in lower case with _ for blanks.
TIME_WORDS = ("time", "elapsed", "seconds", "timestamp", "date")
TEMPERATURE_WORDS = ("temp", "temperature", "chamber", "tc", "thermocouple")
SETPOINT_WORDS = ("setpoint", "sp", "target", "set_point")
#: Values a temperature lies between, least variance of one, least correlation of a setpoint with it, share of steps of time that go up.
LOWEST_C, HIGHEST_C, LEAST_VARIANCE, LEAST_CORRELATION, RISING = -100.0, 200.0, 0.001, 0.3, 0.99
LEAST_VALUES, VARIANCE_VALUES, TIME_VALUES = 10, 1000, 10
TIMESTAMP = r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?|^\s*\d{1,2}[/.]\d{1,2}[/.]\d{4}"


def column_by_name(names: Column, patterns: tuple[str, ...]) -> Column:
    """The first column that the first pattern of all fits; null if none fits any."""
    return F.coalesce(*[F.get(F.filter(names, lambda x: F.lower(x).rlike(p)), F.lit(0)) for p in patterns])


def columns_by_name(raw_traces: DataFrame) -> DataFrame:
    """(source_file, time_column, temperature_column, setpoint_column) by name; null column names fit nothing."""
    names = F.filter("column_names", lambda x: x.isNotNull())
    return raw_traces.filter("source_file is not null").select(
        "source_file", column_by_name(names, TIME_NAMES).alias("time_column"), column_by_name(names, TEMPERATURE_NAMES).alias("temperature_column"),
        column_by_name(names, SETPOINT_NAMES).alias("setpoint_column"),
    )


def _score(name: str, words: tuple[str, ...]) -> Column:
    key = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
    return sum((F.when(F.contains(key, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def columns_by_content(values: DataFrame, least: int = LEAST_VALUES) -> DataFrame:
    """(source_file, time_column, temperature_column, setpoint_column) by what the columns contain.

    values: source_file, column, place (of the column), row_no, text; one row per cell. Time is the first column with a word
    of time in its name, else whose first values are timestamps, else whose numbers rise. The temperature is, of the other
    columns with at least `least` numbers, all between LOWEST_C and HIGHEST_C, that vary or are named so, the one whose
    name says most, then that varies most; without one the first numeric column. The setpoint is chosen likewise among
    those that correlate with it. Cells that are no number count as none; a file without cells has no row. A column is
    aggregated by (file, column), so no file meets in one task but in the choice among its columns.
    """
    cells = values.filter("source_file is not null and column is not null").withColumn("x", F.trim("text").try_cast("double"))
    cells = cells.withColumn("x", F.when(~F.isnan("x") & (F.abs("x") < F.lit(float("inf"))), F.col("x")))
    order = Window.partitionBy("source_file", "column").orderBy("row_no")
    nth = F.sum(F.when(F.col("x").isNotNull(), 1).otherwise(0)).over(order)
    row = F.row_number().over(order)
    step = F.col("x") - F.lag("x").over(order)
    staged = cells.select("*", nth.alias("nth"), row.alias("row"), step.alias("step"))
    rows = staged.groupBy("source_file", "column").agg(
        F.min("place").alias("place"), F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.var_samp(F.when(F.col("nth") <= VARIANCE_VALUES, F.col("x"))).alias("variance"),
        F.coalesce(F.min(F.when((F.col("row") <= TIME_VALUES) & F.col("text").isNotNull(), F.col("text").rlike(TIMESTAMP))), F.lit(False)).alias("stamps"),
        (F.count(F.when(F.col("step") >= 0, 1)) / F.greatest(F.count("step"), F.lit(1))).alias("rising"),
    )
    kind = F.when(_score("column", TIME_WORDS) > 0, 1).when(F.col("stamps"), 2).when((F.col("n") > least) & (F.col("rising") > RISING), 3)
    first = lambda rank: F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "place", "column")))
    timed = rows.groupBy("source_file").agg(first(kind)["column"].alias("time_column"))
    others = rows.join(timed, "source_file").filter(~F.coalesce(F.col("column") == F.col("time_column"), F.lit(False)))
    inside = (F.col("n") >= least) & F.col("lo").between(LOWEST_C, HIGHEST_C) & F.col("hi").between(LOWEST_C, HIGHEST_C)
    named = _score("column", TEMPERATURE_WORDS)
    fits = inside & ((F.coalesce("variance", F.lit(0.0)) > LEAST_VARIANCE) | (named > 0))
    best = F.min(F.when(fits, F.struct((-named).alias("a"), (-F.coalesce("variance", F.lit(0.0))).alias("b"), "place", "column")))
    any_number = F.min(F.when(F.col("n") > least, F.struct("place", "column")))
    warm = others.groupBy("source_file").agg(F.coalesce(best["column"], any_number["column"]).alias("temperature_column"))
    told = timed.join(warm, "source_file", "left")

    whole = cells.join(told, "source_file")
    beside = F.max(F.when(F.col("column") == F.col("temperature_column"), F.col("x"))).over(Window.partitionBy("source_file", "row_no"))
    spread = F.stddev_samp("x") * F.stddev_samp("y")
    correlated = whole.withColumn("y", beside).filter("x is not null and y is not null").groupBy("source_file", "column").agg(
        F.try_divide(F.covar_samp("x", "y"), F.when(spread > 0, spread)).alias("r")
    )
    near = F.abs("r")
    rest = others.join(told.drop("time_column"), "source_file").filter(inside & (F.col("column") != F.col("temperature_column"))).join(correlated, ["source_file", "column"])
    meant = rest.filter(~F.isnan("r") & (near > LEAST_CORRELATION)).groupBy("source_file").agg(
        F.min(F.struct((-_score("column", SETPOINT_WORDS)).alias("a"), (-near).alias("b"), "place", "column"))["column"].alias("setpoint_column")
    )
    return told.join(meant, "source_file", "left").select("source_file", "time_column", "temperature_column", "setpoint_column")


def header_rows(raw_lines: DataFrame, delimiter: str = ",", head: int = 20) -> DataFrame:
    """(source_file, header_rows): lines to skip before the header, the first of the head with two or more fields that are no numbers.

    0 if there is none, or if the first line has two or more numbers. Blank lines and fields count for nothing.
    """
    from tracelake.functions.texts import is_numeric

    fields = F.filter(F.split("line_text", f"[{delimiter}]"), lambda x: F.trim(x) != "")
    numbers = F.size(F.filter(fields, lambda x: is_numeric(F.trim(x))))
    lines = raw_lines.filter(F.col("source_file").isNotNull() & (F.col("line_no") < head)).select(
        "source_file", "line_no", (F.size(fields) - numbers).alias("words"), numbers.alias("numbers")
    )
    found = lines.groupBy("source_file").agg(
        F.min(F.when(F.col("words") >= 2, F.col("line_no"))).alias("at"), F.max(F.when((F.col("line_no") == 0) & (F.col("numbers") >= 2), 1)).alias("data")
    )
    return found.select("source_file", F.when(F.col("data") == 1, 0).otherwise(F.coalesce("at", F.lit(0))).cast("long").alias("header_rows"))
