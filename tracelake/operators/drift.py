"""Schemas that drift between files: rescue-column ingestion into one table, and the list of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.sensors import sensor_of
from tracelake.session import materialize

#: Units a number may be followed by.
UNIT_TEXT = r"°?[CFK]|deg ?[CF]|%|m?V|kV|m?A|g|rpm|m?bar|k?Pa|l/min|ms|s"
#: Cells that mean nothing was recorded.
MISSING = ("", "-", "nan", "n/a")
#: The ingested table has a column for each sensor; a catalog of more is an error.
SENSOR_LIMIT = 1000


def files_in_order(file_metadata: DataFrame) -> DataFrame:
    """Each file once with logger_id and its place (1, 2, ...) among the logger's files.

    A file registered twice counts once; files without logger or file_seq have no order and drop out.
    """
    files = file_metadata.filter(F.col("logger_id").isNotNull() & F.col("file_seq").isNotNull() & F.col("source_file").isNotNull())
    once = files.groupBy("source_file").agg(F.min(F.struct("logger_id", "file_seq")).alias("f")).select("source_file", "f.*")
    order = Window.partitionBy("logger_id").orderBy("file_seq", "source_file")
    return once.withColumn("place", F.row_number().over(order))


def cells(raw_traces: DataFrame) -> DataFrame:
    """Every field of every record: source_file, record_no, channel_name, value (variant), kind (JSON type, null for null).

    Records that are no JSON object drop out, one without fields has a row of nulls; NaN and Infinity, which JSON lacks, count as null.
    """
    records = raw_traces.filter(F.col("source_file").isNotNull()).select("source_file", F.posexplode("records").alias("record_no", "record"))
    clean = F.regexp_replace("record", r"(?<=[:,\[]\s?)(NaN|-?Infinity)(?=\s*[,}\]])", "null")
    parsed = records.withColumn("parsed", F.coalesce(F.try_parse_json("record"), F.try_parse_json(clean)))
    parsed = parsed.filter(F.schema_of_variant("parsed").startswith("OBJECT"))
    view = parsed.select("source_file", "record_no", "parsed").alias("r")
    fields = view.lateralJoin(view.sparkSession.tvf.variant_explode_outer(F.col("r.parsed").outer()))
    sort = F.schema_of_variant("value")
    kind = (
        F.when(sort.isNull() | (sort == "VOID"), None)
        .when(sort == "BOOLEAN", "boolean")
        .when(sort == "STRING", "string")
        .when(sort.startswith("OBJECT") | sort.startswith("ARRAY"), "nested")
        .otherwise("number")
    )
    return fields.select("source_file", "record_no", F.col("key").alias("channel_name"), "value", kind.alias("kind"))


def lenient_number(text: Column) -> Column:
    """A number with sign, exponent, decimal point or comma, blanks around, or a unit after it; else null."""
    number = F.regexp_extract(text, rf"^\s*([+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?)\s*(?:{UNIT_TEXT})?\s*$", 1)
    return F.replace(F.when(number != "", number), F.lit(","), F.lit(".")).try_cast("double")


def lenient_state(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin("on", "true", "1"), True).when(word.isin("off", "false", "0"), False)


def ingested_fields(raw_traces: DataFrame, catalog: DataFrame, promote: bool = True) -> DataFrame:
    """Every field of every record as the ingestion places it: source_file, record_no, channel_name, sensor, kind, text, state.

    The target schema is a typed column for each sensor of the catalog. state is 'time' (the first column), 'typed' (the
    JSON type is the column's), 'promoted' (another type, but replaying the rescued text into the column succeeds),
    'rescued' (unknown name, uncastable value, or a second field of a sensor in the record) or 'missing' (no value).
    Columns that the header names come with record_no null besides, state 'header'; nameless ones don't.
    """
    sensors = [(r[0], r[1]) for r in catalog.select("sensor_code", "data_type").filter("sensor_code <> ''").orderBy("sensor_code").limit(SENSOR_LIMIT + 1).collect()]
    if len(sensors) > SENSOR_LIMIT:
        raise ValueError(f"the channel catalog has more than {SENSOR_LIMIT} rows")
    resolve = sensor_of(catalog)
    fields = cells(raw_traces).withColumn("text", F.expr("variant_get(value, '$', 'string')")).drop("value")
    header = raw_traces.filter("source_file is not null").select("source_file", F.posexplode("column_names").alias("at", "channel_name"))
    named = header.filter("at > 0").select(
        "source_file", F.lit(None).cast("int").alias("record_no"), "channel_name", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("text")
    )
    whole = fields.select(named.columns).unionByName(named.distinct())
    first = raw_traces.filter("source_file is not null").groupBy("source_file").agg(F.min(F.get("column_names", F.lit(0))).alias("time_name"))
    names = whole.select("channel_name").distinct().withColumn("sensor", resolve("channel_name"))
    data_type = F.create_map(*[F.lit(x) for s in sensors for x in s])[F.col("sensor")] if sensors else F.lit(None).cast("string")
    known = whole.join(names, "channel_name", "left").join(first, "source_file", "left").withColumn("data_type", data_type)
    of = lambda data_type, test: (F.col("data_type") == data_type) & test
    strict = of("NUMERIC", F.col("kind") == "number") | of("STATE", F.col("kind") == "boolean") | of("TEXT", F.col("kind") == "string")
    readable = of("NUMERIC", lenient_number(F.col("text")).isNotNull()) | of("STATE", lenient_state(F.col("text")).isNotNull()) | (F.col("data_type") == "TEXT")
    state = (
        F.when(F.col("record_no").isNull() & F.col("sensor").isNotNull(), "header")
        .when(F.col("kind").isNull(), "missing")
        .when(F.col("channel_name") == F.col("time_name"), "time")
        .when(F.coalesce(strict, F.lit(False)), "typed")
        .when(F.coalesce(readable, F.lit(False)) & F.lit(promote), "promoted")
        .otherwise("rescued")
    )
    placed = known.withColumn("state", state)
    fits = F.col("state").isin("typed", "promoted")
    nth = F.row_number().over(Window.partitionBy("source_file", "record_no", "sensor", fits).orderBy(F.desc("kind"), "channel_name"))
    return placed.select(
        "source_file", "record_no", "channel_name", "sensor", "kind", "text", F.when(fits & (nth > 1), "rescued").otherwise(F.col("state")).alias("state")
    )


def ingested_channels(raw_traces: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per file and channel name what became of it: sensor, in_header, how many values were typed, promoted and rescued, and kinds.

    kinds are the JSON types that most non-null values have (several on ties), null without values. Written once.
    """
    count = lambda state: F.count(F.when(F.col("state") == state, 1)).alias(state)
    kinds = ("boolean", "nested", "number", "string")
    found = ingested_fields(raw_traces, catalog).filter("channel_name is not null and state <> 'time'").groupBy("source_file", "channel_name").agg(
        F.max("sensor").alias("sensor"), F.max(F.col("state") == "header").alias("in_header"), count("typed"), count("promoted"), count("rescued"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in kinds],
    )
    most = F.greatest(*[F.col(f"n_{k}") for k in kinds])
    top = F.array_compact(F.array(*[F.when((F.col(f"n_{k}") == most) & (most > 0), k) for k in kinds]))
    return materialize(found.select("source_file", "channel_name", "sensor", "in_header", "typed", "promoted", "rescued", F.when(F.size(top) > 0, top).alias("kinds")))


def schema_report(raw_traces: DataFrame, file_metadata: DataFrame, catalog: DataFrame) -> DataFrame:
    """Changes of each file against the file before it of its logger, with what the ingestion did with the channel's values.

    (source_file, change_kind, channel_name, sensor, typed, promoted, rescued), from the channels as ingested (see
    ingested_channels): a known sensor's fields are in its typed column, an unknown name's in the rescue column.
    change_kind is added, removed (old name), renamed (new name) or retyped. Names in both files are no change; of
    the others those of one sensor are paired as renames, the rest is added or removed. retyped compares the JSON
    type most non-null values of a name have (on ties the earlier type, if among them) with the last file in which
    the name had any. Files without order, null and blank column names are left out; a file given twice counts
    once; empty tables give no change. Everything is keyed by (logger, place, sensor or name), so no logger's
    files meet in one task but in the numbering of its files.
    """
    order = files_in_order(file_metadata).join(raw_traces.select("source_file").distinct(), "source_file", "left_semi")
    numbered = order.withColumn("place", F.row_number().over(Window.partitionBy("logger_id").orderBy("place")))
    files = numbered.select("source_file", "logger_id", "place")
    ingested = ingested_channels(raw_traces, catalog).filter("in_header and sensor is not null")
    channels = ingested.join(files, "source_file")
    now = channels.select("logger_id", "place", "channel_name", "sensor")
    then = now.withColumn("place", F.col("place") + 1)
    keys = ["logger_id", "place", "channel_name"]
    rank = F.row_number().over(Window.partitionBy("logger_id", "place", "sensor").orderBy("channel_name")).alias("nth")
    came = now.join(then, keys, "left_anti").filter("place > 1").select("logger_id", "place", "sensor", rank, F.col("channel_name").alias("new"))
    went = then.join(now, keys, "left_anti").select("logger_id", "place", "sensor", rank, F.col("channel_name").alias("old"))
    moved = came.join(went, ["logger_id", "place", "sensor", "nth"], "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("renamed")
    moved = moved.select("logger_id", "place", kind.alias("change_kind"), F.coalesce("new", "old").alias("channel_name"), "sensor")

    earlier = F.lag("kinds").over(Window.partitionBy("logger_id", "channel_name").orderBy("place"))
    typed = channels.filter("kinds is not null").withColumn("earlier", earlier)
    retyped = typed.filter(F.col("earlier").isNotNull() & ~F.arrays_overlap("kinds", "earlier"))
    retyped = retyped.select("logger_id", "place", F.lit("retyped").alias("change_kind"), "channel_name", "sensor")
    changes = moved.unionByName(retyped).join(files, ["logger_id", "place"]).drop("logger_id", "place")
    known = F.when(~F.col("sensor").startswith("?"), F.col("sensor")).alias("sensor")
    done = ingested.select("source_file", "channel_name", "typed", "promoted", "rescued")
    return changes.join(done, ["source_file", "channel_name"], "left").select(
        "source_file", "change_kind", "channel_name", known, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("typed", "promoted", "rescued")]
    )


def schema_changes(raw_traces: DataFrame, file_metadata: DataFrame, catalog: DataFrame) -> DataFrame:
    """(source_file, change_kind, channel_name) of schema_report."""
    return schema_report(raw_traces, file_metadata, catalog).select("source_file", "change_kind", "channel_name")


def rescued_table(raw_traces: DataFrame, catalog: DataFrame, promote: bool = True) -> DataFrame:
    """All records in one table: source_file, record_no, time_text, a typed column per sensor of the catalog, _rescued.

    A field of a known sensor goes to the sensor's column if its JSON type is the column's (number → double for
    NUMERIC, boolean for STATE, string for TEXT). Everything else that is not null - unknown names, other types, a second
    field of a sensor - stays in _rescued, a JSON object by channel name. promote=True then replays rescued fields of
    known sensors into their columns where the text can be read (decimal comma, unit, ON/OFF, 0/1); what still can't be
    stays rescued. Empty and all-null records are rows without values. Records that are no JSON object drop out; an empty table stays empty.
    """
    placed = ingested_fields(raw_traces, catalog, promote).filter("record_no is not null")
    typed = []
    for code, kind in sorted((r[0], r[1]) for r in catalog.select("sensor_code", "data_type").filter("sensor_code <> ''").limit(SENSOR_LIMIT).collect()):
        value = F.max(F.when(F.col("state").isin("typed", "promoted") & (F.col("sensor") == code), F.col("text")))
        value = lenient_number(value) if kind == "NUMERIC" else lenient_state(value) if kind == "STATE" else value
        typed.append(value.alias(code))
    rest = F.collect_list(F.when(F.col("state") == "rescued", F.struct("channel_name", "text")))
    return placed.groupBy("source_file", "record_no").agg(
        F.max(F.when(F.col("state") == "time", F.col("text"))).alias("time_text"),
        *typed,
        F.to_json(F.map_from_entries(F.sort_array(rest))).alias("_rescued"),
    )
