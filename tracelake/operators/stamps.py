"""Mixed timestamp formats and time zones: a dictionary of distinct strings, parsed once, joined back to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators._groups import salted_join
from tracelake.session import file_system, kept_folder, materialize

MINUTE_US, HOUR_US, DAY_US = 60_000_000, 3_600_000_000, 86_400_000_000
#: Sums over instants are taken from here on (2020-09-13), so that they stay exact enough.
ORIGIN_US = 1_600_000_000_000_000
#: A clock that was never set counts from here: such a wall time is no real time.
UNSET_CLOCK_US = 0
#: Minutes east of UTC of zone abbreviations.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "IST": 330, "JST": 540, "AEST": 600, "AEDT": 660, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300,
    "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_TIME = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?"
_ZONE = r"\s*([A-Za-z]{1,5}|[+-]\d\d:?\d\d)?"
#: Formats by name: the pattern and which group is year, month, day, hour, minute, second, fraction, half of day, zone.
FORMATS = {
    "iso": (rf"^(\d{{4}})-(\d\d)-(\d\d)[Tt ]{_TIME}{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    "compact": (rf"^(\d{{4}})(\d\d)(\d\d)[Tt]?(\d\d)(\d\d)(\d\d)(?:[.,](\d{{1,9}}))?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    "month_name": (
        rf"^(?:[A-Za-z]{{3}},?\s+)?(\d{{1,2}})[- ]([A-Za-z]{{3}})[- ](\d{{4}}|\d\d)\s+{_TIME}{_ZONE}$",
        (3, 2, 1, 4, 5, 6, 7, 0, 8),
    ),
    "slash": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})[ T]{_TIME}\s*([AaPp][Mm])?{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    "dot": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_TIME}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    "number": (r"^(\d{1,19})(?:[.,](\d+))?$", (1, 0, 0, 0, 0, 0, 2, 0, 0)),
}
#: What a format's parts are joined by once it is told.
_SEAM = "\u0001"


def zone_rule(tz_name: Column, clock_note: Column) -> Column:
    """How a logger's clock runs: 'UTC', 'std:<zone>' (standard time all year) or '<zone>' (civil time)."""
    note = F.lower(F.coalesce(clock_note, F.lit("")))
    return (
        F.when(note.rlike(r"\b(utc|gmt|zulu|universal)\b"), "UTC")
        .when(tz_name.isNull(), "UTC")
        .when(note.rlike(r"standard|winter|no (summer|dst|daylight)|never moved|without dst"), F.concat(F.lit("std:"), tz_name))
        .otherwise(tz_name)
    )


def _us(local: Column) -> Column:
    return F.unix_micros(local.cast("timestamp"))


def _wall_us(month: str, day: str) -> Column:
    """Microseconds of a wall time read as UTC, by days since 1970 in the Gregorian calendar; null if there is no such time."""
    leap = "y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0)"
    length = f"CASE WHEN {month} IN (4, 6, 9, 11) THEN 30 WHEN {month} <> 2 THEN 31 WHEN {leap} THEN 29 ELSE 28 END"
    real = f"{month} BETWEEN 1 AND 12 AND {day} >= 1 AND {day} <= {length} AND h < 24 AND mi < 60 AND s < 60 AND y >= 1"
    year = f"(y - CASE WHEN {month} <= 2 THEN 1 ELSE 0 END)"
    days = f"({year} * 365 + {year} div 4 - {year} div 100 + {year} div 400 + (153 * (({month} + 9) % 12) + 2) div 5 + {day} - 719469)"
    return F.expr(f"CASE WHEN {real} THEN (({days} * 24L + h) * 60L + mi) * 60000000L + s * 1000000L + micro END")


def _zone_minutes(text: Column) -> Column:
    """Minutes east of UTC a zone text says, null for none (or one that says nothing)."""
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(text, r"\D", "")
    numeric = sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))
    names = F.create_map(*[F.lit(x) for item in ZONE_MINUTES.items() for x in item])
    return F.when(text.rlike(r"^[+-]"), numeric).otherwise(F.try_element_at(names, F.upper(text)))


def _standard_offset_us(zone: Column) -> Column:
    """Offset of a zone's standard time: the smaller of January's and July's (summer time is ahead)."""
    at = lambda day: _us(F.lit(day).cast("timestamp")) - _us(F.to_utc_timestamp(F.lit(day).cast("timestamp"), zone))
    return F.least(at("2024-01-01 12:00:00"), at("2024-07-01 12:00:00"))


def _instants(wall: Column, rule: Column) -> tuple[Column, Column]:
    """The instant of a wall time under a zone rule, and a second one if the wall time occurs twice.

    A wall time that was skipped gets the offset before the change.
    """
    zone = F.regexp_replace(rule, "^std:", "")
    local = F.timestamp_micros(wall)
    civil = _us(F.to_utc_timestamp(local, zone))
    back = lambda later: _us(F.from_utc_timestamp(F.timestamp_micros(civil + later), zone)) == wall
    again = F.when(back(HOUR_US), civil + HOUR_US).when(back(HOUR_US // 2), civil + HOUR_US // 2)
    first = (
        F.when(wall.isNull(), None).when(rule == "UTC", wall).when(rule.startswith("std:"), wall - _standard_offset_us(zone)).otherwise(civil)
    )
    return first, F.when(wall.isNull() | (rule == "UTC") | rule.startswith("std:"), None).otherwise(again)


def parse_strings(strings: DataFrame) -> DataFrame:
    """Every (text, rule) with the instants it can mean, in microseconds.

    dmy_us, dmy_again_us: read day first, and its second occurrence; mdy_us, mdy_again_us: read month first (only for
    formats that don't tell); ordered: the format tells the order of day and month; half_day: it has AM or PM.

    A text is matched once by each format until one takes it; its parts then stand in place of it, and all else is
    arithmetic on them.
    """
    tagged = F.col("text")
    for name, (pattern, places) in FORMATS.items():
        tagged = F.regexp_replace(tagged, pattern, _SEAM + _SEAM.join([name, *(f"${p}" if p else "" for p in places)]))
    told = strings.select("text", "rule", tagged.alias("t")).select("text", "rule", F.when(F.col("t").startswith(_SEAM), F.split("t", _SEAM)).alias("p"))
    part = lambda k: F.col("p")[k]
    whole = lambda k: part(k).try_cast("int")
    kind = part(1)
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(3))).cast("int")
    hour = (
        F.when(part(9) == "", whole(5))
        .when((whole(5) < 1) | (whole(5) > 12), None)
        .otherwise(F.pmod(whole(5), F.lit(12)) + F.when(F.upper(part(9)) == "PM", 12).otherwise(0))
    )
    read = told.select(
        "text", "rule", kind.alias("kind"),
        F.when(F.length(part(2)) == 2, whole(2) + 2000).otherwise(whole(2)).alias("y"),
        F.when(kind == "month_name", named).otherwise(whole(3)).alias("b"), whole(4).alias("a"), hour.alias("h"), whole(6).alias("mi"),
        F.coalesce(whole(7), F.lit(0)).alias("s"), F.when(part(8) == "", 0).otherwise(F.rpad(part(8), 6, "0").try_cast("int")).alias("micro"),
        (part(9) != "").alias("half_day"), _zone_minutes(part(10)).alias("minutes"),
        F.when(kind == "number", part(2).try_cast("bigint")).alias("n"),
        # twelve digits of the fraction: of a day they are exact to a tenth of a microsecond
        F.when(kind == "number", F.rpad(part(8), 12, "0").try_cast("bigint")).alias("part12"),
    )
    n, part12 = F.col("n"), F.coalesce("part12", F.lit(0))
    epoch = (
        F.when(n.between(10**9, 10**10 - 1), n * 10**6 + F.floor(part12 / 10**6))
        .when(n.between(10**12, 10**13 - 1), n * 10**3 + F.floor(part12 / 10**9))
        .when(n.between(10**15, 10**16 - 1), n)
        .when(n >= 10**18, F.expr("n div 1000"))
    ).cast("long")
    serial = F.when(n.between(30000, 60000), (n - 25569) * DAY_US + F.round(part12 * 0.0864).cast("long"))
    dated = F.col("kind") != "number"
    timed = read.select(
        "text", "rule", "kind", "minutes", "half_day", epoch.alias("epoch"), F.when(dated, _wall_us("b", "a")).otherwise(serial).alias("dmy"),
        F.when(F.col("kind").isin("slash", "dot"), _wall_us("a", "b")).alias("mdy"),
    )
    real = lambda c: F.when(F.col(c) != UNSET_CLOCK_US, F.col(c)).alias(c)
    timed = timed.select("text", "rule", "kind", "minutes", "half_day", "epoch", real("dmy"), real("mdy"))
    out = {}
    for order in ("dmy", "mdy"):
        first, again = _instants(F.col(order), F.col("rule"))
        said = F.col(order) - F.col("minutes").cast("long") * MINUTE_US
        out[order] = F.when(F.col("minutes").isNotNull(), said).otherwise(first)
        out[f"{order}_again"] = F.when(F.col("minutes").isNull(), again)
    out["dmy"] = F.coalesce(F.col("epoch"), out["dmy"])
    return timed.select(
        "text", "rule", *[c.alias(f"{name}_us") for name, c in out.items()], (~F.coalesce(F.col("kind").isin("slash", "dot"), F.lit(False))).alias("ordered"),
        F.coalesce("half_day", F.lit(False)).alias("half_day"),
    )


def stamp_dictionary(strings: DataFrame, folder: str | None = None) -> DataFrame:
    """The parsed dictionary of distinct (text, rule).

    Kept in a folder (Parquet), it is extended by the strings it lacks and those alone are parsed; without one it is
    written to the shared folder for this run.
    """
    distinct = strings.select("text", "rule").distinct()
    if folder is None:
        return materialize(parse_strings(distinct))
    spark = strings.sparkSession
    files, path = file_system(spark, folder)
    if files.exists(path):
        distinct = distinct.join(spark.read.parquet(folder).select("text", "rule").hint("merge"), ["text", "rule"], "left_anti")
    parse_strings(distinct).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def session_dictionary(spark) -> str:
    """The folder of the dictionary that the queries of an application share and extend, one query at a time."""
    return kept_folder(spark, "stamp-dictionary")


def normalised_stamps(
    reading_stamps: DataFrame,
    file_metadata: DataFrame,
    loggers: DataFrame,
    dictionary_folder: str | None = None,
    earliest_us: int | None = None,
    latest_us: int | None = None,
) -> DataFrame:
    """One UTC instant per reading: (reading_id, source_file, line_no, stamp_text, utc_us), utc_us null for no real time.

    Stamps without zone follow the logger's clock (UTC where logger or zone is unknown). The order of day and month is
    decided per file: by stamps that only one order can read, else by which order puts the file's last reading nearest
    before its earliest registration, else day first (month first with AM/PM). Instants outside earliest_us and
    latest_us, where given, are no real times. An hour that occurs twice
    is told apart by the straight line of instant over line_no through the file's other stamps (readings are evenly
    spaced); without two such stamps the earlier one holds. Null, empty and junk stamps have no instant; rows
    delivered twice come out twice here (once in reading_instants); null line_no only loses the tie-breaking;
    empty tables stay empty. Per-file facts are partial aggregates, joined back with the rows of a file spread. Loggers,
    files and the dictionary all grow with the readings: none is broadcast, however small the estimate of it.
    """
    files = file_metadata.filter("source_file is not null").groupBy("source_file").agg(
        F.min("logger_id").alias("logger_id"), _us(F.min("ingested_at")).alias("ingested_us")
    )
    clocks = loggers.filter("logger_id is not null").groupBy("logger_id").agg(
        F.min("tz_name").alias("tz_name"), F.min("clock_note").alias("clock_note")
    )
    rules = files.join(clocks.hint("merge"), "logger_id", "left").select(
        "source_file", "ingested_us", zone_rule(F.col("tz_name"), F.col("clock_note")).alias("rule")
    )
    text = F.regexp_replace("stamp_text", r"^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$", "")
    stamps = reading_stamps.select("reading_id", "source_file", "line_no", "stamp_text", text.alias("text"))
    placed = salted_join(stamps, rules.hint("merge"), "source_file", F.xxhash64("reading_id"), "left").withColumn("rule", F.coalesce("rule", F.lit("UTC")))
    book = stamp_dictionary(placed.filter("text is not null"), dictionary_folder)
    for name in ("dmy_us", "dmy_again_us", "mdy_us", "mdy_again_us"):
        inside = F.lit(True) if earliest_us is None else F.col(name) >= earliest_us
        book = book.withColumn(name, F.when(inside & (F.lit(True) if latest_us is None else F.col(name) <= latest_us), F.col(name)))
    # written once: the facts of the files are gathered from it and joined to it
    read = materialize(placed.join(book.hint("merge"), ["text", "rule"], "left").drop("text", "rule"))
    known = F.coalesce("ordered", F.lit(True))

    origin = F.lit(ORIGIN_US)
    instants = {"dmy": ("dmy_us", "dmy_again_us"), "mdy": ("mdy_us", "mdy_again_us")}
    pick = lambda order, k: F.col(instants["dmy"][k]) if order == "dmy" else F.when(known, F.col("dmy_us" if k == 0 else "dmy_again_us")).otherwise(F.col(instants["mdy"][k]))
    lines = []
    for order in instants:
        sure = F.when(pick(order, 1).isNull(), (pick(order, 0) - origin) / F.lit(1e6))
        at = F.col("line_no").cast("double")
        lines += [F.regr_slope(sure, at).alias(f"{order}_slope"), F.regr_intercept(sure, at).alias(f"{order}_base")]
    only = lambda a, b: F.count(F.when(~known & F.col(a).isNotNull() & F.col(b).isNull(), 1))
    facts = read.groupBy("source_file").agg(
        only("dmy_us", "mdy_us").alias("dmy_only"),
        only("mdy_us", "dmy_us").alias("mdy_only"),
        F.max(F.when(~known, F.col("dmy_us"))).alias("dmy_last"),
        F.max(F.when(~known, F.col("mdy_us"))).alias("mdy_last"),
        F.min("ingested_us").alias("registered_us"),
        F.max(F.coalesce("half_day", F.lit(False))).alias("some_half_day"),
        *lines,
    )
    lag = lambda c: F.col("registered_us") - F.col(c)
    # the last reading may lie within the day of registration in another zone's count
    fits = lambda c: F.coalesce(lag(c) >= -HOUR_US, F.lit(False))
    day_first = (
        F.when(F.col("dmy_only") != F.col("mdy_only"), F.col("dmy_only") > F.col("mdy_only"))
        .when(fits("dmy_last") != fits("mdy_last"), fits("dmy_last"))
        .when(F.coalesce(F.abs(lag("dmy_last")) != F.abs(lag("mdy_last")), F.lit(False)), F.abs(lag("dmy_last")) < F.abs(lag("mdy_last")))
        .otherwise(~F.col("some_half_day"))
    )
    of_order = lambda name: F.when(day_first, F.col(f"dmy_{name}")).otherwise(F.col(f"mdy_{name}"))
    files_told = facts.select("source_file", day_first.alias("day_first"), of_order("slope").alias("slope"), of_order("base").alias("base"))
    joined = salted_join(read, files_told.hint("merge"), "source_file", F.xxhash64("reading_id"), "left")
    dmy = F.coalesce("day_first", F.lit(True))
    us, again = (F.when(dmy, pick("dmy", k)).otherwise(pick("mdy", k)) for k in (0, 1))
    chosen = joined.select("reading_id", "source_file", "line_no", "stamp_text", "slope", "base", us.alias("us"), again.alias("again_us"))
    expected = origin + (F.col("slope") * F.col("line_no") + F.col("base")) * F.lit(1e6)
    later = F.coalesce(F.abs(F.col("again_us") - expected) < F.abs(F.col("us") - expected), F.lit(False))
    return chosen.select(
        "reading_id", "source_file", "line_no", "stamp_text", F.when(later, F.col("again_us")).otherwise(F.col("us")).alias("utc_us")
    )


def reading_instants(reading_stamps: DataFrame, file_metadata: DataFrame, loggers: DataFrame, **options) -> DataFrame:
    """Readings whose stamp is a real time (reading_id, utc_ms), utc_ms rounded to nearest; each reading once."""
    stamps = normalised_stamps(reading_stamps, file_metadata, loggers, **options).filter("utc_us is not null")
    return stamps.select("reading_id", F.floor((F.col("utc_us") + 500) / 1000).cast("long").alias("utc_ms")).distinct()
