"""Scalar functions on logged text: numbers, timestamp formats, units; as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as the loaders read one: blanks around, sign, decimal point or comma, exponent; inf and nan count.
NUMERIC = r"^\s*[+-]?(([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)\s*$"
DELIMITERS = (",", "\t", ";", "|")
#: Timestamp formats by pattern, tried in this order.
FORMAT_PATTERNS = (
    ("ISO 8601 with microseconds", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+"),
    ("ISO 8601", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"),
    ("ISO 8601 space", r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"),
)
SLASH_TIME, SLASH_DATE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
WHOLE, DECIMAL = r"^-?[0-9]+$", r"^-?[0-9]*\.[0-9]+$"


def is_numeric(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(NUMERIC), F.lit(False))


def to_number(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def timestamp_format(text: Column) -> Column:
    """Name of the format of one value; a number between 25569 and 100000 is an Excel date, above 1e9 an epoch."""
    value = F.trim(text)
    number = value.try_cast("double")
    first = F.split(value, "/")[0].try_cast("int")
    order = lambda tail: F.when(first > 12, "DD/MM/YYYY" + tail).otherwise("MM/DD/YYYY" + tail)
    numeric = F.when((number > 25569) & (number < 100000), "Excel serial date").when(number > 1e9, "Epoch seconds").otherwise("elapsed_seconds")
    out = F.when(value.rlike(SLASH_TIME), order(" HH:MM:SS")).when(value.rlike(SLASH_DATE), order("")).when(value.rlike(WHOLE) | value.rlike(DECIMAL), numeric).otherwise("unknown")
    for name, pattern in reversed(FORMAT_PATTERNS):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return F.when(value.isNull() | (value == ""), "unknown").otherwise(out)


def parse_timestamp(text: Column, kind: Column) -> Column:
    """The value as TIMESTAMP_NTZ under a format's name; elapsed seconds count from 2000-01-01, what can't be read is null."""
    value = F.trim(text)
    number = value.try_cast("double")
    from_us = lambda us: F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")
    iso = F.try_to_timestamp(F.regexp_replace(F.substring(value, 1, 26), " ", "T"))
    parts = [F.regexp_extract(value, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?: ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?", i) for i in range(1, 7)]
    whole = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    made = lambda month, day: F.try_make_timestamp_ntz(whole(parts[2]), whole(month), whole(day), whole(parts[3]), whole(parts[4]), whole(parts[5]).cast("double"))
    return (
        F.when(kind.startswith("ISO"), iso.cast("timestamp_ntz"))
        .when(kind.startswith("DD/MM"), made(parts[1], parts[0]))
        .when(kind.startswith("MM/DD"), made(parts[0], parts[1]))
        .when(kind == "Excel serial date", from_us(F.round((number - 25569) * 86_400_000_000.0)))
        .when(kind == "Epoch seconds", F.when(number < 1e11, from_us(F.round(number * 1e6))))
        .when(kind == "elapsed_seconds", from_us(F.round(number * 1e6) + F.lit(946_684_800_000_000)))
    )


def temperature_unit(name: Column) -> Column:
    """Unit a column name tells: F and K patterns first, else C. Any f after temp counts as Fahrenheit, as it does there."""
    low = F.lower(name)
    return F.when(low.rlike(r"temp.*f|fahrenheit|°f|deg ?f"), "F").when(low.rlike(r"temp.*\(?\s*k\)?$|kelvin|\(k\)"), "K").otherwise("C")


def to_celsius(value: Column, unit: Column) -> Column:
    return F.when(unit == "F", (value - 32) * 5 / 9).when(unit == "K", value - 273.15).otherwise(value)
