"""Which sensor a channel name means."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The catalog is a fixed table of sensors; more rows than this are no catalog.
CATALOG_LIMIT = 100_000
#: What loggers append to a name without meaning another sensor.
DECORATION = re.compile(
    r"(?i)(\s*\(\s*(1/10 )?°?[cfk]\s*\)|\s*\[(deg ?[cf]|kelvin|deci-c|k)\]|[ _]deg\.? ?(fahrenheit|celsius|[cf])\b|_k$"
    r"| x ?10\b|[ _]offset\b|[ _]filtered\b|_\d+(?=$|[ _(\[]))"
)
WORD = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")


def words(name: str) -> tuple[str, ...]:
    """Lower-case words of a name, decoration removed; a digit belongs to the word before it unless set apart."""
    before, name = None, name.strip()
    while before != name:
        before, name = name, DECORATION.sub("", name).strip()
    out: list[str] = []
    for part in re.split(r"[\s_.\-/]+", name):
        out.extend(w.lower() for w in WORD.findall(part))
    return tuple(out)


def _shortens(short: str, word: str) -> bool:
    """short has the first letter of word and otherwise some of its letters in order."""
    if not short or not word or short[0] != word[0] or short.isdigit() != word.isdigit():
        return False
    rest = iter(word)
    return all(c in rest for c in short)


class SensorNames:
    """Names of a catalog, with spellings and abbreviations of them."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.exact: dict[str, str] = {}
        self.spelled: list[tuple[tuple[str, ...], str]] = []
        for name, code in names:
            self.exact.setdefault("".join(words(name)), code)
            self.spelled.append((words(name), code))
        self.seen: dict[str, str] = {}

    def code(self, name: str | None) -> str | None:
        """Sensor code; for a name of no sensor '?' and its letters; None for no name at all."""
        if name is None or not name.strip() or re.match(r"(?i)\s*unnamed", name):
            return None
        if name not in self.seen:
            own = words(name)
            code = self.exact.get("".join(own))
            if code is None:
                fits = {
                    c for w, c in self.spelled if len(w) == len(own) and all(_shortens(a, b) for a, b in zip(own, w))
                }
                if not fits:  # more words than the catalog's name has, as in SetPt for Setpoint
                    fits = {c for w, c in self.spelled if len(w) < len(own) and _shortens("".join(own), "".join(w))}
                code = fits.pop() if len(fits) == 1 else "?" + "".join(own)
            self.seen[name] = code
        return self.seen[name]


def catalog_names(catalog: DataFrame) -> list[tuple[str, str]]:
    """All (name, sensor code) of the catalog, a small fixed table whose size is checked."""
    rows = catalog.select("sensor_code", "standard_name", "known_aliases").limit(CATALOG_LIMIT + 1).collect()
    if len(rows) > CATALOG_LIMIT:
        raise ValueError(f"the channel catalog has more than {CATALOG_LIMIT} rows")
    names: list[tuple[str, str]] = []
    for row in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        names.extend((n, row[0]) for n in (row[0], row[1], *(row[2] or ())) if n)
    return names


def sensor_of(catalog: DataFrame):
    """A column function: channel name → sensor code (see SensorNames.code)."""
    names = catalog_names(catalog)

    @F.pandas_udf("string")
    def resolve(channel: pd.Series) -> pd.Series:
        known = SensorNames(names)
        return channel.map(known.code)

    return resolve
