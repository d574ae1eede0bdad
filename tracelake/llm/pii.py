"""Personal information inside free text: found, and replaced by typed placeholders or keyed surrogates."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm import entities, surrogates
from tracelake.operators._groups import salted_join
from tracelake.session import materialize

#: The session setting that holds the secret surrogates and placeholders are made with.
KEY_SETTING = "spark.tracelake.pii.key"
#: Each attempt from the third on makes words of names a syllable longer; so many can't all be taken.
MOST_ATTEMPTS = 40
_DDL = "doc_id long, text_key long, at int, until int, pii_kind string, pii_text string, tag string, atoms array<string>, genders array<string>"
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("text_key", pa.int64()), ("at", pa.int32()), ("until", pa.int32()), ("pii_kind", pa.string()),
        ("pii_text", pa.string()), ("tag", pa.string()), ("atoms", pa.list_(pa.string())), ("genders", pa.list_(pa.string())),
    ]
)


def session_key(spark: SparkSession) -> bytes:
    """The secret of the session (KEY_SETTING); without one the replacements are repeatable by anyone, which is warned of."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        warnings.warn(f"{KEY_SETTING} is unset: surrogates are made without a secret", stacklevel=2)
    return surrogates.KEY if key is None else key.encode()


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def found_entities(documents: DataFrame, key: bytes | None = None) -> DataFrame:
    """Every entity with its place in the text (code points), its placeholder and the atoms that get surrogates, with the gender told of them."""
    key = session_key(documents.sparkSession) if key is None else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _SCHEMA]
            for doc_id, text, text_key in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "text_key"))):
                for e in entities.find(text):
                    parts = surrogates.atoms(e.kind, e.text)
                    row = (doc_id, text_key, e.start, e.end, e.kind, e.text, surrogates.tag(e.kind, parts, key), parts, surrogates.genders(e.kind, e.text, e.gender))
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _SCHEMA)], schema=_SCHEMA)

    return _keyed(documents).filter("text is not null").mapInArrow(run, _DDL)


def surrogate_table(found: DataFrame, key: bytes | None = None) -> DataFrame:
    """(pii_kind, atom, surrogate): no atom keeps its form, and no two atoms of a kind get the same surrogate.

    A surrogate depends on key, kind, atom and, for words of names, the gender most titles before it tell (else what the
    name itself tells). Numbers, e-mail and street addresses are permuted inside their format, so they can't collide
    (in a format all of whose values occur a surrogate may equal another's original). Words of names are checked: where
    several get the same, or one that is the name of somebody else, the first in order keeps it and the others, and only
    they, try again with longer words, until each has its own. Initials go by a permutation of the letters.
    """
    key = session_key(found.sparkSession) if key is None else key

    @F.pandas_udf("string")
    def make(kind: pd.Series, atom: pd.Series, attempt: pd.Series, gender: pd.Series) -> pd.Series:
        told = [surrogates.gender_of(a) if g == "?" else g for a, g in zip(atom, gender)]
        return pd.Series([surrogates.replace_atom(k, a, int(n), key, g) for k, a, n, g in zip(kind, atom, attempt, told)], dtype=object)

    both = F.arrays_zip("atoms", "genders") if "genders" in found.columns else F.transform("atoms", lambda a: F.struct(a.alias("atoms"), F.lit("").alias("genders")))
    parts = found.select("pii_kind", F.explode(both).alias("p")).select("pii_kind", F.col("p.atoms").alias("atom"), F.col("p.genders").alias("g"))
    votes = lambda g: F.count(F.when(F.col("g") == g, 1))
    counted = parts.groupBy("pii_kind", "atom").agg(votes("f").alias("f"), votes("m").alias("m"), F.max(F.col("g") != "").alias("given"))
    gender = F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").when(F.col("given"), "?").otherwise("")
    atoms = materialize(counted.filter("atom is not null").select("pii_kind", "atom", gender.alias("gender")))
    word = (F.col("pii_kind") == "person") & (F.length("atom") > 1)
    settled = [atoms.filter(~word).select("pii_kind", "atom", make("pii_kind", "atom", F.lit(0), "gender").alias("surrogate"))]
    waiting = atoms.filter(word)
    real = waiting.select(F.col("atom").alias("surrogate"), F.lit(True).alias("real"))
    taken: list[DataFrame] = []
    for attempt in range(MOST_ATTEMPTS):
        made = waiting.withColumn("surrogate", make("pii_kind", "atom", F.lit(attempt), "gender")).join(real, "surrogate", "left")
        used = reduce(DataFrame.unionByName, [t.select("surrogate", F.lit(True).alias("used")) for t in taken]) if taken else None
        made = made.join(used, "surrogate", "left") if used is not None else made.withColumn("used", F.lit(None).cast("boolean"))
        order = Window.partitionBy("surrogate").orderBy("atom")
        free = F.col("real").isNull() & F.col("used").isNull() & (F.row_number().over(order) == 1)
        made = materialize(made.select("pii_kind", "atom", "gender", "surrogate", free.alias("free")))
        own = made.filter("free").select("pii_kind", "atom", "surrogate")
        taken.append(own)
        waiting = made.filter("not free").select("pii_kind", "atom", "gender")
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, [*settled, *taken])
    raise RuntimeError(f"names without a surrogate of their own after {MOST_ATTEMPTS} attempts")


def replacements(documents: DataFrame, key: bytes | None = None) -> DataFrame:
    """Every entity with placeholder and surrogate: doc_id, text_key, at, until, pii_kind, pii_text, tag, surrogate."""
    key = session_key(documents.sparkSession) if key is None else key

    @F.pandas_udf("string")
    def render(kind: pd.Series, text: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([surrogates.render(k, t, list(p)) for k, t, p in zip(kind, text, parts)], dtype=object)

    found = materialize(found_entities(documents, key))
    table = surrogate_table(found, key).withColumn("join_key", F.concat_ws("|", "pii_kind", "atom")).drop("pii_kind", "atom")
    parts = found.select("*", F.posexplode("atoms").alias("nth", "atom")).drop("atoms", "genders")
    parts = parts.withColumn("join_key", F.concat_ws("|", "pii_kind", "atom"))
    joined = salted_join(parts, table, "join_key", F.xxhash64("doc_id", "at"))
    whole = joined.groupBy("doc_id", "text_key", "at", "until", "pii_kind", "pii_text", "tag").agg(
        F.sort_array(F.collect_set(F.struct("nth", "surrogate"))).alias("parts")
    )
    names = F.transform("parts", lambda p: p["surrogate"])
    return whole.select(
        "doc_id", "text_key", "at", "until", "pii_kind", "pii_text", "tag", render("pii_kind", "pii_text", names).alias("surrogate")
    )


def personal_information(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, pii_text): each distinct string of a document that the operator replaced."""
    return replacements(documents).filter("surrogate is not null").select("doc_id", "pii_kind", "pii_text").distinct()


def redacted(documents: DataFrame, style: str = "placeholder", key: bytes | None = None) -> DataFrame:
    """Documents with personal information replaced: (doc_id, text), everything else of a text unchanged.

    style 'placeholder' puts [KIND_digest], style 'surrogate' a replacement of the same type, format, script and
    ending; either is the same for the same entity throughout the corpus and differs for different ones. Rows come out
    as they went in: null, empty and blank texts unchanged, repeated rows repeated, null doc_id null; other columns
    are dropped. Texts are searched whole, where they are read; only entities are shuffled until the texts are joined.
    """

    @F.pandas_udf("string")
    def put(text: pd.Series, changes: pd.Series) -> pd.Series:
        def one(t: str | None, spans) -> str | None:
            if t is None or spans is None:
                return t
            out, done = [], 0
            for span in spans:
                at, until, new = (span[k] for k in ("at", "until", "new")) if isinstance(span, dict) else span
                out += [t[done:at], new]
                done = until
            return "".join([*out, t[done:]])

        return pd.Series([one(t, s) for t, s in zip(text, changes)], dtype=object)

    new = F.col("tag") if style == "placeholder" else F.col("surrogate")
    changes = replacements(documents, key).groupBy(F.coalesce("doc_id", F.lit(-1)).alias("id"), "text_key").agg(
        F.sort_array(F.collect_set(F.struct("at", "until", new.alias("new")))).alias("changes")
    )
    keyed = _keyed(documents).withColumn("id", F.coalesce("doc_id", F.lit(-1)))
    return keyed.join(changes, ["id", "text_key"], "left").select("doc_id", put("text", "changes").alias("text"))
