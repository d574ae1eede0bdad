"""Queries p7 to p9 on their whole tables. SQL cannot express them; tests/llm holds them against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import encode, mix, pii
from tracelake.session import fingerprint, still_there, table, write_shared

Query = Callable[[SparkSession, str], DataFrame]
_counted: dict[tuple, str] = {}


def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of a folder's documents, made once as long as their files are the same."""
    key = (spark.sparkContext.applicationId, fingerprint(spark, f"{folder}/documents.parquet"))
    if key not in _counted or not still_there(spark, _counted[key]):
        _counted.clear()
        _counted[key] = write_shared(encode.token_counts(table(spark, folder, "documents")))
    return spark.read.parquet(_counted[key])


def queries() -> dict[str, Query]:
    documents = lambda s, d: table(s, d, "documents")
    targets = lambda s, d: table(s, d, "mix_targets")
    return {
        "p7_ids": lambda s, d: encode.token_ids(documents(s, d)),
        "p8_mix": lambda s, d: mix.mixed_documents(documents(s, d), targets(s, d), counts=_token_counts(s, d)),
        "p8_shares": lambda s, d: mix.mix_shares(documents(s, d), targets(s, d), counts=_token_counts(s, d)),
        "p9_found": lambda s, d: pii.personal_information(documents(s, d)),
        "p9_redacted": lambda s, d: pii.redacted(documents(s, d)),
        "p9_surrogates": lambda s, d: pii.redacted(documents(s, d), style="surrogate"),
    }


def oracle_sql() -> dict[str, str]:
    return {}
