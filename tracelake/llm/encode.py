"""Encoding of the whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.bpe import VOCABULARY, Tokenizer

#: Rows handed on at once, so that the ids of very long texts don't pile up.
ROWS_AT_ONCE = 256


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary, loaded once a worker."""
    return Tokenizer(path)


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield batch.slice(at, ROWS_AT_ONCE)


def token_ids(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row of documents; an empty list for a null or empty text.

    Rows are kept as they are: repeated rows come out repeated, a null doc_id stays null, other columns are dropped,
    an empty table stays empty. Texts are encoded where they are read, without a shuffle; each pre-token is merged by a
    queue whose cost grows in proportion to its length (see bpe.RankQueue), so one very long word is no hazard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for whole in batches:
            for batch in _batches(whole):
                ids = [np.asarray(tokenizer.encode(t.as_py()), dtype=np.int32) for t in batch.column("text")]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), type=pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of every row of documents; 0 for a null or empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            sizes = [len(tokenizer.encode(t.as_py())) for t in batch.column("text")]
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("source").cast(pa.string()), pa.array(sizes, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "n_tokens"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return chosen.mapInArrow(run, "doc_id long, source string, n_tokens long")
