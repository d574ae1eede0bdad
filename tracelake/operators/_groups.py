"""Walk sorted Arrow batches group by group, and join a hot key without piling it onto one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: Rows of a key that one task may get, and most keys that can be hot at once.
ROWS_PER_SALT, MOST_HOT = 1_000_000, 1000


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which a new key begins, 0 included."""
    n = table.num_rows
    changed = np.zeros(max(n - 1, 0), dtype=bool)
    for key in keys:
        column = table[key].combine_chunks()
        changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False).astype(bool)
    return np.append(0, np.flatnonzero(changed) + 1)


def _same(a: pa.Table, b: pa.Table, keys: Sequence[str]) -> bool:
    return all(a[k][a.num_rows - 1] == b[k][b.num_rows - 1] for k in keys)


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the bounds of each; the input is sorted by the (non-null) keys.

    A group that spans batches is put together once, when it ends.
    """
    waiting: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if waiting and _same(waiting[-1], table, keys) and all(table[k][0] == table[k][table.num_rows - 1] for k in keys):
            waiting.append(table)
            continue
        table = pa.concat_tables([*waiting, table]).combine_chunks()
        starts = _starts(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut), np.append(starts[:-1], cut)
        waiting = [table.slice(cut)]
    if waiting:
        table = pa.concat_tables(waiting).combine_chunks()
        yield table, np.append(_starts(table, keys), table.num_rows)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as a numpy array, nulls of a double column as NaN."""
    return table[name].to_numpy()


def salted_join(rows: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join where one key may hold most rows: rows are spread over salts, the one-row-per-key side repeated.

    The repeated side has one short row per key, so the repetition costs salts rows per key and no key stays on
    one task. Which physical join runs is left to Spark; its estimate leaves out the repetition and what Parquet packs,
    so a small side that grows with the data comes with the hint "merge".
    """
    left = rows.withColumn("_salt", F.pmod(F.coalesce(spread, F.lit(0)), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def sized_join(rows: DataFrame, small: DataFrame, key: str, spread: Column, size: str = "n_rows") -> DataFrame:
    """Inner equi-join with a side of one row per key that tells how many rows the key has: hot keys alone are spread.

    A key is hot above ROWS_PER_SALT rows, or above a MOST_HOT-th of all rows if that is more, and gets a salt for every
    so many rows. There are fewer than MOST_HOT such keys, whatever the data: their list is broadcast. small is read
    three times; its rows should be written.
    """
    total = small.agg(F.sum(size)).first()[0] or 0  # one number
    limit = max(ROWS_PER_SALT, total // MOST_HOT + 1)
    salts = F.ceil(F.col(size) / F.lit(limit)).cast("int")
    hot = small.filter(F.col(size) > limit).select(key, salts.alias("_salts"))
    left = rows.join(F.broadcast(hot), key, "left")
    left = left.withColumn("_salt", F.pmod(F.coalesce(spread, F.lit(0)), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts - 1, F.lit(0)))))
    return left.join(right, [key, "_salt"]).drop("_salt", size)
