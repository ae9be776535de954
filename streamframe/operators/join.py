"""The stream-table join: inner, by key, at most one match for a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a table is broadcast at a caller's wish.
BROADCAST_BYTES = 64 << 20


def latest_per_key(table: DataFrame, key: str | Sequence[str], version: Sequence[str]) -> DataFrame:
    """Of rows that share a key, the one with the highest version; in one aggregate, combined before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in table.columns if c not in keys]
    if not rest:
        return table.dropDuplicates(keys)
    newest = F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    return table.groupBy(*keys).agg(newest).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*table.columns)


def _bytes(table: DataFrame) -> int:
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def stream_table_join(
    stream: DataFrame, table: DataFrame, stream_key: str | Sequence[str], table_key: str | Sequence[str],
    project: Sequence[Column | str] | None = None, version: Sequence[str] | None = None, small: bool = False,
) -> DataFrame:
    """Rows whose key the table has, null values included; others are dropped.

    ``version`` reduces a table with repeated keys to its newest rows. ``small`` asks for
    a broadcast, which is made only below BROADCAST_BYTES by the optimizer's own
    estimate; beyond it, and without it, the optimizer chooses.
    """
    sk = [stream_key] if isinstance(stream_key, str) else list(stream_key)
    tk = [table_key] if isinstance(table_key, str) else list(table_key)
    if version:
        table = latest_per_key(table, tk, version)
    if small and _bytes(table) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    condition = None
    for a, b in zip(sk, tk, strict=True):
        c = stream[a] == table[b]
        condition = c if condition is None else condition & c
    out = stream.join(table, condition, "inner")
    return out.select(*project) if project else out
