"""Grouping and folding by key.

``emit="final"`` gives one row for each key; ``emit="changelog"`` gives, for each input
row in order, the state after it. Streams emit per micro-batch ("final", update mode);
per-row changelogs of streams are in :mod:`streamframe.streaming`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

Keys = Sequence[str]


def keys_of(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def checked_keys(df: DataFrame, key: str | Sequence[str], strict: bool) -> DataFrame:
    """Strict mode: a null key is an error. Otherwise nulls are a group of their own."""
    if not strict:
        return df
    out = {k: F.coalesce(F.col(k), F.raise_error(F.lit(f"the key {k} is null")).cast(df.schema[k].dataType)) for k in keys_of(key)}
    return df.withColumns(out)


def running(key: str | Sequence[str], order_by: Sequence[str | Column]) -> WindowSpec:
    """All rows of the key up to and with this one; rows of one place in the order stand one after the other."""
    return Window.partitionBy(*keys_of(key)).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def in_order(order_by: Sequence[str], value: Column) -> Column:
    """All values of a group as an array in order."""
    pairs = F.array_sort(F.collect_list(F.struct(*[F.col(o) if isinstance(o, str) else o for o in order_by], value.alias("_value"))))
    return F.transform(pairs, lambda p: p["_value"])


def group_by(df: DataFrame, key: str | Sequence[str], value: Column, order_by: Sequence[str], emit: str = "final", name: str = "values", strict: bool = False) -> DataFrame:
    """The list of a key's values. A changelog of lists is quadratic in a key's rows: prefer running aggregates for large keys."""
    df = checked_keys(df, key, strict)
    if emit == "final":
        return df.groupBy(*keys_of(key)).agg(in_order(order_by, value).alias(name))
    if emit == "changelog":
        return df.select("*", F.collect_list(value).over(running(key, order_by)).alias(name))
    raise ValueError(f"emit is 'final' or 'changelog', not {emit!r}")


def aggregate(df: DataFrame, key: str | Sequence[str], aggregates: dict[str, Column], order_by: Sequence[str] = (), emit: str = "final", strict: bool = False) -> DataFrame:
    """Built-in aggregates per key: partial and final in one shuffle, or as running frames."""
    df = checked_keys(df, key, strict)
    if emit == "final":
        return df.groupBy(*keys_of(key)).agg(*[c.alias(n) for n, c in aggregates.items()])
    if emit == "changelog":
        if not order_by:
            raise ValueError("a changelog needs an order")
        w = running(key, order_by)
        return df.select("*", *[c.over(w).alias(n) for n, c in aggregates.items()])
    raise ValueError(f"emit is 'final' or 'changelog', not {emit!r}")


def fold(df: DataFrame, key: str | Sequence[str], value: Column, initial: Column, step: Callable[[Column, Column], Column], order_by: Sequence[str], emit: str = "final", name: str = "state") -> DataFrame:
    """An arbitrary left fold over a key's values in order, as an expression."""
    if emit == "final":
        return df.groupBy(*keys_of(key)).agg(F.aggregate(in_order(order_by, value), initial, step).alias(name))
    if emit == "changelog":
        seen = F.collect_list(F.struct(value.alias("v"))).over(running(key, order_by))
        return df.select("*", F.aggregate(seen, initial, lambda a, x: step(a, x["v"])).alias(name))
    raise ValueError(f"emit is 'final' or 'changelog', not {emit!r}")
