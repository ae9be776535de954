"""Map, filter, flat-map and custom operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_rows(df: DataFrame, *columns: Column | str, **named: Column) -> DataFrame:
    """A projection; columns as they are and computed ones by name."""
    return df.select(*columns, *[c.alias(n) for n, c in named.items()])


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A Python function over Arrow batches, for what no expression says."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield fn(f)

    return df.mapInPandas(run, schema)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail where one of the columns is null: the strict mode of map, flat-map and windows."""
    checked = {c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is null")).cast(df.schema[c].dataType)) for c in columns}
    return df.withColumns(checked)


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true; unknown is not true."""
    return df.filter(condition)


def flat_map(df: DataFrame, items: Column, name: str = "value", ordinal: str | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """A row for each item of an array; null and empty arrays give none. ``ordinal`` names the item's place."""
    kept = list(keep)
    if ordinal:
        return df.select(*kept, F.posexplode(items).alias(ordinal, name))
    return df.select(*kept, F.explode(items).alias(name))


def custom(df: DataFrame, fn: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
    return df.transform(fn, *args, **kwargs)
