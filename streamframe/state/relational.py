"""Relational layout of nested values: scalar columns in a main table, lists in child tables.

Null and empty lists stay apart in nested columns; child tables hold neither, so reading
them back gives an empty list for both. Lists of scalars have a ``value`` column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def list_columns(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, ArrayType)]


def to_tables(df: DataFrame, key: str, base: str) -> dict[str, DataFrame]:
    """``base`` with the scalar columns, and ``base_<list>`` with key, ItemIndex and the items' fields."""
    lists = list_columns(df.schema)
    tables = {base: df.drop(*lists)}
    for c in lists:
        items = df.select(key, F.posexplode(c).alias("ItemIndex", "value"))
        item = df.schema[c].dataType.elementType
        fields = [F.col("value")[f.name].alias(f.name) for f in item.fields] if isinstance(item, StructType) else ["value"]
        tables[f"{base}_{c}"] = items.select(key, "ItemIndex", *fields)
    return tables


def from_tables(tables: dict[str, DataFrame], schema: StructType, key: str, base: str) -> DataFrame:
    """The nested values again; lists in order of ItemIndex."""
    out = tables[base]
    for c in list_columns(schema):
        child, kind = tables[f"{base}_{c}"], schema[c].dataType
        item = F.struct(*[F.col(f.name) for f in kind.elementType.fields]) if isinstance(kind.elementType, StructType) else F.col("value")
        lists = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ItemIndex", item.alias("item")))).alias("_items"))
        lists = lists.select(key, F.transform("_items", lambda x: x["item"]).alias(c))
        out = out.join(lists, key, "left").withColumn(c, F.coalesce(F.col(c), F.array().cast(kind)))
    return out.select(*schema.names)


def added_columns(existing: StructType, wanted: StructType, allow: bool) -> list[str]:
    """Columns that a table lacks. Tables only ever grow, and only where that is allowed."""
    missing = [f.name for f in wanted.fields if f.name not in existing.names]
    if missing and not allow:
        raise ValueError(f"the table lacks {', '.join(missing)} and its schema is fixed")
    return missing


def with_schema(df: DataFrame, wanted: StructType, allow: bool = True) -> DataFrame:
    """The table with the wanted columns added as nulls."""
    added = added_columns(df.schema, wanted, allow)
    return df.withColumns({c: F.lit(None).cast(wanted[c].dataType) for c in added}) if added else df


def upsert(current: DataFrame, changes: DataFrame, key: str, deleted: str | None = None) -> DataFrame:
    """A table after changes, one row for each key in them: changed keys are replaced, deleted ones go."""
    kept = current.join(changes.select(key), key, "left_anti")
    new = changes.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else changes
    return kept.unionByName(new.select(*current.columns))
