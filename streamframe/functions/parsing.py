"""Typed values from strings, with defaults instead of errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a failed parse gives where the target takes no null.
DEFAULTS = {
    "boolean": "false", "tinyint": "0", "smallint": "0", "int": "0", "bigint": "0", "float": "0", "double": "0",
    "decimal(18,2)": "0", "decimal(18,4)": "0", "timestamp": "0001-01-01 00:00:00", "date": "0001-01-01", "string": "",
}

#: Column types of the relational profiles, by the name of a scalar type.
PROFILES = {
    "postgres": {"byte": "int", "short": "int", "int": "int", "long": "bigint", "bool": "boolean", "float": "float", "double": "double", "decimal": "decimal(18,2)", "datetime": "timestamp", "timespan": "interval day to second", "guid": "string", "string": "string", "uint": "string"},
    "sqlserver": {"byte": "int", "short": "int", "int": "int", "long": "bigint", "bool": "boolean", "float": "float", "double": "double", "decimal": "decimal(18,2)", "datetime": "timestamp", "timespan": "bigint", "guid": "string", "string": "string", "uint": "string"},
    "clickhouse": {"byte": "int", "short": "int", "int": "int", "long": "bigint", "bool": "tinyint", "float": "float", "double": "double", "decimal": "decimal(18,4)", "datetime": "timestamp", "timespan": "bigint", "guid": "string", "string": "string", "uint": "string"},
}


def parse_or_default(text: Column, kind: str, nullable: bool = False) -> Column:
    """A cast that gives null (nullable targets) or the type's default where it fails."""
    value = text.try_cast(kind)
    return value if nullable else F.coalesce(value, F.lit(DEFAULTS[kind]).cast(kind))


def ticks(interval: Column) -> Column:
    """A day-time interval in steps of 100 ns."""
    return (F.expr("0L") + interval.cast("interval second").cast("decimal(18,6)") * 10_000_000).cast("long")


def column_type(profile: str, scalar: str) -> str:
    """The column type of a scalar in a profile; unknown scalars are strings."""
    return PROFILES[profile].get(scalar, "string")
