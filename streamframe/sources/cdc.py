"""Change data capture: decoding, de-duplication, and applying changes to a table.

Changes are rows of ``operation, data, change_time``. Decoders read recorded or
streamed feeds; ``feed`` puts a snapshot before its changes; ``apply_changes`` gives the
table as of the last change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.hashing import row_hash
from ..operators.join import latest_per_key

INITIAL, INSERT, UPDATE, REPLACE, DELETE = "InitialLoad", "INSERT", "UPDATE", "REPLACE", "DELETE"
#: SQL Server's __$operation codes.
SQLSERVER_OPERATIONS = {1: "Delete", 2: "Insert", 3: "Update (old value)", 4: "Update (new value)", 5: "Merge"}

_WAL2JSON = (
    "struct<change: array<struct<kind: string, schema: string, `table`: string, columnnames: array<string>, columnvalues: array<string>, "
    "oldkeys: struct<keynames: array<string>, keyvalues: array<string>>>>, timestamp: string>"
)


def from_wal2json(lines: DataFrame, column: str, schema: str | None = None, table: str | None = None) -> DataFrame:
    """operation, data (map of text), change_time, lsn (if the input has it), place in the message.

    One row per change of the named table; deletes carry their old keys.
    """
    m = lines.withColumn("_m", F.from_json(column, _WAL2JSON))
    rest = [c for c in lines.columns if c != column]
    c = m.select(*rest, F.to_timestamp("_m.timestamp").alias("change_time"), F.posexplode("_m.change").alias("place", "c"))
    if schema:
        c = c.filter(F.col("c.schema") == schema)
    if table:
        c = c.filter(F.col("c.table") == table)
    delete = F.col("c.kind") == "delete"
    data = F.when(delete, F.map_from_arrays("c.oldkeys.keynames", "c.oldkeys.keyvalues")).otherwise(F.map_from_arrays("c.columnnames", "c.columnvalues"))
    return c.select(*rest, F.upper("c.kind").alias("operation"), data.alias("data"), "change_time", "place")


def from_sqlserver(changes: DataFrame, time: str | None = None) -> DataFrame:
    """Rows of fn_cdc_get_all_changes: operation by name, data, lsn; old values of updates go."""
    codes = F.create_map(*[x for k, v in SQLSERVER_OPERATIONS.items() for x in (F.lit(k), F.lit(v))])
    data = [c for c in changes.columns if not c.startswith("__$") and c != time]
    named = changes.withColumn("operation", F.coalesce(F.try_element_at(codes, F.col("`__$operation`").cast("int")), F.lit("Unknown")))
    out = named.filter(F.col("operation") != SQLSERVER_OPERATIONS[3])
    return out.select("operation", F.struct(*data).alias("data"), (F.col(time) if time else F.current_timestamp()).alias("change_time"), F.col("`__$start_lsn`").alias("lsn"), F.col("`__$seqval`").alias("seq"))


def latest_lsn(changes: DataFrame, column: str = "lsn") -> Column | bytes | None:
    """The highest binary position; the next poll starts after it."""
    return changes.agg(F.max(column)).first()[0]


def from_change_stream(events: DataFrame, column: str, schema: str | StructType | None = None) -> DataFrame:
    """MongoDB change events as JSON: operation, data (variant, or typed with a schema; null on delete), key, change_time."""
    v = events.select(F.get_json_object(column, "$.operationType").alias("t"), F.get_json_object(column, "$.fullDocument").alias("d"), F.get_json_object(column, "$.documentKey").alias("k"), F.get_json_object(column, "$.wallTime").alias("w"))
    known = F.upper("t").isin(INSERT, UPDATE, REPLACE, DELETE)
    doc = F.when(F.upper("t") != DELETE, F.col("d"))
    data = F.from_json(doc, schema if isinstance(schema, StructType) else StructType.fromDDL(schema)) if schema else F.try_parse_json(doc)
    return v.filter(known).select(F.upper("t").alias("operation"), data.alias("data"), F.col("k").alias("key"), F.to_timestamp("w").alias("change_time"))


def snapshot(table: DataFrame, time: Column | None = None) -> DataFrame:
    """A table's rows as initial-load changes."""
    return table.select(F.lit(INITIAL).alias("operation"), F.struct(*table.columns).alias("data"), (time if time is not None else F.current_timestamp()).alias("change_time"))


def jdbc_snapshot(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **properties: str) -> DataFrame:
    """A table over JDBC, read in parallel by ranges of a column where one is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column and bounds:
        for k, v in (("partitionColumn", partition_column), ("lowerBound", bounds[0]), ("upperBound", bounds[1]), ("numPartitions", partitions)):
            reader = reader.option(k, v)
    for k, v in properties.items():
        reader = reader.option(k, v)
    return reader.load()


def feed(initial: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The snapshot before the changes, in one schema."""
    return changes if initial is None else initial.unionByName(changes, allowMissingColumns=True)


def without_repeats(changes: DataFrame, key: str | Sequence[str], columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Leaves out a change that says, for its key, what the change before it said (operation and data)."""
    keys = [key] if isinstance(key, str) else list(key)
    h = changes.withColumn("_hash", row_hash(columns))
    before = F.lag("_hash").over(Window.partitionBy(*keys).orderBy(*order_by))
    return h.withColumn("_before", before).filter("_before IS NULL OR _hash <> _before").drop("_hash", "_before")


def apply_changes(changes: DataFrame, key: str | Sequence[str], order_by: Sequence[str], operation: str = "operation") -> DataFrame:
    """The table after all changes: the newest row of each key, without those whose newest change is a delete."""
    return latest_per_key(changes, key, order_by).filter(F.upper(operation) != DELETE)
