"""Key-value stores behind one contract.

``put_all`` and ``as_dataframe`` are the distributed paths; the single-key methods are
for lookups. Stores on the driver (memory, SQLite) are for small tables and tests.
"""

from __future__ import annotations

import json
import sqlite3
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@runtime_checkable
class Store(Protocol):
    """What every store does; a missing key reads as None."""

    name: str

    def get(self, key: Any) -> Any: ...
    def put(self, key: Any, value: Any) -> None: ...
    def contains(self, key: Any) -> bool: ...
    def remove(self, key: Any) -> None: ...
    def items(self) -> Iterator[tuple[Any, Any]]: ...
    def keys(self) -> Iterator[Any]: ...


class InMemoryStore:
    """A dictionary behind a lock. Null keys are refused."""

    def __init__(self, name: str | None = None):
        self.name, self._data, self._lock = name or f"store-{uuid.uuid4().hex}", {}, threading.RLock()

    def get(self, key):
        with self._lock:
            return self._data.get(key)

    def put(self, key, value) -> None:
        if key is None:
            raise ValueError("a key is not null")
        with self._lock:
            self._data[key] = value

    def update(self, key, fn: Callable[[Any], Any]):
        """Read, change and write under one lock."""
        with self._lock:
            self._data[key] = value = fn(self._data.get(key))
            return value

    def contains(self, key) -> bool:
        with self._lock:
            return key in self._data

    def remove(self, key) -> None:
        with self._lock:
            self._data.pop(key, None)

    def items(self):
        with self._lock:
            return iter(list(self._data.items()))

    def keys(self):
        with self._lock:
            return iter(list(self._data))


class TableView:
    """A read-only view of a store, or of a DataFrame with a key and a value column."""

    def __init__(self, source, key: str = "key", name: str | None = None):
        self.source, self.key, self.name = source, key, name or getattr(source, "name", "table")

    def get(self, key):
        if isinstance(self.source, DataFrame):
            row = self.source.filter(F.col(self.key).eqNullSafe(F.lit(key))).first()
            return None if row is None else {k: v for k, v in row.asDict(recursive=True).items() if k != self.key}
        return self.source.get(key)

    def contains(self, key) -> bool:
        if isinstance(self.source, DataFrame):
            return not self.source.filter(F.col(self.key).eqNullSafe(F.lit(key))).isEmpty()
        return self.source.contains(key)

    def items(self):
        if isinstance(self.source, DataFrame):
            return ((r[self.key], {k: v for k, v in r.asDict(recursive=True).items() if k != self.key}) for r in self.source.toLocalIterator())
        return self.source.items()

    def keys(self):
        return (k for k, _ in self.items())

    def put(self, key, value):
        raise TypeError("the view is read-only")

    def remove(self, key):
        raise TypeError("the view is read-only")


class SqliteStore:
    """JSON text by JSON text in one SQLite table; the offline stand-in for external key-value tables.

    Several stores may share a file; each call has its own short transaction.
    """

    def __init__(self, path: str, name: str, dumps: Callable[[Any], str] = json.dumps, loads: Callable[[str], Any] = json.loads):
        if not name.replace("_", "").isalnum():
            raise ValueError("a store's name is letters, digits and underscores")
        self.path, self.name, self._dumps, self._loads = path, name, dumps, loads
        with self._open() as db:
            db.execute(f'CREATE TABLE IF NOT EXISTS "{name}" (k TEXT PRIMARY KEY, v TEXT)')

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(self.path, timeout=30)

    def get(self, key):
        with self._open() as db:
            row = db.execute(f'SELECT v FROM "{self.name}" WHERE k = ?', (self._dumps(key),)).fetchone()
        return None if row is None else self._loads(row[0])

    def put(self, key, value) -> None:
        self.put_all([(key, value)])

    def put_all(self, pairs: Iterable[tuple[Any, Any]]) -> None:
        """An upsert of many pairs in one transaction."""
        with self._open() as db:
            db.executemany(f'INSERT INTO "{self.name}" VALUES (?, ?) ON CONFLICT (k) DO UPDATE SET v = excluded.v', ((self._dumps(k), self._dumps(v)) for k, v in pairs))

    def contains(self, key) -> bool:
        with self._open() as db:
            return db.execute(f'SELECT 1 FROM "{self.name}" WHERE k = ?', (self._dumps(key),)).fetchone() is not None

    def remove(self, key) -> None:
        with self._open() as db:
            db.execute(f'DELETE FROM "{self.name}" WHERE k = ?', (self._dumps(key),))

    def items(self):
        with self._open() as db:
            rows = db.execute(f'SELECT k, v FROM "{self.name}" ORDER BY k').fetchall()
        return ((self._loads(k), self._loads(v)) for k, v in rows)

    def keys(self):
        return (k for k, _ in self.items())

    def write_batch(self, key: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function that upserts a stream's rows by ``key``; rows come to the driver one partition at a time."""

        def save(batch: DataFrame, _: int) -> None:
            self.put_all((r[key], {k: v for k, v in r.asDict(recursive=True).items() if k != key}) for r in batch.toLocalIterator())

        return save


class VersionedStore:
    """Append-only Parquet of (key, value, version, deleted); the newest version of a key is its value.

    Upserts and deletes append; reads take the newest row per key in one aggregate;
    ``compact`` rewrites only the newest rows into a new generation; the last whole
    generation in the folder counts, whoever opens it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, name: str | None = None):
        self.spark, self.path, self.key, self.name = spark, path, key, name or path.rstrip("/").rsplit("/", 1)[-1]
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self._full = StructType([*self.schema.fields]).add("_version", "long").add("_deleted", "boolean")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _last(self) -> int:
        """The last generation that a compaction has finished, 0 before the first."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        done = [int(n.partition("=")[2]) for n in names if n.startswith("compacted=")]
        return max(done, default=0)

    @property
    def location(self) -> str:
        return f"{self.path}/generation={self._last()}"

    def _history(self) -> DataFrame:
        if not self._exists(self.location):
            return self.spark.createDataFrame([], self._full)
        return self.spark.read.schema(self._full).parquet(self.location)

    def next_version(self) -> int:
        return (self._history().agg(F.max("_version")).first()[0] or 0) + 1

    def put_all(self, rows: DataFrame, version: int | None = None, deleted: bool = False) -> None:
        """Append rows as one version. Of rows that share a key in it, any one counts: reduce them before."""
        v = self.next_version() if version is None else version
        rows.select(*self.schema.names).withColumns({"_version": F.lit(v).cast("long"), "_deleted": F.lit(deleted)}).write.mode("append").parquet(self.location)

    def remove_all(self, keys: DataFrame) -> None:
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != self.key]
        self.put_all(keys.select(self.key, *rest), deleted=True)

    def as_dataframe(self) -> DataFrame:
        rest = [c for c in self._full.names if c != self.key]
        newest = self._history().groupBy(self.key).agg(F.max_by(F.struct(*rest), "_version").alias("r"))
        return newest.filter("NOT r._deleted").select(self.key, *[F.col("r")[c].alias(c) for c in rest if not c.startswith("_")]).select(*self.schema.names)

    def compact(self) -> None:
        now = self.as_dataframe().withColumns({"_version": F.lit(0).cast("long"), "_deleted": F.lit(False)})
        new = self._last() + 1
        now.write.mode("overwrite").parquet(f"{self.path}/generation={new}")
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/compacted={new}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()

    def _one(self, key) -> DataFrame:
        return self.as_dataframe().filter(F.col(self.key) == F.lit(key))

    def get(self, key):
        row = self._one(key).first()
        return None if row is None else {k: v for k, v in row.asDict(recursive=True).items() if k != self.key}

    def put(self, key, value: dict) -> None:
        self.put_all(self.spark.createDataFrame([{self.key: key, **value}], self.schema))

    def contains(self, key) -> bool:
        return not self._one(key).isEmpty()

    def remove(self, key) -> None:
        kind = StructType([self.schema[self.key]])
        self.remove_all(self.spark.createDataFrame([(key,)], kind))

    def items(self):
        return ((r[self.key], {k: v for k, v in r.asDict(recursive=True).items() if k != self.key}) for r in self.as_dataframe().toLocalIterator())

    def keys(self):
        return (r[0] for r in self.as_dataframe().select(self.key).toLocalIterator())


#: Upserts of a (k, v) table by dialect.
UPSERTS = {
    "postgres": 'INSERT INTO "{t}" (k, v) VALUES (%s, %s) ON CONFLICT (k) DO UPDATE SET v = EXCLUDED.v',
    "sqlserver": "MERGE INTO [{t}] AS t USING (VALUES (?, ?)) AS s (k, v) ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (k, v) VALUES (s.k, s.v);",
    "cassandra": "INSERT INTO {t} (k, v) VALUES (?, ?)",
    "sqlite": 'INSERT INTO "{t}" VALUES (?, ?) ON CONFLICT (k) DO UPDATE SET v = excluded.v',
}


class JdbcStore:
    """A (k, v) table of JSON text in an external database.

    Reads go through Spark's JDBC source. Writes go through ``connect``, a function that
    opens a DB-API connection; it travels to the executors, where each partition upserts
    in one transaction.
    """

    def __init__(self, name: str, connect: Callable[[], Any], dialect: str = "postgres", url: str | None = None, properties: dict[str, str] | None = None):
        self.name, self.connect, self.dialect, self.url, self.properties = name, connect, dialect, url, properties or {}

    def _mark(self) -> str:
        return "%s" if self.dialect == "postgres" else "?"

    def as_dataframe(self, spark: SparkSession, **partitioning: Any) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", self.url).option("dbtable", self.name)
        for k, v in {**self.properties, **partitioning}.items():
            reader = reader.option(k, v)
        return reader.load()

    def write_batch(self, key: str, size: int = 1000) -> Callable[[DataFrame, int], None]:
        connect, sql = self.connect, UPSERTS[self.dialect].format(t=self.name)

        def save(batch: DataFrame, _: int) -> None:
            pairs = batch.select(F.to_json(F.struct(F.col(key).alias("k"))).alias("k"), F.to_json(F.struct(*[c for c in batch.columns if c != key])).alias("v"))

            def upsert(rows) -> None:
                db = connect()
                try:
                    cursor, held = db.cursor(), []
                    for r in rows:
                        held.append((r.k, r.v))
                        if len(held) >= size:
                            cursor.executemany(sql, held)
                            held = []
                    if held:
                        cursor.executemany(sql, held)
                    db.commit()
                finally:
                    db.close()

            pairs.foreachPartition(upsert)

        return save

    def _run(self, sql: str, *values) -> list[tuple]:
        db = self.connect()
        try:
            cursor = db.cursor()
            cursor.execute(sql, values)
            rows = cursor.fetchall() if cursor.description else []
            db.commit()
            return rows
        finally:
            db.close()

    def get(self, key):
        rows = self._run(f"SELECT v FROM {self.name} WHERE k = {self._mark()}", json.dumps(key))
        return json.loads(rows[0][0]) if rows else None

    def put(self, key, value) -> None:
        self._run(UPSERTS[self.dialect].format(t=self.name), json.dumps(key), json.dumps(value))

    def contains(self, key) -> bool:
        return bool(self._run(f"SELECT 1 FROM {self.name} WHERE k = {self._mark()}", json.dumps(key)))

    def remove(self, key) -> None:
        self._run(f"DELETE FROM {self.name} WHERE k = {self._mark()}", json.dumps(key))

    def items(self):
        return ((json.loads(k), json.loads(v)) for k, v in self._run(f"SELECT k, v FROM {self.name}"))

    def keys(self):
        return (k for k, _ in self.items())
