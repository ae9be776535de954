"""Stores in document, column and relational databases, behind a client that the caller opens.

``connect`` travels to the executors. Single-key calls open it once each; ``write_batch``
opens it once a partition. No driver library is imported here.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, StructType

from .relational import added_columns, list_columns


def _name(text: str) -> str:
    if not text.replace("_", "").isalnum():
        raise ValueError(f"a name is letters, digits and underscores: {text!r}")
    return text


def _key(key: Any) -> Any:
    if key is None:
        raise ValueError("a key is not null")
    return key


class MongoStore:
    """Documents ``{_id: key, value: value}`` of a collection, replaced whole.

    ``connect`` gives the collection (pymongo's, or one with its ``find_one``,
    ``replace_one``, ``delete_one`` and ``find``).
    """

    def __init__(self, name: str, connect: Callable[[], Any]):
        self.name, self.connect = name, connect

    def get(self, key):
        found = self.connect().find_one({"_id": _key(key)})
        return None if found is None else found["value"]

    def put(self, key, value) -> None:
        self.connect().replace_one({"_id": _key(key)}, {"_id": key, "value": value}, upsert=True)

    def contains(self, key) -> bool:
        return self.connect().find_one({"_id": _key(key)}, {"_id": 1}) is not None

    def remove(self, key) -> None:
        self.connect().delete_one({"_id": _key(key)})

    def items(self) -> Iterator[tuple[Any, Any]]:
        return ((d["_id"], d["value"]) for d in self.connect().find({}))

    def keys(self) -> Iterator[Any]:
        return (d["_id"] for d in self.connect().find({}, {"_id": 1}))

    def write_batch(self, key: str) -> Callable[[DataFrame, int], None]:
        connect = self.connect

        def save(batch: DataFrame, _: int) -> None:
            def replace(rows: Iterable[Row]) -> None:
                collection = connect()
                for r in rows:
                    value = r.asDict(recursive=True)
                    k = _key(value.pop(key))
                    collection.replace_one({"_id": k}, {"_id": k, "value": value}, upsert=True)

            batch.foreachPartition(replace)

        return save


def keyspace_ddl(name: str, strategy: str = "SimpleStrategy", replicas: int | Mapping[str, int] = 1, durable: bool = True) -> str:
    """The statement that makes a Cassandra keyspace; ``replicas`` by data centre for NetworkTopologyStrategy."""
    by = {"replication_factor": replicas} if isinstance(replicas, int) else dict(replicas)
    options = ", ".join(f"'{k}': '{v}'" for k, v in {"class": strategy, **by}.items())
    return f"CREATE KEYSPACE IF NOT EXISTS {_name(name)} WITH replication = {{{options}}} AND durable_writes = {str(durable).lower()}"


class CassandraStore:
    """A (k, v) table of JSON text by prepared statements; an insert is an upsert there.

    ``connect`` gives a session with ``prepare`` and ``execute``; ``consistency`` is the
    level of every statement (4 is QUORUM in the protocol).
    """

    def __init__(self, keyspace: str, name: str, connect: Callable[[], Any], consistency: int = 4, **replication: Any):
        self.keyspace, self.name, self.connect, self.consistency, self.replication = _name(keyspace), _name(name), connect, consistency, replication

    @property
    def table(self) -> str:
        return f"{self.keyspace}.{self.name}"

    def create(self) -> None:
        session = self.connect()
        session.execute(keyspace_ddl(self.keyspace, **self.replication))
        session.execute(f"CREATE TABLE IF NOT EXISTS {self.table} (k text PRIMARY KEY, v text)")

    def _prepared(self, session: Any, cql: str) -> Any:
        statement = session.prepare(cql)
        statement.consistency_level = self.consistency
        return statement

    def _run(self, cql: str, *values: Any) -> list[tuple]:
        session = self.connect()
        return [tuple(r) for r in session.execute(self._prepared(session, cql), values) or ()]

    def get(self, key):
        rows = self._run(f"SELECT v FROM {self.table} WHERE k = ?", json.dumps(_key(key)))
        return json.loads(rows[0][0]) if rows else None

    def put(self, key, value) -> None:
        self._run(f"INSERT INTO {self.table} (k, v) VALUES (?, ?)", json.dumps(_key(key)), json.dumps(value))

    def contains(self, key) -> bool:
        return bool(self._run(f"SELECT k FROM {self.table} WHERE k = ?", json.dumps(_key(key))))

    def remove(self, key) -> None:
        self._run(f"DELETE FROM {self.table} WHERE k = ?", json.dumps(_key(key)))

    def items(self) -> Iterator[tuple[Any, Any]]:
        return ((json.loads(k), json.loads(v)) for k, v in self._run(f"SELECT k, v FROM {self.table}"))

    def keys(self) -> Iterator[Any]:
        return (json.loads(k) for (k,) in self._run(f"SELECT k FROM {self.table}"))

    def write_batch(self, key: str) -> Callable[[DataFrame, int], None]:
        store = self

        def save(batch: DataFrame, _: int) -> None:
            def insert(rows: Iterable[Row]) -> None:
                session = store.connect()
                statement = store._prepared(session, f"INSERT INTO {store.table} (k, v) VALUES (?, ?)")
                for r in rows:
                    session.execute(statement, (r.k, r.v))

            _pairs(batch, key).foreachPartition(insert)

        return save


def _pairs(batch: DataFrame, key: str) -> DataFrame:
    """k and v as JSON text; the key alone, not in an object."""
    k = F.regexp_replace(F.to_json(F.array(key)), r"^\[|\]$", "")
    return batch.select(k.alias("k"), F.to_json(F.struct(*[c for c in batch.columns if c != key])).alias("v"))


#: Column types by dialect, for Spark's simple type names; any other type is text.
COLUMN_TYPES = {
    "postgres": {
        "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "float": "REAL",
        "double": "DOUBLE PRECISION", "decimal": "NUMERIC(18,2)", "timestamp": "TIMESTAMP", "text": "TEXT",
    },
    "sqlserver": {
        "tinyint": "INT", "smallint": "INT", "int": "INT", "bigint": "BIGINT", "boolean": "BIT", "float": "REAL",
        "double": "FLOAT", "decimal": "DECIMAL(18,2)", "timestamp": "DATETIME2", "text": "NVARCHAR(MAX)",
    },
    "clickhouse": {
        "tinyint": "Int32", "smallint": "Int32", "int": "Int32", "bigint": "Int64", "boolean": "UInt8", "float": "Float32",
        "double": "Float64", "decimal": "Decimal(18,4)", "timestamp": "DateTime64(3)", "text": "String",
    },
    "sqlite": {
        "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "boolean": "INTEGER", "float": "REAL",
        "double": "REAL", "decimal": "TEXT", "timestamp": "TEXT", "text": "TEXT",
    },
}


def sql_type(kind: DataType, dialect: str) -> str:
    types = COLUMN_TYPES[dialect]
    if isinstance(kind, ArrayType):
        if dialect != "clickhouse":
            raise ValueError("a list has no column there; it has a child table")
        return f"Array({sql_type(kind.elementType, dialect)})"
    if isinstance(kind, DecimalType):
        return types["decimal"]
    return types.get(kind.simpleString(), types["text"])


@contextmanager
def _cursor(connect: Callable[[], Any]) -> Iterator[Any]:
    """A cursor whose statements are one transaction."""
    db = connect()
    try:
        yield db.cursor()
        db.commit()
    except Exception:
        if hasattr(db, "rollback"):
            db.rollback()
        raise
    finally:
        db.close()


class ClickHouseStore:
    """Rows of (key, timestamp, columns) that are only appended; the newest of a key is its value.

    ``connect`` opens a DB-API connection; ``mark`` is its parameter mark. Older rows go
    when the engine merges, and nobody reads them before. Of rows of one time any one counts.
    """

    def __init__(self, name: str, connect: Callable[[], Any], schema: str | StructType, engine: str = "ReplacingMergeTree", mark: str = "%s"):
        if engine not in ("MergeTree", "ReplacingMergeTree"):
            raise ValueError("the engine is MergeTree or ReplacingMergeTree")
        self.name, self.connect, self.engine, self.mark = _name(name), connect, engine, mark
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.columns = [_name(f.name) for f in self.schema.fields]

    def ddl(self) -> str:
        own = ", ".join(f"{f.name} {sql_type(f.dataType, 'clickhouse')}" for f in self.schema.fields)
        engine = "ReplacingMergeTree(timestamp)" if self.engine == "ReplacingMergeTree" else "MergeTree"
        order = "key" if self.engine == "ReplacingMergeTree" else "key, timestamp"
        return f"CREATE TABLE IF NOT EXISTS {self.name} (key String, timestamp Int64, {own}) ENGINE = {engine} ORDER BY ({order})"

    def create(self) -> None:
        with _cursor(self.connect) as c:
            c.execute(self.ddl())

    def _insert(self) -> str:
        marks = ", ".join([self.mark] * (2 + len(self.columns)))
        return f"INSERT INTO {self.name} (key, timestamp, {', '.join(self.columns)}) VALUES ({marks})"

    def get(self, key):
        with _cursor(self.connect) as c:
            c.execute(f"SELECT {', '.join(self.columns)} FROM {self.name} WHERE key = {self.mark} ORDER BY timestamp DESC LIMIT 1", (json.dumps(_key(key)),))
            row = c.fetchone()
        return None if row is None else dict(zip(self.columns, row))

    def put(self, key, value: Mapping[str, Any]) -> None:
        with _cursor(self.connect) as c:
            c.execute(f"SELECT coalesce(max(timestamp), 0) FROM {self.name} WHERE key = {self.mark}", (json.dumps(_key(key)),))
            c.execute(self._insert(), (json.dumps(key), c.fetchone()[0] + 1, *[value.get(n) for n in self.columns]))

    def contains(self, key) -> bool:
        return self.get(key) is not None

    def remove(self, key) -> None:
        with _cursor(self.connect) as c:
            c.execute(f"DELETE FROM {self.name} WHERE key = {self.mark}", (json.dumps(_key(key)),))

    def items(self) -> Iterator[tuple[Any, Any]]:
        """Each key with its newest row: one aggregate in the database, rows as they come."""
        newest = f"SELECT key AS k, max(timestamp) AS t FROM {self.name} GROUP BY key"
        with _cursor(self.connect) as c:
            own = ", ".join(f"s.{n}" for n in self.columns)
            c.execute(f"SELECT s.key, {own} FROM {self.name} AS s JOIN ({newest}) AS m ON s.key = m.k AND s.timestamp = m.t")
            seen: set[str] = set()
            for row in iter(c.fetchone, None):
                if row[0] not in seen:
                    seen.add(row[0])
                    yield json.loads(row[0]), dict(zip(self.columns, row[1:]))

    def keys(self) -> Iterator[Any]:
        with _cursor(self.connect) as c:
            c.execute(f"SELECT DISTINCT key FROM {self.name}")
            for row in iter(c.fetchone, None):
                yield json.loads(row[0])

    def write_batch(self, key: str, size: int = 10_000) -> Callable[[DataFrame, int], None]:
        """Appends a micro-batch; its rows' time is the batch's number plus one, so a batch that is replayed changes nothing."""
        store = self

        def save(batch: DataFrame, n: int) -> None:
            k = F.regexp_replace(F.to_json(F.array(key)), r"^\[|\]$", "")
            rows = batch.select(k, F.lit(n + 1).cast("long"), *store.columns)

            def append(part: Iterable[Row]) -> None:
                _in_parts(store.connect, store._insert(), (tuple(r) for r in part), size)

            rows.foreachPartition(append)

        return save


def _in_parts(connect: Callable[[], Any], sql: str, rows: Iterable[tuple], size: int) -> None:
    held: list[tuple] = []
    with _cursor(connect) as c:
        for r in rows:
            held.append(r)
            if len(held) >= size:
                c.executemany(sql, held)
                held = []
        if held:
            c.executemany(sql, held)


class RelationalStore:
    """Values with named columns in a table, their lists in child tables, by key.

    A value is written in one transaction: its main row and the rows of its lists are
    deleted and inserted. Main and child tables have ``key`` as text; child tables also
    ``ItemIndex``. Null and empty lists both read as empty. Tables are made, and grow by
    columns they lack, where ``allow_changes``.
    """

    def __init__(self, name: str, connect: Callable[[], Any], schema: str | StructType, dialect: str = "postgres", allow_changes: bool = True):
        self.name, self.connect, self.dialect, self.allow_changes = _name(name), connect, dialect, allow_changes
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.lists = [_name(c) for c in list_columns(self.schema)]
        self.scalars = [_name(f.name) for f in self.schema.fields if f.name not in self.lists]

    def _quoted(self, name: str) -> str:
        return f"[{name}]" if self.dialect == "sqlserver" else f'"{name}"'

    @property
    def _mark(self) -> str:
        return "%s" if self.dialect == "postgres" else "?"

    def _tables(self) -> dict[str, StructType]:
        """Each table's columns after the key, the main table first."""
        out = {self.name: StructType([self.schema[c] for c in self.scalars])}
        for c in self.lists:
            item = self.schema[c].dataType.elementType
            fields = StructType().add("ItemIndex", "integer")
            for f in item.fields if isinstance(item, StructType) else StructType().add("value", item).fields:
                fields = fields.add(f)
            out[f"{self.name}_{c}"] = fields
        return out

    def ddl(self) -> list[str]:
        key = "NVARCHAR(450)" if self.dialect == "sqlserver" else "TEXT"
        out = []
        for t, fields in self._tables().items():
            own = [f"{self._quoted(f.name)} {sql_type(f.dataType, self.dialect)}" for f in fields.fields]
            primary = ["key"] if t == self.name else ["key", "ItemIndex"]
            ends = f"PRIMARY KEY ({', '.join(map(self._quoted, primary))})"
            body = ", ".join([f"{self._quoted('key')} {key} NOT NULL", *own, ends])
            if self.dialect == "sqlserver":
                out.append(f"IF OBJECT_ID(N'{t}', N'U') IS NULL CREATE TABLE {self._quoted(t)} ({body})")
            else:
                out.append(f"CREATE TABLE IF NOT EXISTS {self._quoted(t)} ({body})")
        return out

    def create(self) -> None:
        if not self.allow_changes:
            raise ValueError("the schema of this store is fixed")
        with _cursor(self.connect) as c:
            for statement in self.ddl():
                c.execute(statement)

    def grow(self) -> list[str]:
        """Add the columns that existing tables lack; their names."""
        added = []
        with _cursor(self.connect) as c:
            for t, fields in self._tables().items():
                c.execute(f"SELECT * FROM {self._quoted(t)} WHERE 1 = 0")
                have = StructType()
                for d in c.description:
                    have = have.add(d[0], "string")
                for n in added_columns(have, fields, self.allow_changes):
                    verb = "ADD" if self.dialect == "sqlserver" else "ADD COLUMN"
                    c.execute(f"ALTER TABLE {self._quoted(t)} {verb} {self._quoted(n)} {sql_type(fields[n].dataType, self.dialect)}")
                    added.append(f"{t}.{n}")
        return added

    def _insert(self, table: str, names: list[str]) -> str:
        marks = ", ".join([self._mark] * (1 + len(names)))
        return f"INSERT INTO {self._quoted(table)} ({', '.join(map(self._quoted, ['key', *names]))}) VALUES ({marks})"

    def _delete(self, cursor: Any, key: str) -> None:
        for t in reversed(list(self._tables())):
            cursor.execute(f"DELETE FROM {self._quoted(t)} WHERE {self._quoted('key')} = {self._mark}", (key,))

    def _write(self, cursor: Any, key: Any, value: Mapping[str, Any]) -> None:
        k = str(_key(key))
        self._delete(cursor, k)
        cursor.execute(self._insert(self.name, self.scalars), (k, *[value.get(c) for c in self.scalars]))
        for t, fields in list(self._tables().items())[1:]:
            c, names = t[len(self.name) + 1 :], fields.names
            structs = isinstance(self.schema[c].dataType.elementType, StructType)
            rows = [(k, i, *([(x or {}).get(n) for n in names[1:]] if structs else [x])) for i, x in enumerate(value.get(c) or ())]
            if rows:
                cursor.executemany(self._insert(t, names), rows)

    def put(self, key, value: Mapping[str, Any]) -> None:
        self.put_all([(key, value)])

    def put_all(self, pairs: Iterable[tuple[Any, Mapping[str, Any]]]) -> None:
        """All pairs in one transaction."""
        with _cursor(self.connect) as c:
            for k, v in pairs:
                self._write(c, k, v)

    def _read(self, cursor: Any, key: str, row: tuple) -> dict[str, Any]:
        value = dict(zip(self.scalars, row))
        for t, fields in list(self._tables().items())[1:]:
            c, names = t[len(self.name) + 1 :], fields.names[1:]
            cursor.execute(f"SELECT {', '.join(map(self._quoted, names))} FROM {self._quoted(t)} WHERE {self._quoted('key')} = {self._mark} ORDER BY {self._quoted('ItemIndex')}", (key,))
            structs = isinstance(self.schema[c].dataType.elementType, StructType)
            value[c] = [dict(zip(names, r)) if structs else r[0] for r in cursor.fetchall()]
        return {f.name: value[f.name] for f in self.schema.fields}

    def get(self, key):
        with _cursor(self.connect) as c:
            own = ", ".join(map(self._quoted, ["key", *self.scalars]))
            c.execute(f"SELECT {own} FROM {self._quoted(self.name)} WHERE {self._quoted('key')} = {self._mark}", (str(_key(key)),))
            row = c.fetchone()
            return None if row is None else self._read(c, row[0], row[1:])

    def contains(self, key) -> bool:
        with _cursor(self.connect) as c:
            c.execute(f"SELECT 1 FROM {self._quoted(self.name)} WHERE {self._quoted('key')} = {self._mark}", (str(_key(key)),))
            return c.fetchone() is not None

    def remove(self, key) -> None:
        with _cursor(self.connect) as c:
            self._delete(c, str(_key(key)))

    def keys(self) -> Iterator[str]:
        with _cursor(self.connect) as c:
            c.execute(f"SELECT {self._quoted('key')} FROM {self._quoted(self.name)} ORDER BY {self._quoted('key')}")
            for row in iter(c.fetchone, None):
                yield row[0]

    def items(self) -> Iterator[tuple[str, dict[str, Any]]]:
        """Keys are text; many values are better read as tables over JDBC and put together by ``relational.from_tables``."""
        return ((k, self.get(k)) for k in self.keys())

    def write_batch(self, key: str, size: int = 1000) -> Callable[[DataFrame, int], None]:
        """Upserts a stream's rows, ``size`` of them a transaction, each partition on its executor."""
        store = self

        def save(batch: DataFrame, _: int) -> None:
            def upsert(rows: Iterable[Row]) -> None:
                held: list[tuple[Any, dict]] = []
                for r in rows:
                    value = r.asDict(recursive=True)
                    held.append((value.pop(key), value))
                    if len(held) >= size:
                        store.put_all(held)
                        held = []
                if held:
                    store.put_all(held)

            batch.foreachPartition(upsert)

        return save
