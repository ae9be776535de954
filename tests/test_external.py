"""Stores in external databases and the life cycle of change feeds, over stand-ins."""

import functools
import re
import sqlite3
import sys

import pytest
from pyspark import cloudpickle

from streamframe.sources import lifecycle
from streamframe.sources.connectors import PolledSource
from streamframe.state import external
from streamframe.state.stores import Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors have no tests folder


class Collection:
    """What MongoStore calls, over one SQLite file, so that executors see the same documents."""

    def __init__(self, path):
        self.path = path
        with sqlite3.connect(path, timeout=30) as db:
            db.execute("CREATE TABLE IF NOT EXISTS d (k TEXT PRIMARY KEY, v TEXT)")

    def _run(self, sql, *values):
        with sqlite3.connect(self.path, timeout=30) as db:
            return db.execute(sql, values).fetchall()

    def find_one(self, which, fields=None):
        rows = self._run("SELECT v FROM d WHERE k = ?", repr(which["_id"]))
        return {"_id": which["_id"], "value": eval(rows[0][0])} if rows else None

    def replace_one(self, which, document, upsert):
        assert upsert and document["_id"] == which["_id"]
        self._run("INSERT OR REPLACE INTO d VALUES (?, ?)", repr(which["_id"]), repr(document["value"]))

    def delete_one(self, which):
        self._run("DELETE FROM d WHERE k = ?", repr(which["_id"]))

    def find(self, which, fields=None):
        return [{"_id": eval(k), "value": eval(v)} for k, v in self._run("SELECT k, v FROM d ORDER BY k")]


class Session:
    """What CassandraStore calls, over a SQLite file."""

    levels: list[int] = []

    class Statement:
        consistency_level = None

        def __init__(self, cql):
            self.cql = cql

    def __init__(self, path):
        self.path = path

    def prepare(self, cql):
        return self.Statement(cql)

    def execute(self, statement, values=()):
        cql = statement if isinstance(statement, str) else statement.cql
        if not isinstance(statement, str):
            Session.levels.append(statement.consistency_level)
        if cql.startswith("CREATE KEYSPACE"):
            return None
        cql = cql.replace("space.", "space_").replace("INSERT INTO", "INSERT OR REPLACE INTO")
        with sqlite3.connect(self.path, timeout=30) as db:
            return db.execute(cql, values).fetchall()


class Plain:
    """A DB-API connection to SQLite that leaves out what only a column store's DDL has."""

    def __init__(self, path):
        self.db = sqlite3.connect(path, timeout=30)
        self.commit, self.rollback, self.close = self.db.commit, self.db.rollback, self.db.close

    def cursor(self):
        inner, c = self.db.cursor(), self

        class Cursor:
            fetchone, fetchall, executemany = inner.fetchone, inner.fetchall, inner.executemany

            @property
            def description(self):
                return inner.description

            def execute(self, sql, values=()):
                return inner.execute(re.sub(r" ENGINE = .*", "", sql), values)

        assert c
        return Cursor()


def connect(path):
    return Plain(path)


def _contract(store, one, two):
    assert isinstance(store, Store)
    assert store.get("a") is None and not store.contains("a")
    store.put("a", one)
    store.put("b", one)
    store.put("a", two)
    assert store.get("a") == two and store.contains("b")
    store.remove("b")
    store.remove("never there")
    assert list(store.keys()) == ["a"] and list(store.items()) == [("a", two)]
    with pytest.raises(ValueError):
        store.put(None, one)


def test_document_store(spark, tmp_path):
    store = external.MongoStore("m", functools.partial(Collection, str(tmp_path / "m")))
    _contract(store, {"n": 1}, {"n": 2, "tags": ["x"]})
    store.write_batch("k")(spark.createDataFrame([("a", 5), ("c", None)], "k string, n int"), 0)
    assert store.get("a") == {"n": 5} and store.get("c") == {"n": None}


def test_wide_column_store(spark, tmp_path):
    store = external.CassandraStore("space", "s", functools.partial(Session, str(tmp_path / "c")))
    store.create()
    store.create()
    _contract(store, 1, [2])
    assert set(Session.levels) == {4}
    store.write_batch("k")(spark.createDataFrame([("a", 5), ("ü", 6)], "k string, n int"), 0)
    assert store.get("a") == {"n": 5}
    assert external.keyspace_ddl("s", "NetworkTopologyStrategy", {"dc1": 3}, False).endswith("{'class': 'NetworkTopologyStrategy', 'dc1': '3'} AND durable_writes = false")
    with pytest.raises(ValueError):
        external.keyspace_ddl("s; DROP")


def test_append_only_store(spark, tmp_path):
    store = external.ClickHouseStore("t", functools.partial(connect, str(tmp_path / "h")), "n int, s string", mark="?")
    assert store.ddl() == "CREATE TABLE IF NOT EXISTS t (key String, timestamp Int64, n Int32, s String) ENGINE = ReplacingMergeTree(timestamp) ORDER BY (key)"
    store.create()
    _contract(store, {"n": 1, "s": "x"}, {"n": 2, "s": None})
    save = store.write_batch("k")
    for n in (7, 7, 8):
        save(spark.createDataFrame([("a", n, "batch"), ("d", None, None)], "k string, n int, s string"), n)
    assert store.get("a") == {"n": 8, "s": "batch"} and dict(store.items()) == {"a": {"n": 8, "s": "batch"}, "d": {"n": None, "s": None}}
    assert external.sql_type(external.StructType.fromDDL("l array<bigint>")["l"].dataType, "clickhouse") == "Array(Int64)"


RELATIONAL = "name string, total double, tags array<string>, items array<struct<sku: string, n: int>>"


def test_relational_store(spark, tmp_path):
    file = functools.partial(connect, str(tmp_path / "r"))
    store = external.RelationalStore("orders", file, RELATIONAL, "sqlite")
    store.create()
    store.create()
    one = {"name": "x", "total": 1.5, "tags": ["p", "q"], "items": [{"sku": "s", "n": 1}, {"sku": "t", "n": None}]}
    two = {"name": None, "total": None, "tags": [], "items": [{"sku": "u", "n": 3}]}
    _contract(store, one, two)
    store.put("a", {"name": "only"})
    assert store.get("a") == {"name": "only", "total": None, "tags": [], "items": []}
    rows = [(i, "n", float(i), ["t"] * i, [("s", i)]) for i in range(5)]
    store.write_batch("k", 2)(spark.createDataFrame(rows, "k int, " + RELATIONAL).coalesce(1), 0)
    assert store.get(3) == {"name": "n", "total": 3.0, "tags": ["t"] * 3, "items": [{"sku": "s", "n": 3}]}


def test_a_relational_write_is_whole_or_not_at_all(tmp_path):
    store = external.RelationalStore("o", functools.partial(connect, str(tmp_path / "r")), "name string, tags array<string>", "sqlite")
    store.create()
    store.put("a", {"name": "x", "tags": ["p"]})
    with pytest.raises(Exception):
        store.put_all([("a", {"name": "y", "tags": ["q"]}), ("b", {"name": "z", "tags": [object()]})])
    assert store.get("a") == {"name": "x", "tags": ["p"]} and not store.contains("b")


def test_relational_tables_only_grow(tmp_path):
    file = functools.partial(connect, str(tmp_path / "r"))
    external.RelationalStore("o", file, "name string", "sqlite").create()
    wider = external.RelationalStore("o", file, "name string, n bigint", "sqlite")
    assert wider.grow() == ["o.n"] and wider.grow() == []
    with pytest.raises(ValueError):
        external.RelationalStore("o", file, "name string, other int", "sqlite", allow_changes=False).grow()
    assert "NVARCHAR(450)" in external.RelationalStore("o", file, "d decimal(10,2)", "sqlserver").ddl()[0]
    assert "NUMERIC(18,2)" in external.RelationalStore("o", file, "d decimal(10,2)", "postgres").ddl()[0]


class Scripted:
    """A connection that answers each query from a table and keeps what it was told."""

    def __init__(self, answers):
        self.answers, self.told, self.rows = answers, [], None

    def cursor(self):
        return self

    def execute(self, sql, values=()):
        self.told.append(sql)
        self.rows = next((a.pop(0) if a else None for k, a in self.answers.items() if k in sql), None)

    def fetchone(self):
        return self.rows

    def commit(self):
        pass

    def close(self):
        pass


def test_a_slot_is_made_once():
    settings = lifecycle.FeedSettings(configure=True, replica_identity=lifecycle.ReplicaIdentity.FULL)
    db = Scripted({"pg_publication": [None, (1,)], "pg_replication_slots": [None, (1,)]})
    assert lifecycle.prepare_postgres(lambda: db, "public", "t", "s", "p", settings) == ["replica identity", "publication", "slot"]
    assert lifecycle.prepare_postgres(lambda: db, "public", "t", "s", "p", settings) == ["replica identity"]
    assert lifecycle.prepare_postgres(lambda: db, "public", "t", "s", "p", lifecycle.FeedSettings()) == []
    with pytest.raises(ValueError):
        lifecycle.prepare_postgres(lambda: db, "public", 't"; DROP', "s", "p", settings)


def test_a_capture_instance_is_waited_for():
    waits = []
    db = Scripted({"sys.databases": [(0,)], "sys.tables": [(0,)], "change_tables": [None, None, (1,)]})
    assert lifecycle.prepare_sqlserver(lambda: db, "dbo", "t", lifecycle.FeedSettings(configure=True), sleep=waits.append) == "dbo_t"
    assert waits == [0.5, 0.5] and sum("sp_cdc_enable" in s for s in db.told) == 2
    with pytest.raises(TimeoutError):
        lifecycle.prepare_sqlserver(lambda: Scripted({}), "dbo", "t", lifecycle.FeedSettings(), timeout=1, sleep=waits.append)


def test_failed_polls_wait_longer_and_then_go_on():
    class Flaky(PolledSource):
        answers = [OSError(), OSError(), OSError(), [("x",)], OSError(), []]

        def poll(self, offset):
            a = self.answers.pop(0)
            if isinstance(a, Exception):
                raise a
            return a, {"position": offset["position"] + len(a)}

    waits = []
    source = lifecycle.with_backoff(Flaky, lifecycle.FeedSettings(max_backoff_seconds=3), sleep=waits.append)({})
    at, seen = {"position": 0}, []
    for _ in range(6):
        rows, at = source.poll(at)
        seen += rows
    assert seen == [("x",)] and at == {"position": 1} and waits == [1.0, 2.0, 3.0, 1.0]


def test_the_snapshot_comes_first_where_asked_for(spark):
    table = spark.createDataFrame([(1, "a")], "id int, name string")
    changes = spark.createDataFrame([("INSERT", (2, "b"))], "operation string, data struct<id: int, name: string>")
    got = lifecycle.with_snapshot(changes, lambda: table, lifecycle.FeedSettings())
    assert sorted(r.operation for r in got.collect()) == ["INSERT", "InitialLoad"]
    assert lifecycle.with_snapshot(changes, lambda: table, lifecycle.FeedSettings(initial_load=False)).count() == 1
    assert lifecycle.FeedSettings().trigger == "3000 milliseconds"
