"""Stores, codecs, union types, CDC, connectors, the mediator, and the registered queries."""

import http.server
import json
import os
import sqlite3
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streamframe.functions import codecs, parsing, unions
from streamframe.mediator import HandlerMissing, Mediator, ValidationError, logging_behavior, unit_of_work
from streamframe.sources import cdc, connectors, files
from streamframe.state import InMemoryStore, JdbcStore, SqliteStore, Store, TableView, VersionedStore, relational


def contract(store):
    store.put("a", {"x": 1})
    store.put("b", {"x": 2})
    store.put("a", {"x": 3})
    assert store.get("a") == {"x": 3} and store.get("zz") is None and store.contains("b") and not store.contains("zz")
    assert sorted(store.keys()) == ["a", "b"] and sorted((k, v["x"]) for k, v in store.items()) == [("a", 3), ("b", 2)]
    store.remove("a")
    store.remove("a")
    assert sorted(store.keys()) == ["b"] and isinstance(store, Store)


def test_stores_keep_the_contract(spark, tmp_path):
    contract(InMemoryStore("m"))
    contract(SqliteStore(str(tmp_path / "s.db"), "s"))
    contract(VersionedStore(spark, f"file://{tmp_path}/v", "k string, x int", "k"))
    path = str(tmp_path / "j.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE kv (k TEXT PRIMARY KEY, v TEXT)")
    contract(JdbcStore("kv", lambda: sqlite3.connect(path), "sqlite"))
    with pytest.raises(ValueError):
        InMemoryStore().put(None, 1)
    m = InMemoryStore()
    threads = [threading.Thread(target=lambda: m.update("n", lambda v: (v or 0) + 1)) for _ in range(100)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert m.get("n") == 100
    view = TableView(m)
    with pytest.raises(TypeError):
        view.put("n", 1)


def test_versioned_store_compacts_and_batches(spark, tmp_path):
    s = VersionedStore(spark, f"file://{tmp_path}/v", "k string, x int", "k")
    for v in range(3):
        s.put_all(spark.createDataFrame([("a", v), ("b", v * 10)], "k string, x int"))
    s.remove_all(spark.createDataFrame([("b",)], "k string"))
    s.compact()
    assert [(r.k, r.x) for r in s.as_dataframe().collect()] == [("a", 2)]
    s.put("c", {"x": 7})
    again = VersionedStore(spark, f"file://{tmp_path}/v", "k string, x int", "k")
    assert again.get("a") == {"x": 2} and again.get("c") == {"x": 7} and again.get("b") is None
    again.compact()
    assert s.get("c") == {"x": 7}


def test_stores_take_a_streams_rows(spark, tmp_path):
    s = SqliteStore(str(tmp_path / "s.db"), "s")
    s.write_batch("k")(spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int"), 0)
    assert s.get("b") == {"x": 2}
    path = str(tmp_path / "j.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE kv (k TEXT PRIMARY KEY, v TEXT)")
    j = JdbcStore("kv", lambda: sqlite3.connect(path, timeout=30), "sqlite")
    j.write_batch("k")(spark.createDataFrame([(i, i * i) for i in range(50)], "k int, x int").repartition(2), 0)
    assert j._run("SELECT count(*) FROM kv")[0][0] == 50


def test_relational_round_trip(spark):
    rows = [("a", 1, [(1, "x"), (2, "y")], [5, 6]), ("b", 2, [], None)]
    df = spark.createDataFrame(rows, "k string, n int, items array<struct<q: int, s: string>>, tags array<int>")
    tables = relational.to_tables(df, "k", "base")
    assert set(tables) == {"base", "base_items", "base_tags"} and tables["base_tags"].columns == ["k", "ItemIndex", "value"]
    back = {r.k: r for r in relational.from_tables(tables, df.schema, "k", "base").collect()}
    assert [tuple(i) for i in back["a"]["items"]] == [(1, "x"), (2, "y")] and back["a"].tags == [5, 6] and back["b"].tags == []
    wanted = StructType.fromDDL("k string, n int, more double")
    assert relational.with_schema(tables["base"], wanted).columns == ["k", "n", "more"]
    with pytest.raises(ValueError):
        relational.with_schema(tables["base"], wanted, allow=False)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_unions(spark):
    u = unions.one_of(["int", "string"], 1, F.lit("x"))
    r = one(spark, unions.is_type(u, 1), unions.as_type(u, 1), unions.try_get(u, 0), unions.match(u, lambda i: F.lit("int"), lambda s: F.concat(s, s)))
    assert tuple(r) == (True, "x", None, "xx")
    with pytest.raises(Exception, match="not of case 0"):
        one(spark, unions.as_type(u, 0))
    a = unions.any_of(["int", "string"], {0: F.lit(1), 1: F.lit("1")})
    assert tuple(one(spark, unions.has_type(a, 0), F.array_join(unions.matching_types(a, ["i", "s"]), ","), unions.match_first(a, lambda i: F.lit("i"), lambda s: F.lit("s")))) == (True, "i,s", "i")
    v = F.struct(F.lit("n").alias("name"), F.lit(None).cast("int").alias("age"))
    assert one(spark, unions.satisfies(v, [["name"]]))[0] and not one(spark, unions.satisfies(v, [["name"], ["age"]]))[0]
    with pytest.raises(Exception, match="does not satisfy"):
        one(spark, unions.all_of(v, [["age"]]))


def test_codecs(spark):
    kind = StructType.fromDDL("user_id int, Name string, inner struct<a_b: int>")
    df = spark.createDataFrame([(1, "n", (2,))], kind)
    assert json.loads(df.select(codecs.to_camel_json(F.struct("*"), kind)).first()[0]) == {"userId": 1, "name": "n", "inner": {"aB": 2}}
    text = F.lit('{"USER_ID": "7", "name": "x", "Name": "y"}')
    assert tuple(one(spark, codecs.from_json_any_case(text, StructType.fromDDL("user_id int, name string")).alias("r")).r) == (7, "y")
    assert one(spark, codecs.from_json_any_case(F.lit(None).cast("string"), StructType.fromDDL("a int")))[0] is None
    assert one(spark, codecs.from_base64(codecs.to_base64(F.lit("é"))), codecs.from_base64(F.lit("")))[:] == ("é", None)
    assert one(spark, codecs.csv_line(F.lit(1), F.lit(None), F.lit("x")))[0] == "1,,x"
    assert tuple(one(spark, codecs.from_naive_csv(F.lit('4,"a,b'), ["ID", "name"], StructType.fromDDL("id int, name string, more int")).alias("r")).r) == (4, '"a', None)
    assert one(spark, codecs.from_xml(codecs.to_xml(F.struct(F.lit(3).alias("a"))), "a int").alias("r")).r.a == 3
    assert one(spark, parsing.parse_or_default(F.lit("x"), "int"), parsing.parse_or_default(F.lit("x"), "int", True), parsing.parse_or_default(F.lit("4"), "int"))[:] == (0, None, 4)
    assert parsing.column_type("clickhouse", "decimal") == "decimal(18,4)" and parsing.column_type("postgres", "else") == "string"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    files.FileSink(f"{tmp_path}/one", "csv", "single").write(df)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/one").collect()) == ["1,a", "2,"]
    files.FileSink(f"{tmp_path}/many", "json", "multi", per_record=True).write(df)
    assert len([f for f in os.listdir(tmp_path / "many") if f.startswith("part") and os.path.getsize(tmp_path / "many" / f)]) == 2
    assert sorted(r.id for r in files.read_jsonl(spark, f"{tmp_path}/many", "ID int", any_case=True).select(F.col("ID").alias("id")).collect()) == [1, 2]
    files.FileSink(f"{tmp_path}/x", "xml").write(df)
    assert sorted(r.id for r in files.read_xml(spark, f"{tmp_path}/x", "id int, name string", "ROW", per_line=True).collect()) == [1, 2]
    files.ObjectStoreSink(f"{tmp_path}/o", 1).write(df)
    assert spark.read.json(f"{tmp_path}/o").count() == 2
    (tmp_path / "c.csv").write_text('id,name\n1,"x,y"\n')
    assert files.read_csv(spark, f"{tmp_path}/c.csv", "id int, name string").first().name == "x,y"
    assert files.read_csv(spark, f"{tmp_path}/c.csv", "id int, name string", naive=True).first().name == '"x'
    with pytest.raises(ValueError):
        files.FileSink("p", mode="some")


def test_cdc_decoders(spark):
    w = json.dumps({"timestamp": "2024-01-01 00:00:00", "change": [
        {"kind": "insert", "schema": "public", "table": "t", "columnnames": ["id", "v"], "columnvalues": [1, "a"]},
        {"kind": "insert", "schema": "public", "table": "other", "columnnames": ["id"], "columnvalues": [9]},
        {"kind": "delete", "schema": "public", "table": "t", "oldkeys": {"keynames": ["id"], "keyvalues": [1]}}]})
    rows = cdc.from_wal2json(spark.createDataFrame([("0/1", w)], "lsn string, data string"), "data", "public", "t").orderBy("place").collect()
    assert [(r.operation, r["data"]["id"], r.lsn) for r in rows] == [("INSERT", "1", "0/1"), ("DELETE", "1", "0/1")]
    s = spark.createDataFrame([(bytearray(b"\1"), bytearray(b"\1"), c, 5) for c in (1, 2, 3, 4, 5, 8)], "`__$start_lsn` binary, `__$seqval` binary, `__$operation` int, id int")
    got = cdc.from_sqlserver(s)
    assert sorted(r.operation for r in got.collect()) == ["Delete", "Insert", "Merge", "Unknown", "Update (new value)"] and cdc.latest_lsn(got) == b"\1"
    m = [json.dumps({"operationType": o, "fullDocument": None if o == "delete" else {"a": 1}, "documentKey": {"_id": 1}}) for o in ("insert", "delete", "drop")]
    got = cdc.from_change_stream(spark.createDataFrame([(x,) for x in m], "e string"), "e", "a int").collect()
    assert [(r.operation, r["data"] and r["data"].a) for r in got] == [("INSERT", 1), ("DELETE", None)]


def test_cdc_apply(spark):
    rows = [("k", "UPDATE", 1, 1), ("k", "UPDATE", 1, 2), ("k", "DELETE", 1, 3), ("j", "INSERT", 2, 1)]
    df = spark.createDataFrame(rows, "id string, operation string, v int, n int")
    assert [r.n for r in cdc.without_repeats(df, "id", ["operation", "v"], ["n"]).orderBy("id", "n").collect()] == [1, 1, 3]
    assert [r.id for r in cdc.apply_changes(df, "id", ["n"]).collect()] == ["j"]


class Server:
    def __enter__(self):
        got = self.got = []
        self.fail = 1

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(h):
                body = h.rfile.read(int(h.headers["Content-Length"]))
                if self.fail:
                    self.fail -= 1
                    h.send_error(500)
                    return
                got.append(json.loads(body))
                h.send_response(200)
                h.end_headers()

            def log_message(self, *_):
                pass

        self.http = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_):
        self.http.shutdown()


def test_http_sink_retries(spark):
    with Server() as s:
        connectors.http_sink(f"http://127.0.0.1:{s.http.server_port}/", wait=0.01).write(spark.createDataFrame([(1, "a"), (2, "b")], "user_id int, v string").coalesce(1))
        assert sorted(x["userId"] for x in s.got) == [1, 2]


def test_message_and_search_sinks(spark, tmp_path):
    path = str(tmp_path / "sent")

    class Client:
        def send(self, messages):
            with open(path, "a") as f:
                f.write(json.dumps(messages) + "\n")

        def bulk(self, index, documents):
            return [1] if len(documents) > 1 else []

    connectors.MessageSink(Client, size=2).write(spark.createDataFrame([(i,) for i in range(5)], "a int").coalesce(1))
    assert [len(json.loads(x)) for x in open(path)] == [2, 2, 1]
    bad = str(tmp_path / "bad")
    connectors.SearchSink(Client, "i", lambda docs: open(bad, "a").write("\n".join(docs) + "\n") and None).write(spark.createDataFrame([(i,) for i in range(3)], "a int").coalesce(1))
    assert [json.loads(x) for x in open(bad)] == [{"a": 1}]
    waits = []
    with pytest.raises(ZeroDivisionError):
        connectors.with_retries(lambda: 1 / 0, 3, 0.5, waits.append)
    assert waits == [0.5, 1.0]


def test_queue_source(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    for i in range(25):
        (box / f"{i:03d}").write_text(f"m{i}")
    folder = str(box)

    class Queue:
        """Handles hold for the client that gave them only, and what it has out is not given again."""

        def __init__(self):
            self.out = {}

        def receive(self, n):
            names = [x for x in sorted(os.listdir(folder)) if x not in self.out.values()][:n]
            got = {f"{id(self)}-{x}": x for x in names}
            self.out |= got
            return [(h, open(f"{folder}/{x}").read()) for h, x in got.items()]

        def delete(self, handles):
            for h in handles:
                os.remove(f"{folder}/{self.out.pop(h)}")

        def abandon(self, handles):
            for h in handles:
                del self.out[h]

    spark.dataSource.register(connectors.queue_source("test_queue", Queue, 10))
    got = []
    q = spark.readStream.format("test_queue").load().writeStream.foreachBatch(lambda b, _: got.extend(r.value for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for _ in range(60):
            if len(set(got)) == 25:
                break
            q.awaitTermination(0.5)
    finally:
        q.stop()
    assert sorted(got) == sorted(f"m{i}" for i in range(25))
    assert len(os.listdir(folder)) <= 10  # all but the last micro-batch are acknowledged


def test_a_queue_takes_back_what_no_one_can_read():
    class Queue:
        def __init__(self):
            self.left, self.out = ["1", "x", "2"], []

        def receive(self, n):
            self.out = list(enumerate(self.left))
            return self.out

        def abandon(self, handles):
            self.out = [p for p in self.out if p[0] not in handles]

    source = connectors.queue_source("checked", Queue, 10, check=int)({})
    with pytest.raises(ValueError):
        source.poll({"position": 0})
    assert source._client().out == [] and not source.pending


def test_rows_of_several_frames_are_taken_in_one_order():
    import pandas as pd
    from streamframe.streaming import processors

    class State:
        def __init__(self):
            self.held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def appendList(self, values):
            self.held = [*(self.held or []), *values]

    frames = lambda: iter([pd.DataFrame({"k": 1, "v": [5, 3]}), pd.DataFrame({"k": 1, "v": [4, 1]})])
    fold = processors._Fold(lambda a, r: a + str(r["v"]), "", "string", ["v"], "s")
    fold.value = State()
    assert pd.concat(fold.handleInputRows((1,), frames(), None))["s"].tolist() == ["1", "13", "134", "1345"] and fold.value.held == ("1345",)
    group = processors._Group("v", "long", ["v"], "s")
    group.items = State()
    assert pd.concat(group.handleInputRows((1,), frames(), None))["s"].tolist()[-1] == [1, 3, 4, 5]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N
    from streamframe import shared

    conf = N(get=lambda k: None)
    with pytest.raises(RuntimeError):
        shared.work_path(N(sparkContext=N(getConf=lambda: conf, master="spark://host:7077", applicationId="x")), "a")


def test_mediator(tmp_path):
    class Add:
        def __init__(self, n):
            self.n = n

    m, log = Mediator(), []
    m.on_command(Add, lambda c: c.n + 1)
    m.add_behavior("command", lambda c, inner: (log.append("outer"), inner(c))[1])
    m.add_behavior("command", lambda c, inner: (log.append("inner"), inner(c))[1])
    m.add_behavior("command", logging_behavior)
    assert m.send_command(Add(1)) == 2 and log == ["outer", "inner"]
    with pytest.raises(HandlerMissing):
        m.send_query(Add(1))
    with pytest.raises(ValueError):
        m.on_command(Add, lambda c: 0)
    m.on_notification(Add, lambda c: log.append(c.n))
    m.on_notification(Add, lambda c: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        m.publish(Add(5))
    assert 5 in log and ValidationError({"a": ["bad"]}).errors == {"a": ["bad"]}
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (a)")
    with pytest.raises(KeyError), unit_of_work(db):
        db.execute("INSERT INTO t VALUES (1)")
        raise KeyError
    assert db.execute("SELECT count(*) FROM t").fetchone()[0] == 0


def test_core_imports_without_the_training_data_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys\nclass No:\n def find_spec(self, n, p=None, t=None):\n"
        "  if n == 'corpus_pipeline' or n.startswith('streamframe.llm'): raise ModuleNotFoundError(n, name=n)\n"
        "sys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nq = e.queries()\nassert 'session' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)\n"
        "assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_queries_equal_their_sql(spark):
    import duckdb
    from conftest import SF
    from streamframe.plans import queries

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    for name in ("click_count", "group_by_final", "aggregate_fold", "tumbling_week", "sliding_anchored", "session", "stream_table_join", "cdc_apply", "relational_child_roundtrip", "one_of_match"):
        df = queries.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted(str(tuple(plain(x) for x in r)) for r in df.select(*cols).collect())
        want = sorted(str(tuple(plain(x) for x in r)) for r in db.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall())
        assert got == want, name


def test_change_feeds_resume_and_acknowledge():
    from streamframe.sources import cdc_feeds

    log = [("0/A", "a"), ("0/1F", "b"), ("1/0", "c")]

    class Cursor:
        def execute(self, sql, values):
            if "advance" in sql:
                log[:] = [r for r in log if cdc_feeds.lsn_number(r[0]) > cdc_feeds.lsn_number(values[1])]

        def fetchall(self):
            return list(log)

    class Database:
        cursor, commit, close = (lambda s: Cursor()), (lambda s: None), (lambda s: None)

    feed = cdc_feeds.postgres_feed("pg", Database, "slot")({})
    rows, end = feed.poll(feed.first_offset())
    assert [r[1] for r in rows] == ["a", "b", "c"] and end == {"lsn": "1/0"} and [r[1] for r in feed.replay({"lsn": "0/A"}, end)] == ["b", "c"]
    feed.acknowledge({"lsn": "0/1F"})
    assert log == [("1/0", "c")] and feed.poll(end) == ([], end)

    class Events:
        def __init__(self, after):
            self.left, self.resume_token = [e for e in (1, 2, 3) if after is None or e > after], after

        __enter__, __exit__ = (lambda s: s), (lambda s, *a: None)

        def try_next(self):
            if not self.left:
                return None
            self.resume_token = self.left.pop(0)
            return {"operationType": "insert", "n": self.resume_token}

    collection = type("C", (), {"watch": lambda self, full_document, resume_after: Events(resume_after)})
    feed = cdc_feeds.mongo_feed("m", collection, 2)({})
    rows, end = feed.poll(feed.first_offset())
    assert len(rows) == 2 and end == {"token": 2} and list(feed.replay({"token": 1}, end)) == rows[1:]
    with pytest.raises(ValueError):
        cdc_feeds.sqlserver_feed("s", None, "x; drop", "*")
