"""The builder, its operators and the reference scenarios over event time, in batch and as streams."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamframe.builder import Emitter, StreamBuilder
from streamframe.operators import join as joins
from streamframe.operators import keyed, windows
from streamframe.streaming import fan_out, fold_per_row, group_per_row, live_table_join, read_state
from streamframe.telemetry import InMemoryProvider

T0 = datetime(2024, 3, 4, 10, 0, 0)


def sums():
    return {"n": F.count("*"), "total": F.sum("value")}


def events(spark, rows):
    return spark.createDataFrame([(k, v, T0 + timedelta(seconds=s)) for k, v, s in rows], "key string, value int, ts timestamp")


def test_map_filter_sink_runs_in_order(spark):
    got = []
    s = StreamBuilder.create("ints").stream(spark.createDataFrame([(i,) for i in (5, -1, 7, None)], "value int"))
    s = s.filter("value > 0").map(doubled=F.col("value") * 2).sink(lambda df: got.extend(r.doubled for r in df.collect())).build()
    assert s.status == "Stopped" and got == []
    s.start()
    assert s.status == "Running" and sorted(got) == [10, 14]
    s.stop()
    assert s.status == "Stopped"


def test_flat_map_of_words(spark):
    s = StreamBuilder.create("s").stream(spark.createDataFrame([("Hello world",), ("",), (None,), ("a b c",)], "value string"))
    words = s.flat_map(F.split("value", " "), "word").filter("word <> ''").map(word=F.upper("word")).build().result
    assert sorted(r.word for r in words.collect()) == ["A", "B", "C", "HELLO", "WORLD"]


def test_strict_null_rules(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "key string, value int")
    s = StreamBuilder.create("s").stream(df)
    with pytest.raises(Exception, match="key is null"):
        s.require("key").build().result.collect()
    with pytest.raises(Exception, match="the key key is null"):
        s.aggregate("key", strict=True, n=F.count("*")).build().result.collect()
    assert s.aggregate("key", n=F.count("*")).build().result.count() == 2


def test_building_refuses_what_cannot_run(spark):
    df = spark.range(1)
    s = StreamBuilder.create("s")
    with pytest.raises(RuntimeError):
        s.filter("id > 0")
    with pytest.raises(RuntimeError):
        s.stream(df).stream(df)
    with pytest.raises(ValueError):
        s.stream(df).add_branch(" ", lambda b: b.filter("id > 0"))
    with pytest.raises(TypeError):
        s.stream(df).add_branch("b", None)
    with pytest.raises(RuntimeError):
        s.stream(df).add_branch("b", lambda b: b)
    with pytest.raises(ValueError):
        s.stream(df).add_branch("b", lambda b: b.filter("id > 0")).add_branch("b", lambda b: b.filter("id > 0"))
    with pytest.raises(RuntimeError):
        s.stream(df).build().emit([(1,)])
    with pytest.raises(ValueError):
        StreamBuilder.create("")


def test_branches_of_a_stream(spark, tmp_path):
    got = {"main": [], "even": [], "deep": []}
    take = lambda name: lambda df: got[name].extend(r.v for r in df.collect())
    spark.range(10).selectExpr("id v").write.parquet(str(tmp_path / "in"))
    s = StreamBuilder.create("branched").stream(spark.readStream.schema("v long").parquet(str(tmp_path / "in"))).filter("v > 0")
    s = s.add_branch("even", lambda b: b.filter("v % 2 = 0").add_branch("deep", lambda c: c.filter("v > 5").sink(take("deep"))).sink(take("even")))
    run = s.sink(take("main")).build()
    for _ in range(2):  # the second run goes on from the checkpoints
        run.start(str(tmp_path / "c"), trigger={"availableNow": True})
        for q in run._queries:
            q.awaitTermination(60)
    run.stop()
    assert {k: sorted(v) for k, v in got.items()} == {"main": list(range(1, 10)), "even": [2, 4, 6, 8], "deep": [6, 8]} and run.status == "Stopped"


def test_branches_and_the_main_path(spark):
    got = defaultdict(list)
    s = StreamBuilder.create("s").stream(spark.createDataFrame([(i,) for i in range(10)], "v int"))
    s = s.add_branch("even", lambda b: b.filter("v % 2 = 0").sink(lambda df: got["even"].extend(r.v for r in df.collect())))
    s = s.add_branch("big", lambda b: b.filter("v > 6").aggregate(["v"], store="seen", n=F.count("*")).sink(lambda df: got["big"].extend(r.v for r in df.collect())))
    s = s.filter("v < 2").sink(lambda df: got["main"].extend(r.v for r in df.collect())).build().start()
    assert sorted(got["even"]) == [0, 2, 4, 6, 8] and sorted(got["big"]) == [7, 8, 9] and sorted(got["main"]) == [0, 1]
    assert set(s.branches) == {"even", "big"} and s.state_store("seen").get(8)["n"] == 1 and s.state_store("none") is None


def test_group_by_emits_the_list_so_far(spark):
    df = events(spark, [("a", 1, 0), ("b", 2, 1), ("a", 3, 2)])
    s = StreamBuilder.create("s").stream(df)
    rows = s.group_by("key", F.col("value"), ["ts"], "changelog", store="g").build()
    assert {(r.key, r.value): r["values"] for r in rows.result.collect()} == {("a", 1): [1], ("b", 2): [2], ("a", 3): [1, 3]}
    assert dict((k, v["values"]) for k, v in rows.state_store("g").items()) == {"a": [1, 3], "b": [2]}
    silent = s.group_by_silently("key", F.col("value"), ["ts"], store="g").build()
    assert silent.result.count() == 3 and silent.state_store("g").get("a") == {"values": [1, 3]}


def test_aggregates_and_folds(spark):
    df = events(spark, [("a", 1, 0), ("a", 5, 1), ("b", 2, 2), ("a", 3, 3)])
    s = StreamBuilder.create("s").stream(df)
    log = s.aggregate("key", ["ts"], "changelog", total=F.sum("value")).build().result
    assert {(r.key, r.value): r.total for r in log.collect()} == {("a", 1): 1, ("a", 5): 6, ("b", 2): 2, ("a", 3): 9}
    step = lambda a, x: F.concat(a, F.lit(">"), x.cast("string"))
    end = s.fold("key", F.col("value"), F.lit(""), step, ["ts"]).build().result
    assert {r.key: r.state for r in end.collect()} == {"a": ">1>5>3", "b": ">2"}
    each = s.fold("key", F.col("value"), F.lit(""), step, ["ts"], "changelog").build().result
    assert {r.value: r.state for r in each.collect()} == {1: ">1", 5: ">1>5", 2: ">2", 3: ">1>5>3"}
    with pytest.raises(ValueError):
        keyed.aggregate(df, "key", {"n": F.count("*")}, emit="changelog")


def model_sessions(rows, gap):
    out, held = [], {}
    for k, v, s in sorted(rows, key=lambda r: r[2]):
        if k in held and s - held[k][1] <= gap:
            held[k] = (held[k][0], s, held[k][2] + v)
        else:
            if k in held:
                out.append((k, *held[k]))
            held[k] = (s, s, v)
    return sorted(out + [(k, *h) for k, h in held.items()])


def test_windows_equal_a_model(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(9), rng.randrange(600)) for _ in range(200)]
    df = events(spark, rows)
    at = lambda t: int((t - T0).total_seconds())
    got = sorted((r.key, at(r.session_start), at(r.session_end), r.total) for r in windows.session(df, "key", "ts", "7 seconds", sums()).collect())
    assert got == model_sessions(rows, 7)
    epoch = datetime(1, 1, 1)
    for d in (7, 60):
        want = defaultdict(int)
        for k, v, s in rows:
            since = int((T0 - epoch).total_seconds()) + s
            want[k, s - since % d] += v
        assert {(r.key, at(r.window_start)): r.total for r in windows.tumbling(df, "key", "ts", f"{d} seconds", sums()).collect()} == want
    want = defaultdict(int)
    for k, v, s in rows:
        for i in range(3):
            want[k, s - 15 + 5 + 5 * i] += v
    assert {(r.key, at(r.window_start)): r.total for r in windows.sliding(df, "key", "ts", "15 seconds", "5 seconds", sums(), "anchored").collect()} == want
    aligned = windows.sliding(df, "key", "ts", "15 seconds", "5 seconds", sums())
    assert aligned.agg(F.sum("n")).first()[0] == 3 * len(rows)


def test_window_boundaries(spark):
    df = events(spark, [("a", 1, 0), ("a", 1, 5), ("a", 1, 11)])
    assert sorted(r.n for r in windows.session(df, "key", "ts", "5 seconds", sums()).collect()) == [1, 2]
    assert windows.tumbling(df, "key", "ts", "7 days", sums()).first().window_start.weekday() == 0
    with pytest.raises(ValueError):
        windows.sliding(df, "key", "ts", "5 seconds", "6 seconds", sums())
    for bad in ("", "1 month", "5", "0 seconds", "x days"):
        with pytest.raises(ValueError):
            windows.seconds(bad)
    assert windows.seconds("1 day 2 hours") == 93_600 and windows.tumbling(df.limit(0), "key", "ts", "1 day", sums()).count() == 0


def test_join_keeps_null_values_and_one_match(spark):
    left = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k3"), (4, None)], "id int, key string")
    table = spark.createDataFrame([("k1", None, 1), ("k2", "old", 1), ("k2", "new", 2)], "key string, v string, version int")
    out = joins.stream_table_join(left, table, "key", "key", None, ["version"], small=True)
    assert sorted((r[0], r[3]) for r in out.collect()) == [(1, None), (2, "new")]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_small_is_checked(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    left, table = spark.range(10), spark.range(10).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.stream_table_join(left, table, "id", "k", small=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan


def test_telemetry_counts_rows(spark):
    p = InMemoryProvider()
    s = StreamBuilder.create("t").stream(spark.range(10)).with_telemetry(p).filter("id > 3").map("id").sink(lambda df: df.collect()).build()
    s.start()
    assert [v for k, v in sorted(p.counters.items(), key=str)] == [6, 6]
    with pytest.raises(KeyError), p.span("x"):
        raise KeyError
    assert p.spans[0]["status"] == "error"


# streams


def test_emit_and_state_survive_a_restart(spark, tmp_path):
    got = []
    e = Emitter(spark, "key string, value int", f"file://{tmp_path}/in")

    def build():
        s = StreamBuilder.create("emitted").stream(e).aggregate("key", store="t", total=F.sum("value"))
        return s.sink(lambda df: got.extend((r.key, r.total) for r in df.collect())).build()

    s = build().start(f"{tmp_path}/check", "update")
    s.emit([("a", 1), ("b", 2)])
    s.emit([("a", 5)])
    s.stop()
    s = build().start(f"{tmp_path}/check", "update")
    s.emit([("a", 10)])
    s.stop()
    assert s.status == "Stopped" and got[-1] == ("a", 16) and sorted(got[:2]) == [("a", 1), ("b", 2)]
    assert {r.key["key"]: r.value[0] for r in read_state(spark, f"{tmp_path}/check").collect()} == {"a": 16, "b": 2}


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", 1, 0), ("a", 2, 3), ("b", 3, 4), ("a", 4, 30), ("b", 5, 31), ("z", 0, 10_000)]
    df = events(spark, rows)
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    for name, make in (("tumbling", lambda d: windows.tumbling(d, "key", "ts", "10 seconds", sums())), ("session", lambda d: windows.session(d, "key", "ts", "5 seconds", sums()))):
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds")
        out = []
        q = make(stream).writeStream.outputMode("append").foreachBatch(lambda b, _, out=out: out.extend(map(str, b.collect()))).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(out) == sorted(map(str, make(df).filter("key <> 'z'").collect()))


def test_per_row_state(spark, tmp_path):
    events(spark, [("a", 1, 0), ("a", 2, 3), ("b", 3, 4)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    src = lambda: spark.readStream.schema("key string, value int, ts timestamp").parquet(f"{tmp_path}/in")
    folded, lists = [], []
    q = fold_per_row(src(), "key", lambda a, r: a + int(r["value"]), 0, "long", ["ts"]).writeStream.outputMode("update").foreachBatch(lambda b, _: folded.extend((r.key, r.value, r.state) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(folded) == [("a", 1, 1), ("a", 2, 3), ("b", 3, 3)]
    q = group_per_row(src(), "key", "value", "int", ["ts"]).writeStream.outputMode("update").foreachBatch(lambda b, _: lists.extend((r.key, list(r["values"])) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(lists) == [("a", [1]), ("a", [1, 2]), ("b", [3])]


def test_fan_out_and_live_tables(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    src = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    got = defaultdict(list)
    fan_out(src(), {"even": (lambda d: d.filter("id % 2 = 0"), lambda d: got["even"].extend(r.id for r in d.collect())), "all": (lambda d: d, lambda d: got["all"].extend(r.id for r in d.collect()))}, f"{tmp_path}/c1").awaitTermination()
    assert len(got["even"]) == 5 and len(got["all"]) == 10
    live_table_join(src(), lambda: spark.createDataFrame([(3, "x")], "k long, v string"), lambda d, t: d.join(t, d.id == t.k), lambda d: got["live"].extend(r.v for r in d.collect()), f"{tmp_path}/c2").awaitTermination()
    assert got["live"] == ["x"]


def test_windows_by_the_clock(spark, tmp_path):
    import time

    from streamframe.streaming import session_by_clock, tumbling_by_clock

    for name, make in (("tumbling", tumbling_by_clock), ("session", session_by_clock)):
        e, got = Emitter(spark, "key string, value int", f"file://{tmp_path}/{name}-in"), []
        out = make(e.stream(), "key", "value", "int", 400, lambda v: int(sum(v)), "long")
        q = out.writeStream.outputMode("update").foreachBatch(lambda b, _, got=got: got.extend((r.key, r.value) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/{name}").start()
        try:
            e.emit([("a", 1), ("a", 2)])
            for _ in range(80):  # a query with timers never has nothing to do, so it is polled
                if got:
                    break
                q.awaitTermination(0.5)
            assert got == [("a", 3)]
        finally:
            q.stop()


def test_http_source_polls(spark, tmp_path):
    import http.server
    import threading

    from streamframe.sources.connectors import http_source

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"ID": 4, "name": "x"}')

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = []
    q = http_source(spark, f"http://127.0.0.1:{server.server_port}/", "id int, name string").writeStream.foreachBatch(lambda b, _: got.extend((r.id, r.name) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for _ in range(60):
            if got:
                break
            q.awaitTermination(0.5)
    finally:
        q.stop()
        server.shutdown()
    assert got[0] == (4, "x")
