"""The library's own queries over the test tables, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..builder import StreamBuilder
from ..functions import codecs, hashing, parsing, unions
from ..operators import join as joins
from ..operators import keyed, windows
from ..shared import work_path
from ..sources import cdc
from ..state import relational

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def _start(spark: SparkSession, sf_dir: str, table: str) -> StreamBuilder:
    return StreamBuilder.create(table).stream(_t(spark, sf_dir, table))


# Stateless operators.


@query("SELECT event_type, count(*) AS clicks FROM events WHERE event_type IS NOT NULL AND event_type <> '' GROUP BY event_type")
def click_count(spark, sf_dir):
    """The flagship: clean, count per key."""
    s = _start(spark, sf_dir, "events").filter("event_type is not null and event_type <> ''")
    return s.aggregate("event_type", clicks=F.count("*")).build().result


@query("SELECT l_orderkey, l_linenumber, lower(l_returnflag) AS flag, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def map_project(spark, sf_dir):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return _start(spark, sf_dir, "lineitem").map("l_orderkey", "l_linenumber", flag=F.lower("l_returnflag"), revenue=revenue).build().result


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag IN ('A', 'R')")
def filter_predicate(spark, sf_dir):
    s = _start(spark, sf_dir, "lineitem").filter((F.col("l_quantity") > 45) & F.col("l_returnflag").isin("A", "R"))
    return s.map("l_orderkey", "l_linenumber", "l_quantity").build().result


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) GROUP BY token")
def flatmap_tokens(spark, sf_dir):
    return _start(spark, sf_dir, "documents").flat_map(F.split("text", " ", -1), "token").aggregate("token", n=F.count("*")).build().result


@query("SELECT doc_id, unnest(CASE WHEN lang = 'en' THEN NULL WHEN lang = 'fr' THEN []::VARCHAR[] ELSE [lang, source] END) AS item FROM documents")
def flatmap_null_empty(spark, sf_dir):
    """Null and empty arrays give no row."""
    items = F.when(F.col("lang") == "en", F.lit(None).cast("array<string>")).when(F.col("lang") == "fr", F.array().cast("array<string>")).otherwise(F.array("lang", "source"))
    return _start(spark, sf_dir, "documents").flat_map(items, "item", keep=["doc_id"]).build().result


@query("SELECT conv_id, turn, (generate_subscripts(w, 1) - 1)::INT AS place, unnest(w) AS word FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)")
def flatmap_ordered(spark, sf_dir):
    return _start(spark, sf_dir, "conversations").flat_map(F.split("text", " ", -1), "word", "place", ["conv_id", "turn"]).build().result


@query("SELECT doc_id, length(text) // 100 AS hundreds FROM documents WHERE text IS NOT NULL")
def custom_operator(spark, sf_dir):
    def hundreds(df: DataFrame) -> DataFrame:
        return df.select("doc_id", F.expr("length(text) div 100").alias("hundreds"))

    return _start(spark, sf_dir, "documents").filter("text is not null").use(hundreds).build().result


@query("SELECT doc_id, length(text)::BIGINT AS size FROM documents")
def map_batches(spark, sf_dir):
    """A Python function over Arrow batches."""
    s = _start(spark, sf_dir, "documents").map("doc_id", "text")
    return s.map_batches(lambda f: f.assign(size=f.text.str.len()).loc[:, ["doc_id", "size"]], "doc_id long, size long").build().result


@query("SELECT DISTINCT user_id, upper(event_type) || '!' AS shout FROM events WHERE value > 50")
def full_pipeline(spark, sf_dir):
    s = _start(spark, sf_dir, "events").filter("value > 50").map("user_id", shout=F.concat(F.upper("event_type"), F.lit("!")))
    return s.use(DataFrame.distinct).build().result


# Grouping and folding.


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id")
def group_by_final(spark, sf_dir):
    s = _start(spark, sf_dir, "events").group_by("user_id", F.col("event_id"), ["ts", "event_id"], name="v")
    return s.map("user_id", ids=F.array_join("v", ",")).build().result


@query("SELECT event_id, user_id, count(*) OVER w AS n, md5(string_agg(event_id::VARCHAR, ',') OVER w) AS seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def group_by_changelog(spark, sf_dir):
    """The list after each row: its length and a digest."""
    s = _start(spark, sf_dir, "events").group_by("user_id", F.col("event_id"), ["ts", "event_id"], "changelog", "v")
    return s.map("event_id", "user_id", n=F.size("v").cast("long"), seen=F.md5(F.array_join("v", ",").cast("binary"))).build().result


@query("SELECT event_id, user_id FROM events")
def group_by_silent(spark, sf_dir):
    return _start(spark, sf_dir, "events").group_by_silently("user_id", F.col("event_id"), ["ts", "event_id"], store="lists").map("event_id", "user_id").build().result


@query("SELECT user_id, len(list(event_id)) AS n FROM events GROUP BY user_id")
def group_by_silent_store(spark, sf_dir):
    """What the silent step left in its store."""
    s = _start(spark, sf_dir, "events").group_by_silently("user_id", F.col("event_id"), ["ts", "event_id"], store="lists").build()
    return s.state_store("lists").source.select("user_id", F.size("values").cast("long").alias("n"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id")
def aggregate_final(spark, sf_dir):
    s = _start(spark, sf_dir, "events").aggregate("user_id", n=F.count("*"), total=F.round(F.sum("value"), 2), first_ts=F.min("ts"), last_ts=F.max("ts"))
    return s.build().result


@query("SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 2) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def aggregate_changelog(spark, sf_dir):
    s = _start(spark, sf_dir, "events").aggregate("user_id", ["ts", "event_id"], "changelog", n=F.count("*"), total=F.sum("value"))
    return s.map("event_id", "n", total=F.round("total", 2)).build().result


@query("""SELECT user_id, count(*) FILTER (rn > coalesce(last_error, 0)) AS since_error FROM (
  SELECT *, max(CASE WHEN event_type = 'error' THEN rn END) OVER (PARTITION BY user_id) AS last_error FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)) GROUP BY user_id""")
def aggregate_fold(spark, sf_dir):
    """An arbitrary fold: events since the user's last error."""
    s = _start(spark, sf_dir, "events").fold("user_id", F.col("event_type"), F.lit(0).cast("long"), lambda a, x: F.when(x == "error", F.lit(0).cast("long")).otherwise(a + 1), ["ts", "event_id"], name="since_error")
    return s.build().result


@query("SELECT event_id, event_type FROM events")
def aggregate_silent(spark, sf_dir):
    return _start(spark, sf_dir, "events").aggregate_silently("event_type", store="counts", n=F.count("*")).map("event_id", "event_type").build().result


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def aggregate_silent_store(spark, sf_dir):
    s = _start(spark, sf_dir, "events").aggregate_silently("event_type", store="counts", n=F.count("*")).build()
    return s.state_store("counts").source


# Windows.


def _sums() -> dict:
    return {"n": F.count("*"), "total": F.round(F.sum("value"), 2)}


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    return _start(spark, sf_dir, "events").tumbling_window("user_id", "ts", "1 day", **_sums()).build().result


@query("SELECT user_id, time_bucket(INTERVAL 7 DAY, ts) AS window_start, time_bucket(INTERVAL 7 DAY, ts) + INTERVAL 7 DAY AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_week(spark, sf_dir):
    """Weeks begin on Mondays: aligned with the first day of year 1."""
    return _start(spark, sf_dir, "events").tumbling_window("user_id", "ts", "7 days", **_sums()).build().result


@query("""SELECT user_id, s AS window_start, s + INTERVAL 2 DAY AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM (
  SELECT *, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY user_id, s""")
def sliding_aligned(spark, sf_dir):
    return _start(spark, sf_dir, "events").sliding_window("user_id", "ts", "2 days", "1 day", **_sums()).build().result


@query("""SELECT event_type, s AS window_start, s + INTERVAL 2 HOUR AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM (
  SELECT *, unnest([ts - INTERVAL 1 HOUR, ts]) AS s FROM events) GROUP BY event_type, s""")
def sliding_anchored(spark, sf_dir):
    return _start(spark, sf_dir, "events").sliding_window("event_type", "ts", "2 hours", "1 hour", "anchored", **_sums()).build().result


@query("""SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n, round(sum(value), 2) AS total FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, sid""")
def session(spark, sf_dir):
    """A session ends with its last event."""
    return _start(spark, sf_dir, "events").session_window("user_id", "ts", "12 hours", **_sums()).build().result


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY ALL")
def window_list_function(spark, sf_dir):
    """A function of a window's event list."""
    s = _start(spark, sf_dir, "events").tumbling_window("user_id", "ts", "1 day", store="results", v=windows.events_of_window("ts", "event_id"))
    return s.map("user_id", "window_start", ids=F.array_join(F.transform("v", lambda x: x["event_id"]), ",")).build().result


# Join, branches.


@query("SELECT event_id, c_custkey, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment <> 'BUILDING'")
def stream_table_join(spark, sf_dir):
    table = _t(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    return _start(spark, sf_dir, "events").join(table, "user_id", "c_custkey", ["event_id", "c_custkey", "c_mktsegment"], small=True).build().result


@query("SELECT event_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name FROM events JOIN customer ON user_id = c_custkey")
def join_null_value(spark, sf_dir):
    """A key whose value is null still joins."""
    table = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"))
    return _start(spark, sf_dir, "events").join(table, "user_id", "c_custkey", ["event_id", "name"]).build().result


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def join_unmatched(spark, sf_dir):
    return _start(spark, sf_dir, "events").join(_t(spark, sf_dir, "customer").filter("c_acctbal > 5000"), "user_id", "c_custkey", ["event_id", "user_id"]).build().result


@query("""SELECT e.event_id, o.o_orderkey AS latest_order FROM events e JOIN (
  SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey) o ON e.user_id = o.o_custkey""")
def join_latest_version(spark, sf_dir):
    """A table with repeated keys is reduced to its newest rows first."""
    table = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    s = _start(spark, sf_dir, "events").join(table, "user_id", "o_custkey", ["event_id", F.col("o_orderkey").alias("latest_order")], version=["o_orderdate", "o_orderkey"])
    return s.build().result


@query("SELECT 'big' AS branch, event_id FROM events WHERE value > 90 UNION ALL SELECT 'errors', event_id FROM events WHERE event_type = 'error'")
def branch_fanout(spark, sf_dir):
    s = _start(spark, sf_dir, "events")
    s = s.add_branch("big", lambda b: b.filter("value > 90").map("event_id", branch=F.lit("big")))
    s = s.add_branch("errors", lambda b: b.filter("event_type = 'error'").map("event_id", branch=F.lit("errors")))
    found = s.build().branches
    return found["big"].unionByName(found["errors"])


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n FROM events WHERE value > 10 GROUP BY ALL")
def branch_window(spark, sf_dir):
    """Branches take windows too."""
    s = _start(spark, sf_dir, "events").add_branch("daily", lambda b: b.filter("value > 10").tumbling_window("event_type", "ts", "1 day", n=F.count("*")))
    return s.build().branches["daily"].select("event_type", "window_start", "n")


# Change data capture, stores.


def _changes(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE").alias("operation"), "event_type", "ts", "event_id")


_CHANGES = "(SELECT user_id AS id, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation, event_type, ts, event_id FROM events)"


@query(f"SELECT id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS rn FROM {_CHANGES}) WHERE rn = 1 AND operation <> 'DELETE'")
def cdc_apply(spark, sf_dir):
    return cdc.apply_changes(_changes(spark, sf_dir), "id", ["ts", "event_id"]).select("id", "event_type", "event_id")


@query(f"SELECT id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY id ORDER BY ts, event_id) AS before FROM {_CHANGES}) WHERE before IS NULL OR before <> event_type")
def cdc_dedupe(spark, sf_dir):
    return cdc.without_repeats(_changes(spark, sf_dir), "id", ["operation", "event_type"], ["ts", "event_id"]).select("id", "event_id")


@query("SELECT 'InitialLoad' AS operation, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 'INSERT', r_regionkey, r_name FROM region")
def cdc_snapshot_then_changes(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    changes = _t(spark, sf_dir, "region").select(F.lit("INSERT").alias("operation"), F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).alias("data"))
    return cdc.feed(cdc.snapshot(n).drop("change_time"), changes).select("operation", "data.key", "data.name")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def store_latest_version(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return joins.latest_per_key(e, "user_id", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || '*' ELSE c_name END AS c_name FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def store_upsert_remove(spark, sf_dir):
    """One segment's rows are replaced, another's removed."""
    c = _t(spark, sf_dir, "customer")
    changes = c.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_mktsegment") == "MACHINERY").alias("gone"))
    return relational.upsert(c.select("c_custkey", "c_name"), changes, "c_custkey", "gone")


@query("SELECT event_id, event_type FROM events WHERE user_id = (SELECT max(user_id) FROM events)")
def store_point_lookup(spark, sf_dir):
    """All rows of one key: the lookup's filter reaches the scan."""
    e = _t(spark, sf_dir, "events")
    return e.filter(F.col("user_id") == e.agg(F.max("user_id")).first()[0]).select("event_id", "event_type")


@query("SELECT o_orderkey, string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def relational_child_roundtrip(spark, sf_dir):
    """Lists to a child table and back, in order."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("items")
    lists = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items)
    nested = _t(spark, sf_dir, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "items")
    back = relational.from_tables(relational.to_tables(nested, "o_orderkey", "orders"), nested.schema, "o_orderkey", "orders")
    return back.select("o_orderkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("items"))


# Union types, codecs, parsing, hashes.


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'text:' || event_type WHEN value > 50 THEN 'big:' || CAST(floor(value)::BIGINT AS VARCHAR) END AS m FROM events")
def one_of_match(spark, sf_dir):
    u = unions.one_of_when(["string", "double"], [(F.col("event_type") == "error", F.col("event_type")), (F.col("value") > 50, F.col("value"))])
    m = unions.match(F.col("u"), lambda t: F.concat(F.lit("text:"), t), lambda d: F.concat(F.lit("big:"), F.floor(d).cast("string")))
    return _t(spark, sf_dir, "events").select("event_id", u.alias("u")).select("event_id", m.alias("m"))


@query("SELECT event_id, concat_ws('|', CASE WHEN event_type <> 'error' THEN 'name' END, CASE WHEN value > 50 THEN 'number' END) AS types FROM events")
def any_of_types(spark, sf_dir):
    u = unions.any_of(["string", "double"], {0: F.when(F.col("event_type") != "error", F.col("event_type")), 1: F.when(F.col("value") > 50, F.col("value"))})
    return _t(spark, sf_dir, "events").select("event_id", F.array_join(unions.matching_types(u, ["name", "number"]), "|").alias("types"))


@query("SELECT c_custkey, c_mktsegment <> 'BUILDING' AND c_name IS NOT NULL AS ok FROM customer")
def all_of_validate(spark, sf_dir):
    v = F.struct("c_name", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    return _t(spark, sf_dir, "customer").select("c_custkey", unions.satisfies(v, [["c_name"], ["segment"]]).alias("ok"))


@query("SELECT event_id, (props::JSON->>'k')::INT AS k FROM events")
def json_codec(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_id, (props::JSON->>'k')::INT AS k FROM events")
def json_any_case(spark, sf_dir):
    """Field names match in any case."""
    from pyspark.sql.types import StructType

    return _t(spark, sf_dir, "events").select("event_id", codecs.from_json_any_case(F.replace("props", F.lit('"k"'), F.lit('"K"')), StructType.fromDDL("k int"))["k"].alias("k"))


@query("SELECT c_custkey, base64(encode(c_name)) AS b, c_name AS back FROM customer")
def base64_codec(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", codecs.to_base64(F.col("c_name")).alias("b"))
    return c.withColumn("back", codecs.from_base64(F.col("b")))


@query("SELECT c_custkey, c_custkey::VARCHAR || ',' || coalesce(c_name, '') || ',' || coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, '') AS line FROM customer")
def csv_line(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", codecs.csv_line("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))).alias("line"))


@query("SELECT c_custkey, coalesce(try_cast(right(c_name, 3) AS INT), 0) AS number, coalesce(try_cast(c_mktsegment AS INT), 0) AS failed FROM customer")
def parse_default(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", parsing.parse_or_default(F.expr("right(c_name, 3)"), "int").alias("number"), parsing.parse_or_default(F.col("c_mktsegment"), "int").alias("failed"))


@query("SELECT c_custkey, base64(unhex(md5('c_custkey=' || c_custkey || ';c_name=' || coalesce(c_name, '') || ';'))) AS h FROM customer")
def row_hash(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", hashing.row_hash(["c_name", "c_custkey"]).alias("h"))


@query("SELECT user_id, ts, max(value) AS top FROM events GROUP BY user_id, ts HAVING count(*) > 0")
def keyed_by_two_columns(spark, sf_dir):
    return keyed.aggregate(_t(spark, sf_dir, "events"), ["user_id", "ts"], {"top": F.max("value")})


# Streams: the same plans by Structured Streaming over the table's files, to their end.


def _streamed(spark: SparkSession, sf_dir: str, name: str, plan, columns: list[str], version: str, batches: int = 1) -> DataFrame:
    """Run a stateful plan in update mode with RocksDB state; the newest row of each key is its state.

    For several batches the events are dealt to as many files, of which a micro-batch takes one.
    """
    from ..streaming.processors import ROCKSDB

    path = f"{sf_dir}/events.parquet"
    store = "spark.sql.streaming.stateStore"
    wanted = {f"{store}.providerClass": ROCKSDB, f"{store}.rocksdb.changelogCheckpointing.enabled": "true", f"{store}.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    work = work_path(spark, name)
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        # as a pattern, the path may be one file as well as a folder of files
        reader, pattern = spark.readStream.schema(spark.read.parquet(path).schema), f"{sf_dir}/events.parque[t]"
        if batches > 1:
            spark.read.parquet(path).repartition(batches, "event_id").write.parquet(f"{work}/in")
            reader, pattern = reader.option("maxFilesPerTrigger", 1), f"{work}/in"
        source = reader.parquet(pattern)
        out = plan(source)

        def save(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{work}/out/batch={n}")

        q = out.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{work}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return joins.latest_per_key(spark.read.parquet(f"{work}/out"), columns, [version]).drop("batch")


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY user_id")
def stream_aggregate(spark, sf_dir):
    plan = lambda e: keyed.aggregate(e, "user_id", {"n": F.count("*"), "first_id": F.min("event_id"), "last_id": F.max("event_id")})
    return _streamed(spark, sf_dir, "aggregate", plan, ["user_id"], "batch")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    plan = lambda e: windows.tumbling(e.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", "1 day", {"n": F.count("*")})
    out = _streamed(spark, sf_dir, "tumbling", plan, ["event_type", "window_start", "window_end"], "batch")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark, sf_dir):
    table = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    plan = lambda e: joins.stream_table_join(e, table, "user_id", "c_custkey", ["event_id", "c_mktsegment"])
    return _streamed(spark, sf_dir, "join", plan, ["event_id"], "batch")
