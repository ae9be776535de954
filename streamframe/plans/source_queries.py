"""Registered queries over file sinks and sources, codecs, change feeds, stores and streams of several micro-batches.

Each writes its table through a sink into the shared work folder and reads it back, or
decodes a feed made of the table's rows, and must equal its SQL on the table itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..builder import StreamBuilder
from ..functions import codecs
from ..operators import keyed
from ..shared import work_path
from ..sources import cdc, connectors, files
from ..state.stores import InMemoryStore, VersionedStore
from ..telemetry import InMemoryProvider
from .queries import _streamed, _t, query

_EVENT = "event_id bigint, user_id bigint, event_type string"


def _events(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "event_type")


_EVENTS_SQL = "SELECT event_id::BIGINT AS event_id, user_id::BIGINT AS user_id, event_type FROM events"


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def file_csv(spark, sf_dir):
    """CSV with a header, out and in."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = work_path(spark, "csv")
    c.write.option("header", True).csv(path)
    return files.read_csv(spark, path, c.schema)


@query(_EVENTS_SQL)
def file_jsonl(spark, sf_dir):
    """JSON lines by the file sink, read with names in another case."""
    path = work_path(spark, "jsonl")
    e = _events(spark, sf_dir)
    files.FileSink(path, "json").write(e.toDF(*[c.upper() for c in e.columns]))
    return files.read_jsonl(spark, path, _EVENT, any_case=True)


@query(_EVENTS_SQL)
def file_xml(spark, sf_dir):
    """One XML element a line by the file sink and back."""
    path = work_path(spark, "xml")
    files.FileSink(path, "xml").write(_events(spark, sf_dir))
    return files.read_xml(spark, path, _EVENT, "ROW", per_line=True)


@query("SELECT c_custkey::VARCHAR || ',' || c_name || ',' || c_mktsegment AS value FROM customer")
def file_single(spark, sf_dir):
    """All lines in one file."""
    path = work_path(spark, "single")
    files.FileSink(path, "csv", "single").write(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    return spark.read.text(path)


@query(_EVENTS_SQL)
def object_store(spark, sf_dir):
    """Objects of a thousand JSON records."""
    path = work_path(spark, "objects")
    files.ObjectStoreSink(path, 1000).write(_events(spark, sf_dir))
    return spark.read.schema(_EVENT).json(path)


@query("""SELECT '{"eventId":' || event_id || ',"userId":' || user_id || ',"eventType":"' || event_type || '"}' AS value, user_id::VARCHAR AS key FROM events""")
def broker_rows(spark, sf_dir):
    """What queues and brokers are sent: camel-case JSON with a key."""
    return connectors.kafka_rows(_events(spark, sf_dir), "user_id").select("value", "key")


@query(_EVENTS_SQL)
def xml_codec(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select(codecs.from_xml(codecs.to_xml(F.struct(*e.columns)), _EVENT).alias("r")).select("r.*")


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'INSERT' ELSE 'DELETE' END AS operation, c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer")
def cdc_wal2json(spark, sf_dir):
    """Messages of a logical slot; a delete holds its old key only."""
    c, text = _t(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    head = [F.lit("public").alias("schema"), F.lit("customer").alias("table")]
    insert = F.struct(F.lit("insert").alias("kind"), *head, F.array(F.lit("id"), F.lit("name")).alias("columnnames"), F.array(text, "c_name").alias("columnvalues"))
    old = F.struct(F.array(F.lit("id")).alias("keynames"), F.array(text).alias("keyvalues")).alias("oldkeys")
    delete = F.struct(F.lit("delete").alias("kind"), *head, old)
    message = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.array(insert).alias("change")))).otherwise(F.to_json(F.struct(F.array(delete).alias("change"))))
    out = cdc.from_wal2json(c.select(message.alias("line")), "line", "public", "customer")
    return out.select("operation", F.try_element_at("data", F.lit("id")).alias("id"), F.try_element_at("data", F.lit("name")).alias("name"))


@query("SELECT ['Insert', 'Delete', 'Update (new value)'][(c_custkey % 4)::INT + 1] AS operation, c_custkey, c_name FROM customer WHERE c_custkey % 4 < 3")
def cdc_change_table(spark, sf_dir):
    """A change of every customer, of four kinds in turn; the old values of updates go."""
    code = F.element_at(F.array(*[F.lit(x) for x in (2, 1, 4, 3)]), (F.col("c_custkey") % 4 + 1).cast("int"))
    place = F.col("c_custkey").cast("string").cast("binary")
    rows = _t(spark, sf_dir, "customer").select(code.alias("__$operation"), place.alias("__$start_lsn"), place.alias("__$seqval"), "c_custkey", "c_name")
    return cdc.from_sqlserver(rows).select("operation", "data.c_custkey", "data.c_name")


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS operation, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer")
def cdc_change_stream(spark, sf_dir):
    """Document change events, typed; a delete has no document."""
    gone = F.col("c_custkey") % 3 == 0
    document = F.when(~gone, F.struct(F.col("c_name").alias("name")))
    kind = F.when(gone, "delete").otherwise("update")
    event = F.to_json(F.struct(kind.alias("operationType"), document.alias("fullDocument"), F.struct(F.col("c_custkey").alias("_id")).alias("documentKey")))
    return cdc.from_change_stream(_t(spark, sf_dir, "customer").select(event.alias("e")), "e", "name string").select("operation", "data.name")


@query("SELECT n_nationkey::BIGINT AS k, n_name || '!' AS v FROM nation WHERE n_regionkey <> 0")
def store_in_memory(spark, sf_dir):
    """Put, change, remove and scan; nations are few at every scale."""
    store = InMemoryStore("nations")
    for r in _t(spark, sf_dir, "nation").toLocalIterator():
        store.put(r.n_nationkey, r.n_name)
        store.update(r.n_nationkey, lambda v: v + "!")
        if r.n_regionkey == 0:
            store.remove(r.n_nationkey)
    return spark.createDataFrame(list(store.items()), "k long, v string")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || '*' ELSE c_name END AS c_name FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def store_reopened(spark, sf_dir):
    """Writes before and after a compaction, read by a store that is opened later."""
    c, path = _t(spark, sf_dir, "customer"), work_path(spark, "versions")
    schema = c.select("c_custkey", "c_name").schema
    store = VersionedStore(spark, path, schema, "c_custkey")
    store.put_all(c.select("c_custkey", "c_name"))
    store.remove_all(c.filter("c_mktsegment = 'MACHINERY'").select("c_custkey"))
    store.compact()
    VersionedStore(spark, path, schema, "c_custkey").put_all(c.filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name")))
    return VersionedStore(spark, path, schema, "c_custkey").as_dataframe()


@query("SELECT '0-filter' AS stage, count(*) AS n FROM events WHERE event_type = 'click' UNION ALL SELECT '1-map', count(*) FROM events WHERE event_type = 'click'")
def telemetry_rows(spark, sf_dir):
    """Rows that left each stage, counted while they passed."""
    provider = InMemoryProvider()
    s = StreamBuilder.create("watched").stream(_events(spark, sf_dir)).with_telemetry(provider).filter("event_type = 'click'").map("event_id")
    s.sink(lambda df: df.write.format("noop").mode("overwrite").save()).build().start()
    rows = [(dict(tags)["stage"], int(n)) for (name, *tags), n in provider.counters.items() if name == "rows"]
    return spark.createDataFrame(rows, "stage string, n long")


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY user_id")
def stream_aggregate_batches(spark, sf_dir):
    """Four micro-batches: state is read back from RocksDB by each that follows."""
    plan = lambda e: keyed.aggregate(e, "user_id", {"n": F.count("*"), "first_id": F.min("event_id"), "last_id": F.max("event_id")})
    return _streamed(spark, sf_dir, "aggregate-batches", plan, ["user_id"], "batch", batches=4)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_fold_batches(spark, sf_dir):
    """A fold after each row over four micro-batches; a user's last state."""
    from ..streaming.processors import fold_per_row

    plan = lambda e: fold_per_row(e.select("user_id", "event_id"), "user_id", _one_more, 0, "long", ["event_id"], "n")
    return _streamed(spark, sf_dir, "fold-batches", plan, ["user_id"], "n", batches=4).select("user_id", "n")


def _one_more(n: int, row: dict) -> int:
    return n + 1
