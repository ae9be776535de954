"""Exact deduplication as a stateful stream.

1. One pass fingerprints every whole text (A-Z lower-cased, SHA-256) into a small
   table: identifier, digest, content locator (file and place of the row in it, by
   which it is found again). Rows that come from no file are written to one first.
2. A Structured Streaming query reads that table and keeps, per digest and without
   expiry, the stable identifier of the row that stays, its locator and a count, in
   RocksDB state checkpointed to the shared folder. Rows are combined before the
   shuffle, so a digest that holds a third of all rows reaches its state task as a
   few partial rows. With a ``state`` folder given, a later run goes on from it.
3. Every hit is checked on its full bytes: the rows whose digest occurs more than once
   are read again by their locators and compared, combined before the shuffle. A digest
   that stands for more than one text (none with SHA-256, many with a short digest) is
   resolved by the texts themselves, numbered in byte order.

Of equal texts the row with the largest doc_id stays (null is smallest; of rows that
repeat a doc_id, the one with the last locator). Null text is empty text. Extra
columns are ignored, or passed on as they came; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, lookup, materialize, new_path, small_batches

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of texts that a task of the byte check remembers, so that it forwards copies once.
RECENT_BYTES = 32 << 20


def normalized(text: bytes | None) -> bytes:
    """``bytes.lower`` changes A-Z only."""
    return (text or b"").lower()


def digest_of(text: bytes, digest_bytes: int) -> str:
    return hashlib.sha256(text).digest()[:digest_bytes].hex()


def _texts(column: pa.Array) -> list[bytes]:
    return [normalized(t) for t in column.cast(pa.binary()).to_pylist()]


def located(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows can be found again by file and place, else as a table that is."""
    try:
        docs.select(*_locator())
        return docs
    except AnalysisException:
        return materialize(docs, "dedup-input")


def _locator() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]


def fingerprints(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """doc_id, digest, text_sha256, file, row of located documents: one row each, no shuffle."""

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full = [hashlib.sha256(t).hexdigest() for t in _texts(b.column(0))]
            cut = pa.array([x[: 2 * digest_bytes] for x in full], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(1), cut, pa.array(full, pa.string()), b.column(2), b.column(3)], ["doc_id", "digest", "text_sha256", "file", "row"])

    small_batches(docs.sparkSession)
    d = docs.select(F.col("text"), F.col("doc_id").cast("long"), *_locator())
    return d.mapInArrow(fingerprint, "doc_id long, digest string, text_sha256 string, file string, row long")


def keyed_state(arrivals: DataFrame) -> DataFrame:
    """The state per digest of a stream (or batch) of fingerprints: who stays, where its content is, how many there are."""
    return arrivals.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keeper"), F.count("*").alias("group_size"))


def stream_state(spark: SparkSession, path: str, schema, files_per_trigger: int = 10_000, state: str | None = None) -> DataFrame:
    """Run the stateful query over the table at ``path`` to its end; return the last state of each digest.

    With ``state``, a folder in shared storage, a later call reads only the files that came to ``path`` since and goes on from that state.
    """
    work = state or new_path(spark, "dedup-state")
    store = "spark.sql.streaming.stateStore"
    # many small stores: changelogs instead of whole snapshots, and no space allocated ahead
    names = {f"{store}.providerClass": ROCKSDB, f"{store}.rocksdb.changelogCheckpointing.enabled": "true", f"{store}.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)

        def save(changes: DataFrame, batch: int) -> None:
            changes.write.mode("overwrite").parquet(f"{work}/changes/batch={batch}")

        q = (
            keyed_state(arrivals).writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
        )
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = "digest string, keeper struct<doc_id: long, file: string, row: long>, group_size long"
    if not _exists(spark, f"{work}/changes"):
        return spark.createDataFrame([], kept)
    changes = spark.read.schema(f"{kept}, batch int").parquet(f"{work}/changes")
    return changes.groupBy("digest").agg(F.max_by("keeper", "batch").alias("keeper"), F.max("group_size").alias("group_size"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def hit_texts(docs: DataFrame, hits: DataFrame, digest_bytes: int) -> DataFrame:
    """digest, body of the hits' rows (file, row): every different text at least once; copies that a task has met lately are left out."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[str, bytes] = {}
        held = 0
        for b in batches:
            out: list[tuple[str, bytes]] = []
            for t in _texts(b.column(0)):
                k = digest_of(t, digest_bytes)
                if recent.get(k) == t:
                    continue
                out.append((k, t))
                if held + len(t) > RECENT_BYTES:
                    recent, held = {}, 0
                recent[k] = t
                held += len(t)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["digest", "body"])

    small_batches(docs.sparkSession)
    rows = docs.select("text", *_locator()).join(hits.select("file", "row"), ["file", "row"], "left_semi")
    return rows.select("text").mapInArrow(combine, "digest string, body binary")


def conflicts(texts: DataFrame) -> DataFrame:
    """The digests whose texts are not all the same bytes."""
    return texts.groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a <> b").select("digest")


def deduplicate(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256, digest, and the locators of the row that stays and of its own."""
    spark = docs.sparkSession
    docs = located(docs)
    prints = materialize(fingerprints(docs, digest_bytes), "fingerprints")
    path = prints.inputFiles()[0].rsplit("/", 1)[0] if prints.inputFiles() else None
    state = materialize(stream_state(spark, path, prints.schema), "dedup-groups") if path else spark.createDataFrame([], "digest string, keeper struct<doc_id: long, file: string, row: long>, group_size long")
    hits = lookup(prints, state.filter("group_size > 1").select("digest", "group_size"), "digest", "group_size")
    clash = materialize(conflicts(hit_texts(docs, hits, digest_bytes)), "dedup-conflicts")
    if not clash.isEmpty():
        prints, state = _by_text(docs, prints, state, clash)
    joined = lookup(prints, state, "digest", "group_size")
    kept = (F.col("row") == F.col("keeper.row")) & (F.col("file") == F.col("keeper.file"))
    return joined.select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256",
        "digest", F.col("keeper.file").alias("keep_file"), F.col("keeper.row").alias("keep_row"), "file", "row",
    )


def _by_text(docs: DataFrame, prints: DataFrame, state: DataFrame, clash: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digests that stand for several texts get the number of the text appended: its place among them in byte order."""
    again = prints.join(clash, "digest", "left_semi")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bodies = docs.select(lower.cast("binary").alias("body"), *_locator()).join(again, ["file", "row"])
    bodies = materialize(bodies, "dedup-clashing")
    texts = bodies.select("digest", "body").distinct()
    number = F.row_number().over(Window.partitionBy("digest").orderBy("body"))
    numbered = bodies.join(texts.withColumn("number", number), ["digest", "body"])
    numbered = numbered.withColumn("digest", F.concat_ws(":", "digest", "number")).select(prints.columns)
    prints = materialize(prints.join(clash, "digest", "left_anti").unionByName(numbered), "fingerprints")
    own = keyed_state(prints.filter(F.col("digest").contains(":")))
    return prints, materialize(state.join(clash, "digest", "left_anti").unionByName(own), "dedup-groups")


def survivors(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """The rows that stay, with all columns as they came: read again by their locators."""
    docs = located(docs)
    file, row = fresh(docs.columns, "_file"), fresh(docs.columns, "_row")
    keep = deduplicate(docs, digest_bytes).filter("kept").select(F.col("file").alias(file), F.col("row").alias(row))
    keep = materialize(keep, "dedup-kept").hint("merge")  # as many as documents: never broadcast, at any size
    at = [c.alias(n) for c, n in zip(_locator(), (file, row))]
    return docs.select("*", *at).join(keep, [file, row], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
