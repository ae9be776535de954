"""The fluent builder: one pipeline, as a batch query or as a streaming query.

A builder is immutable; each step returns another. Steps are DataFrame plans, so a
pipeline over a batch DataFrame is one lazy plan, and over a streaming DataFrame one
streaming query. Nothing runs before ``start``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .operators import join as joins
from .operators import keyed, stateless, windows
from .state import InMemoryStore, Store, TableView
from .telemetry import ProgressListener, Provider, StageMetrics

Sink = Callable[[DataFrame], Any]


@dataclass(frozen=True)
class StreamBuilder:
    """Steps so far: the plan, the side tables of silent steps, branches and sinks."""

    name: str
    df: DataFrame | None = None
    stores: Mapping[str, Any] = field(default_factory=dict)
    branches: Mapping[str, StreamBuilder] = field(default_factory=dict)
    sinks: tuple[Sink, ...] = ()
    metrics: StageMetrics | None = None
    emitter: Emitter | None = None
    steps: int = 0

    @staticmethod
    def create(name: str) -> StreamBuilder:
        if not name:
            raise ValueError("a stream has a name")
        return StreamBuilder(name)

    # sources

    def stream(self, source: DataFrame | Callable[[], DataFrame] | Emitter) -> StreamBuilder:
        """Attach a DataFrame (batch or streaming), a function that makes one, or an emitter."""
        if self.df is not None or self.steps:
            raise RuntimeError("a stream has one source, before its operators")
        emitter = source if isinstance(source, Emitter) else None
        df = source.stream() if emitter else source() if callable(source) and not isinstance(source, DataFrame) else source
        return replace(self, df=df, emitter=emitter)

    def with_telemetry(self, provider: Provider) -> StreamBuilder:
        return replace(self, metrics=StageMetrics(self.name, provider))

    def _then(self, df: DataFrame, step: str, **more: Any) -> StreamBuilder:
        if self.df is None:
            raise RuntimeError("a stream needs a source first")
        if self.metrics:
            df = self.metrics.watch(df, f"{self.steps}-{step}")
        return replace(self, df=df, steps=self.steps + 1, **more)

    def _need(self) -> DataFrame:
        if self.df is None:
            raise RuntimeError("a stream needs a source first")
        return self.df

    # stateless

    def map(self, *columns: Column | str, **named: Column) -> StreamBuilder:
        return self._then(stateless.map_rows(self._need(), *columns, **named), "map")

    def map_batches(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> StreamBuilder:
        return self._then(stateless.map_batches(self._need(), fn, schema), "map_batches")

    def require(self, *columns: str) -> StreamBuilder:
        return self._then(stateless.require(self._need(), *columns), "require")

    def filter(self, condition: Column | str) -> StreamBuilder:
        return self._then(stateless.filter_rows(self._need(), condition), "filter")

    def flat_map(self, items: Column, name: str = "value", ordinal: str | None = None, keep: Iterable[str] = ()) -> StreamBuilder:
        return self._then(stateless.flat_map(self._need(), items, name, ordinal, keep), "flat_map")

    def use(self, fn: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> StreamBuilder:
        """Any function from DataFrame to DataFrame as an operator."""
        return self._then(stateless.custom(self._need(), fn, *args, **kwargs), "use")

    # keyed

    def _stored(self, store: str | None, table: DataFrame) -> Mapping[str, Any]:
        name = store or f"store-{uuid.uuid4().hex}"
        if name in self.stores:
            raise ValueError(f"the stream has a store {name!r} already")
        return {**self.stores, name: TableView(table, key=table.columns[0], name=name)}

    def group_by(self, key: str | Sequence[str], value: Column, order_by: Sequence[str], emit: str = "final", name: str = "values", store: str | None = None, strict: bool = False) -> StreamBuilder:
        df = self._need()
        stores = self._stored(store, keyed.group_by(df, key, value, order_by, "final", name, strict))
        return self._then(keyed.group_by(df, key, value, order_by, emit, name, strict), "group_by", stores=stores)

    def group_by_silently(self, key: str | Sequence[str], value: Column, order_by: Sequence[str], name: str = "values", store: str | None = None) -> StreamBuilder:
        """The rows go on as they are; the lists per key are in the store."""
        stores = self._stored(store, keyed.group_by(self._need(), key, value, order_by, "final", name))
        return self._then(self._need(), "group_by_silently", stores=stores)

    def aggregate(self, key: str | Sequence[str], order_by: Sequence[str] = (), emit: str = "final", store: str | None = None, strict: bool = False, **aggregates: Column) -> StreamBuilder:
        df = self._need()
        stores = self._stored(store, keyed.aggregate(df, key, aggregates, order_by, "final", strict))
        return self._then(keyed.aggregate(df, key, aggregates, order_by, emit, strict), "aggregate", stores=stores)

    def aggregate_silently(self, key: str | Sequence[str], store: str | None = None, **aggregates: Column) -> StreamBuilder:
        stores = self._stored(store, keyed.aggregate(self._need(), key, aggregates))
        return self._then(self._need(), "aggregate_silently", stores=stores)

    def fold(self, key: str | Sequence[str], value: Column, initial: Column, step: Callable[[Column, Column], Column], order_by: Sequence[str], emit: str = "final", name: str = "state", store: str | None = None) -> StreamBuilder:
        df = self._need()
        stores = self._stored(store, keyed.fold(df, key, value, initial, step, order_by, "final", name))
        return self._then(keyed.fold(df, key, value, initial, step, order_by, emit, name), "fold", stores=stores)

    # windows

    def tumbling_window(self, key: str | Sequence[str], time: str, duration: str, store: str | None = None, **aggregates: Column) -> StreamBuilder:
        out = windows.tumbling(self._need(), key, time, duration, aggregates)
        return self._then(out, "tumbling_window", stores=self._stored(store, out))

    def sliding_window(self, key: str | Sequence[str], time: str, duration: str, slide: str, mode: str = "aligned", store: str | None = None, **aggregates: Column) -> StreamBuilder:
        out = windows.sliding(self._need(), key, time, duration, slide, aggregates, mode)
        return self._then(out, "sliding_window", stores=self._stored(store, out))

    def session_window(self, key: str | Sequence[str], time: str, gap: str, store: str | None = None, **aggregates: Column) -> StreamBuilder:
        out = windows.session(self._need(), key, time, gap, aggregates)
        return self._then(out, "session_window", stores=self._stored(store, out))

    def watermark(self, time: str, delay: str) -> StreamBuilder:
        return self._then(self._need().withColumn(time, self._need()[time].cast("timestamp")).withWatermark(time, delay), "watermark")

    # join, fork, sink

    def join(self, table: DataFrame, stream_key: str | Sequence[str], table_key: str | Sequence[str], project: Sequence[Column | str] | None = None, version: Sequence[str] | None = None, small: bool = False) -> StreamBuilder:
        return self._then(joins.stream_table_join(self._need(), table, stream_key, table_key, project, version, small), "join")

    def add_branch(self, name: str, configure: Callable[[StreamBuilder], StreamBuilder]) -> StreamBuilder:
        """Every row also goes through the branch; the main path may go on."""
        if not name or not name.strip():
            raise ValueError("a branch has a name")
        if configure is None:
            raise TypeError("a branch needs a configuration")
        if name in self.branches:
            raise ValueError(f"the stream has a branch {name!r} already")
        start = StreamBuilder(f"{self.name}.{name}", self._need(), metrics=self.metrics)
        branch = configure(start)
        if branch is None or branch.steps == 0 and not branch.sinks:
            raise RuntimeError(f"the branch {name!r} has no operators")
        return replace(self, branches={**self.branches, name: branch}, steps=self.steps + 1)

    def sink(self, sink: Sink | Any) -> StreamBuilder:
        """A function of a DataFrame, or an object with ``write(df)``; it ends the path."""
        write = sink.write if hasattr(sink, "write") and not isinstance(sink, type) else sink
        return replace(self, sinks=(*self.sinks, write))

    def with_store(self, store: Store) -> StreamBuilder:
        """Register a store of a sink or of a custom operator, so that it can be looked up."""
        if store.name in self.stores:
            raise ValueError(f"the stream has a store {store.name!r} already")
        return replace(self, stores={**self.stores, store.name: store})

    def build(self) -> Stream:
        self._need()
        return Stream(self)


class Emitter:
    """An in-memory source: rows emitted by the caller, as files that a streaming query reads."""

    def __init__(self, spark: SparkSession, schema: str, path: str):
        self.spark, self.schema, self.path = spark, schema, path
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def emit(self, rows: Iterable[Any]) -> None:
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)


class Stream:
    """A built pipeline: start, stop, status, branches and stores."""

    def __init__(self, builder: StreamBuilder):
        self._b, self._queries, self._running, self._listener = builder, [], False, None

    @property
    def name(self) -> str:
        return self._b.name

    @property
    def result(self) -> DataFrame:
        """The main path's plan."""
        return self._b.df

    @property
    def status(self) -> str:
        live = any(q.isActive for q in self._queries) if self._queries else self._running
        return "Running" if live else "Stopped"

    def _outputs(self) -> list[tuple[StreamBuilder, Sink]]:
        out, todo = [], [self._b]
        while todo:
            b = todo.pop(0)
            out += [(b, s) for s in b.sinks]
            todo += b.branches.values()
        return out

    def start(self, checkpoint: str | None = None, output_mode: str = "append", trigger: Mapping[str, Any] | None = None) -> Stream:
        """Batch: run every sink over its plan. Stream: a query for the main path into its sinks, and one for each branch.

        Each query reads the source for itself and has a checkpoint of its own below
        ``checkpoint``; :func:`streamframe.streaming.fanout.fan_out` reads it once for all.
        """
        if self.status == "Running":
            raise RuntimeError("the stream runs already")
        df = self._b.df
        if not df.isStreaming:
            self._running = True
            outputs = self._outputs()
            shared = df.persist() if len(outputs) > 1 and not self._b.branches else None
            try:
                for b, sink in outputs:
                    sink(b.df)
            finally:
                if shared is not None:
                    shared.unpersist()
            if self._b.metrics and self._b.metrics.provider and outputs:
                self._b.metrics.report()
            return self
        if self._b.metrics and self._b.metrics.provider:
            self._listener = ProgressListener(self._b.metrics.provider)
            df.sparkSession.streams.addListener(self._listener)
        paths, todo = [], [self._b]
        while todo:
            b = todo.pop(0)
            paths.append(b)
            todo += b.branches.values()
        self._queries = []
        for b in paths:
            if b is not self._b and not b.sinks:
                continue
            writer = b.df.writeStream.queryName(b.name.replace(".", "_")).outputMode(output_mode)
            writer = writer.foreachBatch(lambda batch, _, sinks=b.sinks: [s(batch) for s in sinks] and None)
            if checkpoint:
                writer = writer.option("checkpointLocation", checkpoint if len(paths) == 1 else f"{checkpoint.rstrip('/')}/{b.name}")
            self._queries.append(writer.trigger(**(trigger or {"processingTime": "0 seconds"})).start())
        return self

    @property
    def query(self) -> StreamingQuery | None:
        """The main path's query."""
        return self._queries[0] if self._queries else None

    def emit(self, rows: Iterable[Any]) -> None:
        """Hand rows to an in-memory source; a stream with another source, or one not started, refuses them."""
        if self._b.emitter is None:
            raise RuntimeError("the stream has a source of its own")
        if self.status != "Running":
            raise RuntimeError("the stream is not started")
        self._b.emitter.emit(rows)
        for q in self._queries:
            q.processAllAvailable()

    def stop(self) -> None:
        for q in self._queries:
            q.stop()
        if self._queries and self._listener is not None:
            self._b.df.sparkSession.streams.removeListener(self._listener)
        self._running = False

    @property
    def branches(self) -> dict[str, DataFrame]:
        return {n: b.df for n, b in self._b.branches.items()}

    def state_stores(self, kind: type | None = None) -> list[Any]:
        found, todo = [], [self._b]
        while todo:
            b = todo.pop(0)
            found += [s for s in b.stores.values() if kind is None or isinstance(s, kind)]
            todo += b.branches.values()
        return found

    def state_store(self, name: str) -> Any | None:
        return next((s for s in self.state_stores() if s.name == name), None)


__all__ = ["Emitter", "InMemoryStore", "Stream", "StreamBuilder"]
