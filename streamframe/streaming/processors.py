"""Per-row state and processing-time windows by ``transformWithStateInPandas``.

State is in RocksDB and survives with the checkpoint. Rows of a key within a micro-batch
are taken in the order of ``order_by``: what a micro-batch has for one key is held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with(df: DataFrame, name: str, kind: str) -> StructType:
    if name in df.columns:
        raise ValueError(f"the rows have a column {name!r} already")
    return StructType([*df.schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ordered(rows: Iterator[pd.DataFrame], order_by: Sequence[str]) -> pd.DataFrame:
    """A key's rows of a micro-batch, which come in several frames, in one order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order_by), kind="stable")


class _Fold(StatefulProcessor):
    def __init__(self, step: Callable[[Any, dict], Any], initial: Any, state: str, order_by: Sequence[str], name: str):
        self.step, self.initial, self.state, self.order_by, self.name = step, initial, state, list(order_by), name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("fold", f"value {self.state}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.value.get() if self.value.exists() else None
        a = held[0] if held is not None else self.initial
        f, out = _ordered(rows, self.order_by), []
        for r in f.to_dict("records"):
            a = self.step(a, r)
            out.append(a)
        yield f.assign(**{self.name: out})
        self.value.update((a,))

    def close(self) -> None:
        pass


def fold_per_row(df: DataFrame, key: str, step: Callable[[Any, dict], Any], initial: Any, state: str, order_by: Sequence[str], name: str = "state") -> DataFrame:
    """Each input row with the state of its key after it: ``step(state, row)`` from ``initial``."""
    use_rocksdb(df.sparkSession)
    schema = _with(df, name, state)
    return df.groupBy(key).transformWithStateInPandas(_Fold(step, initial, state, order_by, name), schema, "Update", "None")


class _Group(StatefulProcessor):
    def __init__(self, column: str, kind: str, order_by: Sequence[str], name: str):
        self.column, self.kind, self.order_by, self.name = column, kind, list(order_by), name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("group", f"value {self.kind}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [x[0] for x in self.items.get()] if self.items.exists() else []
        f, out = _ordered(rows, self.order_by), []
        for v in f[self.column].tolist():
            held.append(v)
            out.append(list(held))
        self.items.appendList([(v,) for v in f[self.column].tolist()])
        yield f.assign(**{self.name: out})

    def close(self) -> None:
        pass


def group_per_row(df: DataFrame, key: str, column: str, kind: str, order_by: Sequence[str], name: str = "values") -> DataFrame:
    """Each input row with the list of its key's values so far."""
    use_rocksdb(df.sparkSession)
    return df.groupBy(key).transformWithStateInPandas(_Group(column, kind, order_by, name), _with(df, name, f"array<{kind}>"), "Update", "None")


class _Clock(StatefulProcessor):
    """Windows over the arrival clock; a window closes by the key's next event or by its timer."""

    def __init__(self, column: str, kind: str, size_ms: int, session: bool, reduce: Callable[[list], Any], clock: Callable[[], int] | None):
        self.column, self.kind, self.size, self.session, self.reduce, self.clock = column, kind, size_ms, session, reduce, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", f"value {self.kind}")
        self.bounds = handle.getValueState("bounds", "start long, last long")

    def _now(self, timerValues) -> int:
        return self.clock() if self.clock else timerValues.getCurrentProcessingTimeInMs()

    def _close(self, key) -> pd.DataFrame:
        start, last = self.bounds.get()
        values = [x[0] for x in self.events.get()]
        self.events.clear()
        self.bounds.clear()
        end = last if self.session else start + self.size
        return pd.DataFrame({"key": [key[0]], "window_start_ms": [start], "window_end_ms": [end], "value": [self.reduce(values)]})

    def _over(self, now: int, by_timer: bool) -> bool:
        start, last = self.bounds.get()
        return now - last > self.size if self.session else now >= start + self.size

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self._now(timerValues)
        if self.bounds.exists() and self._over(now, False):
            yield self._close(key)
        if not self.bounds.exists():
            # aligned with 0001-01-01, which is a whole number of ms before 1970
            start = now if self.session else now - (now + 62_135_596_800_000) % self.size
            self.bounds.update((start, now))
        else:
            self.bounds.update((self.bounds.get()[0], now))
        for f in rows:
            self.events.appendList([(v,) for v in f[self.column].tolist()])
        start, last = self.bounds.get()
        self.handle.registerTimer((last + self.size + 1) if self.session else start + self.size)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.bounds.exists() and self._over(self._now(timerValues), True):
            yield self._close(key)

    def close(self) -> None:
        pass


_CLOCK_OUT = "key {key}, window_start_ms long, window_end_ms long, value {out}"


def _by_clock(df: DataFrame, key: str, column: str, kind: str, ms: int, session: bool, reduce: Callable[[list], Any], out: str) -> DataFrame:
    use_rocksdb(df.sparkSession)
    schema = _CLOCK_OUT.format(key=df.schema[key].dataType.simpleString(), out=out)
    return df.groupBy(key).transformWithStateInPandas(_Clock(column, kind, ms, session, reduce, None), schema, "Update", "ProcessingTime")


def tumbling_by_clock(df: DataFrame, key: str, column: str, kind: str, duration_ms: int, reduce: Callable[[list], Any], out: str) -> DataFrame:
    """Tumbling windows over processing time; ``reduce`` gets a window's values."""
    return _by_clock(df, key, column, kind, duration_ms, False, reduce, out)


def session_by_clock(df: DataFrame, key: str, column: str, kind: str, gap_ms: int, reduce: Callable[[list], Any], out: str) -> DataFrame:
    """Sessions over processing time."""
    return _by_clock(df, key, column, kind, gap_ms, True, reduce, out)


def read_state(spark: SparkSession, checkpoint: str, variable: str | None = None) -> DataFrame:
    """The keyed state of a streaming query, as of its last batch."""
    reader = spark.read.format("statestore")
    if variable:
        reader = reader.option("stateVarName", variable)
    return reader.load(checkpoint)
