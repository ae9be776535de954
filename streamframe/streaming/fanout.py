"""One streaming query into many branches, and joins with a table that changes."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Branch = tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], Any]]


def fan_out(source: DataFrame, branches: Mapping[str, Branch], checkpoint: str, name: str | None = None, trigger: Mapping[str, Any] | None = None) -> StreamingQuery:
    """Each micro-batch is read once, held, and goes through every branch in order: (transformation, sink)."""
    if not branches:
        raise ValueError("a fan-out has branches")

    def run(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for transform, sink in branches.values():
                sink(transform(batch))
        finally:
            batch.unpersist()

    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def live_table_join(source: DataFrame, table: Callable[[], DataFrame], join: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame], Any], checkpoint: str, trigger: Mapping[str, Any] | None = None) -> StreamingQuery:
    """A stream-table join that reads the table anew for each micro-batch."""
    return fan_out(source, {"join": (lambda batch: join(batch, table()), sink)}, checkpoint, trigger=trigger)
