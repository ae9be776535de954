"""Stage-level metrics: counters and histograms that a pipeline reports to a provider.

Row counts come from ``observe``: they are taken while the rows pass, without a second
job. Stream progress comes from a query listener.
"""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any, Protocol

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Provider(Protocol):
    def counter(self, name: str, value: float, **tags: str) -> None: ...
    def histogram(self, name: str, value: float, **tags: str) -> None: ...
    def span(self, name: str, **tags: str) -> Any: ...


class InMemoryProvider:
    """Keeps everything it is told."""

    def __init__(self) -> None:
        self.counters: dict[tuple, float] = defaultdict(float)
        self.histograms: dict[tuple, list[float]] = defaultdict(list)
        self.spans: list[dict[str, Any]] = []
        self._lock = threading.Lock()

    @staticmethod
    def _key(name: str, tags: dict[str, str]) -> tuple:
        return (name, *sorted(tags.items()))

    def counter(self, name: str, value: float, **tags: str) -> None:
        with self._lock:
            self.counters[self._key(name, tags)] += value

    def histogram(self, name: str, value: float, **tags: str) -> None:
        with self._lock:
            self.histograms[self._key(name, tags)].append(value)

    @contextmanager
    def span(self, name: str, **tags: str) -> Iterator[dict[str, Any]]:
        s: dict[str, Any] = {"name": name, "status": "ok", **tags}
        began = time.perf_counter()
        try:
            yield s
        except Exception as e:
            s["status"], s["error"] = "error", str(e)
            raise
        finally:
            s["ms"] = (time.perf_counter() - began) * 1000
            with self._lock:
                self.spans.append(s)


class OpenTelemetryProvider:
    """The same over the OpenTelemetry API, where that is installed."""

    def __init__(self, service: str = "streamframe"):
        from opentelemetry import metrics, trace

        self._meter, self._tracer, self._made = metrics.get_meter(service), trace.get_tracer(service), {}

    def counter(self, name: str, value: float, **tags: str) -> None:
        if name not in self._made:
            self._made[name] = self._meter.create_counter(name)
        self._made[name].add(value, tags)

    def histogram(self, name: str, value: float, **tags: str) -> None:
        if name not in self._made:
            self._made[name] = self._meter.create_histogram(name)
        self._made[name].record(value, tags)

    def span(self, name: str, **tags: str):
        return self._tracer.start_as_current_span(name, attributes=tags)


class StageMetrics:
    """Row counts of a batch pipeline's stages."""

    def __init__(self, pipeline: str, provider: Provider | None):
        self.pipeline, self.provider, self.observations = pipeline, provider, []

    def watch(self, df: DataFrame, stage: str) -> DataFrame:
        if self.provider is None:
            return df
        if df.isStreaming:
            return df.observe(f"{self.pipeline}:{stage}", F.count(F.lit(1)).alias("rows"))
        o = Observation(f"{self.pipeline}:{stage}:{len(self.observations)}")
        self.observations.append((stage, o))
        return df.observe(o, F.count(F.lit(1)).alias("rows"))

    def report(self) -> None:
        """Once an action has run, tell the provider each stage's rows."""
        for stage, o in self.observations:
            self.provider.counter("rows", o.get["rows"], pipeline=self.pipeline, stage=stage)


class ProgressListener(StreamingQueryListener):
    """Reports input rows, batch time and observed stage counts of streaming queries."""

    def __init__(self, provider: Provider):
        self.provider = provider

    def onQueryStarted(self, event) -> None:
        self.provider.counter("queries_started", 1, query=event.name or "")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.provider.counter("rows_in", p.numInputRows, query=p.name or "")
        self.provider.histogram("batch_ms", p.batchDuration, query=p.name or "")
        for name, row in (p.observedMetrics or {}).items():
            self.provider.counter("rows", row["rows"], query=p.name or "", stage=name.split(":", 1)[-1])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.provider.counter("queries_ended", 1, error=str(bool(event.exception)))
