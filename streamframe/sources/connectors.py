"""Brokers, queues, HTTP and search behind injected clients.

A client is made on the executor that uses it by a function that the caller passes, so
no client library is a dependency here. Sinks write each partition on its executor;
sources are Python data sources that Spark plans as micro-batches and commits after.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..functions import codecs

Client = Callable[[], Any]


def with_retries(action: Callable[[], Any], tries: int = 3, first_wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Try, wait, double the wait; after the last try the error is raised."""
    wait = first_wait
    for i in range(tries):
        try:
            return action()
        except Exception:
            if i + 1 == tries:
                raise
            sleep(wait)
            wait *= 2


def kafka_source(spark: SparkSession, servers: str, topic: str, decode: Callable[[Any], Any] | None = None, **options: str) -> DataFrame:
    """A topic's values from the earliest offset, decoded; needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    for k, v in options.items():
        reader = reader.option(k, v)
    value = F.col("value").cast("string")
    return reader.load().select((decode(value) if decode else value).alias("value"))


def kafka_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """What the Kafka sink takes: camel-case JSON values, and a key if one is named."""
    value = codecs.to_camel_json(F.struct(*df.columns), df.schema).alias("value")
    return df.select(value) if key is None else df.select(F.col(key).cast("string").alias("key"), value)


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str):
    return kafka_rows(df).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


class MessageSink:
    """Sends each row as camel-case JSON by ``client().send(list_of_messages)``, some at a time, with retries.

    It serves queues and brokers (Pulsar, RabbitMQ, SQS, Service Bus): the client wraps
    the library. A batch that fails after its retries fails the task, unless
    ``dead_letters`` takes it.
    """

    def __init__(self, client: Client, size: int = 10, tries: int = 3, wait: float = 0.5, dead_letters: Callable[[list[str], Exception], None] | None = None):
        self.client, self.size, self.tries, self.wait, self.dead_letters = client, size, tries, wait, dead_letters

    def write(self, df: DataFrame) -> None:
        make, size, tries, wait, dead = self.client, self.size, self.tries, self.wait, self.dead_letters

        def send(rows: Iterable[Row]) -> None:
            client = None
            for part in _parts((r.value for r in rows), size):
                client = client or make()
                try:
                    with_retries(lambda part=part: client.send(part), tries, wait)
                except Exception as e:
                    if dead is None:
                        raise
                    dead(part, e)
            if client is not None and hasattr(client, "close"):
                client.close()

        kafka_rows(df).foreachPartition(send)


def _parts(items: Iterable[Any], size: int) -> Iterator[list[Any]]:
    part: list[Any] = []
    for x in items:
        part.append(x)
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part


class _HttpClient:
    def __init__(self, url: str, headers: dict[str, str]):
        self.url, self.headers = url, {"Content-Type": "application/json", **headers}

    def send(self, messages: list[str]) -> None:
        for m in messages:
            request = Request(self.url, m.encode(), self.headers, method="POST")
            with urlopen(request, timeout=30) as answer:
                answer.read()


def http_sink(url: str, headers: dict[str, str] | None = None, tries: int = 3, wait: float = 0.5, dead_letters: Callable[[list[str], Exception], None] | None = None) -> MessageSink:
    """POSTs one JSON object per row; a row that fails goes to ``dead_letters`` or fails the task."""
    return MessageSink(lambda: _HttpClient(url, headers or {}), 1, tries, wait, dead_letters)


class SearchSink:
    """Bulk-indexes documents by ``client().bulk(index, documents)``, which returns the places of those that failed.

    Failed documents go to ``failed`` (a function of a list), the documents themselves.
    """

    def __init__(self, client: Client, index: str, failed: Callable[[list[str]], None], size: int = 50):
        self.client, self.index, self.failed, self.size = client, index, failed, size

    def write(self, df: DataFrame) -> None:
        make, index, failed, size = self.client, self.index, self.failed, self.size

        def send(rows: Iterable[Row]) -> None:
            client = make()
            for part in _parts((r.value for r in rows), size):
                try:
                    bad = client.bulk(index, part)
                except Exception:
                    bad = range(len(part))
                if bad:
                    failed([part[i] for i in bad])

        kafka_rows(df).foreachPartition(send)


class PolledSource(DataSource):
    """Base of sources that poll: ``poll(options, offset)`` gives rows and the next offset.

    Subclasses name themselves and implement ``poll`` and ``acknowledge``. An offset is
    acknowledged after its batch is committed, so a crash replays instead of losing.
    """

    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> StructType:
        raise NotImplementedError

    def first_offset(self) -> dict:
        return {"position": 0}

    def poll(self, offset: dict) -> tuple[list[tuple], dict]:
        raise NotImplementedError

    def replay(self, start: dict, end: dict) -> Iterator[tuple]:
        """The rows between two offsets again; the default polls forward from the first."""
        at = start
        while at != end:
            rows, at = self.poll(at)
            yield from rows
            if not rows:
                return

    def acknowledge(self, offset: dict) -> None:
        pass

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _PolledReader(self)


class _PolledReader(SimpleDataSourceStreamReader):
    def __init__(self, source: PolledSource):
        self.source = source

    def initialOffset(self) -> dict:
        return self.source.first_offset()

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self.source.poll(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.source.replay(start, end)

    def commit(self, end: dict) -> None:
        self.source.acknowledge(end)


class HttpSource(PolledSource):
    """Polls a URL for one JSON object (or an array of them); options ``url``, ``tries``, ``wait``."""

    @classmethod
    def name(cls) -> str:
        return "http_poll"

    def schema(self) -> str:
        return "value string"

    def poll(self, offset: dict) -> tuple[list[tuple], dict]:
        def get() -> bytes:
            with urlopen(self.options["url"], timeout=30) as answer:
                return answer.read()

        body = with_retries(get, int(self.options.get("tries", 3)), float(self.options.get("wait", 0.5)))
        found = json.loads(body)
        rows = [(json.dumps(x),) for x in (found if isinstance(found, list) else [found])]
        return rows, {"position": offset["position"] + len(rows)}


def http_source(spark: SparkSession, url: str, schema: str, **options: str) -> DataFrame:
    spark.dataSource.register(HttpSource)
    reader = spark.readStream.format("http_poll").option("url", url)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select(codecs.from_json_any_case(F.col("value"), StructType.fromDDL(schema)).alias("r")).select("r.*")


def queue_source(name: str, client: Client, batch: int = 10, check: Callable[[str], Any] | None = None) -> type[PolledSource]:
    """A data source over a queue: a client's ``receive(n)`` gives (handle, body) pairs, its ``delete(handles)`` acknowledges them.

    Register the class with ``spark.dataSource.register`` and read ``format(name)``;
    messages are deleted once the micro-batch that holds them is committed. Handles belong
    to the client that received them, so each reader has one client for its life. Where
    ``check`` raises on a body, all that was received with it goes back by the client's
    ``abandon(handles)``, if it has one, and the query fails.
    """

    class QueueSource(PolledSource):
        def __init__(self, options: dict):
            super().__init__(options)
            self.held, self.pending, self.bodies = None, {}, {}

        def __getstate__(self) -> dict:
            return {**self.__dict__, "held": None, "pending": {}, "bodies": {}}

        def _client(self) -> Any:
            self.held = self.held or client()
            return self.held

        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "value string"

        def poll(self, offset: dict) -> tuple[list[tuple], dict]:
            got = self._client().receive(batch)
            try:
                for _, body in got if check else ():
                    check(body)
            except Exception:
                if hasattr(self._client(), "abandon"):
                    self._client().abandon([h for h, _ in got])
                raise
            end = offset["position"] + len(got)
            if got:
                self.pending[end] = [h for h, _ in got]
                self.bodies[end] = [(b,) for _, b in got]
            return [(b,) for _, b in got], {"position": end}

        def replay(self, start: dict, end: dict) -> Iterator[tuple]:
            for at in sorted(self.bodies):
                if start["position"] < at <= end["position"]:
                    yield from self.bodies[at]

        def acknowledge(self, offset: dict) -> None:
            for at in [a for a in self.pending if a <= offset["position"]]:
                self._client().delete(self.pending.pop(at))
                self.bodies.pop(at, None)

    return QueueSource
