"""Adapters of queue, broker and search libraries to what the connectors call.

Each imports its library when it is made, on the executor that uses it: pass
``functools.partial(SqsClient, url)`` as the client of a source or sink.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any


class SqsClient:
    """AWS SQS by boto3: long polls of 20 s, at most 10 messages, deleted after the batch."""

    def __init__(self, queue_url: str, **options: Any):
        import boto3

        self.url, self.sqs = queue_url, boto3.client("sqs", **options)

    def receive(self, n: int) -> list[tuple[str, str]]:
        got = self.sqs.receive_message(QueueUrl=self.url, MaxNumberOfMessages=min(n, 10), WaitTimeSeconds=20)
        return [(m["ReceiptHandle"], m["Body"]) for m in got.get("Messages", [])]

    def delete(self, handles: Sequence[str]) -> None:
        for h in handles:
            self.sqs.delete_message(QueueUrl=self.url, ReceiptHandle=h)

    def send(self, messages: Sequence[str]) -> None:
        for at in range(0, len(messages), 10):
            entries = [{"Id": str(i), "MessageBody": m} for i, m in enumerate(messages[at : at + 10])]
            failed = self.sqs.send_message_batch(QueueUrl=self.url, Entries=entries).get("Failed")
            if failed:
                raise RuntimeError(f"{len(failed)} messages were refused")


class RabbitClient:
    """RabbitMQ by pika: a durable queue, persistent messages, manual acknowledgements."""

    def __init__(self, url: str, queue: str):
        import pika

        self.queue, self._properties = queue, pika.BasicProperties(delivery_mode=2, content_type="application/json")
        self.connection = pika.BlockingConnection(pika.URLParameters(url))
        self.channel = self.connection.channel()
        self.channel.queue_declare(queue=queue, durable=True)

    def receive(self, n: int) -> list[tuple[int, str]]:
        out = []
        while len(out) < n:
            method, _, body = self.channel.basic_get(self.queue)
            if method is None:
                break
            out.append((method.delivery_tag, body.decode()))
        return out

    def delete(self, handles: Sequence[int]) -> None:
        for h in handles:
            self.channel.basic_ack(h)

    def abandon(self, handles: Sequence[int]) -> None:
        for h in handles:
            self.channel.basic_nack(h, requeue=True)

    def send(self, messages: Sequence[str]) -> None:
        for m in messages:
            self.channel.basic_publish("", self.queue, m.encode(), self._properties)

    def close(self) -> None:
        self.connection.close()


class PulsarClient:
    """Pulsar: a shared subscription from the earliest message, acknowledged after the batch."""

    def __init__(self, url: str, topic: str, subscription: str = "streamframe"):
        import pulsar

        self._pulsar, self.client, self.topic, self.subscription = pulsar, pulsar.Client(url), topic, subscription
        self._consumer = self._producer = None

    def receive(self, n: int) -> list[tuple[Any, str]]:
        if self._consumer is None:
            p = self._pulsar
            self._consumer = self.client.subscribe(self.topic, self.subscription, consumer_type=p.ConsumerType.Shared, initial_position=p.InitialPosition.Earliest)
        out = []
        while len(out) < n:
            try:
                m = self._consumer.receive(timeout_millis=500)
            except self._pulsar.Timeout:
                break
            out.append((m.message_id(), m.data().decode()))
        return out

    def delete(self, handles: Sequence[Any]) -> None:
        for h in handles:
            self._consumer.acknowledge(h)

    def abandon(self, handles: Sequence[Any]) -> None:
        for h in handles:
            self._consumer.negative_acknowledge(h)

    def send(self, messages: Sequence[str]) -> None:
        if self._producer is None:
            self._producer = self.client.create_producer(self.topic)
        for m in messages:
            self._producer.send(m.encode())

    def close(self) -> None:
        self.client.close()


class ServiceBusQueue:
    """Azure Service Bus: peek-lock, completed after the batch; messages carry a subject."""

    def __init__(self, connection: str, queue: str, subject: str | None = None):
        from azure.servicebus import ServiceBusClient, ServiceBusMessage

        self._message, self.subject, self.bus = ServiceBusMessage, subject, ServiceBusClient.from_connection_string(connection)
        self.receiver, self.sender = self.bus.get_queue_receiver(queue), self.bus.get_queue_sender(queue)

    def receive(self, n: int) -> list[tuple[Any, str]]:
        return [(m, str(m)) for m in self.receiver.receive_messages(max_message_count=n, max_wait_time=5)]

    def delete(self, handles: Sequence[Any]) -> None:
        for h in handles:
            self.receiver.complete_message(h)

    def abandon(self, handles: Sequence[Any]) -> None:
        for h in handles:
            self.receiver.abandon_message(h)

    def send(self, messages: Sequence[str]) -> None:
        self.sender.send_messages([self._message(m, subject=self.subject) for m in messages])

    def close(self) -> None:
        self.bus.close()


class ElasticClient:
    """Elasticsearch: bulk index; gives the places of the documents that were refused."""

    def __init__(self, hosts: Sequence[str], **options: Any):
        from elasticsearch import Elasticsearch

        self.es = Elasticsearch(list(hosts), **options)

    def bulk(self, index: str, documents: Sequence[str]) -> list[int]:
        body = [x for d in documents for x in ({"index": {"_index": index}}, json.loads(d))]
        answer = self.es.bulk(operations=body)
        return [i for i, item in enumerate(answer["items"]) if item["index"].get("error")]
