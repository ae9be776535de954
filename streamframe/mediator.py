"""A dispatcher for commands, queries and notifications; query handlers may return DataFrames."""

from __future__ import annotations

import logging
import time
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

log = logging.getLogger(__name__)
Handler = Callable[[Any], Any]
Behavior = Callable[[Any, Handler], Any]


class HandlerMissing(LookupError):
    pass


class ValidationError(ValueError):
    """Field errors by field."""

    def __init__(self, errors: dict[str, list[str]]):
        super().__init__("; ".join(f"{k}: {', '.join(v)}" for k, v in errors.items()))
        self.errors = errors


class Mediator:
    """One handler for each command and query type, any number for a notification type.

    Behaviours wrap a handler in the order they were added, the first outermost.
    """

    def __init__(self) -> None:
        self._one: dict[tuple[str, type], Handler] = {}
        self._many: dict[type, list[Handler]] = defaultdict(list)
        self._behaviors: dict[str, list[Behavior]] = defaultdict(list)

    def _register(self, kind: str, message: type, handler: Handler) -> None:
        if (kind, message) in self._one:
            raise ValueError(f"{message.__name__} has a {kind} handler already")
        self._one[kind, message] = handler

    def on_command(self, message: type, handler: Handler) -> None:
        self._register("command", message, handler)

    def on_query(self, message: type, handler: Handler) -> None:
        self._register("query", message, handler)

    def on_notification(self, message: type, handler: Handler) -> None:
        self._many[message].append(handler)

    def add_behavior(self, kind: str, behavior: Behavior) -> None:
        self._behaviors[kind].append(behavior)

    def _send(self, kind: str, message: Any) -> Any:
        handler = self._one.get((kind, type(message)))
        if handler is None:
            raise HandlerMissing(f"no {kind} handler for {type(message).__name__}")
        for b in reversed(self._behaviors[kind]):
            handler = (lambda inner, b: lambda m: b(m, inner))(handler, b)
        return handler(message)

    def send_command(self, command: Any) -> Any:
        return self._send("command", command)

    def send_query(self, query: Any) -> Any:
        return self._send("query", query)

    def publish(self, notification: Any) -> None:
        """All handlers at once; after all have ended, the first error is raised."""
        handlers = self._many[type(notification)]
        if not handlers:
            return
        with ThreadPoolExecutor(len(handlers)) as pool:
            for f in [pool.submit(h, notification) for h in handlers]:
                f.result()


def logging_behavior(message: Any, inner: Handler) -> Any:
    """Logs the elapsed time; errors pass through."""
    began = time.perf_counter()
    try:
        out = inner(message)
    except Exception:
        log.exception("%s failed after %.1f ms", type(message).__name__, (time.perf_counter() - began) * 1000)
        raise
    log.info("%s took %.1f ms", type(message).__name__, (time.perf_counter() - began) * 1000)
    return out


@contextmanager
def unit_of_work(connection):
    """Commit what is done on a DB-API connection, or roll all of it back."""
    try:
        yield connection
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
