"""Setting change capture up, taking the snapshot before the feed, and waiting after failures.

``connect`` opens a DB-API connection. All statements are made here, on the driver, once,
before the stream starts; the feeds themselves are in ``cdc_feeds``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame

from . import cdc


class ReplicaIdentity(Enum):
    """What a deleted row's change holds: as the table says, its key, or all columns."""

    NONE = None
    DEFAULT = "DEFAULT"
    FULL = "FULL"


@dataclass(frozen=True)
class FeedSettings:
    """``initial_load`` reads the table before its changes; ``poll_seconds`` is the trigger's
    interval; ``configure`` lets ``prepare_*`` change the server; failed polls wait, twice
    as long each time, ``max_backoff_seconds`` at most."""

    initial_load: bool = True
    poll_seconds: float = 3.0
    configure: bool = False
    max_backoff_seconds: float = 60.0
    replica_identity: ReplicaIdentity = ReplicaIdentity.NONE

    @property
    def trigger(self) -> str:
        """For ``writeStream.trigger(processingTime=...)``."""
        return f"{round(self.poll_seconds * 1000)} milliseconds"


class Backoff:
    """The wait after each failure in a row: ``first`` seconds, doubled up to ``most``; a success starts again."""

    def __init__(self, first: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep):
        self.first, self.most, self.sleep, self.next = first, most, sleep, first

    def succeeded(self) -> None:
        self.next = self.first

    def failed(self) -> float:
        wait = min(self.next, self.most)
        self.sleep(wait)
        self.next = min(self.next * 2, self.most)
        return wait


def with_backoff(feed: type, settings: FeedSettings = FeedSettings(), first: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> type:
    """A polled source like ``feed`` whose polls that fail give no rows and wait, so the stream goes on when the server is back."""

    class Patient(feed):
        def __init__(self, options: dict):
            super().__init__(options)
            self.backoff = Backoff(first, settings.max_backoff_seconds, sleep)

        def poll(self, offset: dict) -> tuple[list[tuple], dict]:
            try:
                found = super().poll(offset)
            except Exception:
                self.backoff.failed()
                return [], offset
            self.backoff.succeeded()
            return found

    return Patient


def _plain(name: str) -> str:
    if not name.replace("_", "").isalnum():
        raise ValueError(f"a name is letters, digits and underscores: {name!r}")
    return name


def prepare_postgres(connect: Callable[[], Any], schema: str, table: str, slot: str, publication: str, settings: FeedSettings) -> list[str]:
    """Make the slot, the publication and the replica identity where they are missing; what was done.

    The slot exists before ``postgres_snapshot`` reads: a change made in between is in
    both, and ``without_repeats`` or ``apply_changes`` takes it once.
    """
    if not settings.configure:
        return []
    full, done = f'"{_plain(schema)}"."{_plain(table)}"', []
    db = connect()
    try:
        c = db.cursor()
        if settings.replica_identity.value:
            c.execute(f"ALTER TABLE {full} REPLICA IDENTITY {settings.replica_identity.value}")
            done.append("replica identity")
        c.execute("SELECT 1 FROM pg_publication WHERE pubname = %s", (_plain(publication),))
        if c.fetchone() is None:
            c.execute(f'CREATE PUBLICATION "{publication}" FOR TABLE {full}')
            done.append("publication")
        db.commit()  # a slot cannot be made in a transaction that has written
        c.execute("SELECT 1 FROM pg_replication_slots WHERE slot_name = %s", (_plain(slot),))
        if c.fetchone() is None:
            c.execute("SELECT pg_create_logical_replication_slot(%s, %s)", (slot, "wal2json"))
            done.append("slot")
        db.commit()
    finally:
        db.close()
    return done


def prepare_sqlserver(connect: Callable[[], Any], schema: str, table: str, settings: FeedSettings, timeout: float = 30.0, step: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> str:
    """Enable change capture on database and table where it is off, and wait for the capture instance; its name.

    Raises TimeoutError where the instance does not appear in time: a feed on it would fail.
    """
    capture = f"{_plain(schema)}_{_plain(table)}"
    db = connect()
    try:
        c = db.cursor()
        if settings.configure:
            c.execute("SELECT is_cdc_enabled FROM sys.databases WHERE name = DB_NAME()")
            if not (c.fetchone() or (0,))[0]:
                c.execute("EXEC sys.sp_cdc_enable_db")
            c.execute("SELECT is_tracked_by_cdc FROM sys.tables WHERE object_id = OBJECT_ID(?)", (f"{schema}.{table}",))
            if not (c.fetchone() or (0,))[0]:
                c.execute("EXEC sys.sp_cdc_enable_table @source_schema = ?, @source_name = ?, @role_name = NULL, @supports_net_changes = 0", (schema, table))
            db.commit()
        waited = 0.0
        while True:
            c.execute("SELECT 1 FROM cdc.change_tables WHERE capture_instance = ?", (capture,))
            if c.fetchone() is not None:
                return capture
            if waited >= timeout:
                raise TimeoutError(f"no capture instance {capture!r} within {timeout:g} s")
            sleep(step)
            waited += step
    finally:
        db.close()


def with_snapshot(changes: DataFrame, table: Callable[[], DataFrame], settings: FeedSettings) -> DataFrame:
    """The table's rows as initial-load changes before the feed, where the settings ask for them.

    For batches of changes; a stream's first run writes ``cdc.snapshot(table())`` to its
    sink once, then starts from the slot, which was made before.
    """
    return cdc.feed(cdc.snapshot(table()), changes) if settings.initial_load else changes
