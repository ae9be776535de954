"""Change feeds of databases as polled sources: replication slots, change tables, change streams.

``connect`` opens the database (DB-API, or a Mongo collection); positions are exclusive
and are acknowledged once the micro-batch that holds their changes is committed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from .connectors import PolledSource


def postgres_feed(name: str, connect: Callable[[], Any], slot: str, batch: int = 1000) -> type[PolledSource]:
    """wal2json messages of a logical slot, peeked at and advanced after commit: nothing is lost in a crash."""

    class Feed(PolledSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "lsn string, data string"

        def first_offset(self) -> dict:
            return {"lsn": ""}

        def _peek(self) -> list[tuple[str, str]]:
            db = connect()
            try:
                c = db.cursor()
                c.execute("SELECT lsn::text, data FROM pg_logical_slot_peek_changes(%s, NULL, %s)", (slot, batch))
                return [tuple(r) for r in c.fetchall()]
            finally:
                db.close()

        def poll(self, offset: dict) -> tuple[list[tuple], dict]:
            rows = [r for r in self._peek() if not offset["lsn"] or lsn_number(r[0]) > lsn_number(offset["lsn"])]
            return rows, {"lsn": rows[-1][0] if rows else offset["lsn"]}

        def replay(self, start: dict, end: dict) -> Iterator[tuple]:
            low = lsn_number(start["lsn"]) if start["lsn"] else -1
            return iter([r for r in self._peek() if low < lsn_number(r[0]) <= lsn_number(end["lsn"] or "0/0")])

        def acknowledge(self, offset: dict) -> None:
            if offset["lsn"]:
                db = connect()
                try:
                    db.cursor().execute("SELECT pg_replication_slot_advance(%s, %s::pg_lsn)", (slot, offset["lsn"]))
                    db.commit()
                finally:
                    db.close()

    return Feed


def lsn_number(lsn: str) -> int:
    """``16/B374D848`` as a number."""
    high, low = lsn.split("/")
    return (int(high, 16) << 32) + int(low, 16)


def sqlserver_feed(name: str, connect: Callable[[], Any], capture: str, columns: str) -> type[PolledSource]:
    """Rows of a capture instance after the last position, as JSON with their operation codes."""
    if not capture.replace("_", "").isalnum():
        raise ValueError("a capture instance's name is letters, digits and underscores")

    class Feed(PolledSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "lsn string, seq string, operation int, data string"

        def first_offset(self) -> dict:
            return {"lsn": ""}

        def _between(self, low: str, high: str | None) -> list[tuple]:
            db = connect()
            try:
                c = db.cursor()
                c.execute("SELECT sys.fn_cdc_get_min_lsn(?), sys.fn_cdc_get_max_lsn()", (capture,))
                first, last = c.fetchone()
                if last is None or low and bytes.fromhex(low) >= last:
                    return []
                if low:
                    c.execute("SELECT sys.fn_cdc_increment_lsn(?)", (bytes.fromhex(low),))
                    first = c.fetchone()[0]
                c.execute(f"SELECT __$start_lsn, __$seqval, __$operation, {columns} FROM cdc.fn_cdc_get_all_changes_{capture}(?, ?, N'all') ORDER BY __$start_lsn, __$seqval", (first, bytes.fromhex(high) if high else last))
                names = [d[0] for d in c.description][3:]
                return [(r[0].hex(), r[1].hex(), r[2], json.dumps(dict(zip(names, r[3:])), default=str)) for r in c.fetchall()]
            finally:
                db.close()

        def poll(self, offset: dict) -> tuple[list[tuple], dict]:
            rows = self._between(offset["lsn"], None)
            return rows, {"lsn": rows[-1][0] if rows else offset["lsn"]}

        def replay(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter(self._between(start["lsn"], end["lsn"]) if end["lsn"] != start["lsn"] else [])

    return Feed


def mongo_feed(name: str, connect: Callable[[], Any], batch: int = 1000) -> type[PolledSource]:
    """Change events of a collection as JSON, resumed by token."""

    class Feed(PolledSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "event string"

        def first_offset(self) -> dict:
            return {"token": None}

        def poll(self, offset: dict) -> tuple[list[tuple], dict]:
            rows, token = [], offset["token"]
            with connect().watch(full_document="updateLookup", resume_after=token) as events:
                while len(rows) < batch:
                    e = events.try_next()
                    if e is None:
                        break
                    rows.append((json.dumps(e, default=str),))
                    token = events.resume_token
            return rows, {"token": token}

        def replay(self, start: dict, end: dict) -> Iterator[tuple]:
            at = start["token"]
            with connect().watch(full_document="updateLookup", resume_after=at) as events:
                while at != end["token"]:
                    e = events.try_next()
                    if e is None:
                        return
                    at = events.resume_token
                    yield (json.dumps(e, default=str),)

    return Feed
