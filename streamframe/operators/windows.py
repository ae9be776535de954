"""Tumbling, sliding and session windows over event time, for batches and streams."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import keys_of

#: Seconds from 0001-01-01 to 1970-01-01; windows are aligned with the former.
EPOCH_GAP = 62_135_596_800
_UNITS = {"microsecond": 1e-6, "millisecond": 1e-3, "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds(duration: str) -> float:
    """``"1 day 2 hours"`` in seconds; months and years have no fixed length."""
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]+)", duration.lower())
    if not parts or re.sub(r"(\d+(?:\.\d+)?)\s*([a-z]+)", "", duration.lower()).strip():
        raise ValueError(f"not a duration: {duration!r}")
    total = 0.0
    for n, unit in parts:
        unit = unit.rstrip("s") if unit != "s" else "second"
        if unit not in _UNITS:
            raise ValueError(f"not a unit of a fixed length: {unit!r}")
        total += float(n) * _UNITS[unit]
    if total <= 0:
        raise ValueError("a duration is above zero")
    return total


def alignment(duration: str) -> str:
    """The start time that aligns windows with 0001-01-01 (weeks with Mondays)."""
    size = round(seconds(duration) * 1_000_000)
    return f"{-EPOCH_GAP * 1_000_000 % size} microseconds"


def _agg(df: DataFrame, groups: list, aggregates: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*groups).agg(*[c.alias(n) for n, c in aggregates.items()])


def tumbling(df: DataFrame, key: str | Sequence[str], time: str, duration: str, aggregates: Mapping[str, Column]) -> DataFrame:
    """key, window_start, window_end and the aggregates; windows hold [start, start + duration)."""
    ks = keys_of(key)
    out = _agg(df, [*ks, F.window(time, duration, duration, alignment(duration)).alias("window")], aggregates)
    return out.select(*ks, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *aggregates)


def sliding(df: DataFrame, key: str | Sequence[str], time: str, duration: str, slide: str, aggregates: Mapping[str, Column], mode: str = "aligned") -> DataFrame:
    """Overlapping windows. ``aligned`` ones start at multiples of the slide; ``anchored`` ones
    end a whole number of slides after each event, so events share one only where their times
    differ by a multiple of the slide."""
    if seconds(slide) > seconds(duration):
        raise ValueError("the slide is longer than the window: every event would be lost")
    ks = keys_of(key)
    if mode == "aligned":
        out = _agg(df, [*ks, F.window(time, duration, slide, alignment(slide)).alias("window")], aggregates)
        return out.select(*ks, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *aggregates)
    if mode != "anchored":
        raise ValueError(f"mode is 'aligned' or 'anchored', not {mode!r}")
    d, s = (F.expr(f"interval {round(seconds(x) * 1_000_000)} microseconds") for x in (duration, slide))
    count = int(seconds(duration) / seconds(slide) + 1e-9)
    first = F.col(time) - d + s
    starts = F.explode(F.array(*[first + F.expr(f"interval {round(seconds(slide) * 1_000_000) * i} microseconds") for i in range(count)]))
    out = _agg(df.withColumn("window_start", starts), [*ks, "window_start"], aggregates)
    return out.withColumn("window_end", F.col("window_start") + d).select(*ks, "window_start", "window_end", *aggregates)


def session(df: DataFrame, key: str | Sequence[str], time: str, gap: str, aggregates: Mapping[str, Column]) -> DataFrame:
    """Runs of events no more than ``gap`` apart; a session ends with its last event."""
    ks = keys_of(key)
    out = _agg(df, [*ks, F.session_window(time, gap).alias("window")], {**aggregates, "session_end": F.max(time)})
    return out.select(*ks, F.col("window.start").alias("session_start"), "session_end", *aggregates)


def events_of_window(*columns: str) -> Column:
    """A window's events as an array of structs in order of the first column: what a list function gets."""
    return F.array_sort(F.collect_list(F.struct(*columns)))
