"""Every query over sinks, sources, feeds, stores and several micro-batches equals its SQL."""

import os

import duckdb
import pytest
from conftest import SF

from streamframe.plans import queries, source_queries

NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ == source_queries.__name__]


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_equals_its_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    assert got == sorted(repr(r) for r in db.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall())


def test_events_come_in_several_micro_batches(spark):
    """The state that the later ones read is that of the earlier ones."""
    from pyspark.sql import functions as F

    out = queries._streamed(spark, SF, "count", lambda e: e.groupBy("event_type").agg(F.count("*").alias("n")), ["event_type"], "batch", batches=3)
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
