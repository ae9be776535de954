"""File sources and sinks: CSV, JSON lines, XML, one file or many."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import codecs


def read_csv(spark: SparkSession, path: str, schema: str | StructType, streaming: bool = False, naive: bool = False, **options: str) -> DataFrame:
    """CSV with a header. ``naive`` splits on every comma and knows no quotes; columns then stand in the schema's order."""
    reader = (spark.readStream if streaming else spark.read).schema(schema).option("header", True).option("enforceSchema", False)
    if streaming:
        reader = reader.option("enforceSchema", True)
    if naive:
        reader = reader.option("quote", "").option("enforceSchema", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, streaming: bool = False, any_case: bool = False) -> DataFrame:
    """One JSON object per line; ``any_case`` matches field names in any case."""
    reader = spark.readStream if streaming else spark.read
    if not any_case:
        return reader.schema(schema).json(path)
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return reader.text(path).select(codecs.from_json_any_case(F.col("value"), kind).alias("r")).select("r.*")


def read_xml(spark: SparkSession, path: str, schema: str, row_tag: str, streaming: bool = False, per_line: bool = False) -> DataFrame:
    """XML elements named ``row_tag``; ``per_line`` reads one element from each line, which splits at any line."""
    reader = spark.readStream if streaming else spark.read
    if per_line:
        return reader.text(path).select(F.from_xml("value", schema, {"rowTag": row_tag}).alias("r")).select("r.*")
    return reader.format("xml").schema(schema).option("rowTag", row_tag).load(path)


def lines(df: DataFrame, fmt: str | Callable[[DataFrame], Column]) -> DataFrame:
    """Each row as one line of text: ``csv``, ``json``, ``xml``, or a function to a column."""
    if callable(fmt):
        value = fmt(df)
    elif fmt == "csv":
        value = codecs.csv_line(*df.columns)
    elif fmt == "json":
        value = F.to_json(F.struct(*df.columns))
    elif fmt == "xml":
        value = F.regexp_replace(F.to_xml(F.struct(*df.columns)), r"\s*\n\s*", "")
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return df.select(value.alias("value"))


class FileSink:
    """Writes rows as lines. ``single`` replaces one file's folder and runs in one task: for
    small results. ``multi`` writes a file per partition, or per record with ``per_record``."""

    def __init__(self, path: str, fmt: str | Callable[[DataFrame], Column] = "json", mode: str = "multi", per_record: bool = False):
        if mode not in ("single", "multi"):
            raise ValueError("mode is 'single' or 'multi'")
        self.path, self.fmt, self.mode, self.per_record = path, fmt, mode, per_record

    def write(self, df: DataFrame) -> None:
        text = lines(df, self.fmt)
        if self.mode == "single":
            text.coalesce(1).write.mode("overwrite").text(self.path)
            return
        writer = text.write.mode("append")
        if self.per_record:
            writer = writer.option("maxRecordsPerFile", 1)
        writer.text(self.path)


class ObjectStoreSink:
    """JSON objects to an object store path (``s3a://``, ``abfss://`` or any other Hadoop file system).

    ``records`` rows a file; 1 is an object for each record, 100 the bulk default. A
    micro-batch is flushed whole, so nothing is left behind at a stop.
    """

    def __init__(self, path: str, records: int = 100):
        self.path, self.records = path, records

    def write(self, df: DataFrame) -> None:
        df.write.mode("append").option("maxRecordsPerFile", self.records).json(self.path)
