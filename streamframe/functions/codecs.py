"""Column codecs: text or bytes to values and back, inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


def camel_case(name: str) -> str:
    """``user_id`` and ``UserId`` become ``userId``."""
    parts = [p for p in re.split(r"[_\s]+", name) if p]
    if not parts:
        return name
    first = parts[0][0].lower() + parts[0][1:]
    return first + "".join(p[0].upper() + p[1:] for p in parts[1:])


def to_camel_json(row: Column, schema: StructType) -> Column:
    """JSON of a struct with camel-case names, nested structs included."""
    return F.to_json(row.cast(_renamed(schema)))


def _renamed(kind: DataType) -> DataType:
    if isinstance(kind, StructType):
        out = StructType()
        for f in kind.fields:
            out = out.add(camel_case(f.name), _renamed(f.dataType), f.nullable)
        return out
    if isinstance(kind, ArrayType):
        return ArrayType(_renamed(kind.elementType), kind.containsNull)
    if isinstance(kind, MapType):
        return MapType(kind.keyType, _renamed(kind.valueType), kind.valueContainsNull)
    return kind


def from_json_any_case(text: Column, schema: StructType) -> Column:
    """Read a flat JSON object whose field names match in any case. Null or empty text gives null."""
    entries = F.from_json(text, MapType(StringType(), StringType()))
    lower = _lower_keys(entries)
    fields = [_value(F.try_element_at(lower, F.lit(f.name.lower())), f.dataType).alias(f.name) for f in schema.fields]
    return F.when(entries.isNotNull(), F.struct(*fields))


def _lower_keys(entries: Column) -> Column:
    """Lower-case a map's keys; of keys that agree then, the last one counts."""
    pairs = F.map_entries(entries)
    keep = F.aggregate(
        pairs,
        F.expr("cast(map() as map<string, string>)"),
        lambda a, p: F.map_concat(F.map_filter(a, lambda k, _: k != F.lower(p["key"])), F.create_map(F.lower(p["key"]), p["value"])),
    )
    return keep


def _value(text: Column, kind: DataType) -> Column:
    if isinstance(kind, (StructType, ArrayType, MapType)):
        return F.from_json(text, kind)
    return text.try_cast(kind)


def to_base64(text: Column) -> Column:
    return F.base64(F.encode(text, "UTF-8"))


def from_base64(data: Column) -> Column:
    """Null or empty payloads give null."""
    return F.when(data != "", F.decode(F.unbase64(data), "UTF-8"))


def csv_line(*columns: Column | str) -> Column:
    """Values joined by commas, no header, no quotes; null is empty."""
    return F.concat_ws(",", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])


def from_naive_csv(line: Column, header: list[str], schema: StructType) -> Column:
    """Split on every comma, bind by header name in any case; cells that do not parse are null."""
    cells = F.split(line, ",", -1)
    at = {h.strip().lower(): i for i, h in enumerate(header)}
    fields = []
    for f in schema.fields:
        i = at.get(f.name.lower())
        cell = F.lit(None).cast("string") if i is None else F.get(cells, i)
        fields.append(F.trim(cell).try_cast(f.dataType).alias(f.name))
    return F.struct(*fields)


def from_csv(line: Column, schema: str, **options: str) -> Column:
    """One quoted CSV line as a struct."""
    return F.from_csv(line, schema, options)


def to_xml(row: Column, root: str = "ROW") -> Column:
    return F.to_xml(row, {"rowTag": root})


def from_xml(line: Column, schema: str, root: str = "ROW") -> Column:
    return F.from_xml(line, schema, {"rowTag": root})


def protobuf_decoder(message_class: type, schema: StructType):
    """A pandas UDF that reads messages of a generated class; the class travels by import."""
    import pandas as pd

    names = [f.name for f in schema.fields]

    @F.pandas_udf(schema)
    def decode(data: pd.Series) -> pd.DataFrame:
        rows = []
        for d in data:
            m = message_class.FromString(bytes(d)) if d else None
            rows.append([getattr(m, n, None) if m is not None else None for n in names])
        return pd.DataFrame(rows, columns=names)

    return decode


def protobuf_encoder(message_class: type):
    """A pandas UDF that writes structs as messages of a generated class."""
    import pandas as pd

    @F.pandas_udf("binary")
    def encode(rows: pd.DataFrame) -> pd.Series:
        def one(values: Mapping) -> bytes:
            return message_class(**{k: v for k, v in values.items() if v is not None}).SerializeToString()

        return pd.Series([one(r) for r in rows.to_dict("records")])

    return encode
