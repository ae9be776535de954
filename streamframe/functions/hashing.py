"""Row hashes for change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """Base64 of the MD5 of ``name=value;`` pairs in order of name; null is empty."""
    pairs = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(";")) for c in sorted(columns)]
    return F.base64(F.unhex(F.md5(F.concat(*pairs))))
