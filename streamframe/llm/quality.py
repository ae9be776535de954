"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one ``long`` whose bit *i* is set when rule *i* failed. A policy is a versioned
set of rules, that is, a mask over the ledger; verdicts and ablations are bitwise
operations over it and never touch the texts again.

Defined results: a null or empty text has no words, so it fails ``few_words``
(every ratio rule passes where its denominator is zero). Words are runs of
characters other than ASCII white space. Repeated rows are judged each on its own.
Extra input columns are ignored. Any number of rows, also none, is fine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh, small_batches

#: The symbols that count, and the six ASCII white-space characters.
SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

#: Bytes that no alphabetic word starts with, and the length in bytes beyond which a word is huge.
_NO_LETTER = bytes(c for c in range(128) if not chr(c).isalpha())
_LONG = 40
_first = itemgetter(0)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_upper_words", "n_alpha_words", "n_long_words", "n_bang_words",
)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true; its bit is its place in RULES and never changes."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("upper_case", "100 * n_upper_words > 30 * n_words"),
    Rule("few_alphabetic", "100 * n_alpha_words < 70 * n_words"),
    Rule("short_words", "n_words > 0 AND word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("huge_words", "100 * n_long_words > 5 * n_words"),
    Rule("shouting", "100 * n_bang_words > 20 * n_words"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask_of(self.rules)


POLICIES = {
    "v1": Policy("v1", ("few_words", "repeated_words", "many_symbols", "duplicate_lines", "upper_case")),
    "v2": Policy("v2", tuple(r.name for r in RULES)),
}
PRODUCTION = "v2"


def mask_of(names: Iterable[str]) -> int:
    at = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << at[n] for n in set(names))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more. Windows are compared by the words' numbers, exactly."""
    if len(words) < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    ids, n = np.fromiter(map(number.__getitem__, words), np.int64, len(words)), len(number)
    if n < 2_000_000:  # its cube fits in 63 bits
        windows = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
        windows = pairs[:-1] * n + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return (0, 0, sum(map(text.count, SYMBOLS)), *(0,) * (len(MEASURES) - 3))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    joined = b" ".join(words) + b" "
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(map(bytes.isupper, words)),
        len(bytes(map(_first, words)).translate(None, _NO_LETTER)),
        sum(map(_LONG.__lt__, map(len, words))) if len(max(words, key=len)) > _LONG else 0,
        joined.count(b"!! "),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t) for t in b.column(1).to_pylist()]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *MEASURES])


def _failed() -> Column:
    """The bits of the rules that failed, from the measurements."""
    failed = F.lit(0).cast("long")
    for i, r in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return failed


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: the bits of the rules that failed. One pass, no shuffle."""
    small_batches(docs.sparkSession)
    m = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measured, "doc_id long, " + ", ".join(f"{x} long" for x in MEASURES))
    return m.withColumn("failed", _failed())


def store(docs: DataFrame, path: str) -> DataFrame:
    """Write the ledger of ``docs`` as a table at ``path`` and read it: policies and ablations to come never touch the texts again."""
    ledger(docs).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def breaks(policy: Policy, failed: str = "failed") -> Column:
    """The failed rules that the policy holds against a document, as bits."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long"))


def verdicts(book: DataFrame, policy: Policy) -> DataFrame:
    """Adds base_failed, kept and the policy's version."""
    base = F.col("failed").bitwiseAND(F.lit(mask_of(BASE)).cast("long")) != 0
    return book.withColumns({"base_failed": base, "kept": ~base & (breaks(policy) == 0), "policy": F.lit(policy.version)})


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that it alone rejects.

    The ledger is first counted by masked bits, at most one row for each
    combination that occurs, then each rule reads those few counts.
    """
    counts = book.groupBy(breaks(policy).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r.name in policy.rules])
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.sum("n").alias("n_docs"),
    )


def accepted(docs: DataFrame, policy: Policy) -> DataFrame:
    """The documents that the policy keeps, all columns as they came: the ledger's bits beside each row, in one pass and with no join."""
    names = {m: fresh(docs.columns, m) for m in MEASURES}
    at = docs.columns.index("text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t) for t in b.column(at).to_pylist()]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *names.values()])

    small_batches(docs.sparkSession)
    book = docs.mapInArrow(measured, StructType([*docs.schema.fields, *(StructField(x, LongType()) for x in names.values())]))
    kept = book.columns[: len(docs.columns)]
    # the rules name the measurements: where a column clashes with one, both are renamed for the time of the test
    inner = book.toDF(*[f"_{i}" for i in range(len(kept))], *MEASURES)
    mask = F.lit(policy.mask | mask_of(BASE)).cast("long")
    return inner.filter(_failed().bitwiseAND(mask) == 0).drop(*MEASURES).toDF(*kept)
