"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source whose target is r times its size should be taken r times; its
whole part is fixed and the fractional parts are rounded together, so that the sum of
the words behind them is kept. Within a salted group of one source, documents stand
in order of size, the largest first; two neighbours' fractions meet, a random transfer
makes one of them integral, and the other meets the next. What one group leaves over,
one small fractional document, meets the others' in a reduction tree. So a source's
words miss its target by less than one document.

Random numbers and groups are hashes of identifiers, so reruns agree, whatever the
partitions. Null text has no words and is taken zero words of. A null source is a
source of its own. Rows that repeat a doc_id are mixed each on its own. Extra columns are
ignored, or passed on as they came; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialize, small_batches

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Documents that one task rounds in a row, and groups that meet in one group of the next level.
GROUP_ROWS = 4096
FAN_IN = 1024
_EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words: one pass, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(t.split()) if t else 0 for t in b.column(2).cast(pa.binary()).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "source", "size"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(count, "doc_id long, source string, size long")


def numbered_rows(counted: DataFrame, many: int = GROUP_ROWS) -> DataFrame:
    """Rows with the same identifier, source and size get a number (copy), so that each is dealt to a group of its own."""
    same = counted.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    each = lambda d, low, high: d.withColumn("copy", F.explode(F.sequence(low, high)))
    few = each(same.filter(F.col("n") <= many), F.lit(1).cast("long"), F.col("n"))
    # one key may have a third of all rows: its numbers are dealt out in parts first
    parts = same.filter(F.col("n") > many).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / many))))
    parts = parts.repartition("doc_id", "source", "size", "part")
    rest = each(parts, F.col("part") * many + 1, F.least(F.col("n"), (F.col("part") + 1) * many)).drop("part")
    return few.unionByName(rest).drop("n")


def targets(counted: DataFrame) -> DataFrame:
    """Per source: number (by code point, null last), n_docs, source_size, target.

    With weights w and caps c = 3 * size, sharing and resharing ends at
    min(c, level * w) where these sum to all sizes. The level rises from round to round
    until no further source is capped; each round is one aggregate over the sources,
    which are numbered by a range shuffle, not in one task.
    """
    by = counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranged = materialize(by.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = ranged.withColumn("rank", rank).join(before, "part").withColumn("number", F.col("rank") + F.col("before")).drop("part", "rank", "before")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    s = materialize(numbered.withColumns({"weight": weight, "cap": MOST * F.col("source_size")}), "source-weights")
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = None
    while True:
        free = F.lit(True) if level is None else F.col("cap") > level * F.col("weight")
        w, capped, n = s.agg(F.sum(F.when(free, F.col("weight"))), F.coalesce(F.sum(F.when(~free, F.col("cap"))), F.lit(0.0)), F.count(F.when(~free, 1))).first()
        if level is not None and n == known or not w:
            break
        level, known = (total - capped) / w, n
    target = F.least(F.col("cap"), F.lit(float(level or 0.0)) * F.col("weight"))
    return s.select("source", "number", "n_docs", "source_size", target.alias("target"))


def _uniform(*keys: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) that are a hash of the keys (splitmix64)."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in keys:
            h = np.asarray(k).astype(np.uint64) ^ h
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            h = (h ^ (h >> np.uint64(31))) + np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def pivotal(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities in their order; returns them, all 0 or 1 but at most one, and that one's place (or -1).

    The mass that moves between the one at hand (q) and the next (x) is words, not
    copies, so the expected words of the two stay what they are. It moves one way or the
    other, each so far as one becomes 0 or 1, with the odds that keep both expectations.
    A document too large for such a walk over those after it to settle is paired with
    all of them at once: it becomes 0 or 1, and their probabilities shift together.
    """
    n = len(p)
    rest_words = np.append(np.cumsum(size[::-1])[::-1][1:], 0).astype(float)
    rest_root = np.sqrt(np.append(np.cumsum((size[::-1].astype(float)) ** 2)[::-1][1:], 0))
    least = np.append(np.minimum.accumulate(p[::-1])[::-1][1:], 0) if n else p
    most = np.append(np.maximum.accumulate(p[::-1])[::-1][1:], 1) if n else p
    out, held, q, held_size, shift = p.copy(), -1, 0.0, 0.0, 0.0
    for i, (x, s, draw) in enumerate(zip(p.tolist(), size.tolist(), u.tolist())):
        fixed = x <= _EPS or x >= 1 - _EPS
        x = x if fixed else x + shift
        if x <= _EPS or x >= 1 - _EPS:
            out[i] = round(x)
            continue
        if held < 0:
            w = rest_words[i]
            if s > rest_root[i] / 4 and _EPS < least[i] and most[i] < 1 - _EPS and least[i] + shift - (1 - x) * s / w >= 0 and most[i] + shift + x * s / w <= 1:
                out[i] = float(draw < x)
                shift += (x - out[i]) * s / w
                continue
            held, q, held_size = i, x, s
            out[i] = x
            continue
        rate = s / held_size
        up, down = min(1 - x, q / rate), min(x, (1 - q) / rate)
        move = up if draw * (up + down) < down else -down
        x, q = x + move, q - move * rate
        whole_x, whole_q = not _EPS < x < 1 - _EPS, not _EPS < q < 1 - _EPS
        out[i], out[held] = (round(x) if whole_x else x), (round(q) if whole_q else q)
        if whole_x and whole_q:
            held = -1
        elif whole_q:
            held, q, held_size = i, x, s
    return out, held


_STATE = "doc_id long, size long, number long, bucket long, whole long, p double"


def _round_level(level: int, seed: int, last: bool):
    def reduce(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("doc_id", "ascending"), ("p", "ascending")])
        ids = t["doc_id"].fill_null(-1).to_numpy().astype(np.int64)
        place = np.arange(len(ids))
        p, held = pivotal(t["p"].to_numpy(), t["size"].to_numpy(), _uniform(seed, level, ids.view(np.uint64), place))
        if last and held >= 0:
            p[held] = float(_uniform(seed, level + 1, ids[held : held + 1].view(np.uint64), 7)[0] < p[held])
        bucket = pa.array(np.full(len(ids), key[1].as_py() // FAN_IN, np.int64))
        return t.select(["doc_id", "size", "number"]).append_column("bucket", bucket).append_column("whole", t["whole"]).append_column("p", pa.array(p))

    return reduce


def mix(docs: DataFrame, seed: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per document."""
    counted = materialize(numbered_rows(materialize(sizes(docs), "sizes")), "numbered-sizes")
    goal = materialize(targets(counted), "targets")
    g = goal.withColumnRenamed("source", "_source")
    rows = counted.join(g, counted["source"].eqNullSafe(g["_source"]))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("ratio", F.least(ratio, F.lit(MOST)))
    whole = F.floor(F.col("ratio") + _EPS)
    groups = F.ceil(F.col("n_docs") / group_rows)
    state = rows.select(
        "doc_id", "size", F.col("number").cast("long"), F.pmod(F.xxhash64("doc_id", "size", "copy", F.lit(seed)), groups).cast("long").alias("bucket"),
        whole.cast("long").alias("whole"), F.when(F.col("size") > 0, F.greatest(F.col("ratio") - whole, F.lit(0.0))).otherwise(F.lit(0.0)).alias("p"),
    )
    most = goal.agg(F.max(F.ceil(F.col("n_docs") / group_rows))).first()[0] or 1
    level, done = 0, None
    while True:
        last = most <= 1
        out = materialize(state.groupBy("number", "bucket").applyInArrow(_round_level(level, seed, last), _STATE), f"mixed-{level}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        part = out if last else out.filter(~open_)
        done = part if done is None else done.unionByName(part)
        if last:
            break
        state, most, level = out.filter(open_), -(-most // FAN_IN), level + 1
    copies = F.col("whole") + F.col("p").cast("long")
    out = done.withColumn("copies", copies).join(goal, "number")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: every row as often as it is taken, all columns as they came.

    Where rows share a doc_id, their copies are summed and dealt over them evenly.
    """
    key, copies, rows, place, same, n, copy = (fresh(docs.columns, x) for x in ("_id", "_copies", "_rows", "_place", "_same", "_n", "_copy"))
    by = mix(docs, seed).filter("copies > 0").groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    by = materialize(by, "copies")
    out = docs.join(by.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(by[key]))  # as many as documents: never broadcast, at any size
    if by.filter(F.col(rows) > 1).isEmpty():
        taken = F.col(copies)
    else:
        own = Window.partitionBy(key)
        out = out.withColumns({place: F.row_number().over(own.orderBy(F.xxhash64("text"))), same: F.count("*").over(own)})
        taken = F.floor(F.col(copies) / F.col(same)) + (F.col(place) <= F.col(copies) % F.col(same)).cast("long")
    out = out.withColumn(n, taken.cast("int")).filter(F.col(n) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[docs[c] for c in docs.columns])
