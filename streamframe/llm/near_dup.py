"""N-gram Jaccard join with Bayesian pruning of candidates.

1. One pass sketches every whole text: the set of its five-word shingles (64-bit
   hashes of A-Z lower-cased words), a digest of the set, 128 MinHash values and the
   keys of 32 bands of 4 of them. Texts with one set are one class and go on once.
2. Classes that share a band key are linked to the smallest class of that key, a
   linear number of links, whose connected components hold all candidates. At a
   similarity of 0.8 a pair shares no band with a chance of 5e-8.
3. Components are cut into blocks of bounded size and pairs of blocks go to tasks. A
   task compares MinHash values 32 at a time and drops a pair once the posterior
   probability (uniform prior) that its similarity reaches the threshold is below the
   tolerance; the others are verified on their whole shingle sets. Pairs are counted
   where they are found; only counts per class and a spanning forest leave the task.
4. Connected components over the forest are the near-duplicate groups.

Defined results: a text of one to four words has one shingle, all of them; texts
without words are equal and link to nothing else. Null text is empty text. Of a group
the document with the largest doc_id stays, one of its texts where that id is repeated. Rows that repeat a doc_id and its text
stay or go together; exact deduplication removes them before. Null doc_ids are the smallest. Extra columns are ignored, or
passed on as they came; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize, small_batches
from .components import components

WORDS = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
STEP = 32
#: Classes in a block; small components share a task until it has about so many classes.
BLOCK = 256


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    from xxhash import xxh3_64_intdigest

    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w))
    n = min(words, len(w))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + _mix(h[k : len(h) - n + 1 + k])
        return np.unique(_mix(total))


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_229)
    return r.integers(0, 1 << 63, (HASHES, 1), np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, (HASHES, 1), np.uint64)


def minhash(s: np.ndarray, parameters: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = parameters
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 512):
            np.minimum(low, (a * s[at : at + 512] + b).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(BAND_ROWS):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + signature.reshape(BANDS, BAND_ROWS)[:, k])
    return h.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> dict[int, int]:
    """After n compared values, the fewest matches m with P(similarity >= threshold | m of n) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and that probability
    is the chance of at most m successes in n + 1 trials at the threshold.
    """
    out = {}
    for n in range(step, hashes + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def surviving_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, same: bool, threshold: float, limits: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` that the sizes and the incremental comparison leave as pairs."""
    i, j = np.nonzero(np.minimum(na[:, None], nb[None, :]) >= threshold * np.maximum(na[:, None], nb[None, :]))
    if same:
        i, j = i[i < j], j[i < j]
    matches, at = np.zeros(len(i), np.int32), 0
    for n, least in limits.items():
        for k in range(at, n):
            matches += a[i, k] == b[j, k]
        at, alive = n, matches >= least
        i, j, matches = i[alive], j[alive], matches[alive]
    return i, j


def intersections(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a[i] and b[j]: merged pair by pair where there are few, else by a product of incidence matrices."""
    if len(i) <= 2 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    ia, ib = np.unique(i), np.unique(j)
    va, vb = np.concatenate([a[x] for x in ia]), np.concatenate([b[y] for y in ib])
    ra, rb = np.repeat(np.arange(len(ia)), [len(a[x]) for x in ia]), np.repeat(np.arange(len(ib)), [len(b[y]) for y in ib])
    shared = np.intersect1d(va, vb)
    total = np.zeros((len(ia), len(ib)), np.float32)

    def column(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, values).clip(max=len(shared) - 1)
        hit = shared[at] == values
        at, rows = at[hit], rows[hit]
        order = np.argsort(at, kind="stable")
        return at[order], rows[order]

    if len(shared):
        (ca, ra), (cb, rb) = column(va, ra), column(vb, rb)
        for low in range(0, len(shared), 4096):
            width = min(4096, len(shared) - low)
            parts = []
            for c, r, n in ((ca, ra, len(ia)), (cb, rb, len(ib))):
                s, e = np.searchsorted(c, [low, low + width])
                m = np.zeros((n, width), np.float32)
                m[r[s:e], c[s:e] - low] = 1
                parts.append(m)
            total += parts[0] @ parts[1].T
    return total[np.searchsorted(ia, i), np.searchsorted(ib, j)].astype(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the shingle set, its size, MinHash signature, band keys: one pass, no shuffle."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters = _parameters()
        for b in batches:
            digest, n, sig, keys = [], [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                s = shingles(t)
                m = minhash(s, parameters)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                n.append(len(s))
                sig.append(m.tobytes())
                keys.append(band_keys(m).tolist() if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(digest, pa.string()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "row", "digest", "n", "signature", "keys"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", _row(), "text").mapInArrow(sketch, "doc_id long, row long, digest string, n long, signature binary, keys array<long>")


def _row():
    """What tells rows apart that share a doc_id, or have none."""
    return F.xxhash64("doc_id", "text").alias("row")


def classes_of(found: DataFrame) -> DataFrame:
    """One row for each shingle set: node, digest, doc_id (the largest) and row of the one that stands for it, n_copies, signature, keys."""
    one = found.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("own"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    return one.select("digest", "own.doc_id", "own.row", "n_copies", "n", "signature", "keys").withColumn("node", F.monotonically_increasing_id())


def candidates(classes: DataFrame) -> DataFrame:
    """node, component: classes with a chance of a partner; partners are in one component."""
    keys = classes.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("c")).filter("c > 1")
    shared = materialize(shared, "shared-keys")
    return components(lookup(keys, shared, "key", "c").filter("node <> first").select("node", "first"), "node", "first")


_SETS = "node long, component long, blocks long, signature binary, shingles binary"


def member_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The shingle sets of the candidate classes, from the text of a row of each; of rows that repeat, one in each task."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            new = [x not in met and not met.add(x) for x in b.column(2).to_pylist()]
            b = b.filter(pa.array(new, pa.bool_()))
            found = [shingles(t) for t in b.column(0).cast(pa.binary()).to_pylist()]
            own = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() == d for s, d in zip(found, b.column(1).to_pylist())]
            t = pa.RecordBatch.from_arrays([*b.columns[2:], pa.array([s.tobytes() for s in found], pa.binary())], ["node", "component", "blocks", "signature", "shingles"])
            yield t.filter(pa.array(own, pa.bool_()))

    m = members.withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", _row())
    rows = rows.join(m, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
    return rows.select("text", "digest", "node", "component", "blocks", "signature").mapInArrow(sets, _SETS)


_FOUND = "node long, other long, links long"


def _verify(threshold: float, tolerance: float):
    limits = least_matches(threshold, tolerance)

    def one(t: dict, left: np.ndarray, right: np.ndarray, same: bool) -> list[tuple]:
        i, j = surviving_pairs(t["sig"][left], t["sig"][right], t["n"][left], t["n"][right], same, threshold, limits)
        if not len(i):
            return []
        sets_a, sets_b = [t["set"][x] for x in left], [t["set"][x] for x in right]
        both = intersections(sets_a, sets_b, i, j)
        union = t["n"][left][i] + t["n"][right][j] - both
        linked = both >= threshold * union
        i, j = left[i[linked]], right[j[linked]]
        degree = np.bincount(np.concatenate([i, j]), minlength=len(t["node"]))
        rows = [(int(t["node"][x]), None, int(degree[x])) for x in np.flatnonzero(degree)]
        parent = list(range(len(t["node"])))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(i.tolist(), j.tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        rows += [(int(t["node"][x]), int(t["node"][root(x)]), 0) for x in np.flatnonzero(degree) if root(x) != x]
        return rows

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node = table["node"].to_numpy()
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))  # of rows that repeat a document, one
        table, node = table.take(pa.array(first)), node[first]
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        t = {"node": node, "set": sets, "n": np.array([len(s) for s in sets]), "sig": np.array([np.frombuffer(x, np.uint32) for x in table["signature"].to_pylist()])}
        component, block = table["component"].to_numpy(), table["block"].to_numpy()
        low, high = key[1].as_py(), key[2].as_py()
        rows: list[tuple] = []
        if high < 0:  # whole small components
            order = np.argsort(component, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
                rows += one(t, own, own, True)
        else:
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            rows += one(t, left, right, low == high)
        cols = list(zip(*rows)) if rows else [(), (), ()]
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("node", "other", "links"), cols)})

    return verify


def verified(sets: DataFrame, threshold: float, tolerance: float, block: int, tasks: int) -> DataFrame:
    """Per class and task the links found there, and edges of a spanning forest: node, other, links."""
    b = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = sets.withColumn("block", b).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    alone = F.col("blocks") == 1
    rows = rows.select(
        F.when(alone, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.col("component")).cast("long").alias("k"),
        F.when(alone, F.lit(-1)).otherwise(F.least("block", "o")).cast("long").alias("lo"),
        F.when(alone, F.lit(-1)).otherwise(F.greatest("block", "o")).cast("long").alias("hi"),
        "node", "component", "block", "signature", "shingles",
    )
    return rows.groupBy("k", "lo", "hi").applyInArrow(_verify(threshold, tolerance), _FOUND)


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (of its near-duplicate group, the largest doc_id there), n_links
    (other texts at the threshold or above), exact_id and n_copies (of texts with its shingle set), group_size, kept."""
    found = materialize(sketches(docs), "sketches")
    classes = materialize(classes_of(found), "classes")
    near = materialize(candidates(classes), "candidates")
    large = near.groupBy("component").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("c")).filter("blocks > 1")
    members = lookup(near, materialize(large, "large-components"), "component", "c", "left").drop("c").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).join(classes.select("node", "doc_id", "row", "digest", "signature"), "node")
    tasks = max(1, -(-near.count() // block))
    links = materialize(verified(member_sets(docs, members), threshold, tolerance, block, tasks), "links")
    group = components(links.filter("other IS NOT NULL").select("node", "other"), "node", "other")
    degree = links.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("n_links"))
    own = classes.select("node", "digest", F.col("doc_id").alias("exact_id"), "row", "n_copies").join(group, "node", "left").join(degree, "node", "left")
    own = materialize(own.withColumn("component", F.coalesce("component", "node")), "near-classes")
    whole = own.groupBy("component").agg(F.max(F.struct("exact_id", "row")).alias("stays"), F.sum("n_copies").alias("group_size"), F.count("*").alias("c"))
    named = lookup(own.drop("row"), materialize(whole, "near-groups"), "component", "c").select("digest", F.col("stays.exact_id").alias("class_id"), F.col("stays.row").alias("stays"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "exact_id", "n_copies", "group_size")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("row") == F.col("stays"))
    return lookup(found.select("doc_id", "row", "digest"), materialize(named, "near-named"), "digest", "n_copies").select("doc_id", "class_id", "n_links", "exact_id", "n_copies", "group_size", kept.alias("kept"), "row")


def survivors(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns as they came: one of each group."""
    keep = join(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    keep = materialize(keep, "near-kept").hint("merge")  # as many as documents: never broadcast, at any size
    row = F.xxhash64(docs["doc_id"].cast("long"), docs["text"])
    return docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(keep["_id"]) & (row == keep["_row"]), "left_semi")
