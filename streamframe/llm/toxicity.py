"""Toxicity from the nearest labelled examples.

1. A bounded sample of labelled rows (LABELLED rows by hash, POSTINGS terms at most) are the
   examples. All their words are terms, none is selected; the words of other texts that no
   example holds are outside of the vector space.
2. One pass over all whole texts turns each into counts of terms; document frequencies
   are summed over all documents, as partial sums for each task.
3. The examples' vectors form an inverted index in blocks of alike examples with the
   largest weight per term and block. A term's weight is (1 + ln count) x idf x the square
   of its relevance frequency; the last, log2(2 + examples of label 1 / examples of label 0),
   is what tells words of insult from other words that are as rare. For each document the blocks are read
   in the order of their bounds, in runs, until none can hold a nearer example than the K
   nearest found, so the cosines and the K are exact.
4. The neighbours vote, weighed by cosine; votes are calibrated by a logistic fit to
   the examples' own leave-one-out votes. Neighbours are kept as evidence.

Defined results: null and empty texts, and texts without a term, get the base rate of the
sample. With no labelled row the score is 0. Labels, language, source and identifiers
are no inputs of a score; rows held out are never in the sample. Several labels for one
doc_id count as the largest; several different texts for one labelled doc_id are an example
each, equal rows are one, and LABELLED bounds them together. Rows that repeat, or have a null
doc_id, are scored each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Labelled rows that are examples, and different words in all of them together, at most.
LABELLED = 4096
POSTINGS = 2_000_000
#: Neighbours, examples in a block of the index, and folds of which the first is held out.
K = 15
BLOCK = 128
FOLDS = 5
#: Terms whose weights are kept as a matrix beside the postings: only a matter of speed.
PANEL = 256
#: Documents that are searched together, and terms in a part of the frequencies.
BATCH = 256
PART = 8192
#: The cosine that the base rate votes with.
PRIOR = 0.1
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo FOLDS, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def numbers_of(words: list[str]) -> np.ndarray:
    """The words' 63-bit numbers."""
    from xxhash import xxh3_64_intdigest

    return (np.fromiter((xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) >> np.uint64(1)).astype(np.int64)


def _by_batch(docs: DataFrame, keep: tuple[str, ...], number, kind: pa.DataType) -> DataFrame:
    """The columns ``keep`` and each text's counts of terms; ``number`` turns words' numbers into terms, -1 for none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what stands between white space: its word's term, -1 for none, or -2 - i where several[i] are its words' terms
        known: dict[str, int] = {}
        several: list[np.ndarray] = []
        for b in batches:
            chunks = [(t or "").lower().split() for t in b.column(0).to_pylist()]
            if len(known) > 600_000:
                known, several = {}, []
            new = list({x for c in chunks for x in c if x not in known})
            parts = list(map(words_of, new))
            terms = number(numbers_of([w for p in parts for w in p]))
            at = 0
            for x, p in zip(new, parts):
                own = terms[at : at + len(p)]
                at += len(p)
                if len(p) == 1:
                    known[x] = int(own[0])
                elif (own >= 0).any():
                    known[x] = -2 - len(several)
                    several.append(own)
                else:
                    known[x] = -1
            rows, ids = np.repeat(np.arange(len(chunks)), list(map(len, chunks))), np.fromiter((known[x] for c in chunks for x in c), np.int64)
            many = np.flatnonzero(ids < -1)
            if len(many):
                more = [several[-2 - i] for i in ids[many].tolist()]
                rows, ids = np.concatenate([rows, np.repeat(rows[many], list(map(len, more)))]), np.concatenate([ids, *more])
            rows, ids = rows[ids >= 0], ids[ids >= 0]
            order = np.lexsort((ids, rows)) if many_bits else np.argsort(rows << 32 | ids)
            rows, ids = rows[order], ids[order]
            first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1]))[: len(ids)])
            n = np.diff(np.append(first, len(ids)))
            start = pa.array(np.searchsorted(rows[first], np.arange(len(chunks) + 1)), pa.int32())
            arrays = [pa.ListArray.from_arrays(start, pa.array(v, k)) for v, k in ((ids[first].astype(kind.to_pandas_dtype()), kind), (n.astype(np.int32), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *arrays], [*b.schema.names[1:], "terms", "counts"])

    many_bits = kind == pa.int64()
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"terms array<{'long' if kind == pa.int64() else 'int'}>, counts array<int>"])
    small_batches(docs.sparkSession)
    return docs.select("text", *keep).mapInArrow(count, schema)


def vectors(docs: DataFrame, terms: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and each text's counts of ``terms`` (sorted numbers), by their places."""

    def place(numbers: np.ndarray) -> np.ndarray:
        at = np.searchsorted(terms, numbers)
        return np.where((at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == numbers), at, -1) if len(terms) else np.full(len(numbers), -1)

    return _by_batch(docs, keep, place, pa.int32())


def document_frequencies(seen: DataFrame, n_terms: int) -> np.ndarray:
    """In how many rows of ``seen`` each term is: a partial sum from each task, in compressed parts, added up in two levels."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, task = np.zeros(n_terms, np.int64), TaskContext.get().partitionId()
        for b in batches:
            at = b.column(0).flatten().to_numpy()
            if len(at):
                np.add.at(total, at, 1) if 8 * len(at) < n_terms else np.add(total, np.bincount(at, minlength=n_terms), out=total)
        parts = [zlib.compress(total[s : s + PART].tobytes(), 1) for s in range(0, n_terms, PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task % 64] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["part", "salt", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in t["sums"])
        return pa.table({"part": t["part"][:1], "salt": t["salt"][:1], "sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "part int, salt int, sums binary"
    rows = seen.select("terms").mapInArrow(partial, schema).groupBy("part", "salt").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema).collect()
    parts = {r["part"]: np.frombuffer(zlib.decompress(bytes(r["sums"])), np.int64) for r in rows}  # as long as the list of terms
    return np.concatenate([parts[i] for i in sorted(parts)]) if parts else np.zeros(n_terms, np.int64)


class Examples:
    """Labelled examples as rows of a sparse matrix: identifiers, labels, and each one's terms (places) and counts, one after the other."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, start: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        self.ids, self.labels, self.start, self.terms, self.counts = ids, labels, start, terms, counts

    def __len__(self) -> int:
        return len(self.ids)

    def relevance(self, n_terms: int) -> np.ndarray:
        """Relevance frequency of each term: log2(2 + a / max(1, c)) for a examples of label 1 and c of label 0 that hold it."""
        toxic = np.repeat(self.labels > 0, np.diff(self.start))
        a, c = np.bincount(self.terms[toxic], minlength=n_terms), np.bincount(self.terms[~toxic], minlength=n_terms)
        return np.log2(2 + a / np.maximum(1, c))


def weigh(terms: np.ndarray, counts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A unit vector of the weights (1 + ln count) x scale."""
    w = (1 + np.log(counts)) * scale[terms]
    norm = np.sqrt(w @ w)
    return w / norm if norm else w


class BlockMaxIndex:
    """An inverted index over labelled examples, in blocks with the largest weight per term.

    Postings of the most frequent terms are held as dense panels of a block, the others' as
    lists. An example's position is its place in the order by which alike ones share blocks.
    """

    def __init__(self, examples: Examples, scale: np.ndarray, block: int = BLOCK, panel: int = PANEL):
        n, v = len(examples), len(scale)
        self.scale, self.block, self.blocks = scale, block, -(-n // block)
        df = np.bincount(examples.terms, minlength=v)
        rows = []
        for i in range(n):
            s, e = examples.start[i], examples.start[i + 1]
            t = examples.terms[s:e]
            w = weigh(t, examples.counts[s:e], scale)
            # alike examples: by the heaviest term if it is one of label 1, else by the commonest term (a language's), and by length
            rows.append((int(t[np.argmax(w)]) if examples.labels[i] and len(t) else -1, int(t[np.argmax(df[t])]) if len(t) else -1, len(t), int(examples.ids[i]), i, t, w))
        rows.sort(key=lambda r: r[:5])
        self.ids, self.labels = np.array([r[3] for r in rows], np.int64), np.array([examples.labels[r[4]] for r in rows], float)
        self.vectors = [(r[5], r[6]) for r in rows]
        term = np.concatenate([r[5] for r in rows] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([r[6] for r in rows] or [np.zeros(0)])
        who = np.repeat(np.arange(n), [len(r[5]) for r in rows]).astype(np.int64)
        dense = np.argsort(-df, kind="stable")[: min(panel, v)]
        dense = dense[df[dense] > 1]
        self.column = np.full(v, -1, np.int32)
        self.column[dense] = np.arange(len(dense))
        col = self.column[term]
        self.panel = np.zeros((len(dense), self.blocks * block))
        self.panel[col[col >= 0], who[col >= 0]] = weight[col >= 0]
        self.maxima = self.panel.reshape(len(dense), self.blocks, block).max(axis=2) if n else np.zeros((len(dense), 0))
        rest = np.flatnonzero(col < 0)
        rest = rest[np.lexsort((who[rest], term[rest]))]
        self.who, self.weight = who[rest].astype(np.int32), weight[rest]
        self.start = np.searchsorted(term[rest], np.arange(v + 1))
        self.read = self.asked = 0

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query (terms, weights) the k nearest examples (positions) and their cosines, by cosine, then
        position; without example ``but[i]``. Only cosines above 0 count, and 12 decimals of them."""
        m, nb, size = len(queries), self.blocks, self.block
        if not nb:
            return [(np.zeros(0, np.int64), np.zeros(0))] * m
        common, listed = np.zeros((m, len(self.panel))), np.zeros((m, nb * size))
        for r, (t, w) in enumerate(queries):
            col = self.column[t]
            common[r, col[col >= 0]] = w[col >= 0]
            t, w = t[col < 0], w[col < 0]
            s = self.start[t]
            n = self.start[t + 1] - s
            at = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
            if len(at):
                listed[r] = np.bincount(self.who[at], np.repeat(w, n) * self.weight[at], minlength=nb * size)
        # a block's bound: its largest weights of the common terms, and the largest sum that the listed ones have in it
        bounds = common @ self.maxima + listed.reshape(m, nb, size).max(axis=2)
        order = np.argsort(-bounds, axis=1, kind="stable")
        score, top, rows = np.full((m, nb * size), -1.0), np.full((m, k), -1.0), np.arange(m)
        low, high = 0, 1
        while low < nb:
            picks = order[:, low:high]
            wanted = bounds[rows[:, None], picks]
            wanted = (wanted >= top.min(axis=1)[:, None] - 1e-9) & (wanted > 0)
            if not wanted.any():
                break
            who, place = np.nonzero(wanted)
            which = picks[who, place]
            self.read += len(which)
            new = np.full((m, picks.shape[1], size), -1.0)
            for b in np.unique(which):
                own = which == b
                r = who[own]
                cut = slice(b * size, (b + 1) * size)
                got = common[r] @ self.panel[:, cut] + listed[r, cut]
                score[r, cut] = got
                new[r, place[own]] = got
            if but is not None:
                score[rows, but] = -1.0
                at = np.asarray(but)
                own = picks == (at // size)[:, None]
                r, p = np.nonzero(own)
                new[r, p, at[r] % size] = -1.0
            both = np.concatenate([top, new.reshape(m, -1)], axis=1)
            top = -np.partition(-both, k - 1, axis=1)[:, :k]
            low, high = high, min(nb, 4 * high)
        self.asked += m * nb
        out, least = [], np.maximum(np.round(top.min(axis=1), 12), 0)
        for r in range(m):
            i = np.flatnonzero(score[r] >= least[r] - 1e-11)
            x = np.round(score[r, i], 12)
            i, x = i[x > 0], x[x > 0]
            first = np.lexsort((i, -x))[:k]
            out.append((i[first], x[first]))
        return out

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """The share of label 1, weighed by closeness; the base rate counts as one vote more."""
        return float((cosine @ self.labels[near] + PRIOR * self.rate) / (cosine.sum() + PRIOR))

    @property
    def rate(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.0


def calibration(votes: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Platt scaling: P(label 1) = logistic(a * logit(vote) + b), with a > 0."""
    x = np.log(np.clip(votes, 1e-3, 1 - 1e-3) / np.clip(1 - votes, 1e-3, 1 - 1e-3))
    x, w = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
    for _ in range(rounds if len(votes) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - labels) + 1e-3 * (w - [1.0, 0.0]))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def calibrated(vote: float, fit: tuple[float, float]) -> float:
    v = min(max(vote, 1e-3), 1 - 1e-3)
    return float(1 / (1 + np.exp(-(fit[0] * np.log(v / (1 - v)) + fit[1]))))


def chosen_rows(d: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """doc_id, toxic, row (a hash of the row) of the labelled rows that may be examples: at most ``labelled``, whatever repeats."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    few = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    found = d.select("doc_id", _row()).join(F.broadcast(few), "doc_id").distinct()
    return materialize(found.orderBy("row", "doc_id").limit(labelled), "toxic-chosen")


def _row() -> Column:
    return F.xxhash64("doc_id", "text").alias("row")


def examples_of(d: DataFrame, chosen: DataFrame, postings: int = POSTINGS) -> tuple[Examples, np.ndarray]:
    """The examples, in the order of their hashes while they hold at most ``postings`` words together, and all their words' numbers in order."""
    texts = d.select("doc_id", "text", _row()).join(F.broadcast(chosen), ["doc_id", "row"])
    words = _by_batch(texts, ("doc_id", "toxic", "row"), lambda x: x, pa.int64()).dropDuplicates(["doc_id", "row"])
    words = materialize(words, "toxic-words")
    sizes = sorted((r[0], r[1], r[2]) for r in words.select("row", "doc_id", F.size("terms")).collect())  # at most LABELLED
    held = int(np.searchsorted(np.cumsum([n for *_, n in sizes]), postings, "right"))
    last = sizes[held - 1][:2] if held else (None, None)
    kept = words.filter((F.col("row") < last[0]) | (F.col("row") == last[0]) & (F.col("doc_id") <= last[1])) if held else words.limit(0)
    t = kept.select("row", "doc_id", "toxic", "terms", "counts").toArrow().combine_chunks().sort_by([("row", "ascending"), ("doc_id", "ascending")])
    flat, counts = (np.concatenate([np.asarray(c.flatten()) for c in t[x].chunks] or [np.zeros(0, np.int64)]) for x in ("terms", "counts"))
    start = np.concatenate([[0], np.cumsum([len(x) for x in t["terms"]])]).astype(np.int64)
    terms, places = np.unique(flat, return_inverse=True)
    return Examples(t["doc_id"].to_numpy(), t["toxic"].to_numpy(), start, places.astype(np.int32), counts.astype(np.int32)), terms.astype(np.int64)


def _worker_index(key: str, make) -> BlockMaxIndex:
    """One index for each Python worker, kept between tasks: what travels are the examples."""
    kept = sys.modules.setdefault("_streamframe_toxic", types.ModuleType("_streamframe_toxic"))
    if kept.__dict__.get("key") != key:
        kept.key, kept.index = key, make()
    return kept.index


def score(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, k: int = K, postings: int = POSTINGS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence (doc_id, label and cosine of the nearest examples)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    examples, terms = examples_of(d, chosen_rows(d, labels, labelled), postings)
    seen = materialize(vectors(d, terms, ("doc_id",)), "toxic-vectors")
    n, df = seen.count(), document_frequencies(seen, len(terms))
    scale = np.log((1 + n) / (1 + df)) * examples.relevance(len(terms)) ** 2
    key = uuid.uuid4().hex
    index = BlockMaxIndex(examples, scale)
    fit = calibration(leave_one_out(docs.sparkSession, examples, scale, k, key), index.labels)
    rate = index.rate
    del index

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _worker_index(key, lambda: BlockMaxIndex(examples, scale))
        same: dict[tuple, tuple] = {}
        for b in batches:
            names = [(t.values.to_numpy().tobytes(), c.values.to_numpy().tobytes()) for t, c in zip(b.column(1), b.column(2))]
            if len(same) > 20_000:
                same.clear()
            new = [x for x in dict.fromkeys(names) if x not in same]
            for s in range(0, len(new), BATCH):
                part = new[s : s + BATCH]
                at = [np.frombuffer(t, np.int32) for t, _ in part]
                found = index.nearest([(t, weigh(t, np.frombuffer(c, np.int32), scale)) for t, (_, c) in zip(at, part)], k)
                for x, (near, cosine) in zip(part, found):
                    p = (calibrated(index.vote(near, cosine), fit) if len(near) else rate) if len(index.labels) else 0.0
                    same[x] = (p, [{"doc_id": i, "label": y, "cosine": v} for i, y, v in zip(index.ids[near].tolist(), index.labels[near].astype(int).tolist(), cosine.tolist())])
            got = [same[x] for x in names]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], kind)], ["doc_id", "score", "evidence"])

    out = seen.mapInArrow(vote, "doc_id long, score double, evidence array<struct<doc_id: long, label: int, cosine: double>>")
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def leave_one_out(spark: SparkSession, examples: Examples, scale: np.ndarray, k: int, key: str) -> np.ndarray:
    """Each example's vote by the others, in the index's order; as many votes as examples, made on the executors."""
    n = len(examples)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _worker_index(key, lambda: BlockMaxIndex(examples, scale))
        for b in batches:
            at = b.column(0).to_pylist()
            for s in range(0, len(at), BATCH):
                own = at[s : s + BATCH]
                got = [index.vote(*x) for x in index.nearest([index.vectors[i] for i in own], k, own)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(got, pa.float64())], ["id", "vote"])

    rows = spark.range(0, n, 1, max(1, -(-n // 512))).mapInArrow(votes, "id long, vote double").collect() if n else []
    return np.array([v for _, v in sorted((r[0], r[1]) for r in rows)])
