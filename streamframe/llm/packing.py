"""Best-fit packing of token sequences with swap-based local search.

Documents become pieces of at most ``capacity`` tokens; full pieces are sequences of
their own. The rest is packed in salted groups of bounded size: best fit decreasing,
then a local search that takes the emptiest underfull bin and moves documents out of
it, exchanges one for one, one for two or two for one with other underfull bins
whenever that raises the squared fill, until the bin is empty or nothing helps. Bins
that stay far from full go, document by document, to the next level of a reduction
tree, where fewer groups of the same size pack them again. Where a level leaves more than
half of its pieces open, as long pieces do that no other fits beside, the next is the last.

Null and empty texts hold their end mark only; texts of any length are cut. Repeated rows
are packed each on its own; extra columns are ignored; an empty table has no sequences. Sequences are as full in each run; their
numbers depend on how the table of pieces is split.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .tokens import worker_tokenizer

CAPACITY = 2048
END = 0
#: Pieces that one task packs together, at every level.
GROUP_ROWS = 8192
#: From this share of the capacity a bin is left as it is before the last level.
CLOSED = 0.995
#: Bits of a sequence's number that its place in its group takes, and of the group's number.
BIN_BITS, GROUP_BITS = 24, 34
#: Exchanges that the local search tries for each piece of a group.
EFFORT = 50

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, in one pass: doc_id, piece, start, length, ids_crc32, and the ids on request."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end, step = worker_tokenizer(vocabulary), np.array([END], "<u4").tobytes(), 4 * capacity
        for b in batches:
            rows: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                ids = tokenizer.encode(text) + end
                for n, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append((key, n, at // 4, len(own) // 4, zlib.crc32(own), own))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 5 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds)], names[:n])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


class Bins:
    """Items (indices of ``size``) in bins of one capacity."""

    def __init__(self, size: list[int], capacity: int):
        self.size, self.capacity, self.items, self.room = size, capacity, [], []

    def best_fit(self) -> None:
        """Largest first, each into the fullest bin that takes it; a bit mask of the rooms finds that bin at once."""
        by_room: dict[int, list[int]] = {}
        mask = 0
        for i in sorted(range(len(self.size)), key=lambda i: (-self.size[i], i)):
            s = self.size[i]
            fits = mask >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                b = by_room[r].pop()
                if not by_room[r]:
                    mask &= ~(1 << r)
                self.items[b].append(i)
            else:
                b, r = len(self.items), self.capacity
                self.items.append([i])
                self.room.append(r)
            self.room[b] = r = r - s
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r

    def bound(self) -> int:
        return -(-sum(self.size) // self.capacity)

    def exchange(self, a: int, b: int) -> bool:
        """One change that fills ``a`` further out of the emptier ``b``: the largest gain of all moves, one for one, two for one and one for two.

        Only sizes matter, and a bin holds few different ones: at most as many as numbers from 1 up sum to the capacity.
        """
        size, room = self.size, self.room[a]
        mine, theirs = _by_size(self.items[a], size), _by_size(self.items[b], size)
        ours, others = sorted(mine), sorted(theirs)
        best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())

        def offer(sums: list[int], ways: dict[int, tuple[int, ...]] | None, back: int, given: tuple[int, ...]) -> None:
            nonlocal best
            at = bisect_right(sums, room + back) - 1
            if at >= 0 and sums[at] - back > best[0]:
                best = (sums[at] - back, ways[sums[at]] if ways else (sums[at],), given)

        offer(others, None, 0, ())
        for y in ours:
            offer(others, None, y, (y,))
        if best[0] < room:
            pairs = _pairs(theirs)
            sums = sorted(pairs)
            for y in ours:
                offer(sums, pairs, y, (y,))
        if best[0] < room:
            for back, given in _pairs(mine).items():
                offer(others, None, back, given)
        gain, out, back = best
        if not gain:
            return False
        moved, given = [theirs[x].pop() for x in out], [mine[y].pop() for y in back]
        self.items[a] = [i for i in self.items[a] if i not in given] + moved
        self.items[b] = [i for i in self.items[b] if i not in moved] + given
        self.room[a] -= gain
        self.room[b] += gain
        return True

    def search(self, tries: int = 0) -> None:
        """Empty the emptiest bins into the other underfull ones, while fewer bins are possible. The tries grow with the items."""
        tries = tries or EFFORT * len(self.size)
        least, open_bins = self.bound(), [b for b, r in enumerate(self.room) if r]
        open_bins.sort(key=lambda b: (-self.room[b], b))
        used = len(self.items)
        while used > least and len(open_bins) > 1 and tries > 0:
            source = open_bins.pop(0)
            for target in reversed(open_bins):  # the fullest first
                while self.items[source] and self.room[target] and tries > 0 and self.exchange(target, source):
                    tries -= 1
                tries -= 1
                if not self.items[source] or tries <= 0:
                    break
            if not self.items[source]:
                used -= 1
            open_bins = sorted((b for b in open_bins if self.room[b]), key=lambda b: (-self.room[b], b))

    def result(self) -> list[list[int]]:
        return [x for x in self.items if x]


def _by_size(items: list[int], size: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i in items:
        out.setdefault(size[i], []).append(i)
    return out


def _pairs(by_size: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """The sums of two items, each with the two sizes."""
    sizes = sorted(by_size)
    return {x + z: (x, z) for k, x in enumerate(sizes) for z in sizes[k:] if x != z or len(by_size[x]) > 1}


def pack_sizes(size: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    bins = Bins(size, capacity)
    bins.best_fit()
    bins.search()
    return bins.result()


def _pack_level(level: int, last: bool, capacity: int):
    def pack(key: tuple, t: pa.Table) -> pa.Table:
        if t.num_rows >= 1 << BIN_BITS:
            raise ValueError(f"a group of {t.num_rows} pieces: their numbers are not unique")
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "length", "ids_crc32", "uid")])
        size = t["length"].to_pylist()
        seq, off = np.full(len(size), -1, np.int64), np.zeros(len(size), np.int64)
        group = key[0].as_py()
        for n, members in enumerate(pack_sizes(size, capacity)):
            if not last and sum(size[i] for i in members) < CLOSED * capacity:
                continue
            at = 0
            for i in members:
                seq[i], off[i] = (level << BIN_BITS + GROUP_BITS) | (group << BIN_BITS) | n, at
                at += size[i]
        return t.drop_columns(["salt"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    return pack


def place(found: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to materialised pieces. Groups are dealt by a number that each row has, so rows that repeat fill none."""
    full = found.filter(F.col("length") == capacity)
    full = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    todo, done, level = found.filter(F.col("length") < capacity).withColumn("uid", F.monotonically_increasing_id()), full, 0
    rows, last = todo.count(), False
    while True:
        groups = max(1, -(-rows // group_rows))
        last = last or groups == 1
        salt = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups))
        out = todo.withColumn("salt", salt.cast("long")).groupBy("salt").applyInArrow(_pack_level(level, last, capacity), PIECES + ", uid long, sequence_id long, offset long")
        out = materialize(out, f"packed-{level}")
        done = done.unionByName(out.filter("sequence_id >= 0").drop("uid"))
        if last:
            return done
        todo = out.filter("sequence_id < 0").drop("sequence_id", "offset")
        left = todo.count()
        rows, last, level = left, 2 * left > rows, level + 1


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its place: the columns of PIECES, sequence_id, offset."""
    return place(materialize(pieces(docs, vocabulary, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The training sequences themselves: sequence_id, ids (packed 32-bit), and the documents' starts in order.

    Only here do token ids travel; a sequence has at most ``capacity`` of them.
    """
    whole = materialize(pieces(docs, vocabulary, capacity, with_ids=True), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = place(whole.drop("ids"), capacity)
    # rows that agree in all these columns hold the same ids, so any of them may take any of their places
    ids = whole.groupBy(*names).agg(F.first("ids").alias("ids"))
    on = [placed[c].eqNullSafe(ids[c]) for c in names]
    rows = placed.join(ids, on).select("sequence_id", F.struct("offset", placed["doc_id"], placed["piece"], "ids").alias("p"))
    s = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return s.select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"), F.expr("transform(p, x -> struct(x.doc_id, x.piece, x.offset))").alias("members"))
