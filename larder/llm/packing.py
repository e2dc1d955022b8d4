"""Best-fit decreasing packing of token pieces into sequences of a fixed capacity.

Which bin a piece gets depends on its length alone, and lengths are whole numbers up to the capacity. So the
plan is made from the histogram of lengths, at most ``capacity`` rows however many documents there are, with
a segment tree over remaining capacities that finds the tightest open bin in logarithmic time. Pieces then
look up their place by (length, rank among the pieces of that length); ranks are counted in salted groups, so
a length that most pieces share is spread over all tasks.

Only texts of more than ``capacity`` ids are cut, every ``capacity`` ids. Nulls: a null text is empty and
still has its end id; a null ``doc_id`` is kept. Repeated rows are packed one by one. An empty table gives no
sequences. Other columns of the input aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.tokenizing import batches_by_bytes, default_vocabulary, encoder
from larder.llm.words import utf8
from larder.llm.workspace import Workspace

CAPACITY = 4096
#: Groups that the pieces of one length are ranked in.
SALTS = 256


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text's ids and ``end_id``; ``ids`` (32-bit) if asked for."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = encoder(vocabulary)
        for batch in batches:
            texts, names = utf8(batch.column(1)), batch.column(0).to_pylist()
            for part in batches_by_bytes(texts):
                ids, counts = ask.encode([texts[i] for i in part])
                tail, end, rows = np.array([end_id], dtype="<u4").tobytes(), 0, []
                for name, n in zip(names[part.start : part.stop], counts.tolist()):
                    raw = ids[end : end + n].astype("<u4", copy=False).tobytes() + tail
                    end += n
                    for k in range(0, n + 1, capacity):
                        cut = raw[4 * k : 4 * (k + capacity)]
                        rows.append((name, k // capacity, k, len(cut) // 4, zlib.crc32(cut), cut if with_ids else None))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return pieces if with_ids else pieces.drop("ids")


class TightestBin:
    """Segment tree over remaining capacities 0 to ``capacity``: is there an open bin with as much left?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, left: int, bins: int) -> None:
        at = left + self.size
        while at:
            self.open[at] += bins
            at >>= 1

    def find(self, least: int) -> int:
        """The smallest remaining capacity of at least ``least`` that an open bin has; -1 if none has."""
        at = least + self.size
        while not self.open[at]:
            while at & 1:  # a right child: go up until there is a right sibling
                at >>= 1
            if not at:
                return -1
            at += 1
            if at & (at - 1) == 0:  # past the last leaf of this level
                return -1
        while at < self.size:
            at *= 2
            if not self.open[at]:
                at += 1
        return at - self.size


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing for ``histogram`` (length to count): rows (length, first rank, first bin, pieces in
    each bin, offset in the bin), and the number of bins. Equal pieces are placed a run of equal bins at a time,
    as placing them one by one would: a bin that takes one stays the tightest until the next doesn't fit."""
    tree, runs, rows, bins = TightestBin(capacity), {}, [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            runs.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length in sorted(histogram, reverse=True):
        rank, rest = 0, histogram[length]
        while rest:
            left = tree.find(length)
            if left < 0:
                each = capacity // length
                first, n = bins, -(-rest // each)
                bins += n
                left = capacity
            else:
                first, n = runs[left].pop()
                tree.add(left, -n)
                each = left // length
            full = min(n, rest // each)
            part = rest - full * each if full < n else 0
            rows.append((length, rank, first, each, capacity - left))
            rank += full * each + part
            rest -= full * each + part
            put(left - each * length, first, full)
            if part:
                put(left - part * length, first + full, 1)
            put(left, first + full + bool(part), n - full - bool(part))
    return rows, bins


def place(pieces: DataFrame, space: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a table; any columns, with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    columns = pieces.columns
    by = [c for c in ("doc_id", "piece", "ids_crc32") if c in columns]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    groups = space.write(groups, "groups")  # at most capacity x SALTS rows
    found = groups.groupBy("length").agg(F.sum("_n").alias("n")).limit(capacity + 1).toPandas()
    rows, _ = plan(dict(zip(found["length"].tolist(), found["n"].tolist())), capacity)
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    keys = table[:, 0] << 48 | table[:, 1]
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(*by)
    ranked = salted.withColumn("_rank", F.row_number().over(within)).join(starts, ["length", "_salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def find(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        size, r = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(keys, size << 48 | r, side="right") - 1
        _, first, bins, each, offset = table[at].T
        return pd.DataFrame({"sequence_id": bins + (r - first) // each, "offset": offset + (r - first) % each * size})

    placed = ranked.withColumn("_at", find("length", F.col("_before") + F.col("_rank") - 1))
    return placed.select(*columns, "_at.sequence_id", "_at.offset")


def pack(docs: DataFrame, space: Workspace, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(space.write(pieces_of(docs, capacity, vocabulary, end_id), "pieces"), space, capacity)


def sequences(docs: DataFrame, space: Workspace, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (32-bit little-endian), and the documents in them by offset.

    A sequence holds at most ``capacity`` pieces, so its group is bounded."""
    pieces = space.write(pieces_of(docs, capacity, vocabulary, end_id, with_ids=True), "pieces_with_ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    listed = F.transform("parts", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length")))
    grouped = place(pieces, space, capacity).groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", joined.alias("ids"), listed.alias("pieces"))
