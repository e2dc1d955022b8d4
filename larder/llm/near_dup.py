"""Near duplicates by one-permutation MinHash, banded buckets and star-shaped candidates.

1. Each text's set of word shingles is hashed once; one permutation fills ``bands * rows`` bins, empty bins take
   over a bin chosen by a fixed hash sequence (optimal densification), and each band of bins makes a bucket key.
2. Texts with the same set (all its shingles in order, by a 128-bit digest) are one class, so copies never meet one
   another in buckets. The class is the node that links join; rows get their component by it.
3. In a bucket every member is paired with the bucket's smallest member alone (a star). All pairs are confirmed
   on the full sets. A star may part two texts whose centre is like neither; so buckets whose other members
   still are in several components are settled exactly: their members are dealt to blocks, bounded in members and
   shingles, one large component to blocks of its own, and blocks meet unless both hold the same component alone. Only
   links that join two components come out. No bucket, member or pair is dropped.
4. Links make components, whose smallest document stays.

Keys that very many rows share (buckets, centres, classes, hubs) are found first and dealt to salted parts. Two sets at
similarity 0.8 share no band with a chance of about 2e-6 for the default 56 bands of 7 bins.

Words are runs of characters other than space and 9 to 13, with A-Z lower-cased; a text of fewer words than a
shingle is one shingle; a text without words (or null) has an empty set and is linked with nothing. Very long texts
are taken whole. Rows with a null ``doc_id`` can't be named and are linked with nothing (component null, kept). Rows of
equal ``doc_id`` are judged each by its own text. Empty tables give empty results; other columns, whatever their names,
pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.components import components
from larder.llm.skew import SHARE, lookup
from larder.llm.tokenizing import batches_by_bytes
from larder.llm.words import mixed, utf8, words_by_text
from larder.llm.workspace import Workspace, partitions_for

BANDS, ROWS = 56, 7
#: Shingles and members that a block of a bucket holds at most (one longer text is a block of its own).
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 20, 512
#: One row in so many is looked at to find buckets that are dealt to parts; the buckets themselves take all rows.
LOOK_AT = 32
#: Donor bins that are tried in turn for an empty bin; beyond, the next filled bin around the circle.
ATTEMPTS = 256


def shingle_sets(docs: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    hashes, counts = words_by_text(docs, fold=True)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - words + 1)
        rolled = np.full(n, np.uint64(words), dtype=np.uint64)
        for k in range(words):
            rolled = mixed(rolled + hashes[k : k + n])
    out = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        if count >= words:
            out.append(np.unique(rolled[end - count : end - words + 1]))
        else:
            one = np.array([count], dtype=np.uint64)
            with np.errstate(over="ignore"):
                for h in hashes[end - count : end]:
                    one = mixed(one + h)
            out.append(one[: bool(count)])
    return out


class OnePermutation:
    """Signatures of sets, many at a time."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        tries = np.arange(1, ATTEMPTS + 1, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(self.bins, dtype=np.uint64)[None, :]
        self.donors = (mixed(tries) % np.uint64(self.bins)).astype(np.int64)

    def band_keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of ``bands`` bucket keys for each non-empty set."""
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        cell = of * self.bins + (((values >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(cell, prepend=-1))  # sets are sorted: the first of a bin is its minimum
        signature, filled = np.zeros(len(sets) * self.bins, dtype=np.uint64), np.zeros(len(sets) * self.bins, dtype=bool)
        signature[cell[first]], filled[cell[first]] = values[first], True
        empty = np.flatnonzero(~filled)
        base, bin_of = empty - empty % self.bins, empty % self.bins
        for attempt in range(ATTEMPTS):
            if not len(empty):
                break
            donor = base + self.donors[attempt][bin_of]
            found = filled[donor]
            signature[empty[found]] = signature[donor[found]]
            empty, base, bin_of = empty[~found], base[~found], bin_of[~found]
        for i in empty.tolist():
            row = i - i % self.bins
            around = np.flatnonzero(filled[row : row + self.bins])
            signature[i] = signature[row + around[np.searchsorted(around, i % self.bins) % len(around)]]
        grid = signature.reshape(len(sets), self.bands, self.rows)
        with np.errstate(over="ignore"):
            keys = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), grid.shape[:2])
            for r in range(self.rows):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, r])
        return keys.view(np.int64)


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary())


def _features(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, the digest of the set, and the bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = OnePermutation(bands, rows)
        for batch in batches:
            texts = utf8(batch.column(1))
            for part in batches_by_bytes(texts, 4 << 20):
                sets = shingle_sets([texts[i] for i in part], words)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                some, keys = np.flatnonzero(sizes), []
                for i in range(0, len(some), 256):
                    keys.append(hasher.band_keys([sets[k] for k in some[i : i + 256]]).ravel())
                at = np.concatenate(([0], np.cumsum((sizes > 0) * bands)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, len(part)),
                        pa.array(sizes),
                        _digests(sets),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "print", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, print binary, keys array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, the digest of its set, and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for part in batches_by_bytes(texts, 4 << 20):
                sets = shingle_sets([texts[i] for i in part], words)
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(part)), _digests(sets), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))],
                    names=["doc_id", "print", "shingles"],
                )

    return docs.mapInArrow(run, "doc_id long, print binary, shingles array<long>")


def _classes(features: DataFrame, space: Workspace) -> DataFrame:
    """One row for each distinct set: print, node, doc (its smallest id), n, keys.

    Nodes are numbered apart from ids, which may be any."""
    named = features.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("print").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    return space.write(classes.select("print", F.monotonically_increasing_id().alias("node"), "doc", "n", "keys"), "nodes")  # written, so that numbers stand


def _buckets(nodes: DataFrame, space: Workspace) -> DataFrame:
    """key, doc, n, and the bucket's smallest member (center, m) of all buckets of two members or more."""
    rows = nodes.select(F.col("node").alias("doc"), "n", F.explode("keys").alias("key"))
    seen = rows.filter(F.pmod(F.xxhash64("doc"), F.lit(LOOK_AT)) == 0)
    n_seen, share = seen.count(), SHARE * partitions_for(space.spark)
    large = seen.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) & (F.col("_n") * share > n_seen)).select("key")
    large = space.write(large, "large-buckets")  # at most ``share`` rows
    bucket = Window.partitionBy("key")
    head = F.min(F.struct("doc", "n"))
    small = rows.join(F.broadcast(large), "key", "left_anti").withColumn("head", head.over(bucket)).withColumn("last", F.max("doc").over(bucket))
    dealt = rows.join(F.broadcast(large), "key", "left_semi")
    heads = dealt.groupBy("key").agg(head.alias("head"), F.max("doc").alias("last"))
    members = small.unionByName(dealt.join(F.broadcast(heads), "key").select(small.columns))
    live = members.filter(F.col("head.doc") < F.col("last"))
    return space.write(live.select("key", "doc", "n", F.col("head.doc").alias("center"), F.col("head.n").alias("m")), "buckets")


def _alike(pairs: DataFrame, sets: DataFrame, percent: int, space: Workspace) -> DataFrame:
    """The (center, doc) pairs whose full sets reach the similarity."""
    member = sets.select(F.col("node").alias("doc"), F.col("shingles").alias("s"))
    center = sets.select(F.col("node").alias("center"), F.col("shingles").alias("t"))
    both = lookup(space.write(pairs, "pairs"), center, "center", "doc").join(member, "doc")
    shared = F.size(F.array_intersect("s", "t"))
    return both.filter(100 * shared >= percent * (F.size("s") + F.size("t") - shared)).select("center", "doc")


def _links_between(component: np.ndarray, sets: list[np.ndarray], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Positions of alike sets that join different components; ``left`` marks the first block, if there are two.

    Shingles that occur twice or more are counted in slices of a 0/1 matrix, so that memory is bounded."""
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.float64)
    values, of = np.concatenate(sets), np.repeat(np.arange(n), sizes.astype(np.int64))
    _, column, often = np.unique(values, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    column, of = (np.cumsum(often > 1) - 1)[column[shared]], of[shared]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    common, width = np.zeros((n, n)), 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        grid = np.zeros((n, width), dtype=np.float32)
        grid[of[a:b], column[a:b] - start] = 1
        common += grid @ grid.T
    alike = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    alike &= component[:, None] != component[None, :]
    if not left.all():
        alike &= left[:, None] & ~left[None, :]
    root = {int(c): int(c) for c in component}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    links = []
    for i, j in np.argwhere(alike).tolist():
        x, y = find(int(component[i])), find(int(component[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((i, j))
    return links


def _blocks(rest: DataFrame) -> DataFrame:
    """``rest`` (key, doc, n, component) with its block. A component that fills a block has blocks of its own."""
    weight = F.col("n") + BLOCK_SHINGLES // BLOCK_MEMBERS
    sizes = rest.groupBy("key", "component").agg(F.sum(weight).alias("_w"))
    small = F.sum(F.when(F.col("_w") < BLOCK_SHINGLES, F.col("_w")))
    sums = sizes.groupBy("key").agg(F.ceil(2 * F.coalesce(small, F.lit(0)) / BLOCK_SHINGLES).alias("_small"))
    parts = sizes.join(sums, "key").select("key", "component", F.when(F.col("_w") >= BLOCK_SHINGLES, F.ceil(F.col("_w") / BLOCK_SHINGLES)).alias("_own"), "_small")
    own = F.xxhash64("component", F.pmod(F.xxhash64("doc"), F.col("_own")))
    shared = F.pmod(F.xxhash64("component"), F.greatest("_small", F.lit(1)))
    return rest.join(parts, ["key", "component"]).withColumn("block", F.when(F.col("_own").isNotNull(), own).otherwise(shared)).drop("_own", "_small")


def _settled(rest: DataFrame, sets: DataFrame, percent: int, space: Workspace) -> DataFrame:
    """Links (a, b) between different components within the buckets of ``rest`` (key, doc, n, component)."""
    rows = space.write(_blocks(rest), "blocks")
    blocks = rows.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    left, right = (blocks.select("key", F.col("block").alias(x), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high")) for x in "ij")
    alone = (F.col("i_low") == F.col("i_high")) & (F.col("j_low") == F.col("j_high")) & (F.col("i_low") == F.col("j_low"))
    meet = left.join(right, "key").filter(F.col("i") <= F.col("j")).filter(~alone)
    sides = meet.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    filled = rows.join(sides, ["key", "block"]).select("key", "i", "j", "block", "doc", "component").join(sets, F.col("doc") == F.col("node")).drop("node")

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["doc"].to_numpy()
        left = (group["block"] == group["i"]).to_numpy()
        found = _links_between(group["component"].to_numpy(), list(group["shingles"]), left, percent)
        return pd.DataFrame({"a": [ids[i] for i, _ in found], "b": [ids[j] for _, j in found]}, dtype="int64")

    return filled.groupBy("key", "i", "j").applyInPandas(settle, "a long, b long")


def _grouped(docs: DataFrame, space: Workspace, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, print, component_id of every row of ``docs`` (doc_id, text)."""
    features = space.write(_features(docs, words, bands, rows), "features")
    nodes = _classes(features, space)
    live = _buckets(nodes, space)
    wanted = nodes.join(live.select(F.col("doc").alias("node")).distinct(), "node", "left_semi").select("print", "node", "doc")
    ids = wanted.select(F.col("doc").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    sets = _sets(texts, words).select("print", "shingles").dropDuplicates(["print"]).join(wanted.select("print", "node"), "print").select("node", "shingles")
    sets = space.write(sets, "sets")

    # a star in each bucket: its smallest member meets all others
    fits = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("center") < F.col("doc"))
    pairs = live.filter(fits).select("center", "doc").distinct()
    links = space.write(_alike(pairs, sets, percent, space).select(F.col("center").alias("a"), F.col("doc").alias("b")), "star-links")
    labels = None if links.isEmpty() else components(links, space, "stars")

    # buckets that still hold several components are settled on full sets, in blocks of bounded size
    rest = live.filter("doc <> center").select("key", "doc", "n")
    if labels is not None:
        rest = rest.join(labels, F.col("doc") == F.col("node"), "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("component"))
    else:
        rest = rest.withColumn("component", F.col("doc"))
    open_buckets = rest.groupBy("key").agg(
        F.min("component").alias("_least"), F.max("component").alias("_most"), F.count(F.lit(1)).alias("_n"), F.sum(F.shiftright(F.xxhash64("doc"), 16)).alias("_sum"), F.bit_xor(F.xxhash64("doc")).alias("_xor")
    )
    # many bands make the same bucket; one of them is enough
    open_buckets = open_buckets.filter("_least < _most").groupBy("_n", "_sum", "_xor").agg(F.min("key").alias("key"))
    rest = space.write(rest.join(open_buckets.select("key"), "key", "left_semi"), "open")
    if not rest.isEmpty():
        more = space.write(_settled(rest, sets, percent, space), "settled-links")
        if not more.isEmpty():
            labels = components(links.unionByName(more), space, "all")

    # classes get their component, named by its smallest id, and rows by their class
    if labels is None:
        component = nodes.select("print", F.col("doc").alias("component"))
    else:
        component = nodes.select("print", "node", "doc").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        component = space.write(component, "named")
        least = component.groupBy("component").agg(F.min("doc").alias("least"))
        component = lookup(component, least, "component", "print").select("print", F.col("least").alias("component"))
    component = space.write(component.select("print", F.col("component").alias("component_id")), "components")
    for name in ("nodes", "named", "buckets", "sets", "pairs", "open", "blocks"):  # large, and read by nothing from here on
        space.drop(name)
    named = features.filter("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "n_shingles", "print")
    linked = lookup(named, component, "print", "doc_id").select("doc_id", "n_shingles", "print", "component_id")
    alone = features.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", "print", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def find_near_duplicates(
    docs: DataFrame, space: Workspace, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    found = _grouped(docs, space, words, percent, bands, rows)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, space: Workspace, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    found = _grouped(docs.select("doc_id", "text"), space, words, percent, bands, rows)
    own = F.col("doc_id") == F.col("component_id")
    ids = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_if(own).alias("stay"), F.count_if(~own).alias("go"))
    gone = space.write(ids.filter("go > 0"), "gone")
    kept = docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    if gone.filter("stay > 0").isEmpty():
        return kept
    # an id whose texts differ, some of which stay: told apart by their sets
    staying = found.filter(own).join(gone.filter("stay > 0").select("doc_id"), "doc_id", "left_semi").select("doc_id", "print").distinct()
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = whole.join(gone.filter("stay > 0").select("doc_id"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, prints = utf8(batch.column(1)), []
            for part in batches_by_bytes(texts, 4 << 20):
                prints += _digests(shingle_sets([texts[i] for i in part], words)).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), batch.column(2)], names=["doc_id", "print", "row"])

    told = rows.mapInArrow(run, f"doc_id long, print binary, row {whole.schema['row'].dataType.simpleString()}")
    return kept.unionByName(told.join(staying, ["doc_id", "print"], "left_semi").select("row.*"))
