"""Token ids in binary files: canonical length-limited Huffman codes, decoded by table in independent blocks.

``write_token_file`` tokenizes whole texts, counts ids over all of them, and writes two Parquet data sets:

* ``codebook``: ``id``, ``code_length``. Codes are canonical, so lengths alone define them.
* ``blocks``: runs of documents in ascending ``doc_id`` order. A row holds the documents' ids, their token
  counts, the code bits (each document starts at a byte), and ``checkpoints``: the bit offset of every
  ``every``-th token of each document. ``shard`` and ``block`` give the order, ``shard_start`` the number of
  tokens of the shard before the block. A block needs nothing but the codebook to be decoded.

Nulls: a null text is empty; a null ``doc_id`` sorts first. Rows of equal ``doc_id`` stay apart, ordered by
token count and checksum. An empty table gives empty files. Other columns of the input aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.tokenizing import batches_by_bytes, default_vocabulary, encoder, sums_of_runs
from larder.llm.words import utf8
from larder.llm.workspace import Workspace, partitions_for

#: Longest code; longer only if the ids in use need it.
CODE_BITS = 16
#: Tokens between two checkpoints of a document.
EVERY = 128
#: A block is closed when it has this many tokens.
BLOCK_TOKENS = 1 << 17

BLOCKS = "shard int, block int, shard_start long, doc_ids array<long>, n_tokens array<long>, checkpoints array<long>, payload binary"


def code_lengths(counts: np.ndarray, limit: int = CODE_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids not in use.

    Weights rise within each list, so what a level selects of the single symbols is a prefix of them.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, current = [np.ones(len(leaves), dtype=bool)], leaves
    for _ in range(limit - 1):
        packages = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, packages))
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        current = both[by]
    taken, of_rank = 2 * (len(leaves) - 1), np.zeros(len(leaves), dtype=np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:taken].sum())
        of_rank[:n] += 1
        taken = 2 * (taken - n)
    lengths[order] = of_rank
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    code, last = 0, 0
    for i in order.tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits to look at, and the id and code length for each value of them."""
    bits = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    spans = 1 << (bits - lengths[order])
    ids, sizes = np.zeros(1 << bits, dtype=np.uint32), np.ones(1 << bits, dtype=np.int64)
    filled = int(spans.sum())
    ids[:filled] = np.repeat(order, spans)
    sizes[:filled] = np.repeat(lengths[order], spans)
    return bits, ids, sizes


def encode_bits(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bits of documents of ``counts`` ids, each from a byte on; each document's first byte; each token's bit."""
    size = lengths[ids]
    ends = np.cumsum(size)
    doc_bits = sums_of_runs(size, counts)
    doc_bytes = (doc_bits + 7) >> 3
    first_byte = np.cumsum(doc_bytes) - doc_bytes
    shift = first_byte * 8 - (np.cumsum(doc_bits) - doc_bits)
    at = ends - size + np.repeat(shift, counts)
    word, inside = at >> 5, at & 31
    value = codes[ids] << (64 - size - inside).astype(np.uint64)
    n = (int(doc_bytes.sum()) >> 2) + 3
    sums = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
    sums += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return sums.astype(np.uint64).astype(">u4").tobytes(), first_byte, at


def decode_bits(payload: bytes, starts: np.ndarray, counts: np.ndarray, table: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of all lanes, one after another. A lane begins at a checkpoint's bit; all lanes step together."""
    bits, ids_of, size_of = table
    raw = np.frombuffer(payload + bytes(8), dtype=np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    order = np.argsort(-counts, kind="stable")
    at, left = starts[order].copy(), counts[order]
    to = (np.cumsum(counts) - counts)[order]
    out = np.zeros(int(counts.sum()), dtype=np.uint32)
    mask, active = np.uint32((1 << bits) - 1), len(at)
    for step in range(int(left[0]) if len(left) else 0):
        while left[active - 1] <= step:
            active -= 1
        p = at[:active]
        seen = (window[p >> 3] >> (32 - bits - (p & 7)).astype(np.uint32)) & mask
        out[to[:active] + step] = ids_of[seen]
        p += size_of[seen]
    return out


def lanes(n_tokens: np.ndarray, every: int = EVERY) -> np.ndarray:
    """Token counts of the lanes of documents of ``n_tokens`` tokens: full ones, then the rest."""
    per_doc = -(-n_tokens // every)
    sizes = np.full(int(per_doc.sum()), every, dtype=np.int64)
    last = np.cumsum(per_doc)[per_doc > 0] - 1
    sizes[last] = (n_tokens - (per_doc - 1) * every)[per_doc > 0]
    return sizes


def token_table(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id and the ids of its text and ``end_id``, as little-endian 16-bit (or 32-bit) integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = encoder(vocabulary)
        kind = "<u2" if max(ask.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            texts = utf8(batch.column(1))
            for part in batches_by_bytes(texts):
                ids, counts = ask.encode([texts[i] for i in part])
                raw, ends = ids.astype(kind), np.cumsum(counts)
                tail = np.array([end_id], dtype=kind).tobytes()
                rows = [raw[e - n : e].tobytes() + tail for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(part)), pa.array(counts + 1), pa.array([raw.itemsize] * len(rows), pa.int32()), pa.array(rows, pa.binary())],
                    names=["doc_id", "n_tokens", "width", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, width int, ids binary")


def ids_of_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of ``token_table``, and the number of each row."""
    widths = batch.column("width").to_pylist()
    raw = b"".join(batch.column("ids").to_pylist())
    return np.frombuffer(raw, dtype=f"<u{widths[0]}" if widths else "<u2"), np.asarray(batch.column("n_tokens"))


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, n: how often each id occurs in the whole table. Each task adds up its rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            here = np.bincount(ids_of_rows(batch)[0])
            if len(here) > len(total):
                here, total = total, here
            total[: len(here)] += here
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return tokens.select("width", "n_tokens", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _encoded(tokens: DataFrame, lengths: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for whole in batches:
            sizes = whole.column("n_tokens").to_pylist()
            start = 0
            while start < len(sizes):
                stop, size = start, 0
                while stop < len(sizes) and (stop == start or size + sizes[stop] <= 1 << 20):
                    size += sizes[stop]
                    stop += 1
                batch = whole.slice(start, stop - start)
                start = stop
                ids, counts = ids_of_rows(batch)
                payload, first_byte, at = encode_bits(ids, counts, codes, lengths)
                ends = np.append(first_byte[1:], (int(at[-1]) + int(lengths[ids[-1]]) + 7) >> 3)
                per_doc = lanes(counts)
                token = np.cumsum(per_doc) - per_doc
                n_lanes = -(-counts // EVERY)
                marks = at[token] - np.repeat(first_byte * 8, n_lanes)
                wide = ids.astype("<u4")
                token_ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("n_tokens"),
                        pa.array([zlib.crc32(wide[e - n : e]) for e, n in zip(token_ends.tolist(), counts.tolist())], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_lanes))), pa.int32()), pa.array(marks)),
                        pa.array([payload[a:b] for a, b in zip(first_byte.tolist(), ends.tolist())], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "crc", "checkpoints", "payload"],
                )

    return tokens.mapInArrow(run, "doc_id long, n_tokens long, crc long, checkpoints array<long>, payload binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents of one partition to blocks."""
    shard, block, start = TaskContext.get().partitionId(), 0, 0
    names = ["shard", "block", "shard_start", "doc_ids", "n_tokens", "checkpoints", "payload"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    held: list[list] = [[], [], [], []]
    size = bits = 0

    def close() -> pa.RecordBatch:
        row = [shard, block, start, held[0], held[1], held[2], b"".join(held[3])]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "checkpoints", "payload")))
        for doc, n, marks, payload in rows:
            held[0].append(doc)
            held[1].append(n)
            held[2].extend(m + bits for m in marks)
            held[3].append(payload)
            size, bits = size + n, bits + 8 * len(payload)
            if size >= BLOCK_TOKENS:
                yield close()
                block, start = block + 1, start + size
                held, size, bits = [[], [], [], []], 0, 0
    if held[0]:
        yield close()


def write_token_file(docs: DataFrame, folder: str, space: Workspace, vocabulary: str | None = None, end_id: int = 1) -> None:
    """Write all ``documents`` (doc_id, text) as ``folder``/codebook and ``folder``/blocks.

    Only the counts of ids, bounded by the vocabulary, come to the driver.
    """
    spark = docs.sparkSession
    tokens = space.write(token_table(docs, vocabulary or default_vocabulary(), end_id), "tokens")
    found = id_counts(tokens).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, dtype=np.int64)
    counts[found["id"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    rows = list(zip(used.tolist(), lengths[used].tolist()))
    spark.createDataFrame(rows, "id long, code_length int").coalesce(1).write.parquet(f"{folder}/codebook")
    coded = space.write(_encoded(tokens, lengths), "coded")
    space.drop("tokens")
    key = ["doc_id", "n_tokens", "crc"]
    ordered = coded.repartitionByRange(partitions_for(spark), *key).sortWithinPartitions(*key)
    ordered.mapInArrow(_packed, BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    space.drop("coded")


def read_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """The file's documents: doc_id, start (tokens before it), n_tokens, ids (32-bit little-endian), ids_crc32."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, dtype=np.int64)
    lengths[book["id"].to_numpy(dtype=np.int64)] = book["code_length"].to_numpy(dtype=np.int64)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sizes = blocks.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each shard, as many as the writer had partitions
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                start, docs, counts, marks, payload = (batch.column(c)[i] for c in ("start", "doc_ids", "n_tokens", "checkpoints", "payload"))
                counts = np.asarray(counts.values)
                ids = decode_bits(payload.as_py(), np.asarray(marks.values), lanes(counts), table).astype("<u4", copy=False)
                ends = np.cumsum(counts)
                rows = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(start.as_py() + ends - counts), pa.array(counts), pa.array(rows, pa.binary()), pa.array([zlib.crc32(r) for r in rows], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    placed = blocks.join(F.broadcast(shards), "shard").select((F.col("shard_start") + F.col("before")).alias("start"), "doc_ids", "n_tokens", "checkpoints", "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
