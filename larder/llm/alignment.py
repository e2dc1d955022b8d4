"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet over a whole corpus.

A is a byte-level BPE that reads a space and the text, B a piece model that adds the space itself. Both cut the same bytes; places
where a token of both ends cut them into groups, and every pair of tokens whose bytes overlap is a link.

1. A task takes texts in pieces of bounded bytes. Ids become Arrow lists, flattened with their parents' indices; bytes of
   all tokens are taken from the vocabulary and their lengths summed up, document by document. A full outer hash join of both
   sides' ends by (document, end), sorted and filled backward, is the list of links: between two neighbouring ends lies one token of
   each side, and each overlapping pair has one such stretch. Ends of both sides are the groups' ends.
2. Links are counted by pair within a block of pieces (``Table.group_by``). A block is a row: its documents' figures, its distinct pairs with
   counts, and its links as numbers of those pairs, compressed. Blocks are written, so texts are tokenised once.
3. Spark adds up the blocks' counts by pair. The best count of each B id (as many rows as B has ids, at most) is broadcast to
   the pairs. Each block asks for its distinct pairs by a join, one row a pair and block however often the pair occurs, and
   gets its answers by block; sums over a document's links follow.

Nothing grows with a frequent pair but numbers, and no table of links or pairs is held by one task or the driver.

Strings of special tokens within texts are ordinary text. Texts that are null, empty, or whose joined token bytes on either
side differ from a space and the text (a vocabulary that drops or changes characters) have no tokens: zeros, and an empty string for
the groups. Texts are taken whole; a text beyond a block's bytes is a block of its own. Rows of equal or null ids are answered
each, equal texts each count. An empty table gives an empty result. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.tokenizing import PROBES
from larder.llm.words import utf8
from larder.llm.workspace import Workspace

#: Bytes of text that are aligned at a time, and that a block holds.
PIECE_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20
#: Chunks that A's side remembers, and the longest of them in characters.
CACHE_CHUNKS, CACHE_LENGTH = 400_000, 64
#: Fixed value: white space as A's pre-tokenizer knows it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNKS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_LETTERS = re.compile("( ?)([A-Za-z]+)")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteSide(dict):
    """A: ids of a space and each text. Holds the ids of chunks that end where no token reaches over."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        # byte-level letters: printable Latin-1 stands for itself, other bytes for the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        entries = self.tokenizer.get_vocab()
        table = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            table[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.bytes = pa.array(table, pa.large_binary())
        self.space = next(c for c, b in letters.items() if b == 32)
        self.by_chunk = True
        whole = [self.tokenizer.encode(f" {t}", add_special_tokens=False).ids for t in PROBES]
        self.by_chunk = self.ids(list(PROBES)) == whole

    def __missing__(self, chunk: str) -> list[int]:
        if m := _LETTERS.fullmatch(chunk):  # one pre-token, for which the model is asked directly
            ids = [t.id for t in self.model.tokenize(m[1] and self.space + m[2] or m[2])]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        if len(chunk) <= CACHE_LENGTH:
            self[chunk] = ids
        return ids

    def ids(self, texts: list[str]) -> list[list[int]]:
        if not self.by_chunk:
            return [self.tokenizer.encode(f" {t}", add_special_tokens=False).ids for t in texts]
        if len(self) > CACHE_CHUNKS:
            self.clear()
        get = self.__getitem__
        return [list(chain.from_iterable(map(get, _CHUNKS.findall(f" {t}")))) for t in texts]


class PieceSide:
    """B: ids of each text by a piece model."""

    def __init__(self, file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        as_byte = lambda p: re.fullmatch("<0x([0-9A-F]{2})>", p)
        self.bytes = pa.array([bytes([int(m[1], 16)]) if (m := as_byte(p)) else p.replace("▁", " ").encode() for p in pieces], pa.large_binary())

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


class Aligner:
    def __init__(self, a_file: str, b_file: str):
        self.a, self.b = ByteSide(a_file), PieceSide(b_file)
        self.size = max(len(self.a.bytes), len(self.b.bytes))
        self.numerals = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(self.size)], pa.large_string())

    def _ends(self, lists: pa.Array, table: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Document, id and end (bytes from the document's start) of all tokens in order, and their bytes."""
        ids, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        tokens = table.take(ids)
        sums = np.concatenate(([0], pc.cumulative_sum(pc.binary_length(tokens)).to_numpy()))
        starts = lists.offsets.to_numpy()
        return of.astype(np.int64), ids.to_numpy(), sums[1:] - sums[starts[:-1]][of], tokens

    def _same_bytes(self, lists: pa.Array, table: pa.Array, texts: list[bytes]) -> np.ndarray:
        tokens = table.take(pc.list_flatten(lists))
        at, data = np.frombuffer(tokens.buffers()[1], dtype=np.int64)[lists.offsets.to_numpy()].tolist(), tokens.buffers()[2]
        return np.array([bool(t) and b - a == len(t) + 1 and data.slice(a, b - a).to_pybytes() == b" " + t for t, a, b in zip(texts, at, at[1:])], dtype=bool)

    def align(self, texts: list[bytes]) -> dict[str, np.ndarray | list[str]]:
        """n_a, n_b, n_groups, n_links, groups_sha256 of each text; a_id and b_id of all links in order."""
        given = [t.decode("utf-8", "replace") for t in texts]
        lists = [pa.array(side.ids(given), pa.list_(pa.int32())) for side in (self.a, self.b)]
        good = np.ones(len(texts), dtype=bool)
        for rows, side in zip(lists, (self.a, self.b)):
            good &= self._same_bytes(rows, side.bytes, texts)
        lists = [x.filter(pa.array(good)) for x in lists]
        n, names = int(good.sum()), ("a", "b")
        sides, counts = [], []
        for name, rows, side in zip(names, lists, (self.a, self.b)):
            of, ids, ends, _ = self._ends(rows, side.bytes)
            sides.append(pa.table({"key": (of << 40) | ends, f"{name}_id": ids}))
            counts.append(np.bincount(of, minlength=n))
        links = sides[0].join(sides[1], "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
        own = [links[f"{x}_id"].is_valid().to_numpy() for x in names]
        ids = [pc.fill_null_backward(links[f"{x}_id"]).to_numpy() for x in names]
        both, of = own[0] & own[1], links["key"].to_numpy() >> 40
        group = np.cumsum(both) - both
        figures = [*counts, np.bincount(of[both], minlength=n), np.bincount(of, minlength=n)]
        out = {k: np.zeros(len(texts), dtype=np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        for k, v in zip(out, figures):
            out[k][good] = v
        shas = iter(self._group_digests([group[x] for x in own], [x["a_id" if i == 0 else "b_id"].to_numpy() for i, x in enumerate(sides)], counts))
        return out | {"groups_sha256": [next(shas) if g else "" for g in good], "a_id": ids[0], "b_id": ids[1]}

    def _group_digests(self, groups: list[np.ndarray], ids: list[np.ndarray], counts: list[np.ndarray]) -> list[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2`` , digested. Marks follow the ids: , within a side, | after A, ; after B."""
        total = len(ids[0]) + len(ids[1])
        codes = np.zeros(total, dtype=np.int64)
        for side, mark, other in ((0, 1, "left"), (1, 2, "right")):
            mine, theirs = groups[side], groups[1 - side]
            last = np.append(mine[1:] != mine[:-1], True)[: len(mine)]
            codes[np.arange(len(mine)) + np.searchsorted(theirs, mine, other)] = ids[side] + self.size * np.where(last, mark, 0)
        written = self.numerals.take(pa.array(codes))
        ends = np.cumsum(counts[0] + counts[1])
        at = np.frombuffer(written.buffers()[1], dtype=np.int64)[np.concatenate(([0], ends))].tolist()
        data = memoryview(written.buffers()[2] or b"")
        return [hashlib.sha256(data[a : b - 1]).hexdigest() for a, b in zip(at, at[1:])]


@lru_cache(maxsize=2)
def aligner(a_file: str, b_file: str) -> Aligner:
    """One per Python worker and pair of vocabularies."""
    return Aligner(a_file, b_file)


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in _FIGURES], ("groups_sha256", pa.list_(pa.string())),
     ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("links", pa.binary())]
)


class _Block:
    """Documents gathered until a block is full."""

    def __init__(self) -> None:
        self.ids, self.parts, self.pairs, self.bytes = [], [], [], 0

    def add(self, ids: pa.Array, aligned: dict, size: int) -> None:
        self.ids.append(ids)
        self.pairs.append((aligned.pop("a_id").astype(np.int64) << 32) | aligned.pop("b_id"))
        self.parts.append(aligned)
        self.bytes += size

    def row(self, number: int) -> pa.RecordBatch:
        links = np.concatenate(self.pairs)
        counts = pa.table({"pair": links}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by([("count_all", "descending"), ("pair", "ascending")])
        pairs, times = counts["pair"].combine_chunks(), counts["count_all"].combine_chunks()
        # numbers by falling frequency, byte by byte: the high bytes are nearly all zero
        numbers = pc.index_in(pa.array(links), pairs).to_numpy(zero_copy_only=False).astype("<u4")
        packed = pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        figures = [one(pa.array(np.concatenate([p[c] for p in self.parts]))) for c in _FIGURES]
        shas = one(pa.array([s for p in self.parts for s in p["groups_sha256"]], pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(pa.concat_arrays(self.ids)), *figures, shas, one(pairs), one(times), pa.array([packed], pa.binary())], schema=_BLOCK)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel()


def _blocks(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Blocks of ``docs`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_by_side, block, number = aligner(a_file, b_file), _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, start = utf8(batch.column(1)), 0
            while start < len(texts):
                stop, size = start + 1, len(texts[start])
                while stop < len(texts) and size + len(texts[stop]) <= PIECE_BYTES:
                    size += len(texts[stop])
                    stop += 1
                if block.ids and block.bytes + size > BLOCK_BYTES:
                    yield block.row(number)
                    block, number = _Block(), number + 1
                block.add(batch.column(0).slice(start, stop - start), side_by_side.align(texts[start:stop]), size)
                start = stop
        if block.ids:
            yield block.row(number)

    kinds = f"block long, doc_id array<long>, {', '.join(f'{c} array<long>' for c in _FIGURES)}, groups_sha256 array<string>, pairs array<long>, times array<long>, links binary"
    return docs.mapInArrow(run, kinds)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a_id, b_id and how many links hold them, over all blocks; ``best`` where no other A id has more with the B id."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b_id", F.col("pair").bitwiseAND(2**32 - 1))
    top = counts.groupBy("b_id").agg(F.max("n").alias("top"))  # a row for each B id at most
    rated = counts.join(F.broadcast(top), "b_id")
    return rated.select("pair", F.shiftright("pair", 32).alias("a_id"), "b_id", "n", (F.col("n") == F.col("top")).alias("best"))


def align(
    docs: DataFrame, space: Workspace, a_file: str | None = None, b_file: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Figures of each document (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the counts of all id pairs
    (a_id, b_id, n, best)."""
    a_file, b_file = a_file or vocabulary("byte_bpe_50k.json"), b_file or vocabulary("piece_bpe_32k.model")
    named = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    blocks = space.write(_blocks(named, a_file, b_file), "blocks")
    counts = space.write(pair_counts(blocks), "pair-counts")
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts.select("pair", "n", "best"), "pair").select(F.col("block").alias("of"), "at", "n", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        order = right["at"].to_numpy()
        count, best = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        count[order], best[order] = right["n"].to_numpy(), right["best"].to_numpy()
        row = {c: left[c].combine_chunks().flatten() for c in ("doc_id", *_FIGURES, "groups_sha256")}
        ends = np.concatenate(([0], np.cumsum(row["n_links"].to_numpy())))
        numbers = _unpacked(left["links"][0].as_py(), int(ends[-1]))
        sums = [np.concatenate(([0], np.cumsum(x[numbers])))[ends] for x in (best, count)]
        return pa.table(row | {"n_best": np.diff(sums[0]), "count_sum": np.diff(sums[1])})

    kinds = f"doc_id long, {', '.join(f'{c} long' for c in _FIGURES)}, groups_sha256 string, n_best long, count_sum long"
    figures = blocks.drop("pairs", "times").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(finish, kinds)
    return figures.select("doc_id", *_FIGURES, "n_best", "count_sum", "groups_sha256"), counts.drop("pair")
