"""Token ids of whole texts by the ``tokenizers`` library, a batch of texts at a time.

The library is asked once per distinct chunk between ASCII white space: with a vocabulary that drops white
space, no pre-token reaches over it, so a text's ids are those of its chunks, one after another. Chunks are found
by 64-bit hashes and compared by their bytes with the chunk that is remembered; ids of known chunks are gathered with
numpy. A vocabulary that doesn't work that way, as tried on ``PROBES``, is asked for whole texts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from larder.llm.words import SEGMENT_BYTES, Segment, word_segments

#: Letters, then ASCII punctuation to the end: two pre-tokens.
WORD_AND_TAIL = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")
#: Distinct chunks that one Python worker remembers; it starts anew beyond that.
CACHE_CHUNKS = 500_000
#: Texts whose ids must be the same by chunks and whole: case, marks, digits, accents, control strings, white space.
PROBES = (
    "The CAT sat, on; the mat. It's 12.5 -- (ok)?  Two  spaces\tand\nlines", "\u00c9t\u00e9 \u00c0 l'\u00e9cole stra\u00dfe \u0130stanbul na\u0131ve",
    "<|endoftext|> x<|endoftext|>y </s> <s>", "\u65e5\u672c\u8a9e \u03a3\u0391\u03a3 H\u0331 e\u0301", " lead and trail ", "UPPERCASEWORD lowerCamelCase snake_case http://a.b/c?d=e#f",
)
#: A byte from here on may belong to a combining mark (U+0300 and up), before which letter case counts.
COMBINING = 0xCC


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Texts to ids. The ids of all known chunks lie in one array; a chunk's hash leads to its place there."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_letters = {ord(c): to_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xAA, 0x130)) if c.isalpha()}
        self.forget()
        self.by_chunk = True
        whole = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in PROBES]
        ids, counts = self.encode([t.encode() for t in PROBES])
        self.by_chunk = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == whole
        self.forget()

    def forget(self) -> None:
        self.chunks: list[bytes] = []
        self.tails: dict[str, list[int]] = {}
        self.place: dict[int, int] = {}
        self.at = np.zeros(1 << 16, dtype=np.int64)
        self.count = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def chunk_ids(self, chunk: str) -> list[int]:
        """A word of simple letters is one pre-token, for which the model is asked directly; punctuation
        after it is a pre-token of its own. All other chunks go through the whole tokenizer."""
        if chunk.isalpha() and max(chunk) < "İ":
            plain = chunk.lower()
            return [t.id for t in self.model.tokenize(plain if plain.isascii() else plain.translate(self.byte_letters))]
        if (parts := WORD_AND_TAIL.fullmatch(chunk)) and max(parts[1]) < "İ":
            return self.chunk_ids(parts[1]) + self.tail_ids(parts[2])
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def tail_ids(self, tail: str) -> list[int]:
        if (ids := self.tails.get(tail)) is None:
            ids = self.tokenizer.encode(tail, add_special_tokens=False).ids
            if len(self.tails) < 10_000:
                self.tails[tail] = ids
        return ids

    def _learn(self, hashes: list[int], chunks: list[bytes]) -> None:
        for h, chunk in zip(hashes, chunks):
            ids, k = self.chunk_ids(chunk.decode("utf-8", "replace")), len(self.place)
            if k == len(self.at):
                self.at, self.count = np.resize(self.at, 2 * k), np.resize(self.count, 2 * k)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.place[h], self.at[k], self.count[k] = k, self.used, len(ids)
            self.chunks.append(chunk)
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def _segment_ids(self, s: Segment, fold: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a segment, and how many each of its texts has."""
        if len(self.place) > CACHE_CHUNKS:
            self.forget()
        distinct, first, inverse = np.unique(s.hashes, return_index=True, return_inverse=True)
        keys, sizes = distinct.tolist(), s.ends - s.starts
        chunks = [s.data[a:b] for a, b in zip(s.starts[first].tolist(), s.ends[first].tolist())]
        if fold:
            chunks = [c.lower() for c in chunks]
        get = self.place.get
        places = np.array([get(h, -1) for h in keys], dtype=np.int64)
        if len(missing := np.flatnonzero(places < 0)):
            places[missing] = np.arange(len(self.place), len(self.place) + len(missing))
            self._learn([keys[i] for i in missing.tolist()], [chunks[i] for i in missing.tolist()])
        known = self.chunks
        if any(known[k] != c for k, c in zip(places.tolist(), chunks)) or (sizes != sizes[first][inverse]).any():
            return self._ids_one_by_one(s)  # two chunks of one hash
        places = places[inverse]
        return ragged(self.ids, self.at[places], n := self.count[places]), sums_of_runs(n, s.counts)

    def _ids_one_by_one(self, s: Segment) -> tuple[np.ndarray, np.ndarray]:
        each = [self.chunk_ids(s.data[a:b].decode("utf-8", "replace")) for a, b in zip(s.starts.tolist(), s.ends.tolist())]
        n = np.array([len(x) for x in each], dtype=np.int64)
        return np.array([i for x in each for i in x], dtype=np.uint32), sums_of_runs(n, s.counts)

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in order (unsigned 32 bits), and the number of ids of each text."""
        parts, counts = [], np.zeros(len(docs), dtype=np.int64)
        if not self.by_chunk:
            for i, d in enumerate(docs):
                parts.append(np.array(self.tokenizer.encode(d.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=np.uint32))
                counts[i] = len(parts[-1])
            return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32), counts
        for kept_case, run in runs_of(docs, lambda d: b"<|" in d or np.frombuffer(d, dtype=np.uint8).max(initial=0) >= COMBINING):
            base = run[0]
            for s in word_segments([docs[i] for i in run], fold=not kept_case, marks_apart=True):
                if kept_case and len(s.data) and b"<|" in s.data:  # added tokens are looked for in the raw text
                    s.hashes = s.hashes ^ np.uint64(0x5851F42D4C957F2D)
                ids, n = self._segment_ids(s, fold=not kept_case)
                parts.append(ids)
                counts[base + s.first : base + s.first + len(n)] += n
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32), counts


def runs_of(items: list, key) -> list[tuple[bool, range]]:
    """Neighbouring items of equal key, as ranges of positions."""
    out, start = [], 0
    keys = [key(x) for x in items]
    for i in range(1, len(items) + 1):
        if i == len(items) or keys[i] != keys[start]:
            out.append((keys[start], range(start, i)))
            start = i
    return out


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[start : start + count] of all pairs, one after another."""
    total = int(counts.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(counts)
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


def sums_of_runs(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(lengths)
    return sums[ends] - sums[ends - lengths]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary; it stays for later tasks of that worker."""
    return ChunkEncoder(vocabulary)


def batches_by_bytes(docs: list[bytes], limit: int = 8 * SEGMENT_BYTES) -> list[range]:
    """Ranges of texts of at most ``limit`` bytes together, or of one longer text."""
    out, start, size = [], 0, 0
    for i, d in enumerate(docs):
        if size and size + len(d) > limit:
            out.append(range(start, i))
            start, size = i, 0
        size += len(d) + 1
    return [*out, range(start, len(docs))] if start < len(docs) else out
