"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Texts are cut into pieces by the vocabulary's pattern; each distinct piece is encoded once per worker.
Pieces that are new in a batch are encoded together with a pair occurrence index: every mergeable pair
maps to all its positions over all these pieces, the active ranks are applied in ascending order, and each
merge updates only the lists of the neighbours it touches.  Merges are listed in the order they were
learned, so a merge can only create pairs of higher rank and one ascending sweep is exact.

Defined results: a null and an empty text give an empty list; text that looks like a special token is
ordinary text; rows are neither dropped nor merged, so repeated rows give
repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The published splitting pattern, and the same for texts of ASCII only.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"""
)

#: Distinct pieces a worker remembers before it starts afresh.
MEMORY = 400_000


def default_vocabulary() -> str:
    """Path of the public vocabulary file that is installed with the tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Byte ids and ranked merges of a vocabulary file (``model.vocab`` and ``model.merges``)."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.bytes = np.zeros(256, dtype=np.int64)
        for letter, b in _byte_letters().items():
            self.bytes[b] = ids[letter]
        self.merge: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        self.parts: list[tuple[int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[ids[a], ids[b]] = rank
            self.made.append(ids[a + b])
            self.parts.append((ids[a], ids[b]))
        keys = np.array([a << 20 | b for a, b in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.fromiter(self.merge.values(), np.int64)[order]

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair does not merge."""
        want = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.key_rank[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens per piece, all tokens), all pieces merged in one ascending sweep over the active ranks."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        n = len(raw)
        last = np.cumsum(lengths[lengths > 0]) - 1
        follow = np.arange(1, n + 1)
        follow[last] = -1
        before = np.arange(-1, n - 1)
        before[last[:-1] + 1] = -1
        # The index: rank of a pair -> all its positions.
        inner = np.nonzero(follow >= 0)[0]
        rank = self.ranks_of(raw[inner], raw[inner + 1])
        inner, rank = inner[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        inner, rank = inner[order], rank[order]
        firsts = np.nonzero(np.diff(rank, prepend=-1))[0]
        where = dict(zip(rank[firsts].tolist(), (x.tolist() for x in np.split(inner, firsts[1:])))) if len(rank) else {}
        sym, nxt, prev = raw.tolist(), follow.tolist(), before.tolist()
        merge, made, parts = self.merge.get, self.made, self.parts
        active = sorted(where)
        while active:
            rank = heapq.heappop(active)
            token = made[rank]
            a, b = parts[rank]
            spots = where.pop(rank)
            spots.sort()
            for i in spots:
                j = nxt[i]
                if j < 0 or sym[i] != a or sym[j] != b:
                    continue  # an earlier merge used one side
                k = nxt[j]
                sym[i], sym[j], nxt[i] = token, -1, k
                if k >= 0:
                    prev[k] = i
                    r = merge((token, sym[k]))
                    if r is not None:
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heapq.heappush(active, r)
                h = prev[i]
                if h >= 0:
                    r = merge((sym[h], token))
                    if r is not None:
                        if r in where:
                            where[r].append(h)
                        else:
                            where[r] = [h]
                            heapq.heappush(active, r)
        done = np.array(sym, dtype=np.int32)
        alive = done >= 0
        upto = np.concatenate([[0], np.cumsum(alive)])
        ends = np.cumsum(lengths)
        return upto[ends] - upto[ends - lengths], done[alive]


class Encoder:
    """Encodes batches of texts; remembers the pieces it has met."""

    _kept: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this worker process; pieces met in earlier tasks need no second encoding."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary.of(path)
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(itertools.count().__next__)
        self.flat = np.zeros(0, dtype=np.int32)
        self.sizes = np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, as in an Arrow list array."""
        if len(self.number) > MEMORY:
            self.forget()
        numbers, counts = [], []
        look = self.number.__getitem__
        for text in texts:
            found = (self.split_ascii(text) if text.isascii() else self.split(text)) if text else ()
            counts.append(len(found))
            numbers.extend(map(look, found))
        known = len(self.sizes)
        if len(self.number) > known:
            fresh = [p.encode("utf-8", "replace") for p in itertools.islice(self.number, known, None)]
            sizes, ids = self.vocabulary.encode_pieces(fresh)
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, ids])
        begins = np.concatenate([[0], np.cumsum(self.sizes)])
        which = np.array(numbers, dtype=np.int64)
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(begins[which], sizes)
        piece_ends = np.concatenate([[0], ends])
        return piece_ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])], self.flat[at]


def encode_corpus(documents: DataFrame, vocabulary: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row, in the input's partitions: no shuffle."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                offsets, ids = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id, "ids"])

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(f"`{id}`", f"`{text}`").mapInArrow(run, f"`{id}` {kind}, ids array<int>")
