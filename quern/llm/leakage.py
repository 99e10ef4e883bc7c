"""Evaluation texts leaking into training text.

The test items form a sparse BM25 inverted index with block maxima.  Every training text is cut into overlapping
passages and every passage queries the index by block-max WAND, evaluated for many passages at once: terms whose
greatest weights cannot add up to any threshold are no reason to look at a block (the pivot); blocks met through
the other terms are bounded by their maxima; in the blocks that stay, items are scored in full.  An item's
threshold is the least score that any run of ``needle`` of its consecutive words can have, and passages overlap by
``needle - 1`` words, so retrieval loses nothing.  Only retrieved (passage, item) pairs are looked at again, word
by word.

The index takes memory in proportion to the words of the items.  It travels as a broadcast of at most
``INDEX_BYTES`` (items are dealt to as many indexes as that takes); up to some ten thousand items that is one index
and one pass over the corpus.

Defined results: a null, empty or blank text holds nothing, such an item is held by nothing; items shorter
than ``needle`` words must be held whole; repeated rows of documents or items count once; other columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import normal_words

#: Consecutive words that make a leak; words of a passage; items per block; bytes of an index that is broadcast.
NEEDLE, PASSAGE, BLOCK, INDEX_BYTES = 12, 40, 32, 128 << 20
#: Bytes an index takes per character of its items, with a margin (measured: about 6).
BYTES_PER_CHARACTER = 24
K1, B = 1.2, 0.75
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _expand(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [start, stop): the number of its range for each position, and the position."""
    size = np.maximum(stop - start, 0)
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of]


def _run_hashes(code: np.ndarray, m: int, salt: np.ndarray) -> np.ndarray:
    """A hash of each run of ``m`` words."""
    h = np.zeros(max(0, len(code) - m + 1), dtype=np.uint64)
    table = salt[code]
    for k in range(m if len(h) else 0):
        h = h * MULTIPLIER + table[k : k + len(h)]
    return h


class ItemIndex:
    """BM25 postings of a bounded set of items, with block maxima and a threshold per item."""

    def __init__(self, items: list[tuple[int, str]], needle: int = NEEDLE) -> None:
        kept = [(i, w) for i, t in items if t for w in [normal_words(t)] if w]
        self.needle = needle
        self.vocabulary: dict[str, int] = {}
        rows = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], dtype=np.int64) for _, w in kept]
        n, terms = len(rows), len(self.vocabulary)
        self.ids: list[int] = []
        if not n:
            return
        bags = [np.unique(r, return_counts=True) for r in rows]
        df = np.bincount(np.concatenate([t for t, _ in bags]), minlength=terms)
        # Terms are numbered by falling document frequency, which is about the order of their greatest weights.
        rank = np.empty(terms, dtype=np.int64)
        rank[np.argsort(-df, kind="stable")] = np.arange(terms)
        self.vocabulary = {w: int(rank[k]) for w, k in self.vocabulary.items()}
        rows = [rank[r] for r in rows]
        bags = [np.unique(r, return_counts=True) for r in rows]
        df = np.sort(df)[::-1]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = np.mean([len(r) for r in rows])
        weights = [idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(r) / mean)) for r, (t, f) in zip(rows, bags)]
        least = np.array([self._least(r, t, w, needle) for r, (t, _), w in zip(rows, bags, weights)])
        # Items of like thresholds share blocks, so that block maxima stay close to their members.
        order = np.argsort(least, kind="stable")
        self.ids = [kept[k][0] for k in order]
        self.words = [rows[k] for k in order]
        self.least = least[order] * (1 - 1e-6)
        item = np.repeat(np.arange(n), [len(bags[k][0]) for k in order])
        term = np.concatenate([bags[k][0] for k in order])
        weight = np.concatenate([weights[k] for k in order])
        # Postings sorted by (term, item): those of a term in a block lie together.
        key = term * n + item
        at = np.argsort(key)
        self.key, self.weight = key[at], weight[at]
        self.blocks = -(-n // BLOCK)
        block_key = self.key // n * self.blocks + self.key % n // BLOCK
        self.first = np.nonzero(np.diff(block_key, prepend=-1))[0]
        self.block_key = block_key[self.first]
        self.block_max = np.maximum.reduceat(self.weight, self.first)
        self.block_least = np.minimum.reduceat(self.least, np.arange(0, n, BLOCK))
        self.term_blocks = np.searchsorted(self.block_key, np.arange(terms + 1) * self.blocks)
        self.term_max = np.maximum.reduceat(self.block_max, self.term_blocks[:-1])
        # Runs of each item, told apart by the item: where a retrieved passage may hold one.
        rng = np.random.default_rng(1)
        self.salt, self.item_salt = (rng.integers(1, 2**63, k, dtype=np.uint64) for k in (terms + 1, n))
        self.run_length = np.array([min(needle, len(w)) for w in self.words])
        self.runs = {
            m: np.sort(np.concatenate([_run_hashes(self.words[k], m, self.salt) ^ self.item_salt[k] for k in np.nonzero(self.run_length == m)[0]]))
            for m in np.unique(self.run_length).tolist()
        }

    @staticmethod
    def _least(words: np.ndarray, terms: np.ndarray, weights: np.ndarray, needle: int) -> float:
        """The least score of a run of ``needle`` consecutive words (of all words, if there are fewer)."""
        of = weights[np.searchsorted(terms, words)]
        last: dict[int, int] = {}
        before = np.full(len(words), -1)
        for k, w in enumerate(words.tolist()):
            before[k] = last.get(w, -1)
            last[w] = k
        best = np.inf
        for s in range(max(1, len(words) - needle + 1)):
            fresh = before[s : s + needle] < s  # a term counts once
            best = min(best, float(of[s : s + needle][fresh].sum()))
        return best

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(index of the text, item id) for every text that holds a needle."""
        if not self.ids:
            return []
        get = self.vocabulary.get
        coded, counts = [], []
        for t in texts:
            words = normal_words(t) if t else ()
            counts.append(len(words))
            coded.extend([get(w, -1) for w in words])
        code = np.array(coded, dtype=np.int64)
        size = np.array(counts, dtype=np.int64)
        begin = np.cumsum(size) - size
        stride = PASSAGE - self.needle + 1
        # A passage starts every ``stride`` words; a last one that the one before covers is left out.
        number = np.where(size > 0, np.maximum(1, -(-(size - self.needle + 1) // stride)), 0)
        doc, nth = _expand(np.zeros(len(size), dtype=np.int64), number)
        start = begin[doc] + nth * stride
        stop = np.minimum(start + PASSAGE, begin[doc] + size[doc])
        passage, item = self._retrieve(code, start, stop)
        good = self._holds(code, start[passage], stop[passage], item)
        return sorted({(d, self.ids[i]) for d, i in zip(doc[passage[good]].tolist(), item[good].tolist())})

    def _retrieve(self, code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (passage, item) whose BM25 score reaches the item's threshold."""
        of, at = _expand(start, stop)
        of, term = of[code[at] >= 0], code[at][code[at] >= 0]
        terms = len(self.vocabulary)
        pair = np.sort(of * terms + term)
        of, term = np.divmod(pair[np.diff(pair, prepend=-1) != 0], terms)
        heads = np.nonzero(np.diff(of, prepend=-1))[0]
        if not len(heads):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.append(heads[1:], len(of))
        # Pivot: the first terms of a passage, as long as their greatest weights stay below every threshold.
        upto = np.cumsum(self.term_max[term])
        upto -= np.repeat(upto[heads] - self.term_max[term[heads]], ends - heads)
        essential = np.nonzero(upto >= self.least[0])[0]
        k, b = _expand(self.term_blocks[term[essential]], self.term_blocks[term[essential] + 1])
        seen = np.zeros(len(heads) * self.blocks, dtype=bool)
        group = np.repeat(np.arange(len(heads)), ends - heads)
        seen[group[essential[k]] * self.blocks + self.block_key[b] % self.blocks] = True
        group, block = np.divmod(np.nonzero(seen)[0], self.blocks)
        passage = of[heads[group]]
        # Bound of a block: the maxima of all terms of the passage.
        k, t = _expand(heads[group], ends[group])
        want = term[t] * self.blocks + block[k]
        at = np.minimum(np.searchsorted(self.block_key, want), len(self.block_key) - 1)
        there = self.block_key[at] == want
        bound = np.bincount(k[there], weights=self.block_max[at[there]], minlength=len(block))
        open_ = bound >= self.block_least[block]
        use = there & open_[k]
        # Full scores in the blocks that stay.
        j, post = _expand(self.first[at[use]], np.append(self.first, len(self.key))[at[use] + 1])
        if not len(post):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = k[use][j] * BLOCK + self.key[post] % len(self.ids) % BLOCK
        score = np.bincount(where, weights=self.weight[post], minlength=len(block) * BLOCK).reshape(-1, BLOCK)
        limit = np.full(self.blocks * BLOCK, np.inf)
        limit[: len(self.least)] = self.least
        c, i = np.nonzero(score >= limit.reshape(-1, BLOCK)[block])
        return passage[c], block[c] * BLOCK + i

    def _holds(self, code: np.ndarray, start: np.ndarray, stop: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which of the passages hold a run of ``needle`` consecutive words of their item, or the whole of a shorter one."""
        out = np.zeros(len(item), dtype=bool)
        for m, runs in self.runs.items():
            mine = np.nonzero(self.run_length[item] == m)[0]
            if not len(mine) or len(code) < m:
                continue
            here = _run_hashes(code, m, self.salt)
            k, at = _expand(start[mine], stop[mine] - m + 1)
            want = here[at] ^ self.item_salt[item[mine[k]]]
            spot = np.minimum(np.searchsorted(runs, want), len(runs) - 1)
            hit = np.nonzero(runs[spot] == want)[0]
            for h in hit.tolist():  # equal hashes are compared word by word
                pair = mine[k[h]]
                out[pair] = out[pair] or self._same(code[at[h] : at[h] + m], self.words[item[pair]])
        return out

    @staticmethod
    def _same(run: np.ndarray, words: np.ndarray) -> bool:
        m = len(run)
        return any((words[o : o + m] == run).all() for o in np.nonzero(words[: len(words) - m + 1] == run[0])[0].tolist())


def find_leaks(documents: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", needle: int = NEEDLE) -> DataFrame:
    """(id, item_id) of every document that holds at least ``needle`` consecutive words of an item.

    Documents are read where they lie; only results are shuffled. The items are a query set: if their index would
    exceed ``INDEX_BYTES``, they are dealt to several, and the corpus is read once for each.
    """
    clean = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = clean.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-size * BYTES_PER_CHARACTER // INDEX_BYTES))
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks))
    parts = []
    kind = documents.schema[id].dataType.simpleString()
    for k in range(chunks):
        index = ItemIndex([(r.item_id, r.text) for r in clean.where(slot == k).collect()], needle)
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    part = batch.slice(lo, 1000)
                    pairs = index.leaks(part.column(1).to_pylist())
                    at = pa.array([d for d, _ in pairs], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array([i for _, i in pairs], pa.int64())], names=[id, "item_id"])

        parts.append(documents.select(f"`{id}`", f"`{text}`").mapInArrow(run, f"`{id}` {kind}, item_id long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
