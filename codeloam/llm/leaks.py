"""Evaluation texts leaking into training text: SimHash windows with multi-index Hamming search, then exact checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from codeloam.session import spread

WORD = re.compile(r"[a-z0-9]+")
RUN = 10  # words of the shortest passage, and of a window
RADIUS = 3  # Hamming radius that the index guarantees: one of RADIUS + 1 blocks is equal
SHINGLE = 5  # words of a shingle of the similarity
ITEMS_AT_ONCE = 5_000  # items indexed together; more are searched in slices, so the index stays bounded
CHARS_AT_ONCE = 4_000_000  # characters of the items of a slice
CHUNK = 1 << 17  # words fingerprinted at once
FOUND = "doc_id bigint, item_id bigint, shared_runs int, near_runs int, longest_run int, similarity double"


class _Hashes(dict):
    """Word hashes, kept while the vocabulary fits."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str | None, seen: _Hashes) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def fingerprints(h: np.ndarray) -> np.ndarray:
    """SimHash of every window of RUN words: each bit is the majority over its words and word pairs (19 votes)."""
    n = len(h) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0x632BE59BD9B4E019))
    pair ^= pair >> np.uint64(29)
    pair *= np.uint64(0xBF58476D1CE4E5B9)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8)
    both = ones[:-1] + np.unpackbits(pair.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8)
    total = np.zeros((n, 64), np.int8)
    for k in range(RUN - 1):
        total += both[k : k + n]
    total += ones[RUN - 1 :]
    return np.packbits(total > RUN - 1, axis=1).view(np.uint64).ravel()


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ h[k : k + n]) * np.uint64(0x100000001B3)
    return out


class ItemIndex:
    """Windows of the items under each of RADIUS + 1 fingerprint blocks, and weighted shingles of each item."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        seen = _Hashes()
        words = [(i, word_hashes(t, seen)) for i, t in items]
        self.ids = np.array([i for i, _ in words], np.int64)
        self.words = np.concatenate([h for _, h in words] or [np.zeros(0, np.uint64)])
        starts = np.cumsum([0] + [len(h) for _, h in words])
        self.at = np.concatenate([np.arange(s, s + max(0, len(h) - RUN + 1)) for s, (_, h) in zip(starts, words)] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.item = np.concatenate([np.full(max(0, len(h) - RUN + 1), k) for k, (_, h) in enumerate(words)] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.prints = np.concatenate([fingerprints(h) for _, h in words] or [np.zeros(0, np.uint64)])
        self.bits = 64 // (RADIUS + 1)
        self.blocks = []
        for b in range(RADIUS + 1):
            key = self.block(self.prints, b)
            order = np.argsort(key, kind="stable")
            self.blocks.append((order, np.searchsorted(key[order], np.arange((1 << self.bits) + 1))))
        held: dict[int, int] = {}
        sets = [np.unique(shingle_hashes(h)) for _, h in words]
        for s in sets:
            for x in s.tolist():
                held[x] = held.get(x, 0) + 1
        self.shingles = [(s, np.array([1 / held[x] for x in s.tolist()])) for s in sets]

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(self.bits * b)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, window) pairs within RADIUS, each once."""
        qs, ws = [], []
        for b, (order, first) in enumerate(self.blocks):
            key = self.block(prints, b)
            lo, n = first[key], first[key + 1] - first[key]
            q = np.repeat(np.arange(len(prints)), n)
            w = order[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            near = np.bitwise_count(prints[q] ^ self.prints[w]) <= RADIUS
            q, w = q[near], w[near]
            diff = prints[q] ^ self.prints[w]
            first_block = np.ones(len(q), bool)  # counted under the first block in which the two agree
            for c in range(b):
                first_block &= self.block(diff, c) != 0
            qs.append(q[first_block])
            ws.append(w[first_block])
        return np.concatenate(qs), np.concatenate(ws)

    def search(self, h: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(item_id, shared_runs, near_runs, longest_run, similarity) for every item near the words ``h``."""
        hits = []
        for s in range(0, max(0, len(h) - RUN + 1), CHUNK):
            q, w = self.near(fingerprints(h[s : s + CHUNK + RUN - 1]))
            if len(q):
                hits.append((q + s, w))
        if not hits:
            return
        q, w = (np.concatenate(x) for x in zip(*hits))
        same = np.ones(len(q), bool)
        for k in range(RUN):
            same &= h[q + k] == self.words[self.at[w] + k]
        mine = np.unique(shingle_hashes(h))
        for item in np.unique(self.item[w]):
            of = self.item[w] == item
            qe, we = q[of & same], w[of & same]
            longest = 0
            if len(qe):
                order = np.lexsort((qe, qe - we))
                d, p = (qe - we)[order], qe[order]
                breaks = np.flatnonzero((np.diff(d) != 0) | (np.diff(p) != 1)) + 1
                edges = np.concatenate(([0], breaks, [len(p)]))
                longest = int(np.diff(edges).max()) + RUN - 1
            shingles, weight = self.shingles[item]
            similarity = float(weight[np.isin(shingles, mine, assume_unique=True)].sum() / weight.sum())
            yield int(self.ids[item]), len(np.unique(qe)), int(of.sum() - len(qe)), longest, similarity


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared_runs, near_runs, longest_run, similarity) of every document near an item.

    Words are runs of a-z and digits of the lower-cased text. Every window of RUN words of a document gets a 64-bit
    SimHash; the items' windows are indexed under RADIUS + 1 blocks of theirs, so all windows within RADIUS come up,
    equal ones among them. Pairs are then checked on the words: ``shared_runs`` counts windows that stand word by word
    in the item, ``longest_run`` is their longest common run in words (0 without one), ``near_runs`` counts pairs that
    are only near, ``similarity`` is the share of the item's SHINGLE-word shingles in the document, each weighted by
    one over the number of items that hold it.

    Documents are never compared with each other and need no shuffle of results. Whole texts are searched. Null or
    short texts and items find nothing; repeated rows give repeated rows, of equal item ids each row counts; empty
    tables give an empty result; other columns are ignored. Items are indexed in slices of bounded length, which bounds
    what the driver and the executors hold; each slice is another pass.
    """
    spark = documents.sparkSession
    docs = spread(documents.select("doc_id", "text").where("text is not null"), "doc_id")
    out = None
    for part in _slices(items):
        index = spark.sparkContext.broadcast(ItemIndex(part))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            seen = _Hashes()
            for pdf in batches:
                found = [(d, *x) for d, t in zip(pdf["doc_id"], pdf["text"]) for x in index.value.search(word_hashes(t, seen))]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "shared_runs", "near_runs", "longest_run", "similarity"])

        near = docs.mapInPandas(search, FOUND)
        out = near if out is None else out.union(near)
    return out


def _slices(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in slices of at most ITEMS_AT_ONCE and CHARS_AT_ONCE; one slice at a time is held, an item longer than
    that alone. An empty table is one empty slice."""
    part, chars, any_ = [], 0, False
    for r in items.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id").toLocalIterator():
        if part and (len(part) == ITEMS_AT_ONCE or chars + len(r.text) > CHARS_AT_ONCE):
            yield part
            part, chars, any_ = [], 0, True
        part.append((r.item_id, r.text))
        chars += len(r.text)
    if part or not any_:
        yield part
