"""Benchmark decontamination by the CGK embedding.

A document window and a benchmark item are sequences of words (lower case, signs removed).
The CGK random walk copies the word at a pointer and moves the pointer on by a random bit
that depends on the step and the word, so sequences at a small edit distance become strings
at a small Hamming distance.  Each of ``REPEATS`` walks is sampled at ``SAMPLED`` of its
steps; equal samples put an item-sized window and an item in the same bucket, and every
candidate is verified by its exact edit distance in words: a document is contaminated when a
window lies within ``(1 - SIMILARITY)`` times the item's length of the item.

Windows are item-sized and start at every word of every document.  Windows that cannot
verify are left out by the q-gram lemma before they are embedded: within distance d of an
item of L words a window of L + d words holds at least L - 1 - 2d word pairs of items.

Items are handled in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` words, one
pass over the documents each; a block is what is sent to the executors.  No rows are
shuffled, so no group of copies can meet in one task.

Defined results: null or empty texts match nothing; items without a word are ignored;
equal rows are reported each; an item of fewer than five words must occur exactly.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import values_of

SIMILARITY = 0.8
REPEATS = 48
SAMPLED = 3
BLOCK_ITEMS = 5_000
BLOCK_WORDS = 500_000
#: Signs of ASCII become spaces.
SIGNS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
SEED = 20_011
WINDOWS_AT_ONCE = 4096
SIEVE = (1 << 20) - 1
MATCHES = "doc_id bigint, item_id bigint, start bigint, length bigint, distance bigint"


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(SIGNS).split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def sampled_walks(rows: np.ndarray) -> np.ndarray:
    """Bucket keys of equally long word-id sequences, one column per walk.

    The walk takes up to three steps a word; past the end it emits a padding symbol, as CGK
    does.  The sampled steps lie where most pointers are still inside the sequence.
    """
    n, length = rows.shape
    random = np.random.default_rng([SEED, length])
    picked = random.integers(0, max(1, 2 * length), (REPEATS, SAMPLED))
    seeds = random.integers(1, 2**62, (int(picked.max()) + 1, REPEATS), np.int64).astype(np.uint64)
    padded = np.concatenate([rows, np.full((n, 1), -1, rows.dtype)], axis=1)
    at = np.zeros((n, REPEATS), np.int64)
    key = np.tile(np.arange(REPEATS, dtype=np.uint64), (n, 1))
    for step, seed in enumerate(seeds):
        symbol = np.take_along_axis(padded, at, axis=1).astype(np.uint64)
        for walk, times in zip(*np.unique(np.nonzero(picked == step)[0], return_counts=True)):
            for _ in range(times):
                key[:, walk] = mixed(key[:, walk] * np.uint64(31) + symbol[:, walk])
        coin = mixed(symbol * np.uint64(1_000_003) + seed) >> np.uint64(63)
        at = np.minimum(at + coin.astype(np.int64), length)
    return key


def edit_distance(goal: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Least Levenshtein distance of ``goal`` to a prefix of ``window``, and its length."""
    steps = np.arange(len(window) + 1)
    row = steps.copy()
    for i, x in enumerate(goal, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (window != x))
        row = np.minimum.accumulate(np.concatenate(([i], best)) - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


class Index:
    """A block of items: vocabulary, word pairs, and LSH buckets by length of the item."""

    def __init__(self, item_ids: list[int], items: list[list[bytes]]) -> None:
        self.item_ids = item_ids
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in items for w in t}), 1)}
        self.coded = [np.array([self.vocabulary[w] for w in t], np.int64) for t in items]
        self.base = len(self.vocabulary) + 1
        self.single = {int(t[0]): i for i, t in enumerate(self.coded) if len(t) == 1}
        self.lengths = np.array(sorted({len(t) for t in self.coded if len(t) > 1}), np.int64)
        #: Words a match can span, and pairs of items it holds at least.
        self.spans = self.lengths + [slack(n) for n in self.lengths]
        self.needs = np.maximum(1, self.lengths - 1 - 2 * np.array([slack(n) for n in self.lengths], np.int64))
        coded = [p for t in self.coded if len(t) > 1 for p in (t[:-1] * self.base + t[1:]).tolist()]
        self.pairs = np.array(sorted(set(coded)), np.int64)
        self.sieve = np.zeros(SIEVE + 1, bool)
        self.sieve[self.pairs & SIEVE] = True
        #: How often a pair is in an item of that length, at most.
        self.times = np.zeros((len(self.pairs), len(self.lengths)), np.int64)
        for t in self.coded:
            if len(t) > 1:
                pair, count = np.unique(t[:-1] * self.base + t[1:], return_counts=True)
                at = np.searchsorted(self.pairs, pair), np.searchsorted(self.lengths, len(t))
                self.times[at] = np.maximum(self.times[at], count)
        self.buckets: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in self.lengths.tolist():
            members = np.array([i for i, t in enumerate(self.coded) if len(t) == length])
            keys = sampled_walks(np.stack([self.coded[i] for i in members]))
            flat, order = keys.ravel(), np.argsort(keys.ravel(), kind="stable")
            self.buckets[length] = (flat[order], np.repeat(members, REPEATS)[order], members)

    def windows(self, code: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(item length, window starts) that the q-gram lemma leaves."""
        near = np.nonzero((code[:-1] > 0) & (code[1:] > 0))[0] if len(code) > 1 and len(self.pairs) else []
        if not len(near):
            return []
        pair = code[near] * self.base + code[near + 1]
        maybe = self.sieve[pair & SIEVE]
        near, pair = near[maybe], pair[maybe]
        if len(near) < self.needs.min():
            return []
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        near, place = near[self.pairs[place] == pair], place[self.pairs[place] == pair]
        if len(near) < self.needs.min():
            return []
        times = self.times[place]
        order = np.argsort(place, kind="stable")
        out = []
        for k in np.nonzero((times > 0).sum(axis=0) >= self.needs)[0].tolist():
            held = order[times[order, k] > 0]
            # A pair counts no more often in a window than the items hold it: it counts in the windows
            # that reach it and start after its times-th predecessor of the same pair.
            back = np.arange(len(held)) - times[held, k]
            earlier = held[np.maximum(back, 0)]
            after = np.where((back >= 0) & (place[earlier] == place[held]), near[earlier] + 1, 0)
            first = np.maximum(after, near[held] - int(self.spans[k]) + 2)
            change = np.bincount(first, minlength=len(code) + 1) - np.bincount(near[held] + 1, minlength=len(code) + 1)
            total = np.cumsum(change)[:-1]  # total[i]: pairs that count in the window from word i
            out.append((int(self.lengths[k]), np.nonzero(total >= self.needs[k])[0]))
        return [(n, starts) for n, starts in out if len(starts)]

    def matches(self, texts: Iterable[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """Per text (item_id, start word, words, distance), the nearest window of each item."""
        known = self.vocabulary.get
        codes = []
        for text in texts:
            found = words(text)
            codes.append(np.fromiter(map(known, found, repeat(0)), np.int64, len(found)))
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in codes]
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
        for doc, code in enumerate(codes):
            for word, item in self.single.items():
                at = np.nonzero(code == word)[0]
                if len(at):
                    best[doc][item] = (0, int(at[0]), 1)
            for length, starts in self.windows(code):
                waiting.setdefault(length, []).append((doc, starts))
        for length, parts in waiting.items():
            for doc, start, item in self._candidates(length, parts, codes):
                goal = self.coded[item]
                if best[doc].get(item, (1,))[0] == 0:
                    continue  # found without any edit
                distance, end = edit_distance(goal, codes[doc][start : start + length + slack(length)])
                if distance <= slack(length) and (distance, start) < best[doc].get(item, (1 << 30, 0))[:2]:
                    best[doc][item] = (distance, start, end)
        return [[(self.item_ids[i], start, n, d) for i, (d, start, n) in sorted(b.items())] for b in best]

    def _candidates(self, length: int, parts: list, codes: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(document, start, item) that meet in a bucket of some walk, those of most walks first."""
        keys, items, _ = self.buckets[length]
        found: Counter[tuple[int, int, int]] = Counter()
        docs = np.concatenate([np.full(len(s), d) for d, s in parts])
        starts = np.concatenate([s for _, s in parts])
        for low in range(0, len(docs), WINDOWS_AT_ONCE):
            d, s = docs[low : low + WINDOWS_AT_ONCE], starts[low : low + WINDOWS_AT_ONCE]
            rows = np.zeros((len(d), length), np.int64)
            for i, (doc, start) in enumerate(zip(d.tolist(), s.tolist())):
                part = codes[doc][start : start + length]
                rows[i, : len(part)] = part
            hits = sampled_walks(rows)
            left, right = np.searchsorted(keys, hits, "left"), np.searchsorted(keys, hits, "right")
            for i, walk in zip(*np.nonzero(right > left)):
                found.update((int(d[i]), int(s[i]), int(x)) for x in items[left[i, walk] : right[i, walk]])
        return sorted(found, key=lambda c: (-found[c], c))


def slack(length: int) -> int:
    """Largest edit distance to an item of so many words."""
    return int((1 - SIMILARITY) * length + 1e-9)


def item_blocks(items: DataFrame) -> Iterator[Index]:
    """Blocks of bounded size; only one block is held on the driver at a time."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        found = words(text)
        if found:
            if ids and (len(ids) >= BLOCK_ITEMS or size + len(found) > BLOCK_WORDS):
                yield Index(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(item_id)
            texts.append(found)
            size += len(found)
    if ids:
        yield Index(ids, texts)


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            found = index.matches(values_of(batch.column(1)))
            out = [(key, *m) for key, row in zip(batch.column(0).to_pylist(), found) for m in row]
            columns = list(zip(*out)) or [[]] * 5
            names = ["doc_id", "item_id", "start", "length", "distance"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(scan, MATCHES)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document row and item it holds: doc_id, item_id, start, length, distance."""
    found = [_scan(docs, index) for index in item_blocks(items)]
    if not found:
        return docs.sparkSession.createDataFrame([], MATCHES)
    return reduce(DataFrame.unionAll, found)


def _clean(index: Index, docs: DataFrame) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([not found for found in held.value.matches(values_of(batch))], pa.bool_())

    return clean(F.col("text").cast("string"))


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are."""
    return reduce(lambda kept, index: kept.where(_clean(index, kept)), item_blocks(items), docs)
