"""Substring dedup by relative parsing against reference blocks.

A word is removed when a window of ``WINDOW`` consecutive words that covers it also starts
in a document with a smaller id.

Index.  The rarest-looking group of ``GRAM`` words of a window (least hash, leftmost) is its
anchor.  Consecutive windows with one anchor form a block: the anchor with the words around
it.  Equal windows have equal anchors wherever they stand, so blocks are indexed by anchor,
and only anchors of two documents or more matter.  Every block of every document is indexed.

Parse.  A document is factored from left to right along the blocks it shares.  A block that
a smaller id holds as a whole is a factor copied from the first document that holds it, and
neighbouring factors of one source join.  Where blocks of an anchor differ, a factor can
begin or end inside a block; the first holder of each such boundary block checks it window by
window, against those of all other blocks of that anchor.  Factors that come from a smaller
id are the duplicate spans.

Anchors, blocks and windows are aggregated to one row per distinct value before they are
joined, so a passage in a third of all documents is one row; equality is decided by 64 bits
of the anchor with 64 bits of the block, and by 128 bits of a window.

Defined results: null text has no words; rows with a null id are never changed and never a
source; rows with the same id are not smaller than each other; equal rows have equal
results; texts shorter than a window are kept whole.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import BoundedCache
from tapeloom.session import settle

WINDOW = 50
GRAM = 8
CACHE_WORDS = 400_000
#: Odd multipliers of the polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes() -> BoundedCache:
    return BoundedCache(xxhash.xxh3_64_intdigest, CACHE_WORDS)


class Parsed:
    """Blocks of one document: anchors, first windows and numbers of windows."""

    def __init__(self, words: list[bytes], cache: BoundedCache) -> None:
        n = len(words)
        self.n = n
        self.anchors = self.starts = self.counts = np.empty(0, np.int64)
        if n < WINDOW:
            return
        self.h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
        gram = np.zeros(n - GRAM + 1, np.uint64)
        for j in range(GRAM):
            gram = gram * np.uint64(BASES[0]) + self.h[j : n - GRAM + 1 + j]
        rank = mixed(gram)
        place = _leftmost_least(rank, WINDOW - GRAM + 1)
        self.starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        self.counts = np.diff(np.concatenate([self.starts, [len(place)]]))
        self.anchors = rank[place[self.starts]].view(np.int64)

    def _prefix(self, base: int) -> tuple[np.ndarray, np.ndarray]:
        up = np.full(self.n, base, np.uint64)
        down = np.full(self.n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.h * np.cumprod(up))]), np.cumprod(down)

    def blocks(self) -> np.ndarray:
        """Hash of the words of every block."""
        if not len(self.starts):
            return np.empty(0, np.int64)
        total, back = self._prefix(BASES[0])
        ends = self.starts + self.counts + WINDOW - 1
        value = (total[ends] - total[self.starts]) * back[self.starts]
        return mixed(value + self.counts.astype(np.uint64)).view(np.int64)

    def windows(self, at: np.ndarray) -> list[np.ndarray]:
        """Two hashes of each window that starts in ``at``."""
        out = []
        for base in BASES:
            total, back = self._prefix(base)
            out.append(mixed((total[at + WINDOW] - total[at]) * back[at]).view(np.int64))
        return out


def _leftmost_least(rank: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value, leftmost if tied, in every stretch of ``width`` values."""
    view = np.lib.stride_tricks.sliding_window_view(rank, width)
    out = np.empty(len(view), np.int64)
    for low in range(0, len(view), 1 << 14):
        out[low : low + (1 << 14)] = view[low : low + (1 << 14)].argmin(1)
    return out + np.arange(len(view))


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _batch(columns: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def shared_anchors(docs: DataFrame) -> DataFrame:
    """anchor, first (least id) and uniform (all its blocks are equal), of anchors in two ids or more."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_hashes()
        for batch in batches:
            ids, anchors, blocks = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Parsed(_words(text), cache)
                ids.append(np.full(len(own.starts), doc_id, np.int64))
                anchors.append(own.anchors)
                blocks.append(own.blocks())
            yield _batch([_joined(ids), _joined(anchors), _joined(blocks)], [pa.int64()] * 3, ["doc_id", "anchor", "block"])

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(emit, "doc_id bigint, anchor bigint, block bigint")
    seen = rows.groupBy("anchor").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("block").alias("b0"), F.max("block").alias("b1")
    )
    return seen.where("first < last").select("anchor", "first", (F.col("b0") == F.col("b1")).alias("uniform"))


def _shared_of_documents(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, text_hash and the shared blocks of each document that has any, with the first
    document of each block (of the anchor, where all its blocks are equal)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_hashes()
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = Parsed(_words(text), cache)
                blocks, at = np.unique(own.blocks(), return_index=True)
                for column, value in zip(columns, (np.full(len(blocks), doc_id), np.full(len(blocks), text_hash), own.anchors[at], blocks)):
                    column.append(value.astype(np.int64))
            yield _batch([_joined(c) for c in columns], [pa.int64()] * 4, ["doc_id", "text_hash", "anchor", "block"])

    own = docs.where("doc_id IS NOT NULL").mapInArrow(emit, "doc_id bigint, text_hash bigint, anchor bigint, block bigint")
    held = settle(own.join(shared, "anchor"))
    # Where blocks of an anchor differ, each kind of block has a first document of its own.
    kinds = held.where("NOT uniform").groupBy("anchor", "block").agg(F.min("doc_id").alias("holder"))
    held = held.join(kinds, ["anchor", "block"], "left").withColumn("first", F.coalesce("holder", "first"))
    # The first document of a block that is the same everywhere has nothing to lose by it.
    useful = held.where("NOT uniform OR first < doc_id")
    return useful.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "block", "first", "uniform")).alias("known"))


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed, as they are about to be shuffled."""

    @F.arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.array([None if t is None else press.compress(t.encode("utf-8", "surrogatepass")) for t in batch.to_pylist()], pa.binary())

    return docs.select("doc_id", "text_hash", pack("text").alias("packed"))


def _factors(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Factors (doc_id, text_hash, start, n_words, source) and, at their boundaries, windows
    whose source is still open (w1, w2)."""
    schema = "doc_id bigint, text_hash bigint, start bigint, n_words bigint, source bigint, w1 bigint, w2 bigint"
    names = [part.split()[0] for part in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, press = word_hashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[list[np.ndarray]] = [[] for _ in names]
            nulls: list[np.ndarray] = []
            for doc_id, text_hash, packed, known in zip(*(c.to_pylist() for c in batch.columns)):
                own = Parsed(press.decompress(packed).split(), cache)
                order = sorted(known, key=lambda k: k["block"])
                blocks = np.array([k["block"] for k in order])
                mine = own.blocks()
                at = np.minimum(np.searchsorted(blocks, mine), len(blocks) - 1)
                hit = (blocks[at] == mine) & (np.array([k["anchor"] for k in order])[at] == own.anchors)
                source = np.array([k["first"] for k in order])[at]
                copied = hit & (source < doc_id)
                checked = hit & ~copied & ~np.array([k["uniform"] for k in order])[at]
                # Greedy: a factor goes on while the next block comes from the same source.
                goes_on = copied[1:] & copied[:-1] & (source[1:] == source[:-1])
                begin = np.flatnonzero(copied & ~np.concatenate([[False], goes_on]))
                end = np.flatnonzero(copied & ~np.concatenate([goes_on, [False]]))
                start = own.starts[begin]
                length = own.starts[end] + own.counts[end] + WINDOW - 1 - start
                check = np.flatnonzero(checked)
                open_at = np.concatenate([np.arange(own.starts[i], own.starts[i] + own.counts[i]) for i in check]) if len(check) else np.empty(0, np.int64)
                w1, w2 = own.windows(open_at) if len(open_at) else (open_at, open_at)
                n, m = len(start), len(open_at)
                zeros_n, zeros_m = np.zeros(n, np.int64), np.zeros(m, np.int64)
                for column, value in zip(
                    rows,
                    (np.full(n + m, doc_id), np.full(n + m, text_hash), np.concatenate([start, open_at]), np.concatenate([length, zeros_m + WINDOW]),
                     np.concatenate([source[begin], zeros_m]), np.concatenate([zeros_n, w1]), np.concatenate([zeros_n, w2])),
                ):
                    column.append(value.astype(np.int64))
                nulls.append(np.concatenate([np.zeros(n, bool), np.ones(m, bool)]))
            is_open = np.concatenate(nulls) if nulls else np.empty(0, bool)
            columns = [pa.array(_joined(c)) for c in rows[:4]]
            columns.append(pa.array(_joined(rows[4]), mask=is_open))
            columns += [pa.array(_joined(c), mask=~is_open) for c in rows[5:]]
            yield pa.RecordBatch.from_arrays(columns, names)

    known = _shared_of_documents(docs, shared)
    texts = _packed(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"))
    return texts.join(known, ["doc_id", "text_hash"]).mapInArrow(parse, schema)


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, n_words, source: stretches of words that a smaller id holds too.

    Spans may overlap; ``source`` is the least id that holds the span.
    """
    docs = _keyed(docs)
    shared = settle(shared_anchors(docs))
    factors = settle(_factors(docs, shared))
    open_windows = factors.where("source IS NULL")
    first = open_windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    checked = open_windows.join(first, ["w1", "w2"]).where("first < doc_id").withColumn("source", F.col("first"))
    columns = ["doc_id", "text_hash", "start", "n_words", "source"]
    return factors.where("source < doc_id").select(columns).unionByName(checked.select(columns))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words and n_removed per row of ``docs``."""
    schema = "doc_id bigint, text string, n_words bigint, n_removed bigint"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, packed, spans in zip(*(c.to_pylist() for c in batch.columns)):
                words = press.decompress(packed).split() if packed is not None else []
                kept = words
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [s["start"] for s in spans], 1)
                    np.add.at(edge, [s["start"] + s["n_words"] for s in spans], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                for column, value in zip(out, (doc_id, b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), len(words) - len(kept))):
                    column.append(value)
            yield _batch(out, [pa.int64(), pa.string(), pa.int64(), pa.int64()], ["doc_id", "text", "n_words", "n_removed"])

    spans = duplicate_spans(docs)
    lists = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    joined = _packed(_keyed(docs)).join(lists, ["doc_id", "text_hash"], "left")
    return joined.select("doc_id", "packed", "spans").mapInArrow(remove, schema)


def oracle() -> str:
    """DuckDB SQL of the query: every window of 50 words by its whole text."""
    return r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i AS start, array_to_string(words[i:i + 49], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts)
), firsts AS (
  SELECT passage, min(doc_id) AS first_id FROM windows GROUP BY passage
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 50)) AS i FROM windows JOIN firsts USING (passage) WHERE first_id < doc_id
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts
), kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS text
  FROM placed ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
