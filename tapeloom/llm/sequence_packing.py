"""Best-fit packing of token pieces into sequences of bounded length.

``token_pieces`` turns texts into token ids with a terminator, cut into pieces.  ``pack``
places pieces by a configuration linear program over the histogram of lengths: a
configuration is a multiset of lengths that fits a sequence, and the program asks for the
fewest configurations that cover every length.  It is solved by multiplicative weights
whose pricing step is a knapsack (dynamic programming over the capacity, bounded by what is
still uncovered); purchases are rounded to whole sequences as they are made.  A rest of many
sequences is solved again, a small one
is placed by best fit, and the plan is then used to give every piece
a sequence and an offset.

The driver sees only the histogram (at most ``capacity`` counts) and the plan (one entry
per configuration and length), both bounded by the capacity and not by the data.  Pieces
of one length are ranked in buckets, with running totals over the buckets, so a length
that holds a third of all pieces is dealt over many tasks.

Defined results: null text counts as empty and gives one piece with the terminator; equal
rows each get a place of their own; an empty table gives no piece; a length outside
1..capacity is an error.
"""
from __future__ import annotations

import os
import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapeloom.llm.common import BoundedCache
from tapeloom.session import settle

#: Pre-tokens and words remembered by a worker, about 200 bytes each; it keeps them while other stages run.
CACHE_WORDS = 100_000
#: Characters of a pre-token or word that is remembered.
LONGEST_WORD = 64
#: Documents whose texts and ids a worker holds at a time.
ROWS_AT_ONCE = 512
#: Share of a scarcest length's demand that one round of multiplicative weights buys.
STEP = 1.0
#: Share of all tokens that is left to best fit.
REST = 0.08
#: The first price of a length is its share of a sequence to this power: above 1, short
#: lengths go a little later, and are there for best fit.
TILT = 1.1
#: Share of the highest price that a configuration without waste needs at least.
ENOUGH = 0.5

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Visible Latin-1 characters and spaces: no normalisation changes them but lower case.
PLAIN = re.compile("[ -~¡-¬®-ÿ]*")
_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
#: The tokenizer's own split of plain text in lower case into pre-tokens.
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^ {_LETTERS}{_DIGITS}]+")


def _byte_letters() -> list[str]:
    """The letter a byte-level vocabulary uses for each byte: its own if visible, else a spare one."""
    spare = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(spare)) for b in range(256)]


def _is_plain(text: str) -> bool:
    return "<|" not in text and PLAIN.fullmatch(text) is not None


def _parts(text: str) -> list[str]:
    """Pre-tokens of the plain words of ``text``, and its other words with a space before them."""
    if _is_plain(text):
        return PRE_TOKEN.findall(text.lower())
    parts: list[str] = []
    for plain, words in groupby(text.split(" "), _is_plain):
        parts += PRE_TOKEN.findall(" ".join(words).lower()) if plain else [" " + word for word in words]
    return parts


class TextIds:
    """``ids[text]``: token ids of a text without line feeds as little-endian unsigned 32-bit numbers.

    The tokenizer normalises white space to one space and drops it between tokens, so words
    between spaces are independent of each other.  Visible Latin-1 words need no Unicode
    normalisation: a run of them is split by one regular-expression pass, and the pre-tokens
    go to the tokenizer's merges directly.  All other words go through the whole tokenizer.
    Both are remembered, but for very long ones.
    """

    def __init__(self, tokenizer_path: str) -> None:
        tokenizer = _tokenizer(tokenizer_path)
        tokenize, letters = tokenizer.model.tokenize, _byte_letters()

        def part_ids(part: str) -> bytes:
            if part[0] == " ":
                ids = tokenizer.encode(part[1:], add_special_tokens=False).ids
            else:
                name = part if part.isascii() else "".join(map(letters.__getitem__, part.encode()))
                ids = [t.id for t in tokenize(name)]
            return struct.pack(f"<{len(ids)}I", *ids)

        self._ids = BoundedCache(part_ids, CACHE_WORDS, longest=LONGEST_WORD)

    def __getitem__(self, text: str) -> bytes:
        return b"".join(map(self._ids.__getitem__, _parts(text)))


@lru_cache(maxsize=2)
def word_ids(tokenizer_path: str) -> TextIds:
    """The ids of this worker, which keeps what it learned in earlier tasks."""
    return TextIds(tokenizer_path)


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length and ids (little-endian unsigned 32-bit, binary)."""
    end, step = np.array([end_id], "<u4").tobytes(), 4 * max_tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_path)
        slices = (batch.slice(at, ROWS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, ROWS_AT_ONCE))
        for batch in slices:
            doc_id, piece, start, length, ids = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = ids_of[(text or "").replace("\n", " ")] + end
                for k, at in enumerate(range(0, len(whole), step)):
                    part = whole[at : at + step]
                    doc_id.append(key)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


# The plan: histogram -> configurations with their multiplicity.


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int, copies: np.ndarray | None = None, enough: float = np.inf) -> dict[int, int]:
    """The most valuable multiset of lengths that fits, with at most ``copies`` of each.

    One that fills the capacity and is worth ``enough`` is taken as soon as it is found.
    """
    best, taken, parts = np.full(capacity + 1, -np.inf), [], []
    best[0] = 0.0
    for i, (length, value) in enumerate(zip(lengths.tolist(), values.tolist())):
        left = capacity // length if copies is None else min(capacity // length, int(copies[i]))
        if best[capacity] >= enough:
            break
        # Copies in parts of 1, 2, 4, ... make every number of them.
        n = 1
        while left > 0:
            n = min(n, left)
            worth = best[: capacity + 1 - n * length] + n * value
            better = worth > best[n * length :]
            np.maximum(best[n * length :], worth, out=best[n * length :])
            taken.append(better)
            parts.append((length, n))
            left -= n
            n *= 2
    chosen: Counter[int] = Counter()
    room = capacity if best[capacity] >= enough else int(np.argmax(best))
    for (length, n), better in zip(reversed(parts), reversed(taken)):
        if room >= n * length and better[room - n * length]:
            chosen[length] += n
            room -= n * length
    return dict(chosen)


def priced(price: np.ndarray, lengths: np.ndarray, copies: np.ndarray, capacity: int) -> dict[int, int]:
    """A configuration that is full and whose price is at least ``ENOUGH`` of the highest.

    No configuration is worth more than ``capacity`` times the highest price of a token, so
    lengths are added in the order of that price until a full configuration comes close to
    the bound.  Without such a one the configuration of the highest price is returned.
    """
    density = price / lengths
    # Equal prices are taken in mixed order, so that long and short lengths go at the same pace.
    order = np.lexsort((lengths * 2654435761 % 2**32, -density))
    return knapsack(price[order], lengths[order], capacity, copies[order], ENOUGH * capacity * density[order[0]])


def configuration_lp(histogram: dict[int, int], capacity: int, step: float = STEP) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Configurations with whole multiplicities inside the histogram, and what they leave.

    Multiplicative weights for the covering program: a length's price is its share of a
    sequence, times a weight that falls by the factor e while its demand is covered once.
    Each round buys the configuration of the highest price, ``step`` of the demand of its
    scarcest length, so all lengths are covered at the same pace.  A purchase is rounded down
    to whole sequences, at least one, and never exceeds what is still uncovered, so there is
    nothing to scale or to take back at the end.  Rounds end when the share ``REST`` of all
    tokens is uncovered, which goes to best fit.
    """
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    left = demand.copy()
    bought: Counter[tuple] = Counter()
    open_ = np.arange(len(lengths))
    while int(left @ lengths) > REST * int(demand @ lengths):
        price = (lengths[open_] / capacity) ** TILT * np.exp(left[open_] / demand[open_] - 1.0)
        config = priced(price, lengths[open_], left[open_], capacity)
        at = np.searchsorted(lengths, list(config))
        count = np.array(list(config.values()))
        times = int(min(np.min(left[at] // count), max(1, np.floor(step * np.min(demand[at] / count)))))
        bought[tuple(sorted(config.items()))] += times
        left[at] -= count * times
        open_ = open_[left[open_] > 0]
    rest = {int(n): int(c) for n, c in zip(lengths, left) if c}
    return [(dict(key), times) for key, times in bought.items()], rest


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: equal sequences are handled together."""
    open_by_room: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_by_room if r >= length), default=None)
            if room is None:
                per = capacity // length
                groups = [(per, left // per)] + ([(left % per, 1)] if left % per else [])
                for n, times in groups:
                    if times:
                        open_by_room.setdefault(capacity - n * length, Counter())[((length, n),)] += times
                break
            config, times = next(iter(open_by_room[room].items()))
            n = min(room // length, max(1, left // times))
            used = min(times, left // n)
            bins = open_by_room[room]
            bins[config] -= used
            if not bins[config]:
                del bins[config]
            if not bins:
                del open_by_room[room]
            open_by_room.setdefault(room - n * length, Counter())[config + ((length, n),)] += used
            left -= n * used
    return [(_counted(config), times) for bins in open_by_room.values() for config, times in bins.items()]


def _counted(parts: tuple[tuple[int, int], ...]) -> dict[int, int]:
    """Number of each length; a length can have been added to a sequence more than once."""
    out: dict[int, int] = {}
    for length, n in parts:
        out[length] = out.get(length, 0) + n
    return out


def plan(histogram: dict[int, int], capacity: int, step: float = STEP) -> list[tuple[dict[int, int], int]]:
    """Configurations with whole multiplicities that hold exactly the histogram."""
    if not histogram:
        return []
    if min(histogram) < 1 or max(histogram) > capacity:
        raise ValueError(f"lengths must lie in 1..{capacity}")
    out, rest = [], histogram
    while True:
        bought, rest = configuration_lp(rest, capacity, step)
        out += bought
        # A rest of many sequences is a histogram of its own for the program.
        if sum(n * c for n, c in rest.items()) <= capacity**2:
            return out + best_fit(rest, capacity)


# Giving pieces their places.


def _slots(configs: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, per sequence, offset) of each plan entry."""
    rank: Counter[int] = Counter()
    out, sequence = [], 0
    for config, times in configs:
        offset = 0
        for length, per in sorted(config.items(), reverse=True):
            out.append((length, rank[length], per * times, sequence, per, offset))
            rank[length] += per * times
            offset += length * per
        sequence += times
    return out


def ranked(pieces: DataFrame, order: list[str], buckets: int) -> DataFrame:
    """Adds ``rank`` from 0 among the pieces of one length, without one task per length."""
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    pieces = pieces.withColumn("_bucket", bucket)
    counts = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("length").alias("_length"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    own = Window.partitionBy("length", "_bucket").orderBy(*order)
    numbered = pieces.withColumn("_row", F.row_number().over(own) - 1)
    joined = numbered.join(starts, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("rank", F.col("_start") + F.col("_row")).drop("_length", "_b", "_start", "_row", "_bucket")


def pack(pieces: DataFrame, order: list[str], capacity: int, step: float = STEP) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (column ``length``, long).

    ``order`` names columns that tell pieces apart; rows equal in them are interchangeable.
    ``pieces`` is read several times, so settle it first when it is dear to compute.
    """
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan(histogram, capacity, step))
    names = ["s_length", "s_first", "s_ranks", "s_sequence", "s_per", "s_offset"]
    # An Arrow table needs no Python workers of its own, as a list of rows does.
    entries = spark.createDataFrame(pa.table([pa.array([s[k] for s in slots], pa.int64()) for k in range(len(names))], names=names))
    # One row per length: its entries, each with the ranks it holds.
    by_length = entries.groupBy("s_length").agg(F.array_sort(F.collect_list(F.struct("s_first", "s_ranks", "s_sequence", "s_per", "s_offset"))).alias("s_entries"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = ranked(pieces, order, buckets).join(F.broadcast(by_length), F.col("length") == F.col("s_length"))
    entry = F.element_at(F.filter("s_entries", lambda e: (e["s_first"] <= F.col("rank")) & (F.col("rank") < e["s_first"] + e["s_ranks"])), 1)
    within = F.col("_entry.s_first")
    return (
        placed.withColumn("_entry", entry)
        .withColumn("sequence_id", F.col("_entry.s_sequence") + F.expr("(rank - _entry.s_first) div _entry.s_per"))
        .withColumn("offset", F.col("_entry.s_offset") + F.col("length") * ((F.col("rank") - within) % F.col("_entry.s_per")))
        .drop("rank", "s_length", "s_entries", "_entry")
    )


def packed_digest(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Places of all pieces of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer_path, capacity)
    digest = settle(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(digest, ["doc_id", "piece", "ids_crc32", "start"], capacity)
