"""Importance resampling towards a target distribution, over hashed runs of words.

A batch of texts is joined with a sentinel between them, one pass of a regular expression
finds all words of the batch, ``searchsorted`` on the texts' ends tells whose each word is,
runs of words that reach over a sentinel are masked, and ``bincount`` gives the counts of the
buckets or the weights of the texts.  Batches are short and texts leave Arrow a few at a time,
since every word of a batch is an object and a worker's memory counts once per core.

``fit`` counts the buckets of all documents and of the whole target (at most ``buckets``
rows each reach the driver) and turns them into one integer gain per bucket.  A document's
weight is the sum of the gains of its features; Gumbel noise made of its id turns the
weights into scores whose largest values are a draw without replacement in proportion to
the importance of the documents.  Ranks come from ranges of scores: splitters of an
approximate quantile sketch, exact counts per range for the offsets, a sort per range.
A single score can hold about 1/2700 of the rows of one weight, so a range stays small.

Defined results: null and empty texts have no feature and weight 0; a null id is written
as the empty string for the noise and is drawn first among equal scores; rows that are
repeated are drawn one by one; an empty target or empty documents give the gains that the
formula gives with counts of 0.
"""
from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import values_of
from tapeloom.session import settle

#: Bytes of one joined batch; a longer text is a batch of its own.
BATCH_BYTES = 1 << 18
#: Letters a-z, digits and everything beyond ASCII, as bytes of UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SENTINEL = b"\n"
ROWS_PER_RANGE = 200_000
LEAST_RANGES, MOST_RANGES = 64, 10_000


@dataclass(frozen=True)
class Settings:
    """Runs of ``shortest`` to ``longest`` words, hashed into ``buckets``."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000


@dataclass(frozen=True)
class Features:
    """Of one joined batch: the number of words per text, and text and bucket per feature."""

    words: np.ndarray
    text: np.ndarray
    bucket: np.ndarray


def joined(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """The texts in batches of about BATCH_BYTES, ASCII letters in lower case."""
    held, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "replace").lower()
        if held and size + len(data) > BATCH_BYTES:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield held


def reader(settings: Settings):
    """The function texts -> Features per joined batch."""

    def features(texts: Iterable[str | None]) -> Iterator[Features]:
        for batch in joined(texts):
            ends = np.cumsum([len(data) + len(SENTINEL) for data in batch])
            words, starts = [], array("q")
            for found in WORD.finditer(SENTINEL.join(batch)):
                words.append(found[0])
                starts.append(found.start())
            owner = np.searchsorted(ends, np.array(starts, np.int64), "right")
            run = list(map(zlib.crc32, words))
            owners, buckets = [], []
            for n in range(1, settings.longest + 1):
                if n > 1:  # the run from each word on, longer by one word
                    run = [zlib.crc32(w, zlib.crc32(b" ", before)) for before, w in zip(run, words[n - 1 :])]
                if n >= settings.shortest:
                    first, last = owner[: len(run)], owner[n - 1 :]
                    within = first == last
                    owners.append(first[within])
                    buckets.append(np.array(run, np.int64)[within] % settings.buckets)
            yield Features(np.bincount(owner, minlength=len(batch)), np.concatenate(owners), np.concatenate(buckets))

    return features


def bucket_counts(texts: DataFrame, settings: Settings, text: str = "text") -> np.ndarray:
    """Features per bucket over all rows; every task sends at most one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = reader(settings), np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for part in features(values_of(batch.column(0))):
                total += np.bincount(part.bucket, minlength=settings.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = texts.select(F.col(text)).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(settings.buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+k) / ((s+1)(T+k)))) per bucket, k the number of buckets."""
    k, total, aim = len(source), int(source.sum()), int(target.sum())
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * (total + k) / ((s + 1) * (aim + k)))) for s, t in pairs], np.int64)


def fit(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), text: str = "text") -> np.ndarray:
    return gains_of(bucket_counts(docs, settings, text), bucket_counts(target, settings, text))


def weighed(text: Column, gains: np.ndarray, settings: Settings = Settings()) -> Column:
    """Struct of n_words, n_features and weight (all long) of every whole text."""

    @F.arrow_udf("n_words bigint, n_features bigint, weight bigint")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = reader(settings)
        for batch in batches:
            parts = [(np.zeros(0, np.int64),) * 3]
            for part in features(values_of(batch)):
                n = len(part.words)
                # Sums of integers below 2**53 are exact in doubles.
                weight = np.bincount(part.text, gains[part.bucket].astype(np.float64), n).astype(np.int64)
                parts.append((part.words, np.bincount(part.text, minlength=n), weight))
            columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)]
            yield pa.StructArray.from_arrays(columns, ["n_words", "n_features", "weight"])

    return weigh(text)


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("bigint")


def scored(docs: DataFrame, gains: np.ndarray, seed: str = "2024", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_features, weight and score per row of ``docs``."""
    found = docs.select("doc_id", weighed(F.col("text"), gains, settings).alias("_w")).select("doc_id", "_w.*")
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def range_of(score: Column, splitters: Sequence[int]) -> Column:
    """Number of splitters above ``score``, so that range 0 has the highest scores."""
    ordered = np.array(sorted(splitters), np.int64)

    @F.arrow_udf("int")
    def place(scores: pa.Array) -> pa.Array:
        above = len(ordered) - np.searchsorted(ordered, scores.to_numpy(zero_copy_only=False), "right")
        return pa.array(above, pa.int32())

    return place(score)


def ranked(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``rows`` of ``scored`` with rank: 1 for the highest of the drawn scores, null if not drawn.

    Drawn are floor(percent * N / 100) of the N rows with at least ``least_words`` words.
    """
    rows = settle(rows)
    eligible = F.col("n_words") >= least_words
    n = rows.where(eligible).count()
    drawn = percent * n // 100
    if not drawn:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    ranges = min(max(LEAST_RANGES, n // ROWS_PER_RANGE), MOST_RANGES)
    shares = [i / ranges for i in range(1, ranges)]
    splitters = rows.where(eligible).agg(F.percentile_approx("score", shares, 10 * ranges).alias("s")).first().s
    placed = rows.withColumn("_range", F.when(eligible, range_of(F.col("score"), sorted(set(splitters)))))
    sizes = sorted((r["_range"], r["count"]) for r in placed.where(eligible).groupBy("_range").count().collect())
    before, at = {}, 0
    for number, size in sizes:
        if at < drawn:
            before[number] = at
        at += size
    last = max(before)
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    order = Window.partitionBy("_range").orderBy(F.desc("score"), F.asc("doc_id"), "n_features")
    candidates = placed.where(F.col("_range") <= last)
    rank = F.row_number().over(order) + F.try_element_at(offsets, F.col("_range"))
    top = candidates.withColumn("rank", rank.cast("bigint"))
    top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = placed.where(F.col("_range").isNull() | (F.col("_range") > last)).withColumn("rank", F.lit(None).cast("bigint"))
    return top.unionByName(rest).drop("_range")


def resampling(docs: DataFrame, target: DataFrame, percent: int, least_words: int = 20, seed: str = "2024", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank per row of ``docs``."""
    return ranked(scored(docs, fit(docs, target, settings), seed, settings), percent, least_words)


def resampled(docs: DataFrame, target: DataFrame, percent: int, least_words: int = 20, seed: str = "2024", settings: Settings = Settings()) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows equal to the last drawn in id and score go along.

    The last drawn (score, id) decides alone, so the documents are filtered, not joined.
    """
    gains = fit(docs, target, settings)
    last = ranked(scored(docs, gains, seed, settings), percent, least_words).agg(F.max_by(F.struct("score", "doc_id"), "rank").alias("last")).first().last
    whole = docs.select(F.struct(*docs.columns).alias("row"), weighed(F.col("text"), gains, settings).alias("w"))
    if last is None:
        return docs.where(F.lit(False))
    score = F.col("w.weight") + noise(F.col("row.doc_id"), seed)
    among = (score > last.score) | ((score == last.score) & (F.col("row.doc_id").isNull() if last.doc_id is None else F.col("row.doc_id").isNull() | (F.col("row.doc_id") <= last.doc_id)))
    return whole.where((F.col("w.n_words") >= least_words) & among).select("row.*")


def oracle() -> str:
    """DuckDB SQL of the query: one word a feature, 10,000 buckets, a tenth drawn."""
    return r"""
WITH RECURSIVE crc_steps AS (
  SELECT i, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE k = 8),
texts AS (
  SELECT 0 AS aim, doc_id AS id, text FROM documents
  UNION ALL
  SELECT 1, item_id, text FROM benchmark
), split AS (
  SELECT aim, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), features AS (SELECT aim, id, unnest(words) AS word FROM split),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(octet_length(encode(word))), lambda i: CAST(('0x' || substr(hex(encode(word)), 2 * i + 1, 2)) AS BIGINT))),
    lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM features) w, crc_table
), counted AS (
  SELECT bucket, count(*) FILTER (aim = 0) AS s, count(*) FILTER (aim = 1) AS t FROM features JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM counted
), weights AS (
  SELECT id AS doc_id, count(*) AS n_features, sum(gain) AS weight
  FROM features JOIN hashed USING (word) JOIN gains USING (bucket) WHERE aim = 0 GROUP BY id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8)) AS BIGINT) + 0.5) / 4294967296))) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CAST(CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS BIGINT) AS rank
FROM placed"""
