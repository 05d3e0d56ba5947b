"""Vectors as product codes, nearest entries found by Orchard's search.

A vector is cut into equal consecutive parts, and every part is replaced by the index of the
nearest entry of that part's codebook.  All arithmetic is on integers: a component x becomes
floor(scale * x), entries are floors of means.

Nearest entries: each entry has the list of all entries sorted by their distance to it.  A
search walks along the list of its current entry, skips entries that it has visited, jumps
to the list of every entry that is nearer, and stops at the first neighbour farther than
twice the current distance: by the triangle inequality nothing after it can be as near.
Equal distances go to the lower index.  Many vectors walk side by side in numpy.

A round of fitting sends parts x entries x (width + 1) sums per task and collects as many;
no vector leaves its task.

Defined results: vectors that are null or hold null or non-finite components are left out,
and so are those whose length differs from that of the smallest id's vector; that length has
to be a multiple of the number of parts.  A component is bounded so that the error of a
vector fits a long (about 2**20 at 64 components).  Repeated ids give repeated rows; of an
id's vectors the smallest one may start a codebook.  Null ids are encoded and start none.
Fewer ids than entries give smaller codebooks, no vector gives no row.  Null labels are one
label; a sum beyond a long is null.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.session import settle

#: A label with more than this share of the rows is looked up by broadcast: at most 1,000 labels.
HOT_SHARE = 1000


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


@dataclass(frozen=True)
class Codebooks:
    """``books``: integers by part, entry and place within the part."""

    books: np.ndarray
    settings: Settings

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Vectors (rows of doubles) that stand for rows of entry numbers."""
        parts = [book[codes[:, p]] for p, book in enumerate(self.books)]
        return (np.concatenate(parts, axis=1) + 0.5) / self.settings.scale


def integers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), for vectors of ``width`` components."""
    most = math.isqrt((1 << 60) // width)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(values * scale), -most, most).astype(np.int64).reshape(-1, width)


class Orchard:
    """Exact nearest entries of one codebook."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        apart = np.array([((book - entry) ** 2).sum(axis=1) for entry in book]).reshape(len(book), len(book))
        np.fill_diagonal(apart, -1)  # an entry comes first in its own list, also before equal ones
        self.lists = np.argsort(apart, axis=1, kind="stable")
        # One more column without bound ends every list.
        self.gaps = np.pad(np.take_along_axis(apart, self.lists, axis=1), ((0, 0), (0, 1)), constant_values=np.iinfo(np.int64).max)
        self.lists = np.pad(self.lists, ((0, 0), (0, 1)))
        self.along = np.argsort(book[:, 0], kind="stable")
        self.firsts = book[self.along, 0]

    def _start(self, x: np.ndarray) -> np.ndarray:
        """An entry whose first component is close; any entry gives the same result."""
        return self.along[np.minimum(np.searchsorted(self.firsts, x[:, 0]), len(self.along) - 1)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) per row of ``x``."""
        current = self._start(x)
        best = ((x - self.book[current]) ** 2).sum(axis=1)
        live = np.arange(len(x))
        place = np.zeros(len(x), np.int64)
        visited = np.zeros((len(x), len(self.book)), bool)
        visited[live, current] = True
        while len(live):
            place[live] += 1
            at, step = current[live], place[live]
            within = self.gaps[at, step] <= 4 * best[live]
            live = live[within]
            entry = self.lists[at[within], step[within]]
            fresh = ~visited[live, entry]
            rows, entry = live[fresh], entry[fresh]
            visited[rows, entry] = True
            distance = ((x[rows] - self.book[entry]) ** 2).sum(axis=1)
            nearer = (distance < best[rows]) | ((distance == best[rows]) & (entry < current[rows]))
            rows = rows[nearer]
            current[rows], best[rows], place[rows] = entry[nearer], distance[nearer], 0
        return current, best


def assign(x: np.ndarray, searches: list[Orchard]) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers (rows x parts) and the summed squared distances per row."""
    codes, error, size = [], np.zeros(len(x), np.int64), x.shape[1] // len(searches)
    for p, search in enumerate(searches):
        entry, distance = search.nearest(x[:, p * size : (p + 1) * size])
        codes.append(entry)
        error += distance
    return np.stack(codes, axis=1), error


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The rows whose vector has only finite components."""
    value = F.col(embedding)
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(value.isNotNull() & (F.size(value) > 0) & whole)


def width_of(rows: DataFrame) -> int:
    """Length of the vector of the smallest id, 0 without any."""
    first = rows.where(F.col("vec_id").isNotNull()).agg(F.min(F.struct("vec_id", F.size("embedding").alias("width"))).alias("first")).first().first
    return first.width if first else 0


def fit(rows: DataFrame, settings: Settings = Settings()) -> Codebooks | None:
    """Codebooks of usable rows (vec_id, embedding) that all have one length; None without any."""
    ids = [r.vec_id for r in rows.where(F.col("vec_id").isNotNull()).select("vec_id").distinct().orderBy("vec_id").limit(settings.entries).collect()]
    if not ids:
        return None
    seeds = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").collect()
    width = len(seeds[0].embedding)
    if width % settings.parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {settings.parts} equal parts")
    whole = integers(pa.array([r.embedding for r in seeds]), width, settings.scale)
    books = whole.reshape(len(seeds), settings.parts, -1).transpose(1, 0, 2)
    for _ in range(settings.rounds):
        books = refined(rows, Codebooks(books, settings))
    return Codebooks(np.ascontiguousarray(books), settings)


def refined(rows: DataFrame, codebooks: Codebooks) -> np.ndarray:
    """Books whose entries are the floored means of the parts assigned to them."""
    books, scale, width = codebooks.books, codebooks.settings.scale, codebooks.width
    parts, entries, size = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(book) for book in books]
        total = np.zeros((parts, entries, size + 1), np.int64)  # the last column counts
        for batch in batches:
            x = integers(batch.column(0), width, scale)
            codes, _ = assign(x, searches)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], np.pad(x[:, p * size : (p + 1) * size], ((0, 0), (0, 1)), constant_values=1))
        cell = np.flatnonzero(total.any(axis=2))
        values = pa.FixedSizeListArray.from_arrays(pa.array(total.reshape(-1, size + 1)[cell].ravel()), size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), values.cast(pa.list_(pa.int64()))], ["cell", "total"])

    summed = rows.select("embedding").mapInArrow(sums, "cell bigint, total array<bigint>")
    each = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(size + 1)]
    new = books.reshape(parts * entries, size).copy()
    for row in summed.groupBy("cell").agg(*each).collect():
        new[row.cell] = [row[f"s{i}"] // row[f"s{size}"] for i in range(size)]
    return new.reshape(books.shape)


def encoded(vector: Column, codebooks: Codebooks) -> Column:
    """Struct of code (two hexadecimal digits a part) and error (long) of every vector."""
    books, scale, width = codebooks.books, codebooks.settings.scale, codebooks.width

    @F.arrow_udf("code string, error bigint")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searches = [Orchard(book) for book in books]
        for batch in batches:
            codes, error = assign(integers(batch, width, scale), searches)
            texts = [bytes(row).hex() for row in codes.astype(np.uint8)]
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(error)], ["code", "error"])

    return encode(vector)


def with_totals(rows: DataFrame) -> DataFrame:
    """Add label_error, the sum of ``error`` over the rows of one label.

    Labels that hold more than a thousandth of the rows are at most a thousand and are looked
    up by broadcast, so that no task gets the rows of a large label.
    """
    totals = settle(rows.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error"), F.count("*").alias("_n")))
    n = totals.agg(F.sum("_n")).first()[0] or 0
    totals = totals.withColumnRenamed("label", "_label")
    hot = totals.where(F.col("_n") * HOT_SHARE > n)
    same = F.col("label").eqNullSafe(F.col("_label"))
    large = rows.join(F.broadcast(hot), same)
    small = rows.join(F.broadcast(hot), same, "left_anti").join(totals.where(F.col("_n") * HOT_SHARE <= n), same)
    return large.unionByName(small).drop("_label", "_n")


def compressed(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 per usable vector."""
    if settings.entries > 256:
        raise ValueError("two hexadecimal digits name at most 256 entries")
    rows = usable(vectors.select("vec_id", "embedding", "label"))
    rows = rows.where(F.size("embedding") == width_of(rows))
    codebooks = fit(rows.select("vec_id", "embedding"), settings)
    if codebooks is None:  # no id at all
        none = F.lit(None)
        return rows.where(F.lit(False)).select("vec_id", "label", none.cast("string").alias("code"), *[none.cast("bigint").alias(c) for c in ("error", "label_error")], none.cast("string").alias("codebooks_sha256"))
    coded = rows.select("vec_id", "label", encoded(F.col("embedding"), codebooks).alias("_c")).select("vec_id", "label", "_c.*")
    return with_totals(settle(coded)).withColumn("codebooks_sha256", F.lit(codebooks.sha256()))


def oracle() -> str:
    """DuckDB SQL of the query: every distance is computed."""
    step = """
near{i} AS MATERIALIZED (
  SELECT x.vec_id, x.part, arg_min(b.entry, (d, b.entry)) AS entry, min(d) AS d FROM (
    SELECT x.vec_id, x.part, b.entry, list_sum(list_transform(x.v, lambda e, i: (e - b.v[i]) * (e - b.v[i]))) AS d
    FROM cut x JOIN book{i} b USING (part)) x JOIN book{i} b USING (part, entry) GROUP BY x.vec_id, x.part
)"""
    mean = """
book{j} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN (
    SELECT part, entry, list(q ORDER BY place) AS v FROM (
      SELECT part, entry, place, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS q
      FROM (SELECT part, entry, unnest(v) AS e, unnest(range(4)) AS place FROM near{i} JOIN cut USING (vec_id, part)) y GROUP BY part, entry, place) z GROUP BY part, entry) m USING (part, entry)
)"""
    steps = ",".join([step.format(i=0), mean.format(i=0, j=1), step.format(i=1), mean.format(i=1, j=2), step.format(i=2)])
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (SELECT vec_id, part, v[4 * part + 1 : 4 * part + 4] AS v FROM kept, range(16) p(part)),
book0 AS MATERIALIZED (
  SELECT part, entry, v FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)
), {steps},
codes AS (
  SELECT vec_id, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d) AS error FROM near2 GROUP BY vec_id
), books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), books"""
