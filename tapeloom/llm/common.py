"""Helpers shared by the text operators."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of an Arrow column that are Python objects at a time.
VALUES_AT_ONCE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values_of(column: pa.Array) -> Iterator:
    """The values of a column of texts or bytes, so that a worker never holds a whole batch of them twice."""
    for start in range(0, len(column), VALUES_AT_ONCE):
        yield from column.slice(start, VALUES_AT_ONCE).to_pylist()


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a document row: equal only for rows with the same id and the same text."""
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text, F.length(text)).alias("text_hash"))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """``wanted`` with underscores before them, so that no name is among ``columns``."""
    used, out = {c.lower() for c in columns}, []
    for name in wanted:
        name = "_" + name
        while name.lower() in used:
            name = "_" + name
        out.append(name)
    return out


class BoundedCache(dict):
    """``cache[key]`` computes a missing value; the cache is emptied when it holds ``limit`` keys.

    The values of keys with more than ``longest`` characters are not kept.
    """

    def __init__(self, compute, limit: int, fixed: dict | None = None, longest: float = float("inf")) -> None:
        super().__init__(fixed or {})
        self._compute, self._limit, self._fixed, self._longest = compute, limit, fixed or {}, longest

    def __missing__(self, key):
        if len(key) > self._longest:
            return self._compute(key)
        if len(self) >= self._limit:
            self.clear()
            self.update(self._fixed)
        value = self[key] = self._compute(key)
        return value
