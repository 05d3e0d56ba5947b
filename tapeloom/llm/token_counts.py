"""Token counts by a whole-token table.

A sentencepiece BPE vocabulary whose pieces never hold the space mark after another
character cannot merge across the start of a word, and a line feed that is in no piece
always stands alone.  Text therefore falls into independent units: a run of spaces with
the word after it, and line feeds.  ``whole_tokens`` proves once, on the driver, which
vocabulary strings encode alone to exactly one token; units found in that table count one
without any merging, and only the others are merged by the library and remembered.

Defined results: null text counts as empty (0 bytes, 0 tokens); empty text has no token.
Rows are independent, so repeated rows and ids give repeated results.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import BoundedCache

SPACE = "▁"
#: Units remembered by a worker, about 100 bytes each.
CACHE_UNITS = 400_000
#: A run of spaces with the word after it, a bare word, or a line feed.
UNIT = re.compile(rf"[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+|\n")


@lru_cache(maxsize=2)
def _processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def splits_at_spaces(sp: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether no piece of the vocabulary reaches over the start of a word or a line feed."""
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not sp.is_byte(i)]
    return not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)


def whole_tokens(model: str) -> list[str]:
    """Words (without the space mark before them) that the model encodes as one token."""
    sp = _processor(model)
    if not splits_at_spaces(sp):
        raise ValueError("pieces of this model reach over spaces; units would not be independent")
    marked = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not sp.is_control(i)]
    words = [p[1:] for p in marked if p.startswith(SPACE) and SPACE not in p[1:] and len(p) > 1]
    return [w for w, ids in zip(words, sp.encode(words, num_threads=1)) if len(ids) == 1]


def counter(model: str, whole: list[str]):
    """The function text -> number of tokens; ``whole`` are words known to be one token."""
    sp = _processor(model)
    feed = len(sp.encode("\n"))

    def merged(unit: str) -> int:
        if unit == "\n":
            return 1
        if unit == " " or unit == SPACE:
            return 1
        if unit[0] in (" ", SPACE):
            return len(sp.encode(unit[1:]))  # the library puts one space before a text
        return len(sp.encode("\n" + unit)) - feed

    def after_space(part: str) -> int:
        return sum(units[u] for u in UNIT.findall(" " + part))

    units = BoundedCache(merged, CACHE_UNITS // 4, {" " + w: 1 for w in whole})
    parts = BoundedCache(after_space, CACHE_UNITS, dict.fromkeys(whole, 1))

    def count(text: str) -> int:
        if not text:
            return 0
        if "  " in text or text[0] == " " or SPACE in text:  # runs of spaces belong to the word after them
            return sum(map(units.__getitem__, UNIT.findall(" " + text)))
        return sum(map(parts.__getitem__, text.split(" ")))

    return count


def token_count(text: Column, model: str) -> Column:
    """Number of tokens of ``text`` (long), as the library gives it for the whole text."""
    whole = whole_tokens(model)

    @F.arrow_udf("bigint")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(model, whole)
        for batch in batches:
            yield pa.array(map(count, batch.to_pylist()), pa.int64())

    return tokens(F.coalesce(text, F.lit("")))


def token_counts(docs: DataFrame, model: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), token_count(text, model).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
