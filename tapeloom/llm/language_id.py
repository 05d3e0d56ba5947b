"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its own sample text.  A text is
compressed once with every dictionary, and once with none; the language whose dictionary gives
the fewest bytes is chosen.  The text is rejected when the runner-up is nearly as good, or when
the best dictionary saves next to nothing against none, as for a language that was not learned.
Both differences are measured against the bytes without a dictionary, which is what the text
leaves to save: a text that repeats itself leaves little, and its margin in bytes is narrow.

``train`` takes a bounded sample: per language at most ``SAMPLES`` excerpts of ``EXCERPT``
characters, from the distinct texts and places that come first in hash order.  Prediction reads every
character of every text.

Defined results: a text that is null or has no letter is ``und``, score 0, rejected.  Ties
in size go to the language with more training texts and are rejected.  Rows are independent,
so repeated rows repeat.  Without any training text every row is ``und``.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import values_of

UNKNOWN = "und"
SAMPLES = 64
EXCERPT = 2000
#: Texts are compressed in pieces, so that the dictionary counts throughout a long text.
PIECE_BYTES = 16384
#: Below so many bytes the compressor stores a text as it is unless it repeats; such a text is
#: compressed several times over, so that what its words save can show.
SHORT, COPIES = 256, 4
#: Least margin between the best two languages, and least saving of the best, as shares of the
#: bytes without a dictionary; never less than one byte of margin.
MARGIN = 0.03
SAVING = 0.02
#: ASCII signs and digits say nothing about a language.
NOISE = bytes(b for b in range(33, 128) if not chr(b).isalpha())

PARAMETERS = {
    "window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 2, "min_match": 4,
    "target_length": 16, "strategy": zstandard.STRATEGY_LAZY,
    "write_content_size": False, "write_checksum": False, "write_dict_id": False,
}


def cleaned(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(None, NOISE)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content per language, the language with most texts first.

    At most SAMPLES * EXCERPT characters per language reach the driver.
    """
    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    order = F.xxhash64("text")
    start = F.pmod(order, F.greatest(F.lit(1), F.length("text") - EXCERPT + 1)).cast("int") + 1
    drawn = known.select("lang", order.alias("h"), F.substring("text", start, F.lit(EXCERPT)).alias("excerpt")).where(F.col("excerpt").rlike(r"\p{L}"))
    # Copies of a text share hash and place; hashes are made distinct first, so that only they are moved.
    first = Window.partitionBy("lang").orderBy("h")
    chosen = drawn.select("lang", "h").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLES)
    sample = drawn.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "n").agg(F.min("excerpt").alias("excerpt"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for row in sample.select("lang", "n", "excerpt").collect():
        parts.setdefault(row.lang, []).append((row.n, cleaned(row.excerpt)))
    return {name: b" ".join(x for _, x in sorted(parts[name])) for name in sorted(parts, key=lambda x: (-counts[x], x))}


def classifier(dictionaries: dict[str, bytes]):
    """The function text -> (language, score, margin in bytes, bytes saved, rejected)."""
    parameters = zstandard.ZstdCompressionParameters(**PARAMETERS)
    plain = zstandard.ZstdCompressor(compression_params=parameters)
    compressors = {}
    for name, content in dictionaries.items():
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=parameters)
        compressors[name] = zstandard.ZstdCompressor(compression_params=parameters, dict_data=own)

    def classify(text: str | None) -> tuple[str, float, int, int, bool]:
        if not compressors or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0, 0, True
        data = cleaned(text)
        if len(data) < SHORT:
            data = (b" " + b" ".join(data.split()) + b" ") * COPIES
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in compressors.values()]
        least = min(sizes)
        best = sizes.index(least)
        # A byte more in the code means a likelihood lower by a factor of two at least.
        score = 1.0 / sum(math.pow(2.0, max(least - s, -1000)) for s in sizes)
        runner_up = min((s for i, s in enumerate(sizes) if i != best), default=least + 1000)
        alone = sum(len(plain.compress(p)) for p in pieces)
        margin, saved = runner_up - least, alone - least
        return list(compressors)[best], score, margin, saved, margin < max(1, MARGIN * alone) or saved < SAVING * alone

    return classify


def language(text: Column, dictionaries: dict[str, bytes]) -> Column:
    """Struct of lang_pred, score, margin and saved (bytes) and rejected for every whole text."""

    @F.arrow_udf("lang_pred string, score double, margin bigint, saved bigint, rejected boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classify = classifier(dictionaries)
        for batch in batches:
            rows = [classify(t) for t in values_of(batch)]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.bool_()),
                ],
                ["lang_pred", "score", "margin", "saved", "rejected"],
            )

    return predict(text)


def held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % divisor == remainder, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, saved and rejected per row of ``docs``."""
    out = held_out(F.col("doc_id"), 4, 2)
    dictionaries = train(docs.where(~out))
    return docs.select("doc_id", out.alias("held_out"), language(F.col("text"), dictionaries).alias("_r")).select("doc_id", "held_out", "_r.*")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all columns as they are."""
    dictionaries = train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    verdict = language(F.col("text"), dictionaries)
    return docs.where(~verdict["rejected"])
