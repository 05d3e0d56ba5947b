"""Statistics of whole texts as one struct column.

Words are runs of characters other than the space and the ASCII controls 9 to 13.
Defined results: null and empty texts have all statistics 0.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signs counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Number of each kind in a text; n_lines counts lines with a word.
FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_stops", "n_shouts",
)
_SPACES = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(SYMBOLS.encode(), np.uint8)


def repeated_words(codes: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more, the first time included."""
    if len(codes) < 4:
        return 0
    size = int(codes.max()) + 1
    if size < 1 << 20:
        windows = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]
    else:
        pairs = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)[1]
        windows = pairs[:-1] * size + codes[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(FIELDS)
    data = text.encode("utf-8", "replace")
    words = data.split()
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    each = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return (
        len(words),
        len(text) - int(each[_SPACES].sum()),
        int(each[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated_words(codes),
        len(lines),
        len(seen),
        int(each[65:91].sum()),
        int(each[97:123].sum()),
        int(each[48:58].sum()),
        int(each[46] + each[63]),
        int(each[33]),
    )


def text_statistics(text: Column) -> Column:
    """Struct of FIELDS (all long) of every whole text."""

    @F.arrow_udf(", ".join(f"{name} bigint" for name in FIELDS))
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.to_pylist()], np.int64).reshape(-1, len(FIELDS))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], list(FIELDS))

    return stats(text)
