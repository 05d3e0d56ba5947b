"""Instrument codes: exchange suffixes and price-limit bands."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.expr import as_col

# First digit of a bare code -> exchange; anything else is Shanghai.
EXCHANGE_DIGITS = {"SZ": "[0123]", "BJ": "[48]"}
DEFAULT_EXCHANGE = "SH"

# Price-limit fractions by code prefix.
WIDE_BAND, WIDE_PREFIXES = 0.20, ("688", "689", "300", "301")
WIDEST_BAND, WIDEST_PATTERN = 0.30, "^([48]|920)"
DEFAULT_BAND = 0.10


def to_exchange_code(symbol: Column | str) -> Column:
    code = F.trim(as_col(symbol))
    suffix = F.lit(DEFAULT_EXCHANGE)
    for exchange, digits in EXCHANGE_DIGITS.items():
        suffix = F.when(code.rlike(f"^{digits}"), F.lit(exchange)).otherwise(suffix)
    return F.when(code.contains("."), F.upper(code)).otherwise(F.concat_ws(".", code, suffix))


def from_exchange_code(code: Column | str) -> Column:
    return F.substring_index(as_col(code), ".", 1)


def limit_pct(symbol: Column | str, default: float = DEFAULT_BAND) -> Column:
    code = from_exchange_code(symbol)
    numeric = code.rlike(r"^\d{3,}$")
    return (
        F.when(numeric & F.substring(code, 1, 3).isin(*WIDE_PREFIXES), F.lit(WIDE_BAND))
        .when(numeric & code.rlike(WIDEST_PATTERN), F.lit(WIDEST_BAND))
        .otherwise(F.lit(default))
    )
