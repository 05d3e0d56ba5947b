"""Quality rules combined by weak supervision.

Every rule votes good, bad or abstains.  Documents are counted by their pattern of votes
(at most 3 to the number of rules), and expectation-maximisation on those counts estimates
the share of good documents and, per rule and class, how often it votes which way.  The
posterior probability of good then decides, instead of asking that all rules pass.

Counts are of all documents; only the patterns with their counts reach the driver.
Defined results: null and empty texts have no word and fail the base rule; equal rows are
judged alike; an empty table gives no row.
"""
from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.text_stats import text_statistics
from tapeloom.session import settle

ABSTAIN, BAD, GOOD = 0, 1, 2
ROUNDS = 200
LEAST_POSTERIOR = 0.5


def _per(count: str, of: str) -> Column:
    return F.col(count) / F.greatest(F.col(of), F.lit(1))


def rules() -> dict[str, Column]:
    """Votes as columns over the statistics.

    A rule against junk abstains where it finds none, as the lack of one kind of junk is no
    evidence of quality; rules for prose ask for several signs of it together.
    """

    def against(found: Column) -> Column:
        return F.when(found, BAD).otherwise(ABSTAIN)

    def in_favour(found: Column) -> Column:
        return F.when(found, GOOD).otherwise(ABSTAIN)

    length, symbols = _per("word_chars", "n_words"), _per("n_symbols", "n_words")
    repetition, stops = _per("n_repeat_words", "n_words"), _per("n_stops", "n_words")
    letters = F.col("n_upper") + F.col("n_lower")
    return {
        "odd_words": against((length < 2.5) | (length > 9)),
        "symbols": against(symbols > 0.25),
        "line_copies": against(_per("n_dup_lines", "n_lines") > 0.3),
        "repetition": against(repetition > 0.3),
        "capitals": against(F.col("n_upper") > 0.4 * letters),
        "few_words": against(_per("n_distinct_words", "n_words") < 0.1),
        "shouts": against(_per("n_shouts", "n_words") > 0.25),
        "sentences": in_favour((stops > 0.02) & (stops < 0.5) & (symbols < 0.02) & (F.col("n_upper") < 0.15 * letters)),
        "fresh_text": in_favour((repetition < 0.1) & (F.col("n_dup_lines") == 0) & (symbols < 0.02)),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Prior of good and P(vote | class, rule), from vote patterns and their counts."""
    n_rules = patterns.shape[1]
    hot = np.eye(3)[patterns]  # patterns x rules x votes
    # Start from "no rule votes bad": each kind of junk breaks a rule of its own, and a start
    # from the majority would take the rarer kinds for good text.
    posterior = np.where((patterns == BAD).any(1), 0.05, 0.95)
    prior, table = 0.5, np.full((2, n_rules, 3), 1 / 3)
    for _ in range(rounds):
        weights = np.stack([counts * (1 - posterior), counts * posterior])
        table = np.einsum("cp,prv->crv", weights, hot) + 0.5
        table /= table.sum(2, keepdims=True)
        prior = (weights[1].sum() + 1) / (counts.sum() + 2)
        before, posterior = posterior, posterior_of(patterns, prior, table)
        if np.max(np.abs(posterior - before), initial=0.0) < 1e-9:
            break
    return prior, table


def posterior_of(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    at = np.arange(patterns.shape[1])
    good = np.log(prior) + np.log(table[1, at, patterns]).sum(1)
    bad = np.log(1 - prior) + np.log(table[0, at, patterns]).sum(1)
    return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and posterior per row of ``docs``."""
    spark = docs.sparkSession
    counted = docs.select("doc_id", text_statistics(F.col("text")).alias("_s")).select("doc_id", "_s.*")
    votes = rules()
    code = sum((vote * 3**i for i, vote in enumerate(votes.values())), F.lit(0))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    stats = settle(counted.select("doc_id", *base, base_failed.alias("base_failed"), code.cast("int").alias("_votes")))
    seen = stats.groupBy("_votes").agg(F.count("*").alias("n")).collect()
    every = np.array(list(product(range(3), repeat=len(votes))))[:, ::-1]  # row k holds the digits of k
    codes = np.array([r["_votes"] for r in seen], int)
    patterns = every[codes].reshape(-1, len(votes))
    prior, table = estimate(patterns, np.array([float(r["n"]) for r in seen]))
    posterior = posterior_of(patterns, prior, table)
    learned = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, posterior)], "_pattern int, posterior double")
    joined = stats.join(F.broadcast(learned), F.col("_votes") == F.col("_pattern"))
    kept = ~F.col("base_failed") & (F.col("posterior") >= LEAST_POSTERIOR)
    return joined.select("doc_id", *base, "base_failed", kept.alias("kept"), "posterior")
