from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeloom.llm import pitman_yor as model
from tests.llm import cases


def stirling(n):
    """Ways of n customers at k tables with discount 1/2, by the recursion."""
    row = {1: 1.0}
    for c in range(1, n):
        row = {k: row.get(k - 1, 0.0) + (c - k / 2) * row.get(k, 0.0) for k in range(1, c + 2)}
    return row


@pytest.mark.parametrize("c,others,parent,strength", [(2, 0, 0.3, 1.0), (7, 12, 0.2, 0.5), (30, 400, 0.4, 1.0), (5, 3, 1e-7, 1.0), (40, 0, 1.0, 20.0)])
def test_tables_follow_their_full_conditional(c, others, parent, strength):
    weight, rising = {}, 1.0
    for k in range(1, c + 1):
        rising *= (strength + (others + k - 1) / 2) * parent
        weight[k] = stirling(c)[k] * rising
    n, total = 40_000, sum(weight.values())
    drawn = model.draw_tables(np.full(n, c), np.full(n, others), np.full(n, parent), strength, np.random.default_rng(c))
    found = Counter(drawn.tolist())
    for k, w in weight.items():
        p = w / total
        assert abs(found[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    assert set(found) <= set(weight)


def test_tables_of_large_and_empty_dishes():
    c = np.array([0, 1, 10**9, 10**6])
    drawn = model.draw_tables(c, np.array([5, 5, 10**7, 10**5]), np.array([0.5, 0.5, 0.02, 0.1]), 1.0, np.random.default_rng(1))
    assert drawn[0] == 0 and drawn[1] == 1
    # Far below the root of the customers the number is negative binomial.
    assert abs(drawn[3] - 1 - 10**5 * 0.1 / 0.9) < 6 * math.sqrt(10**5 * 0.1) / 0.9


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["\n"]


def by_hand(docs):
    """Rows of the result with one table per dish."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    n, pairs = Counter(), Counter()
    for h, (_, text) in zip(held, docs):
        if not h:
            words = words_of(text)
            n.update(words)
            pairs.update(zip([" ", *words], words))
    total, v = sum(n.values()), len(n)
    contexts, customers, dishes = Counter(w for _, w in pairs), Counter(), defaultdict(int)
    for (u, _), c in pairs.items():
        customers[u] += c
        dishes[u] += 1
    rows = []
    for h, (i, text) in zip(held, docs):
        words, score = words_of(text), 0.0
        for u, w in zip([" ", *words], words):
            parent = (contexts[w] - (w in contexts) / 2 + (1 + v / 2) / (v + 1)) / (1 + sum(contexts.values()))
            score += math.log10((pairs[u, w] - ((u, w) in pairs) / 2 + (1 + dishes[u] / 2) * parent) / (1 + customers[u]))
        base = sum(math.log10((n[w] + 0.1) / (total + 0.1 * (v + 1))) for w in words)
        rows.append((i, h, len(words), sum(w in n for w in words), total, base, score))
    return rows


def same(found, expected):
    key = lambda r: (repr(r[:5]), round(r[5], 6))
    assert len(found) == len(expected)
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(expected, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_counts_and_places_agree_with_plain_loops(spark):
    """Several chunks, contexts spread over the buckets, rows of all odd kinds."""
    r = random.Random(2)
    texts = [" ".join(r.choice(["the", "The", "a", "b", "É", "é", "日本", f"w{r.randrange(300)}"]) for _ in range(r.randrange(40))) for _ in range(300)]
    docs = [*enumerate(texts), (7, texts[7]), (7, texts[7]), *zip(cases.ODD_IDS[:-1], cases.ODD_TEXTS[:-1]), (9999, "x" * 50_000 + "\x00\x85  y")]
    frame = cases.frame(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(5)
    out = model.scored(frame, model.Settings(sweeps=0, chunk_tokens=700)).collect()
    same(out, by_hand(docs))


def test_very_long_text_and_extra_columns(spark):
    docs = [(1, cases.LONG), (2, cases.LONG), (3, None), (14, "unseen words")]
    out = model.scored(cases.frame(spark, [t for _, t in docs], [i for i, _ in docs]), model.Settings(sweeps=0, chunk_tokens=1000)).collect()
    same(out, by_hand(docs))


def test_drawn_model_predicts_better_than_the_base_and_repeats(spark):
    r, following = random.Random(4), defaultdict(list)
    for i in range(200):
        following[i] = [r.randrange(200) for _ in range(3)]

    def text(n):
        at, words = r.randrange(200), []
        for _ in range(n):
            words.append(f"w{at}")
            at = r.choice(following[at])
        return " ".join(words)

    frame = cases.frame(spark, [text(60) for _ in range(400)])
    rows = model.scored(frame, model.Settings(chunk_tokens=4000)).collect()
    held = [x for x in rows if x.held_out]
    assert len(held) > 20
    # Three equally likely words follow each word.
    mean = sum(x.score for x in held) / sum(x.n_tokens for x in held)
    base = sum(x.base_score for x in held) / sum(x.n_tokens for x in held)
    assert mean > 0.5 * base and mean > -1.0
    again = model.scored(frame.repartition(3), model.Settings(chunk_tokens=4000)).collect()
    assert {x.doc_id: pytest.approx(x.score, rel=1e-9) for x in rows} == {x.doc_id: x.score for x in again}


def test_probabilities_of_a_context_sum_to_one(spark):
    """A text of one word x and its end: the end's probability after x is that of the pair (x, end)."""
    train = [(i, t) for i, t in enumerate(["a b", "a c", "a b", "b", "b c a", ""] * 3) if zlib.crc32(str(i).encode()) % 10]
    parents = model.Parent(tables=5, customers=9, base=1 / 4, strength=1.0)
    customers, tables = np.array([4, 3, 2]), np.array([2, 2, 1])
    assert parents.probability(customers, tables).sum() + parents.probability(np.array([0]), np.array([0]))[0] == pytest.approx(1)
    held = next(i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 10 == 0)
    out = model.scored(cases.frame(spark, [*(t for _, t in train), ""], [*(i for i, _ in train), held])).where(f"doc_id = {held}").collect()
    assert len(out) == 1 and -1.5 < out[0].score < 0


def test_empty_tables_and_no_training_text(spark):
    assert model.scored(cases.empty(spark)).count() == 0
    held = next(i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = model.scored(cases.frame(spark, ["a b"], [held])).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
