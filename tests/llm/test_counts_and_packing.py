from __future__ import annotations

import random
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tapeloom.llm import sequence_packing as packing
from tapeloom.llm import token_counts
from tests.llm import cases

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
STRANGE = [" ", "  ", "\n", "\t", "a", "B", "▁", "é", "É", "ß", "\xa0", "\xad", "é", "<|endoftext|>", "</s>", "'s", "'T", ".", "İ", "Σ", "日", "5", "the"]


def strange(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(STRANGE) for _ in range(r.randrange(12))) for _ in range(n)]


def test_token_counts_agree_with_the_library():
    sp = token_counts._processor(PIECES)
    count = token_counts.counter(PIECES, token_counts.whole_tokens(PIECES))
    for text in [*strange(5000), *cases.ODD_TEXTS]:
        assert count(text or "") == len(sp.encode(text or "")), repr(text)


def test_whole_tokens_are_proved():
    sp = token_counts._processor(PIECES)
    whole = token_counts.whole_tokens(PIECES)
    assert len(whole) > 10_000 and all(len(sp.encode(w)) == 1 for w in whole[::97])


def test_token_counts_of_odd_rows(spark):
    rows = token_counts.token_counts(cases.odd(spark), PIECES, 4096).collect()
    sp = token_counts._processor(PIECES)
    expected = sorted((i or -1, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in zip(cases.ODD_IDS, cases.ODD_TEXTS))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == expected
    assert {r.doc_id for r in rows if r.over_limit} == {7}
    assert token_counts.token_counts(cases.empty(spark), PIECES, 4096).count() == 0


def test_word_ids_agree_with_the_library():
    tokenizer, ids = Tokenizer.from_file(WORDS), packing.word_ids(WORDS)
    for text in strange(5000, 1):
        got = np.frombuffer(b"".join(map(ids.__getitem__, text.replace("\n", " ").split(" "))), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_of_whole_texts_agree_with_the_library():
    tokenizer, ids = Tokenizer.from_file(WORDS), packing.TextIds(WORDS)
    latin = [chr(c) for c in range(32, 256)]
    pairs = [f"{a}{b}" for a in latin for b in latin]
    r = random.Random(2)
    mixed = ["".join(r.choice([*STRANGE, " ", "’", "don't", "<|", "A.B", "naïve"]) for _ in range(r.randrange(40))) for _ in range(3000)]
    for text in [*(" ".join(pairs[k : k + 100]) for k in range(0, len(pairs), 100)), *pairs[::7], *mixed]:
        got = np.frombuffer(ids[text.replace("\n", " ")], "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_worker_remembers_little():
    ids = packing.TextIds(WORDS)
    letters = str.maketrans("0123456789", "qwertyuiop")
    for at in range(0, 199_000, 1000):
        assert ids[" ".join(str(1_000_000 + k).translate(letters) for k in range(at, at + 1000))]
    long = "ab" * 50_000
    assert np.frombuffer(ids[long], "<u4").tolist() == Tokenizer.from_file(WORDS).encode(long, add_special_tokens=False).ids
    held = ids._ids
    assert sys.getsizeof(held) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in held.items()) < 20e6
    assert long not in held


def test_plan_table_starts_no_python_workers(spark):
    pieces = spark.range(500).selectExpr("id AS doc_id", "1 + id % 40 AS length")
    placed = packing.pack(pieces, ["doc_id"], 64)
    assert "ExistingRDD" not in placed._jdf.queryExecution().executedPlan().toString()
    ends = placed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sum(r[1] for r in ends) == sum(1 + i % 40 for i in range(500)) and max(r[1] for r in ends) <= 64


def test_work_of_pieces_grows_with_pre_tokens_not_with_words(spark):
    class Task:
        """Gives the function that runs in a task instead of running it."""

        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):
            return function

    cut = packing.token_pieces(Task(), WORDS, 2048)
    parts, marks = [f"part{chr(97 + k)}" for k in range(20)], [",", ".", "-", "/", "+"]
    words = [f"{a}{mark}{b}" for a in parts for mark in marks for b in parts]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join(words)]})
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        (out,) = cut(iter([batch]))
    finally:
        sys.setprofile(None)
    got = np.frombuffer(b"".join(out.column("ids").to_pylist()), "<u4").tolist()
    assert got == [*Tokenizer.from_file(WORDS).encode(" ".join(words), add_special_tokens=False).ids, 0]
    assert len(words) == 2000 and calls["call"] < 1000


def check_places(rows, capacity):
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_odd_rows(spark):
    rows = packing.packed_digest(cases.odd(spark), WORDS, 2048).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    expected = []
    for i, t in zip(cases.ODD_IDS, cases.ODD_TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected.append((i or -1, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    check_places(rows, 2048)
    assert packing.packed_digest(cases.empty(spark), WORDS).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_the_histogram_in_few_sequences(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 300])
    histogram: dict[int, int] = {}
    for _ in range(r.randrange(1, 60)):
        histogram[r.randrange(1, capacity + 1)] = r.choice([1, 3, 50, 1000])
    plan = packing.plan(histogram, capacity)
    held: dict[int, int] = {}
    for config, times in plan:
        assert sum(n * c for n, c in config.items()) <= capacity and times > 0
        for n, c in config.items():
            held[n] = held.get(n, 0) + c * times
    assert held == histogram
    volume = sum(n * c for n, c in histogram.items())
    large = sum(c for n, c in histogram.items() if 2 * n > capacity)
    assert sum(t for _, t in plan) <= 1.25 * max(-(-volume // capacity), large) + 2


def test_program_places_most_tokens_and_never_needs_more_than_best_fit():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()
    once = Counter(min(2048, len((t or "").split()) + 1) for t in texts)
    for scale in (1, 10, 1000):
        histogram = {n: c * scale for n, c in once.items()}
        volume = sum(n * c for n, c in histogram.items())
        bought, rest = packing.configuration_lp(histogram, 2048)
        assert sum(n * c for n, c in rest.items()) < 0.1 * volume
        held = Counter(rest)
        for config, times in bought:
            held.update({n: c * times for n, c in config.items()})
        assert held == histogram and len(bought) > 100
        alone = sum(times for _, times in packing.best_fit(histogram, 2048))
        assert -(-volume // 2048) <= sum(times for _, times in packing.plan(histogram, 2048)) <= alone


def test_knapsack_against_all_choices():
    lengths, values = np.array([2, 3, 5]), np.array([1.0, 1.9, 3.1])
    best = max(
        (a * 1.0 + b * 1.9 + c * 3.1 for a in range(7) for b in range(5) for c in range(3) if 2 * a + 3 * b + 5 * c <= 13)
    )
    chosen = packing.knapsack(values, lengths, 13)
    assert sum(n * c for n, c in chosen.items()) <= 13
    assert abs(sum(values[list(lengths).index(n)] * c for n, c in chosen.items()) - best) < 1e-9


def test_lengths_outside_the_capacity_are_errors():
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_ranks_are_dense_for_a_length_of_most_pieces(spark):
    pieces = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 3 = 0, id % 7 + 1, 9L) AS length")
    rows = packing.pack(pieces, ["doc_id"], 20).collect()
    assert len(rows) == 5000 and check_places(rows, 20) <= 2300
