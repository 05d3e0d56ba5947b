from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import importance_resampling as resampling
from tapeloom.llm import vector_codes as codes
from tapeloom.llm.common import values_of
from tests.llm import cases


def runs(text, settings):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = [" ".join(words[i : i + n]) for n in range(settings.shortest, settings.longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(x.encode()) % settings.buckets for x in out]


def drawn_by_hand(docs, target, percent, least, settings):
    """(id, features, weight, score, rank) per document, formula by formula."""
    source, aim = Counter(), Counter()
    for _, t in docs:
        source.update(runs(t, settings)[1])
    for t in target:
        aim.update(runs(t, settings)[1])
    k, s_all, t_all = settings.buckets, sum(source.values()), sum(aim.values())
    rows = []
    for i, t in docs:
        n, buckets = runs(t, settings)
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (s_all + k) / ((source[b] + 1) * (t_all + k)))) for b in buckets)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0], r[2]))
    ranks = {id(r): at + 1 for at, r in enumerate(order[: percent * len(order) // 100])}
    return sorted(((r[0], *r[2:], ranks.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize("settings", [resampling.Settings(), resampling.Settings(1, 3, 500), resampling.Settings(2, 2, 50)])
def test_resampling_agrees_with_the_formulas(spark, settings):
    r = random.Random(1)
    docs = [(i, cases.prose(i % 60, r.randrange(60), 200).replace("b", "B")) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "É é Ç\x00x 日本 a-b\n_C"), (1003, cases.LONG), (1004, docs[0][1]), (1004, docs[0][1])]
    target = [cases.prose(i, 80, 200) for i in range(12)]
    frame = cases.frame(spark, [t for _, t in docs], [i for i, _ in docs])
    rows = resampling.resampling(frame, spark.createDataFrame([(t,) for t in target], "text string"), 30, 20, settings=settings)
    found = sorted(((x.doc_id, x.n_features, x.weight, x.score, x["rank"]) for x in rows.collect()), key=repr)
    assert found == drawn_by_hand(docs, target, 30, 20, settings)


def test_features_do_not_depend_on_the_batch(monkeypatch):
    settings, texts = resampling.Settings(1, 3, 500), [cases.prose(i, i % 7 * 9) for i in range(60)] + [None, "a", "", "b c"]
    monkeypatch.setattr(resampling, "BATCH_BYTES", 700)
    parts = list(resampling.reader(settings)(texts))
    assert len(parts) > 5
    at = 0
    for part in parts:
        for i, n in enumerate(part.words):
            words, buckets = runs(texts[at], settings)
            assert n == words and sorted(part.bucket[part.text == i]) == sorted(buckets)
            at += 1
    assert at == len(texts)


def test_a_worker_holds_few_words_at_a_time():
    texts = [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(800)]  # 3 MB, all words distinct
    features = resampling.reader(resampling.Settings())
    tracemalloc.start()
    try:
        n = sum(len(part.bucket) for part in features(texts))
        assert n == 400_000 and tracemalloc.get_traced_memory()[1] < 24e6
    finally:
        tracemalloc.stop()
    column = pa.array([None, "", *texts[:200]])
    assert list(values_of(column)) == column.to_pylist()
    assert list(values_of(column.slice(0, 0))) == []


def test_resampling_of_odd_and_empty_tables(spark):
    target = spark.createDataFrame([("kon taba 12",), (None,)], "text string")
    rows = resampling.resampling(cases.odd(spark), target, 50)
    assert rows.count() == len(cases.ODD_TEXTS)
    assert sorted(x["rank"] for x in rows.where("rank IS NOT NULL").collect()) == [1, 2, 3]
    assert {(x.n_features, x.weight) for x in rows.where("doc_id IN (2, 3, 4)").collect()} == {(0, 0)}
    assert resampling.resampling(cases.empty(spark), target, 50).count() == 0
    assert resampling.resampling(cases.odd(spark), target.limit(0), 50).count() == len(cases.ODD_TEXTS)


def test_resampled_rows_are_the_ranked_ones(spark):
    docs = cases.frame(spark, [cases.prose(i, 40, 300) for i in range(200)])
    target = spark.createDataFrame([(cases.prose(3, 90, 300),)], "text string")
    drawn = {r.doc_id for r in resampling.resampling(docs, target, 10).where("rank IS NOT NULL").collect()}
    kept = resampling.resampled(docs, target, 10)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == drawn and len(drawn) == 20
    assert resampling.resampled(cases.empty(spark), target, 10).count() == 0


@pytest.mark.parametrize("size,entries,spread", [(4, 64, 40), (1, 7, 3), (3, 1, 5), (2, 30, 2)])
def test_orchard_search_is_exact_and_ties_go_down(size, entries, spread):
    r = np.random.default_rng(size)
    book, x = r.integers(-spread, spread, (entries, size)), r.integers(-2 * spread, 2 * spread, (3000, size))
    apart = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    entry, distance = codes.Orchard(book).nearest(x)
    assert (entry == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()


def by_hand(rows, settings):
    """Codes, errors and final entries by plain loops; rows are (id, vector)."""
    whole = [(i, [math.floor(settings.scale * x) for x in v]) for i, v in rows]
    size = len(whole[0][1]) // settings.parts
    cut = [[v[p * size : (p + 1) * size] for p in range(settings.parts)] for _, v in whole]
    first: dict[int, list] = {}
    for (i, v), parts in sorted(zip(whole, cut), key=lambda t: (t[0][0] is None, t[0])):
        if i is not None:
            first.setdefault(i, parts)
    books = [[parts[p] for _, parts in sorted(first.items())[: settings.entries]] for p in range(settings.parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(settings.rounds):
        for p in range(settings.parts):
            groups: dict[int, list] = {}
            for parts in cut:
                groups.setdefault(nearest(p, parts[p])[1], []).append(parts[p])
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    found = [[nearest(p, parts[p]) for p in range(settings.parts)] for parts in cut]
    return [(i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near)) for (i, _), near in zip(whole, found)], books


def test_codes_agree_with_plain_loops(spark):
    settings, r = codes.Settings(parts=4, entries=8, rounds=2), random.Random(5)
    good = [(i * 3, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    good += [(300, good[7][1]), (300, good[7][1]), (None, good[9][1]), (0, [9.0] * 8)]
    bad = [(500, None), (501, []), (502, [1.0] * 7 + [None]), (503, [float("nan")] * 8), (504, [float("inf")] + [0.0] * 7), (505, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, None if i is None else i % 3 or None, "x", 1) for i, v in good + bad], "vec_id bigint, embedding array<double>, label int, code string, error int")
    out = codes.compressed(table, settings).collect()
    expected, books = by_hand(good, settings)
    assert sorted(((x.vec_id, x.code, x.error) for x in out), key=repr) == sorted(expected, key=repr)
    sums = Counter()
    for x in out:
        sums[x.label] += x.error
    assert all(x.label_error == sums[x.label] for x in out) and None in sums
    text = ",".join(str(c) for book in books for e in book for c in e)
    assert {x.codebooks_sha256 for x in out} == {hashlib.sha256(text.encode()).hexdigest()}


def test_codes_of_empty_few_and_large_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert codes.compressed(spark.createDataFrame([], schema)).count() == 0
    assert codes.compressed(spark.createDataFrame([(None, [0.5] * 16, 1), (1, None, 1)], schema)).count() == 0
    rows = codes.compressed(spark.createDataFrame([(1, [0.5] * 16, 1), (2, [3e38] * 16, 1)], schema)).collect()
    assert [(r.error, r.label_error) for r in rows] == [(0, 0)] * 2
    with pytest.raises(ValueError):
        codes.compressed(spark.createDataFrame([(1, [0.5] * 15, 1)], schema))


def test_every_label_gets_its_sum_when_one_is_hot(spark):
    rows = spark.range(9000).select((F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id"))).cast("int").alias("label"), F.col("id").alias("error"))
    out = codes.with_totals(rows)
    wrong = out.groupBy("label").agg(F.sum("error").alias("s"), F.min("label_error").alias("a"), F.max("label_error").alias("b")).where("s <> a OR s <> b")
    assert out.count() == 9000 and wrong.count() == 0


def test_decoded_vectors_are_close(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + r.normal(scale=0.01, size=8)).tolist(), 0) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    books = codes.fit(table.select("vec_id", "embedding"), codes.Settings(parts=2, entries=32))
    out = table.select("vec_id", codes.encoded(F.col("embedding"), books)["code"].alias("code")).orderBy("vec_id").collect()
    decoded = books.decode(np.array([list(bytes.fromhex(x.code)) for x in out]))
    assert np.abs(decoded - np.array([v for _, v, _ in rows])).max() < 0.1
