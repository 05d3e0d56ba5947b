from __future__ import annotations

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import pii_surrogates as pii
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def rewritten(spark, texts, key="k"):
    rows = pii.anonymised(cases.frame(spark, texts, range(len(texts))), key).collect()
    return [t for _, t in sorted((r.doc_id, r.text) for r in rows)]


def test_surrogates_keep_kind_and_format(spark):
    texts = [
        "mail Jo.Doe7@Corp.Example.org, or JO.DOE7@CORP.EXAMPLE.ORG!",
        "call +1 (652) 555-4544 or +1-652-555-4544 or (652) 555-4544",
        "card 4111 1111 1111 1111, 4111111111111111; order 4111111111111112",
        "host 10.200.3.44. version 2.0.1 and 300.1.1.1",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
        "Mrs. Anna Smith met Mr. Bob Smith; Mr. Smith left. господин Иван Петров и госпожа Анна Иванова",
    ]
    mail, phone, card, host, token, names = rewritten(spark, texts)
    a, b = re.findall(r"\S+@[\w.]+\w", mail)
    assert a.upper() == b and a.endswith(".org") and re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}\d@[A-Z][a-z]{3}\.[A-Z][a-z]{6}\.org", a) and "doe" not in mail.lower()
    one, two, three = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1-\d{3}-\d{3}-\d{4}|(?<!1 )\(\d{3}\) \d{3}-\d{4}", phone)
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) != "16525554544" and "555-4544" not in phone and len(three) == 14
    spaced, plain = re.findall(r"card (.{19}), (\d{16});", card)[0]
    assert spaced.replace(" ", "") == plain != "4111111111111111" and luhn(plain) and plain[0] == "4" and card.endswith("order 4111111111111112")
    assert re.fullmatch(r"host \d\d\.[12]\d\d\.\d\.\d\d\. version 2\.0\.1 and 300\.1\.1\.1", host) and "10.200.3.44" not in host
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', token) and "24be6443" not in token
    found = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+); Mr\. (\w+) left\. господин (\w+) (\w+) и госпожа (\w+) (\w+)", names)
    anna, smith, bob, smith2, smith3, ivan, petrov, anna2, ivanova = found.groups()
    assert anna.endswith("a") and bob.endswith("o") and smith == smith2 and "Smith" not in names
    assert all(re.fullmatch("[А-Яа-я]+", w) for w in (ivan, petrov, anna2, ivanova)) and anna2.endswith("а") and ivan.endswith("н")


def test_texts_without_mentions_and_odd_rows(spark):
    docs = cases.odd(spark)
    out = pii.anonymised(docs, "k")
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    assert pii.anonymised(cases.empty(spark), "k").count() == 0
    long = "x" * 300_000 + " a@b.example " + "1" * 300_000 + " " + "." * 100_000
    same = rewritten(spark, [long, long, "a@b.example", None, ""])
    assert same[0] == same[1] and "a@b.example" not in same[0] and len(same[0]) == len(long) and same[2] in same[0] and same[3:] == [None, ""]


def test_surrogates_stay_distinct_where_a_kind_is_crowded(spark):
    # All one-digit addresses ending in 0..9: most first draws meet another entity.
    entities = [f"{a}.{b}.{c}.{d}" for a in range(6) for b in range(10) for c in range(10) for d in range(10)]
    frame = spark.createDataFrame([("address", e) for e in entities], "kind string, entity string")
    rows = pii.distinct_surrogates(frame, "k").collect()
    assert sorted(r.entity for r in rows) == sorted(entities)
    shown = [r.surrogate for r in rows]
    assert len(set(shown)) == len(shown) and not set(shown) & set(entities)


def test_another_key_gives_other_surrogates(spark):
    text = ["a.person@host.example"]
    assert rewritten(spark, text, "k") == rewritten(spark, text, "k") != rewritten(spark, text, "other")


def test_mentions_of_the_documents_are_replaced(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in pii.anonymised(docs, "k").collect()}
    pattern = re.compile(r"[\w.]+@[\w.]+\w|\+\d \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|\b[0-9a-fA-F]{38,40}\b")
    pairs: dict[str, set[str]] = {}
    for i, text in before.items():
        old, new = pattern.findall(text), pattern.findall(after[i])
        assert len(old) == len(new) and pattern.sub("", text) == pattern.sub("", after[i])
        for x, y in zip(old, new):
            if re.fullmatch(r"\d{16}", x) and not luhn(x):
                assert x == y
            else:
                pairs.setdefault(x.lower(), set()).add(y.lower())
    assert pairs and all(len(v) == 1 for v in pairs.values())
    shown = [next(iter(v)) for v in pairs.values()]
    assert len(set(shown)) == len(shown) and not set(shown) & set(pairs)


def test_stages_keep_columns_and_agree_with_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
        if name != "packing":
            assert docs.columns == columns
    sizes = [d.count() for d in seen]
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] and sizes[4] >= sizes[3]
    whole = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, seen[-1].select(key).collect()))


@pytest.mark.parametrize("make", [cases.odd, cases.empty])
def test_stages_take_odd_tables(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns, name
        out.count()


def test_near_dedup_stage_keeps_one_of_each_group(spark):
    texts = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:60]
    docs = cases.frame(spark, texts * 3, range(len(texts) * 3))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    rows = kept.select("doc_id", F.lower("text").alias("t")).collect()
    assert max(r.doc_id for r in rows) < len(texts) and len({r.t for r in rows}) == len(rows)


def test_long_secrets_and_addresses_after_long_runs(spark):
    key = "0123456789abcdef" * 8
    dashes, dots, name = "-" * 70, "." * 70, "anna.b" * 20
    texts = [key, key[:65].upper(), "aB1" * 50_000, f"{dashes}joe@x.com", "joe@x.com", f"call 652-555-4544{dots}joe@x.com", f"{name}@x.com", f"{dashes}{name}@x.com", dashes]
    sha, half, mixed, rule, plain, leader, long, both, none = rewritten(spark, texts)
    assert re.fullmatch("[0-9a-f]{128}", sha) and sha != key
    assert re.fullmatch("[0-9A-F]{65}", half) and half != key[:65].upper()
    assert re.fullmatch("[0-9a-fA-F]{150000}", mixed) and mixed != texts[2]
    assert plain != "joe@x.com" and rule == dashes + plain
    assert re.fullmatch(r"call \d{3}-\d{3}-\d{4}", leader.removesuffix(dots + plain)) and "555" not in leader
    assert len(long) == len(texts[6]) and "anna" not in long and both == dashes + long and none == dashes


def test_parts_of_names_and_domains_keep_one_surrogate(spark):
    letters = "abcdefghij"
    hosts = [f"{a}{b}.com" for a in letters for b in letters]
    texts = ["Mrs. Anna Smith and Mrs. Smith", "Mr. Smith and Mr. Anna Smith", "Ms. Smith Anna"] + [f"me@{h} you@{h}" for h in hosts]
    first, second, third, *mails = rewritten(spark, texts)
    anna, smith, alone = re.fullmatch(r"Mrs\. (\w+) (\w+) and Mrs\. (\w+)", first).groups()
    alone2, him, smith2 = re.fullmatch(r"Mr\. (\w+) and Mr\. (\w+) (\w+)", second).groups()
    assert smith == alone == alone2 == smith2 and him != anna
    given, surname = re.fullmatch(r"Ms\. (\w+) (\w+)", third).groups()
    assert len({anna, him, smith, given, surname, "Anna", "Smith"}) == 7
    pairs = [re.fullmatch(r"(\S+)@(\S+) (\S+)@(\S+)", m).groups() for m in mails]
    assert all(a == b and x != y for x, a, y, b in pairs)
    shown = {a for _, a, _, _ in pairs}
    assert len(shown) == len(hosts) and not shown & set(hosts) and all(h.endswith(".com") for h in shown)


def test_names_used_inside_may_be_columns(spark):
    inside = ["_found", "_hash", "_of", "_map", "_row_hash", "_stay_id", "_stay_hash", "_times", "__found", "_HASH_"]
    docs = cases.frame(spark, ["mail a.b@c.example", "mail a.b@c.example", None, cases.prose(3, 60)], [1, 1, 2, 3])
    docs = docs.withColumns({name: F.lit(k) for k, name in enumerate(inside)})
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.replace_personal_data):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and len(out.collect()) in (3, 4)
        assert {tuple(r[n] for n in inside) for r in out.collect()} == {tuple(range(len(inside)))}
