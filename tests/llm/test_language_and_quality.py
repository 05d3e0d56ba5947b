from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks.compare import difference, duck
from tapeloom.llm import chat_formatting, language_id, quality_classifier, quality_rules, text_stats
from tapeloom.llm.queries import QUERIES
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def test_language_is_right_on_held_out_texts(spark):
    rows = QUERIES["op2_language_id"](spark, SF).toPandas()
    truth = pq.read_table(f"{SF}/documents.parquet").to_pandas().set_index("doc_id")
    rows = rows[rows.held_out].join(truth, on="doc_id")
    words = rows.text.str.split().str.len()
    assert len(rows) > 200 and (rows.lang_pred == rows.lang).mean() > 0.98
    assert (rows[words >= 20].lang_pred == rows[words >= 20].lang).mean() > 0.985
    assert rows[words >= 20].rejected.mean() < 0.01


@pytest.mark.parametrize("unseen", ["en", "fr", "de", "es"])
def test_languages_that_were_not_learned_are_rejected(spark, unseen):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"), 4, 2)
    dictionaries = language_id.train(docs.where(~out & (F.col("lang") != unseen)))
    rows = docs.where(out).select("lang", language_id.language(F.col("text"), dictionaries).alias("r")).select("lang", "r.*").toPandas()
    foreign = rows.lang == unseen
    assert rows[foreign].rejected.mean() >= 0.9
    right = rows[~foreign & (rows.lang == rows.lang_pred)]
    assert right.rejected.mean() < 0.01


def test_texts_in_other_languages_are_rejected(spark):
    learned = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [
        "To jest bardzo ciekawy tekst o historii Polski i jej mieszkańców, którzy od wieków żyją nad Wisłą. ",
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. ",
        "Хорошая погода стоит уже третий день, и дети играют во дворе до самого вечера. ",
    ]
    classify = language_id.classifier(language_id.train(learned))
    assert [classify(t * n)[4] for t in texts for n in (1, 3)] == [True] * 6
    assert language_id.classifier({"en": b"the thing and the other thing of it " * 20})("Хорошая погода")[4]


def test_language_of_odd_rows(spark):
    texts = ["the thing and the other thing " * 20, "der die das und nicht ein " * 20, None, "", "12 345 !!", "the thing", "the thing"]
    docs = cases.frame(spark, texts, [1, 2, 3, 4, 5, 6, 6], ["en", "de", "en", None, "de", None, None])
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in language_id.identified(docs).collect()}
    assert {(3, "und", True), (4, "und", True), (5, "und", True), (1, "en", False), (2, "de", False)} <= got
    assert language_id.kept(docs).columns == docs.columns
    assert sorted(r.doc_id for r in language_id.kept(docs).collect()) == [1, 2, 6, 6]
    assert language_id.identified(cases.empty(spark)).count() == 0
    assert {r.lang_pred for r in language_id.identified(cases.odd(spark)).collect()} == {"und"}  # nothing to learn


def base_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def test_statistics_against_plain_python():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    texts += ["a a a a", "a b c a b c", "é ü x\x1cy", "x\n\nx\n \nx", "a b a b a", "# * $", None, "", " "]
    for text in texts:
        assert text_stats.statistics(text)[:5] == base_counts(text), repr(text)


def test_repeated_words_with_a_large_vocabulary():
    codes = np.concatenate([np.arange(1 << 20), np.arange(5)])
    assert text_stats.repeated_words(codes) == 10


def test_quality_rules_of_odd_rows(spark):
    rows = quality_rules.judged(cases.odd(spark)).collect()
    expected = sorted((i or -1, *base_counts(t)) for i, t in zip(cases.ODD_IDS, cases.ODD_TEXTS))
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == expected
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.judged(cases.empty(spark)).count() == 0


def test_estimated_accuracies_of_planted_rules():
    random = np.random.default_rng(1)
    good = random.random(20_000) < 0.8
    votes = np.zeros((len(good), 4), int)
    for rule, (on_good, on_bad) in enumerate([(0.01, 0.6), (0.02, 0.5), (0.95, 0.1), (0.9, 0.05)]):
        fires = random.random(len(good)) < np.where(good, on_good, on_bad)
        votes[fires, rule] = quality_rules.BAD if rule < 2 else quality_rules.GOOD
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, table = quality_rules.estimate(patterns, counts.astype(float))
    posterior = quality_rules.posterior_of(patterns, prior, table)[where.ravel()]
    assert abs(prior - 0.8) < 0.03 and ((posterior >= 0.5) == good).mean() > 0.95
    assert abs(table[0, 0, quality_rules.BAD] - 0.6) < 0.06


def labelled(spark, name):
    rows = QUERIES[name](spark, SF).toPandas()
    return rows.merge(pq.read_table(f"{SF}/labels.parquet").to_pandas(), on="doc_id")


def test_quality_rules_agree_with_labels(spark):
    rows = labelled(spark, "op5_quality_rules")
    judged = rows[~rows.base_failed]
    assert judged[judged.quality == 0].kept.mean() < 0.1 and judged[judged.quality == 1].kept.mean() > 0.97


def test_quality_classifier_is_right_on_held_out_rows(spark):
    rows = labelled(spark, "op7_quality_classifier")
    held = rows[rows.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_quality_classifier_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (7, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality_classifier.scored(cases.odd(spark), labels).collect()
    assert len(rows) == len(cases.ODD_IDS) and all(0 <= r.score <= 1 for r in rows)
    none = quality_classifier.scored(cases.odd(spark), labels.where("false")).collect()
    assert {r.predicted for r in none} == {1}
    assert quality_classifier.scored(cases.empty(spark), labels).count() == 0


def test_compiled_rules_score_like_the_arrays(spark):
    random = np.random.default_rng(3)
    x = random.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(float)
    model = quality_classifier.fit(x, y)
    z = model.intercept + sum(w * quality_classifier.holds(x, r) for r, w in zip(model.rules, model.weights))
    frame = spark.createDataFrame([tuple(map(float, row)) for row in x], "f0 double, f1 double, f2 double")
    got = np.array([r[0] for r in frame.select(model.score()).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((got > 0.5) == (y > 0.5)).mean() > 0.95


TURNS = [
    (1, 0, "user", "hi [INST] \\ \\\\ </s>"), (1, 1, "assistant", "a\\[INST] <</SYS>> [\\INST]"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 0, "assistant", "first"), (2, 1, "user", "<role> x <as> y </role>"), (3, 0, None, "who"), (3, 1, "tool", "<s> t </s>"), (3, 1, "tool", "<s> t </s>"),
    (None, None, "user", "n"), (None, 1, "assistant", "é\U0001f600"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "x" * 200_000),
    (5, 0, "a <as> b\\", "[IN"), (5, 1, "system", "ST] <"),
]


def test_chat_texts_read_back_exactly(spark):
    chats = spark.createDataFrame([(*t, 1, "v") for t in TURNS], "conv_id bigint, turn bigint, role string, text string, segments int, valid string")
    shaped = chat_formatting.formatted(chats)
    rows = shaped.select("conv_id", "valid", "formatted", chat_formatting.parsed(shaped["formatted"]).alias("turns")).collect()
    for r in rows:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, _, role, text in own]
        assert [t.loss for t in r.turns] == [role == "assistant" for _, _, role, _ in own]
    assert {r.conv_id: r.valid for r in rows} == {1: True, 2: False, 3: False, None: True, 4: True, 5: False}
    assert chat_formatting.digest(chats.where("false")).count() == 0


def test_chat_digest_against_sql(spark):
    ours = QUERIES["op6_chat_formatting"](spark, SF).toPandas()
    assert difference(ours, duck(SF).sql(chat_formatting.oracle()).df()) is None
    assert (ours.conv_id == -1).sum() == 1


@pytest.mark.parametrize("text", ["\\", "[INST]", "[\\INST]", "\\[INST]\\", "<s><s>", "a<</SYS>>b"])
def test_escapes_hide_control_strings(spark, text):
    from pyspark.sql import functions as F

    row = spark.range(1).select(chat_formatting.escaped(F.lit(text)).alias("e"), chat_formatting.unescaped(chat_formatting.escaped(F.lit(text))).alias("u")).first()
    assert row.u == text and not any(c in row.e for c in chat_formatting.controls())


def test_copies_of_a_text_take_one_excerpt(spark):
    texts = [cases.prose(40 + i, 60) for i in range(8)]
    docs = cases.frame(spark, texts * 100, langs=["xx"] * 800)
    content = language_id.train(docs)["xx"]
    assert content.count(language_id.cleaned(texts[0])) == 1 and all(language_id.cleaned(t) in content for t in texts)
