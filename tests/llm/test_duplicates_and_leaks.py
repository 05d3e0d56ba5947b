from __future__ import annotations

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from tapeloom.llm import bag_minhash, benchmark_decontamination, substring_dedup
from tests.llm import cases


# Near-duplicates.


def bag(text):
    words = text.lower().encode().translate(bag_minhash.SIGNS).split()
    width = min(5, len(words))
    out: dict = {}
    for i in range(len(words) - width + 1 if width else 0):
        key = tuple(words[i : i + width])
        out[key] = out.get(key, 0) + 1
    return out


def plain_classes(texts):
    """Least index of the component of links of weighted Jaccard 0.8, by all pairs."""
    bags, root = [bag(t or "") for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            overlap = sum(min(n, b.get(k, 0)) for k, n in a.items())
            if a and b and overlap >= 0.8 * (sum(a.values()) + sum(b.values()) - overlap) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def edited(words, r, share):
    words = list(words)
    for _ in range(int(share * len(words))):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_classes_are_the_components_of_all_links(spark):
    r = random.Random(4)
    texts = []
    for group in range(8):
        base = cases.prose(1000 + group, r.choice([30, 120, 300])).split()
        texts += [edited(base, r, r.choice([0, 0.005, 0.01, 0.02, 0.03])) for _ in range(12)]
    chain = cases.prose(55, 200).split()  # neighbours are alike, the ends are not
    texts += [" ".join(chain[k * 12 :] + [f"tail{i}" for i in range(k * 12)]) for k in range(8)]
    texts += ["one two three", "One, two three!", "one two", "a a a a a a a a", "a a a a a a a a a", None, "", "  ", "..."]
    r.shuffle(texts)
    rows = bag_minhash.near_duplicates(cases.frame(spark, texts, range(len(texts)))).collect()
    assert {x.doc_id: x.class_id for x in rows} == dict(enumerate(plain_classes(texts)))


def test_members_far_from_the_leader_are_still_linked(spark):
    # A star of copies around a base that is not there, so that pairs decide.
    r = random.Random(9)
    base = cases.prose(77, 400).split()
    texts = [edited(base, r, 0.012) for _ in range(25)]
    rows = bag_minhash.near_duplicates(cases.frame(spark, texts, range(25))).collect()
    assert {x.doc_id: x.class_id for x in rows} == dict(enumerate(plain_classes(texts)))


def test_near_duplicates_of_odd_rows(spark):
    got = sorted((r.doc_id or -1, r.class_id or -1) for r in bag_minhash.near_duplicates(cases.odd(spark)).collect())
    assert got == [(-1, -1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (5, 5), (6, 6), (6, 6), (7, 7)]
    kept = bag_minhash.deduplicated(cases.odd(spark))
    assert kept.columns == cases.odd(spark).columns
    # One of the equal rows of id 5 goes; the two texts of id 6 are different documents.
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 6, 7]
    assert bag_minhash.near_duplicates(cases.empty(spark)).count() == 0
    assert bag_minhash.deduplicated(cases.empty(spark)).count() == 0


def test_hashes_of_words_are_not_held():
    word_hash = bag_minhash.word_hashes()
    tracemalloc.start()
    try:
        for i in range(100):
            shingles, _ = bag_minhash.multiset(" ".join(f"w{i}x{j}" for j in range(2000)).encode(), word_hash)
            assert len(shingles) == 1996
        assert tracemalloc.get_traced_memory()[0] < 1e6
    finally:
        tracemalloc.stop()


def test_matches_reads_its_texts_once():
    index = benchmark_decontamination.Index([1], [benchmark_decontamination.words("a b c d e f")])
    texts = ["x a b c d e f", None, "y"]
    assert index.matches(iter(texts)) == index.matches(texts) == [[(1, 1, 6, 0)], [], []]


def test_signatures_estimate_weighted_similarity():
    r, cache = random.Random(2), bag_minhash.word_hashes()
    left, right, truth = [], [], []
    for n in range(200):
        words = [f"w{r.randrange(900)}" for _ in range(r.choice([6, 40, 400]))]
        other = edited(words + words[: len(words) // 3] * (n % 4), r, 0.02)
        a, b = (bag_minhash.multiset(t.encode(), cache) for t in (" ".join(words), other))
        overlap, union = bag_minhash.similarity(a, b)
        left.append(a), right.append(b), truth.append(overlap / union)
    agree = (bag_minhash.signatures(left) == bag_minhash.signatures(right)).mean(1)
    truth = np.array(truth)
    assert abs((agree - truth).mean()) < 0.01
    assert np.sqrt(((agree - truth) ** 2).mean()) < 1.25 * np.sqrt((truth * (1 - truth) / bag_minhash.SLOTS).mean())


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_links(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = {x: x for link in links for x in link}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in bag_minhash.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: y for x, y in root.items() if any(x in link and link[0] != link[1] for link in links)}


# Repeated passages.


def plain_removal(rows):
    texts = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first: dict = {}
    for i, words in texts:
        for k in range(len(words) - 49):
            key = tuple(words[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - 49):
            if i is not None and first[tuple(words[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i if i is not None else -1, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def removal(frame):
    rows = substring_dedup.without_duplicates(frame).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows)


def test_removed_words_are_those_of_repeated_windows(spark):
    r = random.Random(8)
    passages = [cases.prose(200 + k, r.choice([49, 50, 51, 80, 300])).split() for k in range(6)]
    rows = []
    for i in range(60):
        words = cases.prose(500 + i, r.choice([0, 10, 60, 200])).split()
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            cut = r.randrange(len(p))
            part = p[cut:] if r.random() < 0.3 else p[: max(40, len(p) - cut)]
            at = r.randrange(len(words) + 1)
            words[at:at] = part
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words)))
    rows += [(100, "same word " * 100), (101, "same word " * 70), (102, "word same " * 70), (103, "spam " * 60), (104, "spam " * 49), (7, rows[3][1]), (7, rows[3][1])]
    r.shuffle(rows)
    got = removal(cases.frame(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert got == plain_removal(rows)
    assert sum(x[2] for x in got) > 500


def test_removal_of_odd_rows(spark):
    rows = [*zip(cases.ODD_IDS, cases.ODD_TEXTS), (None, cases.ODD_TEXTS[0]), (9, cases.ODD_TEXTS[0]), (0, cases.prose(8, 60))]
    got = removal(cases.frame(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert got == plain_removal(rows)
    assert substring_dedup.without_duplicates(cases.empty(spark)).count() == 0


# Benchmark leaks.


def plain_distance(goal, words):
    """Least edit distance of ``goal`` to any stretch of ``words``."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(goal, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_recall_against_all_edit_distances(spark):
    r = random.Random(6)
    common = "the of and to in a is that for it".split()
    items = [(i, " ".join(r.choice(common) if r.random() < 0.4 else w for w in cases.prose(300 + i, r.choice([14, 25, 40, 59])).split())) for i in range(20)]
    texts = []
    for _ in range(250):
        words = benchmark_decontamination.words(r.choice(items)[1])
        words = [w.decode() for w in words]
        for _ in range(int(r.choice([0, 0.1, 0.2, 0.2, 0.3]) * len(words))):
            k, kind = r.randrange(len(words)), r.randrange(3)
            words[k : k + 1] = [[], ["and"], [words[k], "in"]][kind]
        texts.append(cases.prose(r.randrange(10**6), 30) + " " + " ".join(words).upper() + "!! " + cases.prose(r.randrange(10**6), 30))
    texts += [cases.prose(7000 + i, 100) for i in range(20)] + [" ".join(r.choice(common) for _ in range(300)) for _ in range(10)]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in benchmark_decontamination.contaminated(cases.frame(spark, texts, range(len(texts))), frame).collect()}
    truth = set()
    for d, text in enumerate(texts):
        words = benchmark_decontamination.words(text)
        for i, item in items:
            goal = benchmark_decontamination.words(item)
            if plain_distance(goal, words) <= benchmark_decontamination.slack(len(goal)):
                truth.add((d, i))
    assert got <= truth and len(got) >= 0.97 * len(truth) and len(truth) > 100


def test_leaks_of_odd_rows(spark):
    items = spark.createDataFrame([(1, cases.prose(1, 20)), (2, None), (3, ""), (4, "zq17"), (5, "alpha beta"), (6, cases.prose(1, 20)), (None, "gamma delta")], "item_id bigint, text string")
    texts = [*cases.ODD_TEXTS, "x zq17 y", "say Alpha, beta!", "alpha gamma beta", "gamma delta"]
    docs = cases.frame(spark, texts, [*cases.ODD_IDS, 20, 21, 22, 23])
    got = sorted((x.doc_id, x.item_id or -1, x.distance) for x in benchmark_decontamination.contaminated(docs, items).collect())
    assert got == [(1, 1, 0), (1, 6, 0), (20, 4, 0), (21, 5, 0), (23, -1, 0)]
    clean = benchmark_decontamination.uncontaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(x.doc_id or -1 for x in clean.collect()) == [-1, 2, 3, 4, 5, 5, 6, 6, 7, 22]
    assert benchmark_decontamination.contaminated(cases.empty(spark), items).count() == 0
    assert benchmark_decontamination.contaminated(docs, items.where("false")).count() == 0
    assert benchmark_decontamination.uncontaminated(docs, items.where("false")).count() == docs.count()


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(benchmark_decontamination, "BLOCK_ITEMS", 2)
    items = spark.createDataFrame([(i, cases.prose(900 + i, 20)) for i in range(5)], "item_id bigint, text string")
    docs = cases.frame(spark, [cases.prose(900 + i, 20) + " end" for i in range(5)], range(5))
    got = sorted((x.doc_id, x.item_id) for x in benchmark_decontamination.contaminated(docs, items).collect())
    assert got == [(i, i) for i in range(5)]
    assert benchmark_decontamination.uncontaminated(docs, items).count() == 0


@pytest.mark.parametrize("length, before", [(50, 35), (20, 14), (30, 21), (80, 56), (10, 7)])
@pytest.mark.parametrize("between", [0, 5, 20])
def test_leaks_after_a_part_of_themselves(length, before, between):
    item = cases.prose(31, length).replace(".", "").split()
    index = benchmark_decontamination.Index([1], [[w.encode() for w in item]])
    text = " ".join(item[:before] + cases.prose(32, between).split() + item)
    assert index.matches([text]) == [[(1, before + between, length, 0)]]


def test_filter_counts_pairs_per_window():
    r = random.Random(6)
    items = [[r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.choice([6, 9, 15]))] for _ in range(5)]
    index = benchmark_decontamination.Index(list(range(5)), items)
    code = np.array([r.randrange(index.base) for _ in range(400)], np.int64)
    kept = dict((n, set(s.tolist())) for n, s in index.windows(code))
    for n in index.lengths.tolist():
        d = benchmark_decontamination.slack(n)
        most: dict = {}
        for t in index.coded:
            if len(t) == n:
                pairs = list(zip(t.tolist(), t.tolist()[1:]))
                most |= {p: max(most.get(p, 0), pairs.count(p)) for p in pairs}
        for start in range(len(code)):
            window = code[start : start + n + d].tolist()
            pairs = list(zip(window, window[1:]))
            shared = sum(min(pairs.count(p), most.get(p, 0)) for p in set(pairs))
            assert (start in kept.get(n, set())) == (shared >= max(1, n - 1 - 2 * d))
