"""A hierarchical Pitman-Yor language model over word pairs, trained and applied by Spark.

Every context (the word before, or the start of a text) has a restaurant whose customers are
the words that followed it in the training texts; all these restaurants share one parent,
the restaurant of single words, whose base gives each of the V training words and one
unknown word 1/(V+1).  A table of a context's restaurant is a customer of the parent.

The discount is 1/2.  For it the number of ways in which c customers of one dish sit at t
tables has a closed form, so the sizes of tables are summed out exactly, and a Gibbs step
draws the number of tables of a dish from its full conditional in a time that grows with the
spread of that number, not with c (``draw_tables``).  The dishes of a restaurant are drawn
side by side given its tables so far.  Rounds alternate between the contexts and the parent;
after ``burn_in`` rounds the predictive probabilities are averaged over the rounds.

How it is spread: documents are gathered into chunks of about ``chunk_tokens`` tokens that
hold their distinct words once.  A chunk asks buckets of words and buckets of pairs (a third of
all tokens costs no more than one entry per chunk); a bucket counts, draws tables and
answers.  Contexts with over a thousandth of the training tokens are at most a thousand; their
dishes are spread over all buckets and only their numbers of tables pass through the driver.
Words are told apart by 64 bits of a hash for the base score, and by 48 bits within pairs.

Defined results: null text counts as empty and has its end as only token; a null id is never
held out; repeated rows count and are scored one by one; without training texts every
probability is 1.  Ids are integers.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.language_id import held_out
from tapeloom.session import Scratch, settle

#: Tokens, or words of chunks, for each bucket; at least LEAST_BUCKETS buckets.
PER_BUCKET, LEAST_BUCKETS = 500_000, 64
#: A context with more than this share of the training tokens is spread over all buckets.
HOT_SHARE = 1000
END, START = b"\n", b" "  # neither can be a word

MESSAGE = "level string, dest bigint, kind string, source bigint, data array<binary>"


@dataclass(frozen=True)
class Settings:
    """``strength`` of the contexts' restaurants and of the parent's; rounds of drawing.

    Without ``sweeps`` nothing is drawn and every dish keeps one table, which is interpolated
    Kneser-Ney smoothing.  A text longer than ``chunk_tokens`` is a chunk of its own.
    """

    strength: float = 1.0
    parent_strength: float = 1.0
    rounds: int = 3
    burn_in: int = 1
    sweeps: int = 2
    seed: int = 1
    floor: float = 0.1  # added to each count by the base score
    chunk_tokens: int = 2_000_000


# Tables of a dish.


def draw_tables(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with so many ``customers``, given the other tables of their restaurants.

    With discount 1/2 the weight of k+1 tables is that of k times
    4 (c-k) / (k (2c-k-1)) * (strength + (others+k)/2) * parent, which falls in k: the mode is
    found by bisection and the number is drawn by inversion outwards from it.
    """
    c = customers.astype(np.float64)

    def ratio(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Weight of k+1 over weight of k tables, for the dishes ``i``; 0 beyond the customers."""
        return np.where(k < c[i], 4 * (c[i] - k) / (k * np.maximum(2 * c[i] - k - 1, 1)) * (strength + (others[i] + k) / 2) * parent[i], 0.0)

    tables = np.minimum(customers, 1).astype(np.int64)
    low, high = tables.copy(), customers.astype(np.int64)
    live = np.flatnonzero(high > 1)
    while len(live):
        middle = (low[live] + high[live]) // 2
        up = ratio(live, middle) >= 1
        low[live[up]], high[live[~up]] = middle[up] + 1, middle[~up]
        live = live[low[live] < high[live]]
    mode = low
    live = np.flatnonzero(customers > 1)

    def outwards(i: np.ndarray, left: np.ndarray | None) -> np.ndarray:
        """Summed weights around the mode; with ``left``, where a sum of that much is reached."""
        total, found = np.ones(len(i)), mode[i].copy()
        if left is not None:
            left = left - 1
        for step in (1, -1):
            at = np.arange(len(i)) if left is None else np.flatnonzero(left >= 0)
            k, weight = mode[i[at]].copy(), np.ones(len(at))
            while len(at):
                if step > 0:
                    weight = weight * ratio(i[at], k)
                else:
                    before = ratio(i[at], np.maximum(k - 1, 1))
                    weight = np.where(k > 1, weight / np.where(before > 0, before, 1), 0.0)
                k = k + step
                go = weight > 1e-15
                at, k, weight = at[go], k[go], weight[go]
                total[at] += weight
                if left is not None:
                    left[at] -= weight
                    found[at] = k
                    go = left[at] >= 0
                    at, k, weight = at[go], k[go], weight[go]
        return total if left is None else found

    if len(live):
        total = outwards(live, None)
        tables[live] = outwards(live, rng.random(len(live)) * total)
    return tables


# Messages between chunks and buckets.


def packed(values: Iterable[int] | np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    data = np.ascontiguousarray(values).astype(np.uint64)
    return zstandard.compress(data.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel().astype(np.int64)


@dataclass
class Outbox:
    """Rows of MESSAGE."""

    rows: list[tuple] = field(default_factory=list)

    def send(self, level: str, dest: int, kind: str, source: int, *arrays: np.ndarray) -> None:
        self.rows.append((level, int(dest), kind, int(source), [packed(a) for a in arrays]))

    def batch(self) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary())]
        columns = list(zip(*self.rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["level", "dest", "kind", "source", "data"])


class Inbox:
    """The messages to one bucket or chunk; those of a kind are ordered by their source."""

    def __init__(self, table: pa.Table) -> None:
        self._kinds: dict[str, list[tuple[int, list[np.ndarray]]]] = {}
        for row in table.sort_by("source").to_pylist():
            self._kinds.setdefault(row["kind"], []).append((row["source"], [unpacked(d) for d in row["data"]]))

    def all(self, kind: str) -> list[tuple[int, list[np.ndarray]]]:
        return self._kinds.get(kind, [])

    def one(self, kind: str) -> list[np.ndarray] | None:
        return self._kinds[kind][0][1] if kind in self._kinds else None


def answered(messages: DataFrame, level: str, answer: Callable[[int, Inbox, Outbox], None]) -> DataFrame:
    """One call of ``answer`` per destination of ``level``; what it sends, as messages."""

    def work(table: pa.Table) -> pa.Table:
        out = Outbox()
        answer(table.column("dest")[0].as_py(), Inbox(table), out)
        return pa.Table.from_batches([out.batch()])

    return messages.where(F.col("level") == level).groupBy("dest").applyInArrow(work, MESSAGE)


def each(messages: DataFrame, schema: str, read: Callable[[int, list[np.ndarray]], Iterable[tuple]]) -> DataFrame:
    """Rows that ``read`` makes of each message."""
    names = [part.split()[0] for part in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for r in batch.to_pylist() for x in read(r["dest"], [unpacked(d) for d in r["data"]])]
            yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names)

    return messages.mapInArrow(work, schema)


def slices(sorted_keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(key, slice of its run) of sorted keys."""
    starts = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(sorted_keys)]):
        yield int(sorted_keys[a]), slice(a, b)


# Chunks.


def hashed(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def short(hashes: np.ndarray) -> np.ndarray:
    """The upper 48 bits of hashes, as non-negative longs."""
    return (hashes.view(np.uint64) >> np.uint64(16)).astype(np.int64)


START_48 = hashed(START) >> 16


def chunked(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """Chunks of documents: ids, flags (1 null id, 2 held out), sizes, tokens and words.

    Tokens are numbers of the chunk's words, the commonest first; a text ends with END.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        ids, flags, sizes, flat, known = [], [], [], [], {END: 0}

        def flushed() -> pa.RecordBatch:
            tokens = np.array(flat, np.int64)
            order = np.argsort(-np.bincount(tokens, minlength=len(known)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = list(known)
            hashes = np.array([hashed(words[i]) for i in order], np.uint64)
            out = Outbox()
            out.send("chunk", base + number, "text", -1, np.array(ids, np.int64), np.array(flags), np.array(sizes), rank[tokens], hashes)
            return out.batch()

        for batch in batches:
            for doc_id, text, held in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or "").encode("utf-8", "replace").lower().split()
                if flat and len(flat) + len(words) >= chunk_tokens:
                    yield flushed()
                    number += 1
                    ids, flags, sizes, flat, known = [], [], [], [], {END: 0}
                flat.extend([known.setdefault(w, len(known)) for w in words])
                flat.append(0)
                ids.append(doc_id or 0)
                flags.append((doc_id is None) + 2 * held)
                sizes.append(len(words) + 1)
        if ids:
            yield flushed()

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", held_out(F.col("doc_id"), 10, 0))
    return rows.mapInArrow(gather, MESSAGE)


@dataclass(frozen=True)
class Spread:
    """Numbers of buckets, and contexts (48 bits, sorted) that are spread over all of them."""

    words: int
    pairs: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def pair_bucket(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        mixed = np.where(np.isin(u, self.hot), u * np.int64(31) + w, u).astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(20)) % np.uint64(self.pairs)).astype(np.int64)


def word_order(hashes: np.ndarray, spread: Spread) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket and hash, sorted buckets) of a chunk's words."""
    bucket = short(hashes) % spread.words
    order = np.lexsort((hashes.view(np.uint64), bucket))
    return order, bucket[order]


@dataclass(frozen=True)
class Pairs:
    """A chunk's distinct pairs by bucket, context and word; ``place``: the pair of each token."""

    bucket: np.ndarray
    u: np.ndarray
    w: np.ndarray
    word: np.ndarray
    place: np.ndarray


def pairs_of(sizes: np.ndarray, tokens: np.ndarray, hashes: np.ndarray, spread: Spread) -> Pairs:
    n = len(hashes)
    names = np.append(short(hashes), START_48)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = n
    keys, inverse = np.unique(before * n + tokens, return_inverse=True)
    u, word = names[keys // n], keys % n
    w = names[word]
    bucket = spread.pair_bucket(u, w)
    order = np.lexsort((w, u, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Pairs(bucket[order], u[order], w[order], word[order], rank[inverse])


def runs(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, lengths) of the runs of sorted values."""
    starts = np.flatnonzero(np.diff(u, prepend=-1))
    return u[starts], np.diff(np.append(starts, len(u)))


def asks(chunks: DataFrame, make: Callable[[int, list[np.ndarray], Outbox], None]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = Outbox()
                make(row["dest"], [unpacked(d) for d in row["data"]], out)
                yield out.batch()

    return chunks.mapInArrow(work, MESSAGE)


def trained(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per token whether its document is for training."""
    return np.repeat(flags < 2, sizes)


def word_asks(chunks: DataFrame, spread: Spread) -> DataFrame:
    def make(chunk: int, data: list[np.ndarray], out: Outbox) -> None:
        _, flags, sizes, tokens, hashes = data
        n = np.bincount(tokens[trained(flags, sizes)], minlength=len(hashes))
        order, bucket = word_order(hashes, spread)
        for b, part in slices(bucket):
            out.send("word", b, "ask", chunk, hashes[order[part]], n[order[part]])

    return asks(chunks, make)


def pair_asks(chunks: DataFrame, spread: Spread) -> DataFrame:
    def make(chunk: int, data: list[np.ndarray], out: Outbox) -> None:
        _, flags, sizes, tokens, hashes = data
        pairs = pairs_of(sizes, tokens, hashes, spread)
        n = np.bincount(pairs.place[trained(flags, sizes)], minlength=len(pairs.u))
        for b, part in slices(pairs.bucket):
            out.send("pair", b, "ask", chunk, *runs(pairs.u[part]), pairs.w[part], n[part])

    return asks(chunks, make)


# Buckets.


def parted(values: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(lengths)[:-1])


def count_words(bucket: int, got: Inbox, out: Outbox) -> None:
    """state: training words (hash, count); asked: per chunk 1 + index in the state, 0 unknown."""
    sources = got.all("ask")
    keys = np.concatenate([d[0] for _, d in sources]).view(np.uint64)
    words, inverse = np.unique(keys, return_inverse=True)
    n = np.bincount(inverse, np.concatenate([d[1] for _, d in sources])).astype(np.int64)
    index = np.where(n > 0, np.cumsum(n > 0), 0)[inverse]
    out.send("word", bucket, "state", -1, words[n > 0], n[n > 0])
    for (chunk, data), part in zip(sources, parted(index, [len(d[0]) for _, d in sources])):
        out.send("word", bucket, "asked", chunk, part)


def count_pairs(spread: Spread):
    """state: restaurants and dishes; asked: places in them per chunk; want, sums: to the words.

    A dish with one customer has one table for ever, so only the number of such dishes is
    kept, per context and per word.
    """

    def answer(bucket: int, got: Inbox, out: Outbox) -> None:
        sources = got.all("ask")
        u = np.concatenate([np.repeat(d[0], d[1]) for _, d in sources])
        w = np.concatenate([d[2] for _, d in sources])
        n = np.concatenate([d[3] for _, d in sources])
        order = np.lexsort((w, u))
        fresh = (np.diff(u[order], prepend=-1) != 0) | (np.diff(w[order], prepend=-1) != 0)
        cell = np.empty(len(u), np.int64)
        cell[order] = np.cumsum(fresh) - 1
        c = np.bincount(cell, n, minlength=int(fresh.sum())).astype(np.int64)
        cell_u, cell_w = u[order][fresh], w[order][fresh]
        seen, large = c > 0, c > 1
        # A spread context is listed wherever it is asked for: its numbers come from all buckets.
        contexts = np.unique(np.concatenate([cell_u[seen], np.intersect1d(cell_u, spread.hot)]))
        context = np.searchsorted(contexts, cell_u[seen])
        customers = np.bincount(context, c[seen], minlength=len(contexts))
        singles = np.bincount(context[c[seen] == 1], minlength=len(contexts))
        hot = np.where(np.isin(contexts, spread.hot), np.searchsorted(spread.hot, contexts) + 1, 0)
        # Wanted words by bucket and name.
        wanted = np.unique(cell_w[large])
        wanted = wanted[np.argsort(wanted % spread.words, kind="stable")]
        by_name = np.argsort(wanted)
        dish = by_name[np.searchsorted(wanted[by_name], cell_w[large])] if len(wanted) else np.zeros(0, np.int64)
        one, ones = np.unique(cell_w[c == 1], return_counts=True)
        at = np.argsort(one % spread.words, kind="stable")
        one, ones = one[at], ones[at]
        tables = np.bincount(dish, minlength=len(wanted))
        large_parts, one_parts = dict(slices(wanted % spread.words)), dict(slices(one % spread.words))
        none = slice(0, 0)
        for b in sorted(large_parts.keys() | one_parts.keys()):
            some = one_parts.get(b, none)
            out.send("word", b, "want", bucket, wanted[large_parts.get(b, none)], one[some], ones[some])
            if b in large_parts:
                out.send("word", b, "sums", bucket, tables[large_parts[b]])
        out.send("pair", bucket, "state", -1, customers, singles, hot, context[large[seen]], dish, c[large], np.ones(int(large.sum())), np.zeros(int(large.sum())))
        place = np.where(large, np.cumsum(large) + 1, seen.astype(np.int64))[cell]
        for (chunk, data), part in zip(sources, parted(place, [len(d[2]) for _, d in sources])):
            at = np.minimum(np.searchsorted(contexts, data[0]), max(len(contexts) - 1, 0))
            known = contexts[at] == data[0] if len(contexts) else np.zeros(len(data[0]), bool)
            out.send("pair", bucket, "asked", chunk, part, np.where(known, at + 1, 0))

    return answer


def open_parent(bucket: int, got: Inbox, out: Outbox) -> None:
    """dish: words with the customers from dishes of one customer; wants: places per pair bucket."""
    words = short(got.one("state")[0])
    fixed = np.zeros(len(words), np.int64)
    for source, (wanted, one, ones) in got.all("want"):
        np.add.at(fixed, np.searchsorted(words, one), ones)
        if len(wanted):
            out.send("word", bucket, "wants", source, np.searchsorted(words, wanted))
    out.send("word", bucket, "dish", -1, fixed, np.ones(len(words)), np.zeros(len(words)))


@dataclass(frozen=True)
class Parent:
    """The restaurant of single words: tables, customers, and the base of a word."""

    tables: int
    customers: int
    base: float
    strength: float

    def probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - tables / 2 + (self.strength + self.tables / 2) * self.base) / (self.strength + self.customers)


def parent_step(parent: Parent, settings: Settings, seed: list[int], sample: bool):
    """New tables of the words; answers to the pair buckets; a sample is appended to the dish."""

    def answer(bucket: int, got: Inbox, out: Outbox) -> None:
        fixed, tables, customers, *samples = got.one("dish")
        customers = fixed.copy()
        sums = {source: data[0] for source, data in got.all("sums")}
        for source, (place,) in got.all("wants"):
            np.add.at(customers, place, sums[source])
        if settings.sweeps:
            rng = np.random.default_rng([*seed, bucket])
            tables = draw_tables(customers, parent.tables - tables, np.full(len(fixed), parent.base), parent.strength, rng)
        if sample:
            samples += [customers, tables]
        out.send("word", bucket, "dish", -1, fixed, tables, customers, *samples)
        for source, (place,) in got.all("wants"):
            out.send("pair", source, "answer", bucket, customers[place], tables[place])

    return answer


def context_step(parent: Parent, hot_tables: np.ndarray, settings: Settings, seed: list[int], sample: bool):
    """New tables of the contexts' dishes, and their sums per word to the word buckets."""

    def answer(bucket: int, got: Inbox, out: Outbox) -> None:
        customers, singles, hot, context, dish, c, tables, summed, *samples = got.one("state")
        answers = got.all("answer")
        if answers:
            probability = parent.probability(*(np.concatenate([d[i] for _, d in answers]) for i in (0, 1)))
        rng = np.random.default_rng([*seed, bucket])

        def own() -> np.ndarray:
            return singles + np.bincount(context, tables, minlength=len(singles)).astype(np.int64)

        elsewhere = np.where(hot > 0, np.append(0, hot_tables)[hot] - own(), 0)
        for _ in range(settings.sweeps if answers else 0):
            others = (own() + elsewhere)[context] - tables
            tables = draw_tables(c, others, probability[dish], settings.strength, rng)
        if sample:
            summed = summed + tables
            samples.append(own())
        out.send("pair", bucket, "state", -1, customers, singles, hot, context, dish, c, tables, summed, *samples)
        if answers:
            sums = np.bincount(dish, tables, minlength=len(probability)).astype(np.int64)
            for (source, _), part in zip(answers, parted(sums, [len(d[0]) for _, d in answers])):
                out.send("word", source, "sums", bucket, part)

    return answer


def word_answers(bucket: int, got: Inbox, out: Outbox) -> None:
    """word: per chunk the training count and the samples (customers, tables) of its words."""
    columns = [got.one("state")[1], *got.one("dish")[3:]]
    columns = [np.append(0, column) for column in columns]
    for chunk, (index,) in got.all("asked"):
        out.send("chunk", chunk, "word", bucket, *(column[index] for column in columns))


def pair_answers(hot_customers: np.ndarray, hot_samples: list[np.ndarray]):
    """pair: per chunk customers and summed tables of its dishes, numbers of its restaurants."""

    def answer(bucket: int, got: Inbox, out: Outbox) -> None:
        customers, _, hot, _, _, c, _, summed, *samples = got.one("state")
        whole = [np.where(hot > 0, np.append(0, h)[hot], x) for h, x in zip([hot_customers, *hot_samples], [customers, *samples])]
        c, summed = np.append([0, 1], c), np.append([0, len(samples)], summed)
        whole = [np.append(0, column) for column in whole]
        for chunk, (place, context) in got.all("asked"):
            out.send("chunk", chunk, "pair", bucket, c[place], summed[place], *(column[context] for column in whole))

    return answer


# The whole.


def chunk_scores(spread: Spread, parents: list[Parent], settings: Settings, total: int, words: int):
    """The function chunk -> columns of the result."""

    def score(got: Inbox) -> list[np.ndarray]:
        ids, flags, sizes, tokens, hashes = got.one("text")
        order, _ = word_order(hashes, spread)
        found = [np.concatenate(c) for c in zip(*(d for _, d in got.all("word")))]
        by_word = [np.empty_like(f) for f in found]
        for column, values in zip(by_word, found):
            column[order] = values
        n, *samples = by_word
        pairs = pairs_of(sizes, tokens, hashes, spread)
        answers = [d for _, d in got.all("pair")]
        c, summed = (np.concatenate([d[i] for d in answers]) for i in (0, 1))
        repeats = np.concatenate([runs(pairs.u[part])[1] for _, part in slices(pairs.bucket)])
        customers, *tables = (np.repeat(np.concatenate([d[i] for d in answers]), repeats) for i in range(2, 3 + len(parents)))
        back = np.zeros(len(c))
        for s, parent in enumerate(parents):
            probability = parent.probability(samples[2 * s], samples[2 * s + 1])[pairs.word]
            back += (settings.strength + tables[s] / 2) * probability / len(parents)
        value = np.log10((c - summed / (2 * len(parents)) + back) / (settings.strength + customers))
        floor = settings.floor
        base = np.log10((n + floor) / (total + floor * (words + 1)))
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, starts)
        return [ids, flags, sizes, add((n > 0)[tokens].astype(np.int64)), add(base[tokens]), add(value[pairs.place])]

    return score


def scored(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row of ``docs``.

    Training texts are those whose crc32 of the id leaves a remainder other than 0 by 10.
    """
    if not 0 <= settings.burn_in < settings.rounds:
        raise ValueError("at least one round has to follow the burn-in")
    scratch = Scratch(docs.sparkSession, "pitman-yor")
    try:
        return settle(_scored(docs, settings, scratch))
    finally:
        scratch.remove()


def _total(messages: DataFrame, width: int, read: Callable[[int, list[np.ndarray]], Iterable[tuple]]) -> list[int]:
    names = [f"c{i}" for i in range(width)]
    row = each(messages, ", ".join(f"{c} bigint" for c in names), read).agg(*[F.sum(c) for c in names]).first()
    return [x or 0 for x in row]


def _scored(docs: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    chunks = scratch.keep(chunked(docs, settings.chunk_tokens), "chunks")
    n_tokens, n_words = _total(chunks, 2, lambda _, d: [(len(d[3]), len(d[4]))])
    spread = Spread(max(LEAST_BUCKETS, n_words // PER_BUCKET), max(LEAST_BUCKETS, n_tokens // PER_BUCKET))
    kind = lambda df, *names: df.where(F.col("kind").isin(*names))

    words = scratch.keep(answered(word_asks(chunks, spread), "word", count_words), "words")
    total, distinct = _total(kind(words, "state"), 2, lambda _, d: [(d[1].sum(), len(d[1]))])
    frequent = each(kind(words, "state"), "name bigint", lambda _, d: [(x,) for x in short(d[0][d[1] * HOT_SHARE > total])])
    spread = Spread(spread.words, spread.pairs, np.unique([START_48, *(r.name for r in frequent.collect())]))

    pairs = scratch.keep(answered(pair_asks(chunks, spread), "pair", count_pairs(spread)), "pairs")
    opened = kind(words, "state").unionByName(kind(pairs, "want"))
    parents_table = scratch.keep(answered(opened, "word", open_parent), "parent")
    wants = kind(parents_table, "wants")
    dishes, states, sums = kind(parents_table, "dish"), kind(pairs, "state"), kind(pairs, "sums")

    def hot_total(states: DataFrame, value: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
        """Per context spread over the buckets the sum of ``value`` over its restaurants' parts."""
        rows = each(states, "number bigint, n bigint", lambda _, d: [(h, x) for h, x in zip(d[2][d[2] > 0], value(d)[d[2] > 0])])
        out = np.zeros(len(spread.hot), np.int64)
        for r in rows.groupBy("number").agg(F.sum("n").alias("n")).collect():
            out[r.number - 1] = r.n
        return out

    def tables_of(d: list[np.ndarray]) -> np.ndarray:
        return d[1] + np.bincount(d[3], d[6], minlength=len(d[1])).astype(np.int64)

    parent, samples = Parent(distinct, 0, 1 / (distinct + 1), settings.parent_strength), []
    for turn in range(settings.rounds + 1):
        sample = turn > settings.burn_in
        step = parent_step(parent, settings, [settings.seed, 0, turn], sample)
        drawn = scratch.keep(answered(dishes.unionByName(wants).unionByName(sums), "word", step), f"parent{turn}")
        dishes = kind(drawn, "dish")
        tables, customers = _total(dishes, 2, lambda _, d: [(d[1].sum(), d[2].sum())])
        parent = Parent(tables, customers, parent.base, parent.strength)
        if sample:
            samples.append(parent)
        if turn < settings.rounds:
            hot = hot_total(states, tables_of)
            step = context_step(parent, hot, settings, [settings.seed, 1, turn], turn >= settings.burn_in)
            moved = scratch.keep(answered(states.unionByName(kind(drawn, "answer")), "pair", step), f"contexts{turn}")
            states, sums = kind(moved, "state"), kind(moved, "sums")

    hot_customers = hot_total(states, lambda d: d[0])
    hot_samples = [hot_total(states, lambda d, i=i: d[8 + i]) for i in range(len(samples))]
    for_words = kind(words, "state", "asked").unionByName(dishes)
    for_pairs = states.unionByName(kind(pairs, "asked"))
    answers = answered(for_words, "word", word_answers).unionByName(answered(for_pairs, "pair", pair_answers(hot_customers, hot_samples)))
    score = chunk_scores(spread, samples, settings, total, distinct)

    def rows(table: pa.Table) -> pa.Table:
        ids, flags, sizes, known, base, value = score(Inbox(table))
        columns = [
            pa.array(ids, pa.int64(), mask=flags % 2 == 1), pa.array(flags > 1), pa.array(sizes), pa.array(known),
            pa.array(np.full(len(ids), total)), pa.array(base), pa.array(value),
        ]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return chunks.unionByName(answers).where("level = 'chunk'").groupBy("dest").applyInArrow(rows, schema)
