"""Near-duplicate classes by BagMinHash.

A document is the multiset of its shingles of five words (lower case, signs removed).  Two
documents are linked when their weighted Jaccard similarity, the overlap of the multisets,
is ``SIMILARITY`` or more; classes are the connected components of all links.

Signature.  Every shingle owns Poisson processes over its discretised weight: one for the
interval [0, 1), one for [1, 2), [2, 4), [4, 8) and so on, each as dense as its interval is
wide; a point belongs to a document when it lies below the shingle's count there.  Points
carry a random slot, and a slot's signature is the earliest of its points, so two documents
agree in a slot with a probability equal to their similarity.  Processes are followed in
time only until every slot is filled, which takes few points beyond the first of each shingle.

Classes.  Equal multisets are one node from the start, whatever the number of copies.  Nodes
that agree in a band of the signature share a bucket.  In every bucket all members are
verified against its leader, the member with the largest buckets, which is what a group of
copies has in common; linked nodes are joined.  Where a bucket still holds several
components, members outside the largest one are compared with those of other components, in
parts of bounded size: by their signatures, and by bitmaps of their shingles, which bound the
overlap from above.  The few pairs that stay are verified as well, so no link is lost to the
choice of leaders; members already connected are not compared, and pairs are not written out
before both tests.

Verification is exact, on the whole texts.  Two documents of similarity 0.8 share a band
with a probability of 0.99995, and agree in less than ``LEAST_AGREEING`` slots with one below
1e-5.  A node is named by 64 bits of its multiset.

Defined results: documents with fewer than five words have one shingle of all of them;
documents without a word (or null) are each alone, class_id their own id; the class id is
the least id of the class, nulls aside; equal rows are of one class.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import VALUES_AT_ONCE, free_names, values_of
from tapeloom.session import settle

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
LEAST_AGREEING = 78
#: Bits of the bitmap of a document's shingles; it bounds overlaps well up to about as many shingles.
BITS = 4096
#: Members of a bucket that are compared in one task, on either side.
PART = 1500
#: Shingles handled in one vectorised step, about 100 bytes each.
AT_ONCE = 100_000
SIGNS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def multiset(text: bytes, word_hash: Callable[[bytes], int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their counts."""
    words = text.lower().translate(SIGNS).split() if text.isascii() else text.decode("utf-8", "replace").lower().encode().translate(SIGNS).split()
    h = np.fromiter(map(word_hash, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    total = np.zeros(len(h) - width + 1 if width else 0, np.uint64)
    for j in range(width):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : len(h) - width + 1 + j]
    return np.unique(mixed(total), return_counts=True)


def word_hashes() -> Callable[[bytes], int]:
    """Hashing is as fast as remembering the hashes, and holds nothing."""
    return xxhash.xxh3_64_intdigest


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Size of the overlap and of the union of two multisets."""
    if not len(a[0]) or not len(b[0]):
        return 0, int(a[1].sum() + b[1].sum())
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    overlap = int(np.minimum(a[1][both], b[1][at[both]]).sum())
    return overlap, int(a[1].sum() + b[1].sum()) - overlap


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of SLOTS 32-bit values per non-empty multiset."""
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    shingle = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags])
    # The interval [0, 1) of every shingle, and the doubling ones that its count reaches.
    parts, low = [(np.arange(len(doc)), 0, 1)], 1
    while low < weight.max():
        parts.append((np.flatnonzero(weight > low), low, low))
        low *= 2
    rows = np.concatenate([p[0] for p in parts])
    start = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
    width = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    doc, weight = doc[rows], weight[rows]
    state = mixed(shingle[rows] + STEP * start.astype(np.uint64))
    mass = np.bincount(doc, weight * (start == 0), len(bags))

    best = np.full(len(bags) * SLOTS, np.inf)
    value = np.zeros(len(bags) * SLOTS, np.uint32)
    horizon = SLOTS * (np.log(SLOTS) + 2) / mass
    time = np.zeros(len(doc))
    point = np.zeros(len(doc), np.uint64)

    def advance(i: np.ndarray) -> None:
        point[i] += np.uint64(1)
        uniform = ((mixed(state[i] + STEP * (np.uint64(2) * point[i])) >> np.uint64(11)).astype(float) + 1.0) / 2.0**53
        time[i] -= np.log(uniform) / width[i]

    everything = np.arange(len(doc))
    advance(everything)
    waiting = everything
    while len(waiting):
        now = waiting[time[waiting] <= horizon[doc[waiting]]]
        while len(now):
            drawn = mixed(state[now] + STEP * (np.uint64(2) * point[now] + np.uint64(1)))
            place = start[now] + width[now] * ((drawn >> np.uint64(32)).astype(float) / 2.0**32)
            inside = place < weight[now]
            slot = doc[now] * SLOTS + ((drawn & np.uint64(0xFFFFFFFF)) % np.uint64(SLOTS)).astype(np.int64)
            better = inside & (time[now] < best[slot])
            slot, at, name = slot[better], time[now[better]], mixed(drawn[better]).astype(np.uint32)
            order = np.argsort(-at, kind="stable")  # the earliest of a slot is written last
            best[slot[order]] = at[order]
            value[slot[order]] = name[order]
            advance(now)
            now = now[time[now] <= horizon[doc[now]]]
        unfilled = np.isinf(best.reshape(-1, SLOTS)).any(1)
        horizon[unfilled] *= 1.6
        waiting = waiting[unfilled[doc[waiting]]]
    return value.reshape(-1, SLOTS)


# Documents to nodes.


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, check (64 bits of the multiset each) and signature; the last
    three are null for documents without a word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = word_hashes()
        for batch in batches:
            ids, hashes, bags, size = [], [], [], 0
            for doc_id, text_hash, text in zip(*map(values_of, batch.columns)):
                bag = multiset((text or "").encode("utf-8", "replace"), word_hash)
                ids.append(doc_id)
                hashes.append(text_hash)
                bags.append(bag)
                size += len(bag[0])
                if size >= AT_ONCE:
                    yield _signed_batch(ids, hashes, bags)
                    ids, hashes, bags, size = [], [], [], 0
            yield _signed_batch(ids, hashes, bags)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(sign, "doc_id bigint, text_hash bigint, node bigint, check bigint, signature array<int>")


def _signed_batch(ids: list, hashes: list, bags: list) -> pa.RecordBatch:
    empty = np.array([not len(b[0]) for b in bags], bool)
    filled = [b for b in bags if len(b[0])]
    names = [[int(mixed(h * np.uint64(2 * k + 3) + c.astype(np.uint64) * STEP).sum(dtype=np.uint64)) for h, c in bags] for k in (0, 1)]
    node, check = (pa.array(np.array(n, np.uint64).view(np.int64), mask=empty) for n in names)
    flat = signatures(filled).view(np.int32).ravel() if filled else np.empty(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(np.where(empty, 0, SLOTS))])
    offsets = pa.array(ends.astype(np.int32), mask=np.concatenate([empty, [False]]))
    lists = pa.ListArray.from_arrays(offsets, pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), node, check, lists], ["doc_id", "text_hash", "node", "check", "signature"])


# Links.


def _agreeing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _similar(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures leave a similarity of SIMILARITY possible."""
    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(_agreeing(F.col("sa"), F.col("sb")) >= LEAST_AGREEING).select("a", "b")


def _pack(text: Column) -> Column:
    @F.arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.array([None if t is None else press.compress(t.encode("utf-8", "surrogatepass")) for t in values_of(batch)], pa.binary())

    return pack(text)


def _unpack(packed: Column) -> Column:
    @F.arrow_udf("string")
    def unpack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            parts = [pa.array([], pa.string())]
            for at in range(0, len(batch), VALUES_AT_ONCE):
                part = batch.slice(at, VALUES_AT_ONCE).to_pylist()
                parts.append(pa.array([None if t is None else press.decompress(t).decode("utf-8", "surrogatepass") for t in part], pa.string()))
            yield pa.concat_arrays(parts)

    return unpack(packed)


def _texts(needed: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and packed, the compressed text of one document of each of the nodes."""
    chosen = nodes.join(needed.distinct(), "node").select("node", F.col("row.doc_id").alias("d"), F.col("row.text_hash").alias("h"))
    packed = docs.where("text IS NOT NULL").select("doc_id", "text_hash", _pack(F.col("text")).alias("packed"))
    same = packed["doc_id"].eqNullSafe(chosen["d"]) & (packed["text_hash"] == chosen["h"])
    return packed.join(chosen, same).groupBy("node").agg(F.max("packed").alias("packed"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts overlap enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash, press = word_hashes(), zstandard.ZstdDecompressor()
        last: tuple[int, tuple] | None = None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i, (x, own, other) in enumerate(zip(b, values_of(batch.column(2)), values_of(batch.column(3)))):
                if last is None or last[0] != x:  # pairs of one leader come together
                    last = (x, multiset(press.decompress(other), word_hash))
                overlap, union = similarity(multiset(press.decompress(own), word_hash), last[1])
                if overlap >= SIMILARITY * union - 1e-9:
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in good], pa.int64()) for c in (a, b)], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("pb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(verify, "a bigint, b bigint")


def _bitmaps(needed: DataFrame, texts: DataFrame) -> DataFrame:
    """node, size (shingles) and bitmap (a bit per distinct shingle) of the nodes."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash, press = word_hashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, bitmaps = [], []
            for packed in values_of(batch.column(1)):
                shingles, counts = multiset(press.decompress(packed), word_hash)
                bits = np.zeros(BITS, np.uint8)
                bits[(shingles % np.uint64(BITS)).astype(np.int64)] = 1
                sizes.append(int(counts.sum()))
                bitmaps.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(bitmaps, pa.binary())], ["node", "size", "bitmap"])

    return texts.join(needed.distinct(), "node").mapInArrow(draw, "node bigint, size bigint, bitmap binary")


def _open_pairs(rows: pa.Table) -> pa.Table:
    """Pairs of a straggler and a member of another component that can still be links.

    Every bit that only one of two bitmaps has stands for a shingle that the other document
    lacks, so the overlap is at most the size less the number of such bits.
    """
    column = {name: rows.column(name).to_numpy() for name in ("node", "root", "band", "own", "size", "straggler")}
    bitmap = np.frombuffer(b"".join(rows.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITS // 64)
    signature = np.array(rows.column("signature").to_pylist(), np.int32).reshape(-1, SLOTS)
    left, right = np.flatnonzero(column["straggler"] & column["own"]), np.flatnonzero(~column["own"])
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for i in left:
        x, y = column["node"][i], column["node"][right]
        other = right[(column["root"][right] != column["root"][i]) & (y != x) & (~column["straggler"][right] | (x < y))]
        agree = signature[other] == signature[i]
        near = agree.sum(1) >= LEAST_AGREEING
        other, agree = other[near], agree[near]
        # Each pair in the first of its shared bands only.
        other = other[agree.reshape(-1, BANDS, ROWS).all(2).argmax(1) == column["band"][i]]
        size = column["size"]
        most = np.minimum(
            size[i] - np.bitwise_count(bitmap[i] & ~bitmap[other]).sum(1, dtype=np.int64),
            size[other] - np.bitwise_count(bitmap[other] & ~bitmap[i]).sum(1, dtype=np.int64),
        )
        other = other[most >= SIMILARITY * (size[other] + size[i] - most) - 1e-9]
        pairs.append((np.full(len(other), x), column["node"][other]))
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.empty(0, np.int64) for k in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _between_components(placed: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components of a bucket whose link the leaders leave open."""
    by_root = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    split = by_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    split = split.where("roots > 1 AND n > 2").select(
        "bucket", F.col("main.root").alias("main_root"),
        F.ceil(F.col("n") / PART).cast("int").alias("m"), F.ceil((F.col("n") - F.col("main.n")) / PART).cast("int").alias("k"),
    )
    rest = placed.where("node <> leader").join(split, "bucket").withColumn("straggler", F.col("root") != F.col("main_root"))
    rest = settle(rest)
    known = _bitmaps(rest.select("node"), texts).join(nodes.select("node", "signature"), "node")
    # Members stand in one part each, stragglers meet every part, in parts of their own.
    place = F.xxhash64("node")
    members = rest.withColumns({"own": F.lit(False), "i": F.pmod(place, "m").cast("int")})
    members = members.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    stragglers = rest.where("straggler").withColumns({"own": F.lit(True), "j": F.pmod(place, "k").cast("int")})
    stragglers = stragglers.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    columns = ["bucket", "i", "j", "node", "root", "band", "own", "straggler"]
    both = members.select(columns).unionAll(stragglers.select(columns)).join(known, "node")
    return both.groupBy("bucket", "i", "j").applyInArrow(_open_pairs, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (least node of its component), of nodes with links (a, b).

    Alternates the large and the small star: every node points its larger, then its smaller
    neighbours to the least one, until nothing changes, in about log(longest path) rounds.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settle(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class_key (null without a word) and class_id per row of ``docs``.

    Classes are told apart by class_key; class_id is ambiguous only where ids repeat.
    """
    docs = _keyed(docs)
    rows = settle(signed(docs))
    nodes = rows.where("node IS NOT NULL").groupBy("node", "check").agg(
        F.max("signature").alias("signature"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.min("doc_id").alias("least_id")
    )
    nodes = settle(nodes)
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.slice("signature", i * ROWS + 1, ROWS))).alias("band", "part")
    bands = nodes.select("node", band).select("node", "band", F.xxhash64("band", "part").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = settle(bands.join(shared, "bucket"))
    score = members.groupBy("node").agg(F.sum("size").alias("score"))
    leaders = members.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("best")).select("bucket", F.col("best.node").alias("leader"))
    placed = settle(members.join(leaders, "bucket").select("bucket", "band", "node", "leader"))
    stars = placed.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    near = settle(_similar(stars, nodes))
    # All further steps read the texts of documents that share a bucket, moved once.
    texts = settle(_texts(placed.select("node"), nodes, docs))
    links = settle(_verified(near, texts))
    joined = components(links)

    # What the leaders have not connected: other pairs of a bucket, of different components.
    rooted = placed.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    pairs = settle(_between_components(rooted, nodes, texts))
    if pairs.head(1):
        more = settle(_verified(pairs, texts))
        if more.head(1):
            joined = components(links.unionAll(more))

    of_node = nodes.select("node", "least_id").join(joined, "node", "left").withColumn("class_key", F.coalesce("root", "node"))
    ids = of_node.groupBy("class_key").agg(F.min("least_id").alias("class_id"))
    named = of_node.select("node", "class_key").join(ids, "class_key")
    with_words = rows.where("node IS NOT NULL").select("doc_id", "text_hash", "node").join(named, "node").drop("node")
    alone = rows.where("node IS NULL").select("doc_id", "text_hash", F.lit(None).cast("bigint").alias("class_key"), F.col("doc_id").alias("class_id"))
    return with_words.select(alone.columns).unionAll(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id per row of ``docs``."""
    return classes(docs).select("doc_id", "class_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each class, all columns as they are.

    Of a class the row with the least id stays (nulls first), of several with that id the one
    with the least hash of its text, and one of equal rows.  Documents without a word stay.
    """
    found = settle(classes(docs))
    rows = found.groupBy("class_key", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    row = F.struct("doc_id", "text_hash", "times").alias("row")
    least = rows.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min(row).alias("row")).select("row")
    stays = least.unionAll(rows.where("class_key IS NULL").select(row))
    stay_id, stay_hash, times, row_hash = free_names(docs.columns, "stay_id", "stay_hash", "times", "row_hash")
    stays = stays.select(F.col("row.doc_id").alias(stay_id), F.col("row.text_hash").alias(stay_hash), F.col("row.times").alias(times))
    text = F.col("text").cast("string")
    keyed = docs.withColumns({row_hash: F.xxhash64(text), "text": _pack(text)})

    def staying(which: DataFrame) -> DataFrame:
        same = keyed["doc_id"].cast("bigint").eqNullSafe(which[stay_id]) & (keyed[row_hash] == which[stay_hash])
        return keyed.join(which, same).drop(stay_id, stay_hash, times)

    once = staying(stays.where(F.col(times) == 1))
    again = staying(stays.where(F.col(times) > 1)).dropDuplicates(["doc_id", row_hash])
    return once.unionAll(again).drop(row_hash).withColumn("text", _unpack(F.col("text"))).select(docs.columns)


def oracle() -> str:
    """DuckDB SQL of the query: overlaps of all pairs that share a shingle, and their components."""
    return r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS words FROM documents
), shingles AS (
  SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, least(len(words) + 1, 2)))) AS i FROM texts)
), bags AS (
  SELECT doc_id, shingle, count(*) AS n FROM shingles GROUP BY doc_id, shingle
), sizes AS (
  SELECT doc_id, sum(n) AS size FROM bags GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common
  FROM bags a JOIN bags b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 5 * common >= 4 * (x.size + y.size - common)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reached.a, edges.b FROM reached JOIN edges ON edges.a = reached.b
)
SELECT a AS doc_id, min(b) AS class_id FROM reached GROUP BY a
"""
