"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of ``K`` words, labelled by occurrence. Each sketch takes the ``L`` labelled k-mers with
the least hashes and keeps them in text order, so that equal sketches speak for a small edit distance and not only for
common k-mers. ``ROWS`` sketches make a band; texts that share a band are candidates.

Copies of a text are one node (its digest). In each band's bucket every node is compared with the bucket's hub, so a
bucket of n texts costs n comparisons and no bucket is cut. The hub is the node that shares most buckets with most
others: the text that a group of near copies was made from agrees with nearly all of them, while two copies may be
too far apart. Then components are formed. Buckets that still hold several components are looked at again, alone and in
pairs: texts at the similarity bound share several bands, and a pair of bands holds few others. In each of these sets two
nodes of each component, the most central one and one by a hash that differs from set to set, are compared with
``len(ORDERS)`` hubs of the set. All of this is partial aggregates, linear in the buckets. Nodes of buckets that even
then hold several components are joined exactly: by their rarest k-mers, of which texts of this similarity must share
one, so that no link between two components of a bucket is lost. A candidate pair is a link if
its k-mers' Jaccard similarity (with occurrences) is ``SIMILARITY`` or more and an alignment inside the band of
diagonals that this similarity allows confirms it (edit similarity of ``SIMILARITY`` or more).

Tables with one row for each bucket are written before a bucket's rows are joined with them, so that a hot bucket's
partition can be split.

Defined results: a text of fewer than K words is one k-mer; texts without words (null, empty) are copies of each other;
``class_id`` is the least doc_id of a class (null if it has none); repeated rows are members like any other; ties between
hubs go to the greater digest; texts of any length are sketched and aligned whole; an empty table gives no rows; other
columns than doc_id and text are not read, and ``dedup`` hands them on unchanged, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, small_batches, table, written

K, L, BANDS, ROWS = 5, 2, 16, 2
SIMILARITY = 0.8
#: The second turn's hubs: the first delegate of a set in each of these orders.
ORDERS = ("central", "draw", "-draw")
#: Key tables of up to this many rows (16-byte digests) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000

_U = np.uint64
_SEEDS = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


class WordHash(dict):
    """64-bit word hashes, the same on every executor; the memo is emptied when full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def kmers(words: list[str], memo: WordHash) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers in text order."""
    if not words:
        return np.zeros(0, _U)
    ids = np.fromiter(map(memo.__getitem__, words), _U, len(words))
    width = min(K, len(ids))
    n = len(ids) - width + 1
    key = np.zeros(n, _U)
    for k in range(width):
        key = _mix(key + ids[k : k + n])
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    start = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if not start.all():
        first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        again = np.zeros(n, _U)
        again[order] = (np.arange(n) - first).astype(_U)
        key = key + again * _U(0xA24BAED4963EE407)
    return key


def bands(key: np.ndarray) -> list[int]:
    """The band hashes of a text's labelled k-mers; texts without words share one band."""
    if not len(key):
        return [0]
    take = min(L, len(key))
    best_hash = best_at = None
    for a in range(0, len(key), 1 << 15):
        h = _mix((key[None, a : a + (1 << 15)] ^ _SEEDS) * _U(0x9FB21C651E98DF25))
        at = np.broadcast_to(np.arange(a, a + h.shape[1]), h.shape)
        if best_hash is not None:
            h, at = np.concatenate([best_hash, h], 1), np.concatenate([best_at, at], 1)
        low = np.argpartition(h, take - 1, axis=1)[:, :take] if h.shape[1] > take else np.broadcast_to(np.arange(h.shape[1]), (h.shape[0], h.shape[1]))
        best_hash, best_at = np.take_along_axis(h, low, 1), np.take_along_axis(at, low, 1)
    kept = np.sort(best_at, axis=1)
    sketch = np.zeros(len(kept), _U)
    for j in range(kept.shape[1]):
        sketch = _mix(sketch * _U(31) + key[kept[:, j]])
    sketch = sketch.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=_U)
    for j in range(ROWS):
        out = _mix(out * _U(0x9FB21C651E98DF25) + sketch[:, j])
    return out.view(np.int64).tolist()


def alignment_distance(a: list, b: list, limit: int) -> int | None:
    """Edit distance of two sequences inside the band of ``limit`` diagonals either way; None if it is over the limit.

    Furthest-reaching points: after d edits only 2d + 1 diagonals are alive, so the cost is that of a band which grows
    with the distance itself.
    """
    while a and b and a[-1] == b[-1]:
        cut = 1
        while cut < min(len(a), len(b)) and a[-cut - 1] == b[-cut - 1]:
            cut += 1
        a, b = a[:-cut], b[:-cut]
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return None
    goal = n - m
    reach = {0: 0}
    for d in range(limit + 1):
        new: dict[int, int] = {}
        for k in range(-d, d + 1):
            if d == 0:
                i = 0
            else:
                i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2))
                if i < 0:
                    continue
            i = min(i, n, m + k)
            j = i - k
            if i < 0 or j < 0:
                continue
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            new[k] = i
        if new.get(goal, -1) >= n:
            return d
        reach = new
    return None


def is_near(a: list[str], b: list[str], memo: WordHash, similarity: float = SIMILARITY) -> bool:
    """Whether two word lists are near duplicates."""
    if a == b:
        return True
    x, y = Counter(kmers(a, memo).tolist()), Counter(kmers(b, memo).tolist())
    n, m = sum(x.values()), sum(y.values())
    if min(n, m) < similarity * max(n, m):
        return False
    common = sum((x & y).values())
    if common < similarity * (n + m - common):
        return False
    return alignment_distance(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9)) is not None


def _digest() -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("digest")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest and band hashes of every document; written."""
    small_batches(docs.sparkSession)

    def load():
        memo = WordHash()

        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            for doc_id, digest, text in rows:
                yield doc_id, digest, bands(kmers(words_of(text), memo))

        return step

    return written(map_rows(docs.select("doc_id", _digest(), F.col("text").cast("string").alias("text")), "doc_id long, digest binary, bands array<long>", load), "sketches")


def keyed(left: DataFrame, keys: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join with a written table of keys: broadcast where its counted rows are few, by shuffle beyond."""
    return left.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b of the candidate pairs (written) that are links."""
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), "needed-texts", compact=True)
    texts = keyed(docs.select(_digest(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), needed, "digest", "left_semi")
    texts = written(texts.groupBy("digest").agg(F.first("text").alias("text")), "candidate-texts")
    left = texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b"))
    small_batches(docs.sparkSession)

    def load():
        memo = WordHash()

        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            last, words = None, []
            for a, b, text_a, text_b in rows:
                if a != last:
                    last, words = a, words_of(text_a)
                if is_near(words, words_of(text_b), memo):
                    yield a, b

        return step

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return map_rows(joined, "a binary, b binary", load)


def components(edges: DataFrame) -> DataFrame:
    """node, root of the nodes of the edges (a, b): large and small stars in turn until nothing moves."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", compact=True)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = written(small, "stars", compact=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def link(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """node, root for each digest that is linked to another one."""
    nodes = sketched.groupBy("digest").agg(F.first("bands").alias("bands"))
    member = nodes.select("digest", F.explode("bands").alias("band"))
    size = written(member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band-sizes", compact=True)
    member = written(keyed(member, size, "band", "inner"), "buckets", compact=True)
    central = member.groupBy("digest").agg(F.sum("n").alias("central"))
    member = written(member.select("band", "digest").join(central, "digest"), "central")

    def edges_to(hubs: DataFrame, others: DataFrame) -> DataFrame:
        joined = keyed(others, written(hubs, "hubs", compact=True), "band", "inner").where("root <> hub_root")
        return joined.select(F.least("hub", "digest").alias("a"), F.greatest("hub", "digest").alias("b")).distinct()

    hubs = member.groupBy("band").agg(F.max(F.struct("central", "digest")).alias("h")).select("band", F.col("h.digest").alias("hub"), F.col("h.digest").alias("hub_root"))
    first = written(edges_to(hubs, member.withColumn("root", F.col("digest"))), "pairs", compact=True)
    links = written(verified(docs, first), "links", compact=True)
    roots = components(links)
    own = member.join(roots, member.digest == roots.node, "left").select("band", "digest", "central", F.coalesce("root", "digest").alias("root"))
    mixed = own.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    near = keyed(own, written(mixed, "mixed-bands", compact=True), "band", "inner").groupBy("digest", "root", "central").agg(F.array_sort(F.collect_set("band")).alias("own"))  # at most BANDS of them
    alone_and_paired = F.expr("concat(own, flatten(transform(own, (x, i) -> transform(slice(own, i + 2, size(own)), y -> xxhash64(x, y)))))")
    near = near.select("digest", "root", "central", F.explode(alone_and_paired).alias("band")).withColumn("draw", F.xxhash64("band", "digest"))
    each = [F.max(F.struct(F.col(first), F.col(then), F.col("digest"))).alias(name) for name, first, then in (("a", "central", "draw"), ("b", "draw", "central"))]
    reps = written(near.groupBy("band", "root").agg(*each), "delegates", compact=True)
    still = reps.groupBy("band").agg(F.count("*").alias("roots")).where("roots > 1").select("band")
    reps = keyed(reps, written(still, "mixed-sets", compact=True), "band", "inner").select("band", "root", F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"{x}.central"), F.col(f"{x}.draw"), F.col(f"{x}.digest")) for x in "ab")))).alias("d"))
    delegates = written(reps.select("band", "root", "d.*"), "delegates", compact=True)
    best = [F.max(F.struct(F.expr(o).alias("o"), "digest", "root")).alias(f"h{i}") for i, o in enumerate(ORDERS)]
    hubs = delegates.groupBy("band").agg(*best).select("band", F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"h{i}.digest").alias("hub"), F.col(f"h{i}.root").alias("hub_root")) for i in range(len(ORDERS)))))).alias("h"))
    second = written(edges_to(hubs.select("band", "h.hub", "h.hub_root"), delegates).join(first, ["a", "b"], "left_anti"), "pairs", compact=True)
    more = written(verified(docs, second), "links", compact=True)
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)
    rest = overlapping(docs, apart(member, roots)).join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti")
    last = written(verified(docs, written(rest, "pairs", compact=True)), "links", compact=True)
    return roots if last.isEmpty() else components(links.unionByName(last))


def apart(member: DataFrame, roots: DataFrame) -> DataFrame:
    """digest, root of the nodes in buckets that hold several components; written."""
    own = member.join(roots, member.digest == roots.node, "left").select("band", "digest", F.coalesce("root", "digest").alias("root"))
    mixed = own.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    return written(keyed(own, written(mixed, "mixed-bands", compact=True), "band", "inner").select("digest", "root").distinct(), "apart", compact=True)


def overlapping(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: every pair of these nodes (written) of different components that can have the similarity; no such pair is left out.

    K-mers are put in one order for all texts: those of a single component first, then from rare to common. Two sets of
    Jaccard t or more have n - ceil(t n) + 1 first k-mers of each (of the smaller set n - ceil(2 t n / (1 + t)) + 1) in
    common, and behind their first common one enough places for the k-mers that both need.
    """
    small_batches(docs.sparkSession)

    def load():
        memo = WordHash()

        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            for digest, root, text in rows:
                own = kmers(words_of(text), memo).view(np.int64).tolist()
                yield digest, root, len(own), own

        return step

    texts = keyed(docs.select(_digest(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), nodes, "digest", "inner")
    sets = map_rows(texts.groupBy("digest", "root").agg(F.first("text").alias("text")), "digest binary, root binary, n int, own array<long>", load)
    each = written(sets, "kmers").select("digest", "root", "n", F.explode("own").alias("kmer"))
    shared = each.groupBy("kmer").agg(F.count("*").alias("of"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("kmer", "of")
    common = each.join(shared, "kmer").groupBy("digest", "root", "n").agg(F.array_sort(F.collect_list(F.struct("of", "kmer"))).alias("common"))  # at most the text's k-mers
    start = common.select("digest", "root", "n", (F.col("n") - F.size("common")).alias("alone"), "common")
    start = start.withColumn("long", F.expr(f"cast(n - ceil({SIMILARITY}D * n - 1e-6D) + 1 as int)")).withColumn("short", F.expr(f"cast(n - ceil({2 * SIMILARITY / (1 + SIMILARITY)}D * n - 1e-6D) + 1 as int)"))
    start = start.where("long > alone").select("digest", "root", "n", "alone", "short", F.posexplode(F.expr("slice(common, 1, long - alone)")).alias("i", "x"))
    start = written(start.select("digest", "root", "n", "short", F.expr("alone + i + 1").alias("at"), F.col("x.kmer").alias("kmer")), "first-kmers", compact=True)
    left = start.where("at <= short").select("kmer", *(F.col(c).alias(f"{c}_a") for c in ("digest", "root", "n", "at")))
    right = start.select("kmer", *(F.col(c).alias(f"{c}_b") for c in ("digest", "root", "n", "at")))
    fits = f"root_a <> root_b AND (n_a < n_b OR n_a = n_b AND digest_a < digest_b) AND n_a >= {SIMILARITY}D * n_b - 1e-6D"
    room = f"1 + least(n_a - at_a, n_b - at_b) >= {SIMILARITY / (1 + SIMILARITY)}D * (n_a + n_b) - 1e-6D"
    pairs = left.join(right, "kmer").where(f"{fits} AND {room}")
    return pairs.select(F.least("digest_a", "digest_b").alias("a"), F.greatest("digest_a", "digest_b").alias("b")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, class_id, class_size and n_texts (different texts of the class) of every document."""
    sketched = sketches(docs)
    roots = link(docs, sketched)
    own = sketched.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    named = own.join(roots, own.digest == roots.node, "left").select("digest", F.coalesce("root", "digest").alias("root"), "least_id", "copies")
    named = written(named, "nodes", compact=True)
    size = named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n_texts"))
    by_digest = named.select("digest", "root").join(size, "root").drop("root")
    return sketched.select("doc_id", "digest").join(by_digest, "digest")


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each class (that of the least doc_id, the least digest among equals), in the columns of ``docs``."""
    found = written(classes(docs), "classes")
    rows = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    keep = rows.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("digest")).alias("other")).agg(F.min("digest").alias("digest"))
    keep = keep.select(F.col("class_id").alias("doc_id"), "digest")
    counted = written(found.groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "copies")
    flagged = counted.alias("c").join(keep.withColumn("keep", F.lit(True)).alias("k"), F.col("c.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("c.digest") == F.col("k.digest")), "left")
    flagged = written(flagged.select(F.col("c.doc_id").alias("__id"), F.col("c.digest").alias("__digest"), "n", F.coalesce("keep", F.lit(False)).alias("keep")), "verdicts")
    columns = [F.col("__row").getField(c).alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("doc_id").alias("__doc"), _digest().alias("__text"))

    def without(bad: DataFrame, how: str) -> DataFrame:
        bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
        return rows.join(bad, rows["__doc"].eqNullSafe(bad["__id"]) & (rows["__text"] == bad["__digest"]), how)

    once = without(flagged.where("NOT keep OR n > 1"), "left_anti").select(*columns)
    again = flagged.where("keep AND n > 1")
    if again.isEmpty():
        return once
    repeated = without(again, "left_semi").dropDuplicates(["__doc", "__text"]).select(*columns)
    return once.unionByName(repeated)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_texts")
