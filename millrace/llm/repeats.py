"""Removal of repeated passages: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

1. Every window of LENGTH bytes has an anchor: the leftmost least-hashed ``GRAM`` bytes in it. Equal windows have equal
   anchors at equal places, so windows need comparing only under one anchor. Consecutive windows with one anchor form a
   segment. Texts are read once for (anchor, segment digest, place); texts themselves do not move.
2. Segments that occur twice or more are repeated whole; those alone under their anchor are not. Counts are partial
   sums, so a passage in a third of all rows costs one counter in each task.
3. What is left are the edges of repeats: single segments under an anchor that has other segments too. A window reaches
   at least HALF bytes beyond its anchor on one side, so segments that share one agree in a digest of the anchor and
   HALF bytes before it or after it. Only segments that agree so with others, one copy of each, are cut from the texts
   and dealt by anchor. Each batch of anchors gets a Burrows-Wheeler transform; breadth-first backward extension of its intervals sets common-prefix values in
   increasing order and stops at LENGTH. Neighbours whose value is still open share LENGTH bytes or more.
4. An anchor whose segments have more than ``BATCH_BYTES`` bytes is not gathered in one task: the 128-bit digests of its
   windows are counted by partial sums, and those counted twice or more are joined back.
5. Covered bytes are merged for each different text and cut.

Tables that a large side is joined with are written first, so that Spark can split a hot key's partition.

Defined results: null and empty texts have no bytes; overlapping repeats count, also within one document; repeated
documents of LENGTH bytes or more lose everything; everything is judged on the input. Texts of any length are read in
blocks of ``BLOCK`` window starts; an empty table gives no rows; ties between least-hashed bytes go to the left; other
columns than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, small_batches, table, written

LENGTH = 400
GRAM = 64
HALF = (LENGTH - GRAM) // 2
#: What one Burrows-Wheeler transform takes at most; it needs some 400 bytes of memory for each.
BATCH_BYTES = 1 << 18
BLOCK = 1 << 20
#: Key tables of up to this many rows (16-byte digests) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (x ^ (x >> _U(29))) * _U(0x9FB21C651E98DF25)


def eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place, as an integer."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").ravel()


def segments(data: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(anchor hash, anchor place, first and last window start) of each run of windows with one anchor."""
    out: list[tuple[int, int, int, int]] = []
    width = length - GRAM + 1
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        raw = np.frombuffer(data, np.uint8)[at : at + BLOCK + length - 1]
        gram, size = eights(raw), 8
        while size < GRAM:
            gram = _mix(_mix(gram[:-size]) + gram[size:])
            size *= 2
        low = (gram & ~_U((1 << 24) - 1)) | np.arange(len(gram), dtype=_U)
        span, least = 1, low
        while 2 * span <= width:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        n = len(raw) - length + 1
        place = (np.minimum(least[:n], least[width - span : width - span + n]) & _U((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        spot = place[first]
        out += zip(gram[spot].view(np.int64).tolist(), (spot + at).tolist(), (first + at).tolist(), (last + at).tolist(), strict=True)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of symbols (int64, last one unique and least) by prefix doubling from packed symbols."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    bits = int(rank.max()).bit_length() + 1
    pack = max(1, 62 // bits)
    if pack > 1 and n > pack:
        key = np.zeros(n, np.int64)
        for k in range(pack):
            key = (key << bits) | np.concatenate([rank[k:] + 1, np.zeros(k, np.int64)])[:n]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        step = pack
    while int(rank.max()) < n - 1:
        after = np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])[:n]
        rank = np.unique(rank * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part the places where a string of ``length`` bytes starts that also starts at another place of the parts.

    Parts end in marks of their own, so nothing crosses them.
    """
    sizes = np.array([len(p) + 1 for p in parts])
    ends = np.cumsum(sizes) - 1
    text = np.zeros(int(sizes.sum()), np.int64)
    body = np.ones(len(text), bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 1
    n = len(text)
    marked = text.copy()
    sa = _ordered(text, ends)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    before = sa - 1
    before[before < 0] = n - 1
    to = rank[before].astype(np.int32)  # last-to-first mapping
    sign = marked[before]
    back = np.empty(n, np.int64)
    back[to] = np.arange(n)
    # the next and previous rank whose preceding sign is the same; marks have none
    by_first = sign[back]
    same = (by_first[1:] == by_first[:-1]) & (by_first[1:] > 0)
    later, sooner = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    later[back[:-1][same]] = back[1:][same]
    sooner[back[1:][same]] = back[:-1][same]
    is_open = np.ones(n + 1, bool)  # common-prefix value of each rank with the one before it not yet known
    is_open[0] = is_open[n] = False
    left, right = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    is_first = True
    for _ in range(length):
        width = right - left + 1
        total = int(width.sum())
        shift = np.repeat(left - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
        at = np.arange(total) + shift
        start = np.sort(to[at[sooner[at] < np.repeat(left, width)]])
        stop = np.sort(to[at[later[at] > np.repeat(right, width)]])
        fresh = is_open[stop + 1]
        is_open[stop[fresh] + 1] = False
        if is_first:  # the last interval's right end is the text's end, which is never open
            fresh[-1] = True
            is_first = False
        left, right = start[fresh].astype(np.int64), stop[fresh].astype(np.int64)
        if not len(left):
            break
    shared = np.flatnonzero(is_open)
    places = np.unique(sa[np.concatenate([shared, shared - 1])])
    owner = np.searchsorted(ends, places)
    begins = ends - sizes + 1
    cut = np.searchsorted(owner, np.arange(len(parts) + 1))
    return [places[cut[i] : cut[i + 1]] - begins[i] for i in range(len(parts))]


def _ordered(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array with each mark less than all bytes and marks in order of place."""
    own = text.copy()
    own[~np.isin(np.arange(len(text)), ends)] += len(ends)
    own[ends] = np.arange(len(ends))
    return suffix_array(own)


def spans_of(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Merged byte spans covered by windows at the sorted starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    first = starts[np.concatenate([[0], gap + 1])]
    last = starts[np.concatenate([gap, [len(starts) - 1]])] + length
    return list(zip(first.tolist(), last.tolist(), strict=True))


def _digest() -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("digest")


def sides(data: bytes, place: int, first: int, last: int, digest) -> tuple[int | None, int | None]:
    """Digests of the anchor with HALF bytes before it and after it, where windows of the run reach so far."""
    before = digest(data[place - HALF : place + GRAM], seed=1) if place - first >= HALF else None
    after = digest(data[place : place + GRAM + HALF], seed=2) if last + LENGTH - place >= GRAM + HALF else None
    return before, after


def anchors(docs: DataFrame) -> DataFrame:
    """digest, key, segment, place, first, last, before, after: every run of windows of every document; written."""
    small_batches(docs.sparkSession)

    def load():
        import xxhash

        def signed(part: bytes, seed: int) -> int:
            return xxhash.xxh3_64_intdigest(part, seed=seed) - (1 << 63)

        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            for digest, data in rows:
                for key, place, first, last in segments(data):
                    before, after = sides(data, place, first, last, signed)
                    yield digest, key, xxhash.xxh3_128_digest(data[first : last + LENGTH], seed=place - first), place, first, last, before, after

        return step

    long_enough = docs.select(_digest(), F.col("text").cast("binary").alias("raw")).where(F.length("raw") >= LENGTH)
    return written(map_rows(long_enough, "digest binary, key long, segment binary, place int, first int, last int, before long, after long", load), "anchors")


def keyed(left: DataFrame, keys: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with a written table of one row for each key: broadcast where its counted rows are few, by shuffle beyond."""
    return left.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """digest, raw: one copy of each needed text. ``needed`` is written; it is broadcast where its counted rows are few."""
    return keyed(docs.select(_digest(), "text"), needed.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("text").cast("binary").alias("raw"))


def _cut_segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, n, bytes (of all wanted segments of the key), digest, place, first, part (bytes) of the wanted segments."""
    by_text = written(wanted.groupBy("digest").agg(F.collect_list(F.struct("key", "n", "bytes", "place", "first", "last")).alias("own")), "edge-places", compact=True)

    def load():
        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            for digest, raw, own in rows:
                for x in own:
                    yield x["key"], x["n"], x["bytes"], digest, x["place"], x["first"], raw[x["first"] : x["last"] + LENGTH]

        return step

    joined = _texts(docs, by_text).join(by_text, "digest").select("digest", "raw", "own")
    return map_rows(joined, "key long, n long, bytes long, digest binary, place int, first int, part binary", load)


def _by_transform(parts: DataFrame) -> DataFrame:
    """digest, start, end: covered bytes found by the transform of batches of whole anchors, ``BATCH_BYTES`` at most."""

    def load():
        def solve(held: list[tuple]) -> Iterator[tuple]:
            found = repeated_starts([h[2] for h in held])
            for (digest, first, _, single), starts in zip(held, found, strict=True):
                if single:
                    for a, b in spans_of(starts):
                        yield digest, first + a, first + b

        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            held: list[tuple] = []
            size, last = 0, None
            for key, n, digest, first, part, total in rows:
                if key != last and held and size + total > BATCH_BYTES:
                    yield from solve(held)
                    held, size = [], 0
                if key != last:
                    size, last = size + total, key
                held.append((digest, first, part, n == 1))
            if held:
                yield from solve(held)

        return step

    dealt = parts.where(F.col("bytes") <= BATCH_BYTES).select("key", "n", "digest", "first", "part", "bytes").repartition("key").sortWithinPartitions("key")
    return map_rows(dealt, "digest binary, start int, end int", load)


def _by_digests(parts: DataFrame) -> DataFrame:
    """digest, start, end: covered bytes under hot anchors, by counts of their windows' digests (partial sums, then a join that can be split)."""

    def load():
        import xxhash

        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            for n, digest, place, first, part in rows:
                for k in range(len(part) - LENGTH + 1):
                    yield xxhash.xxh3_128_digest(part[k : k + LENGTH], seed=place - first - k), digest, first + k, n == 1

        return step

    hot = parts.where(F.col("bytes") > BATCH_BYTES).select("n", "digest", "place", "first", "part")
    windows = written(map_rows(hot, "window binary, digest binary, start int, single boolean", load), "hot-windows", compact=True)
    twice = written(windows.groupBy("window").agg(F.count("*").alias("of")).where("of > 1").select("window"), "repeated-windows", compact=True)
    return keyed(windows.where("single"), twice, "window", "left_semi").select("digest", "start", (F.col("start") + LENGTH).alias("end"))


def covered(docs: DataFrame) -> DataFrame:
    """digest and the sorted, merged covered spans of every different text that has any; written."""
    found = anchors(docs)
    counts = written(found.groupBy("key", "segment").agg(F.count("*").alias("n"), F.min(F.struct("digest", "place", "first", "last", "before", "after")).alias("one")), "segments")
    whole = found.join(counts.where("n > 1").select("key", "segment"), ["key", "segment"], "left_semi").select("digest", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))
    open_keys = written(counts.groupBy("key").agg(F.count("*").alias("many"), F.min("n").alias("least")).where("many > 1 AND least = 1").select("key"), "open-keys", compact=True)
    near = written(keyed(counts, open_keys, "key").select("key", "segment", "n", "one.*"), "open-segments", compact=True)
    side = near.select("key", "segment", "n", F.explode(F.array_compact(F.array("before", "after"))).alias("side"))
    agree = side.groupBy("key", "side").agg(F.count("*").alias("many"), F.min("n").alias("least")).where("many > 1 AND least = 1").select("key", "side")
    kept = written(near.join(side.join(agree, ["key", "side"]).select("key", "segment").distinct(), ["key", "segment"], "left_semi"), "edge-segments", compact=True)
    size = written(kept.groupBy("key").agg(F.sum(F.col("last") - F.col("first") + LENGTH + 1).alias("bytes")), "edge-keys", compact=True)
    wanted = keyed(kept, size, "key").select("key", "n", "bytes", "digest", "place", "first", "last")
    parts = written(_cut_segments(docs, wanted), "edges", compact=True)
    spans = whole.unionByName(_by_transform(parts))
    if not parts.where(F.col("bytes") > BATCH_BYTES).isEmpty():
        spans = spans.unionByName(_by_digests(parts))
    return written(spans.distinct().groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "covered", compact=True)


def merge(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in spans:
        if out and x["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["end"])
        else:
            out.append([x["start"], x["end"]])
    return [tuple(x) for x in out]


def strip(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes kept, of every document."""
    small_batches(docs.sparkSession)
    spans = covered(docs)

    def load():
        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            for digest, raw, own in rows:
                runs = merge(own)
                yield digest, sum(b - a for a, b in runs), len(runs), hashlib.sha256(strip(raw, runs)).hexdigest()

        return step

    cut = map_rows(_texts(docs, spans).join(spans, "digest").select("digest", "raw", "spans"), "digest binary, n_removed long, n_spans long, kept string", load)
    rows = docs.select("doc_id", _digest(), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("sha"))
    out = rows.join(cut, "digest", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages over every document."""
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
win AS (SELECT rid, p, md5(array_slice(raw, p, p + {LENGTH - 1})) AS h FROM (SELECT rid, raw, unnest(range(1, octet_length(raw) - {LENGTH - 2})) AS p FROM doc WHERE octet_length(raw) >= {LENGTH})),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM win WHERE h IN (SELECT h FROM twice)),
grouped AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS g FROM hit),
run AS (SELECT rid, g, min(p) AS first, max(p) + {LENGTH} AS stop FROM grouped GROUP BY rid, g),
gap AS (
  SELECT rid, coalesce(lag(stop) OVER (PARTITION BY rid ORDER BY g), 1) AS first, first - 1 AS last FROM run
  UNION ALL SELECT doc.rid, coalesce(max(stop), 1), octet_length(any_value(raw)) FROM doc LEFT JOIN run ON doc.rid = run.rid GROUP BY doc.rid),
kept AS (SELECT doc.rid, string_agg(hex(array_slice(raw, first, last)), '' ORDER BY first) AS h FROM doc JOIN gap ON doc.rid = gap.rid WHERE first <= last GROUP BY doc.rid),
total AS (SELECT rid, sum(stop - first) AS n_removed, count(*) AS n_spans FROM run GROUP BY rid)
SELECT doc_id, octet_length(raw) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM doc LEFT JOIN kept ON doc.rid = kept.rid LEFT JOIN total ON doc.rid = total.rid
"""
