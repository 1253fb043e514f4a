"""Benchmark decontamination by a generalised suffix automaton.

The test items are normalised to words and put into a generalised suffix automaton that every executor gets once.
Training documents stream through it: after each word the automaton holds the longest suffix of the document that is a
substring of some item, so a match of ``window`` words is seen when its last word is read. One pass, constant memory
beside the automaton, no shuffle at all. A benchmark of more than ``PART_WORDS`` words is dealt over several automata,
one pass each, whose hits are united; the result is the same.

Defined results: null or empty texts have no words and no hits; an item without words is ignored; an item of
fewer than ``window`` words is one window; repeated documents are judged each; several items with one id count
once; items without an id mark words as hit but are not counted; an empty benchmark hits nothing and an empty table
gives no rows; texts of any length are read whole; other columns than doc_id and text are not read and come through
``decontaminate`` unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_rows, small_batches, table, written

WINDOW = 8
#: Words of the items in one broadcast automaton, which has at most two states for each (some 50 MB for 100,000 words).
PART_WORDS = 200_000
#: Documents whose share of hit words exceeds this are dropped by the pipeline stage even with one item.
MAX_COVERAGE = 0.5

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, every other ASCII sign than letters and digits separates."""
    return raw.translate(_TABLE).split() if raw else []


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items of each ``window``-long substring."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        kept = []
        for name, words in items:
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                kept.append((name, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        n = len(self.next)
        self.items: list[set | None] = [None] * n
        self.short: list[list[tuple[int, str | None]] | None] = [None] * n
        for name, ids in kept:
            state = length = 0
            for w in ids:
                state, length = self.next[state][w], length + 1
                if length >= window:
                    at = state
                    while self.length[self.link[at]] >= window:
                        at = self.link[at]
                    if self.items[at] is None:
                        self.items[at] = set()
                    self.items[at].add(name)
            if len(ids) < window:
                if self.short[state] is None:
                    self.short[state] = []
                self.short[state].append((len(ids), name))
        self.any_short = any(self.short)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, w)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = twin
            p = link[p]
        return twin

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal runs of hit words as (start, end), and the names of the items with an occurring window."""
        known, nxt, link, length, window = self.vocabulary.get, self.next, self.link, self.length, self.window
        runs: list[list[int]] = []
        found: set = set()
        state = size = 0
        for i, word in enumerate(words):
            w = known(word)
            if w is None:
                state = size = 0
                continue
            while w not in nxt[state]:
                state = link[state]
                if state == -1:
                    break
                size = length[state]
            if state == -1:
                state = size = 0
                continue
            state = nxt[state][w]
            size += 1
            reach = 0
            if size >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found |= self.items[at]
                reach = window
            if self.any_short:
                at = state
                while at > 0:
                    for n, name in self.short[at] or ():
                        if n <= size:
                            found.add(name)
                            reach = max(reach, n)
                    at = link[at]
            if reach:
                start = i + 1 - reach
                while runs and runs[-1][0] >= start:
                    runs.pop()
                if runs and runs[-1][1] >= start:
                    runs[-1][1] = i + 1
                else:
                    runs.append([start, i + 1])
        return [tuple(r) for r in runs], found


def item_parts(benchmark: DataFrame, window: int = WINDOW, most: int = PART_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items' words in parts of ``most`` words at most, read one by one on the driver.

    A longer item is cut into pieces that overlap by a window less one word, so that each window lies in one piece.
    """
    part: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("raw")).toLocalIterator():
        words = words_of(bytes(r.raw) if r.raw is not None else None)
        for at in range(0, max(1, len(words) - window + 1), most):
            piece = words[at : at + most + window - 1]
            if part and size + len(piece) > most:
                yield part
                part, size = [], 0
            part.append((r.item, piece))
            size += len(piece)
    if part:
        yield part


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs, merged where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def through(docs: DataFrame, benchmark: DataFrame, window: int, schema: str | StructType, emit: Callable[[dict, bytes | None, list[bytes], list[tuple[int, int]], set], Iterator[tuple]]) -> DataFrame:
    """What ``emit`` gives for each document from its row, bytes, words, hit runs and names of hit items.

    A benchmark of up to ``PART_WORDS`` words is one automaton and one pass. A larger one is a pass for each part over
    the written documents with what was hit so far, so that no worker holds more than one part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("binary").alias("raw"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("runs"), F.lit(None).cast("array<string>").alias("names"), F.lit(False).alias("unnamed"))
    parts = item_parts(benchmark, window)
    part = next(parts, [])
    while True:
        after = next(parts, None)
        shared = spark.sparkContext.broadcast(SuffixAutomaton(part, window))

        def load(shared=shared, last=after is None):
            automaton = shared.value

            def step(source: Iterable[tuple]) -> Iterator[tuple]:
                for row, raw, before, names, unnamed in source:
                    words = words_of(raw)
                    runs, found = automaton.scan(words)
                    if before:
                        runs = joined([*runs, *((x["start"], x["end"]) for x in before)])
                    found = found | set(names or ()) | ({None} if unnamed else set())
                    if last:
                        yield from emit(row, raw, words, runs, found)
                    else:
                        yield row, raw, [{"start": a, "end": b} for a, b in runs], sorted(found - {None}), None in found

            return step

        if after is None:
            return map_rows(rows, schema, load)
        rows = written(map_rows(rows, rows.schema, load), "benchmark-part")
        part = after


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids) and runs (hit word runs) of every document."""

    def emit(row: dict, raw: bytes | None, words: list[bytes], runs: list[tuple[int, int]], found: set) -> Iterator[tuple]:
        names = sorted(found - {None})
        yield row["doc_id"], len(words), sum(b - a for a, b in runs), len(names), names, [{"start": a, "end": b} for a, b in runs]

    schema = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, runs array<struct<start:int,end:int>>"
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return through(rows, benchmark, window, schema, emit)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = 2, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The documents without benchmark passages, in the columns of ``docs``.

    A document with windows of ``min_items`` items, or with more than ``max_coverage`` of its words hit, goes. In the
    others each run of hit words is cut from the text, from the run's first to its last byte.
    """
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    columns = docs.columns

    def emit(row: dict, raw: bytes | None, words: list[bytes], runs: list[tuple[int, int]], found: set) -> Iterator[tuple]:
        if runs:
            if len(found - {None}) >= min_items or sum(b - a for a, b in runs) > max_coverage * len(words):
                return
            places = [m.span() for m in word.finditer(raw.translate(_LOWER))]
            kept, last = [], 0
            for a, b in runs:
                kept.append(raw[last : places[a][0]])
                last = places[b - 1][1]
            row = row | {"text": b"".join([*kept, raw[last:]]).decode("utf-8", "replace")}
        yield tuple(row[c] for c in columns)

    return through(docs, benchmark, window, docs.schema, emit)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item; the digest columns of the contract."""
    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(8, len(w)) AS m, array_to_string(w[p : p + least(8, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS p FROM item WHERE len(w) > 0)),
dw AS (
  SELECT rid, m, p, array_to_string(w[p : p + m - 1], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM doc, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hit AS (SELECT dw.rid, dw.m, dw.p, iw.item FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
covered AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
