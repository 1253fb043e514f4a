"""Lexical search: full text (stemmed, cover density) and trigram similarity, mixed 0.7 to 0.3."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import STOP_WORDS, stem
from ..functions.text import trigrams

FTS_WEIGHT, TRIGRAM_WEIGHT = 0.7, 0.3
TRIGRAM_THRESHOLD = 0.18
#: Up to so many keys are sent to every task to leave out texts before they are split; they are counted first.
BROADCAST_KEYS = 2_000_000
_WORD = re.compile(r"[^\W_]+")


def trigram_postings(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """The trigram index: (gram, key, n), n being the chunk's number of distinct trigrams. Write it once, query it often."""
    rows = chunks.select(key, trigrams(F.col(text)).alias("grams"))
    return rows.select(key, F.size("grams").alias("n"), F.explode("grams").alias("gram"))


def trigram_scores(postings: DataFrame, query: str, key: str = "chunk_id") -> DataFrame:
    """key, trigram of every chunk that shares a trigram with the query: an index probe and a partial count, no scan of texts."""
    spark = postings.sparkSession
    own = spark.range(1).select(F.explode(trigrams(F.lit(query))).alias("gram"))
    size = own.count()
    hit = postings.join(F.broadcast(own), "gram").groupBy(key, "n").agg(F.count("*").alias("both"))
    return hit.select(key, F.round(F.col("both") / (F.col("n") + size - F.col("both")), 6).alias("trigram"))


def trigram_scan(chunks: DataFrame, query: str, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """key, trigram as by ``trigram_scores``, for texts without an index: one pass over the rows, nothing exploded or shuffled."""
    own = chunks.sparkSession.range(1).select(trigrams(F.lit(query)).alias("grams")).first().grams
    wanted = F.array(*map(F.lit, own)).cast("array<string>")
    counts = F.transform(F.array(trigrams(F.col(text))), lambda g: F.struct(F.size(g).alias("n"), F.size(F.array_intersect(g, wanted)).alias("both")))
    # a generator, because a filter would be pushed below the counts and split each text a second time
    hit = chunks.select(key, F.inline(F.filter(counts, lambda c: c["both"] > 0)))
    return hit.select(key, F.round(F.col("both") / (F.col("n") + len(own) - F.col("both")), 6).alias("trigram"))


def parse_query(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Web-search syntax: alternatives of (negated, phrase lexemes); ``or`` splits, ``-`` negates, quotes make phrases."""
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        if word == "or" and not minus:
            groups.append([])
            continue
        lexemes = [stem(w) for w in _WORD.findall(phrase or word) if w not in STOP_WORDS]
        if lexemes:
            groups[-1].append((bool(minus), lexemes))
    return [g for g in groups if g]


def positions(text: str | None) -> dict[str, list[int]]:
    """Lexemes with their places; stop words take a place but have none."""
    out: dict[str, list[int]] = {}
    for i, word in enumerate(_WORD.findall((text or "").lower()), 1):
        if word not in STOP_WORDS:
            out.setdefault(stem(word), []).append(i)
    return out


def _phrase_at(own: dict[str, list[int]], lexemes: list[str]) -> list[int]:
    places = [set(own.get(x, ())) for x in lexemes]
    return sorted(p for p in places[0] if all(p + k in s for k, s in enumerate(places)))


def fts_score(own: dict[str, list[int]], query: list[list[tuple[bool, list[str]]]]) -> tuple[bool, float]:
    """Match and cover-density rank: each minimal cover of all wanted lexemes adds 0.1 / (1 + noise words inside)."""
    matched, rank = False, 0.0
    for group in query:
        hits = [(negated, _phrase_at(own, lexemes)) for negated, lexemes in group]
        if not all(bool(at) != negated for negated, at in hits):
            continue
        matched = True
        wanted = sorted({x for negated, lexemes in group if not negated for x in lexemes})
        events = sorted((p, x) for x in wanted for p in own[x])
        last: dict[str, int] = {}
        seen_start = 0
        for p, x in events:
            last[x] = p
            if len(last) == len(wanted):
                start = min(last.values())
                if start > seen_start:
                    seen_start = start
                    rank += 0.1 / (1 + (p - start + 1 - len(wanted)))
    return matched, rank


def surely_in(lexeme: str) -> str:
    """A string that is in every word of the stem: stemming changes the last sign or the last two, the rest is kept."""
    return lexeme[: max(1, len(lexeme) - (2 if lexeme.endswith("ie") else 1))] if len(lexeme) > 2 else lexeme[:1]


def fts_scores(chunks: DataFrame, query: str, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """key, fts (rank) of the chunks that match the query, from their texts."""
    parsed = parse_query(query)
    plain = [sorted({x for negated, lexemes in g if not negated for x in lexemes}) for g in parsed]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, *fts_score(positions(t), parsed)) for k, t in zip(frame[key], frame[text], strict=True)]
            yield pd.DataFrame([(k, round(r, 6)) for k, m, r in found if m], columns=[key, "fts"])

    rows = chunks.select(key, text)
    if plain and all(plain):  # most chunks never reach Python
        low = F.lower(F.col(text))
        rows = rows.where(reduce(or_, (reduce(and_, (low.contains(surely_in(x)) for x in g)) for g in plain)))
    return rows.mapInPandas(run, f"{key} {chunks.schema[key].dataType.simpleString()}, fts double")


def stem_postings(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """The full-text index: (lexeme, key, places). Write it once, query it often; texts are stemmed here and never again."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(x, k, at) for k, t in zip(frame[key], frame[text], strict=True) for x, at in positions(t).items()]
            yield pd.DataFrame(rows, columns=["lexeme", key, "places"])

    return chunks.select(key, text).mapInPandas(run, f"lexeme string, {key} {chunks.schema[key].dataType.simpleString()}, places array<int>")


def fts_scores_indexed(postings: DataFrame, query: str, key: str = "chunk_id") -> DataFrame:
    """key, fts (rank) of the chunks that match the query, by the index. Each alternative needs a word that is not negated."""
    parsed = parse_query(query)
    if not all(any(not negated for negated, _ in g) for g in parsed):
        raise ValueError("an alternative of negated words alone matches chunks that the index does not list; use fts_scores")
    wanted = sorted({x for g in parsed for _, lexemes in g for x in lexemes})

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, *fts_score({x["lexeme"]: list(x["places"]) for x in own}, parsed)) for k, own in zip(frame[key], frame["own"], strict=True)]
            yield pd.DataFrame([(k, round(r, 6)) for k, m, r in found if m], columns=[key, "fts"])

    hit = postings.where(F.col("lexeme").isin(wanted)).groupBy(key).agg(F.collect_list(F.struct("lexeme", "places")).alias("own"))  # at most the query's lexemes
    return hit.mapInPandas(run, f"{key} {postings.schema[key].dataType.simpleString()}, fts double")


def search(chunks: DataFrame, postings: DataFrame | None, query: str, limit: int, threshold: float = TRIGRAM_THRESHOLD, key: str = "chunk_id", text: str = "content", fts: bool = True, stems: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """key, fts, trigram, similarity: candidates match or are similar; the limit comes before the second filter, as in the contract.

    ``postings`` and ``stems`` are the stored trigram and full-text indexes; without them the texts are read. ``within``
    has the keys that the chunks are joined with: their scores are, after the scan of the texts. No text is shuffled.
    """
    if within is not None and within.count() <= BROADCAST_KEYS:  # beyond it all texts are scanned, with the same result
        chunks = chunks.join(F.broadcast(within.select(key)), key, "left_semi")

    def joined(scores: DataFrame) -> DataFrame:
        return scores if within is None else scores.join(within.select(key).hint("merge"), key)

    grams = joined(trigram_scan(chunks, query, key, text) if postings is None else trigram_scores(postings, query, key))
    if fts:
        both = grams.join(joined(fts_scores(chunks, query, key, text) if stems is None else fts_scores_indexed(stems, query, key)), key, "full_outer").fillna(0.0, ["trigram"])
        rows = both.withColumn("is_match", F.col("fts").isNotNull()).fillna(0.0, ["fts"])
    else:
        rows = grams.withColumns({"fts": F.lit(0.0), "is_match": F.lit(False)})
    rows = rows.where(F.col("is_match") | (F.col("trigram") > threshold)).withColumn("similarity", F.round(FTS_WEIGHT * F.col("fts") + TRIGRAM_WEIGHT * F.col("trigram"), 6))
    top = rows.orderBy(F.desc("similarity"), key).limit(limit)
    return top.where((F.col("fts") > 0) | (F.col("trigram") > threshold)).select(key, "fts", "trigram", "similarity")


def fts_postings(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """The word index without stemming: (term, key, positions)."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    rows = chunks.select(key, F.posexplode(found).alias("place", "term"))
    return rows.groupBy("term", key).agg(F.array_sort(F.collect_list(F.col("place") + 1)).alias("positions"))


def fts_match(postings: DataFrame, terms: list[str], key: str = "chunk_id") -> DataFrame:
    """key, n_hits of the chunks that have all the terms, by the index."""
    wanted = sorted(set(terms))
    return postings.where(F.col("term").isin(wanted)).groupBy(key).agg(F.count("*").alias("n"), F.sum(F.size("positions")).alias("n_hits")).where(F.col("n") == len(wanted)).select(key, "n_hits")


def rank_window(by: list[str], key: str = "chunk_id") -> Window:
    return Window.partitionBy(*by).orderBy(F.desc("similarity"), key)
