"""The retrieval plan: rewrite gate, branches, fusion, reranking, provenance.

Three plans: one vector branch; original and rewritten vector branches with two-branch fusion; and the hybrid one with
up to four branches and weighted reciprocal ranks. The choice is made on the driver from the settings and the gate;
each plan is one DataFrame that ends in a bounded top-k, so only ``limit`` (or the reranker's candidates) rows move.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Retrieval
from ..functions.text import anchor_url, rewrite_gate
from . import fusion, lexical, rerank, vector
from .models import embed_text, rank_by_overlap, rewrite_words, with_deadline, with_retries

LOG = logging.getLogger(__name__)


@dataclass
class Corpus:
    """chunks: chunk_id, doc_id, content, anchor, embedding; documents: doc_id, url, title; postings and stems: the stored trigram and full-text indexes (texts are read where there is none).

    vectors: chunk_id, embedding, where they are a table of their own. The corpus is then the inner join of the two, but
    ids and scores are joined, never texts.
    """

    chunks: DataFrame
    documents: DataFrame
    postings: DataFrame | None = None
    stems: DataFrame | None = None
    vectors: DataFrame | None = None


def decide_rewrite(corpus: Corpus, query: str, config: Retrieval, model: Callable[[str], str] = rewrite_words) -> tuple[str | None, str]:
    """The rewritten query, or None with the reason why there is none; logged where the settings ask for it."""
    new, reason = _rewritten(corpus, query, config, model)
    if config.rewrite_debug:
        LOG.info("rewrite %s", {"originalQuery": query, "rewrittenQuery": new, "reason": reason})
    return new, reason


def _rewritten(corpus: Corpus, query: str, config: Retrieval, model: Callable[[str], str]) -> tuple[str | None, str]:
    spark = corpus.chunks.sparkSession
    reason = spark.range(1).select(rewrite_gate(F.lit(query), config.rewrite).alias("r")).first().r
    if reason != "eligible":
        return None, reason
    try:
        new = " ".join(with_retries(lambda: with_deadline(lambda: model(query), config.rewrite_timeout_s), config.rewrite_retries).split())
    except Exception:
        return None, "model_failed"
    if not new or new.lower() == " ".join(query.split()).lower():
        return None, "equivalent_to_original"
    return new, "applied"


def _vector(corpus: Corpus, query: str, k: int, config: Retrieval, embed: Callable[[str], list[float]]) -> DataFrame:
    if corpus.vectors is None:
        return vector.top_k(corpus.chunks, embed(query), k, config.threshold, "chunk_id")
    # merged at every size, so that what is shuffled grows as the ids do
    hits = vector.above(corpus.vectors, embed(query), config.threshold, "chunk_id").join(corpus.chunks.select("chunk_id").hint("merge"), "chunk_id")
    return hits.orderBy(F.desc("similarity"), "chunk_id").limit(k)


def _payload(corpus: Corpus, fused: DataFrame) -> DataFrame:
    """The fused rows with their chunks and documents: each table is read once and only the few fused rows are sent."""
    rows = corpus.chunks.select("chunk_id", "doc_id", "content", "anchor").join(F.broadcast(fused), "chunk_id")
    if corpus.vectors is not None:
        rows = corpus.vectors.select("chunk_id").join(F.broadcast(rows), "chunk_id")
    return corpus.documents.select("doc_id", "url", "title").join(F.broadcast(rows), "doc_id")


def branch_names(matched: Column) -> Column:
    """The vector branches behind a mark of two-branch fusion: original, rewritten or both."""
    return F.when(matched == "both", F.array(F.lit("vector_original"), F.lit("vector_rewritten"))).otherwise(F.array(F.concat(F.lit("vector_"), matched)))


def retrieve(corpus: Corpus, query: str, config: Retrieval, embed: Callable[[str], list[float]] = embed_text, rewriter: Callable[[str], str] = rewrite_words, reranker: Callable = rank_by_overlap) -> tuple[list[dict], dict]:
    """Result rows (content, url, title, anchor, similarity, matched) and the debug record."""
    query = " ".join(re.split(r"\s+", query.strip()))
    new, reason = decide_rewrite(corpus, query, config, rewriter)
    each = config.branch_limit()
    keep = config.limit if config.cut_before_rerank or not config.rerank else max(config.limit, config.rerank_candidates)
    texts = {"original": query} | ({"rewritten": new} if new else {})
    parts = {f"vector_{name}": _vector(corpus, text, each if config.hybrid or new else keep, config, embed) for name, text in texts.items()}
    if config.hybrid:
        within = None if corpus.vectors is None else corpus.vectors.select("chunk_id")
        parts |= {f"lexical_{name}": lexical.search(corpus.chunks, corpus.postings, text, each, config.trigram_threshold, stems=corpus.stems, within=within).select("chunk_id", "similarity") for name, text in texts.items()}
    # each branch runs once: its few rows (the branch limit) go on as a local table
    tops = {name: fusion.ranked(part).select("chunk_id", "similarity", "rank") for name, part in parts.items()}
    found = {name: part.collect() for name, part in tops.items()}
    ranked = {name: corpus.chunks.sparkSession.createDataFrame(found[name], tops[name].schema) for name in tops}
    if config.hybrid:
        union = reduce(DataFrame.unionByName, (part.withColumn("source", F.lit(name)) for name, part in ranked.items()))
        fused = fusion.fuse(union, keep).select("chunk_id", F.col("score").alias("similarity"), "matched", "position")
    elif new:
        two = fusion.fuse_two(ranked["vector_original"], ranked["vector_rewritten"], keep)
        fused = two.select("chunk_id", "similarity", branch_names(F.col("matched")).alias("matched"), "position")
    else:
        fused = ranked["vector_original"].select("chunk_id", "similarity", F.array(F.lit("vector_original")).alias("matched"), F.col("rank").alias("position"))
    rows = [r.asDict() for r in _payload(corpus, fused).withColumn("url", anchor_url(F.col("url"), F.col("anchor"))).orderBy("position").collect()]
    done = rerank.rerank(query, rows, config, reranker)
    counts = {name: len(rows) for name, rows in found.items()}
    debug = {
        "originalQuery": query, "rewrittenQuery": new, "rewriteApplied": new is not None, "rewriteReason": reason, "branchCounts": counts, "fusedCount": len(rows),
        "reranking": {"status": done.status, "applied": done.applied, "beforeIds": done.before_ids, "afterIds": [c["chunk_id"] for c in done.candidates], "fallbackReason": done.fallback_reason, "diagnostics": done.diagnostics},
    }
    return [{k: c[k] for k in ("content", "url", "title", "anchor", "similarity", "matched")} for c in done.candidates], debug
