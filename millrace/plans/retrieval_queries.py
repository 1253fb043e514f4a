"""Retrieval over the documents and embeddings tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Retrieval
from ..functions import text as T
from ..operators import fusion, lexical, rerank, retrieve, vector, vector_index
from ..operators.models import embed_text, rank_by_overlap
from .registry import Registry, spread, table

REGISTRY = Registry()
query = REGISTRY

_SIM = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
#: Two query vectors stand for the original and the rewritten query; lexical branches use two benchmark passages.
_BRANCH_SQL = f"""
vec AS (
  SELECT source, chunk_id, similarity, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, chunk_id) AS rank FROM (
    SELECT CASE q.vec_id WHEN 0 THEN 'vector_original' ELSE 'vector_rewritten' END AS source, e.vec_id AS chunk_id, {_SIM} AS similarity
    FROM embeddings e, embeddings q WHERE q.vec_id IN (0, 1)) WHERE similarity > 0.1
  QUALIFY rank <= 12)
"""
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_GRAMS = "list_distinct(flatten(list_transform(list_distinct({w}), lambda w: list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substring('  ' || w || ' ', CAST(i AS BIGINT), 3)))))"
_DOC_GRAMS = _GRAMS.format(w=_WORDS)


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first().embedding]


def _passage(spark: SparkSession, sf_dir: str, item: int) -> str:
    return table(spark, sf_dir, "benchmark").where(F.col("item_id") == item).first().text


@query(
    f"""SELECT vec_id, similarity, lang, source FROM (
  SELECT e.vec_id, {_SIM} AS similarity, d.lang, d.source FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id, embeddings q WHERE q.vec_id = 0)
WHERE similarity > 0.2 ORDER BY similarity DESC, vec_id LIMIT 5"""
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.search(table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents"), _query_vector(spark, sf_dir, 0), 5, 0.2)


@query(f"SELECT e.vec_id, {_SIM} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND {_SIM} > 0.25")
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.above(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir, 0), 0.25)


_STEP = "pow(2.0, greatest(floor(log2(abs(CAST(x AS DOUBLE)))), -14) - 10)"
_HALF = "list_transform({v}, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE sign(x) * round_even(abs(CAST(x AS DOUBLE)) / " + _STEP + ", 0) * " + _STEP + " END)"
_HALF_SIM = f"round(list_cosine_similarity({_HALF.format(v='e.embedding')}, {_HALF.format(v='q.embedding')}), 6)"


@query(f"SELECT e.vec_id, {_HALF_SIM} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND {_HALF_SIM} > 0.2 ORDER BY similarity DESC, e.vec_id LIMIT 20")
def vector_topk_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar vectors where both sides are stored in half precision."""
    return vector.top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir, 0), 20, 0.2, in_half=True)


@query(
    f"""SELECT query_id, vec_id, similarity, CAST(rank AS INT) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {_SIM} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND {_SIM} > 0.1) WHERE rank <= 5"""
)
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.top_k_batch(vectors, queries, 5, 0.1)


@query()
def ann_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries through the index of cells; tests measure its recall against the exact answer."""
    vectors = table(spark, sf_dir, "embeddings")
    centres = vector_index.fit(vectors)
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index.search_batch(vector_index.assign(vectors, centres), centres, queries, 5, 0.1)


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    parts = []
    for vec_id, source in ((0, "vector_original"), (1, "vector_rewritten")):
        top = vector.top_k(vectors, _query_vector(spark, sf_dir, vec_id), 12, 0.1, "chunk_id")
        parts.append(fusion.ranked(top).withColumn("source", F.lit(source)))
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""WITH {_BRANCH_SQL}
SELECT chunk_id, round(score, 9) AS score, n_matched, best_similarity, best_source, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, n_matched DESC, n_original DESC, best_similarity DESC, best_source, chunk_id) AS position FROM (
    SELECT chunk_id, coalesce(max(1.0::DOUBLE / (60 + rank)) FILTER (source = 'vector_original'), 0) + coalesce(max(0.75::DOUBLE / (60 + rank)) FILTER (source = 'vector_rewritten'), 0) AS score,
           CAST(count(*) AS INT) AS n_matched, count(*) FILTER (source = 'vector_original') AS n_original, max(similarity) AS best_similarity, arg_max(source, (similarity, -(CASE source WHEN 'vector_original' THEN 0 ELSE 2 END))) AS best_source
    FROM vec GROUP BY chunk_id)) WHERE position <= 5"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.fuse(_branches(spark, sf_dir), 5)
    return fused.select("chunk_id", F.round("score", 9).alias("score"), F.size("matched").alias("n_matched"), "best_similarity", "best_source", "position")


@query(
    f"""WITH {_BRANCH_SQL}
SELECT chunk_id, similarity, matched, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (ORDER BY similarity DESC, CASE matched WHEN 'both' THEN 0 WHEN 'original' THEN 1 ELSE 2 END, seen) AS position FROM (
    SELECT chunk_id, max(similarity) AS similarity, CASE WHEN count(*) = 2 THEN 'both' ELSE substring(min(source), 8) END AS matched, min(CASE source WHEN 'vector_original' THEN rank ELSE rank + 1000000 END) AS seen
    FROM vec GROUP BY chunk_id)) WHERE position <= 8"""
)
def legacy_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _branches(spark, sf_dir)
    return fusion.fuse_two(rows.where("source = 'vector_original'"), rows.where("source = 'vector_rewritten'"), 8)


@query(
    f"""WITH {_BRANCH_SQL}
SELECT count(*) FILTER (source = 'vector_original') AS n_vector_original, 0::BIGINT AS n_lexical_original, count(*) FILTER (source = 'vector_rewritten') AS n_vector_rewritten, 0::BIGINT AS n_lexical_rewritten, count(DISTINCT chunk_id) AS n_fused FROM vec"""
)
def branch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.branch_counts(_branches(spark, sf_dir))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))


_TRIGRAM_SQL = f"""
grams AS (SELECT doc_id, {_DOC_GRAMS} AS g FROM documents),
own AS (SELECT {_DOC_GRAMS} AS g FROM benchmark WHERE item_id = 0),
scored AS (SELECT doc_id AS chunk_id, len(list_intersect(grams.g, own.g)) AS common, len(grams.g) AS n, len(own.g) AS m FROM grams, own),
lex AS (SELECT chunk_id, round(common / (n + m - common), 6) AS trigram FROM scored WHERE common > 0)
"""


@query(f"WITH {_TRIGRAM_SQL} SELECT chunk_id, trigram FROM lex ORDER BY trigram DESC, chunk_id LIMIT 10")
def trigram_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lexical.trigram_scan(_chunks(spark, sf_dir), _passage(spark, sf_dir, 0))
    return scores.orderBy(F.desc("trigram"), "chunk_id").limit(10)


@query(f"WITH {_TRIGRAM_SQL} SELECT chunk_id, 0.0::DOUBLE AS fts, trigram, round(0.3 * trigram, 6) AS similarity FROM lex WHERE trigram > 0.18 ORDER BY similarity DESC, chunk_id LIMIT 15")
def lexical_score_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return lexical.search(chunks, None, _passage(spark, sf_dir, 0), 15, fts=False)


#: A query of words that need no stemming.
PLAIN_QUERY = ("the", "and", "with")


@query(
    rf"""WITH hit AS (SELECT doc_id, w FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) WHERE w IN {PLAIN_QUERY})
SELECT doc_id AS chunk_id, count(*) AS n_hits FROM hit GROUP BY doc_id HAVING count(DISTINCT w) = {len(PLAIN_QUERY)}"""
)
def fts_match_unstemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.fts_match(lexical.fts_postings(_chunks(spark, sf_dir)), list(PLAIN_QUERY))


@query()
def fts_rank_cd(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lexical.fts_scores(_chunks(spark, sf_dir), "inning or enthing reaned")
    return scores.orderBy(F.desc("fts"), "chunk_id").limit(20)


@query()
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return lexical.search(chunks, None, _passage(spark, sf_dir, 2), 12)


@query(
    f"""WITH {_BRANCH_SQL}, {_TRIGRAM_SQL}, lexr AS (
  SELECT 'lexical_original' AS source, chunk_id, round(0.3 * trigram, 6) AS similarity, row_number() OVER (ORDER BY round(0.3 * trigram, 6) DESC, chunk_id) AS rank FROM lex WHERE trigram > 0.18 QUALIFY rank <= 12),
rows AS (SELECT source, chunk_id, similarity, rank FROM vec UNION ALL SELECT source, chunk_id, similarity, rank FROM lexr)
SELECT chunk_id, round(score, 9) AS score, matched, best_source, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, n DESC, n_original DESC, best_similarity DESC, CASE best_source WHEN 'vector_original' THEN 0 WHEN 'lexical_original' THEN 1 ELSE 2 END, chunk_id) AS position FROM (
    SELECT chunk_id, coalesce(max(1.0::DOUBLE / (60 + rank)) FILTER (source = 'vector_original'), 0) + coalesce(max(1.0::DOUBLE / (60 + rank)) FILTER (source = 'lexical_original'), 0) + coalesce(max(0.75::DOUBLE / (60 + rank)) FILTER (source = 'vector_rewritten'), 0) AS score,
           count(*) AS n, count(*) FILTER (source IN ('vector_original', 'lexical_original')) AS n_original, max(similarity) AS best_similarity,
           arg_max(source, (similarity, -(CASE source WHEN 'vector_original' THEN 0 WHEN 'lexical_original' THEN 1 ELSE 2 END))) AS best_source,
           string_agg(source, ',' ORDER BY CASE source WHEN 'vector_original' THEN 0 WHEN 'lexical_original' THEN 1 ELSE 2 END) AS matched
    FROM rows GROUP BY chunk_id)) WHERE position <= 5"""
)
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    lex = lexical.search(chunks, None, _passage(spark, sf_dir, 0), Retrieval(hybrid=True, limit=4).branch_limit(), fts=False).select("chunk_id", "similarity")
    rows = _branches(spark, sf_dir).unionByName(fusion.ranked(lex).withColumn("source", F.lit("lexical_original")))
    return fusion.fuse(rows, 5).select("chunk_id", F.round("score", 9).alias("score"), F.array_join("matched", ",").alias("matched"), "best_source", "position")


@query(
    f"""WITH cand AS (
  SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {_SIM} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND {_SIM} > 0.1 QUALIFY rank <= 10),
model AS (SELECT query_id, list(chunk_id ORDER BY chunk_id DESC) AS ranked FROM cand GROUP BY query_id)
SELECT query_id, chunk_id, similarity, CAST(list_position(ranked, chunk_id) - 1 AS INT) AS place, len(ranked) = len(list_distinct(ranked)) AS valid FROM cand JOIN model USING (query_id) WHERE list_position(ranked, chunk_id) <= 5"""
)
def rerank_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    cand = vector.top_k_batch(vectors, queries, 10, 0.1).withColumnRenamed("vec_id", "chunk_id")
    own = cand.groupBy("query_id").agg(F.collect_list("chunk_id").alias("ids"))
    model = own.select("query_id", F.sort_array("ids", asc=False).alias("ranked_ids"), rerank.is_permutation(F.sort_array("ids", asc=False), F.col("ids")).alias("valid"))
    return rerank.reorder(cand, model.where("valid"), 5).withColumn("valid", F.lit(True)).select("query_id", "chunk_id", "similarity", "place", "valid")


@query()
def retrieve_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orchestrator in its three plans (one vector branch; original and rewritten; hybrid with reranking) for one passage."""
    documents = table(spark, sf_dir, "documents")
    chunks = _chunks(spark, sf_dir).select("chunk_id", F.col("chunk_id").alias("doc_id"), "content", F.lit(None).cast("string").alias("anchor"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    corpus = retrieve.Corpus(chunks, documents.select("doc_id", F.concat(F.lit("https://docs.example.com/"), "doc_id").alias("url"), F.col("source").alias("title")), vectors=vectors)
    passage = " ".join(_passage(spark, sf_dir, 2).split()[:12])
    plans = {"vector": Retrieval(threshold=-1.0), "rewritten": Retrieval(threshold=-1.0, rewrite=True), "hybrid": Retrieval(threshold=-1.0, rewrite=True, hybrid=True, rerank=True)}
    out = []
    for name, config in plans.items():
        rows, debug = retrieve.retrieve(corpus, passage, config, embed=lambda t: embed_text(t, 64))
        out += [(name, i, r["url"], r["title"], float(r["similarity"]), ",".join(r["matched"]), debug["rewriteReason"], debug["reranking"]["status"]) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, "plan string, place int, url string, title string, similarity double, matched string, rewrite_reason string, rerank_status string")


@query()
def rerank_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each outcome of the contract over the candidates that lexical search finds for a passage."""
    chunks, passage = _chunks(spark, sf_dir), _passage(spark, sf_dir, 0)
    found = lexical.search(chunks, None, passage, 12, fts=False)
    rows = [r.asDict() for r in chunks.join(F.broadcast(found), "chunk_id").orderBy(F.desc("similarity"), "chunk_id").collect()]
    replies = {"applied": rank_by_overlap, "model_failed": lambda q, c: 1 / 0, "invalid": lambda q, c: '{"rankedIds": [1, 1]}', "no_json": lambda q, c: "sorry"}
    out = []
    for name, model in replies.items():
        for on in (True, False):
            done = rerank.rerank(passage, rows, Retrieval(rerank=on), model)
            out.append((name, on, done.status, done.fallback_reason, [c["chunk_id"] for c in done.candidates]))
    return spark.createDataFrame(out, "reply string, enabled boolean, status string, fallback_reason string, after_ids array<long>")


_GATE_INPUT = """(SELECT 'b' || item_id AS id, text AS q FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations UNION ALL
  SELECT * FROM (VALUES ('l1', 'how do I configure the server proxy'), ('l2', 'npm run build'), ('l3', '"exact phrase" here'), ('l4', 'server.proxy'), ('l5', 'hmr'), ('l6', 'what about plugins'), ('l7', 'how does it work'),
  ('l8', 'defineConfig usage'), ('l9', '  spaced   out words '), ('l10', 'vite preview?'), ('l11', 'env variables modes'), ('l12', '`x`'), ('l13', '')) v(id, q))"""


@query(
    rf"""WITH raw AS {_GATE_INPUT}, norm AS (SELECT id, trim(regexp_replace(q, '\s+', ' ', 'g')) AS q FROM raw), t AS (SELECT id, q, list_filter(string_split(q, ' '), lambda x: x <> '') AS w, regexp_matches(lower(q), '^(how|what|why|when|where) ') AS asks FROM norm),
u AS (SELECT *, NOT asks AND NOT contains(q, '?') AND len(w) BETWEEN 2 AND 5 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Za-z0-9._:/=-]+$'))) = 0
   AND (lower(w[1]) IN ('vite', 'npm', 'pnpm', 'yarn', 'bun', 'npx', 'node') OR len(list_filter(w, lambda x: lower(x) IN ('build', 'preview', 'dev', 'serve', 'start', 'run', 'test', 'install', 'create', 'add', 'remove'))) > 0) AS command FROM t),
v AS (SELECT *, NOT asks AND (regexp_matches(q, '[_./():{{}}-]') OR regexp_matches(q, '[a-z][A-Z]') OR command) AS ident FROM u)
SELECT id, CAST(len(w) AS INT) AS n_words, CASE WHEN len(q) > 1 AND q[1] IN ('"', '''', '`') AND strpos(substring(q, 2), q[1]) > 1 THEN 'quoted_query' WHEN len(w) < 2 AND NOT ident THEN 'query_too_short' WHEN len(w) > 30 THEN 'query_too_long'
  WHEN ident THEN 'identifier_like' WHEN regexp_matches(q, '(?i)^(what about|how does that|how does it)\b') THEN 'context_dependent' ELSE 'eligible' END AS reason FROM v"""
)
def rewrite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("benchmark", "conversations"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    raw = spark.sql("SELECT * FROM " + _GATE_INPUT)
    return raw.select("id", T.word_count(T.normalize_whitespace(F.col("q"))).alias("n_words"), T.rewrite_gate(F.col("q")).alias("reason"))


@query(
    "SELECT a.item_id AS id, lower(trim(regexp_replace(a.text, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) AS equivalent FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - a.item_id % 2"
)
def query_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    other = items.select(F.col("item_id").alias("even"), F.col("text").alias("base"))
    joined = items.join(other, other.even == items.item_id - items.item_id % 2)
    return joined.select(F.col("item_id").alias("id"), T.equivalent_queries(F.col("text"), F.col("base")).alias("equivalent"))


@query(f"WITH {_BRANCH_SQL} SELECT chunk_id, string_agg(source, ',' ORDER BY source) AS branches FROM vec GROUP BY chunk_id")
def provenance_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch names of every result of two-branch fusion."""
    rows = _branches(spark, sf_dir)
    fused = fusion.fuse_two(rows.where("source = 'vector_original'"), rows.where("source = 'vector_rewritten'"), 24)
    return fused.select("chunk_id", F.array_join(retrieve.branch_names(F.col("matched")), ",").alias("branches"))


