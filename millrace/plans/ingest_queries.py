"""Ingestion over pages and documents: addresses, hashes, changes, splitting, structure, enrichment, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Enrichment
from ..functions import text as T
from ..operators import enrich, store, structure
from ..sources import pages as P
from .registry import BLANK_SQL, Registry, table, trim_sql

REGISTRY = Registry()
query = REGISTRY

_SEGMENTS = r"list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '')"
PRODUCT = "en"


@query(f"SELECT page_id, array_to_string({_SEGMENTS}, '/') AS path, coalesce({_SEGMENTS}[2], 'en-us') AS lang, coalesce({_SEGMENTS}[3], 'general') AS product FROM pages")
def url_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang, product = T.language_and_product(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.url_path_segments(F.col("url")), "/").alias("path"), lang.alias("lang"), product.alias("product"))


_RANKED = f"""ranked AS (SELECT page_id, url, 10 * (len(s) - pos) + CASE WHEN starts_with(coalesce(s[pos + 1], ''), 'api-') THEN 1 ELSE 0 END AS rank
  FROM (SELECT page_id, url, s, list_position(s, '{PRODUCT}') AS pos FROM (SELECT page_id, url, list_transform({_SEGMENTS}, lambda x: lower(x)) AS s FROM pages)) WHERE pos > 0)"""


@query(f"WITH {_RANKED} SELECT page_id, url, CAST(rank AS INT) AS rank FROM ranked")
def product_filter_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").where(P.in_product(F.col("url"), PRODUCT))
    return rows.select("page_id", "url", P.crawl_rank(F.col("url"), PRODUCT).alias("rank"))


@query(f"WITH {_RANKED} SELECT page_id, url, CAST(rank AS INT) AS rank FROM ranked ORDER BY rank, page_id LIMIT 10")
def crawl_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.crawl_order(table(spark, sf_dir, "pages"), PRODUCT, 10).select("page_id", "url", "rank")


@query("SELECT doc_id, md5('paragraph:' || coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", enrich.content_hash(F.lit("paragraph"), F.coalesce("text", F.lit(""))).alias("content_hash"))


@query(
    """SELECT doc_id, sha256('{"parsedHash":"' || md5('paragraph:' || coalesce(text, '')) || '","enrichmentVersion":"meta-v1","embeddingInputVersion":"embed-v1","enabledContentKinds":["prose","table","code"],"minChars":300}') AS processing_hash FROM documents"""
)
def processing_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = enrich.content_hash(F.lit("paragraph"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", enrich.processing_hash(own).alias("processing_hash"))


#: Two crawls: the documents as they are stored, and a later one in which rated documents have changed and all pages are new.
_CRAWLS = """stored AS (SELECT 'doc/' || doc_id AS url, md5(text) AS content_hash, source AS title, lang FROM documents),
crawl AS (SELECT 'doc/' || d.doc_id AS url, md5(d.text || coalesce('/' || l.quality, '')) AS content_hash, d.source AS title, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'page/' || page_id, md5(html), url, NULL FROM pages)"""


def _crawls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, labels, pages = (table(spark, sf_dir, n) for n in ("documents", "labels", "pages"))
    address = F.concat(F.lit("doc/"), "doc_id").alias("url")
    stored = docs.select(address, F.md5("text").alias("content_hash"), F.col("source").alias("title"), "lang")
    mark = F.coalesce(F.concat(F.lit("/"), "quality"), F.lit(""))
    later = docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(address, F.md5(F.concat("text", mark)).alias("content_hash"), F.col("source").alias("title"), "lang")
    fresh = pages.select(F.concat(F.lit("page/"), "page_id").alias("url"), F.md5("html").alias("content_hash"), F.col("url").alias("title"), F.lit(None).cast("string").alias("lang"))
    return stored, later.unionByName(fresh)


@query(
    f"""WITH {_CRAWLS} SELECT c.url, c.content_hash, CASE WHEN s.url IS NULL THEN 'new' WHEN s.content_hash = c.content_hash THEN 'unchanged' ELSE 'changed' END AS change
FROM crawl c LEFT JOIN stored s ON c.url = s.url"""
)
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, later = _crawls(spark, sf_dir)
    return store.changes(stored, later).select("url", "content_hash", "change")


@query(
    f"""WITH {_CRAWLS} SELECT coalesce(s.url, c.url) AS url, coalesce('old-' || s.url, 'new-' || c.url) AS id, CASE WHEN c.url IS NULL THEN s.content_hash ELSE c.content_hash END AS content_hash,
  CASE WHEN c.url IS NULL THEN s.title ELSE c.title END AS title, CASE WHEN s.url IS NULL THEN NULL ELSE 7 END AS revision FROM stored s FULL JOIN crawl c ON s.url = c.url"""
)
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second crawl merged into the first: ids and columns that no update names stay."""
    stored, later = _crawls(spark, sf_dir)
    old = stored.select("url", F.concat(F.lit("old-"), "url").alias("id"), "content_hash", "title", F.lit(7).alias("revision"))
    new = later.select("url", F.concat(F.lit("new-"), "url").alias("id"), "content_hash", "title")
    return store.upsert_marked(old, new, ["url"], ["content_hash", "title"])


@query(
    """WITH gone AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')
SELECT 'conversation' AS kind, conv_id, NULL::BIGINT AS turn FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT conv_id FROM gone)
UNION ALL SELECT 'message', conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM gone)"""
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    parents = messages.select("conv_id").distinct()
    gone = messages.where("role = 'system'").select("conv_id").distinct()
    left, below = store.delete_cascade(parents, messages, gone, "conv_id", "conv_id")
    return left.select(F.lit("conversation").alias("kind"), "conv_id", F.lit(None).cast("long").alias("turn")).unionByName(below.select(F.lit("message").alias("kind"), "conv_id", "turn"))


@query("SELECT 'doc/' || doc_id AS url, CAST(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL) THEN 2 ELSE 1 END AS INT) AS n_chunks FROM documents")
def replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated documents get two new chunks in place of their old one; the others keep theirs."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    address = F.concat(F.lit("doc/"), "doc_id").alias("url")
    old = docs.select(address, F.lit(0).alias("chunk_index"))
    rated = docs.join(labels.where("quality IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    new = rated.select(address, F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"))
    return store.replace_children(old, new, "url").groupBy("url").agg(F.count("*").cast("int").alias("n_chunks"))


@query("SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


@query(f"SELECT doc_id, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{BLANK_SQL}+'), lambda w: w <> '')) AS INT) AS words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.coalesce("text", F.lit(""))).alias("words"))


@query("SELECT lang, source, count(*) AS n_docs, CAST(sum(ceil(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens, CAST(max(length(text)) AS BIGINT) AS longest FROM documents GROUP BY lang, source")
def content_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source")
    return rows.agg(F.count("*").alias("n_docs"), F.sum(T.estimate_tokens(F.coalesce("text", F.lit("")))).alias("tokens"), F.max(F.length("text")).cast("long").alias("longest"))


@query(f"SELECT doc_id, md5({trim_sql(f"regexp_replace(coalesce(text, ''), '{BLANK_SQL}+', ' ', 'g')")}) AS squashed, md5(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {trim_sql('x')}), lambda x: x <> ''), chr(10))) AS trimmed_lines FROM documents")
def whitespace_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_whitespace(text)).alias("squashed"), F.md5(T.normalize_multiline(text)).alias("trimmed_lines"))


_LIMIT = structure.LIMIT


def _parts(value: str) -> str:
    return f"list_filter(list_transform({value}, lambda x: {trim_sql('x')}), lambda x: x <> '')"


@query(
    rf"""WITH b AS (SELECT doc_id, {trim_sql("coalesce(text, '')")} AS t FROM documents),
c AS (SELECT doc_id, t, {_parts(r"string_split_regex(t, '\n\s*\n')")} AS p1, {_parts("string_split(t, chr(10))")} AS p2, {_parts(r"string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))")} AS p3,
  {_parts(f"list_transform(range(0, CAST(greatest(length(t), 1) AS BIGINT), {_LIMIT}), lambda i: substring(t, CAST(i + 1 AS BIGINT), {_LIMIT}))")} AS p4 FROM b),
d AS (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN length(t) <= {_LIMIT} THEN [t] WHEN len(p1) > 1 AND len(list_filter(p1, lambda x: length(x) > {_LIMIT})) = 0 THEN p1
  WHEN len(p2) > 1 AND len(list_filter(p2, lambda x: length(x) > {_LIMIT})) = 0 THEN p2 WHEN len(p3) > 1 AND len(list_filter(p3, lambda x: length(x) > {_LIMIT})) = 0 THEN p3 ELSE p4 END AS parts FROM c)
SELECT doc_id, CAST(len(parts) AS INT) AS n_parts, md5(array_to_string(parts, chr(1))) AS parts_md5 FROM d"""
)
def boundary_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.split_sentences(F.coalesce("text", F.lit("")), _LIMIT).alias("parts"))
    return rows.select("doc_id", F.size("parts").alias("n_parts"), F.md5(F.array_join("parts", "\u0001")).alias("parts_md5"))


@query(
    f"""SELECT doc_id, CAST(unnest(range(CAST(ceil(length(coalesce(text, '')) / {float(_LIMIT)}) AS BIGINT))) AS INT) AS place,
  md5(substring(coalesce(text, ''), CAST(unnest(range(CAST(ceil(length(coalesce(text, '')) / {float(_LIMIT)}) AS BIGINT))) * {_LIMIT} + 1 AS BIGINT), {_LIMIT})) AS part_md5 FROM documents"""
)
def hard_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = T.hard_cut(F.coalesce("text", F.lit("")), _LIMIT)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut).alias("place", "part")).select("doc_id", "place", F.md5("part").alias("part_md5"))


@query()
def fixed_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlapping windows of every document; tests hold it against a plain loop."""
    return structure.window_chunks(table(spark, sf_dir, "documents")).select("doc_id", "place", F.md5("content").alias("content_md5"), F.length("content").alias("n_chars"))


@query()
def structured_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.elements(table(spark, sf_dir, "pages"))


@query()
def plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.plain_pages(table(spark, sf_dir, "pages"))


@query()
def structure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chunks(table(spark, sf_dir, "pages"))


@query()
def content_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chunks(table(spark, sf_dir, "pages")).groupBy("content_kind").agg(F.count("*").alias("n_chunks"), F.sum("token_estimate").alias("tokens"), F.countDistinct("page_id").alias("n_pages"))


@query()
def enriched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every page with enrichment by the offline model, and their embedding input."""
    rows = enrich.enrich(structure.chunks(table(spark, sf_dir, "pages")))
    given = enrich.embedding_input(F.col("title"), F.col("heading_path"), F.col("content_kind"), F.col("content"), F.col("enrichment"))
    return rows.select("page_id", "chunk_index", "status", "reason", given.alias("embedding_input")).withColumn("preview", enrich.preview(F.col("embedding_input")))


_KIND = "CASE lang WHEN 'en' THEN 'prose' WHEN 'fr' THEN 'table' WHEN 'de' THEN 'code' ELSE 'list' END"
_POLICY = f"CASE WHEN ({_KIND}) NOT IN ('prose', 'table', 'code') THEN 'content_kind_not_enabled' WHEN ({_KIND}) <> 'table' AND length(coalesce(text, '')) < 300 THEN 'below_min_chars' ELSE 'eligible' END"


@query(f"SELECT doc_id, {_KIND} AS content_kind, {_POLICY} AS verdict FROM documents")
def enrichment_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_KIND).alias("content_kind"), F.coalesce("text", F.lit("")).alias("content"))
    return rows.select("doc_id", "content_kind", enrich.policy(F.col("content_kind"), F.col("content"), Enrichment()).alias("verdict"))


@query(f"SELECT count(*) FILTER (({_POLICY}) = 'eligible') AS n_eligible, count(*) AS n_chunks FROM documents")
def eligible_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment_policy(spark, sf_dir).agg(F.count_if(F.col("verdict") == "eligible").alias("n_eligible"), F.count("*").alias("n_chunks"))


@query(
    f"""SELECT doc_id, md5(input) AS input_md5, substring(input, 1, 240) AS preview FROM (
  SELECT doc_id, CASE WHEN ({_POLICY}) <> 'eligible' THEN coalesce(text, '') ELSE concat_ws(chr(10), 'Document: ' || source, 'Path: ' || source || ' > ' || lang,
    'Type: ' || CASE ({_KIND}) WHEN 'table' THEN 'Table' WHEN 'code' THEN 'Code' ELSE 'Prose' END, 'Summary: ' || source || ' in ' || lang,
    CASE WHEN ({_KIND}) = 'table' THEN 'Table Summary: ' || source END, CASE WHEN ({_KIND}) = 'code' THEN 'Code Summary: ' || lang END, 'Keywords: ' || lang || ', ' || source,
    'Topics: ' || source, 'Questions:' || chr(10) || '- What is in ' || source || '?', 'Content:', coalesce(text, '')) END AS input FROM documents)"""
)
def embedding_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.to_json(
        F.struct(
            F.concat("source", F.lit(" in "), "lang").alias("summary"), F.array("lang", "source", "lang").alias("keywords"), F.array(F.concat(F.lit(" What is in "), "source", F.lit("?"))).alias("hypothetical_questions"),
            F.array("source").alias("topics"), F.col("source").alias("table_summary"), F.col("lang").alias("code_summary"),
        )
    )
    kind, content = F.expr(_KIND), F.coalesce("text", F.lit(""))
    made = F.when(enrich.policy(kind, content) == "eligible", enrich.validated(kind, given))
    rows = table(spark, sf_dir, "documents").select("doc_id", enrich.embedding_input(F.col("source"), F.array("source", "lang"), kind, content, made).alias("input"))
    return rows.select("doc_id", F.md5("input").alias("input_md5"), enrich.preview(F.col("input")).alias("preview"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.content_kind') AS content_kind FROM events")
def json_debug_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.content_kind").alias("content_kind"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC NULLS FIRST, event_id LIMIT 20")
def debug_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc_nulls_first("ts"), "event_id").limit(20).select("event_id", "user_id", "event_type")


_META = """'{"content_kind":' || CASE doc_id % 3 WHEN 0 THEN '7' WHEN 1 THEN '"prose"' ELSE 'null' END || ',"enrichment":' || CASE doc_id % 2 WHEN 0 THEN '{"status":"success"}' ELSE '"none"' END || ',"embedding_input_preview":"' || lang || '"}'"""


@query(
    f"""WITH chunk AS (SELECT doc_id, CAST(doc_id % 7 AS INT) AS chunk_index, lang AS anchor, {_META} AS m FROM documents),
page AS (SELECT vec_id AS doc_id, 'https://docs.example.com/' || label AS url, 'Cell ' || label AS title, label AS last_crawled_at FROM embeddings)
SELECT url, title, anchor, chunk_index, CASE WHEN json_type(m, '$.content_kind') = 'VARCHAR' THEN json_extract_string(m, '$.content_kind') END AS content_kind,
       CASE WHEN json_type(m, '$.enrichment.status') = 'VARCHAR' THEN json_extract_string(m, '$.enrichment.status') END AS enrichment_status, CAST(NULL AS VARCHAR) AS embedding_input_version, json_extract_string(m, '$.embedding_input_preview') AS embedding_input_preview
FROM chunk JOIN page USING (doc_id) WHERE url = 'https://docs.example.com/3' ORDER BY last_crawled_at DESC, chunk_index, url LIMIT 1000000"""
)
def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their documents, of one address."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.expr("cast(doc_id % 7 as int)").alias("chunk_index"), F.col("lang").alias("anchor"), F.expr(_META).alias("metadata"))
    pages = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("https://docs.example.com/"), "label").alias("url"), F.concat(F.lit("Cell "), "label").alias("title"), F.col("label").alias("last_crawled_at"))
    return store.chunk_listing(chunks, pages, "https://docs.example.com/3", 1_000_000)


@query("SELECT doc_id, place, CAST(place // 50 AS INT) AS batch FROM (SELECT doc_id, CAST(unnest(range(CAST(ceil(length(coalesce(text, '')) / 100.0) AS BIGINT))) AS INT) AS place FROM documents)")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty pieces of one document to an embedding call."""
    cut = T.hard_cut(F.coalesce("text", F.lit("")), 100)
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut).alias("place", "part")).select("doc_id", "place")
    return store.batches(pieces, 50, "place", ["doc_id"])


@query(
    "SELECT page_id, CASE WHEN strpos(html, 'class=\"ad\"') > 0 THEN url || '#ad' ELSE url END AS url, lower(regexp_extract('x language-' || split_part(url, '.', -1), '(?i)lang(?:uage)?-([a-z0-9_+\\-]+)', 1)) AS code_language FROM pages"
)
def anchor_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.when(F.instr("html", 'class="ad"') > 0, "ad").otherwise("")
    language = T.code_language(F.concat(F.lit("x language-"), F.substring_index("url", ".", -1)))
    return table(spark, sf_dir, "pages").select("page_id", T.anchor_url(F.col("url"), anchor).alias("url"), F.coalesce(language, F.lit("")).alias("code_language"))
