"""Ingestion of a stream of pages: parse, compare with what is stored, upsert documents and replace their chunks.

Both tables are partitioned by a hash bucket of the address, so a batch reads and rewrites the buckets of its changed
pages only; a bucket is staged and then moved into place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import language_and_product
from ..operators import store, structure

BUCKETS = 1024
DOCUMENTS = "id string, url string, title string, lang string, product string, content_hash string, updated_at timestamp, last_crawled_at timestamp"


def parsed(pages: DataFrame) -> DataFrame:
    """Document rows of pages."""
    lang, product = language_and_product(F.col("url"))
    rows = structure.documents(pages).select(store.new_id("url").alias("id"), "url", "title", lang.alias("lang"), product.alias("product"), "content_hash")
    return rows.withColumns({"updated_at": F.lit(None).cast("timestamp"), "last_crawled_at": F.current_timestamp()})


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int").alias("bucket")


def one_per_url(pages: DataFrame) -> DataFrame:
    """One page for each address: that of the greatest page_id, which came last; ties go to the greater markup."""
    rest = [c for c in pages.columns if c != "url"]
    lead = [c for c in ("page_id", "html") if c in rest]
    last = pages.groupBy("url").agg(F.max(F.struct(*lead, *(c for c in rest if c not in lead))).alias("last"))
    return last.select(*(F.col("url") if c == "url" else F.col("last").getField(c).alias(c) for c in pages.columns))


def ingest_batch(pages: DataFrame, documents_path: str, chunks_path: str, buckets: int = BUCKETS) -> None:
    """One batch; replaying it changes nothing, since unchanged pages are left alone. Documents come last, so a batch that fails between the two is done again."""
    spark = pages.sparkSession
    pages = one_per_url(pages)
    own = pages.withColumn("bucket", bucket(buckets))
    batch = sorted(r.bucket for r in own.select("bucket").distinct().collect())
    old = _read(spark, documents_path, f"{DOCUMENTS}, bucket int").where(F.col("bucket").isin(batch))
    fresh = store.changes(old, parsed(pages).withColumn("bucket", bucket(buckets))).where("change <> 'unchanged'").drop("change").persist()
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
    if touched:
        changed = pages.join(fresh.select("url"), "url", "left_semi")
        found = structure.chunks(changed).select(store.new_id("url", "chunk_index").alias("id"), F.sha2("url", 256).alias("document_key"), "url", "chunk_index", "content", "anchor", "content_kind", "token_estimate", bucket(buckets))
        kept = _read(spark, chunks_path, ", ".join(f"`{n}` {t}" for n, t in found.dtypes)).where(F.col("bucket").isin(touched))
        # a changed page without chunks still loses its old ones
        left = kept.join(fresh.select("url"), "url", "left_anti").unionByName(found)
        store.replace_partitions(left, chunks_path, "bucket", touched)
        store.replace_partitions(store.upsert_marked(old.where(F.col("bucket").isin(touched)), fresh, ["url"], ["title", "lang", "product", "content_hash", "last_crawled_at"]), documents_path, "bucket", touched)
    fresh.unpersist()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    here = jvm.org.apache.hadoop.fs.Path(path)
    there = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(here)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def start(pages: DataFrame, documents_path: str, chunks_path: str, checkpoint: str) -> StreamingQuery:
    """Run ``ingest_batch`` on each micro-batch of a stream of (page_id, url, html); ends when the input is used up."""
    write = pages.writeStream.foreachBatch(lambda batch, _: ingest_batch(batch, documents_path, chunks_path))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
