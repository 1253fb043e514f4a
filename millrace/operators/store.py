"""Tables kept as Parquet: upsert, replace, delete with cascade, update, append.

Each operation gives the table's new rows as a DataFrame; ``commit`` writes them beside the old ones and swaps the two,
so a failed job leaves the old table whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_id(*keys: str) -> Column:
    """An id that the same keys always get."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *keys), 256), 1, 32)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], id_column: str = "id") -> DataFrame:
    """Rows of ``old`` with ``update`` taken from the matching row of ``new``, and the rows of ``new`` that had no match.

    One full outer join on the keys; columns that are not updated keep their old values, ids too. Of several new rows
    with one key the last by the updated columns counts.
    """
    last = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in update))
    new = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    joined = old.alias("o").join(new.alias("n"), keys, "full_outer")
    known = F.col(f"o.{id_column}").isNotNull()
    fresh = F.coalesce(*(F.col(f"n.{c}").isNotNull() for c in update)) if update else F.lit(False)
    there = F.col("n.__new").isNotNull() if "__new" in new.columns else fresh
    columns = []
    for c in old.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c == id_column:
            columns.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c not in new.columns:
            columns.append(F.col(f"o.{c}").alias(c))
        elif c in update:
            columns.append(F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return joined.select(*columns)


def upsert_marked(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], id_column: str = "id") -> DataFrame:
    """``upsert`` whose updated columns may be null in ``new``."""
    return upsert(old, new.withColumn("__new", F.lit(True)), keys, update, id_column)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """The children of each parent in ``new`` take the place of all its old ones."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the deleted keys (column ``key`` of ``gone``)."""
    return parents.join(gone, key, "left_anti"), children.join(gone.select(F.col(key).alias(child_key)), child_key, "left_anti")


def update_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def changes(old: DataFrame, new: DataFrame, key: str = "url", digest: str = "content_hash", force: bool = False) -> DataFrame:
    """Rows of ``new`` with change: new, changed or unchanged (never the last with ``force``)."""
    known = old.select(key, F.col(digest).alias("__old"))
    kind = F.when(F.col("__old").isNull(), "new").when((F.col("__old") == F.col(digest)) & F.lit(not force), "unchanged").otherwise("changed")
    return new.join(known, key, "left").withColumn("change", kind).drop("__old")


def append_message(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with updated_at moved to their newest message, and untitled ones named by their first user message."""
    first = F.min_by("content", F.when(F.col("role") == "user", F.col("created_at")))
    seen = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("__last"), first.alias("__first"))
    untitled = F.trim(F.coalesce("title", F.lit(""))).isin("", "New Conversation") & F.col("__first").isNotNull()
    joined = conversations.join(seen, "id", "left")
    return joined.withColumn("title", F.when(untitled, F.substring("__first", 1, 160)).otherwise(F.col("title"))).withColumn("updated_at", F.greatest("updated_at", "__last")).drop("__last", "__first")


def batches(rows: DataFrame, size: int, order: str, by: list[str]) -> DataFrame:
    """Adds batch: groups of ``size`` rows in order, within each of the keys ``by``."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / size).cast("int"))


def commit(rows: DataFrame, path: str) -> None:
    """Write to a sibling path, then swap by renaming; the store's own file system does both."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}.next")
    jvm = spark.sparkContext._jvm
    here, fresh, back = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.next", f"{path}.old"))
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(back, True)
    if fs.exists(here):
        fs.rename(here, back)
    fs.rename(fresh, here)
    fs.delete(back, True)


def replace_partitions(rows: DataFrame, path: str, column: str, values: list) -> None:
    """Put ``rows`` in place of the named partitions of a table; partitions that have no row left are emptied, the others stay as they are."""
    spark = rows.sparkSession
    rows = rows.persist()
    left = {r[0] for r in rows.select(column).distinct().collect()}
    rows.repartition(column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    rows.unpersist()
    jvm = spark.sparkContext._jvm
    for value in sorted(set(values) - left):
        gone = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def exists(spark, name: str) -> bool:
    return spark.catalog.tableExists(name)


def chunk_listing(chunks: DataFrame, documents: DataFrame, url: str | None = None, limit: int = 20) -> DataFrame:
    """Chunks with their documents for inspection, the last crawled first; of one address only, where it is given.

    Fields of the metadata (a JSON text) count only where they are strings.
    """
    own = documents.select("doc_id", "url", "title", "last_crawled_at").where(F.col("url") == url if url else F.lit(True))

    def field(path: str) -> Column:
        value = F.variant_get("__meta", path, "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.variant_get("__meta", path, "string"))

    rows = chunks.withColumn("__meta", F.try_parse_json("metadata")).join(own, "doc_id")
    names = {"content_kind": "$.content_kind", "enrichment_status": "$.enrichment.status", "embedding_input_version": "$.embedding_input_version", "embedding_input_preview": "$.embedding_input_preview"}
    rows = rows.select("url", "title", "anchor", "chunk_index", *(field(path).alias(name) for name, path in names.items()), "last_crawled_at")
    return rows.orderBy(F.desc_nulls_first("last_crawled_at"), "chunk_index", "url").limit(limit).drop("last_crawled_at")
