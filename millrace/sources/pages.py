"""Page sources: tables of pages, address filters and crawl order; JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import url_path_segments


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def in_product(url: Column, product: str) -> Column:
    """Whether a part of the address's path is the product, in any case."""
    return F.coalesce(F.array_contains(F.transform(url_path_segments(url), lambda x: F.lower(x)), product.lower()), F.lit(False))


def crawl_rank(url: Column, product: str) -> Column:
    """Ten for each path part after the product, one more where the first of them starts with ``api-``."""
    parts = F.transform(url_path_segments(url), lambda x: F.lower(x))
    at = F.array_position(parts, product.lower()).cast("int")
    tail = F.size(parts) - at
    first = F.try_element_at(parts, at + 1)
    return F.when(at > 0, tail * 10 + F.when(first.startswith("api-"), 1).otherwise(0))


def crawl_order(rows: DataFrame, product: str, limit: int, order: str = "page_id") -> DataFrame:
    """The first ``limit`` pages of a product, short paths first, in input order among equals."""
    found = rows.where(in_product(F.col("url"), product)).withColumn("rank", crawl_rank(F.col("url"), product))
    return found.orderBy("rank", order).limit(limit)


def json_column(columns: list[str], debug: list[str] | None = None) -> Column:
    """One JSON text for each result: the public fields that there are, and a debug struct where asked for."""
    public = [c for c in ("content", "url", "title", "anchor", "similarity") if c in columns]
    extra = [F.struct(*debug).alias("debug")] if debug else []
    return F.to_json(F.struct(*public, *extra))


def to_json(rows: DataFrame, debug: list[str] | None = None) -> DataFrame:
    return rows.select(json_column(rows.columns, debug).alias("json"))
