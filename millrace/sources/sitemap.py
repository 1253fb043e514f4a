"""Sitemaps: index files lead to more files; page addresses come in document order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCS = "//*[local-name()='{}']/*[local-name()='loc']/text()"


def locations(files: DataFrame) -> DataFrame:
    """path, is_index and locs of sitemap files (path, content)."""
    xml = F.regexp_replace("content", r"^\s*<\?xml[^>]*\?>|<!DOCTYPE[^>]*>", "")
    rows = files.select("path", F.xpath(xml, F.lit(_LOCS.format("sitemap"))).alias("maps"), F.xpath(xml, F.lit(_LOCS.format("url"))).alias("pages"), F.col("content").rlike(r"<(?:\w+:)?sitemapindex[\s>]").alias("is_index"))
    return rows.select("path", "is_index", F.transform(F.when(F.col("is_index"), F.col("maps")).otherwise(F.col("pages")), lambda x: F.trim(x)).alias("locs"))


def scan(files: DataFrame, start: str, depth: int = 10) -> DataFrame:
    """url and order of all pages under the sitemap ``start``; depth first, repeated addresses stay, loops end at ``depth``."""
    found = locations(files).persist()
    level = found.where(F.col("path") == start).withColumn("place", F.array().cast("array<int>"))
    out = None
    for _ in range(depth):
        pages = level.where("NOT is_index").select("place", F.posexplode("locs").alias("at", "url"))
        out = pages if out is None else out.unionByName(pages)
        maps = level.where("is_index").select("place", F.posexplode("locs").alias("at", "next"))
        level = maps.join(found, maps.next == found.path).select("path", "is_index", "locs", F.concat("place", F.array("at")).alias("place"))
        if level.isEmpty():
            break
    return out.select("url", F.concat("place", F.array("at")).alias("order"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Sitemap files of a folder as (path, content)."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
