"""Tables written in Markdown: the test matrix of queries and expected decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """The rows below the header line up to the first line without bars; a row of another width is an error."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    line = F.trim("line")
    cells = F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = text.select("n", line.startswith("|").alias("barred"), cells.alias("cells"))
    start = rows.where(F.col("barred") & (F.col("cells") == F.array(*map(F.lit, header)))).agg(F.min("n").alias("n")).first().n
    if start is None:
        raise ValueError(f"no table with the header {header}")
    end = rows.where(~F.col("barred") & (F.col("n") > start)).agg(F.min("n").alias("n")).first().n
    body = rows.where((F.col("n") > start + 1) & (F.lit(end is None) | (F.col("n") < (end or 0))))
    width = F.when(F.size("cells") == len(header), F.col("cells")).otherwise(F.raise_error(F.concat(F.lit("wrong number of cells in line "), F.col("n") + 1)))
    return body.withColumn("cells", width).select("n", *(F.col("cells")[i].alias(name) for i, name in enumerate(header)))
