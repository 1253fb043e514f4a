"""Approximate vector search: an inverted file over cells of a spherical k-means.

The cells' centres are fitted on a bounded sample (``FIT_ROWS`` rows, chosen by a hash of the key); every row is then
put into the cell of its nearest centre, in one pass with the centres broadcast (``CELLS`` vectors, a fixed size). The
index is a table partitioned by cell, so a query reads ``probes`` cells and no others. Large cells are dealt over several
files by a salt. Recall follows ``probes``; all cells give the exact answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from . import vector

FIT_ROWS, CELLS, PROBES, TURNS, SALTS = 20_000, 32, 16, 12, 8


def fit(vectors: DataFrame, cells: int = CELLS, key: str = "vec_id", column: str = "embedding") -> np.ndarray:
    """Unit centres of the cells; fewer where there are fewer vectors."""
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("h"))
    n = rows.count()
    share = rows if n <= FIT_ROWS else rows.where(F.col("h") < int(FIT_ROWS / n * (1 << 30)))
    found = [r.v for r in share.orderBy("h", "v").limit(FIT_ROWS).collect()]
    unit = _unit(np.array(found, dtype=np.float64)) if found else np.zeros((0, 1))
    centres = unit[np.linspace(0, len(unit) - 1, min(cells, len(unit))).astype(int)] if len(unit) else unit
    for _ in range(TURNS if len(unit) else 0):
        own = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        empty = np.linalg.norm(sums, axis=1) == 0
        sums[empty] = centres[empty]
        centres = _unit(sums)
    return centres


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1.0)


def assign(vectors: DataFrame, centres: np.ndarray, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, vector and cell of every row that has a vector."""
    rows = vectors.select(key, column).where(F.col(column).isNotNull())
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType())])
    arrow = to_arrow_schema(schema)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.array(batch.column(1).to_pylist(), dtype=np.float64) @ shared.value.T
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), batch.column(1).cast(arrow.field(1).type), pa.array(own.argmax(1), pa.int32())], schema=arrow)

    return rows.mapInArrow(run, schema)


def build(vectors: DataFrame, path: str, cells: int = CELLS, key: str = "vec_id", column: str = "embedding") -> np.ndarray:
    """Write the index; gives the centres."""
    centres = fit(vectors, cells, key, column)
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS))
    assign(vectors, centres, key, column).repartition(F.col("cell"), salt).write.mode("overwrite").partitionBy("cell").parquet(path)
    return centres


def nearest_cells(centres: np.ndarray, query: list[float], probes: int = PROBES) -> list[int]:
    return np.argsort(-(centres @ np.asarray(query, dtype=np.float64)), kind="stable")[:probes].tolist()


def search(spark: SparkSession, path: str, centres: np.ndarray, query: list[float], k: int, threshold: float, probes: int = PROBES, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, similarity of the k best rows of the probed cells; the other cells' files are not read."""
    rows = spark.read.parquet(path).where(F.col("cell").isin(nearest_cells(centres, query, probes)))
    return vector.top_k(rows, query, k, threshold, key, column)


def search_batch(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, threshold: float, probes: int = PROBES, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, key, similarity, rank: each query against the rows of its cells only, in blocks of queries."""
    found = vector.top_k_batch(index, queries, k, threshold, key, column, cells=lambda q: nearest_cells(centres, q, probes))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return found.drop("rank").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recall(exact: DataFrame, found: DataFrame, key: str = "vec_id") -> float:
    """The share of the exact answer's rows that were found."""
    both = exact.select("query_id", key).join(found.select("query_id", key), ["query_id", key]).count()
    return both / max(1, exact.count())
