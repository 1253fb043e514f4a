"""Exact vector search: cosine similarity, strict threshold, top k with a tie-break by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A query block is a matrix that every task holds; its rows are counted before it is broadcast.
MAX_QUERY_BLOCK = 4096


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def half(vector: Column) -> Column:
    """Each component rounded to the nearest half-precision number, ties to even; infinite beyond 65504."""

    def one(x: Column) -> Column:
        size = F.abs(x.cast("double"))
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
        near = F.rint(size / step) * step
        return F.when(size == 0, F.lit(0.0)).otherwise(F.signum(x.cast("double")) * F.when(near > 65504, F.lit(float("inf"))).otherwise(near))

    return F.transform(vector, one)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision, rounded to 6 places; null where either is null or zero."""
    size = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(size > 0, F.round(_dot(a, b) / size, 6))


def above(vectors: DataFrame, query: list[float], threshold: float, key: str = "vec_id", column: str = "embedding", in_half: bool = False) -> DataFrame:
    """key, similarity of the rows above the threshold; no vector leaves the scan's task. ``in_half`` compares both sides as a store of half-precision vectors keeps them."""
    own, asked = (half(F.col(column)), np.array(query).astype(np.float16).tolist()) if in_half else (F.col(column), query)
    scored = vectors.select(key, cosine(own, F.array(*map(F.lit, asked))).alias("similarity"))
    return scored.where(F.col("similarity") > threshold)


def top_k(vectors: DataFrame, query: list[float], k: int, threshold: float, key: str = "vec_id", column: str = "embedding", in_half: bool = False) -> DataFrame:
    """key, similarity of the k most similar rows above the threshold; one scan and a bounded heap in each task."""
    return above(vectors, query, threshold, key, column, in_half).orderBy(F.desc("similarity"), key).limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, threshold: float, key: str = "vec_id", column: str = "embedding", cells: Callable[[list[float]], list[int]] | None = None) -> DataFrame:
    """query_id, key, similarity, rank for many queries (query_id, embedding); with ``cells``, of rows in a query's cells only.

    Queries are taken in blocks of ``MAX_QUERY_BLOCK``. In each task a block meets each Arrow batch as one matrix
    product, and only the batch's k best rows of each query leave Python, so what is shuffled is batches x queries x k.
    """
    rows = queries.select("query_id", "embedding").where("embedding IS NOT NULL").toLocalIterator()
    out: DataFrame | None = None
    kind = {f.name: f.dataType.simpleString() for f in vectors.select(key).schema} | {f.name: f.dataType.simpleString() for f in queries.schema}
    schema = f"query_id {kind['query_id']}, {key} {kind[key]}, similarity double"
    types = [to_arrow_type(f.dataType) for f in (queries.schema["query_id"], vectors.schema[key])]
    while (block := list(islice(rows, MAX_QUERY_BLOCK))) or out is None:
        ids = [r.query_id for r in block]
        matrix = np.array([r.embedding for r in block], dtype=np.float64) if block else np.zeros((0, 1))
        probed = [frozenset(cells(r.embedding)) for r in block] if cells else None
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300), probed))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, own, probed = shared.value
            for batch in batches:
                kept = [i for i, v in enumerate(batch.column(1).to_pylist()) if v is not None]
                if not kept or not names:
                    continue
                keys = batch.column(0).to_numpy(zero_copy_only=False)[kept]
                found = np.array(batch.column(1).take(pa.array(kept)).to_pylist(), dtype=np.float64)
                sizes = np.linalg.norm(found, axis=1, keepdims=True)
                sims = np.round(own @ (found / np.where(sizes > 0, sizes, np.inf)).T, 6)
                if probed is not None:
                    cell = batch.column(2).to_numpy(zero_copy_only=False)[kept]
                    here = {c: np.array([c in p for p in probed]) for c in set(cell.tolist())}
                    sims = np.where(np.stack([here[c] for c in cell.tolist()], axis=1), sims, -np.inf)
                q, c, s = [], [], []
                for i, name in enumerate(names):
                    hit = np.flatnonzero(sims[i] > threshold)
                    hit = hit[np.lexsort((keys[hit], -sims[i][hit]))][:k]
                    q += [name] * len(hit)
                    c.append(keys[hit])
                    s.append(sims[i][hit])
                yield pa.RecordBatch.from_arrays([pa.array(q, types[0]), pa.array(np.concatenate(c)).cast(types[1]), pa.array(np.concatenate(s), pa.float64())], names=["query_id", key, "similarity"])

        part = vectors.select(key, column, *(["cell"] if cells else [])).mapInArrow(score, schema)
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(vectors: DataFrame, documents: DataFrame, query: list[float], k: int, threshold: float) -> DataFrame:
    """Top k of the rows that have a document: vec_id, similarity, lang, source.

    What is joined is one id and one number for each row above the threshold; adaptive execution broadcasts it if small.
    """
    hits = above(vectors, query, threshold).join(documents.select(F.col("doc_id").alias("vec_id"), "lang", "source"), "vec_id")
    return hits.select("vec_id", "similarity", "lang", "source").orderBy(F.desc("similarity"), "vec_id").limit(k)
