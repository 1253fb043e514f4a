import numpy as np
import pytest

from millrace.operators import vector, vector_index

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{FOLDER}/embeddings.parquet").cache()


def test_recall_against_brute_force(spark, vectors):
    queries = vectors.selectExpr("vec_id AS query_id", "embedding")
    exact = vector.top_k_batch(vectors, queries, 5, 0.1).cache()
    centres = vector_index.fit(vectors)
    index = vector_index.assign(vectors, centres).cache()
    assert index.count() == vectors.count()
    assert vector_index.recall(exact, vector_index.search_batch(index, centres, queries, 5, 0.1)) >= 0.9
    everything = vector_index.search_batch(index, centres, queries, 5, 0.1, probes=len(centres))
    assert vector_index.recall(exact, everything) == 1.0


def test_written_index_reads_probed_cells_only(spark, vectors, tmp_path):
    centres = vector_index.build(vectors, f"{tmp_path}/index")
    query = [float(x) for x in vectors.where("vec_id = 3").first().embedding]
    found = vector_index.search(spark, f"{tmp_path}/index", centres, query, 5, 0.1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.first().vec_id == 3 and "PartitionFilters: [cell" in plan
    every = vector_index.search(spark, f"{tmp_path}/index", centres, query, 5, 0.1, probes=len(centres))
    assert every.collect() == vector.top_k(vectors, query, 5, 0.1).collect()


def test_small_and_empty(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "vec_id int, embedding array<float>")
    centres = vector_index.fit(rows)
    assert np.allclose(centres, [[1, 0], [1, 0]]) and vector_index.assign(rows, centres).count() == 2
    assert len(vector_index.fit(rows.where("false"))) == 0
