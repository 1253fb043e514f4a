import pytest

from millrace.operators import fusion


def branch(spark, source, scores):
    rows = [(source, k, s) for k, s in scores]
    return fusion.ranked(spark.createDataFrame(rows, "source string, chunk_id string, similarity double"))


def two(spark, original, rewritten, limit):
    rows = fusion.fuse_two(branch(spark, "o", original), branch(spark, "r", rewritten), limit).orderBy("position").collect()
    return [(r.chunk_id, r.similarity, r.matched) for r in rows]


@pytest.mark.parametrize(
    ("original", "rewritten", "limit", "expected"),
    [
        ([("a", 0.72)], [("a", 0.81)], 5, [("a", 0.81, "both")]),
        ([("a", 0.72), ("b", 0.61)], [("b", 0.63), ("c", 0.67)], 5, [("a", 0.72, "original"), ("c", 0.67, "rewritten"), ("b", 0.63, "both")]),
        ([("a", 0.7), ("b", 0.7)], [("b", 0.7), ("c", 0.7)], 5, [("b", 0.7, "both"), ("a", 0.7, "original"), ("c", 0.7, "rewritten")]),
        ([("a", 0.7), ("b", 0.51)], [("c", 0.69), ("d", 0.68)], 3, [("a", 0.7, "original"), ("c", 0.69, "rewritten"), ("d", 0.68, "rewritten")]),
        ([("a", 0.9), ("b", 0.8)], [("c", 0.85), ("d", 0.75)], 2, [("a", 0.9, "original"), ("c", 0.85, "rewritten")]),
    ],
)
def test_two_branches(spark, original, rewritten, limit, expected):
    assert two(spark, original, rewritten, limit) == expected


def fused(spark, branches, limit=5):
    rows = None
    for source, scores in branches.items():
        part = branch(spark, source, scores)
        rows = part if rows is None else rows.unionByName(part)
    return fusion.fuse(rows, limit).orderBy("position").collect()


def test_equal_ranks_add_up(spark):
    (row,) = fused(spark, {"vector_original": [("a", 0.8)], "lexical_original": [("a", 0.6)]})
    assert row.score == 1 / 61 + 1 / 61 and row.matched == ["vector_original", "lexical_original"] and row.best_source == "vector_original"


def test_rewritten_branches_weigh_less(spark):
    rows = fused(spark, {"vector_original": [("a", 0.5)], "vector_rewritten": [("b", 0.9)]})
    assert [(r.chunk_id, r.score) for r in rows] == [("a", 1 / 61), ("b", 0.75 / 61)]


def test_raw_similarity_decides_equal_scores(spark):
    rows = fused(spark, {"vector_original": [("a", 0.9), ("b", 0.8)], "lexical_original": [("c", 0.85), ("d", 0.75)]}, 2)
    assert [r.chunk_id for r in rows] == ["a", "c"]


def test_branch_names_keep_their_order(spark):
    (row,) = fused(spark, {"lexical_rewritten": [("s", 0.7)], "lexical_original": [("s", 0.6)], "vector_original": [("s", 0.8)]})
    assert row.matched == ["vector_original", "lexical_original", "lexical_rewritten"]


def test_ids_decide_last(spark):
    rows = fused(spark, {"vector_original": [("b", 0.5)], "lexical_original": [("a", 0.5)]})
    assert [r.chunk_id for r in rows] == ["b", "a"]  # the better source comes before the id
    counts = fusion.branch_counts(branch(spark, "vector_original", [("a", 1.0), ("b", 0.5)])).first()
    assert (counts.n_vector_original, counts.n_lexical_original, counts.n_fused) == (2, 0, 2)


def test_many_queries_at_once(spark):
    rows = spark.createDataFrame([(q, "vector_original", c, s) for q in (1, 2) for c, s in (("a", 0.9 - q / 10), ("b", 0.8))], "query_id int, source string, chunk_id string, similarity double")
    got = fusion.fuse(fusion.ranked(rows, ["query_id", "source"]), 1, ["query_id"]).orderBy("query_id").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, "a"), (2, "b")]
