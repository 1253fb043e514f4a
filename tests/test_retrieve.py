import dataclasses
import json
import time

import numpy as np
import pytest

from millrace.config import Retrieval
from millrace.operators import chat, lexical, rerank, retrieve, vector
from millrace.operators.models import embed_text
from millrace.plans import retrieval_queries


def candidates(n):
    return [{"chunk_id": f"c{i}", "content": f"text {i}"} for i in range(n)]


def run(reply, n=6, **more):
    model = reply if callable(reply) else lambda q, c: reply
    return rerank.rerank("q", candidates(n), Retrieval(**{"rerank": True, "limit": 3, "rerank_candidates": 6, "rerank_timeout_s": 0.5} | more), model)


def test_statuses():
    order = [f"c{i}" for i in (5, 4, 3, 2, 1, 0)]
    done = run("```json\n" + json.dumps({"rankedIds": order, "diagnostics": [{"chunkId": "c4", "reason": "good"}, {"chunkId": "c4", "reason": "better"}]}) + "\n```")
    assert done.status == "applied" and [c["chunk_id"] for c in done.candidates] == order[:3]
    assert done.diagnostics[1] == {"chunkId": "c4", "rank": 2, "reason": "better"}
    for reply in (json.dumps({"rankedIds": order[:-1]}), json.dumps({"rankedIds": [*order[:-1], "c5"]}), json.dumps({"rankedIds": [*order[:-1], "zz"]}), "not json", json.dumps({"rankedIds": order, "diagnostics": [1]}), '{"other": 1}'):
        done = run(reply)
        assert done.status == "fallback_invalid_output" and [c["chunk_id"] for c in done.candidates] == ["c0", "c1", "c2"] and done.fallback_reason == "invalid_output"
    assert run(lambda q, c: 1 / 0).status == "fallback_model_failed"
    assert run(lambda q, c: time.sleep(1), rerank_timeout_s=0.05).status == "fallback_timeout"
    assert run("x", rerank=False).status == "skipped_disabled" and run("x", n=3).status == "skipped_below_limit"
    assert len(run("x", n=20).before_ids) == 6


def test_vector_search_against_numpy(spark):
    rng = np.random.default_rng(2)
    own = rng.normal(size=(200, 8)).astype(np.float32)
    own[7] = own[3]
    rows = [(i, v.tolist()) for i, v in enumerate(own)] + [(500, None), (501, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<float>").repartition(5)
    unit = own.astype(float) / np.linalg.norm(own.astype(float), axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)

    def best(q):
        return [(i, sims[q, i]) for i in sorted(range(200), key=lambda i: (-sims[q, i], i)) if sims[q, i] > 0.1][:6]

    assert [(r.vec_id, r.similarity) for r in vector.top_k(vectors, rows[3][1], 6, 0.1).collect()] == best(3)
    batch = vector.top_k_batch(vectors, vectors.selectExpr("vec_id AS query_id", "embedding").where("query_id % 10 = 3 OR query_id = 500"), 6, 0.1)
    found = {}
    for r in batch.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.similarity))
    assert found == {q: best(q) for q in range(3, 200, 10)}


def test_half_precision_against_numpy(spark):
    rng = np.random.default_rng(3)
    edge = [0.0, -0.0, 1.0, 2.0**-24, 2.0**-25, 3 * 2.0**-25, 6.1e-5, 65504.0, 65519.0, 65520.0, 1e-12, 2049.0, 2051.0, 0.1, -0.3333]
    own = [edge, *(rng.normal(size=15) * 10.0 ** rng.integers(-7, 5, size=15) for _ in range(200))]
    rows = [(i, [float(x) for x in np.array(v, dtype=np.float32)]) for i, v in enumerate(own)]
    vectors = spark.createDataFrame([*rows, (900, None)], "vec_id int, embedding array<float>")
    found = dict(map(tuple, vectors.select("vec_id", vector.half(vectors.embedding)).collect()))
    with np.errstate(over="ignore"):
        assert found.pop(900) is None and all((np.array(found[i]) == np.array(v, dtype=np.float32).astype(np.float16).astype(float)).all() for i, v in rows)
    near = {i: np.array(v, dtype=np.float32).astype(np.float16).astype(float) for i, v in rows[1:]}
    query = near[1]
    expected = {i: round(float(v @ query / np.linalg.norm(v) / np.linalg.norm(query)), 6) for i, v in near.items() if np.isfinite(v).all()}
    got = dict(map(tuple, vector.above(vectors.where("vec_id > 0"), rows[1][1], 0.1, in_half=True).collect()))
    assert all(abs(got[i] - x) < 2e-6 for i, x in expected.items() if x > 0.10001)


def test_debug_logs_change_nothing(corpus, caplog):
    caplog.set_level("INFO")
    plain = Retrieval(limit=2, threshold=0.05, rerank=True, rerank_candidates=4)
    quiet = retrieve.retrieve(corpus, "proxy server settings", plain)
    assert not [r for r in caplog.records if r.name.startswith("millrace")]
    loud = retrieve.retrieve(corpus, "proxy server settings", dataclasses.replace(plain, rewrite_debug=True, rerank_debug=True))
    assert loud == quiet and [r.name for r in caplog.records if r.name.startswith("millrace")] == ["millrace.operators.retrieve", "millrace.operators.rerank"]
    assert chat.answer("p", ["m"], lambda m, p: "x", verbose=True) == ("m", "x") and "'prompt': 'p'" in caplog.records[-1].getMessage()
    env = Retrieval.of({"QUERY_REWRITE_DEBUG": "true", "RERANKING_DEBUG": "true"})
    assert env.rewrite_debug and env.rerank_debug


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vector, "MAX_QUERY_BLOCK", 2)
    vectors = spark.createDataFrame([(i, [float(i == k) + 0.1 for k in range(5)]) for i in range(5)], "vec_id int, embedding array<float>")
    rows = vector.top_k_batch(vectors, vectors.selectExpr("vec_id AS query_id", "embedding"), 1, 0.5).collect()
    assert sorted((r.query_id, r.vec_id) for r in rows) == [(i, i) for i in range(5)]
    assert vector.top_k_batch(vectors, vectors.selectExpr("vec_id AS query_id", "embedding").where("false"), 1, 0.5).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["set up the proxy server for development", "build output folder settings", "plugin order and hooks", "proxy server ports and hosts", "environment variables and modes", "proxy rules", "server start options", "static assets"]
    rows = [(i, i % 3, t, "top" if i == 0 else None, embed_text(t)) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id int, doc_id int, content string, anchor string, embedding array<float>").cache()
    documents = spark.createDataFrame([(i, f"https://e.org/{i}", f"T{i}") for i in range(3)], "doc_id int, url string, title string")
    return retrieve.Corpus(chunks, documents, lexical.trigram_postings(chunks).cache())


def test_plain_vector_plan(corpus):
    rows, debug = retrieve.retrieve(corpus, "  set up   the proxy server for development ", Retrieval(threshold=0.1, limit=2))
    assert rows[0]["url"] == "https://e.org/0#top" and rows[0]["similarity"] == pytest.approx(1.0) and rows[0]["matched"] == ["vector_original"]
    assert debug["rewriteReason"] == "disabled" and debug["reranking"]["status"] == "skipped_disabled" and debug["originalQuery"] == "set up the proxy server for development"


def test_two_branch_plan(corpus):
    rows, debug = retrieve.retrieve(corpus, "please tell me the proxy server ports and hosts", Retrieval(threshold=0.1, limit=3, rewrite=True))
    assert debug["rewriteApplied"] and debug["rewrittenQuery"] == "proxy server ports and hosts" and set(debug["branchCounts"]) == {"vector_original", "vector_rewritten"}
    assert rows[0]["content"] == "proxy server ports and hosts" and rows[0]["matched"] == ["vector_original", "vector_rewritten"]


def test_hybrid_plan_with_reranking(corpus):
    config = Retrieval(threshold=0.1, limit=2, hybrid=True, rerank=True, rerank_candidates=5)
    backwards = lambda q, c: json.dumps({"rankedIds": [x["chunk_id"] for x in reversed(c)]})
    rows, debug = retrieve.retrieve(corpus, "proxy server ports and hosts", config, reranker=backwards)
    assert debug["reranking"]["status"] == "applied" and len(rows) == 2 and len(debug["reranking"]["beforeIds"]) > 2
    assert debug["reranking"]["afterIds"] == debug["reranking"]["beforeIds"][::-1][:2]
    strict, debug = retrieve.retrieve(corpus, "proxy server ports and hosts", Retrieval(threshold=0.1, limit=2, hybrid=True, rerank=True, cut_before_rerank=True), reranker=backwards)
    assert debug["reranking"]["status"] == "skipped_below_limit" and len(strict) == 2


@pytest.mark.parametrize("most", [0, 100])
def test_vectors_apart_give_the_joined_corpus(spark, corpus, most, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_KEYS", most)
    chunks = corpus.chunks.drop("embedding").unionByName(spark.createDataFrame([(20, 0, "proxy server ports", None), (21, 0, None, None)], "chunk_id int, doc_id int, content string, anchor string"))
    vectors = corpus.chunks.where("chunk_id <> 3").select("chunk_id", "embedding").unionByName(spark.createDataFrame([(21, None), (99, embed_text("proxy server"))], "chunk_id int, embedding array<float>"))
    apart = retrieve.Corpus(chunks, corpus.documents, vectors=vectors)
    whole = retrieve.Corpus(chunks.join(vectors, "chunk_id"), corpus.documents)
    for config in (Retrieval(threshold=-1.0, limit=3), Retrieval(threshold=-1.0, limit=9, rewrite=True, hybrid=True)):
        found = retrieve.retrieve(apart, "please tell me the proxy server ports", config)
        assert found == retrieve.retrieve(whole, "please tell me the proxy server ports", config) and found[0]


def test_retrieve_plans_shuffles_no_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval_queries, "spread", lambda df: df)  # deals out tables of few files, whatever is joined
    texts = [f"{' '.join(words)} {i}" for i, words in enumerate(np.random.default_rng(0).integers(0, 10**9, (640, 200)).astype(str).tolist())]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, embed_text(t)) for i, t in enumerate(texts)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(2, texts[5])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def written():
        own = spark._jsc.sc().statusStore().executorList(False)
        return sum(own.apply(i).totalShuffleWrite() for i in range(own.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        assert retrieval_queries.retrieve_plans(spark, str(tmp_path)).count() == 15
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert written() - before < sum(map(len, texts)) / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rewrite_decisions(corpus):
    config = Retrieval(rewrite=True)
    assert retrieve.decide_rewrite(corpus, "what about the other one", config)[1] == "context_dependent"
    assert retrieve.decide_rewrite(corpus, "proxy rules here", config, lambda q: 1 / 0)[1] == "model_failed"
    assert retrieve.decide_rewrite(corpus, "proxy rules here", config, lambda q: " Proxy  rules here ")[1] == "equivalent_to_original"
    assert retrieve.decide_rewrite(corpus, "proxy rules here", config, lambda q: "")[1] == "equivalent_to_original"
    assert retrieve.decide_rewrite(corpus, "proxy rules here", config, lambda q: "other words") == ("other words", "applied")


def test_ambiguity_gate():
    ask = '{"decision": "clarify", "clarificationQuestion": "Which one?"}'
    assert chat.ambiguity("it", "", True, lambda p: f"```json\n{ask}\n```") == ("clarify", "Which one?")
    for reply in ("no", '{"decision": "clarify"}', '{"decision": "proceed"}', ask[:-1] + ', "more": 1}'):
        assert chat.ambiguity("it", "", True, lambda p, r=reply: r) == ("proceed", None)
    assert chat.ambiguity("it", "", True, lambda p: 1 / 0)[0] == "proceed" and chat.ambiguity("it", "", False, lambda p: ask)[0] == "proceed"
    assert chat.ambiguity("it", "", True, lambda p: time.sleep(1), 0.05)[0] == "proceed"


def test_model_fallback():
    def send(name, prompt):
        if name != "c":
            raise chat.ModelMissing(name)
        return prompt.upper()

    assert chat.answer("hi", ["a", "a", "c"], send) == ("c", "HI")
    with pytest.raises(chat.ModelMissing):
        chat.answer("hi", ["a", "b"], send)
    with pytest.raises(ZeroDivisionError):
        chat.answer("hi", ["a", "c"], lambda n, p: 1 / 0)
