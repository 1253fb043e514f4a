import random
import zlib
from array import array

import numpy as np
import pytest
from helpers import documents, prose, save
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, tokenstore


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def corpus():
    rng = random.Random(3)
    texts = [None, "", " ", "x<|endoftext|>y", "don't", "東京 タワー 🙂", "a" * 2000, "naïve Größe", "  two  blanks \n"] + [prose(rng, rng.randrange(1, 80)) for _ in range(60)]
    ids = rng.sample(range(-50, 100_000), len(texts))
    return list(zip(ids, texts, strict=True))


def expected(rows, library):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library(spark, tmp_path, library):
    rows = corpus()
    folder = save(documents(spark, rows), tmp_path, "documents")
    got = tokenstore.op6_token_store(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected(rows, library)


def test_lookup_by_key(spark, tmp_path, library):
    rows = corpus()
    doc_id, text = rows[20]
    out = f"file://{tmp_path}/store"
    tokenstore.write_store(documents(spark, [*rows, (doc_id, text), (None, "no id")]), out)
    shards = tokenstore.index_shards(spark, out)
    keys = spark.createDataFrame([(k,) for k in (doc_id, doc_id, rows[3][0], 123_456_789, None)], "doc_id long")
    found = {}
    for r in tokenstore.lookup(keys, out, shards).collect():
        found.setdefault(r.key, []).append(r.ids)
    ids = library.encode(text, add_special_tokens=False).ids
    assert found == {doc_id: [ids, ids], rows[3][0]: [library.encode(rows[3][1], add_special_tokens=False).ids]}
    back = tokenstore.read_store(spark, out).collect()
    assert len(back) == len(rows) + 2 and sum(r.doc_id is None for r in back) == 1
    assert sorted(tokenstore.read_store(spark, out, max_shards=0).collect(), key=str) == sorted(back, key=str)
    assert sorted(r.start for r in back)[0] == 0 and len({r.start for r in back}) == len(back)


def test_empty_table(spark, tmp_path):
    out = f"file://{tmp_path}/store"
    tokenstore.write_store(documents(spark, []), out)
    assert tokenstore.read_store(spark, out).count() == 0
    assert tokenstore.lookup(spark.createDataFrame([(1,)], "doc_id long"), out, tokenstore.index_shards(spark, out)).count() == 0


def test_shards_follow_the_bytes(spark, tmp_path, library):
    rows = [*corpus(), *[(7, f"same key {i}") for i in range(40)], *[(None, f"no key {i}") for i in range(40)]]
    docs = documents(spark, rows).withColumns({"value": F.lit("x"), "file": F.lit(1), "my col": F.lit(2)})
    out = f"file://{tmp_path}/store"
    tokenstore.write_store(docs, out, shard_bytes=500)
    assert len(list((tmp_path / "store").glob("part-*"))) > 8
    back = sorted(tokenstore.read_store(spark, out).collect(), key=lambda r: r.start)
    assert [r.start for r in back] == [sum(x.n_tokens for x in back[:k]) for k in range(len(back))]
    assert [r.doc_id for r in back] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    found = tokenstore.lookup(spark.createDataFrame([(7,)], "doc_id long"), out, tokenstore.index_shards(spark, out)).collect()
    assert sorted(r.ids for r in found) == sorted(library.encode(t or "", add_special_tokens=False).ids for k, t in rows if k == 7)


def test_very_long_text(spark, tmp_path, library):
    text = "word and word " * 60_000
    out = f"file://{tmp_path}/store"
    tokenstore.write_store(documents(spark, [(1, text)]), out)
    assert tokenstore.read_store(spark, out).first().n_tokens == len(library.encode(text, add_special_tokens=False).ids) + 1


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 100, 5000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        index = tokenstore.PerfectHash.build(keys)
        assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))


def test_fingerprint_refuses_strangers():
    shard = tokenstore.Shard(tokenstore.pack_shard([1, 5, 9], [array("I", [7, 0]).tobytes()] * 3, False) + b"\0\0")
    assert [x.tolist() for x in shard.get(5)] == [[7]]
    assert all(shard.get(k) == [] for k in range(100, 2000))
