import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import token
from millrace.operators import models


def by_hand(payload: bytes, key: bytes) -> str:
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    body = url(payload)
    return f"{body}.{url(hmac.new(key, body.encode(), hashlib.sha256).digest())}"


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long key " * 20])
def test_tokens_equal_the_library(spark, key):
    payloads = [json.dumps({"sub": "é" * i, "exp": i * 10}) for i in range(12)]
    rows = spark.createDataFrame([(p, by_hand(p.encode(), key)) for p in payloads], "p string, t string")
    signed = rows.select("p", "t", token.sign(F.col("p"), key).alias("s"), token.is_valid(F.col("t"), key, F.lit(55)).alias("v"), token.payload_of(F.col("t")).alias("back"))
    for i, r in enumerate(signed.collect()):
        assert r.s == r.t and r.back == r.p and r.v == (i * 10 > 55)


def test_forged_tokens(spark):
    good = by_hand(b'{"exp": 100}', b"k")
    bad = [good[:-1] + ("A" if good[-1] != "A" else "B"), good.split(".")[0], "", "a.b", good + ".x", by_hand(b"{}", b"k"), by_hand(b"no json", b"k"), None]
    rows = spark.createDataFrame([(t,) for t in bad], "t string")
    assert [r.v for r in rows.select(token.is_valid(F.col("t"), b"k", F.lit(5)).alias("v")).collect()] == [False] * len(bad)


def test_batched_embedding():
    calls, waits = [], []

    def batch(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise models.Busy(2.0)
        if "bad" in texts:
            raise ValueError
        return [[float(len(t))] for t in texts]

    out = models.embed_many(["a", "bb", "bad", "c"], batch, lambda t: [-1.0], 2, 2, waits.append)
    assert out == [[1.0], [2.0], [-1.0], [-1.0]] and calls == [2, 2, 2] and waits == [3.0]
    with pytest.raises(models.Busy):
        models.embed_many(["a"], lambda t: (_ for _ in ()).throw(models.Busy(0.0)), lambda t: [], retries=1, sleep=lambda s: None)
