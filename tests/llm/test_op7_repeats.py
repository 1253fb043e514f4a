import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import documents, prose, save

from millrace.llm import repeats


def brute(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        hit = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(hit) if x and (not i or not hit[i - 1]))
        out.append((len(r), sum(hit), runs, hashlib.sha256(bytes(b for b, x in zip(r, hit, strict=True) if not x)).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    passage, second = prose(rng, 90), prose(rng, 70)
    texts = [None, "", "short", "ab" * 700, "x" * 399, "y" * 400, "z" * 401, passage, passage[5:480], "é" * 450]
    for _ in range(30):
        own = prose(rng, rng.randrange(5, 200))
        if rng.random() < 0.6:
            a = rng.randrange(0, 120)
            own += " " + passage[a : a + rng.randrange(390, 520)] + " " + prose(rng, 20)
        if rng.random() < 0.3:
            own = second + own + second[10:]
        texts.append(own)
    return texts + texts[12:18] + ["é" * 450]


@pytest.mark.parametrize("most", [1 << 18, 3000])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(repeats, "BATCH_BYTES", most)
    texts = corpus()
    folder = save(documents(spark, list(enumerate(texts))), tmp_path, "documents")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op7_repeats(spark, folder).collect()}
    assert rows == dict(enumerate(brute(texts)))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in duckdb.sql(repeats.ORACLE).fetchall()} == rows


def test_empty_table_and_repeated_rows(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0
    text = prose(random.Random(1), 100)
    rows = repeats.remove_repeats(documents(spark, [(1, text), (1, text), (None, None)]).withColumnRenamed("source", "digest")).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(0, 0), (len(text), len(text)), (len(text), len(text))]


def test_transform_against_counting():
    rng = random.Random(5)
    for _ in range(20):
        parts = ["".join(rng.choices("ab", k=rng.randrange(0, 60))).encode() for _ in range(rng.randrange(1, 6))] + [b"abab" * 8]
        seen = Counter(p[i : i + 7] for p in parts for i in range(len(p) - 6))
        for p, starts in zip(parts, repeats.repeated_starts(parts, 7), strict=True):
            assert starts.tolist() == [i for i in range(len(p) - 6) if seen[p[i : i + 7]] > 1]


def test_segments_cover_every_window():
    data = prose(random.Random(2), 4000).encode()
    runs = repeats.segments(data)
    covered = np.concatenate([np.arange(first, last + 1) for _, _, first, last in runs])
    assert covered.tolist() == list(range(len(data) - 399))
    assert all(first <= place and place + repeats.GRAM <= first + 400 and place <= last + 400 - repeats.GRAM for _, place, first, last in runs)


def test_text_longer_than_a_block(spark):
    rng = random.Random(8)
    passage = prose(rng, 400)
    head = "".join(rng.choices("abcdefgh ", k=repeats.BLOCK - len(passage) // 2))
    texts = [head + passage + "".join(rng.choices("abcdefgh ", k=5000)), "other " + passage + " end"]
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(documents(spark, list(enumerate(texts)))).collect()}
    raws = [t.encode() for t in texts]
    at = [raws[0].index(passage.encode()), 6]
    for k, raw in enumerate(raws):
        a, b = at[k], at[k] + len(passage)
        other = raws[1 - k]
        while a and at[1 - k] - (at[k] - a) > 0 and raw[a - 1] == other[at[1 - k] - (at[k] - a) - 1]:
            a -= 1
        while b < len(raw) and at[1 - k] + (b - at[k]) < len(other) and raw[b] == other[at[1 - k] + (b - at[k])]:
            b += 1
        assert rows[k] == (len(raw), b - a, 1, hashlib.sha256(raw[:a] + raw[b:]).hexdigest())
