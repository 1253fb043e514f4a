import random
import shutil
from datetime import datetime, timedelta

from millrace.config import Quota
from millrace.operators import quota
from millrace.operators.quota import Meter
from millrace.streaming import ingest
from millrace.streaming import quota as quota_stream

START = datetime(2024, 3, 1, 23, 57)


def requests(n=400):
    rng = random.Random(5)
    return [(i, START + timedelta(seconds=rng.randrange(0, 400), microseconds=i), i % 3, rng.randrange(0, 900)) for i in range(n)]


def test_large_request_is_refused_and_a_small_one_admitted():
    meter = Meter(Quota(5, 1000, 4, 0))
    assert meter.check(START, 900) == (True, None, 0)
    assert meter.check(START + timedelta(seconds=12), 200) == (False, "tpm", 48)
    assert meter.check(START + timedelta(seconds=13), 100)[0]
    assert meter.check(START, 0, consume=False)[0] and meter.requests == 2
    for _ in range(2):
        meter.check(START, 0)
    assert meter.check(START, 0) == (False, "rpd", 180)
    assert meter.check(START + timedelta(minutes=3), 0)[0]  # the next day


def by_hand(rows, q):
    meter, out = Meter(q), {}
    for i, ts, _, tokens in sorted(rows, key=lambda r: (r[1], r[0])):
        out[i] = meter.check(ts, tokens)[:2]
    return out


def test_fold_by_days_and_keys(spark):
    rows, q = requests(), Quota(30, 9000, 120, 10)
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, tokens long")
    assert {r.event_id: (r.allowed, r.reason) for r in quota.fold(table, q).collect()} == by_hand(rows, q)
    q = Quota(10, 4000, 60, 10)
    expected = {k: v for u in range(3) for k, v in by_hand([r for r in rows if r[2] == u], q).items()}
    assert {r.event_id: (r.allowed, r.reason) for r in quota.fold(table, q, "user_id").collect()} == expected


def test_fold_at_its_limits(spark):
    """Waits, accounts without a name, minutes that admit nothing, a day that ends inside a minute, any batch size."""
    schema = "event_id long, ts timestamp, user_id long, tokens long"
    rows = [(i, ts, None if u == 1 else u, tokens) for i, ts, u, tokens in requests(300)] + [(1000 + i, START - timedelta(minutes=9, seconds=-i), None, 10**6) for i in range(3)]
    table = spark.createDataFrame(rows, schema)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    for batch, q in ((old, Quota(10, 4000, 25, 10)), ("7", Quota(10, 4000, 25, 10)), (old, Quota(10, 4000, 0, 10)), (old, Quota(0, 4000, 5, 10))):
        expected = {}
        for user in {r[2] for r in rows}:
            meter = Meter(q)
            expected |= {r[0]: meter.check(r[1], r[3]) for r in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0]))}
        spark.conf.set(size, batch)
        try:
            found = {r.event_id: (r.allowed, r.reason, r.retry_after) for r in quota.fold(table, q, "user_id").collect()}
        finally:
            spark.conf.set(size, old)
        assert found == expected and (q.rpd < 5 or q.rpm == 0 or {v[1] for v in expected.values()} == {None, "rpm", "tpm", "rpd"})
    odd = spark.createDataFrame([(1, None, None, 5), (2, None, 3, 5)], schema)
    assert sorted((r.event_id, r.allowed) for r in quota.fold(odd, Quota(1, 100, 1, 0)).collect()) == [(1, True), (2, False)]
    assert quota.fold(table.limit(0), Quota()).collect() == []


def test_window_forms_agree_with_the_fold(spark):
    rows = requests()
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, tokens long")
    fold = by_hand(rows, Quota(30, 10**9, 10**9, 0))
    assert {r.event_id: r.allowed for r in quota.by_requests(table, 30).collect()} == {k: v[0] for k, v in fold.items()}
    fold = by_hand(rows, Quota(30, 10**9, 50, 0))
    assert {r.event_id: r.allowed for r in quota.by_requests_and_day(table, 30, 50).collect()} == {k: v[0] for k, v in fold.items()}


def test_stream_equals_the_fold(spark, tmp_path):
    rows, q = sorted(requests(), key=lambda r: (r[1], r[0])), Quota(30, 9000, 120, 10)
    schema = "event_id long, ts timestamp, user_id long, tokens long"
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    (tmp_path / "in").mkdir()
    found = {}
    for k in range(4):
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{k}.parquet")
        stream = quota_stream.admit(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), q)
        write = stream.writeStream.foreachBatch(lambda df, _: found.update({r.event_id: (r.allowed, r.reason) for r in df.collect()}))
        write.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert found == by_hand(rows, q)


def test_stream_of_pages(spark, tmp_path):
    schema = "page_id long, url string, html string"
    first = [(i, f"https://e.org/en/guide/{i}", f"<title>P{i}</title><article><p>Text {i}</p></article>") for i in range(4)]
    second = [first[0], (1, first[1][1], "<title>P1</title><article><p>New text</p><table><tr><td>x</table></article>"), (9, "https://e.org/de/x", "<article><h1>Nine</h1><p>n</p></article>"), (2, first[2][1], "<title>P2</title><article></article>")]
    for name, rows in (("in", first), ("more", second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")

    def run():
        ingest.start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/docs", f"{tmp_path}/chunks", f"{tmp_path}/mark").awaitTermination()
        docs = {r.url: r for r in spark.read.parquet(f"{tmp_path}/docs").collect()}
        return docs, sorted((r.url, r.chunk_index, r.content.splitlines()[-1]) for r in spark.read.parquet(f"{tmp_path}/chunks").collect())

    docs, chunks = run()
    assert len(docs) == 4 and [c[2] for c in chunks] == [f"Text {i}" for i in range(4)]
    ids = {u: r.id for u, r in docs.items()}
    for f in (tmp_path / "more").glob("*.parquet"):
        shutil.copy(f, tmp_path / "in" / "later.parquet")
    docs, chunks = run()
    assert len(docs) == 5 and all(docs[u].id == i for u, i in ids.items())
    assert [c[1:] for c in chunks if c[0] == first[1][1]] == [(0, "New text"), (1, "x")] and len(chunks) == 5
    assert not [c for c in chunks if c[0] == first[2][1]]  # its text is gone, and so are its chunks
    assert docs["https://e.org/en/guide/1"].lang == "guide" and docs["https://e.org/de/x"].title == "Nine"


def test_one_page_for_each_address_of_a_batch(spark, tmp_path):
    rows = [(1, "https://e.org/en/a", "<article><p>old</p></article>"), (7, "https://e.org/en/a", "<article><p>new</p></article>"), (7, "https://e.org/en/a", None), (2, None, "<article><p>x</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, ingest.one_per_url(pages).collect()), key=str) == sorted([rows[1], rows[3]], key=str)
    ingest.ingest_batch(pages.where("url IS NOT NULL"), f"{tmp_path}/docs", f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks").collect()
    assert [(c.chunk_index, c.content.splitlines()[-1]) for c in chunks] == [(0, "new")] and spark.read.parquet(f"{tmp_path}/docs").count() == 1
