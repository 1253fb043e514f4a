import hashlib
import random
import re

import duckdb
from helpers import documents, prose, save
from pyspark.sql import functions as F

from millrace.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, window=8):
    wins = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[k]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= 2))
    return sorted(out, key=str)


def tables(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randrange(9, 40))) for i in range(12)] + [(12, "tiny item here"), (13, ""), (14, None), (15, "!!! ..."), (3, "again under three with more than eight words in it"), (16, prose(rng, 8)), (17, "Größe ÜBER naïve 東京 1 2 3 4 5")]
    docs = [(0, None), (1, ""), (2, "?!"), (3, "Tiny ITEM, here! tiny item here"), (4, "größe Über naïve 東京 1 2 3 4 5"), (5, "größe ÜBER naïve 東京 1 2 3 4 5 6")]
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(items[:12])[1].split()
            a = rng.randrange(0, len(w) - 6)
            parts += [" ".join(w[a : a + rng.randrange(5, 20)]).upper() if rng.random() < 0.3 else ", ".join(w[a : a + 15]), prose(rng, 5)]
        docs.append((10 + i, "\n".join(parts)))
    return docs, items


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    docs, items = tables(spark)
    docs += docs[:8]
    save(documents(spark, docs), tmp_path, "documents")
    folder = save(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark")
    got = decontam.op8_decontamination(spark, folder)
    rows = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got.collect()), key=str)
    assert rows == brute(docs, items)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.sql(decontam.ORACLE).fetchall(), key=str) == rows


def test_decontaminate_cuts_runs_and_drops_contaminated(spark):
    docs, items = tables(spark)
    items = spark.createDataFrame(items, "item_id long, text string")
    source = documents(spark, docs).withColumnRenamed("source", "item_id")
    kept = decontam.decontaminate(source, items)
    assert kept.columns == source.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    found = {r.doc_id: r for r in decontam.scan_documents(source, items).collect()}
    for doc_id, text in docs:
        r = found[doc_id]
        goes = r.n_items >= 2 or r.n_hit > decontam.MAX_COVERAGE * r.n_words
        assert (doc_id in rows) != goes
        if not goes and not r.n_hit:
            assert rows[doc_id] == text
        elif not goes:
            assert len(words(rows[doc_id])) == r.n_words - r.n_hit


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan_documents(documents(spark, []), none).count() == 0
    row = decontam.scan_documents(documents(spark, [(1, "a b c d e f g h i j")]), none).first()
    assert (row.n_words, row.n_hit, row.n_items) == (10, 0, 0)


def test_large_benchmarks_go_in_parts(spark, monkeypatch):
    docs, items = tables(spark)
    items = spark.createDataFrame([*items, (77, " ".join(f"long{i}" for i in range(300)))], "item_id long, text string")
    docs = documents(spark, [*docs, (9000, " ".join(f"long{i}" for i in range(5, 290))), (9001, "x " + " ".join(f"long{i}" for i in range(37, 46)))])
    whole = sorted(map(tuple, decontam.scan_documents(docs, items).collect()), key=str)
    cut = sorted((r.doc_id, r.text) for r in decontam.decontaminate(docs, items).collect() if r.text and r.doc_id is not None)
    monkeypatch.setattr(decontam.item_parts, "__defaults__", (decontam.WINDOW, 40))
    assert len(list(decontam.item_parts(items))) > 3
    assert sorted(map(tuple, decontam.scan_documents(docs, items).collect()), key=str) == whole
    assert sorted((r.doc_id, r.text) for r in decontam.decontaminate(docs, items).collect() if r.text and r.doc_id is not None) == cut


def test_columns_of_any_name_and_long_texts(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    long = "word " * 200_000
    docs = documents(spark, [(1, long + "a b c d e f g h " + long), (2, "clean text")]).withColumns({"my col": F.lit("m"), "raw": F.lit(1), "row": F.array(F.lit(2)), "runs": F.lit(3)})
    out = {r.doc_id: r for r in decontam.decontaminate(docs, items).collect()}
    assert len(out[1].text) == len(long) * 2 + 1 and out[2].text == "clean text"
    assert all((r["my col"], r.raw, r["row"], r.runs) == ("m", 1, [2], 3) for r in out.values())
