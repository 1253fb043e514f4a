from datetime import datetime

import pytest

from millrace.config import Enrichment
from millrace.operators import enrich, store
from millrace.sources import markdown, pages, sitemap

OLD = "id string, url string, title string, content_hash string, updated_at timestamp"


def test_upsert_keeps_ids_and_other_columns(spark):
    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([("1", "a", "A", "h", t), ("2", "b", "B", "h", t)], OLD)
    new = spark.createDataFrame([("9", "b", None, "h2", None), ("8", "c", "C", "h3", None), ("7", "c", "C", "h3", None)], OLD)
    rows = sorted(map(tuple, store.upsert_marked(old, new, ["url"], ["title", "content_hash"]).select("url", "id", "title", "content_hash", "updated_at").collect()))
    assert [r[:4] for r in rows[:2]] == [("a", "1", "A", "h"), ("b", "2", None, "h2")] and rows[1][4] == t
    assert rows[2][0] == "c" and rows[2][1] in ("7", "8") and len(rows) == 3


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("n", None)], "url string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "url string, content_hash string")
    assert {r.url: r.change for r in store.changes(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert {r.url: r.change for r in store.changes(old, new, force=True).collect()} == {"a": "changed", "b": "changed", "c": "new"}


def test_cascade_and_children(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(1, "x"), (2, "y")], "parent int, v string")
    left, below = store.delete_cascade(parents, children, parents.where("id = 1"), "id", "parent")
    assert left.collect() == [(2,)] and below.collect() == [(2, "y")]
    assert sorted(map(tuple, store.replace_children(children, spark.createDataFrame([(1, "n"), (1, "m")], "parent int, v string"), "parent").collect())) == [(1, "m"), (1, "n"), (2, "y")]


def test_commit_swaps_tables(spark, tmp_path):
    path = f"{tmp_path}/t"
    store.commit(spark.range(3), path)
    store.commit(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    assert not store.exists(spark, "no_such_table")


def test_batches(spark):
    rows = store.batches(spark.range(5).selectExpr("id", "id % 2 AS k"), 2, "id", ["k"]).orderBy("id").collect()
    assert [r.batch for r in rows] == [0, 0, 0, 0, 1]


def test_enrichment(spark):
    schema = "content_kind string, content string"
    rows = spark.createDataFrame([("prose", "word " * 100), ("prose", "short"), ("table", "a | b"), ("quote", "x" * 400), ("code", "y" * 400)], schema)
    got = {(r.content_kind, r.content[:1]): (r.status, r.reason) for r in enrich.enrich(rows).collect()}
    assert got == {("prose", "w"): ("success", None), ("prose", "s"): ("skipped_by_policy", "below_min_chars"), ("table", "a"): ("success", None), ("quote", "x"): ("skipped_by_policy", "content_kind_not_enabled"), ("code", "y"): ("success", None)}
    bad = enrich.enrich(rows, Enrichment(retries=0), lambda kind, content: "{}" if kind == "code" else 1 / 0)
    assert {(r.content_kind, r.reason) for r in bad.where("status = 'failed'").collect()} == {("prose", "model_failed"), ("table", "model_failed"), ("code", "invalid_enrichment_output")}


def test_sitemap(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    files = [
        ("root", f'<?xml version="1.0"?><sitemapindex {ns}><sitemap><loc> one </loc></sitemap><sitemap><loc>two</loc></sitemap></sitemapindex>'),
        ("one", f"<urlset {ns}><url><loc>https://e.org/a</loc></url><url><loc>https://e.org/b</loc></url></urlset>"),
        ("two", "<urlset><url><loc>https://e.org/a</loc></url><url><loc>not an address</loc></url></urlset>"),
        ("loop", "<sitemapindex><sitemap><loc>loop</loc></sitemap></sitemapindex>"),
    ]
    table = spark.createDataFrame(files, "path string, content string")
    assert [r.url for r in sitemap.scan(table, "root").orderBy("order").collect()] == ["https://e.org/a", "https://e.org/b", "https://e.org/a", "not an address"]
    assert sitemap.scan(table, "loop").count() == 0
    found = spark.createDataFrame([(1, "https://e.org/Docs/x/api-y/z"), (2, "https://e.org/docs/x"), (3, "https://e.org/other"), (4, "docs"), (5, "https://e.org/docs/api-x")], "page_id int, url string")
    assert [(r.page_id, r["rank"]) for r in pages.crawl_order(found, "DOCS", 9).collect()] == [(2, 10), (5, 11), (1, 30)]
    assert [r.json for r in pages.to_json(found.limit(1), ["page_id"]).collect()] == ['{"url":"https://e.org/Docs/x/api-y/z","debug":{"page_id":1}}']


def test_markdown_table(spark, tmp_path):
    (tmp_path / "m.md").write_text("# T\n| a | b |\n\n| id | query |\n| --- | --- |\n| 1 | how  to |\n| 2 | x |\n\n| 3 | y |\n")
    assert [(r.id, r["query"]) for r in markdown.table(spark, f"{tmp_path}/m.md", ["id", "query"]).orderBy("n").collect()] == [("1", "how  to"), ("2", "x")]
    (tmp_path / "bad.md").write_text("| id | query |\n| --- | --- |\n| 1 | a | b |\n")
    with pytest.raises(Exception, match="wrong number of cells"):
        markdown.table(spark, f"{tmp_path}/bad.md", ["id", "query"]).collect()
    with pytest.raises(ValueError, match="no table"):
        markdown.table(spark, f"{tmp_path}/m.md", ["x"])
