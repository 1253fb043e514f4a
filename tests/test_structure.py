import gc

import pandas as pd
import pyarrow as pa

from millrace.operators import structure
from millrace.operators.structure import chunk_elements, parse_page, split_rows, windows


def kinds(source):
    return [(e["type"], e["text"]) for e in parse_page(source)[2]]


def test_elements_and_boilerplate():
    source = '<title>Guide</title><nav><p>menu</p></nav><div class="footer-container"><p>no</p></div><article><h1 id="top">Start</h1><p>One <b>two</b></p><ul><li>a</li><li> b </li></ul><ol><li>c</ol><pre><code class="language-ts">let a\n\n  = 1</code></pre><blockquote>said</blockquote><span>loose</span></article><footer><p>no</p></footer>'
    title, _, found = parse_page(source)
    assert title == "Guide"
    assert [(e["type"], e["text"]) for e in found] == [("heading", "Start"), ("paragraph", "One two"), ("list", "1. a\n2. b"), ("list", "1. c"), ("code", "let a\n= 1"), ("blockquote", "said")]
    assert found[4]["code_language"] == "ts" and found[3]["list_kind"] == "ordered"
    assert all(e["heading_path"] == ["Guide", "Start"] and e["anchor"] == "top" for e in found)


def test_heading_jumps_and_anchors():
    found = parse_page('<body><h1 id="a">A</h1><h3>C</h3><p>x</p><h2 id="b">B</h2><p>y</p></body>')[2]
    assert found[2]["heading_path"] == ["A", "A", "", "C"] and found[2]["anchor"] is None
    assert found[4]["heading_path"] == ["A", "A", "B"] and found[4]["anchor"] == "b"


def test_tables():
    found = parse_page("<main><table><tr><th>k<th>v</tr><tr><td>a</td><td></td><td>1</td></tr></table></main>")[2]
    assert found[0]["text"] == "k | v\na | 1" and found[0]["html"].startswith("<table>")
    rows = [["head", "x"], *([str(i), "y" * 50] for i in range(100))]
    groups = split_rows(rows, 500)
    assert all(g[0] == rows[0] and len(structure.table_text(g)) <= 500 for g in groups)
    assert [r for g in groups for r in g[1:]] == rows[1:]


def test_unclosed_markup():
    assert kinds("<p><b>one<br><p>two") == []  # no body and no container
    assert kinds("<body><p><b>one<p>two<ul><li>x<li>y</ul>") == [("paragraph", "one"), ("paragraph", "two"), ("list", "1. x\n2. y")]


def chunks_of(source):
    title, _, found = parse_page(source)
    return chunk_elements(title, found)


def test_merging_and_kinds():
    out = chunks_of("<title>T</title><article><h1>H</h1><p>a</p><p>b</p><h2>I</h2><p>c</p><ul><li>d</ul><table><tr><td>e</table><p>f</p></article>")
    assert [c["content_kind"] for c in out] == ["prose", "mixed", "table", "prose"]
    assert out[0]["content"] == "Document: T\nPath: T > H\n\na\n\nb" and out[2]["content"] == "Document: T\nPath: T > H > I\nType: Table\n\ne"
    assert [c["chunk_index"] for c in out] == [0, 1, 2, 3] and out[1]["element_types"] == ["paragraph", "list"]


def test_budgets():
    sentence = "A sentence of some length stands here. "
    long = chunks_of(f"<article><p>{sentence * 100}</p></article>")
    assert len(long) == 100 and {c["part_total"] for c in long} == {100} and long[0]["original_type"] == "paragraph"
    pair = chunks_of(f"<article><p>{'x' * 1200}</p><p>{'y' * 1200}</p><p>{'z' * 900}</p></article>")
    assert [len(c["element_types"]) for c in pair] == [1, 1] and pair[1]["content"].endswith("z")
    whole = chunks_of(f"<article><p>{'x' * 3000}</p></article>")
    assert len(whole) == 1 and whole[0]["part_index"] is None
    code = chunks_of("<article><pre>" + "\n".join("line" + "x" * 60 for _ in range(80)) + "</pre></article>")
    assert len(code) == 80


def test_windows():
    text = "\n".join(f"line {i} of the text." for i in range(400))
    out = windows(text, 350, 50)
    assert all(len(w) <= 350 for w in out) and out[0].endswith(".") and out[-1].endswith("line 399 of the text.")
    assert windows("", 10, 2) == [] and windows("abc", 10, 2) == ["abc"] and windows("a" * 25, 10, 2) == ["a" * 10, "a" * 10, "a" * 9]


def test_sections():
    text = "Intro words. " * 6 + "\nSetup\n" + "Do this. " * 10 + "\nUsage\nshort"
    assert [s["heading"] for s in structure.sections("T", ["Setup", "Usage", "Gone"], text)] == ["T", "Setup", "Usage"]


def test_tables_of_pages(spark):
    rows = [(1, "u1", "<article><h1>A</h1><p>b</p></article>"), (2, "u2", None), (3, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert structure.elements(pages).count() == 2
    assert [(r.page_id, r.n_elements) for r in structure.documents(pages).orderBy("page_id").collect()] == [(1, 2), (2, 0), (3, 0)]
    assert structure.chunks(pages).select("content", "chunk_version").collect() == [("Document: A\nPath: A > A\n\nb", "structure-v1")]
    assert structure.chunks(pages.where("false")).count() == 0
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": [1, 2], "text": ["abc", None]}), "doc_id long, text string")
    assert structure.window_chunks(docs).collect() == [(1, 0, "abc")]


def test_same_content_same_hash():
    a, b = (parse_page(f"<title>{t}</title><article><p>x</p></article>")[1] for t in "ab")
    assert a == b != parse_page("<article><p>y</p></article>")[1]


def test_deep_nesting_and_long_tables():
    title, _, found = parse_page("<title>D</title><body>" + "<div>" * 20_000 + "<p>inside</p>")
    assert title == "D" and [(e["type"], e["text"]) for e in found] == [("paragraph", "inside")]
    rows = [["head", "x"], *([str(i), "y" * 20] for i in range(20_000))]
    groups = split_rows(rows, 500)
    assert all(g[0] == rows[0] for g in groups) and [r for g in groups for r in g[1:]] == rows[1:]
    assert all(len(structure.table_text(g)) <= 500 for g in groups)


def test_trees_are_freed_without_the_collector():
    gc.collect()
    gc.disable()
    try:
        parse_page("<title>T</title><nav><ul><li>a<li>b</ul></nav><article><h1>H</h1>" + "<p>x <b>y</b></p>" * 50 + "</article>")
        assert gc.collect() < 20
    finally:
        gc.enable()


def test_workers_get_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]}, schema=pa.schema([("n", pa.int64())]))

    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text").coalesce(1)
    found = [r.n for r in structure.window_chunks(docs).mapInArrow(sizes, "n long").collect()]
    assert len(found) > 4 and max(found) < 6 << 20
