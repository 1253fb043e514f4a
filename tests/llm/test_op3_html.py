import time
from collections import Counter

import pytest
from helpers import save

from millrace.llm import html_extract
from millrace.llm.html_extract import Page, extract_text

LONG = "A sentence of the article that is long enough to carry weight in the page, number {}."


def page(body: str, tail: str = "</body></html>") -> str:
    return f'<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";track(1);</script></head><body>{body}{tail}'


FRAME = '<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy now</div>{}<aside>Side</aside><div id="cookie-notice">We use cookies</div><form><p>Name</p><input></form><footer>&copy; us</footer>'
CASES = {
    "plain": (page(FRAME.format("<article><h1>Title &amp; more</h1><p>One&nbsp;two\n  three<br>four<p><b>Five<p>Six &eacute;&#33;</article>")), "Title & more\n\nOne two three four\n\nFive\n\nSix é!"),
    "cut off": (page("<nav>Menu</nav><article><h1>T</h1><p>Body text</p></article><footer>Foot", ""), "T\n\nBody text"),
    "reader comments": (page("<main><article><h1>T</h1><p>Body text of it</p></article><section id='comments'><article class='comment'><p>First!</p></article></section></main>"), "T\n\nBody text of it"),
    "article header": (page("<article><header><h1>T</h1><span>by me</span></header><p>Body text</p><div class='share-buttons'>Share</div><ul class='related'><li>x</li></ul></article>"), "T\n\nBody text"),
    "list and table": (page("<article><p>Items:</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e\n f</pre></article>"), "Items:\n\na\n\nb\n\nc\n\nd\n\ne f"),
    "raw text": (page("<article><p>Before<script>if (a<b) { document.write('<p>no</p>') }</script> after<!-- <p>no</p> --></p><noscript>no</noscript></article>"), "Before after"),
    "heading outside": (page("<main><h1>Title</h1><div class='body'>" + "".join(f"<p>{LONG.format(i)}</p>" for i in range(3)) + "</div></main><div class='sidebar'>x</div>"), "Title\n\n" + "\n\n".join(LONG.format(i) for i in range(3))),
    "section in article": (page("<article><h1>T</h1><section>" + f"<p>{LONG.format(1)}</p>" * 2 + "</section></article>"), "\n\n".join(["T", LONG.format(1), LONG.format(1)])),
    "title in a named header": (page("<article><div class='post-header'><h1>T</h1><p>By me</p></div><p>Body</p></article>"), "T\n\nBy me\n\nBody"),
    "discussion": (page("<article><h1>T</h1><section id='discussion'><h2>Discussion</h2><p>We discuss.</p></section></article>"), "T\n\nDiscussion\n\nWe discuss."),
    "related work": (page("<article><h1>T</h1><div class='related-work'><p>Others did <a href='/x'>this</a> before us.</p></div></article>"), "T\n\nOthers did this before us."),
    "social history": (page("<article><h1>T</h1><div class='social-history'><p>The village grew.</p></div></article>"), "T\n\nThe village grew."),
    "a notice in the text": (page("<article><h1>T</h1><p class='notice'>Mind the step.</p></article>"), "T\n\nMind the step."),
    "a heading on comments": (page("<article><h1>T</h1><h2 id='comments'>On comments</h2><p>Text.</p></article>"), "T\n\nOn comments\n\nText."),
    "links in the article": (page("<article><h1>T</h1><p>Body</p><div class='related-posts'><a href='/1'>First thing</a> <a href='/2'>Second thing</a></div><section id='comments'><p>First!</p></section><div class='ad-box'>Buy</div></article>"), "T\n\nBody"),
    "deep": (page("<div>" * 20_000 + "<p>inside</p>"), "inside"),
    "deep and closed": (page("<article>" + "<section><b>" * 5_000 + "<p>inside</p>" + "</b></section>" * 5_000 + "<p>after</p></article>"), "inside\n\nafter"),
    "nothing": (page("<nav>only a menu</nav>"), ""),
    "null": (None, ""),
    "empty": ("", ""),
    "no markup": ("just words", "just words"),
    "broken": ("<article><p>a < b & c <b>d</b> <<p>e</article", None),
}


@pytest.mark.parametrize("name", CASES)
def test_page_alone(name):
    source, expected = CASES[name]
    found = extract_text(source, Page(source or "").main_path())
    assert expected is None or found == expected


def test_query(spark, tmp_path):
    body = "".join(f"<p>{LONG.format(i)}</p>" for i in range(4))
    layout = "<div class='top{0}'>Menu words that stay here</div><div class='page-{0}'><div class='story x{0}'><h1>T{0}</h1>" + body + "</div><div class='extra'>More of this site, always the same long list of other things to read</div></div>"
    rows = [(i, f"https://Host.example.com/{i}", page(layout.format(i))) for i in range(6)]
    # a page of that host where the other container outweighs the story; the host's path still wins
    odd = "<div class='top9'>Menu</div><div class='page-9'><div class='story x9'><h1>T9</h1><p>Short story.</p></div><div class='extra'>" + "<p>Long list of other things to read on this site.</p>" * 20 + "</div></div>"
    rows += [(9, "https://host.example.com/9?x=1", page(odd)), (10, None, "<p>no address</p>"), (11, "https://other.example.com/", None), (11, "https://other.example.com/", ""), (None, "bad", "<b>x</b>")]
    folder = save(spark.createDataFrame(rows, "page_id long, url string, html string"), tmp_path, "pages")
    got = html_extract.op3_html(spark, folder)
    found = sorted(map(tuple, got.select("page_id", "url", "text", "n_chars").collect()), key=str)
    story = "\n\n".join(LONG.format(i) for i in range(4))
    texts = [f"T{i}\n\n{story}" for i in range(6)] + ["T9\n\nShort story.", "no address", "", "", "x"]
    assert found == sorted(((p, u, t, len(t)) for (p, u, _), t in zip(rows, texts, strict=True)), key=str)


def test_votes_equal_counting(spark):
    """Winning paths against a plain count of each page's vote."""
    bodies = ["<div class='a1'>" + f"<p>{LONG.format(1)}</p>" * 3 + "</div><div class='b'>x</div>", "<div class='b2'>" + f"<p>{LONG.format(2)}</p>" * 3 + "</div>", "<article><p>y</p></article>"]
    rows = [(i, f"https://h{i % 4}.example.com/{i}", page(bodies[(i * i + i // 5) % 3])) for i in range(60)]
    votes = Counter((url.split("/")[2], Page(html).main_path()) for _, url, html in rows)
    expected = {host: min((-n, path) for (h, path), n in votes.items() if h == host)[1] for host, _ in votes}
    found = html_extract.winning_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.host: r.path for r in found} == expected


def test_long_pages_are_read_in_linear_time():
    start = time.process_time()
    for source in ("<div>" * 200_000 + "x", "<b>" * 100_000 + "<p>x" * 1000, "<p>word " * 100_000, "<li>a" * 100_000, "</div>" * 100_000 + "<div><p>" * 20_000):
        found = Page(page(source))
        found.text(found.main_path())
    assert time.process_time() - start < 30


def test_clashing_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "https://a.example.com/", "<p>x</p>", "h", 3, "p")], "page_id long, url string, html string, host string, salt int, path string")
    assert html_extract.extract_pages(rows).first().text == "x"
    assert html_extract.extract_pages(rows.where("false")).count() == 0
