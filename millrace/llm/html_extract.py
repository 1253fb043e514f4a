"""Main text of web pages by consensus of each host's pages.

Pass one parses every page once, walks down from the root along the container that holds most of the remaining text,
and votes for that container's generalised path (tag and letters of its classes, from the root). Votes are counted
for each host and path in Spark; the path with most votes wins its host. Pass two takes from each page the elements
at its host's winning path, or at the page's own path where it lacks that one.

Menus, headers, footers, sidebars, notices, adverts, forms, reader comments and the like are left out by element and
role, and outside the article by the words of class and id. Inside an article or main element a name alone proves
little (a section on related work is content): only a container whose name has nothing but such words goes, or one
that has such a word and is mostly links; paragraphs, headings and whatever holds the page's h1 stay whatever their
names. A header inside the article keeps its headings. Blocks are joined by a blank line, white space inside a block
(line breaks included) is one blank.

Containers' paths are numbers in a tree of labels, so memory and time are linear in the page, also for deep nesting.

Defined results: null or empty html gives the empty text; a null url counts as a host of its own; markup that is cut
off or unbalanced is read as far as it goes; repeated pages are each extracted; pages of any length are read whole; ties
between paths go to the greater path on a page and to the first in order for a host; an empty table gives no rows; other
columns than page_id, url and html are not read, so their names cannot clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, small_batches, table, written

SALTS = 16
#: A container is left for one inside it that holds at least this share of its text.
DESCEND = 0.8

TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = {"script", "style", "textarea", "xmp", "noembed", "noframes", "iframe", "title"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = set("html body article main section div center td table tbody tr details figure blockquote".split())
DROPPED = set("head nav footer aside form script style noscript template iframe svg button select textarea input object dialog menu canvas audio video map".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SAFE = HEADINGS | {"html", "body", "article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "dialog", "alertdialog", "alert", "search", "menu", "menubar", "form", "toolbar"}
WORDS = set(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside widget widgets ad ads adv advert adverts advertisement advertising adsense banner promo promotion promotions"
    " sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form comment comments commentlist disqus replies respond share sharing social related recommended recommendations pagination pager skip toolbar".split()
)
#: Words of names that say nothing by themselves.
NEUTRAL = set("box block list section container wrapper area items item bar buttons button links link widget widgets top bottom left right main page site inner outer group row col".split())
#: Elements that are containers by class and id; names on others are no reason to drop them inside an article.
NAMED = set("div section ul ol dl table article aside span figure details".split())
COMMENTS = {"comment", "comments", "commentlist", "disqus"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NO_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dt", "dd", "option", "optgroup", "legend", "summary", "figcaption"} | {"p"}


class Page:
    """Blocks of a page: (container's number, text, signs inside links), the containers' path numbers and parents, and the blocks that are titles.

    A path number stands for (number of the path above, label); 0 is the root.
    """

    def __init__(self, source: str):
        self.known: dict[tuple[int, str], int] = {}
        self.above: list[tuple[int, str]] = [(-1, "")]
        self.paths: list[int] = [0]
        self.parents: list[int] = [-1]
        self.blocks: list[tuple[int, str, int]] = []
        self.titles: list[int] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, int, int, int]] = []  # tag, container, dropped, header, first block if the element is in doubt
        opened: dict[str, int] = {}
        buffer: list[str] = []
        linked = links = container = dropped = header = heading = 0
        at, end = 0, len(source)
        blocks, paths, parents = self.blocks, self.paths, self.parents

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join(entities.unescape("".join(buffer)).split())
                if text:
                    if opened.get("h1"):
                        self.titles.append(len(blocks))
                    blocks.append((container, text, linked))
                buffer.clear()
            linked = 0

        def pop() -> None:
            nonlocal container, dropped, header, links, heading
            if stack[-1][4] >= 0:
                flush()
                self._settle(stack[-1][4])
            tag, container, dropped, header, _ = stack.pop()
            opened[tag] -= 1
            links -= tag == "a"
            heading -= tag in HEADINGS

        while at < end:
            m = TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at and not dropped and (not header or heading):
                piece = source[at:stop]
                buffer.append(piece)
                if links:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            closing, tag, rest = m.group(1), m.group(2), m.group(3)
            if tag is None:
                closing, tag, rest = m.group(4), m.group(5), m.group(6)
                if tag is None:
                    continue
            tag = tag.lower()
            if closing:
                if tag in BLOCK:
                    flush()
                if opened.get(tag):
                    while True:
                        top = stack[-1][0]
                        pop()
                        if top == tag:
                            break
                continue
            if tag == "br" or tag == "hr":
                buffer.append(" ")
                if tag == "hr":
                    flush()
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                done = RAW_END[tag].search(source, at)
                at = done.end() if done else end
                continue
            if tag in BLOCK:
                flush()
                if tag == "body":
                    while stack and stack[-1][0] != "html":
                        pop()
                elif tag in NO_P and opened.get("p") or any(opened.get(x) for x in CLOSES.get(tag, ())):
                    for k in range(len(stack) - 1, -1, -1):
                        name = stack[k][0]
                        if name == "p" and tag in NO_P:
                            while len(stack) > k:
                                pop()
                            break
                        if name in CLOSES.get(tag, ()):
                            while len(stack) > k:
                                pop()
                            if tag != "tr":
                                break
                        elif name in LIMITS.get(tag, ()) or name in CONTAINER and name not in ("tr", "tbody"):
                            break
            if rest.rstrip().endswith("/") and tag not in BLOCK and tag != "a":
                continue
            inside = bool(opened.get("article") or opened.get("main"))
            label, doubt = self._label(tag, rest, inside)
            if doubt:
                flush()
            stack.append((tag, container, dropped, header, len(blocks) if doubt else -1))
            opened[tag] = opened.get(tag, 0) + 1
            links += tag == "a"
            heading += tag in HEADINGS
            if label is None:
                if tag == "header" and inside:
                    header += 1
                else:
                    dropped += 1
            elif tag in CONTAINER and not dropped:
                step = (paths[container], label)
                if step not in self.known:
                    self.known[step] = len(self.above)
                    self.above.append(step)
                parents.append(container)
                paths.append(self.known[step])
                container = len(paths) - 1
        flush()
        while stack:
            pop()

    def _settle(self, first: int) -> None:
        """Drops the blocks from ``first`` on, an element in doubt, if they are mostly links and have no title."""
        if first < len(self.blocks) and not (self.titles and self.titles[-1] >= first):
            own = self.blocks[first:]
            if sum(x[2] for x in own) >= 0.5 * sum(len(x[1]) for x in own):
                del self.blocks[first:]

    @staticmethod
    def _label(tag: str, rest: str, inside: bool) -> tuple[str | None, bool]:
        """The element's part of a path, None for an element that never holds main text; and whether its name leaves it in doubt."""
        if tag in DROPPED or tag == "header":
            return None, False
        if not rest or "=" not in rest and "hidden" not in rest:
            return tag, False
        label, doubt = tag, False
        for name, a, b, c in ATTRIBUTE.findall(rest):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                value = entities.unescape(value)
                words = [w.lower() for w in LETTERS.findall(value)]
                bad = COMMENTS if tag in SAFE else WORDS
                if not bad.isdisjoint(words) and tag not in ("html", "body"):
                    if not inside:
                        return None, False
                    if tag in NAMED:
                        for token in value.split():
                            own = {w.lower() for w in LETTERS.findall(token)}
                            if own and not own.isdisjoint(bad):
                                if own <= bad | NEUTRAL:
                                    return None, False
                                doubt = True
                if name == "class" and words:
                    label += "." + "-".join(words)
            elif name == "role" and value.lower() in ROLES and tag not in SAFE:
                return None, False
            elif (name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value)) and tag not in SAFE:
                return None, False
        return label, doubt

    def main_path(self) -> str:
        """The path that this page votes for: from the root down, as long as one path below holds most of the text and the title.

        An article is not left for a part of it.
        """
        weight = [0] * len(self.paths)
        for container, text, linked in self.blocks:
            weight[container] += max(0, len(text) - 2 * linked)
        for k in range(len(weight) - 1, 0, -1):
            weight[self.parents[k]] += weight[k]
        by_path = [0] * len(self.above)
        below: dict[int, list[int]] = {}
        for k in range(1, len(weight)):
            by_path[self.paths[k]] += weight[k]
        for k in range(1, len(self.above)):
            below.setdefault(self.above[k][0], []).append(k)
        here, total, labels = 0, weight[0], [""]
        titles = [self._chain(container) for container in {self.blocks[i][0] for i in self.titles}]
        while (under := below.get(here)) and total and not (labels[-1] + ".").startswith("article."):
            best = max(under, key=lambda p: (by_path[p], self.above[p][1]))
            if by_path[best] < DESCEND * total or any(here in t and best not in t for t in titles):
                break
            here, total = best, by_path[best]
            labels.append(self.above[best][1])
        return "/".join(labels)

    def _chain(self, container: int) -> set[int]:
        """The paths that a container lies in."""
        out = set()
        while container >= 0:
            out.add(self.paths[container])
            container = self.parents[container]
        return out

    def text(self, path: str | None) -> str:
        """The blocks inside the elements at the path, in page order."""
        wanted = 0
        for label in (path or "").split("/")[1:]:
            wanted = self.known.get((wanted, label), -1)
            if wanted < 0:
                return ""
        inside = [False] * len(self.paths)
        for k in range(len(self.paths)):
            inside[k] = self.paths[k] == wanted or k > 0 and inside[self.parents[k]]
        return "\n\n".join(text for container, text, _ in self.blocks if inside[container])


def extract_text(source: str | None, path: str | None) -> str:
    """A page's main text by its host's path, or by its own where it has nothing there."""
    if not source:
        return ""
    page = Page(source)
    return (page.text(path) if path is not None else "") or page.text(page.main_path())


def host_of(url: str | F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path with most votes of each host, ties to the first in order. Counted by partial sums."""

    def load():
        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            for host, source in rows:
                if source:
                    page = Page(source)
                    if page.blocks:
                        yield host, page.main_path()

        return step

    votes = map_rows(pages.select(host_of("url").alias("host"), "html"), "host string, path string", load).groupBy("host", "path").count()
    best = Window.partitionBy("host").orderBy(F.desc("count"), "path")
    return votes.withColumn("place", F.row_number().over(best)).where("place = 1").select("host", "path")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    winners = written(winning_paths(pages), "host-paths")
    salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = pages.select("page_id", "url", "html").withColumns({"host": host_of("url"), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})

    def load():
        def step(source: Iterable[tuple]) -> Iterator[tuple]:
            for page_id, url, markup, path in source:
                text = extract_text(markup, path)
                yield page_id, url, text, len(text)

        return step

    return map_rows(rows.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "path"), "page_id long, url string, text string, n_chars long", load)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
