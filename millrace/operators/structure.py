"""Structured pages: typed elements with heading context, and heading-aware chunks of them.

A small tree builder (standard library only) follows the usual recovery rules: void elements, paragraphs closed by
block starts, list items and table parts that close each other, raw script and style text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
SELF_CLOSE = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
BOILERPLATE_TAGS = frozenset("header footer nav script style".split())
BOILERPLATE_CLASSES = frozenset(("nav-container", "footer-container"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
WALKED = frozenset("article main section div body aside details summary".split())
TARGET, LIMIT = 2200, 3200
CHUNK_VERSION = "structure-v1"

ELEMENT_SCHEMA = "order int, type string, text string, anchor string, heading_path array<string>, primary_heading string, dom_path string, level int, list_kind string, items array<string>, code_language string, html string"
CHUNK_SCHEMA = (
    "chunk_index int, content string, anchor string, content_kind string, heading_path array<string>, primary_heading string, element_types array<string>, word_count int, token_estimate int,"
    " dom_paths array<string>, table_html string, code_language string, part_index int, part_total int, original_type string"
)


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        out, left = [], [self]
        while left:
            node = left.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                left.extend(reversed(node.children))
        return "".join(out)

    def nodes(self) -> Iterator[Node]:
        """The nodes below, in page order."""
        left = [c for c in reversed(self.children) if not isinstance(c, str)]
        while left:
            node = left.pop()
            yield node
            left.extend(c for c in reversed(node.children) if not isinstance(c, str))

    def markup(self) -> str:
        out: list[str] = []
        left: list[tuple[bool, Node | str]] = [(False, self)]
        while left:
            done, node = left.pop()
            if isinstance(node, str):
                out.append(node if done else node.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
                continue
            out.append(f"<{node.tag}{''.join(f' {k}=\"{v}\"' for k, v in node.attrs.items())}>")
            if node.tag not in VOID:
                left.append((True, f"</{node.tag}>"))
                left.extend((False, c) for c in reversed(node.children))
        return "".join(out)


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and (found := next((n for n in self.root.nodes() if n.tag == tag), None)):
            found.attrs.update({k: v or "" for k, v in attrs if k not in found.attrs})
            return
        if tag in CLOSE_P:
            self._close({"p"}, {"table", "td", "th", "body", "button"})
        if tag in SELF_CLOSE:
            names, limits = SELF_CLOSE[tag]
            while self._close(names, limits) and tag == "tr":
                pass
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def _close(self, names: set[str], limits: set[str]) -> bool:
        node = self.at
        while node is not None and node.tag not in limits:
            if node.tag in names:
                self.at = node.parent
                return True
            node = node.parent
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag not in WALKED:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def squash(text: str) -> str:
    return " ".join(text.split())


def lines(text: str) -> str:
    return "\n".join(x for x in map(str.strip, text.split("\n")) if x)


def build(source: str) -> Node:
    builder = Builder()
    builder.feed(source)
    builder.close()
    return builder.root


def _classes(node: Node) -> list[str]:
    return node.attrs.get("class", "").split()


def _detach(root: Node) -> None:
    """Cuts the links to parents, so that a tree is freed as soon as it is done with and not when cycles are next collected."""
    for node in root.nodes():
        node.parent = None
    root.parent = None


def _prune(root: Node) -> None:
    left = [root]
    while left:
        node = left.pop()
        before = node.children
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in BOILERPLATE_TAGS and BOILERPLATE_CLASSES.isdisjoint(_classes(c))]
        if len(node.children) < len(before):
            kept = set(map(id, node.children))
            for c in before:
                if not isinstance(c, str) and id(c) not in kept:
                    _detach(c)
        left.extend(c for c in node.children if not isinstance(c, str))


def _main(root: Node) -> Node | None:
    tests = (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: "content" in _classes(n), lambda n: n.attrs.get("id") == "main-content", lambda n: n.tag == "body")
    for test in tests:
        for node in root.nodes():
            if test(node) and node.text().strip():
                return node
    return next((n for n in root.nodes() if n.tag == "body"), None)


def _dom_path(node: Node) -> str:
    parts = []
    while node is not None and node.parent is not None:
        twins = [c for c in node.parent.children if not isinstance(c, str) and c.tag == node.tag]
        parts.append(f"{node.tag}{'#' + node.attrs['id'] if node.attrs.get('id') else ''}:nth-of-type({next(i for i, c in enumerate(twins, 1) if c is node)})")
        node = node.parent
    return " > ".join(reversed(parts))


def _code_language(node: Node) -> str | None:
    inner = next((n for n in node.nodes() if n.tag == "code"), None)
    found = re.search(r"lang(?:uage)?-([a-z0-9_+\-]+)", " ".join(filter(None, (node.attrs.get("class"), inner.attrs.get("class") if inner else None))), re.I)
    return found.group(1).lower() if found else None


class Walk:
    """Elements in source order; heading levels that were jumped over stay empty in the path."""

    def __init__(self, title: str):
        self.title, self.stack, self.anchor, self.out = title, [], None, []

    def add(self, node: Node, kind: str, text: str, anchor: str | None, **more) -> None:
        head = next((h for h in reversed(self.stack) if h), None) if self.stack and self.stack[-1] is None else (self.stack[-1] if self.stack else None)
        row = {"order": len(self.out), "type": kind, "text": text, "anchor": anchor, "heading_path": [self.title, *(h or "" for h in self.stack)], "primary_heading": head or self.title, "dom_path": _dom_path(node)}
        self.out.append(row | {"level": None, "list_kind": None, "items": None, "code_language": None, "html": None, "rows": None} | more)

    def visit(self, root: Node) -> None:
        left = [root]
        while left:
            node = left.pop()
            if node.tag in WALKED:
                left.extend(c for c in reversed(node.children) if not isinstance(c, str))
            else:
                self.element(node)

    def element(self, node: Node) -> None:
        tag = node.tag
        own = node.attrs.get("id") or self.anchor
        if tag in HEADINGS:
            if text := squash(node.text()):
                level = int(tag[1])
                self.stack = (self.stack[: level - 1] + [None] * level)[: level - 1] + [text]
                self.anchor = node.attrs.get("id") or None
                self.add(node, "heading", text, self.anchor, level=level)
        elif tag == "p":
            if text := squash(node.text()):
                self.add(node, "paragraph", text, own)
        elif tag in ("ul", "ol"):
            items = [t for c in node.children if not isinstance(c, str) and c.tag == "li" and (t := squash(c.text()))]
            if items:
                self.add(node, "list", numbered(items), own, list_kind="ordered" if tag == "ol" else "unordered", items=items)
        elif tag == "pre" or tag == "code" and not (node.parent and node.parent.tag == "pre") and ("\n" in node.text() or _code_language(node)):
            if text := lines(node.text()):
                self.add(node, "code", text, own, code_language=_code_language(node))
        elif tag == "table":
            rows = [r for n in node.nodes() if n.tag == "tr" and (r := [t for c in n.nodes() if c.tag in ("th", "td") and (t := squash(c.text()))])]
            if rows:
                self.add(node, "table", table_text(rows), own, html=node.markup(), rows=rows)
        elif tag == "blockquote":
            if text := squash(node.text()):
                self.add(node, "blockquote", text, own)


def numbered(items: list[str]) -> str:
    return "\n".join(f"{i}. {x}" for i, x in enumerate(items, 1))


def table_text(rows: list[list[str]]) -> str:
    return "\n".join(" | ".join(r) for r in rows)


def parse_page(source: str | None) -> tuple[str, str, list[dict]]:
    """Title, content hash and elements of a page."""
    root = build(source or "")
    _prune(root)
    main = _main(root)

    def first(tag: str, under: Node | None) -> str:
        return squash(next((n.text() for n in under.nodes() if n.tag == tag), "")) if under else ""

    title = first("title", root) or first("h1", main) or first("h1", root) or "Untitled Document"
    walk = Walk(title)
    if main:
        walk.visit(main)
    _detach(root)
    payload = "\n\n".join(f"{e['type']}:{e['text']}" + (f"\n{e['html']}" if e["type"] == "table" else "") for e in walk.out)
    return title, hashlib.md5(payload.encode()).hexdigest(), walk.out


def split_text(text: str, boundaries: tuple[str, ...], limit: int = LIMIT) -> list[str]:
    body = text.strip()
    if len(body) <= limit:
        return [body] if body else []
    for boundary in boundaries:
        parts = [p for p in map(str.strip, re.split(boundary, body)) if p]
        if len(parts) > 1 and max(map(len, parts)) <= limit:
            return parts
    return [p for i in range(0, len(body), limit) if (p := body[i : i + limit].strip())]


def split_rows(rows: list[list[str]], limit: int = LIMIT) -> list[list[list[str]]]:
    """Row groups that fit, each with the first row as its header."""
    sizes = [len(" | ".join(r)) for r in rows]
    if sum(sizes) + len(rows) - 1 <= limit:
        return [rows]
    head, groups, own, size = rows[0], [], [rows[0]], sizes[0]
    for row, n in zip(rows[1:], sizes[1:], strict=True):
        if len(own) > 1 and size + 1 + n > limit:
            groups.append(own)
            own, size = [head], sizes[0]
        own.append(row)
        size += 1 + n
    return [*groups, own]


def chunk_elements(title: str, elements: list[dict]) -> list[dict]:
    out: list[dict] = []
    held: list[dict] = []

    def emit(path: list[str], body: str, kind: str, parts: list[dict], **more) -> None:
        label = {"table": "\nType: Table", "code": "\nType: Code"}.get(kind, "")
        content = f"Document: {title}\nPath: {' > '.join(path)}{label}\n\n{body}".strip()
        row = {"chunk_index": len(out), "content": content, "anchor": next((e["anchor"] for e in parts if e["anchor"]), None), "content_kind": kind, "heading_path": path, "primary_heading": path[-1] or title}
        row |= {"element_types": list(dict.fromkeys(e["type"] for e in parts)), "word_count": len(body.split()), "token_estimate": -(-len(content) // 4), "dom_paths": list(dict.fromkeys(e["dom_path"] for e in parts))}
        out.append(row | {"table_html": None, "code_language": None, "part_index": None, "part_total": None, "original_type": None} | more)

    def flush() -> None:
        if held:
            kinds = {e["type"] for e in held}
            kind = {"paragraph": "prose", "list": "list", "blockquote": "blockquote"}[kinds.pop()] if len(kinds) == 1 else "mixed"
            emit(held[0]["heading_path"], "\n\n".join(e["text"] for e in held), kind, list(held))
            held.clear()

    for e in elements:
        kind, path = e["type"], e["heading_path"]
        if kind == "heading":
            flush()
        elif kind in ("table", "code") or kind == "paragraph" and len(e["text"]) > LIMIT:
            flush()
            if kind == "table":
                bodies, more = [table_text(g) for g in split_rows(e["rows"])], {"table_html": e["html"]}
            elif kind == "code":
                bodies, more = split_text(e["text"], (r"\n{2,}", r"\n")), {"code_language": e["code_language"]}
            else:
                bodies, more = split_text(e["text"], (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+")), {}
            for i, body in enumerate(bodies, 1):
                part = {"part_index": i, "part_total": len(bodies), "original_type": kind} if len(bodies) > 1 else {}
                emit(path, body, "prose" if kind == "paragraph" else kind, [e], **more, **part)
        else:
            if held and (held[0]["heading_path"] != path or len("\n\n".join(x["text"] for x in [*held, e])) > TARGET):
                flush()
            held.append(e)
    flush()
    return out


def _per_page(pages: DataFrame, schema: str, rows_of) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", schema)]

    def rows(page_id: int, url: str, source: str) -> Iterator[tuple]:
        title, digest, elements = parse_page(source)
        for row in rows_of(title, elements):
            yield (page_id, url, title, digest, *(row[name] for name in names))

    return map_texts(pages.select(F.col("page_id").cast("long"), "url", "html"), f"page_id long, url string, title string, content_hash string, {schema}", rows)


def elements(pages: DataFrame) -> DataFrame:
    """One row for each structural element of each page."""
    return _per_page(pages, ELEMENT_SCHEMA, lambda title, found: [{k: v for k, v in e.items() if k != "rows"} for e in found])


def chunks(pages: DataFrame) -> DataFrame:
    """One row for each heading-aware chunk of each page."""
    return _per_page(pages, CHUNK_SCHEMA, chunk_elements).withColumn("chunk_version", F.lit(CHUNK_VERSION))


def documents(pages: DataFrame) -> DataFrame:
    """page_id, url, title, content_hash and n_elements of every page."""
    return _per_page(pages, "n_elements int", lambda title, found: [{"n_elements": len(found)}])


def plain_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, headings, content and content_hash of every page: the main part's text without its structure."""

    def rows(page_id: int, url: str, source: str) -> Iterator[tuple]:
        root = build(source or "")
        _prune(root)
        main = _main(root)
        text = squash(main.text()) if main else ""
        headings = [t for n in main.nodes() if n.tag in HEADINGS and (t := squash(n.text()))] if main else []
        title = next((t for n in root.nodes() if n.tag == "title" and (t := squash(n.text()))), "Untitled Document")
        _detach(root)
        yield page_id, url, title, headings, text, hashlib.md5(text.encode()).hexdigest()

    return map_texts(pages.select(F.col("page_id").cast("long"), "url", "html"), "page_id long, url string, title string, headings array<string>, content string, content_hash string", rows)


def sections(title: str, headings: list[str], text: str, size: int = 3500, overlap: int = 500, least: int = 50) -> list[dict]:
    """The plain-text form: sections from one heading's first place to the next one's, in overlapping windows."""
    marks = sorted((at, h) for h in headings if (at := text.find(h)) >= 0)
    bounds = [(0, title), *marks] if not marks or marks[0][0] > 0 else marks
    out = []
    for i, (at, head) in enumerate(bounds):
        end = bounds[i + 1][0] if i + 1 < len(bounds) else len(text)
        body = text[at:end].strip()
        if len(body) >= least or i + 1 == len(bounds) and body:
            out += [{"heading": head, "content": w} for w in windows(body, size, overlap)]
    return out


def windows(text: str, size: int = 3500, overlap: int = 500) -> list[str]:
    """Windows of ``size`` signs that end at the last line or sentence end past their middle; each starts ``overlap`` before the last one's end."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            at_line, at_stop = text.rfind("\n", start, end + 1), text.rfind(". ", start, end + 2)
            if at_line > start + size / 2:
                end = at_line
            elif at_stop > start + size / 2:
                end = at_stop + 1
        out.append(text[start:end].strip())
        if end >= len(text) or overlap >= end - start:
            break
        start = end - overlap
    return out


def window_chunks(docs: DataFrame, size: int = 3500, overlap: int = 500, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, place and content of the overlapping windows of plain texts."""

    def rows(k, t: str | None) -> Iterator[tuple]:
        return ((k, i, w) for i, w in enumerate(windows(t or "", size, overlap)))

    return map_texts(docs.select(key, text), f"{key} {docs.schema[key].dataType.simpleString()}, place int, content string", rows)
