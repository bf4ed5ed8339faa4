"""Web pages to text: metadata, removal of furniture, choice of the main content, simple markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that are dropped, parts of class or id that mark an element as advertising, and those that mark it as main content.
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "iframe", "noscript", "form", "input", "button")
ADVERTS = ("ad", "ads", "advertisement", "banner", "popup", "modal")
CONTENT = ("content", "post", "entry", "article", "main", "body", "text", "story")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("p div section article main ul ol table tr pre blockquote h1 h2 h3 h4 h5 h6 li".split())


class _Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def walk(self) -> Iterator[_Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(k for k in reversed(n.kids) if isinstance(k, _Node))

    def text(self) -> str:
        """All text in order, each piece trimmed."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n.strip())
            else:
                todo.extend(reversed(n.kids))
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.path = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.path[-1].tag == tag:
            self.path.pop()
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.path[-1].kids.append(node)
        if tag not in _VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.path[-1].kids.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.path) - 1, 0, -1):
            if self.path[k].tag == tag:
                del self.path[k:]
                return

    def handle_data(self, data):
        self.path[-1].kids.append(data)


def parse(html: str) -> _Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def metadata(root: _Node) -> tuple[str, str]:
    """Title and description; the og: ones where the plain ones are missing."""
    title, named = "", {}
    for n in root.walk():
        if n.tag == "title" and not title:
            title = n.text()
        elif n.tag == "meta" and n.attrs.get("content"):
            named.setdefault(n.attrs.get("name") or n.attrs.get("property"), n.attrs["content"])
    return title or named.get("og:title", ""), named.get("description") or named.get("og:description", "")


def _furniture(n: _Node) -> bool:
    if n.tag in DROPPED:
        return True
    marks = (*n.attrs.get("class", "").lower().split(), n.attrs.get("id", "").lower())
    return any(a in m for m in marks if m for a in ADVERTS)


def clean(root: _Node) -> None:
    """Removes furniture and advertising, in place."""
    for n in root.walk():
        n.kids = [k for k in n.kids if isinstance(k, str) or not _furniture(k)]


def _likeliness(div: _Node, size: int) -> int:
    """Two points for each content word in the class and in the id, and up to six for the text's length."""
    marks = (" ".join(div.attrs.get("class", "").split()).lower(), div.attrs.get("id", "").lower())
    return 2 * sum(word in mark for mark in marks for word in CONTENT) + sum(points for least, points in ((100, 1), (500, 2), (1000, 3)) if size > least)


def main_content(root: _Node) -> _Node:
    """The longest article, main or section of more than 100 characters; a main role; the likeliest div; the body."""
    nodes = list(root.walk())
    size = {id(n): len(n.text()) for n in nodes if n.tag in ("article", "main", "section", "div") or n.attrs.get("role") == "main"}
    for tag in ("article", "main", "section"):
        own = [n for n in nodes if n.tag == tag]
        best = max(own, key=lambda n: size[id(n)], default=None)
        if best is not None and size[id(best)] > 100:
            return best
    role = next((n for n in nodes if n.attrs.get("role") == "main"), None)
    if role is not None and size[id(role)] > 100:
        return role
    divs = [n for n in nodes if n.tag == "div"]
    best = max(divs, key=lambda n: (_likeliness(n, size[id(n)]), size[id(n)]), default=None)
    if best is not None and (_likeliness(best, size[id(best)]) > 0 or size[id(best)] > 50):
        return best
    return next((n for n in nodes if n.tag == "body"), root)


def markdown(node: _Node) -> str:
    """Headings, lists, bold, italics, links and paragraphs; blank lines collapsed."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, tuple):
            out.append(n[0])
            continue
        if isinstance(n, str):
            out.append(re.sub(r"\s+", " ", n))
            continue
        before = after = ""
        if re.fullmatch("h[1-6]", n.tag):
            before, after = f"\n\n{'#' * int(n.tag[1])} ", "\n\n"
        elif n.tag == "li":
            before, after = "\n- ", "\n"
        elif n.tag in ("b", "strong"):
            before = after = "**"
        elif n.tag in ("i", "em"):
            before = after = "*"
        elif n.tag == "a" and n.attrs.get("href"):
            before, after = "[", f"]({n.attrs['href']})"
        elif n.tag == "br":
            before = "\n"
        elif n.tag in _BLOCK:
            before = after = "\n\n"
        todo.append((after,))
        todo.extend(reversed(n.kids))
        todo.append((before,))
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, description, text) of pages; null pages are empty."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for html in b.column(1).to_pylist():
                root = parse(html or "")
                title, about = metadata(root)
                clean(root)
                rows.append((title, about, markdown(main_content(root))))
            cols = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, "title", "description", "text"])

    src = pages.select(id_col, F.col(html_col))
    return src.mapInArrow(go, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, title string, description string, text string")


def titles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title) by a pattern, where the title alone is wanted."""
    return pages.select(id_col, F.trim(F.regexp_extract(F.coalesce(html_col, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))
