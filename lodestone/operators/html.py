"""HTML and Markdown to their structural spine and to trees of chunks.

Parsing markup needs a stack, so these run on Arrow batches of whole pages; a page stays in its row until its chunks come out of it,
and nothing is shuffled.  A null or empty page has no spine and only its document chunk.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Tags that stay, tags that go with what they hold, attributes that say nothing, heading words.
KEPT = frozenset("h1 h2 h3 h4 h5 h6 p br hr ul ol li table thead tbody tfoot tr th td caption strong em b i u".split())
DROPPED = frozenset("script style noscript iframe object embed nav aside header footer form button svg canvas video audio source track figure figcaption picture link meta".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = re.compile(r"(class|id|style|data-[\w-]+|on\w+|srcset|sizes|color|face|width|height|align|valign|bgcolor|border|cellpadding|cellspacing|target|rel|aria-[\w-]+|role)", re.I)
CONTAINERS = (("chapter", "Chương", re.compile(r"Chương\s+([IVXLC0-9]+)\b\.?\s*(.*)", re.I)), ("section", "Mục", re.compile(r"Mục\s+(\d+)\b\.?\s*(.*)", re.I)), ("article", "Điều", re.compile(r"Điều\s+(\d+)\b\.?\s*(.*)", re.I)))
DEPTH = {"document": 0, "chapter": 1, "section": 2, "article": 3, "paragraph": 4, "list": 4, "table": 4}
UNTITLED = "Untitled Document"

BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p ul ol table hr".split())
HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Which open tags a start tag ends, up to the tag that bounds the search.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}


@dataclass
class Node:
    tag: str
    attributes: list[tuple[str, str | None]] = field(default_factory=list)
    inner: list[Node | str] = field(default_factory=list)

    def strings(self) -> Iterator[str]:
        for x in self.inner:
            if isinstance(x, str):
                if x.strip():
                    yield x.strip()
            else:
                yield from x.strings()

    def text(self, gap: str) -> str:
        return gap.join(self.strings())

    def markup(self) -> str:
        body = "".join(entities.escape(x, quote=False) if isinstance(x, str) else x.markup() for x in self.inner)
        if not self.tag:
            return body
        said = "".join(f' {k}="{entities.escape(v or "")}"' for k, v in self.attributes)
        return f"<{self.tag}{said}/>" if self.tag in VOID else f"<{self.tag}{said}>{body}</{self.tag}>"


class Spine(HTMLParser):
    """Builds the tree of kept tags; others are unwrapped, or dropped with what they hold and counted."""

    def __init__(self, markup: str):
        super().__init__()
        self.root, self.removed = Node(""), {}
        self.stack, self.inside = [self.root], []
        self.feed(markup)
        self.close()
        _tidied(self.root)

    def _end(self, tags: set[str], bound: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                del self.stack[k:]
                return
            if self.stack[k].tag in bound:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.inside:
            if tag == self.inside[0] and tag not in VOID:
                self.inside.append(tag)
            return
        if tag in DROPPED:
            self.removed[tag] = self.removed.get(tag, 0) + 1
            if tag not in VOID:
                self.inside.append(tag)
            return
        if tag not in KEPT:
            return
        if tag in BLOCKS:
            self._end({"p"}, {"td", "th", "li"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        node = Node(tag, [(k, v) for k, v in attrs if not NOISE.fullmatch(k)])
        self.stack[-1].inner.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        if self.inside:
            if tag == self.inside[0]:
                self.inside.pop()
        elif tag in KEPT and tag not in VOID:
            self._end({tag}, set())

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.stack[-1].inner.append(data)


def _tidied(node: Node) -> None:
    """White space collapsed within texts, blank texts and paragraphs without words (or with a page number only) gone."""
    kept: list[Node | str] = []
    for x in node.inner:
        if isinstance(x, str):
            x = re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]*", "\n", re.sub("[ \t\xa0]+", " ", x)))
            if x.strip():
                kept.append(x)
        elif x.tag != "p" or not re.fullmatch(r"(\d{1,4})?", x.text(" ")):
            _tidied(x)
            kept.append(x)
    node.inner = kept


def _heading(text: str) -> tuple[str, str] | None:
    for kind, word, pattern in CONTAINERS:
        if m := pattern.fullmatch(text):
            rest = m[2].strip(" .:-")
            return kind, f"{word} {m[1]}" + (f" - {rest}" if rest else "")
    return None


def _titles(open_: dict[str, dict]) -> list[str]:
    """Titles of the open containers from the document down, each once."""
    out: list[dict] = []
    for x in open_.values():
        if x["title"] and not any(x is y for y in out):
            out.append(x)
    return [x["title"] for x in out]


def chunks(spine: Spine) -> list[dict]:
    """The document, then its headings and leaves in reading order.  A container's path is that of the containers open before it; a
    heading without a number is added to the last chapter's title, and to paths whose second title has that chapter's name in it."""
    heads = [x.text(" ") for x in _all(spine.root) if x.tag in ("h1", "h2")]
    out: list[dict] = []

    def add(kind: str, title: str, text: str, parent: dict | None, path: list[str]) -> dict:
        made = {"ord": len(out), "id": f"c{len(out) + 1:04d}", "kind": kind, "title": title, "text": text, "heading_path": path, "parent_id": parent and parent["id"], "children_ids": [], "next_id": None, "depth": DEPTH[kind], "char_count": len(text or title) if parent else 0}
        if len(out) > 1:
            out[-1]["next_id"] = made["id"]
        out.append(made)
        return made

    root = add("document", next((x for x in heads if x), UNTITLED), "", None, [])
    open_, chapter = {"document": root, "chapter": root, "section": root, "article": root}, None
    for x in spine.root.inner:
        node = Node("p", inner=[x]) if isinstance(x, str) else x
        if node.tag in HEADS:
            said = node.text(" ")
            found = _heading(said)
            if found:
                kind, title = found
                above = {"chapter": "document", "section": "chapter", "article": "section"}[kind]
                made = add(kind, title, "", open_[above], _titles(open_))
                root["children_ids"].append(made["id"])
                if open_[above] is not root:
                    open_[above]["children_ids"].append(made["id"])
                for lower in list(open_)[list(open_).index(kind) :]:
                    open_[lower] = made
                chapter = made if kind == "chapter" else chapter
            elif said and node.tag != "h1" and chapter and said not in chapter["title"]:
                chapter["title"] += f" - {said}"
                chapter["char_count"] = len(chapter["title"])
                name = chapter["title"].split(" - ")[0]
                for c in out:
                    if c is not chapter and len(c["heading_path"]) > 1 and name in c["heading_path"][1]:
                        c["heading_path"][1] = chapter["title"]
        elif kind := {"p": "paragraph", "ul": "list", "ol": "list", "table": "table"}.get(node.tag):
            text = re.sub(r"\n{2,}", "\n", node.text("\n")).strip()
            title = text[:60] + ("..." if len(text) > 60 else "")
            made = add(kind, title, text, open_["article"], [*_titles(open_), title])
            open_["article"]["children_ids"].append(made["id"])
    if len(out) > 1:
        out[-1]["next_id"] = root["id"]
    root["next_id"] = next(iter(root["children_ids"]), None)
    return out


def _all(node: Node) -> Iterator[Node]:
    for x in node.inner:
        if not isinstance(x, str):
            yield x
            yield from _all(x)


def _by_page(f: Callable[[str], list[tuple]], column: str, names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(source, *row) for source, page in zip(frame["source"], frame[column]) for row in f(page or "")]
            yield pd.DataFrame(rows, columns=["source", *names])

    return run


def cleaned(pages: DataFrame) -> DataFrame:
    """(source, html) to the markup of the spine, sizes before and after, and tags dropped as name:count."""

    def clean(page: str) -> list[tuple]:
        spine = Spine(page) if page.strip() else None
        made = spine.root.markup() if spine else ""
        return [(made, len(page) if spine else 0, len(made), ",".join(f"{k}:{n}" for k, n in sorted(spine.removed.items())) if spine else "")]

    return pages.select("source", "html").mapInPandas(_by_page(clean, "html", ["cleaned", "raw_size", "cleaned_size", "removed"]), "source string, cleaned string, raw_size long, cleaned_size long, removed string")


CHUNK = "ord int, id string, kind string, title string, text string, heading_path array<string>, parent_id string, children_ids array<string>, next_id string, depth int, char_count int"


def chunked(pages: DataFrame) -> DataFrame:
    """(source, html) to one row a chunk."""
    names = [x.split()[0] for x in CHUNK.split(", ")]
    return pages.select("source", "html").mapInPandas(_by_page(lambda page: [tuple(c[n] for n in names) for c in chunks(Spine(page))], "html", names), f"source string, {CHUNK}")


INLINE = ((re.compile(r"\*\*(.+?)\*\*"), r"<strong>\1</strong>"), (re.compile(r"(?<!\*)\*([^*]+)\*(?!\*)"), r"<em>\1</em>"))


def _inline(line: str) -> str:
    line = entities.escape(line, quote=False)
    for pattern, put in INLINE:
        line = pattern.sub(put, line)
    return line


def markdown_html(text: str) -> str:
    """Headings, lists, pipe tables, and paragraphs of lines; strong and emphasised text."""
    out: list[str] = []
    for block in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n").replace("\r", "\n")):
        kind, held = "", []

        def close() -> None:
            if kind == "p":
                out.append("<p>" + "<br/>\n".join(map(_inline, held)) + "</p>")  # noqa: B023
            elif kind in ("ul", "ol"):
                out.append(f"<{kind}>" + "".join(f"<li>{_inline(x)}</li>" for x in held) + f"</{kind}>")  # noqa: B023
            elif kind == "table":
                rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in held if not re.fullmatch(r"[\s|:-]+", x)]  # noqa: B023
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_inline(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>")

        for line in filter(str.strip, block.split("\n")):
            if m := re.match(r"\s*(#{1,6})\s+(.*?)\s*#*\s*$", line):
                close()
                kind, held = "", []
                out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
                continue
            item = re.match(r"\s*(?:([-*+])|\d+[.)])\s+(.*)", line)
            new = ("ul" if item[1] else "ol") if item else "table" if line.strip().startswith("|") else "p"
            if new != kind:
                close()
                kind, held = new, []
            held.append(item[2] if item else line.strip())
        close()
    return "\n".join(out)


def rendered(texts: DataFrame) -> DataFrame:
    """(source, markdown) to (source, html)."""
    return texts.select("source", "markdown").mapInPandas(_by_page(lambda x: [(markdown_html(x),)], "markdown", ["html"]), "source string, html string")
