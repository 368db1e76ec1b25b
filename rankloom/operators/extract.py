"""Pages to text and Markdown: pattern-based parts as Columns, the parser in one Arrow pass over each page."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that end a line of text.
BLOCK_TAGS = set("address article aside blockquote details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Tags and roles removed before anything else.
STRIPPED_TAGS = set("script style noscript iframe svg canvas form button input select textarea".split())
STRIPPED_ROLES = {"navigation", "banner", "contentinfo"}
VOID_TAGS = set("area base br col embed hr img input link meta source track wbr".split())
#: Hosts whose content has a known place, and the least text a candidate must have.
SITE_PLACES = [
    (r"mp\.weixin\.qq\.com", ["#js_content"]),
    (r"zhuanlan\.zhihu\.com|zhihu\.com/question", [".RichText", ".Post-RichText", ".QuestionAnswer-content"]),
    (r"blog\.csdn\.net", ["#content_views", ".blog-content-box"]),
    (r"juejin\.cn", ["#article-root", ".article-content", ".markdown-body"]),
    (r"cnblogs\.com", ["#cnblogs_post_body", ".postBody"]),
    (r"segmentfault\.com", [".article-content", ".fmt"]),
    (r"developers\.weixin\.qq\.com", [".markdown-body", ".content", "#js_content"]),
    (r"docs\.python\.org|developer\.mozilla\.org|docs\.docker\.com|kubernetes\.io", ["main", "article", "[role=main]"]),
]
#: Usual containers of content.
USUAL_PLACES = ["main", "article", "[role=main]", ".post-content", ".article-content", ".markdown-body", "#content", ".content"]
SITE_TEXT, READABLE_TEXT = 200, 80


def squeezed(text: Column) -> Column:
    """Blanks collapsed, blanks around line ends dropped, at most one empty line; null stays null."""
    t = F.regexp_replace(text, "[ \\t\\u00a0\\u3000]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, " *\\n *", "\n"), "\\n{3,}", "\n\n")
    return F.btrim(t, F.lit(" \n\r\t"))


def charset(declared: Column, html: Column) -> Column:
    """Declared charset, else that of a meta tag within the first 4096 characters, else 'utf-8'."""
    meta = F.regexp_extract(F.substring(F.coalesce(html, F.lit("")), 1, 4096), r"(?i)<meta[^>]+charset=[\"']?([A-Za-z0-9_-]+)", 1)
    own = F.regexp_extract(F.coalesce(declared, F.lit("")), "([A-Za-z0-9_-]+)", 1)
    return F.coalesce(F.nullif(F.lower(own), F.lit("")), F.nullif(F.lower(meta), F.lit("")), F.lit("utf-8"))


def normal_heading(title: Column) -> Column:
    """Longest piece (the first among equals) of a heading without marks and links, in lower case; '' if nothing is left.

    A link of nothing but '#' is dropped whole.
    """
    t = F.regexp_replace(F.regexp_replace(title, r"\[\s*#*\s*\]\([^)]*\)", " "), r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"^\s*#+\s*", ""), r"\s*#+\s*$", "")
    pieces = F.filter(F.transform(F.split(t, r"\s*[|｜·_–—-]\s*"), lambda p: F.lower(F.trim(F.regexp_replace(p, r"\s+", " ")))), lambda p: p != "")
    return F.aggregate(pieces, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))


def without_title(content: Column, title: Column) -> Column:
    """Content without a first line that is a level-one heading and says what the page's title says, or how it begins."""
    first = F.trim(F.substring_index(content, "\n", 1))
    head, whole = normal_heading(first), normal_heading(F.coalesce(title, F.lit("")))
    rest = F.when(F.contains(content, F.lit("\n")), F.regexp_replace(F.regexp_replace(content, "^[^\\n]*\\n", ""), "^\\n+", "")).otherwise(content)
    return F.when(first.rlike(r"^#\s") & (head != "") & (whole != "") & F.startswith(whole, head), rest).otherwise(content)


def answer(content: Column, via: Column) -> Column:
    """Content, or a note that tells the way taken where nothing was extracted."""
    note = F.concat(F.lit("(no content, way taken: "), F.coalesce(via, F.lit("none")), F.lit("; the page may need scripts)"))
    return F.when(F.coalesce(content, F.lit("")) == "", note).otherwise(content)


def truncated(text: Column, most: int) -> Column:
    """Text cut after ``most`` characters with a note; shorter text stays."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(f"\n\n[...truncated at {most} characters]"))).otherwise(text)


def envelope(title: Column, url: Column, content: Column) -> Column:
    return F.concat(F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n\nURL: "), F.coalesce(url, F.lit("")), F.lit("\n\n"), content)


def routed(content_type: Column, content: Column) -> Column:
    """Content for text types; a note for any other."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(kind.contains("text") | kind.contains("html") | (kind == ""), content).otherwise(F.concat(F.lit("["), kind, F.lit("] Binary content")))


def entities(text: Column) -> Column:
    """Text with the five entities of markup decoded."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def text_by_patterns(html: Column) -> Column:
    """Text of flat html without a parser: comments and scripts dropped, block tags as line ends, five entities decoded."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, rf"(?i)</?({'|'.join(sorted(BLOCK_TAGS))}|br)(\s[^>]*)?/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    return squeezed(entities(t))


def decode_body(data: bytes | None, name: str | None) -> str:
    """Text of a page's bytes: by the named charset, by UTF-8 if that is unknown or leaves over one per cent undecodable; null gives ''."""
    if not data:
        return ""
    try:
        text = data.decode(codecs.lookup(name or "utf-8").name, "replace")
    except LookupError:
        return data.decode("utf-8", "replace")
    return data.decode("utf-8", "replace") if text.count("�") > 0.01 * len(text) else text


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, bodies, names = (c.to_pylist() for c in batch.columns)
        texts = [decode_body(b, n).replace("\x00", "") for b, n in zip(bodies, names, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["extract_id", "text"])


def decoded(bodies: DataFrame) -> DataFrame:
    """``extract_id``, ``text`` of ``extract_id``, ``body`` (bytes) and ``charset`` as named; null bodies give ''."""
    return bodies.select("extract_id", "body", "charset").mapInArrow(_decode, "extract_id bigint, text string")


class _Node:
    __slots__ = ("tag", "attrs", "items", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[_Node | str] = []

    def walk(self) -> Iterator[_Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [x for x in reversed(node.items) if isinstance(x, _Node)]

    def text(self) -> str:
        out: list[str] = []
        todo: list[_Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.items)
        return "".join(out)


#: An open tag that one of these closes.
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}
_ENDS_P = BLOCK_TAGS - {"p", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt"}


class _Tree(HTMLParser):
    """A tree of a page that tolerates tags left open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("body", {}, None)
        self.title = ""
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "title":
            self.in_title = True
            return
        while self.at.parent and (self.at.tag in _CLOSES.get(tag, ()) or self.at.tag == "p" and tag in _ENDS_P):
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in VOID_TAGS:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        else:
            self.at.items.append(data)


def tree(html: str) -> _Tree:
    page = _Tree()
    page.feed(html)
    page.close()
    for node in page.root.walk():
        node.items = [x for x in node.items if isinstance(x, str) or not (x.tag in STRIPPED_TAGS or x.attrs.get("role") in STRIPPED_ROLES or x.attrs.get("aria-hidden") == "true")]
    return page


def _matches(node: _Node, place: str) -> bool:
    if place[0] == "#":
        return node.attrs.get("id") == place[1:]
    if place[0] == ".":
        return place[1:] in node.attrs.get("class", "").split()
    return node.attrs.get("role") == "main" if place[0] == "[" else node.tag == place


_UNLIKELY = re.compile(r"nav|menu|breadcrumb|footer|sidebar|share|comment|cookie|consent|banner|\bad\b|ads|promo|widget|related|overlay|popup", re.I)
_LIKELY = re.compile(r"article|body|content|main|post|entry|text", re.I)


def _readable(root: _Node) -> _Node | None:
    """The container whose paragraphs score best: length and commas, less the share of link text, more or less by its name."""
    scores: dict[_Node, float] = {}
    for node in root.walk():
        if node.tag not in ("p", "pre", "td", "li", "blockquote"):
            continue
        text = node.text().strip()
        if len(text) < 25 or not node.parent:
            continue
        gain = 1 + len(re.findall("[,，、]", text)) + min(3, len(text) // 100)
        for up, share in ((node.parent, 1.0), (node.parent.parent, 0.5)):
            if up is not None:
                scores[up] = scores.get(up, 0.0) + gain * share

    def final(node: _Node) -> float:
        name = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
        bonus = 25 * bool(_LIKELY.search(name)) - 25 * bool(_UNLIKELY.search(name)) + 5 * (node.tag in ("article", "main")) - 10 * (node.tag in ("nav", "aside", "footer", "header"))
        whole = len(node.text()) or 1
        links = sum(len(x.text()) for x in node.walk() if x.tag == "a")
        return (scores[node] + bonus) * (1 - links / whole)

    return max(scores, key=final, default=None)


def choose(page: _Tree, url: str | None) -> tuple[_Node, str]:
    """(content, way taken): a known place of the site, the most readable container, else the whole body.

    Where the body has a usual container of content with text, the way is called 'fallback-largest'; the content is the body all the same.
    """
    for pattern, places in SITE_PLACES:
        if url and re.search(pattern, url):
            for place in places:
                found = next((n for n in page.root.walk() if _matches(n, place)), None)
                if found and len(found.text().strip()) >= SITE_TEXT:
                    return found, "site-selector"
            break
    best = _readable(page.root)
    if best is not None and len(best.text().strip()) >= READABLE_TEXT:
        return best, "readability"
    usual = any(any(_matches(n, x) for x in USUAL_PLACES) and n.text().strip() for n in page.root.walk())
    return page.root, "fallback-largest" if usual else "body"


def _squeeze(text: str) -> str:
    text = re.sub(r"[ \t  　]+", " ", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def to_text(node: _Node) -> str:
    """Text with a line end around each block; of trees of any depth."""
    out: list[str] = []
    todo: list[_Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        block = x.tag in BLOCK_TAGS
        if block or x.tag == "br":
            out.append("\n")
        if block:
            todo.append("\n")
        todo += reversed(x.items)
    return _squeeze("".join(out))


_ESCAPED = re.compile(r"([\\*`\[\]])")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A list deeper than this isn't indented any more.
DEEPEST = 16


class _Markdown:
    """Renders a tree from its leaves to its root, without recursion: each node is text of a line or a list of blocks."""

    def __init__(self, url: str | None) -> None:
        self.url = url
        self.text: dict[int, str] = {}
        self.blocks: dict[int, list[str]] = {}

    def absolute(self, to: str) -> str:
        if not self.url or re.match(r"(?:https?|mailto|tel|javascript|data):|#", to, re.I):
            return to
        try:
            return urljoin(self.url, to)
        except ValueError:
            return to

    def of(self, root: _Node) -> str:
        order: list[tuple[_Node, int, bool]] = []
        todo = [(root, 0, False)]
        while todo:
            n, depth, line = todo.pop()
            order.append((n, depth, line))
            inner = 0 if n.tag == "blockquote" else depth + (n.tag == "li")
            todo += [(x, inner, line or n.tag in _HEADINGS or x.tag not in BLOCK_TAGS or x.tag in ("td", "th")) for x in n.items if isinstance(x, _Node)]
        for n, depth, line in reversed(order):
            if line:
                self.text[id(n)] = self._line(n)
            else:
                self.blocks[id(n)] = self._blocks(n, depth)
        return "\n\n".join(b for b in self.blocks[id(root)] if b)

    def _body(self, items: list[_Node | str]) -> str:
        return "".join(_ESCAPED.sub(r"\\\1", re.sub(r"\s+", " ", x)) if isinstance(x, str) else self.text.pop(id(x)) for x in items)

    def _line(self, n: _Node) -> str:
        body = self._body(n.items)
        bare = body.strip()
        if n.tag == "br":
            return "  \n"
        if n.tag in ("b", "strong"):
            return f"**{bare}**" if bare else body
        if n.tag in ("i", "em"):
            return f"_{bare}_" if bare else body
        if n.tag == "code":
            return f"`{n.text()}`"
        if n.tag == "a":
            to = n.attrs.get("href", "")
            return "" if not bare else f"[{bare}]({self.absolute(to)})" if to else body
        if n.tag == "img":
            return f"![{n.attrs['alt']}]({self.absolute(n.attrs.get('src', ''))})" if n.attrs.get("alt") else ""
        return body

    def _blocks(self, n: _Node, depth: int) -> list[str]:
        if n.tag in _HEADINGS:
            body = self._body(n.items).strip()
            return [f"{'#' * int(n.tag[1])} {body}"] if body else []
        if n.tag == "pre":
            return ["```\n" + n.text().strip("\n") + "\n```"]
        if n.tag == "hr":
            return ["---"]
        if n.tag in ("ul", "ol"):
            lines = []
            for k, li in enumerate((x for x in n.items if isinstance(x, _Node) and x.tag == "li"), 1):
                own = self.blocks.pop(id(li)) or [""]
                lines.append("  " * min(depth, DEEPEST) + ("- " if n.tag == "ul" else f"{k}. ") + own[0])
                lines += own[1:]
            return ["\n".join(lines)]
        if n.tag == "table":
            cells = [[self.text.get(id(c), "").strip() for c in r.items if isinstance(c, _Node) and c.tag in ("td", "th")] for r in n.walk() if r.tag == "tr"]
            rows = [r for r in cells if r]
            return ["\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * len(rows[0]), *rows[1:]])] if rows else []
        if n.tag == "tr":
            return []  # its table reads the cells
        out: list[str] = []
        run: list[_Node | str] = []
        for x in [*n.items, None]:
            if x is not None and (isinstance(x, str) or x.tag not in BLOCK_TAGS):
                run.append(x)
                continue
            if t := self._body(run).strip():
                out.append(t)
            run = []
            if x is not None:
                out += self.blocks.pop(id(x)) if id(x) in self.blocks else [self.text[id(x)].strip()]
        if n.tag == "blockquote":
            return ["\n".join("> " + line for line in "\n\n".join(out).split("\n"))]
        return out


def to_markdown(node: _Node, url: str | None) -> str:
    """Markdown with ATX headings, fenced code, '-' lists and tables; with ``url``, links are made absolute. Trees of any depth."""
    return _Markdown(url).of(node)


def extract(html: str | None, url: str | None) -> tuple[str, str, str, str]:
    """(title, text, markdown, way taken); null and '' give empty strings and the way 'body'."""
    if not html:
        return "", "", "", "body"
    page = tree(html)
    node, via = choose(page, url)
    heading = next((n.text().strip() for n in page.root.walk() if n.tag == "h1"), "")
    return page.title.strip() or heading, to_text(node), to_markdown(node, None if via == "site-selector" else url), via


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, htmls, urls = (c.to_pylist() for c in batch.columns)
        cols = list(zip(*(extract(h, u) for h, u in zip(htmls, urls, strict=True)), strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in cols)], ["extract_id", "title", "text", "markdown", "via"])


def extracted(extractions: DataFrame) -> DataFrame:
    """``extract_id``, ``title``, ``text``, ``markdown``, ``via`` of each page with html; one pass makes all of them."""
    return extractions.where("html is not null").select("extract_id", "html", "url").mapInArrow(_run, "extract_id bigint, title string, text string, markdown string, via string")
