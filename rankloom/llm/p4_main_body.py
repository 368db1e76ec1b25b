"""Problem 4: the main body of a page without its furniture.

A streaming parser turns a page into lines and counts the tags and link characters that each line costs.
The text-to-tag ratio of the lines is smoothed by a Gaussian and split in two clusters by a threshold of
the page's own; lines above it are content regions. Regions are learned from over the corpus: how often a
line's wording (numbers masked), and each of its words, lie inside and outside the content regions. The
final log-odds of a line joins both kinds of evidence and is pooled over the container that holds the line
where there is markup, and smoothed along the lines where there is none.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.plans.durable import cut

#: Tags that end a line.
BLOCK_TAGS = frozenset(
    "address article aside blockquote details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside div footer form header main nav section".split())
SKIPPED = frozenset(("script", "style"))
#: Text for browsers without scripts; one that is never closed hides nothing.
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(?:(?!<noscript\b).)*?</noscript\s*>", re.I | re.S)
#: Container names of page furniture and of content, as HTML defines them or authors name them.
FURNITURE_TAGS, CONTENT_TAGS = frozenset(("nav", "header", "footer", "aside", "form")), frozenset(("article", "main"))
_FURNITURE_NAME = re.compile(r"(?:^|[-_\s])(?:top|main|site)?(?:nav\w*|menu|breadcrumbs?|footer|bottom|header|sidebar|widget|share|social|comments?|cookies?|consent|banner|ads?|advert\w*|promo|related|overlay|popup|newsletter|toolbar)(?:$|[-_\s])", re.I)
_CONTENT_NAME = re.compile(r"(?:^|[-_\s])(?:content|article|post|entry|body|text|prose)(?:$|[-_\s])", re.I)

#: Spread of the Gaussian in lines, for ratios and for the final scores of pages without markup.
SIGMA, SIGMA_PLAIN = 0.9, 0.8
TOKEN_BITS, LINE_BITS = 18, 21
#: Evidence from which on a region counts as clear, and as fair; fair ones teach where clear ones of a kind are too few a share.
SURE, FAIR, FEW = 1.0, 0.3, 0.2
#: Weight of the words' evidence against counts of the whole line, and of a region's and a name's evidence.
STRONG = 12
WORDS_WEIGHT, REGION_WEIGHT, NAME_WEIGHT, LINK_WEIGHT, TITLE_WEIGHT = 3.0, 0.6, 3.0, 3.0, 6.0


class _Page(HTMLParser):
    """Parser events into lines: text, tags since the line before, characters in links, container."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.names: list[float] = [0.0]  # prior of each container: above 0 for furniture
        self.parent: list[int] = [0]
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.parts: list[str] = []
        self.tags = self.links = self.in_link = self.skip = 0

    def updatepos(self, i: int, j: int) -> int:  # line numbers aren't needed
        return j

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.lines.append((text, self.tags, self.links, self.stack[-1][1]))
                self.tags = self.links = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "br" or tag in BLOCK_TAGS:
            self._end_line()
            if tag in CONTAINERS or tag in ("ul", "ol") and attrs:
                name = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")) if attrs else ""
                prior = 1.0 if tag in FURNITURE_TAGS or name and _FURNITURE_NAME.search(name) else -1.0 if tag in CONTENT_TAGS or name and _CONTENT_NAME.search(name) else 0.0
                if not prior and self.names[self.stack[-1][1]] > 0:
                    prior = self.names[self.stack[-1][1]]
                self.names.append(prior)
                self.parent.append(self.stack[-1][1])
                self.stack.append((tag, len(self.names) - 1))
        elif tag == "a":
            self.in_link = 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCK_TAGS:
            self._end_line()
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] == tag:
                    del self.stack[k:]
                    break
        elif tag == "a":
            self.in_link = 0

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if "\n" not in data:
            self.parts.append(data)
            self.links += len(data) * self.in_link
            return
        first, *rest = data.split("\n")
        self.parts.append(first)
        self.links += len(first) * self.in_link
        for part in rest:
            self._end_line()
            if part:
                self.parts.append(part)
                self.links += len(part) * self.in_link

    def close(self) -> None:
        super().close()
        self._end_line()
        self._join_small()

    def _join_small(self) -> None:
        """A container of one or two lines belongs with the container around it if that has no more of its own."""
        own = [0] * len(self.names)
        for x in self.lines:
            own[x[3]] += 1
        to = list(range(len(own)))
        for k, up in enumerate(self.parent):
            if up and own[k] <= 2 and own[up] <= 2:
                to[k] = to[up]
        self.lines = [(*x[:3], to[x[3]]) for x in self.lines]


def parse(html: str) -> _Page:
    page = _Page()
    page.feed(_NOSCRIPT.sub("", html) if "<noscript" in html.lower() else html)
    page.close()
    return page


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with the kernel renormalised at both ends."""
    r = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = np.convolve(x, kernel)[r : r + len(x)]
    return full / np.convolve(np.ones(len(x)), kernel)[r : r + len(x)]


def regions(ratio: np.ndarray, pooled: np.ndarray | None = None) -> np.ndarray:
    """How far each line is from the threshold between the two clusters of smoothed ratios, in their half-distance (above 0: content).

    ``pooled``: the ratio of the container that holds the line, which counts as much as the line's own.
    """
    x = smooth(np.log1p(ratio), SIGMA)
    if pooled is not None:
        x = (x + np.log1p(pooled)) / 2
    low, high = float(x.min()), float(x.max())
    if high - low < 0.7:  # one cluster: all content or all furniture
        return np.full(len(x), 1.0 if float(x.mean()) > 3.2 else -1.0)
    for _ in range(8):
        above = x > (low + high) / 2
        last, n = (low, high), int(above.sum())
        high = float(x @ above) / n
        low = float(x @ ~above) / (len(x) - n)
        if last == (low, high):
            break
    return np.clip((x - (low + high) / 2) / max(0.25, (high - low) / 2), -2, 2)


_WIDE = re.compile("[\u2e80-\U0010ffff]+")


def _said(line: str) -> int:
    """Characters of the line; a Han character says about as much as two letters."""
    return len(line) if line.isascii() else 2 * len(line) - len(_WIDE.sub("", line))


def _weak(lines: list[tuple[str, int, int, int]], names: list[float]) -> list[float]:
    """Evidence of each line before wording counts: below 0 for furniture."""
    length = np.array([len(x[0]) for x in lines], float)
    chars = np.array([_said(x[0]) for x in lines], float)
    tags, links, block = (np.array(x) for x in list(zip(*lines, strict=True))[1:])
    linked = np.minimum(1, links / length)
    free = chars * (1 - linked)
    total = lambda x: np.bincount(block, x, len(names))[block]
    found = regions(free / np.maximum(1, tags), total(free) / np.maximum(1, total(tags))) * REGION_WEIGHT
    found -= LINK_WEIGHT * (total(linked * length) > 0.6 * total(length))
    return (found - NAME_WEIGHT * np.array(names)[block]).tolist()


_SPACES = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_TOKENS = re.compile(r"[㐀-鿿]+|[^\W\d_]+|#|[|·»>/©:?]")


def _plain_lines(plain: str) -> list[str]:
    return [t for x in plain.split("\n") if (t := _SPACES.sub(" ", x).strip())]


def page_lines(html: str | None, plain: str | None) -> tuple[list[str], list[int], list[float]]:
    """(lines, container of each or -1, evidence of each) of a page; the lines are plain's unless it is null."""
    own = _plain_lines(plain) if plain is not None else None
    if not html:
        own = own or []
        lengths = np.array([_said(x) for x in own], float)
        return own, [-1] * len(own), (regions(lengths) * REGION_WEIGHT).tolist() if own else []
    page = parse(html)
    if not page.lines:
        return own or [], [-1] * len(own or []), [0.0] * len(own or [])
    weak = _weak(page.lines, page.names)
    if own is None or len(own) == len(page.lines):
        return own if own is not None else [x[0] for x in page.lines], [x[3] for x in page.lines], weak
    at: dict[str, list[int]] = {}
    for k, x in enumerate(page.lines):
        at.setdefault(x[0], []).append(k)
    found = [at[t].pop(0) if at.get(t) else -1 for t in own]
    return own, [page.lines[k][3] if k >= 0 else -1 for k in found], [weak[k] if k >= 0 else 0.0 for k in found]


_PAGE = pa.schema([("extract_id", pa.int64()), ("title", pa.string()), ("lines", pa.list_(pa.string())), ("block", pa.list_(pa.int32())), ("weak", pa.list_(pa.float32()))])


def _parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, titles, htmls, plains = (c.to_pylist() for c in batch.columns)
        rows = [page_lines(h, p) for h, p in zip(htmls, plains, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(titles, pa.string()), pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.float32()))],
            schema=_PAGE,
        )


@lru_cache(maxsize=1 << 17)
def _token(t: str) -> int:
    return zlib.crc32(t.encode()) >> (32 - TOKEN_BITS)


@lru_cache(maxsize=1 << 15)
def _short_features(sig: str) -> tuple[int, tuple[int, ...]]:
    return _features(sig)


def _features(sig: str) -> tuple[int, tuple[int, ...]]:
    """(slot of the whole line, slots of its words, pairs of Han characters, signs and shape)."""
    out = set()
    for t in _TOKENS.findall(sig):
        if t[0] > "㏿" and len(t) > 1:
            out.update(t[k : k + 2] for k in range(len(t) - 1))
        else:
            out.add(t)
    out.add(f"\x00{min(6, len(sig).bit_length())}{sig[-1:] in '.。!！?？'}")
    return zlib.crc32(sig.encode(), 7) >> (32 - LINE_BITS), tuple(map(_token, out))


def features(line: str) -> tuple[int, tuple[int, ...]]:
    sig = _DIGITS.sub("#", line.lower())
    return _short_features(sig) if len(sig) <= 60 else _features(sig)


_EDGE = re.compile(r"[\W_]+")


def is_title(text: str, title: str, bare: str) -> bool:
    """True if the line is the page's title, perhaps without the site's name; ``bare``: the title's letters and digits."""
    if len(text) > 2 * len(title):
        return False
    own = _EDGE.sub("", text.lower())
    return len(own) >= 4 and (own == bare or len(own) >= 0.5 * len(bare) and bare.startswith(own))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = (1 << TOKEN_BITS) + (1 << LINE_BITS)
    table = np.zeros((4, size), np.float32)  # clear furniture, clear content, fair furniture, fair content
    for batch in batches:
        slots: tuple[list[int], ...] = ([], [], [], [])
        for title, lines, block, weak in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bare = _EDGE.sub("", (title or "").lower())
            for text, score in zip(lines, _pooled(block, weak), strict=True):
                # only clear regions teach, and a page's title says nothing about titles in lists of other pages
                if abs(score) < FAIR or bare and is_title(text, title, bare):
                    continue
                line, words = features(text)
                to = slots[(score > 0) + 2 * (abs(score) < SURE)]
                to.append(line + (1 << TOKEN_BITS))
                to.extend(words)
        for k in range(4):
            table[k] += np.bincount(np.array(slots[k], np.int64), minlength=size).astype(np.float32)
    at = np.flatnonzero(table.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(row[at]) for row in table)], ["slot", *_KINDS])


_KINDS = ("furniture", "content", "fair_furniture", "fair_content")


def _pooled(block: list[int], scores: list[float]) -> list[float]:
    """Scores averaged over the lines of each container; lines without one keep theirs."""
    total: dict[int, list[float]] = {}
    for b, s in zip(block, scores, strict=True):
        if b >= 0:
            total.setdefault(b, []).append(s)
    mean = {b: sum(x) / len(x) for b, x in total.items()}
    return [mean[b] if b >= 0 else s for b, s in zip(block, scores, strict=True)]


def train(pages: DataFrame) -> np.ndarray:
    """Counts of each slot outside and inside content regions; the size doesn't depend on the corpus."""
    counted = pages.select("title", "lines", "block", "weak").mapInArrow(_count, "slot int, " + ", ".join(f"{k} float" for k in _KINDS))
    got = counted.groupBy("slot").agg(*[F.sum(k).cast("float").alias(k) for k in _KINDS]).toArrow()
    table = np.zeros((4, (1 << TOKEN_BITS) + (1 << LINE_BITS)), np.float32)
    for k, name in enumerate(_KINDS):
        table[k][got.column("slot").to_numpy()] = got.column(name).to_numpy()
    return settled(table)


def settled(table: np.ndarray) -> np.ndarray:
    """Clear counts, with the fair ones of a kind added if its clear lines are less than a share of FEW of the other kind's."""
    lines = table[:2, 1 << TOKEN_BITS :].sum(axis=1)
    return np.stack([table[k] + (table[k + 2] if lines[k] < FEW * lines[1 - k] else 0) for k in (0, 1)])


class Wording:
    """Log-odds of a line's wording (above 0: content) from the counts of its words and of the whole line."""

    def __init__(self, table: np.ndarray) -> None:
        off = 1 << TOKEN_BITS
        self.odds = np.log((table[1][:off] + 0.5) / (table[0][:off] + 0.5)).tolist()
        self.furniture, self.content = table[0][off:], table[1][off:]
        self.seen: dict[str, float] = {}

    def __call__(self, text: str) -> float:
        sig = _DIGITS.sub("#", text.lower())
        if (s := self.seen.get(sig)) is None:
            line, words = _short_features(sig) if len(sig) <= 60 else _features(sig)
            # every word counts; those of a long line are no independent witnesses, so together they count as STRONG of them
            total = sum([self.odds[w] for w in words]) * min(1.0, STRONG / max(1, len(words)))
            by_words = 1 / (1 + math.exp(-max(-6.0, min(6.0, total))))
            n_f, n_c = float(self.furniture[line]), float(self.content[line])
            p = (n_c + WORDS_WEIGHT * by_words) / (n_f + n_c + WORDS_WEIGHT)
            s = math.log((p + 1e-3) / (1 - p + 1e-3))
            if len(sig) <= 120:
                if len(self.seen) >= 1 << 17:
                    self.seen.clear()
                self.seen[sig] = s
        return s


def furniture_lines(title: str | None, lines: list[str], block: list[int], weak: list[float], wording: Wording) -> list[int]:
    """Numbers (from 1) of the lines that aren't main body."""
    bare = _EDGE.sub("", (title or "").lower())
    scores, last = [], ""
    for text, w in zip(lines, weak, strict=True):
        s = wording(text) + w
        if bare and text != last and is_title(text, title, bare):
            s += TITLE_WEIGHT
            last = text
        scores.append(s)
    if lines and max(block) < 0:
        final = smooth(np.array(scores), SIGMA_PLAIN).tolist()
        final = [0.5 * a + 0.5 * b for a, b in zip(final, scores, strict=True)]
    else:
        final = _pooled(block, scores)
    return [k for k, s in enumerate(final, 1) if s < 0]


def _score(spark: SparkSession, table: np.ndarray):
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wording = Wording(shared.value)
        for batch in batches:
            ids, *rest = (c.to_pylist() for c in batch.columns)
            out = [furniture_lines(*page, wording) for page in zip(*rest, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["extract_id", "numbers"])

    return run


def _judged(extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = extractions.sparkSession
    pages = cut(extractions.select("extract_id", "title", "html", "plain").mapInArrow(_parse_pages, "extract_id bigint, title string, lines array<string>, block array<int>, weak array<float>"))
    found = pages.select("extract_id", "title", "lines", "block", "weak").mapInArrow(_score(spark, train(pages)), "extract_id bigint, numbers array<int>")
    return pages, found


def furniture(extractions: DataFrame) -> DataFrame:
    """``extract_id``, ``line_no`` of each line that isn't main body.

    Lines are the non-blank lines of plain, or of the text of html if plain is null; an empty or blank text
    has none. A page without markup is judged by wording and line lengths alone. A refetched page is judged
    for itself. Whole pages are read. Empty tables give no rows.
    """
    return _judged(extractions)[1].select("extract_id", F.explode("numbers").alias("line_no"))


def main_bodies(extractions: DataFrame) -> DataFrame:
    """``extract_id``, ``body``: the lines that are main body, joined by line ends; '' where there are none."""
    pages, found = _judged(extractions)
    both = pages.select("extract_id", "lines").join(found, "extract_id")
    kept = F.filter("lines", lambda x, k: ~F.array_contains(F.col("numbers"), k + 1))
    return both.select("extract_id", F.array_join(kept, "\n").alias("body"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture(spark.read.parquet(f"{sf_dir}/extractions.parquet"))


def p4_main_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_bodies(spark.read.parquet(f"{sf_dir}/extractions.parquet"))
