"""Sources: providers' JSON answers, engines' result pages, host lists."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote, urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rankloom.functions.constants import JUNK_TLDS, LOWERED, SHORTENERS
from rankloom.functions.text import split_sources
from rankloom.functions.urls import is_valid_url
from rankloom.operators.extract import _Node, tree
from rankloom.plans.skew import salted_join

#: Schema of each provider's answer, path of its rows, and fields (title, url, snippet, date, site, score).
PROVIDERS = {
    "tavily": ("results array<struct<title:string,url:string,content:string,published_date:string,score:double>>", ["results"], ("title", "url", "content", "published_date", None, "score"), 800),
    "bocha": ("data struct<webPages:struct<value:array<struct<name:string,url:string,summary:string,snippet:string,datePublished:string,siteName:string>>>>, webPages struct<value:array<struct<name:string,url:string,summary:string,snippet:string,datePublished:string,siteName:string>>>", ["data.webPages.value", "webPages.value"], ("name", "url", "summary", "datePublished", "siteName", None), 500),
    "zhipu": ("search_result array<struct<title:string,link:string,content:string,publish_date:string,media:string>>, data struct<search_result:array<struct<title:string,link:string,content:string,publish_date:string,media:string>>>", ["search_result", "data.search_result"], ("title", "link", "content", "publish_date", "media", None), 500),
}


def _rows_of(body: Column, provider: str) -> Column:
    schema, paths, (title, url, snippet, date, site, score), cut = PROVIDERS[provider]
    data = F.from_json(body, schema)
    rows = F.coalesce(*[_path(data, p) for p in paths])

    def one(x: Column) -> Column:
        text = F.coalesce(F.nullif(x[snippet], F.lit("")), x["snippet"]) if provider == "bocha" else x[snippet]
        null = F.lit(None).cast("string")
        return F.struct(
            x[title].alias("title"), x[url].alias("url"), F.substring(text, 1, cut).alias("snippet"), (x[date] if date else null).alias("date_published"),
            (x[site] if site else null).alias("site_name"), (x[score] if score else F.lit(None).cast("double")).alias("api_score"),
        )

    return F.transform(rows, one)


def _path(data: Column, path: str) -> Column:
    for name in path.split("."):
        data = data[name]
    return data


def parsed(responses: DataFrame, limit: int = 50) -> DataFrame:
    """Rows of providers' answers (``ref``, ``source``, ``body``): title, url, snippet and what else they tell.

    Rows without a valid address are dropped, at most ``limit`` of an answer are taken (1 to 50). An answer of
    another shape gives no rows; ``failures`` tells why.
    """
    limit = min(50, max(1, limit))
    parts = [responses.where(F.col("source") == p).select("ref", "source", F.posexplode(_rows_of(F.col("body"), p)).alias("pos", "r")) for p in PROVIDERS]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.where(F.col("pos") < limit).select("ref", "source", "pos", "r.*").where(is_valid_url(F.col("url")))


def failures(responses: DataFrame) -> DataFrame:
    """``ref``, ``source``, ``error`` of answers without rows: 'auth' for refused keys, else 'contract'."""
    rows = F.lit(None)
    for p in PROVIDERS:
        rows = F.when(F.col("source") == p, F.size(_rows_of(F.col("body"), p))).otherwise(rows)
    code = F.get_json_object("body", "$.code")
    # a status code given as a string isn't one; only the wording tells then
    auth = F.col("body").rlike(r'"(?:code|status)"\s*:\s*(?:401|403|429)\b') | F.coalesce(F.col("body"), F.lit("")).rlike(r"(?i)unauthori[sz]ed|invalid.{0,10}key|api key|quota|rate limit")
    return responses.withColumn("n", rows).where("n is null or n < 0").select("ref", "source", code.alias("code"), F.when(auth, "auth").otherwise("contract").alias("error"))


def provider_column(source: Column) -> Column:
    """The provider among the engines of a joined source, null if there is none."""
    own = split_sources(source)
    return F.coalesce(*[F.when(F.array_contains(own, F.lit(p)), p) for p in PROVIDERS])


def as_responses(results: DataFrame) -> DataFrame:
    """Result rows written as one-row answers of their provider (``ref`` is the result_id, ``source`` the provider)."""
    s, provider = F.col("snippet"), provider_column(F.col("source"))
    bodies = {
        "tavily": F.to_json(F.struct(F.array(F.struct("title", "url", s.alias("content"))).alias("results"))),
        "bocha": F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.col("title").alias("name"), "url", s.alias("summary"), s.alias("snippet"))).alias("value")).alias("webPages")).alias("data"))),
        "zhipu": F.to_json(F.struct(F.array(F.struct("title", F.col("url").alias("link"), s.alias("content"))).alias("search_result"))),
    }
    body = F.lit(None).cast("string")
    for p, b in bodies.items():
        body = F.when(provider == p, b).otherwise(body)
    return results.select(F.col("result_id").alias("ref"), provider.alias("source"), body.alias("body")).where("source is not null")


def keys_of(*places: dict[str, str | None] | None) -> dict[str, str]:
    """Keys of the providers from several places, the first place that has a key wins; blank ones and names or keys that begin with '_' count as none."""
    usable = lambda k, v: isinstance(v, str) and v.strip() and not v.startswith("_") and not k.startswith("_")
    out: dict[str, str] = {}
    for place in places:
        for k, v in (place or {}).items():
            if usable(k, v):
                out.setdefault(k, v.strip())
    return out


def provider_of(keys: dict[str, str | None], forced: str | None = None) -> str | None:
    """The provider to ask: the forced one, else the first of tavily, bocha and zhipu with a key. A forced one without a key raises ValueError."""
    own = keys_of(keys)
    if forced and forced not in own:
        raise ValueError(f"no key of {forced}; there are keys of: {', '.join(own) or 'none'}")
    return forced or next((p for p in PROVIDERS if p in own), None)


#: Entries taken from a list of each kind, in the order of the list; lists of top-level domains have no limit.
LIST_LIMITS = {"hosts": 1000, "abp": 1500}
#: Top-level domains that stay blocked although a list allows hosts in them.
NOTORIOUS_TLDS = (
    "top xyz icu info zip mov click link sbs work site online shop club live fun store buzz loan gdn vip review racing stream download"
    " win bid party trade date faith webcam email rest cam men mom cricket quest realtor sport"
).split()
#: Built-in shorteners that the list maintenance leaves to the lists.
_LISTED_SHORTENERS = ("shortest.link",)


def parse_blocklists(lines: DataFrame) -> DataFrame:
    """``action``, ``rule`` of the lines (``list``, ``kind``, ``n``, ``value``) of host lists, with the built-in rules; no repeats.

    ``kind`` is 'hosts' (address and host), 'abp' ('||host^') or 'abp-tlds' ('||*.tld^' or '||tld^'), ``n`` the number of
    the line in its list. Comments, headers, addresses, hosts without a dot, local names and other lines count
    for nothing. A list's first LIST_LIMITS entries are taken, repeated ones included. A top-level domain with
    exceptions is taken if it is one of NOTORIOUS_TLDS. A list without lines simply adds nothing.
    """
    line = F.trim(F.regexp_replace("value", r"\r$", ""))
    host = F.lower(F.regexp_extract(line, r"^(?:0\.0\.0\.0|127\.0\.0\.1)\s+([^\s#]+)", 1))
    abp = F.lower(F.regexp_extract(line, r"^\|\|([a-z0-9_.-]+)\^", 1))
    tld = F.regexp_extract(line, r"^\|\|\*?\.?([a-z0-9-]{2,})\^", 1)
    is_host = lambda h: F.contains(h, F.lit(".")) & ~h.rlike(r"^\d+\.\d+\.\d+\.\d+$") & ~F.contains(h, F.lit(":"))
    entry = (
        F.when((F.col("kind") == "hosts") & is_host(host), host)
        .when((F.col("kind") == "abp") & is_host(abp), abp)
        .when((F.col("kind") == "abp-tlds") & (tld != "") & (~F.contains(line, F.lit("denyallow")) | tld.isin(NOTORIOUS_TLDS)), F.concat(F.lit("."), tld))
    )
    own = lines.where(~line.rlike(r"^[!#\[]|^$")).select("list", "kind", "n", entry.alias("rule")).where("rule is not null")
    names = [r.list for r in lines.select("list").distinct().collect()]  # the lists that someone subscribed to
    taken = own.where(~F.col("kind").isin(list(LIST_LIMITS))).select("rule")
    for kind, limit in LIST_LIMITS.items():
        for name in names:
            # the limit is the feature; the first rows are found by each task and merged, no list is sorted in one task
            taken = taken.unionByName(own.where((F.col("kind") == kind) & (F.col("list") == name)).orderBy("n").limit(limit).select("rule"))
    built_in = [("." + t,) for t in NOTORIOUS_TLDS] + [(h,) for h in SHORTENERS if h not in _LISTED_SHORTENERS]
    spark = lines.sparkSession
    remove = taken.unionByName(spark.createDataFrame(built_in, "rule string")).distinct().select(F.lit("remove").alias("action"), "rule")
    return remove.unionByName(spark.createDataFrame([("lower", h) for h in LOWERED], "action string, rule string"))


def with_fallback(rules: DataFrame) -> DataFrame:
    """``rule``, ``action`` of a rule table; where it has no 'remove' or no 'lower' rule at all, the built-in ones of that kind."""
    spark = rules.sparkSession
    built_in = spark.createDataFrame([(r, "remove") for r in [*JUNK_TLDS, *SHORTENERS]] + [(r, "lower") for r in LOWERED], "rule string, action string")
    own = rules.where(F.trim("rule") != "").select("rule", "action")
    present = own.where(F.col("action").isin("remove", "lower")).select("action").distinct()  # two rows at most
    return own.unionByName(built_in.join(F.broadcast(present), "action", "left_anti").select("rule", "action"))


def resolve_redirects(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with ``url`` replaced by the ``target`` that ``known`` has for it (``address``, ``target``, unique), else as it is."""
    found = known.select(F.col("address").alias("_address"), F.col("target").alias("_target"))
    keyed = rows.withColumn("_address", F.col("url"))
    joined = salted_join(keyed, found, ["_address"], by="result_id", how="left")
    return joined.withColumn("url", F.coalesce("_target", "url")).drop("_address", "_target")


def _class(pattern: str):  # noqa: ANN202
    """Test for a class attribute that the pattern is found in."""
    return lambda n: bool(re.search(pattern, n.attrs.get("class", "")))


def _has(node: _Node, name: str) -> bool:
    return name in node.attrs.get("class", "").split()


def _named(*names: str):  # noqa: ANN202
    return lambda n: any(_has(n, x) for x in names)


#: Where each engine's page has its rows: the row, attributes with the address, the title, and places of the snippet in order.
PAGE_RULES = {
    "baidu": (_named("result", "c-container"), ("mu",), lambda n: n.tag == "h3", [_class("summary"), _named("c-abstract"), _named("c-span-last"), _class("abstract")]),
    "baiduMobile": (lambda n: "tpl" in n.attrs or _has(n, "c-result"), ("data-log",), lambda n: n.tag == "h3" or _class("title")(n), [_class("summary|abstract|content")]),
    "so360": (lambda n: n.tag == "li" and _has(n, "res-list"), ("data-mdurl",), lambda n: n.tag == "h3", [lambda n: _class("res-desc")(n) or n.tag == "p"]),
    "sogouWeixin": (lambda n: n.tag == "li" and n.parent is not None and n.parent.tag == "ul" and _has(n.parent, "news-list"), (), lambda n: n.tag == "h3", [_named("txt-info")]),
    "cnBing": (_named("b_algo"), (), lambda n: n.tag == "h2", [_named("b_caption")]),
    "intlBing": (_named("b_algo"), (), lambda n: n.tag == "h2", [_named("b_caption")]),
    "sogou": (_named("vrwrap"), ("data-url",), lambda n: n.tag == "h3", [_class("str-text|space-txt|text-layout"), lambda n: n.tag == "p"]),
}
#: Notices of verification pages, titles that are no results, and hosts without content by engine.
_WALL = re.compile("百度安全验证|请输入验证码|网络不给力|antispider|unusual traffic")
_NO_RESULT = re.compile("百度图片|视频大全|大家还在搜|相关搜索")
_NO_CONTENT = {
    "baidu": re.compile(r"^(?:image|lightapp)\.baidu\.com$", re.I),
    "baiduMobile": re.compile(r"^(?:m|haokan|baike|ailegal|ikan|ad|lightapp|image|recommend_list|baijiahao)\.baidu\.com$", re.I),
    "so360": re.compile(r"(?:^|\.)(?:so\.com|360\.cn)$", re.I),
}
#: A page of the desktop engine without rows that is shorter is a verification page.
SMALL_PAGE = 3000
WEIXIN = "https://weixin.sogou.com"


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def bing_target(url: str) -> str:
    """Target of a redirect whose ``u`` parameter is 'a1' and url-safe base64; else the address as it is."""
    found = re.search(r"[?&]u=([^&#]*)", url)
    if not found:
        return url
    raw = unquote(found[1]).removeprefix("a1").translate(str.maketrans("-_", "+/"))
    try:
        target = base64.b64decode(raw + "=" * (-len(raw) % 4)).decode()
    except ValueError:
        return url
    return target if re.match("https?://", target) else url


def _address(engine: str, node: _Node, attributes: tuple[str, ...], link: _Node | None) -> str:
    for a in attributes:
        value = node.attrs.get(a, "") or next((x.attrs[a] for x in node.walk() if x.attrs.get(a)), "")
        if a == "data-log" and value:
            try:
                value = (json.loads(value) or {}).get("mu", "")
            except (ValueError, AttributeError):
                value = ""
        if re.match("https?://", value or ""):
            return value
    href = link.attrs["href"] if link else ""
    if engine == "sogouWeixin":
        return urljoin(WEIXIN, href) if href else ""
    if engine == "baiduMobile" and not re.match("https?://", href):
        href = next((x.attrs["href"] for x in node.walk() if x.tag == "a" and x.attrs.get("href", "").startswith("http")), "")
    return bing_target(href) if engine == "intlBing" else href


def _snippet(engine: str, node: _Node, places: list) -> str:
    text = next((t for place in places if (t := _squeezed(next((x.text() for x in node.walk() if place(x)), "")))), "")
    if engine != "sogouWeixin":
        return text
    account = next((x for x in node.walk() if _has(x, "s-p")), None)
    name = next((x for x in account.walk() if x.tag == "a"), account) if account else None
    who = re.sub(r"document\.write.*$", "", _squeezed(name.text()), flags=re.I)[:40].strip() if name else ""
    return (f"【{who}】{text}" if who else text)[:400]


def parse_page(engine: str, html: str, limit: int = 10) -> list[tuple[str, str, str]]:
    """(title, url, snippet) of an engine's result page; repeated titles, advertisements and the engine's own lists are dropped.

    A verification page (by its notice, or a small page of the desktop engine, without rows) raises ValueError.
    """
    is_row, attributes, is_title, places = PAGE_RULES[engine]
    page = tree(html)
    out, seen = [], set()
    for node in page.root.walk():
        if len(out) >= limit:
            break
        if not is_row(node) or any("data-tuiguang" in x.attrs for x in node.walk()):
            continue
        heading = next((x for x in node.walk() if is_title(x)), None)
        link = next((x for x in (heading or node).walk() if x.tag == "a" and x.attrs.get("href")), None)
        title = _squeezed((heading or link or node).text())
        url = _address(engine, node, attributes, link)
        host = re.match(r"https?://([^/?#:]+)", url)
        noise = _NO_CONTENT.get(engine)
        if not host or not title or title in seen or _NO_RESULT.search(title) or noise and noise.search(host[1]):
            continue
        seen.add(title)
        out.append((title, url, _snippet(engine, node, places)))
    if not out and (_WALL.search(page.title + page.root.text()) or engine == "baidu" and len(html) < SMALL_PAGE):
        raise ValueError(f"{engine}: verification page")
    return out


def parse_found(text: str, limit: int = 10) -> list[tuple[str, str, str]]:
    """(title, url, snippet) of the JSON that the metasearch process prints; anything else gives none."""
    try:
        rows = json.loads(text)
    except ValueError:
        return []
    own = [(str(r.get("title") or "").strip(), str(r.get("href") or r.get("url") or "").strip(), str(r.get("body") or r.get("snippet") or "").strip()) for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
    return [r for r in own if r[0] and r[1]][: max(1, limit)]


class SavedPages(DataSource):
    """Spark source over saved answers of engines: ``spark.read.format("saved_pages").option("fixture_dir", ...)``.

    The folder may be a path or an address of a shared file system. Files are named ``<engine>--<query id>.html``,
    those of the metasearch process ``ddgs--<query id>.json``; each is a partition and is read again once if
    that fails. A verification page gives a row with ``error``.
    """

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "query_id bigint, source string, pos int, title string, url string, snippet string, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _SavedPagesReader(self.options.get("fixture_dir", "."), int(self.options.get("limit", "10")))


def _file_system(folder: str):  # noqa: ANN202
    from pathlib import Path

    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else str(Path(folder).absolute()))


class _SavedPagesReader(DataSourceReader):
    def __init__(self, folder: str, limit: int) -> None:
        self.folder, self.limit = folder, limit

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector

        system, path = _file_system(self.folder)
        names = sorted(x.base_name for x in system.get_file_info(FileSelector(path, allow_not_found=True)) if re.fullmatch(r"\w+--\d+\.(?:html|json)", x.base_name))
        return [InputPartition(n) for n in names] or [InputPartition("")]

    def _text(self, name: str, tries: int = 2) -> str:
        system, path = _file_system(self.folder)
        try:
            with system.open_input_stream(f"{path.rstrip('/')}/{name}") as f:
                return f.read().decode(errors="replace")
        except OSError:
            if tries <= 1:
                raise
            return self._text(name, tries - 1)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        stem, _, kind = partition.value.rpartition(".")
        engine, _, query_id = stem.partition("--")
        try:
            text = self._text(partition.value)
            rows = parse_found(text, self.limit) if kind == "json" else parse_page(engine, text, self.limit)
        except ValueError as e:
            yield int(query_id), engine, None, None, None, None, str(e)
            return
        for k, (title, url, snippet) in enumerate(rows, 1):
            yield int(query_id), engine, k, title, url, snippet, None
