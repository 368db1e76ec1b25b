"""Problem 1: template residue, filler, error messages and script notices in place of content.

Every segment (a snippet, or a line of a page's text; of longer ones each sentence) is judged by evidence that adds up: placeholder
detectors, phrases of notices, how little it says, whether its words meet the words of the page's address
slug and title, whether they are words that slugs and titles of the corpus have at all, and how many addresses
and hosts show the very same segment once digits and names are masked. Talk about templates, errors or
scripts counts against. Segments that some detector holds for are grouped over the corpus, pre-aggregated by
their masked text, and joined back salted. The weights of the evidence are fitted to the corpus: the patterns
of evidence are counted, and expectation maximisation over these counts (at most two to the number of
features, whatever the corpus) tells residue from other text, from stated beginnings.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import bigrams
from rankloom.functions.urls import bare_host, path
from rankloom.plans.durable import cut
from rankloom.plans.skew import salted_join

#: Unfilled placeholders of the usual template languages.
PLACEHOLDER = (
    r"\{\{\{?[^{}\n]{1,40}\}\}|\$\{[^{}\n]{1,40}\}|#\{[^{}\n]{1,40}\}|\{%[^{}\n]{1,40}%\}|<%=?[^<>\n]{1,40}%>|\[\[[^\[\]\n]{1,40}\]\]"
    r"|\[[A-Z][A-Z_]{2,30}\]|%[A-Z][A-Z_]{2,30}%|__[A-Z][A-Z_]{1,30}__|@@[A-Z_a-z]{2,30}@@|\{[a-z]+(?:[_.][a-z_]+)+\}|【(?:在此|请)[^】]{1,20}】|\{[A-Za-z]{3,30}\}|(?i:\[object object\])"
)
#: Text that stands where text should come, by its own wording. Groups that may repeat at any length are possessive, as others recurse; a longer run of x is data.
FILLER = (
    r"(?i)lorem ipsum dolor|\bipsum dolor sit|consectetur adipiscing|^\W*(?:(?:undefined|null|NaN|none|text|test|content|title)(?:\W++|$)){2,}+(?:[0-9a-f]{4,16}\W*)?$"
    r"|^\W*(?:x{4,240}+(?:\W++|$))++$|^\W*(?:(?:asdf|qwerty|qwer|zxcv|foo|bar|baz|blah)\W*+){2,}+(?:[0-9a-f]{4,16}\W*)?$|^\W*(?:todo|tbd|fixme|tba)\b[\W]*(?:$|:|write|add|fill)|^\W*untitled (?:document|page)|\bNaN results\b|results found for (?:null|undefined)"
    r"|\b(?:sample|dummy|placeholder|example|filler) (?:text|copy|content)[.,:]? (?:replace|edit|to be|goes|please|only)|\breplace this (?:with|text)|this is an example page|\bto be supplied by\b"
    r"|\byour (?:\w+ ){1,2}(?:goes|comes|here)\b|\binsert (?:a |your |the )?(?:\w+ ){1,6}here\b|\bcomes? in this box|edit or delete (?:it|this)|\bcoming soon\W*$"
    r"|^(?:示例(?:内容|文字|文本)\W*){2,}|此处为.{0,4}(?:示例|占位)|(?:示例|占位)(?:文字|文本|内容)[，,].{0,2}请|请(?:在此|输入|填写)(?:输入|填写)?.{0,4}(?:描述|内容|简介|标题|摘要)|在此(?:填写|输入)"
    r"|texte d.exemple|remplacer par votre|votre texte ici|hier steht ein|beispieltext|bitte ersetzen|ihr text hier|texto de ejemplo (?:de|para) su|aquí va el texto|su texto aquí"
)
#: Notices that scripts are required.
SCRIPTS = (
    r"(?i)(?:please|you need to|you must|must) (?:enable|activate|turn on|allow|switch on)[^.]{0,30}(?:javascript|java script|scripts?\b|scripting)|(?:javascript|scripts?|scripting) (?:is|are) (?:disabled|turned off|not enabled|blocked|required)"
    r"|your browser (?:does not|doesn.t|has not)[^.]{0,20}(?:run|support|enabled?)[^.]{0,12}scripts?|\b(?:this|the) (?:site|page|app|application|viewer|content|website)[^.]{0,30}(?:requires?|needs?|work properly without|rendered by)[^.]{0,12}(?:javascript|scripts?)\b|\bnoscript mode|(?:activate|enable) scripting and (?:refresh|reload)"
    r"|请(?:先)?(?:启用|开启|打开|允许).{0,8}(?:脚本|JavaScript)|浏览器.{0,6}(?:不支持|未启用|已禁用|禁用了|没有启用).{0,4}(?:脚本|JavaScript)|(?:脚本|JavaScript).{0,2}(?:已被?禁用|未启用)"
    r"|(?:veuillez|merci d.)\s?activer (?:le )?javascript|activez javascript|javascript (?:est désactivé|doit être activé)|bitte (?:aktivieren|schalten) sie[^.]{0,20}(?:javascript|skript)|aktivieren sie[^.]{0,20}(?:javascript|skripte)|javascript (?:ist deaktiviert|muss aktiviert)|(?:active|habilite|debe activar|por favor,? active) (?:el )?javascript|javascript está desactivado"
)
#: Error pages.
ERRORS = (
    r"(?i)(?:^|[-|:]\s*)(?:http )?(?:error )?[45]\d\d\b\W{0,3}(?:not found|gone|bad gateway|forbidden|internal|service|unauthori|gateway|bad request|page not|the page|error|too many)|internal server error\W+(?:reference|please|try|$)|^\W*(?:\w+ [-|] )?internal server error|^\W*(?:\w+ [-|] )?bad gateway|(?:the )?page you(?:.re| are| were)? (?:looking for|requested)[^.]{0,20}(?:does not|doesn.t|cannot|could not|has been|no longer|was not)"
    r"|can.t find (?:that|this|the) page|(?:it|page) may have been (?:moved|deleted|removed)|requested (?:resource|page|url)[^.]{0,20}(?:no longer|not found|not available|was not)|access denied|(?:don.t|do not) have permission to (?:view|access)|session (?:has )?expired|sign in again|too many requests from|error \d{2,4}: (?:the )?(?:service|server)|(?:service|site|server) is (?:temporarily|currently) (?:unavailable|down|busy|offline)"
    r"|could not connect to (?:the )?database|database connection (?:failed|error)|traceback \(most recent call last\)|(?:nullpointer|illegalargument|runtime|io|sql|class\w+)exception at \w|(?:warning|notice|fatal error|parse error): (?:undefined|uncaught|call to|syntax)|stack trace:|checking your browser before|verify (?:that )?you are (?:human|not a robot)|are you a robot|unusual traffic|domain is parked|may be for sale|down for maintenance|under maintenance|^\W*(?:\w+ [-|] )?loading\W*(?:$|if nothing)|if nothing happens"
    r"|(?:页面|网页|您访问的.{0,6})(?:不存在|未找到|找不到|已失效)|页面.{0,4}已被?删除|没有权限(?:访问|查看)|系统繁忙|^\W*(?:\w+ [-|] )?服务器(?:内部)?错误|访问过于频繁|完成验证后继续|正在加载|网站?(?:正在)?维护中|错误码\s*\d|请求(?:已)?超时"
    r"|page (?:introuvable|non trouvée)|erreur (?:interne du serveur|\d{3})\b|accès refusé|session (?:a )?expirée?|service (?:momentanément|temporairement) indisponible|seite (?:wurde )?nicht gefunden|\(fehler \d+\)|zugriff verweigert|interner serverfehler|sitzung (?:ist )?abgelaufen|vorübergehend nicht (?:erreichbar|verfügbar)|página no encontrada|acceso denegado|error interno del servidor|sesión (?:ha )?(?:expirado|caducada)|servicio no disponible temporalmente"
)
#: Wording of those who write about such pages.
TALK = (
    r"(?i)\bhow to\b|\bthis (?:guide|article|chapter|post)\b|\bexplains?\b|\bwe (?:compared|measured|tested)\b|\bsites that\b|\bhas long\b|\bsuch as\b|\bno longer needs?\b|\bsince version\b|\breport counts\b|\blog line\b|\bappears \d+ times\b|\bthe variable\b|\bis replaced at\b|\btemplates?,|\bescaping rules\b|\brefer to your own\b|\bwhen you configure\b|\bmust match\b|\bdesigners?\b|\bhas helped\b"
    r"|本文|介绍如何|教程|调试.{1,14}时|时若出现|排版时|常用.{0,6}占位|模板语法|渲染时|正式发布前|日志中|\bcet article\b|\bce guide\b|\bcomment (?:créer|rédiger|configurer|personnaliser)\b|\bdepuis la version\b|\bdieser (?:artikel|leitfaden|beitrag)\b|\bwie man\b|\bseit version\b|\beste artículo\b|\besta guía\b|\bcómo (?:crear|diseñar|configurar)\b|\bdesde la versión\b"
)
#: Words that alone say little but are usual on such pages.
WEAK = r"(?i)^\W*(?:loading|undefined|null|nan|tbd|n/a|error|untitled|request id \w+|try again|please wait|请稍候|加载中)\W*$|try again later|请稍后再试|if the problem persists|réessayez plus tard|später erneut|inténtelo más tarde"

#: Parts of words one of which is in every text that a detector holds for, in lower case; a quick test before the patterns.
STEMS = (
    "{ [[ <% %} __ @@ 【 [object [a [b [c [d [e [f [g [h [i [j [k [l [m [n [o [p [q [r [s [t [u [v [w [x [y [z".split()
    + ["script", "skript", "脚本", "lorem", "ipsum", "consectetur", "undefined", "null", "nan", "none none", "text text", "test test", "content content", "title title", "xxxx", "asdf", "qwer", "zxcv", "foo", "bar", "baz", "blah", "todo", "tbd", "fixme", "tba"]
    + ["untitled", "sample ", "dummy ", "placeholder", "example ", "filler", "replace this", "supplied by", "your ", "insert", "this box", "or delete", "coming soon", "示例", "占位", "请", "填写", "exemple", "remplacer", "votre texte", "hier steht", "beispieltext", "ersetzen", "ihr text", "ejemplo", "aquí va", "su texto"]
    + ["not found", "gone", "gateway", "forbidden", "internal", "service", "unauthori", "bad request", "the page", "page ", "error", "too many", "find th", "may have been", "requested", "denied", "permission", "expired", "in again", "temporarily", "currently", "connect to", "database connection", "traceback", "exception at"]
    + ["warning:", "notice:", "stack trace", "your browser", "robot", "you are human", "unusual traffic", "parked", "for sale", "maintenance", "loading", "nothing happens", "不存在", "未找到", "找不到", "已失效", "删除", "权限", "系统繁忙", "服务器", "频繁", "完成验证", "加载", "维护中", "错误", "超时", "浏览器"]
    + ["introuvable", "trouvée", "erreur", "refusé", "expiré", "indisponible", "gefunden", "fehler", "verweigert", "abgelaufen", "vorübergehend", "encontrada", "denegado", "expirado", "caducada", "no disponible", "n/a", "request id", "try again", "please wait", "plus tard", "später erneut", "más tarde", "persists", "noscript"]
)

#: The vocabulary of Latin filler; the first are words that hardly any other text has.
FILLER_OWN = (
    "lorem ipsum amet consectetur adipiscing eiusmod incididunt labore aliqua minim veniam nostrud exercitation ullamco laboris aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat pariatur excepteur occaecat cupidatat proident deserunt mollit laborum"
).split()
FILLER_WORDS = [*FILLER_OWN, *"dolor dolore sit elit sed do tempor ut et magna enim ad quis nisi ex ea in esse eu nulla sint non sunt culpa qui officia anim id est".split()]
#: Different words of FILLER_OWN, and share of FILLER_WORDS, from which a text is filler.
OWN_WORDS, FILLER_SHARE = 3, 0.5

#: Evidence of a segment: how often residue, and other text that a detector holds for, is taken to show it before anything is counted.
BEGINNINGS = {
    "dense": (0.4, 0.02),
    "placeholder": (0.4, 0.5),
    "notice": (0.6, 0.4),
    "weak": (0.1, 0.1),
    "talk": (0.01, 0.7),
    "topical": (0.1, 0.8),
    "mismatch": (0.9, 0.5),
    "short": (0.8, 0.6),
    "repeated": (0.5, 0.3),
    "on_hosts": (0.5, 0.3),
}
#: Share of residue among such segments before anything is counted, segments that the beginnings count for, and rounds of the fit.
RESIDUE_SHARE, STRENGTH, ROUNDS = 0.7, 50.0, 60
#: Share of the rows whose slug or title has a term from which on it is a topic, and topics that make a segment topical.
TOPIC_SHARE, TOPICS = 0.001, 3
#: A line of more characters is a paragraph; it is judged sentence by sentence.
PARAGRAPH = 240
#: A shorter sentence is judged with the next one.
SENTENCE = 20


def _words(segment: Column) -> Column:
    """Number of words outside placeholders; two Han characters count as one."""
    rest = F.regexp_replace(segment, PLACEHOLDER, " ")
    return F.size(F.regexp_extract_all(rest, F.lit(r"([A-Za-zÀ-ÿ'’]+)"), F.lit(1))) + F.size(F.regexp_extract_all(rest, F.lit("([㐀-鿿])"), F.lit(1))) / 2


#: Words of addresses and titles that no page is about.
_NO_TOPIC = "docs guide blog wiki article thread posts notes html with what reference tutorial howto page error errors".split()


def _terms(latin: Column, han: Column) -> Column:
    """Words of four letters and more, and pairs of Han characters."""
    words = F.filter(F.regexp_extract_all(latin, F.lit("([a-zà-ÿ]{4,})"), F.lit(1)), lambda w: ~w.isin(_NO_TOPIC))
    return F.array_distinct(F.concat(words, bigrams(F.regexp_extract_all(han, F.lit("([㐀-鿿]{2,})"), F.lit(1)))))


def _topic(url: Column, title: Column) -> Column:
    """Terms of the address slug and the title."""
    slug = F.regexp_replace(F.lower(path(url)), r"[^a-z]+", " ")
    return _terms(F.concat_ws(" ", slug, F.lower(F.coalesce(title, F.lit("")))), F.coalesce(title, F.lit("")))


def topics(pages: DataFrame) -> DataFrame:
    """``term`` of each topic: terms that at least TOPIC_SHARE of the rows (``url``, ``title``) have in slug or title."""
    least = TOPIC_SHARE * pages.count()
    return pages.select(F.explode(_topic(F.col("url"), F.col("title"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("term")


def signature(segment: Column) -> Column:
    """Segment in lower case with numbers, identifiers and white space masked."""
    s = F.regexp_replace(F.lower(segment), r"\[?\b[0-9a-f]*[0-9][0-9a-f.]*\b\]?", "#")
    return F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^ | $", "")


def _filler(segment: Column) -> Column:
    """True if the segment is mostly words of Latin filler, in whatever order."""
    words = F.regexp_extract_all(F.lower(segment), F.lit(r"([a-zà-ÿ'’]+)"), F.lit(1))
    own = F.size(F.array_intersect(words, F.array(*map(F.lit, FILLER_OWN))))
    return (own >= OWN_WORDS) & (F.size(F.filter(words, lambda w: w.isin(FILLER_WORDS))) >= FILLER_SHARE * _words(segment))


_PERCENT = re.compile(r"%[A-Z][A-Z_]{2,30}%")
_LATIN, _OWN = re.compile(r"[a-z]+"), frozenset(FILLER_OWN)


def promising(text: str) -> bool:
    """True if a detector may hold for the text."""
    low = text.lower()
    return any(x in low for x in STEMS) or "%" in text and bool(_PERCENT.search(text)) or len(_OWN.intersection(_LATIN.findall(low))) >= OWN_WORDS


_BESIDE = "\x1f"
#: Between two sentences, but not inside a placeholder.
_BREAK = re.compile(r"(?<=[.!?])\s+(?![^{}\n]{0,40}\}|[^<>\n]{0,40}%>|[^\[\]\n]{0,40}\]\])|(?<=[。！？])(?![^【】\n]{0,20}】)")


def pieces(line: str) -> list[str]:
    """The line, or the sentences of one that is a paragraph, each with those beside it after a separator."""
    line = line.replace(_BESIDE, " ")
    if len(line) <= PARAGRAPH:
        return [line]
    out = [""]
    for sentence in _BREAK.split(line):
        if len(out[-1]) >= SENTENCE:
            out.append(sentence)
        else:
            out[-1] = f"{out[-1]} {sentence}"
    if len(out) > 1 and len(out[-1]) < SENTENCE:
        out[-2:] = [f"{out[-2]} {out[-1]}"]
    return [s + _BESIDE + " ".join(out[max(0, k - 1) : k + 2]) for k, s in enumerate(out) if promising(s)]


def _promising_lines(text: Column) -> Column:
    """The lines, or sentences of paragraphs, that a detector may hold for, one a line; null if there are none."""

    def run(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(["\n".join(p for line in t.split("\n") if promising(line) for p in pieces(line)) or None if t and promising(t) else None for t in texts], dtype=object)

    return F.pandas_udf(run, "string").asNondeterministic()(text)  # else it runs again in filters made from it


def _detected(segments: DataFrame) -> DataFrame:
    """Adds the detectors' columns to ``origin, row_id, url, title, segment, beside`` and keeps the segments that one holds for."""
    s = F.col("segment")
    d = segments.withColumn("placeholders", F.size(F.regexp_extract_all(s, F.lit(f"({PLACEHOLDER})"), F.lit(1))))
    d = d.withColumn("notice", s.rlike(FILLER) | s.rlike(SCRIPTS) | s.rlike(ERRORS)).withColumn("weak", s.rlike(WEAK)).withColumn("filler", _filler(s))
    return d.where("placeholders > 0 or notice or weak or filler")


def fitted(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[list[float], float]:
    """(weight of each feature of BEGINNINGS, bias): log-odds of residue, by expectation maximisation over counted patterns of features.

    Features are taken to be independent within residue and within other text. The beginnings count as
    STRENGTH segments, so that they decide where there are few and the corpus decides where there are many.
    """
    shown = np.array(list(BEGINNINGS.values())).T  # residue, other
    x = np.array([p for p, _ in patterns], float).reshape(-1, len(BEGINNINGS))
    n = np.array([c for _, c in patterns], float)
    share, rates = RESIDUE_SHARE, shown.copy()
    for _ in range(ROUNDS):
        weights = np.log(rates[0] / (1 - rates[0])) - np.log(rates[1] / (1 - rates[1]))
        bias = np.log(share / (1 - share)) + np.log((1 - rates[0]) / (1 - rates[1])).sum()
        residue = n / (1 + np.exp(-(x @ weights + bias)))
        own = np.stack([residue, n - residue])
        rates = (own @ x + STRENGTH * shown) / (own.sum(axis=1, keepdims=True) + STRENGTH)
        share = (residue.sum() + STRENGTH * RESIDUE_SHARE) / (n.sum() + STRENGTH)
    return weights.tolist(), float(bias)


def judged(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """``origin, row_id, segment, score`` (log-odds of residue) of the segments that a detector holds for; ``pages`` has ``url`` and ``title`` of all rows."""
    s = F.col("segment")
    d = _detected(segments)
    d = d.withColumn("words", _words(s)).withColumn("talk", F.col("beside").rlike(TALK)).withColumn("sig", F.xxhash64(signature(s)))
    text = F.lower(s)
    d = d.withColumn("mismatch", ~F.exists(_topic(F.col("url"), F.col("title")), lambda t: F.contains(text, t)))
    d = d.withColumn("host", bare_host(F.col("url"))).select("origin", "row_id", "segment", "placeholders", "notice", "weak", "filler", "words", "talk", "sig", "mismatch", "host", F.xxhash64("url").alias("address"))
    d = cut(d)
    # the same segment on many addresses and hosts: pre-aggregated, as one segment may be very frequent
    seen = d.groupBy("sig").agg(F.approx_count_distinct("address", 0.1).alias("addresses"), F.approx_count_distinct("host", 0.1).alias("hosts"), F.avg(F.col("mismatch").cast("double")).alias("astray"), F.first("segment").alias("like"))
    seen = cut(seen.withColumn("like", F.regexp_replace("like", PLACEHOLDER, " ")))
    terms = seen.select("sig", F.explode(_terms(F.lower("like"), F.col("like"))).alias("term"))
    about = salted_join(terms, topics(pages), ["term"], by="sig").groupBy("sig").agg(F.count(F.lit(1)).alias("topics"))
    seen = seen.drop("like").join(about, "sig", "left")
    again = F.col("astray") >= 0.6
    features = {
        "dense": (F.col("placeholders") > 0) & (F.col("words") <= 6 * F.col("placeholders")) | F.col("filler"),
        "placeholder": F.col("placeholders") > 0,
        "notice": F.col("notice"),
        "weak": F.col("weak") & ~F.col("notice"),
        "talk": F.col("talk"),
        "topical": F.coalesce(F.col("topics") >= TOPICS, F.lit(False)),
        "mismatch": F.col("mismatch"),
        "short": F.col("words") <= 14,
        "repeated": (F.col("addresses") >= 3) & again,
        "on_hosts": (F.col("hosts") >= 3) & again,
    }
    e = cut(salted_join(d, seen, ["sig"], by="row_id").select("origin", "row_id", "segment", F.array(*[features[k].cast("int") for k in BEGINNINGS]).alias("features")))
    weights, bias = fitted([(tuple(r.features), r["count"]) for r in e.groupBy("features").count().collect()])  # two to the number of features at most
    score = F.lit(bias)
    for k, w in enumerate(weights):
        score = score + w * F.get("features", F.lit(k))
    return e.select("origin", "row_id", "segment", score.alias("score"))


def segments_of(results: DataFrame, extractions: DataFrame) -> DataFrame:
    """Snippets, and the lines of pages' texts, that a detector may hold for: ``origin, row_id, url, title, segment, beside``.

    A paragraph gives its sentences; ``beside`` has the text in which talk counts, the segment and the sentences next to it. Null and blank ones give none.
    """
    one_line = F.regexp_replace("snippet", r"[\r\n]+", " ")
    snippets = results.select(F.lit("search_results").alias("origin"), F.col("result_id").alias("row_id"), "url", "title", _promising_lines(one_line).alias("text"))
    pages = extractions.select(F.lit("extractions").alias("origin"), F.col("extract_id").alias("row_id"), "url", "title", _promising_lines(F.col("plain")).alias("text"))
    both = snippets.unionByName(pages)
    return both.select("origin", "row_id", "url", "title", F.explode(F.split("text", "\n")).alias("piece")).select("origin", "row_id", "url", "title", *(F.trim(F.regexp_replace(F.substring_index("piece", _BESIDE, n), r"\s+", " ")).alias(name) for name, n in (("segment", 1), ("beside", -1)))).where("segment <> ''")


def residue(results: DataFrame, extractions: DataFrame) -> DataFrame:
    """``origin``, ``row_id`` of each record whose snippet or plain is residue in whole or in part.

    Null, empty and blank values are never cases. A repeated row is a case each time. The address and the
    title may be null: such a record simply has nothing its text could meet. Whole texts are read. Empty
    tables give no rows.
    """
    pages = results.select("url", "title").unionByName(extractions.select("url", "title"))
    return judged(segments_of(results, extractions), pages).where(F.col("score") > 0).select("origin", "row_id").distinct()


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/search_results.parquet"), spark.read.parquet(f"{sf_dir}/extractions.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(*_tables(spark, sf_dir))


def p1_clean_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``result_id`` of the search results that remain once residue is excluded (rows without a snippet stay)."""
    results, extractions = _tables(spark, sf_dir)
    bad = residue(results, extractions).where("origin = 'search_results'").select(F.col("row_id").alias("result_id"))
    return results.select("result_id").join(bad, "result_id", "left_anti")


def p1_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``extract_id`` of the pages that remain once residue is excluded (pages without plain stay)."""
    results, extractions = _tables(spark, sf_dir)
    bad = residue(results, extractions).where("origin = 'extractions'").select(F.col("row_id").alias("extract_id"))
    return extractions.select("extract_id").join(bad, "extract_id", "left_anti")
