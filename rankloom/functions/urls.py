"""URL functions as Column expressions (no Python in the hot path).

Addresses are cut up by regular expressions rather than by ``parse_url``: that one rejects the raw
non-ASCII characters and blanks that browsers accept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.constants import TRACKING_PARAMS

_ADDRESS = r"^(?i:https?)://(?:[^/?#@\s]*@)?([^/?#:\s]+)(?::\d*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _trimmed(url: Column) -> Column:
    return F.regexp_replace(url, r"^[\x00-\x20\u00a0\u3000\ufeff]+|[\x00-\x20\u00a0\u3000\ufeff]+$", "")


def is_valid_url(url: Column) -> Column:
    """True for http and https addresses with a host; null and anything else give false."""
    return F.coalesce(_trimmed(url).rlike(_ADDRESS), F.lit(False))


def host(url: Column) -> Column:
    """Host in lower case, with any ``www.``; '' where the address isn't valid or null."""
    return F.coalesce(F.lower(F.regexp_extract(_trimmed(url), _ADDRESS, 1)), F.lit(""))


def bare_host(url: Column) -> Column:
    """``host`` without a leading ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    """Path of the address, '/' where it is empty; '' where the address isn't valid."""
    found = F.regexp_extract(_trimmed(url), _ADDRESS, 2)
    return F.when(host(url) == "", F.lit("")).otherwise(F.when(found == "", F.lit("/")).otherwise(found))


def query_string(url: Column) -> Column:
    """Query of the address without '?'; '' where there is none."""
    return F.coalesce(F.regexp_extract(_trimmed(url), _ADDRESS, 3), F.lit(""))


def sorted_params(query: Column, drop: list[str] | None = None) -> Column:
    """``name=value`` pairs with names in lower case, tracking names dropped, sorted and joined by '&'."""
    gone = F.array(*[F.lit(x) for x in (TRACKING_PARAMS if drop is None else drop)])
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p: F.concat(F.lower(F.regexp_extract(p, r"^([^=]*)", 1)), F.lit("="), F.regexp_extract(p, r"^[^=]*=?(.*)$", 1)))
    kept = F.filter(named, lambda p: ~F.array_contains(gone, F.regexp_extract(p, r"^([^=]*)", 1)))
    return F.array_join(F.array_sort(kept), "&")


def decoded(text: Column) -> Column:
    """Percent-decoded text; text that can't be decoded stays."""
    return F.coalesce(F.try_url_decode(text), text)


def url_key(url: Column) -> Column:
    """Key under which addresses of one page meet: ``host|path|params``.

    Scheme, port, user, ``www.``, fragment, one closing slash, tracking parameters and the order of the
    parameters don't count. An address that isn't valid is its own key; null stays null.
    """
    way = path(url)
    way = F.when(F.length(way) > 1, F.regexp_replace(way, "/$", "")).otherwise(way)
    key = F.concat_ws("|", bare_host(url), way, sorted_params(decoded_query(url)))
    return F.when(url.isNull(), F.lit(None)).when(host(url) == "", url).otherwise(key)


def decoded_query(url: Column) -> Column:
    """Query with each value decoded, but for '&' and '=' that would change its structure."""
    pairs = F.filter(F.split(query_string(url), "&"), lambda p: p != "")
    return F.array_join(F.transform(pairs, lambda p: F.regexp_replace(decoded(p), "&", "%26")), "&")


def is_homepage(url: Column) -> Column:
    """True if the path is empty or only slashes; false where the address isn't valid."""
    return (host(url) != "") & path(url).rlike("^/*$")


def path_segments(url: Column) -> Column:
    """Number of segments of the path that aren't empty."""
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def host_suffixes(h: Column) -> Column:
    """The host and each of its parent domains: 'a.b.c' gives [a.b.c, b.c, c]; '' gives []."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    return F.when(F.coalesce(h, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))


def normalize_domain(domain: Column) -> Column:
    """Domain as typed by a person: scheme, ``www.`` and path dropped, '.com' added where there is no dot."""
    d = F.lower(F.trim(F.coalesce(domain, F.lit(""))))
    d = F.regexp_replace(d, r"^https?://", "")
    d = F.regexp_replace(d, r"^www\.", "")
    d = F.regexp_extract(d, r"^([^/?#]*)", 1)
    return F.when(d.contains("."), d).otherwise(F.concat(d, F.lit(".com")))


def decode_bing_redirect(url: Column) -> Column:
    """Target of a redirect whose ``u`` parameter is 'a1' and url-safe base64; else the address as it is."""
    u = F.regexp_extract(F.coalesce(query_string(url), F.lit("")), r"(?:^|&)u=([^&]*)", 1)
    raw = F.translate(F.regexp_replace(u, "^a1", ""), "-_", "+/")
    target = F.try_validate_utf8(F.try_to_binary(raw, F.lit("base64")).cast("string"))
    return F.when((u != "") & target.rlike("^https?://"), target).otherwise(url)


#: White space and controls that don't count around an address.
_OUTER = "".join(map(chr, [*range(0x21), 0xA0, 0x3000, 0xFEFF]))


def with_address(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host``, ``domain`` (without ``www.``), ``path`` and ``key`` of an address column.

    The same values as ``host``, ``bare_host``, ``path`` and ``url_key`` give, in projections that follow one
    another, so that the address is cut up once however many of them are used.
    """
    gone = F.array(*[F.lit(x) for x in TRACKING_PARAMS])
    d = df.withColumn("_t", F.btrim(url, F.lit(_OUTER)))
    d = d.withColumn("host", F.coalesce(F.lower(F.regexp_extract("_t", _ADDRESS, 1)), F.lit("")))
    found = F.regexp_extract("_t", _ADDRESS, 2)
    d = d.withColumn("path", F.when(F.col("host") == "", "").otherwise(found)).withColumn("_q", F.when(F.contains("_t", F.lit("?")), F.regexp_extract("_t", _ADDRESS, 3)).otherwise(""))
    d = d.withColumn("path", F.when((F.col("path") == "") & (F.col("host") != ""), "/").otherwise(F.col("path"))).drop("_t")
    d = d.withColumn("domain", F.when(F.startswith("host", F.lit("www.")), F.substring("host", 5, 1 << 20)).otherwise(F.col("host")))
    plain = lambda p: F.when(F.contains(p, F.lit("%")) | F.contains(p, F.lit("+")), F.replace(decoded(p), F.lit("&"), F.lit("%26"))).otherwise(p)
    pairs = F.transform(F.filter(F.split("_q", "&"), lambda p: p != ""), plain)
    named = F.transform(pairs, lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("k"), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)).alias("v")))
    kept = F.filter(named, lambda x: ~F.array_contains(gone, x["k"]))
    params = F.array_join(F.array_sort(F.transform(kept, lambda x: F.concat(x["k"], F.lit("="), x["v"]))), "&")
    d = d.withColumn("_params", F.when(F.col("_q") == "", "").otherwise(params))
    way = F.when((F.length("path") > 1) & F.endswith("path", F.lit("/")), F.substring(F.col("path"), F.lit(1), F.length("path") - 1)).otherwise(F.col("path"))
    key = F.when(F.col("host") == "", F.col(url)).otherwise(F.concat(F.col("domain"), F.lit("|"), way, F.lit("|"), F.col("_params")))
    return d.withColumn("key", key).drop("_q", "_params")
