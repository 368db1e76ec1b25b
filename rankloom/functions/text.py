"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.constants import HAN_RUN, SPACE


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks and trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))


def clean_query(q: Column) -> Column:
    """Query with white space collapsed and closing punctuation dropped (a blank before it stays); null gives ''."""
    return F.regexp_replace(squeeze(q), "[.,;:!?。，；：！？、]+$", "")


def query_language(q: Column) -> Column:
    """'cn' for a query with two Han characters in a row, else 'en' (null too)."""
    return F.when(F.coalesce(q, F.lit("")).rlike(HAN_RUN + "{2,}"), "cn").otherwise("en")


def has_cjk(text: Column) -> Column:
    """True if the text has a Han, kana or Hangul character; null gives false."""
    return F.coalesce(text, F.lit("")).rlike("[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]")


def bigrams(runs: Column) -> Column:
    """Overlapping pairs of characters of each run in an array of runs; runs of one character give none."""
    pairs = F.transform(
        runs,
        lambda r: F.when(F.length(r) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>")),
    )
    return F.flatten(pairs)


def query_terms(q: Column) -> Column:
    """Distinct terms: words of at least two of [a-z0-9] that aren't all digits, then pairs of Han characters."""
    text = F.coalesce(q, F.lit(""))
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))
    han = F.regexp_extract_all(text, F.lit(f"({HAN_RUN}{{2,}})"), F.lit(1))
    return F.array_distinct(F.concat(words, bigrams(han)))


def coverage(terms: Column, title: Column, snippet: Column | None) -> Column:
    """Share of the terms that title and snippet contain; 1 without terms."""
    parts = [F.coalesce(x, F.lit("")) for x in (title, snippet) if x is not None]
    text = F.lower(F.concat_ws(" ", *parts))
    hits = F.size(F.filter(terms, lambda t: F.contains(text, F.lower(t))))
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(hits / F.size(terms))


def tokens(text: Column) -> Column:
    """Multiset of words in lower case, then pairs of Han characters (a lone one stays alone)."""
    t = F.coalesce(text, F.lit(""))
    words = F.transform(F.regexp_extract_all(t, F.lit("([A-Za-z0-9_]+)"), F.lit(1)), lambda w: F.lower(w))
    runs = F.regexp_extract_all(t, F.lit("([一-鿿㐀-䶿]+)"), F.lit(1))
    return F.concat(words, F.filter(runs, lambda r: F.length(r) == 1), bigrams(runs))


def word_set(text: Column) -> Column:
    """Distinct words of letters and digits in lower case; null gives []."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets given as arrays; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def split_sources(source: Column) -> Column:
    """Engines of a '+'-joined source, blanks trimmed and empty ones dropped; null gives []."""
    return F.filter(F.transform(F.split(F.coalesce(source, F.lit("")), r"\+"), lambda s: F.trim(s)), lambda s: s != "")


def round_half_up(x: Column, digits: int) -> Column:
    """Rounding to ``digits`` places, halves upward."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale
