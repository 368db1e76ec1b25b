"""Which documentation host a query is about, and the query that finds its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.constants import AUTHORITY_HOSTS, LABEL_STOP, OFFICIAL_ALIASES
from rankloom.operators.pool import clean_rules
from rankloom.plans.skew import bounded


def label_score(stem: Column, label: Column) -> Column:
    """4 equal, 3 one begins with the other (of four characters or more), 2 contained, 1 same beginning and two edits at most, else 0."""
    return (
        F.when((F.length(stem) < 3) | (F.length(label) < 3), 0)
        .when(stem == label, 4)
        .when((F.length(stem) >= 4) & F.startswith(label, stem), 3)
        .when((F.length(label) >= 4) & F.startswith(stem, label), 3)
        .when((F.length(stem) >= 4) & F.contains(label, stem), 2)
        .when((F.substring(stem, 1, 3) == F.substring(label, 1, 3)) & (F.levenshtein(stem, label, 2) >= 0), 1)
        .otherwise(0)
    )


def stems(q: Column) -> Column:
    """Product words of a query: Latin words of three characters and more without closing digits and signs."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(q, F.lit(""))), F.lit("([a-z][a-z0-9+#]*)"), F.lit(1)), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, "[0-9]+$", ""), "[.+#-]", "")), lambda s: F.length(s) >= 3))


def alias(q: Column, hosts: list[str] | None = None) -> Column:
    """The host of the first product alias in the query, null without one."""
    out = F.lit(None).cast("string")
    for name, host in reversed(OFFICIAL_ALIASES):
        if host in (AUTHORITY_HOSTS if hosts is None else hosts):
            out = F.when(F.contains(F.lower(q) if name.isascii() else q, F.lit(name)), host).otherwise(out)
    return out


def inferred(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """``query_id``, ``domain``, ``score`` of the best match of each query that has one.

    The rule table is fixed and small: its labels are broadcast. A host of three labels whose first is the
    very product scores 5; ties go to the shorter label, then to the order of the rules.
    """
    stop = F.array(*[F.lit(x) for x in LABEL_STOP])
    r = clean_rules(rules).where("action = 'authority'").groupBy(F.col("domain").alias("dom")).agg(F.min("ord").alias("ord"))
    labels = r.withColumn("parts", F.split("dom", r"\.")).select("dom", "ord", "parts", F.explode("parts").alias("label")).where((F.length("label") >= 3) & ~F.array_contains(stop, F.col("label")))
    own = queries.select("query_id", F.explode(stems(F.col("q"))).alias("stem"))
    first = F.get("parts", F.lit(0))
    hosted = ~F.array_contains(stop, first) & (F.size("parts") >= 3) & (F.col("stem") == first)
    m = own.crossJoin(bounded(labels)).withColumn("score", F.when(hosted, 5).otherwise(label_score(F.col("stem"), F.col("label")))).where("score > 0")
    order = F.struct(-F.col("score"), F.when(F.col("score") == 5, 0).otherwise(F.length("label")), F.col("ord"))
    return m.groupBy("query_id").agg(F.min_by("dom", order).alias("domain"), F.max("score").alias("score"))


def docs_query(q: Column, domain: Column) -> Column:
    """Three product words at most that spell the host, and words that ask for documentation; else the query itself."""
    stop = F.array(*[F.lit(x) for x in LABEL_STOP])
    labels = F.filter(F.split(domain, r"\."), lambda s: (F.length(s) >= 3) & ~F.array_contains(stop, s))
    bare = lambda w: F.regexp_replace(F.regexp_replace(w, "[0-9]+$", ""), "[.+#-]", "")
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(q), F.lit("([a-z][a-z0-9+#]*)"), F.lit(1)), lambda w: F.exists(labels, lambda s: label_score(bare(w), s) > 0)))
    return F.when(F.size(words) > 0, F.concat(F.array_join(F.slice(words, 1, 3), " "), F.lit(" reference guide documentation"))).otherwise(q)
