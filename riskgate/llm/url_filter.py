"""URL filters: host and path rules first, then a list of canonical URLs.

The list is looked up in two steps. A blocked Bloom filter of it (bloom.py, bounded in
size, so always broadcast) lets possible hits pass; an exact hash join with the list
then removes the false positives. All steps are DataFrame expressions.

Defined results: a null URL, or one without `://`, has an empty host and path, fits
no rule, and is never on the list; null list entries are ignored, repeated ones count
once; repeated rows are judged alike. Equal canonical URLs are looked up in one join
whose large side Spark may split when one URL holds many rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgate.llm.bloom import blocked_bloom, may_contain

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """A host with the start of a path: it fits the host and all its subdomains."""
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.` and default port, path without index page or final slash,
    query without tracking parameters, no scheme and no fragment; null without host."""
    host = F.regexp_replace(url_host(url), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(url_path(url), r"/(?:index\.html?)?$", "")
    query = F.coalesce(F.regexp_extract(url, r"://[^/?#]*[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(F.regexp_replace(query, r"(?:^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*", ""), r"^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, r.text).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, key: str = "page_id",
                url: str = "url") -> DataFrame:
    """Per row: key, host, path, rule, verdict, canonical URL and whether the list was
    asked (`checked`: the Bloom filter let it pass) and holds it (`listed`).
    `listed` has one column of canonical URLs; they are blocked, others allowed."""
    names = listed.columns
    entries = listed.select(F.col(names[0]).alias("entry")).where(F.col("entry").isNotNull()).distinct()
    bloom = blocked_bloom(entries, "entry", entries.count())
    base = pages.select(F.col(key), F.col(url).alias("url"))
    base = base.select(key, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                       canonical(F.col("url")).alias("canonical"))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    base = base.select("*", rule.alias("rule"), verdict.alias("ruled"))
    probe = may_contain(base, "canonical", bloom, "passes") \
        .withColumn("checked", F.col("passes") & F.col("rule").isNull()).drop("passes")
    found = probe.where("checked").join(entries.withColumn("listed", F.lit(True)),
                                        F.col("canonical") == F.col("entry"), "left").drop("entry")
    rest = probe.where("not checked").withColumn("listed", F.lit(False))
    both = rest.unionByName(found.withColumn("listed", F.coalesce("listed", F.lit(False))))
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select(key, "host", "path", "rule", verdict.alias("verdict"), "canonical", "checked", "listed")
