"""URL filters: host and path rules, whose blocks reach every address that redirects or canonical links make equivalent.

An address is a url without scheme and fragment: lower-case host, path and query. Canonical links (`<link rel=canonical>`),
immediate redirects (`<meta http-equiv=refresh>`) and rows of a redirect log are edges between addresses; connected
components of these edges are classes of aliases. A url's own rule decides first, so an explicit allow holds against any
blocked alias. A url without a rule is blocked if an alias has a block rule, be it a page of the table or only named by a
link, and allowed otherwise.

Rules are a table and are joined by host suffix and path prefix, never compared one by one with each url.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.components import components
from barspark.llm.storage import attached, discard, saved

#: The rules of the query, host and path, longest match first in force.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """host (A-Z lower-cased), path, and path with query of a url; all empty for null or where `://` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """rule, verdict of the given rules as a table."""
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def ruled(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of the distinct (host, path) that some rule fits.

    A rule `host/path` fits its host and all subdomains where the path starts with the rule's. The longest rule wins; of equal
    length, the one with the longer host, then allow. A url looks up the suffixes of its host that have rules and the
    prefixes of its path that are as long as a rule's of that host, so a host with many rules costs no more look-ups than they have lengths.
    """
    cut = F.instr("rule", "/")
    table = rules.select("rule", "verdict", F.translate(F.substr("rule", F.lit(1), cut - 1), _UPPER, _LOWER).alias("suffix"), F.substr("rule", cut).alias("prefix"))
    best = table.groupBy("suffix", "prefix").agg(F.min("verdict").alias("verdict"), F.min("rule").alias("rule"))
    lengths = best.groupBy("suffix").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    tried = attached(addresses.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix")), lengths, ["suffix"])
    tried = tried.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    tried = tried.select("host", "path", "suffix", F.substr("path", F.lit(1), F.col("n")).alias("prefix"))
    order = F.struct(
        (F.length("suffix") + F.length("prefix")).alias("n"), F.length("suffix").alias("h"), (F.col("verdict") == "allow").alias("a"), "rule", "verdict"
    )
    found = attached(tried, best, ["suffix", "prefix"]).groupBy("host", "path").agg(F.max(order).alias("_b"))
    return found.select("host", "path", "_b.rule", "_b.verdict")


class _Links(HTMLParser):
    """Targets of canonical links and of redirects in the markup; comments and scripts have none."""

    def __init__(self) -> None:
        super().__init__()
        self.base, self.found = None, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        has = {k: v or "" for k, v in reversed(attrs)}
        if tag == "base" and self.base is None and has.get("href"):
            self.base = has["href"]
        elif tag == "link" and "canonical" in has.get("rel", "").lower().split() and has.get("href", "").strip():
            self.found.append(has["href"].strip())
        elif tag == "meta" and has.get("http-equiv", "").strip().lower() == "refresh":
            m = re.match(r"\s*[\d.]*\s*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"']+)", has.get("content", ""), re.IGNORECASE)
            if m and m[1].strip():
                self.found.append(m[1].strip())


def _targets(url: str, html: str) -> list[str]:
    links = _Links()
    links.feed(html)
    links.close()
    out = []
    for target in links.found:
        try:
            out.append(urljoin(urljoin(url, links.base or ""), target))
        except ValueError:  # no address, such as an unclosed [ in a host
            continue
    return out


def page_links(pages: DataFrame) -> DataFrame:
    """from_url, to_url of the canonical links and immediate redirects in html, relative ones resolved.

    Only pages with a link tag or an http-equiv attribute go to Python, a batch at a time.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(u, t) for u, h in zip(batch["url"], batch["html"], strict=True) for t in _targets(u, h)]
            yield pd.DataFrame(pairs, columns=["from_url", "to_url"])

    hinted = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)<link[\s/]|http-equiv")).select("url", "html")
    return hinted.mapInPandas(read, "from_url string, to_url string")


def judged(pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_of of each row of pages (page_id, url, html).

    redirects (from_url, to_url) is a log that adds edges to those in the pages' html. rules (rule, verdict) are RULES where
    not given. verdict is the rule's; without one it is block if an alias has a block rule, else allow. alias_of is the least
    address of the url's class of aliases; null where it has no link.

    A null url or one without `://` has empty host and path, no rule and no alias: allowed. Urls that differ in scheme or
    fragment only are one address. A null html has no links. Repeated rows stay as many rows as they are and agree; other columns are
    ignored; an empty table gives an empty result. Very long urls and pages are read whole.
    """
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select("from_url", "to_url"))

    def address(url: Column) -> Column:
        host, _, rest = address_parts(url)
        return F.when(F.instr(url, "://") > 0, F.concat(host, rest))

    edges = saved(links.select(address(F.col("from_url")).alias("u"), address(F.col("to_url")).alias("v")).where("u <> v"), "url-links")
    classes = saved(components(edges), "url-classes")
    discard(edges)
    host, path, _ = address_parts(F.col("url"))
    narrow = saved(pages.select("page_id", host.alias("host"), path.alias("path"), address(F.col("url")).alias("address")), "url-pages")
    # An address starts with its host and goes on with its path, so a link's target can be judged without a page.
    parts = (F.regexp_extract("vertex", r"^[^/?]*", 0).alias("host"), F.regexp_extract("vertex", r"^[^/?]*([^?]*)", 1).alias("path"))
    members = classes.select("vertex", "root", *parts)
    fits = saved(ruled(narrow.select("host", "path").union(members.select("host", "path")), rules), "url-ruled")
    blocks = fits.where("verdict = 'block'").select("host", "path")
    blocked = members.join(blocks, ["host", "path"]).select("root").distinct().withColumn("_blocked", F.lit(True))
    aliases = saved(classes.join(blocked, "root", "left").select(F.col("vertex").alias("address"), F.col("root").alias("alias_of"), "_blocked"), "url-aliases")
    discard(classes)
    whole = attached(attached(narrow, fits, ["host", "path"], "left"), aliases, ["address"], "left")
    verdict = F.coalesce("verdict", F.when(F.col("_blocked"), F.lit("block")), F.lit("allow"))
    return whole.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alias_of")


def op13_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judged() of all pages by RULES and the links in their html. Nulls, ties, repeated rows and empty tables as there."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
