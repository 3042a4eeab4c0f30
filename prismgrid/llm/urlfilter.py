"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a pattern in the customary filter syntax: ``||`` anchors at a domain label, ``|`` at an end, ``*`` is any
text, ``^`` a separator or the end, and the rest is literal. From every rule one token (a run of a-z and 0-9 that
the pattern bounds on both sides) goes into the index: the one that the fewest rules hold. The tokens of a url
fetch candidate rules by an equi-join, and only those run their regular expression. Rules without a bounded token
are few and are tried on every url.

Site rules (host, path) are judged first: the longest that fits wins. A url that no site rule fits gets the verdict
of the longest pattern rule that fits, else ``DEFAULT``.

Defined results: null urls and urls without "://" have an empty host and path and are blocked by the method; the
host keeps port and user as written; tokens and patterns compare without case, site paths with; equal lengths are
decided by the rule's text, then by the verdict (block first); repeated rows and null keys are judged each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "allow"
#: Rules broadcast at most; more are joined by shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class UrlRule:
    """A site rule has ``host`` and ``path``; any other has ``pattern`` alone."""

    action: str
    host: str | None = None
    path: str = ""
    pattern: str = ""

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}" if self.host is not None else self.pattern

    @property
    def regex(self) -> str:
        """Over ``host`` + "#" + ``path`` for site rules (a host has no "#"), over the lower-cased url for others."""
        if self.host is not None:
            return rf"^(?:[^#]*\.)?{re.escape(self.host.lower())}#{re.escape(self.path)}"
        body, p = "", self.pattern.lower()
        if p.startswith("||"):
            body, p = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*[.@])?", p[2:]
        elif p.startswith("|"):
            body, p = "^", p[1:]
        end, p = ("$", p[:-1]) if p.endswith("|") else ("", p)
        return "(?s)" + body + "".join(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in p) + end

    def tokens(self) -> list[str]:
        """Tokens that every matching url has as whole tokens."""
        if self.host is not None:
            shown = f".{self.host.lower()}/" if self.host else ""
            path = re.findall(r"(?<![a-z0-9])[a-z0-9]+(?=[^a-z0-9])", self.path.lower()) if self.path[:1] == "/" else []
            return re.findall(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", shown) + path
        p = self.pattern.lower()
        p = ("." + p[2:] if p.startswith("||") else "^" + p[1:] if p.startswith("|") else "*" + p)
        p = p[:-1] + "^" if p.endswith("|") else p + "*"
        return re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", p)


#: The contract's site rules.
SITE_RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
#: The method's own rules, for urls that no site rule fits.
PATTERN_RULES = (
    UrlRule("block", pattern="/login^"),
    UrlRule("block", pattern="/logout^"),
    UrlRule("block", pattern="/signup^"),
    UrlRule("block", pattern="/wp-admin/"),
    UrlRule("block", pattern="/cgi-bin/"),
    UrlRule("block", pattern="/shopping/cart^"),
    UrlRule("block", pattern="||doubleclick.net^"),
    UrlRule("block", pattern="||googlesyndication.com^"),
    UrlRule("block", pattern=".exe|"),
    UrlRule("block", pattern=".zip|"),
    UrlRule("block", pattern="sessionid="),
)


def host_of(url: Column) -> Column:
    """After the first "://", up to "/", "?", "#" or the end; A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def compile_rules(rules: tuple[UrlRule, ...]) -> list[tuple]:
    """(token or null, regex, site?, length, name, action): each rule under its rarest token."""
    held = Counter(t for r in rules for t in set(r.tokens()))
    out = []
    for r in rules:
        token = min(r.tokens(), key=lambda t: (held[t], -len(t), t), default=None)
        out.append((token, r.regex, r.host is not None, len(r.name), r.name, r.action))
    return out


def rule_table(spark: SparkSession, rules: tuple[UrlRule, ...]) -> DataFrame:
    return spark.createDataFrame(compile_rules(rules), "token string, regex string, site boolean, size int, name string, action string")


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = SITE_RULES + PATTERN_RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """Every page's host, path, the site rule that fits, if any, the pattern rule otherwise, and the verdict.

    Only key and url are read. Urls become tokens where they are, candidates are found by broadcast (a rule table
    within BROADCAST_RULES; a larger one by shuffle on the token), and a page's candidates are reduced before the
    one shuffle, by row, so no url or host is a hot key.
    """
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    bounded = F.broadcast(table) if len(rules) <= BROADCAST_RULES else table
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(url).alias("u"))
    rows = rows.select("row", "k", F.lower(F.coalesce("u", F.lit(""))).alias("low"), host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    tokens = F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), F.lit(0)))
    asked = F.concat(F.array(F.lit("")), tokens)  # the empty token fetches the rules that have none
    spread = rows.withColumn("token", F.explode(asked))
    met = spread.join(bounded.withColumn("token", F.coalesce("token", F.lit(""))), "token", "left")
    subject = F.when(F.col("site"), F.concat("host", F.lit("#"), "path")).otherwise(F.col("low"))
    fits = F.col("regex").isNotNull() & F.regexp(subject, F.col("regex")) & (F.col("host") != "")
    best = F.struct(F.col("site").alias("site"), F.col("size").alias("size"), F.col("name").alias("name"), F.col("action").alias("action"))
    found = met.groupBy("row", "k", "host", "path").agg(F.max(F.when(fits, best)).alias("best"))
    site = F.coalesce(F.col("best.site"), F.lit(False))
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("host") == "", F.lit("block")).otherwise(F.lit(DEFAULT)))
    return found.select(F.col("k").alias(key), "host", "path", F.when(site, F.col("best.name")).alias("rule"), verdict.alias("verdict"), F.when(~site, F.col("best.name")).alias("pattern"))


def keep_allowed(pages: DataFrame, rules: tuple[UrlRule, ...] = SITE_RULES + PATTERN_RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """The pages, all columns kept, whose key has no blocked url."""
    blocked = judge(pages, rules, key, url).where("verdict = 'block'").select(F.col(key).alias("__k")).distinct()
    return pages.join(blocked, pages[key].eqNullSafe(blocked["__k"]), "left_anti")
