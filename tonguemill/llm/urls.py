"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch candidate rules and only those run their regular expression."""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.llm.common import UPPER, LOWER, ascii_lower, table


@dataclass(frozen=True)
class UrlRule:
    """A rule runs `pattern` (a Java regular expression) on host followed by path.

    `tokens` are ASCII words that every match holds whole, in lower case; a rule needs one at least. A base rule outranks the
    method's patterns, and the longest base rule outranks the others.
    """

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    base: bool = False


def host_rule(action: str, host: str, path: str) -> UrlRule:
    """Fits the host with all its subdomains where the URL's path starts with `path`."""
    whole = re.findall("[a-z0-9]+", host) + re.findall("(?<![^/])[a-z0-9]+(?=[^a-z0-9A-Z])", path)
    escape = lambda s: re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)
    return UrlRule(host + path, action, rf"\A(?:[^/]*\.)?{escape(host)}{escape(path)}", tuple(whole), base=True)


# The contract's rules.
BASE_RULES = (
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
)
def word_rule(words: str) -> UrlRule:
    """Blocks hosts in which the words, joined by hyphens, stand whole."""
    return UrlRule(words, "block", rf"\A[^/]*\b{words}\b[^/]*", tuple(words.split("-")))


#: The method's own block list: unwanted kinds of site, by words of the host. A real list is given to judge_urls as `rules`.
PATTERN_RULES = tuple(map(word_rule, ("casino", "free-bets", "cheap-pills", "spam-farm", "ads-track")))


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"\A(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(key: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(key, UPPER, LOWER), F.lit("([a-z0-9]+)"), F.lit(1)))


#: Bytes of a rule list up to which its index is a constant of the plan; longer lists are joined as a table.
INDEX_BYTES = 8 << 20
RULE = "struct<length:int,name:string,action:string,base:boolean,pattern:string>"


def token_counts(urls: DataFrame, rules: tuple[UrlRule, ...]) -> dict[str, int]:
    """URLs that hold each token of the rules. As many rows as the rules have tokens reach the driver."""
    words = sorted({t for r in rules for t in r.tokens})
    listed = urls.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(words)), "array<string>")).alias("token"))
    held = urls.select(F.explode(url_tokens(F.col("key"))).alias("token")).join(listed, "token", "left_semi")
    return {w: 0 for w in words} | {r.token: r.n for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def by_rarest(rules: tuple[UrlRule, ...], counts: dict[str, int]) -> dict[str, list[dict]]:
    """Rules by their rarest token."""
    out: dict[str, list[dict]] = {}
    for r in rules:
        told = {"length": len(r.name), "name": r.name, "action": r.action, "base": r.base, "pattern": r.pattern}
        out.setdefault(min(r.tokens, key=lambda t: (counts[t], t)), []).append(told)
    return out


def rule_index(listed: dict[str, list[dict]]) -> tuple[str, int]:
    """JSON of buckets of (token, rules) by crc32 of the token, and how many buckets."""
    n = 1 << max(2, len(listed)).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for token, own in sorted(listed.items()):
        buckets[zlib.crc32(token.encode()) % n].append({"token": token, "rules": own})
    return json.dumps(buckets), n


def _fetched(keyed: DataFrame, listed: dict[str, list[dict]], most: int) -> DataFrame:
    """keyed (key, ...) with __fits, the rules whose pattern fits among those that its tokens fetch."""
    index, n = rule_index(listed)
    fitting = lambda rules, key: F.filter(rules, lambda r: F.rlike(key, r["pattern"]))
    if len(index) <= most:
        table_ = F.from_json(F.lit(index), f"array<array<struct<token:string,rules:array<{RULE}>>>>")  # folded to a constant

        def fetch(token: Column) -> Column:
            bucket = F.element_at(table_, (F.crc32(token) % n + 1).cast("int"))
            return F.flatten(F.transform(F.filter(bucket, lambda e: e["token"] == token), lambda e: e["rules"]))

        return keyed.withColumn("__fits", fitting(F.flatten(F.transform(url_tokens(F.col("key")), fetch)), F.col("key")))
    spark, names = keyed.sparkSession, list(listed)
    rows = [(t, [(r["length"], r["name"], r["action"], r["base"], r["pattern"]) for r in listed[t]]) for t in names]
    rules = spark.createDataFrame(rows, f"token string, rules array<{RULE}>")
    tokens = keyed.select("key").distinct().select("key", F.explode(url_tokens(F.col("key"))).alias("token"))
    met = tokens.join(rules, "token").select("key", F.explode(fitting(F.col("rules"), F.col("key"))).alias("r"))
    fits = met.groupBy("key").agg(F.collect_list("r").alias("__fits"))
    return keyed.join(fits, "key", "left").withColumn("__fits", F.coalesce("__fits", F.array().cast(f"array<{RULE}>")))


def judge_urls(pages: DataFrame, url_col: str = "url", rules: tuple[UrlRule, ...] = BASE_RULES + PATTERN_RULES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """pages with host, path, rule (the base rule that decided, else null), verdict and method_rules (names of the patterns that fit).

    Up to index_bytes the index is a constant and each URL looks up its tokens: no shuffle over pages. A longer list is a table that the
    tokens of distinct URLs are joined with. Null URLs and URLs without `://` have an empty host and path, fit no rule and are
    allowed. Of base rules of one length that fit, the last by name decides. Repeated rows are judged each, very long URLs whole; an
    empty table gives none. Columns of the input with the result's names are replaced.
    """
    keyed = pages.withColumn("host", url_host(F.col(url_col))).withColumn("path", url_path(F.col(url_col)))
    keyed = keyed.withColumnRenamed("key", "__key").withColumn("key", F.concat("host", "path"))
    out = _fetched(keyed, by_rarest(rules, token_counts(keyed.select("key"), rules)), index_bytes).drop("key").withColumnRenamed("__key", "key")
    best = F.array_max(F.filter("__fits", lambda r: r["base"]))
    own = F.filter("__fits", lambda r: ~r["base"])
    blocked = F.exists(own, lambda r: r["action"] == "block")
    return (
        out.withColumn("rule", best["name"])
        .withColumn("verdict", F.coalesce(best["action"], F.when(blocked, "block").otherwise("allow")))
        .withColumn("method_rules", F.array_sort(F.transform(own, lambda r: r["name"])))
        .drop("__fits")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM cut)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '\\b(casino|free-bets|cheap-pills|spam-farm|ads-track)\\b') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
