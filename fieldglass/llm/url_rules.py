"""URL filters: host rules by the longest fit, pattern rules found by their rarest literal token.

A null URL, or one without ``://``, has an empty host and an empty path, fits no host
rule and is judged by the pattern rules on an empty string, which none fits: it is allowed.
Repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import ascii_lower

TOKEN = re.compile(r"[a-z0-9]+")


class HostRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class PatternRule(NamedTuple):
    """``pattern`` is searched in lower-cased ``host + path``; a URL it fits holds every one of ``tokens``."""

    verdict: str
    tokens: tuple[str, ...]
    pattern: str


HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)

def word_rule(*words: str) -> PatternRule:
    """Blocks URLs with these words in a row, joined by hyphens, as a whole part of a host label or path segment."""
    return PatternRule("block", words, rf"(^|[./-]){'-'.join(words)}([./-]|$)")


#: Families of sites and paths that carry no prose worth training on: gambling, adult, pills and loans, spam, adverts, machinery.
PATTERN_RULES = (
    *(word_rule(*x.split("-")) for x in (
        "casino", "bets", "betting", "sports-betting", "poker", "lottery", "jackpot", "slots",
        "porn", "xxx", "adult", "escorts", "sex-chat", "pills", "viagra", "payday-loans", "replica-watches",
        "spam", "link-farm", "ads", "adserver", "banner-ads", "click-here", "cgi-bin", "wp-admin")),
    PatternRule("block", ("doubleclick",), r"(^|\.)doubleclick\."),
    PatternRule("block", ("wp", "login", "php"), r"/wp-login\.php$"),
    PatternRule("block", ("tracking", "pixel"), r"/tracking[/-]pixel([./-]|$)"),
)


def rest_of_url(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(rest_of_url(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of_url(url), r"^[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """The rule, as a struct, with the longest host and path that fits; ties go to the smaller text."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def rarest_tokens(urls: Column, df: DataFrame, rules: tuple[PatternRule, ...]) -> list[str]:
    """The literal token of each rule that fewest URLs hold, counted over all of ``df``.

    At most one row for each literal of the rules comes to the driver.
    """
    literals = sorted({t for r in rules for t in r.tokens})
    text = ascii_lower(F.concat(host_of(urls), path_of(urls)))
    held = F.array_intersect(F.split(text, "[^a-z0-9]+"), F.array(*[F.lit(t) for t in literals]))
    counts = {r["token"]: r["n"] for r in df.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    return [min(r.tokens, key=lambda t: (counts.get(t, 0), t)) for r in rules]


def pattern_verdict(text: Column, rules: tuple[PatternRule, ...], keys: list[str], default: str = "allow") -> Column:
    """Verdict of the first rule, in the order given, whose pattern fits; only rules fetched by a token are tried."""
    index: dict[str, list[int]] = {}
    for at, key in enumerate(keys):
        index.setdefault(key, []).append(at)
    patterns, verdicts, token = [r.pattern for r in rules], [r.verdict for r in rules], TOKEN.pattern

    @F.pandas_udf("string")
    def judge(texts: pd.Series) -> pd.Series:
        tokens, compiled = re.compile(token), [re.compile(p) for p in patterns]
        out = []
        for x in texts:
            found = sorted({at for t in set(tokens.findall(x)) if t in index for at in index[t]})
            out.append(next((verdicts[at] for at in found if compiled[at].search(x)), default))
        return pd.Series(out, dtype=object)

    return judge(text)


def judge_urls(df: DataFrame, url: str = "url", host_rules: tuple[HostRule, ...] = HOST_RULES, rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict`` in place of columns of those names.

    The rules are configuration (a list in the driver's program), so they travel with the task.
    """
    keys = rarest_tokens(F.col(url), df, rules)
    source = F.col(url)
    parts = df.withColumns({"__host": host_of(source), "__path": path_of(source)})
    parts = parts.withColumn("__fit", host_rule(F.col("__host"), F.col("__path"), host_rules))
    parts = parts.withColumn("__pattern", pattern_verdict(ascii_lower(F.concat("__host", "__path")), rules, keys))
    named = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__fit.rule"), "verdict": F.coalesce(F.col("__fit.verdict"), F.col("__pattern"))}
    return parts.withColumns(named).drop("__host", "__path", "__fit", "__pattern")


def judge_urls_sql(host_rules: tuple[HostRule, ...] = HOST_RULES, rules: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """The same verdicts for the table ``pages`` in SQL, with every pattern tried on every URL."""
    whens = []
    for rule in sorted(host_rules, key=lambda r: (-len(r.text), r.text)):
        whens.append(f"WHEN (host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}') THEN '{rule.text}'")
    verdicts = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in host_rules)
    patterns = " ".join(f"WHEN regexp_matches(low, '{r.pattern}') THEN '{r.verdict}'" for r in rules)
    lower = f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{LOWER_SQL}'"
    return f"""
    WITH cut AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {lower}) AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    fit AS (
      SELECT *, translate(host || path, {lower}) AS low, CASE {' '.join(whens)} END AS rule FROM parts)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END ELSE CASE {patterns} ELSE 'allow' END END AS verdict
    FROM fit"""


LOWER_SQL = "abcdefghijklmnopqrstuvwxyz"
