r"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

Each rule has a regular expression over `host + path` and the literal tokens that any URL it fits
must have. Over the URLs at hand, the tokens of all rules are counted (one aggregation
of a row for each token of a rule), and each rule is entered in the index under its rarest one. A URL's
tokens then fetch candidate rules, and only these run their expressions. Of the rules that
fit, the longest wins; of equally long ones, a block before an allow, then by text. A URL that
no host-and-path rule fits gets the verdict of the pattern rules, and `allow` if none of them fits either.

The index is a literal of the plan: an array of `SLOTS` buckets by the token's hash, each a list of
(token, rule). Looking up is an array access in the row, without shuffle, whatever
the skew of hosts. More than `MAX_RULES` rules become several such literals, looked up in one pass.

Defined cases: a null URL or one without `://` has empty host and path, no rule, and is allowed;
repeated URLs are judged alike; other columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Rules in one literal of the plan; this keeps it below a few MB.
MAX_RULES = 20_000
SLOTS = 1024


@dataclass(frozen=True)
class Rule:
    """verdict for what `pattern` finds in host + path; `name` is reported, if not empty."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    name: str = ""
    length: int = 0


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the URL's path starts with `path`."""
    host = host.lower()
    # The last part of a path without a final slash may go on in the URL: it is no whole token.
    whole = path if path.endswith("/") else path[: len(path) - len(re.search(r"[A-Za-z0-9]*$", path)[0])]
    found = re.findall(r"[a-z0-9]+", f"{host}/{whole.lower()}")
    text = f"{host}{path}"
    quoted = re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)
    return Rule(verdict, rf"^(?:[^/]*\.)?{quoted}", tuple(found), text, len(text))


def pattern_rule(verdict: str, pattern: str, tokens: Sequence[str]) -> Rule:
    """An expression over host + path; each of `tokens` must be a whole word of any URL that it fits."""
    return Rule(verdict, pattern, tuple(tokens))


RULES = (
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
)
#: The method's own rules, for URLs that no host-and-path rule fits.
PATTERNS = (
    pattern_rule("block", r"^(?:[^/]*[.-])?spam(?:[.-][^/]*)?(?:/|$)", ["spam"]),
    pattern_rule("block", r"^(?:[^/]*[.-])?pills(?:[.-][^/]*)?(?:/|$)", ["pills"]),
    pattern_rule("block", r"^(?:[^/]*[.-])?casino(?:[.-][^/]*)?(?:/|$)", ["casino"]),
    pattern_rule("block", r"^(?:[^/]*\.)?[^/.]*-farm\.", ["farm"]),
)


def _lower(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: str) -> Column:
    return _lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def _rest(url: str) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(F.col(url), "://")
    return F.coalesce(F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))), F.lit(""))


def path_of(url: str) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(urls: DataFrame, rules: Sequence[Rule], target: str) -> Column:
    """Buckets of (token, rule), as a literal; each rule under the token that fewest URLs have."""
    wanted = sorted({t for r in rules for t in r.tokens})
    got = (
        urls.select(F.explode(F.array_intersect(tokens_of(F.col(target)), F.lit(wanted))).alias("token"))
        .groupBy("token").count().collect()  # a row for each token of a rule at most
    ) if wanted else []
    often = {r["token"]: r["count"] for r in got}
    entries = [{"token": min(r.tokens, key=lambda t: (often.get(t, 0), t)) if r.tokens else "", "rule": r} for r in rules]
    plain = [
        {"token": e["token"], "pattern": e["rule"].pattern, "verdict": e["rule"].verdict, "name": e["rule"].name,
         "length": e["rule"].length}
        for e in entries
    ]
    schema = "array<struct<token:string,pattern:string,verdict:string,name:string,length:int>>"
    flat = F.from_json(F.lit(json.dumps(plain)), schema)
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.filter(flat, lambda e: _slot(e["token"]) == i)
    )
    # One row on the driver turns the list into buckets; the plan gets them as a literal.
    made = urls.sparkSession.range(1).select(F.to_json(slots).alias("x")).first()["x"]
    return F.from_json(F.lit(made), f"array<{schema}>")


def _slot(token: Column) -> Column:
    return F.pmod(F.hash(token), F.lit(SLOTS))


def _looked_up(index: Column):
    """token -> the rules that the index has for it."""
    return lambda t: F.filter(F.element_at(index, _slot(t) + 1), lambda e: e["token"] == t)


def judge(urls: DataFrame, rules: Sequence[Rule] = RULES, patterns: Sequence[Rule] = PATTERNS, url_col: str = "url") -> DataFrame:
    """urls with host, path, rule and verdict."""
    both = [*rules, *patterns]
    out = urls.withColumn("_host", host_of(url_col)).withColumn("_path", path_of(url_col))
    out = out.withColumn("_target", F.concat("_host", "_path"))
    words = F.concat(tokens_of(F.col("_target")), F.array(F.lit("")))
    names = []
    for k in range(0, max(1, len(both)), MAX_RULES):
        index = rule_index(out, both[k : k + MAX_RULES], "_target")
        fetched = F.flatten(F.transform(words, _looked_up(index)))
        names.append(f"_fits{k}")
        out = out.withColumn(names[-1], F.filter(fetched, lambda e: F.regexp_like(F.col("_target"), e["pattern"])))
    out = out.withColumn("_fits", F.concat(*names))
    # The longest first, then block before allow, then by name.
    ranked = F.array_sort(
        F.transform(
            F.col("_fits"),
            lambda e: F.struct((-e["length"]).alias("o"), (e["verdict"] == "allow").alias("a"), e["name"].alias("n"), e["verdict"].alias("v")),
        )
    )
    out = out.withColumn("_best", F.get(ranked, F.lit(0)))
    names = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(
        *names,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_best.n") != "", F.col("_best.n")).alias("rule"),
        F.coalesce(F.col("_best.v"), F.lit("allow")).alias("verdict"),
    )


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


OP4_SQL = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
), rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host || path, '^([^/]*[.-])?(spam|pills|casino)([.-][^/]*)?(/|$)')
                                OR regexp_matches(host || path, '^([^/]*\.)?[^/.]*-farm\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""
