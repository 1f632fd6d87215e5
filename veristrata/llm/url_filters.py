r"""URL rules fetched by their rarest literal token.

Each rule has literal tokens (runs of ``[a-z0-9]`` that stand complete in any
url the rule can match).  Token frequencies over all urls decide which of them
is rarest; the rule is filed under that one alone.  A url's own tokens then
fetch candidate rules, and only those run a regular expression.  Rules without
a complete literal token are tried on every url.

Two kinds of rules share the index:

* host rules, ``(action, "host/path")``: the host itself or any subdomain, and
  a path that starts with the rule's path; the longest one wins;
* patterns, consulted when no host rule fits: ``^`` is an edge of an
  alphanumeric run, ``*`` anything; an allow pattern beats block patterns.

Defined results: a null url or one without ``://`` has empty host and path and
the verdict ``allow``; a very long url is read whole; of rules that tie the one listed first counts;
repeated rows are judged alike; an empty table gives an empty result; extra
columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.session import table

#: The host rules that the query applies.
HOST_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
PATTERNS = (
    ("allow", "^health^advice^"),
    ("allow", "/research/*^adult^"),
    ("block", "^pills^"),
    ("block", "^bets^"),
    ("block", "^adult^"),
    ("block", "^casino^"),
    ("block", "^poker^"),
    ("block", "^viagra^"),
    ("block", "^xxx^"),
    ("block", "/ads/*^banner^"),
    ("block", "/wp-login.php"),
)
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    order: int
    action: str
    text: str
    is_host: bool
    regex: str
    tokens: tuple[str, ...]


def host_rule(order: int, action: str, text: str) -> Rule:
    return Rule(order, action, text, True, r"^(?:[^/]*\.)?" + re.escape(text), tuple(_TOKEN.findall(text.lower())) if text.endswith("/") else tuple(_TOKEN.findall(text.lower())[:-1]))


def pattern_rule(order: int, action: str, text: str) -> Rule:
    """Tokens that touch a ``*`` or an unmarked end may be part of a longer run, so they are left out."""
    regex = "".join({"^": "(?:^|$|[^a-z0-9])", "*": ".*"}.get(c, re.escape(c)) for c in text)
    tokens = [m[0] for m in _TOKEN.finditer(text) if m.start() and m.end() < len(text) and text[m.start() - 1] != "*" and text[m.end()] != "*"]
    return Rule(order, action, text, False, "(?s)" + regex, tuple(tokens))


def rules(host_rules=HOST_RULES, patterns=PATTERNS) -> list[Rule]:
    return [host_rule(k, *r) for k, r in enumerate(host_rules)] + [pattern_rule(k, *r) for k, r in enumerate(patterns)]


def split_url(url: str | None) -> tuple[str, str]:
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_UPPER), re.match(r"[^?#]*", rest[len(host) :])[0]


def token_counts(urls: DataFrame, wanted: Iterable[str], url: str = "url") -> dict[str, int]:
    """Occurrences of the rules' tokens in all urls; as many rows as rule tokens reach the driver."""
    found = urls.select(F.explode(F.regexp_extract_all(F.lower(url), F.lit("[a-z0-9]+"), 0)).alias("token"))
    kept = urls.sparkSession.createDataFrame([(t,) for t in sorted(set(wanted))], "token string")
    return {r.token: r.n for r in found.join(F.broadcast(kept), "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


class RuleIndex:
    """Rules filed under their rarest token; those without one are kept apart."""

    def __init__(self, all_rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.always: list = []
        self.runs = 0
        for r in all_rules:
            entry = (r, re.compile(r.regex))
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(entry)
            else:
                self.always.append(entry)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        host, path = split_url(url)
        whole = host + path
        lower = whole.translate(_UPPER)
        best, chosen = None, None
        entries = list(self.always)
        for token in dict.fromkeys(_TOKEN.findall(lower)):
            entries += self.by_token.get(token, ())
        for r, regex in entries:
            self.runs += 1
            if not regex.search(whole if r.is_host else lower):
                continue
            if r.is_host:
                if best is None or len(r.text) > len(best.text):
                    best = r
            elif chosen is None or r.order < chosen.order:
                chosen = r
        verdict = best.action if best else chosen.action if chosen else "allow"
        return host, path, best and best.text, verdict, None if best else chosen and chosen.text


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", all_rules: list[Rule] | None = None) -> DataFrame:
    """``key, host, path, rule, verdict, pattern`` for every row; one pass, no shuffle.

    The index is as large as the rule list, which is a parameter, not data.
    """
    all_rules = rules() if all_rules is None else all_rules
    counts = token_counts(pages, [t for r in all_rules for t in r.tokens], url)

    def judge(batches):
        index = RuleIndex(all_rules, counts)
        for pdf in batches:
            out = pd.DataFrame([index.judge(u if isinstance(u, str) else None) for u in pdf["url"]], columns=["host", "path", "rule", "verdict", "pattern"], dtype=object)
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key), F.col(url).cast("string").alias("url")).mapInPandas(judge, f"{key} {kind}, host string, path string, rule string, verdict string, pattern string")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _case(column: str, those: list[Rule]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{r.regex}') THEN '{r.text}'" for r in those) + " END"


def _sql() -> str:
    hosts = sorted((r for r in rules() if r.is_host), key=lambda r: -len(r.text))
    patterns = [r for r in rules() if not r.is_host]
    allowed = ", ".join(f"'{r.text}'" for r in rules() if r.action == "allow")
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM u
), p AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM s
), j AS (
  SELECT *, {_case("host || path", hosts)} AS rule,
    {_case("translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", patterns)} AS found FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ({allowed}) THEN 'allow' ELSE 'block' END
  WHEN found IS NULL OR found IN ({allowed}) THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN rule IS NULL THEN found END AS pattern FROM j
"""


OP6_SQL = _sql()
