"""Operator 9: URL filters with rules indexed by their rarest literal token.

A rule is a host and path rule or a pattern (a regular expression over the lower-cased url), with the verdict allow or
block. A literal token is a run of letters and digits that any url which fits the rule has as a whole run. Each rule is
filed under that of its tokens which the fewest urls have (counted over all urls). A url's tokens fetch candidate rules
and only these run their regular expression; rules without a token are candidates for every url. Of the host rules that
fit, the longest (host and path together) wins; without one, any blocking pattern blocks, else the url is allowed.

Defined results: the host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased (user names
and ports stay part of it); the path is what then follows up to `?`, `#` or the end. A null url and one without `://`
have empty host and path, fit no host rule, and are allowed unless a pattern blocks them (null: allowed). Urls of any
length are read whole; line breaks are ordinary characters. Of host rules of one length the greater name wins. Repeated rows are
judged alike; an empty table gives an empty result. Other columns pass through; clashing ones give way, also where one of them
is the url column itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name, python_ready

MOST_RULES = 500_000  # a rule list is configuration; its size bounds what is sent to the executors


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    literals: tuple[str, ...] = ()  # for patterns: runs that every fitting url has whole

    @property
    def name(self) -> str:
        return self.host + self.path or self.pattern

    def regexes(self) -> tuple[re.Pattern, ...]:
        """For the lower-cased host and for the path as it is; for patterns one for the lower-cased url."""
        if self.pattern:
            return (re.compile(self.pattern, re.ASCII),)
        return re.compile(rf"(?:\A|\.){re.escape(self.host)}\Z"), re.compile(rf"\A{re.escape(self.path)}")

    def tokens(self) -> list[str]:
        if self.pattern:
            return list(self.literals)
        path = re.findall(r"[a-z0-9]+", self.path.lower())
        if path and re.search(r"[A-Za-z0-9]$", self.path):
            path = path[:-1]  # the url's run may go on
        return re.findall(r"[a-z0-9]+", self.host) + path


#: The rules of the registered query.
HOST_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
PATTERN_RULES = (
    Rule("block", pattern=r"[./-]cheap-pills[./-]", literals=("cheap", "pills")),
    Rule("block", pattern=r"[./-](casino|poker|xxx)[./-]"),
    Rule("block", pattern=r"/(ads|banner)/"),
    Rule("block", pattern=r"[?&]utm_source=spam(&|$)", literals=("utm", "source", "spam")),
)


def host_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def url_tokens(url: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", url.lower()))


def _judge(rules: tuple[Rule, ...], rarity: dict[str, int], url_at: str, keep: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, list] = {}
        always = []
        for r in rules:
            tokens = r.tokens()
            entry = (r, r.regexes())
            if tokens:
                index.setdefault(min(tokens, key=lambda t: (rarity.get(t, 0), t)), []).append(entry)
            else:
                always.append(entry)
        for batch in batches:
            out = []
            for url in batch.column(url_at).to_pylist():
                host, path = host_path(url)
                named, blocked = None, False
                low = (url or "").lower()
                for rule, regexes in [*always, *(e for t in url_tokens(low) if t in index for e in index[t])]:
                    if rule.host:
                        if host and regexes[0].search(host) and regexes[1].search(path) and (named is None or (len(rule.name), rule.name) > (len(named.name), named.name)):
                            named = rule
                    elif not blocked and rule.verdict == "block" and regexes[0].search(low):
                        blocked = True
                out.append((host, path, named.name if named else None, named.verdict if named else "block" if blocked else "allow"))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, pa.string()) for c in cols)], names)

    return run


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = (*HOST_RULES, *PATTERN_RULES), url: str = "url") -> DataFrame:
    """pages with host, path, rule (of the host rule that decides, else null) and verdict."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    python_ready(pages.sparkSession)
    wanted = sorted({t for r in rules for t in r.tokens()})
    runs = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url)), F.lit("[a-z0-9]+"), F.lit(0)))
    counted = pages.select(F.explode(F.array_intersect(runs, F.array(*map(F.lit, wanted)))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    rarity = {r.t: r.n for r in counted.collect()}  # no more rows than the rules have tokens
    new = ["host", "path", "rule", "verdict"]
    keep = [c for c in pages.columns if c.lower() not in new]
    fields = [pages.schema[c].simpleString().split(":", 1)[1] for c in keep]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(keep, fields, strict=True)), *(f"{c} string" for c in new)])
    at = free_name(pages, "_url")
    return pages.select(*(f"`{c}`" for c in keep), F.col(url).alias(at)).mapInArrow(_judge(rules, rarity, at, keep, [*keep, *new]), schema)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, url, host, path, (SELECT arg_max(struct_pack(rule := rhost || rpath, verdict := rverdict), length(rhost || rpath)) FROM r
         WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best FROM h)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN regexp_matches(lower(url), '[./-]cheap-pills[./-]') OR regexp_matches(lower(url), '[./-](casino|poker|xxx)[./-]')
         OR regexp_matches(lower(url), '/(ads|banner)/') OR regexp_matches(lower(url), '[?&]utm_source=spam(&|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""
