"""URL filters: a trie over reversed host labels, then path segments, sent to every task.

The most specific rule decides: the longest host and path together, then the longest host, then
block before allow. The trie is broadcast while the rules number at most ``MOST_RULES``; more of
them are joined by their (host, path) keys instead, each url exploded into the hosts and path
beginnings that could hold a rule.

Null urls, and urls without ``://``, have an empty host and path, which no rule fits. Ports and
user names stay part of the host. Each input row gives one result row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 200_000
Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parse_rule(text: str) -> Rule:
    """'block example.com/en/' as (verdict, host, path)."""
    verdict, place = text.split(" ", 1)
    host, slash, path = place.partition("/")
    return verdict, host.lower(), slash + path


def _segments(path: str) -> list[str]:
    """'/en/a' as ['/', 'en/', 'a']: what ends in a slash is a whole segment, the rest a beginning."""
    parts = path.split("/")
    return [p + "/" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


class Trie:
    """Children by label or segment; ``ends`` holds verdicts at a node, ``starts`` the rules that
    end inside a segment. Labels are under ('h', label), segments under ('p', segment)."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("h", label), {})
            parts = _segments(path)
            open_end = parts.pop() if parts and not parts[-1].endswith("/") else None
            for part in parts:
                node = node.setdefault(("p", part), {})
            kept = node.setdefault("starts", {}) if open_end else node
            key = open_end or "ends"
            if kept.get(key, ("allow",))[0] != "block":
                kept[key] = (verdict, host, path)

    def match(self, host: str, path: str) -> Rule | None:
        best: tuple[tuple, Rule] | None = None

        def offer(rule: Rule) -> None:
            nonlocal best
            rank = (len(rule[1]) + len(rule[2]), len(rule[1]), rule[0] == "block")
            if best is None or rank > best[0]:
                best = (rank, rule)

        parts, node = _segments(path), self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.get(("h", label))
            if node is None:
                break
            inner = node
            if "ends" in inner:
                offer(inner["ends"])
            for i, part in enumerate([*parts, None]):
                for start, rule in inner.get("starts", {}).items():
                    if part is not None and part.startswith(start):
                        offer(rule)
                inner = inner.get(("p", part)) if part is not None else None
                if inner is None:
                    break
                if "ends" in inner:
                    offer(inner["ends"])
        return best and best[1]


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """page_id, host, path, rule (like 'net/', null if none fits), verdict."""
    placed = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if len(rules) > most_rules:
        return _judge_by_join(placed, rules, default)
    trie = placed.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def matched(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = [trie.value.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r and r[1] + r[2] for r in found], "verdict": [r[0] if r else default for r in found]}, dtype=object)

    return placed.withColumn("m", matched("host", "path")).select("page_id", "host", "path", "m.rule", "m.verdict")


def _judge_by_join(placed: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same without a broadcast: an equi-join on every (host suffix, path beginning) of a url
    that has the length of some rule's path; the best rule of a row by one aggregation."""
    spark = placed.sparkSession
    table = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string").distinct()
    lengths = F.array(*[F.lit(n) for n in sorted({len(r[2]) for r in rules})])
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    begins = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    keyed = placed.withColumn("row", F.monotonically_increasing_id())
    keys = keyed.select("row", F.explode(suffixes).alias("rule_host"), begins.alias("begins")).select("row", "rule_host", F.explode("begins").alias("rule_path"))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), (F.col("verdict") == "block").alias("block"))
    best = keys.join(table, ["rule_host", "rule_path"]).groupBy("row").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("m"))
    return keyed.join(best, "row", "left").select("page_id", "host", "path", "m.rule", F.coalesce("m.verdict", F.lit(default)).alias("verdict"))
