"""URL filter: a trie over reversed host labels and path segments; the longest fitting entry decides.

An entry has a host, a path and a verdict. It fits its host and all subdomains,
if the URL's path starts with the entry's path. Of the fitting entries the one
with the longest host and path together wins; of equally long ones the one with
more host labels, then ``block``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A list of rules up to this many entries is sent to every task as one trie; a table of rules of any size is joined.
MAX_TRIE_RULES = 1_000_000

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null URL or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _rank(rule: Rule) -> tuple[int, int, bool]:
    host, path, verdict = rule
    return len(host) + len(path), host.count("."), verdict == "block"


def build_trie(rules: Sequence[Rule]) -> dict:
    """Nested nodes: ``kids`` by host label from the right, then ``dirs`` by whole path segment; ``ends`` holds (rest of the path, rule)."""
    root: dict = {"kids": {}, "dirs": {}, "ends": []}
    for rule in rules:
        host, path, _ = rule
        node = root
        for label in reversed(host.split(".")):
            node = node["kids"].setdefault(label, {"kids": {}, "dirs": {}, "ends": []})
        *whole, rest = path.split("/")
        for segment in whole:
            node = node["dirs"].setdefault(segment, {"dirs": {}, "ends": []})
        node["ends"].append((rest, rule))
    return root


def longest_match(trie: dict, host: str, path: str) -> Rule | None:
    """The deciding entry for a host and a path, or None."""
    segments = path.split("/")
    found: list[Rule] = []
    node = trie
    for label in reversed(host.split(".")):
        node = node["kids"].get(label)
        if node is None:
            break
        at = node
        for i, segment in enumerate(segments):
            tail = None
            for rest, rule in at["ends"]:
                if not rest:
                    found.append(rule)
                else:
                    tail = "/".join(segments[i:]) if tail is None else tail
                    if tail.startswith(rest):
                        found.append(rule)
            at = at["dirs"].get(segment) if i + 1 < len(segments) else None
            if at is None:
                break
    return max(found, key=_rank) if found else None


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page, whole table, one row per input row.

    ``rules`` is a list of (host, path, verdict), sent to the tasks as a trie of at
    most ``MAX_TRIE_RULES`` entries, or a table of such rows, which is joined and
    may have any size. A URL that no entry fits gets rule null and ``default``.
    Null URLs and URLs without ``://`` have empty host and path. Repeated rows
    and null page ids are kept; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        return _judge_by_join(parts, rules, default)
    if len(rules) > MAX_TRIE_RULES:
        raise ValueError(f"more than {MAX_TRIE_RULES} rules: pass them as a DataFrame")
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            hits = [longest_match(trie.value, h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(
                {"rule": [h and h[0] + h[1] for h in hits], "verdict": [h[2] if h else default for h in hits]}, dtype="object"
            )

    return parts.withColumn("hit", decide("host", "path")).select("page_id", "host", "path", "hit.rule", "hit.verdict")


def _judge_by_join(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same decision by an equi-join of (host suffix, folder of the path) for rule tables too large to send."""
    folder = lambda c: F.regexp_extract(c, r"(?s)^(.*/)?", 1)
    entries = rules.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"),
        folder(F.col("path")).alias("rule_folder"),
    ).distinct()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    places = parts.select("host", "path").distinct()
    keys = places.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(labels)))).select(
        "host", "path", F.array_join(F.slice(labels, F.col("k"), F.size(labels)), ".").alias("rule_host")
    ).withColumn("k", F.explode(F.sequence(F.lit(0), F.size(segments) - 1))).select(
        "host", "path", "rule_host",
        F.when(F.col("k") == 0, "").otherwise(F.concat(F.array_join(F.slice(segments, F.lit(1), F.col("k")), "/"), F.lit("/"))).alias("rule_folder"),
    )
    fits = keys.join(entries, ["rule_host", "rule_folder"]).where(F.expr("startswith(path, rule_path)"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.size(F.split("rule_host", r"\.")).alias("labels"),
        (F.col("rule_verdict") == "block").alias("block"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"),
    )
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
