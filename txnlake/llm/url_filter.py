"""URL allow/block rules: a trie over reversed host labels, then path segments.

A rule is ``(action, host, path)``.  It fits its host and every subdomain when the
URL's path starts with the rule's path (a character prefix: ``/en/1`` fits
``/en/15``).  Of the fitting rules the longest (host + path characters) wins; between
rules of equal length the deeper host, then ``block`` wins.  No rule: ``default``.

Defined cases: a null URL or one without ``://`` has empty host and path and matches
only rules of the empty host; a URL without a path has the empty path, which a rule
path ``/`` does not fit; an empty rule list gives every row the default; repeated rows
and null ids are judged like any other row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.llm.common import lower_ascii, share, ship

#: Rules up to this many characters in all are broadcast as a trie; longer lists are joined.
MAX_TRIE_CHARS = 32_000_000

RESULT = "rule string, verdict string"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _preference(action: str, host: str, path: str) -> tuple[int, int, bool]:
    return len(host) + len(path), len(host), action == "block"


class Node:
    """A label or segment: children by name, and the rules that end in a part of the next
    segment, as (that part, preference, rule, action)."""

    __slots__ = ("children", "ends", "paths")

    def __init__(self) -> None:
        self.children: dict[str, Node] = {}
        self.ends: list[tuple[str, tuple, str, str]] = []
        self.paths: Node | None = None  # on a host node: the root of its path trie

    def child(self, name: str) -> Node:
        return self.children.setdefault(name, Node())


def build_trie(rules: Iterable[tuple[str, str, str]]) -> Node:
    root = Node()
    for action, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.child(label)
        node.paths = node.paths or Node()
        *whole, part = path.split("/")
        at = node.paths
        for segment in whole:
            at = at.child(segment)
        at.ends.append((part, _preference(action, host, path), host + path, action))
    return root


def match(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """(rule, action) of the preferred fitting rule."""
    best = None
    segments = path.split("/")
    node: Node | None = root
    for label in reversed(host.split(".")):
        node = node.children.get(label)
        if node is None:
            break
        at, depth = node.paths, 0
        while at is not None:
            for part, rank, rule, action in at.ends:
                if segments[depth].startswith(part) and (best is None or rank > best[0]):
                    best = rank, rule, action
            if depth == len(segments) - 1:
                break
            at, depth = at.children.get(segments[depth]), depth + 1
    return best and best[1:]


def _by_trie(df: DataFrame, rules, default: str) -> DataFrame:
    ship(df.sparkSession)
    trie = share(df.sparkSession, build_trie(rules))

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for hosts, paths in batches:
            found = [match(root, h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return df.withColumn("_j", judge("host", "path")).select(
        *df.columns, "_j.rule", "_j.verdict")


def _by_join(df: DataFrame, rules, default: str) -> DataFrame:
    """The same verdicts for a rule list too long to broadcast: every distinct (host, path)
    is expanded to its host suffixes and whole-segment prefixes, which meet the rules in a
    hash join; the rest of the rule's path is checked on the match."""
    spark = df.sparkSession
    rows = [(a, h, p, *p.rpartition("/")[::2], h + p, list(_preference(a, h, p)[:2]))
            for a, h, p in rules]
    table = spark.createDataFrame(
        [(a, h, (d + "/") if "/" in p else "", part, r, n[0], n[1], a == "block")
         for a, h, p, d, part, r, n in rows],
        "action string, r_host string, r_dir string, part string, rule string, "
        "n int, n_host int, block boolean")
    places = df.select("host", "path").distinct()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    keys = places.select(
        "host", "path",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)),
                              lambda i: F.array_join(F.slice(labels, -i, i), "."))).alias("r_host"),
        segments.alias("s")).select(
        "host", "path", "r_host",
        F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.when(
            i > 0, F.concat(F.array_join(F.slice("s", 1, i), "/"), F.lit("/"))).otherwise(
                F.lit("")))).alias("r_dir"))
    best = (keys.join(table, ["r_host", "r_dir"])
            .where(F.substring(F.col("path"), F.length("r_dir") + 1, F.length("part"))
                   == F.col("part"))
            .groupBy("host", "path")
            .agg(F.max_by(F.struct("rule", "action"),
                          F.struct("n", "n_host", "block", "rule")).alias("m")))
    return df.join(best, ["host", "path"], "left").select(
        *df.columns, F.col("m.rule").alias("rule"),
        F.coalesce("m.action", F.lit(default)).alias("verdict"))


def url_verdicts(df: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow",
                 id_col: str = "page_id", url_col: str = "url",
                 max_trie_chars: int = MAX_TRIE_CHARS) -> DataFrame:
    """One row per input row: id, host, path, the winning rule (or null), verdict."""
    parts = df.select(F.col(id_col), host_of(F.col(url_col)).alias("host"),
                      path_of(F.col(url_col)).alias("path"))
    small = sum(len(h) + len(p) for _, h, p in rules) <= max_trie_chars
    return (_by_trie if small else _by_join)(parts, rules, default)
