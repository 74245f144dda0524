"""URL filters: a trie over reversed host labels and path segments, longest match wins.

A rule has a host and a path. It fits its host and all subdomains, if the url's path starts with the rule's path.
Of the rules that fit, the one with the most host labels wins, then the one with the longest path; of equal rules
the first in order (verdict block before allow). Urls that no rule fits get the default verdict.

Defined cases: a null url, or one without "://", has host and path "" and gets the default verdict (a rule with an
empty host fits every url, these too). Very long urls are walked once: at each node a segment is looked up once for each
length that the node's rules have. Repeated rows are judged each. Rules may be empty. Columns of the input named host,
path, rule or verdict are replaced, and other names can't clash.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import fresh, map_columns

_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True, order=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def split_url(url: str | None) -> tuple[str, str]:
    start = -1 if url is None else url.find("://")
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_ASCII_LOWER), path


class HostPathTrie:
    """Outer levels: host labels from the last one on. At a host's node: path segments; the last segment of a rule is a prefix."""

    def __init__(self, rules: list[Rule]):
        self.root = _Node()
        for rule in sorted(set(rules), key=lambda r: (r.host, r.path, r.verdict != "block", r.verdict)):
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.children.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            node = node.paths
            if rule.path:
                *whole, last = rule.path.split("/")
                for segment in whole:
                    node = node.children.setdefault(segment, _Node())
            else:
                last = ""
            if last not in node.prefixes:
                node.prefixes[last] = rule
                if len(last) not in node.lengths:
                    insort(node.lengths, len(last))

    def find(self, host: str, path: str) -> Rule | None:
        found, node, segments = None, self.root, None
        labels = host.split(".") if host else []
        for depth in range(len(labels) + 1):
            if node.paths is not None:
                segments = path.split("/") if segments is None else segments
                found = _longest(node.paths, segments) or found
            if depth == len(labels) or (node := node.children.get(labels[-1 - depth])) is None:
                break
        return found


class _Node:
    """lengths: those of the prefixes, ascending."""

    __slots__ = ("children", "paths", "prefixes", "lengths")

    def __init__(self):
        self.children: dict[str, _Node] = {}
        self.paths: _Node | None = None
        self.prefixes: dict[str, Rule] = {}
        self.lengths: list[int] = []


def _longest(node: _Node, segments: list[str]) -> Rule | None:
    found = None
    for segment in segments:
        for i in range(bisect_right(node.lengths, len(segment)) - 1, -1, -1):
            if rule := node.prefixes.get(segment[: node.lengths[i]]):
                found = rule
                break
        if (node := node.children.get(segment)) is None:
            break
    return found


def filter_urls(df: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow", max_trie_rules: int = 200_000) -> DataFrame:
    """df with host, path, rule and verdict.

    Up to max_trie_rules rules (some 100 MB of trie; the size is checked) the trie is broadcast and no row moves.
    Beyond, the distinct urls' (host suffix, path up to a slash) keys are hash-joined with the rules.
    """
    spark = df.sparkSession
    if isinstance(rules, DataFrame):
        if rules.limit(max_trie_rules + 1).count() > max_trie_rules:
            return _by_join(df, rules, url, default)
        rules = [Rule(r.host, r.path, r.verdict) for r in rules.select("host", "path", "verdict").collect()]
    elif len(rules) > max_trie_rules:
        return _by_join(df, spark.createDataFrame([Row(host=r.host, path=r.path, verdict=r.verdict) for r in rules]), url, default)
    trie = spark.sparkContext.broadcast(HostPathTrie(rules))

    def judge(urls: list[str | None]) -> dict[str, list]:
        parts = [split_url(u) for u in urls]
        hits = [trie.value.find(*p) for p in parts]
        return {"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": [r and r.text for r in hits], "verdict": [r.verdict if r else default for r in hits]}

    keep = [c for c in df.columns if c not in {"host", "path", "rule", "verdict"}]
    return map_columns(df, keep, [url], judge, "host string, path string, rule string, verdict string")


def _by_join(df: DataFrame, rules: DataFrame, url: str, default: str) -> DataFrame:
    urls = df.select(F.col(url).alias("u")).distinct()
    parts = urls.withColumn("rest", F.coalesce(F.regexp_extract(F.when(F.instr("u", "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")), r"(?s)^[^?#]*", 0), F.lit("")))
    host = F.translate(F.substring_index("rest", "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.when(F.instr("rest", "/") > 0, F.expr("substring(rest, instr(rest, '/'))")).otherwise("")
    parts = parts.select("u", host.alias("host"), path.alias("path"))
    keys = parts.withColumn("labels", F.split("host", r"\."))
    keys = keys.withColumn("h", F.explode(F.expr("concat(array(''), if(host = '', array(), transform(sequence(1, size(labels)), n -> array_join(slice(labels, -n, n), '.'))))")))
    keys = keys.withColumn("segments", F.split("path", "/")).withColumn("d", F.explode(F.expr("concat(array(''), if(size(segments) < 2, array(), transform(sequence(1, size(segments) - 1), n -> concat(array_join(slice(segments, 1, n), '/'), '/'))))")))
    given = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict").withColumn("d", F.regexp_extract("p", r"(?s)^(.*/)?", 0))
    hits = keys.join(given, ["h", "d"]).where(F.expr("startswith(path, p)"))
    rank = F.struct(F.when(F.col("h") == "", 0).otherwise(F.size(F.split("h", r"\."))), F.length("p"), (F.col("verdict") == "block").cast("int"))
    best = hits.groupBy(F.col("u").alias("hit")).agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), rank).alias("best"))
    judged = parts.join(best, F.col("u").eqNullSafe(F.col("hit")), "left").select("u", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    name = fresh(df, "url__")
    judged = judged.withColumnRenamed("u", name)
    base = df.drop("host", "path", "rule", "verdict")
    return base.join(judged, base[url].eqNullSafe(judged[name]), "left").drop(name)
