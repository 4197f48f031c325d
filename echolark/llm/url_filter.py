"""Allow and block rules for URLs, held in one trie over reversed host labels and path segments.

A rule is (host, path, verdict). It fits its host and every subdomain of it, for paths that start
with the rule's path, letter by letter. Of the rules that fit, the longest wins: more host labels
first, then the longer path; a block wins a tie. URLs that no rule fits get `default`.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits only rules
with an empty host and path. Ports and user names stay in the host, as the host ends at ``/``,
``?``, ``#`` or the text's end. Repeated rows are judged alike; an empty table gives an empty
result; other columns pass through, and columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import spare

MAX_RULES = 1_000_000

def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def build_trie(rules: Sequence[tuple[str, str, str]]) -> dict:
    """Nested dicts: reversed host labels, then under _PATH whole path segments.

    The last, possibly partial segment of a rule's path is kept in the node as a prefix entry.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules exceed the broadcast bound of {MAX_RULES}")
    root: dict = {"kids": {}, "paths": None}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node["kids"].setdefault(label, {"kids": {}, "paths": None})
        if node["paths"] is None:
            node["paths"] = {"kids": {}, "ends": {}}
        at = node["paths"]
        *whole, partial = path.split("/")
        for segment in whole:
            at = at["kids"].setdefault(segment, {"kids": {}, "ends": {}})
        if at["ends"].get(partial, ("", ""))[1] != "block":
            at["ends"][partial] = (f"{host}{path}", verdict)
    return root


def _longest_path(paths: dict, path: str):
    """The longest rule path that `path` starts with."""
    best, at, segments = None, paths, path.split("/")
    for k, segment in enumerate(segments):
        ends = at["ends"]
        if ends:
            for size in range(len(segment), -1, -1):
                if (hit := ends.get(segment[:size])) is not None:
                    best = hit
                    break
        if k == len(segments) - 1 or (at := at["kids"].get(segment)) is None:
            return best
    return best


def judge(trie: dict, host: str, path: str):
    """(rule, verdict) of the longest fitting rule, or None."""
    best, node = None, trie
    labels = host.split(".")[::-1] if host else []
    for depth in range(len(labels) + 1):
        if node["paths"] is not None:
            best = _longest_path(node["paths"], path) or best
        if depth == len(labels) or (node := node["kids"].get(labels[depth])) is None:
            return best
    return best


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict; no shuffle, the trie is broadcast."""
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def verdicts(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = [judge(trie.value, h, p) or (None, default) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], names=["rule", "verdict"])

    parsed = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    at = spare(parsed, "judged")
    judged = parsed.withColumn(at, verdicts("host", "path"))
    return judged.withColumns({"rule": F.col(f"{at}.rule"), "verdict": F.col(f"{at}.verdict")}).drop(at)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over every row of pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT p.page_id, max_by(struct_pack(rule := rh || rp, v := v), length(rh) * 1000 + length(rp)) AS best
  FROM p JOIN r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.best.rule AS rule, coalesce(m.best.v, 'allow') AS verdict
FROM p LEFT JOIN m USING (page_id)
"""
