"""URL filters by a sort-merge range join.

A rule is a host and a path prefix. It fits its host and all subdomains if the url's path starts with the rule's. The
canonical key of a host is its labels in reverse order, each with a dot behind it, so that a rule's host is the interval of
the keys that start with its own key, and hosts nest. Distinct urls and rules are range-partitioned together by (key,
path) and sorted; one sweep through a partition keeps the stack of the hosts with rules whose intervals are open. The path prefixes
of a host are intervals of its paths, which nest in the same way: as a host's rules come in order, each learns which one it
stands in. A url is one row: in each open host, the rule that sorts last before its path and those it stands in are
the only ones that may fit, and the innermost that does wins. A host with
very many urls is spread over partitions by path. The rules that are open where a partition begins belong to parents of its
first key; they are found by an equi-join on these parents and sent to that partition, so no rule passes the driver.

The longest rule wins: by characters of host and path together, then by host. If a rule is given with both verdicts,
block wins. Defined cases: a null url or one without ``://`` has an empty host and path and fits no rule; a rule with
a null host, path or verdict is ignored; repeated urls and rules each give the same answer, also if a third of all rows
have one url; very long urls are rows like others; without rules or urls every row gets the default verdict; other
columns are passed through, but for those named host, path, rule and verdict, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url"):
    """The host (A-Z in lower case) and the path of a url column."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _key(host):
    """com.example.www. for www.example.com"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


_HEAD, _RULE, _URL = 0, 1, 2
_FOUND = "host string, path string, rule string, verdict string"


class _Host:
    """An open host: its rules in the order of paths, each with the number of the rule whose interval it stands in (-1: none)."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.verdicts, self.outer, self.known = key, host, [], [], [], set()

    def add(self, path: str, verdict: str) -> None:
        if path in self.known:  # all rules of a host were sent to this part as open ones, too
            return
        self.known.add(path)
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.outer.append(at)

    def find(self, path: str) -> int:
        """The innermost rule whose interval holds a path, or -1."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return at


def _sweep(batches):
    """The stack sweep over rows (part, key, kind, path, host, verdict) in this order; each part starts with its open rules."""
    part, stack = None, []
    for batch in batches:
        out = []
        for now, key, kind, path, host, verdict in zip(*(c.to_pylist() for c in batch.columns)):
            if now != part:
                part, stack = now, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind != _URL:
                if not stack or stack[-1].key != key:
                    stack.append(_Host(key, host))
                stack[-1].add(path, verdict)
                continue
            best = (-1, -1, None, None)
            for of in stack:
                at = of.find(path)
                if at >= 0:
                    found = of.paths[at]
                    best = max(best, (len(of.host) + len(found), len(of.host), of.host + found, of.verdicts[at]))
            out.append((host, path, best[2], best[3]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(4)], names=["host", "path", "rule", "verdict"])


def matches(urls: DataFrame, rules: DataFrame, parts: int) -> DataFrame:
    """Each distinct (host, path) with a host, with its winning rule and verdict, null if none fits."""
    rules = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = common.cut(rules.select(_key(F.col("host")).alias("key"), F.lit(_RULE).alias("kind"), "path", "host", "verdict"))
    asked = urls.select("host", "path").where("host <> ''").distinct().select(_key(F.col("host")).alias("key"), F.lit(_URL).alias("kind"), "path", "host", F.lit("").alias("verdict"))
    order = ("key", "kind", "path")
    ordered = common.cut(asked.unionByName(rules).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    first = ordered.groupBy("part").agg(F.min("key").alias("first"))
    labels = F.split(F.regexp_replace("first", r"\.$", ""), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    heads = first.select("part", F.explode(parents).alias("key")).join(rules.drop("kind"), "key").withColumn("kind", F.lit(_HEAD))
    whole = ordered.unionByName(heads).select("part", "key", "kind", "path", "host", "verdict")
    return whole.repartition(parts, "part").sortWithinPartitions("part", *order).mapInArrow(_sweep, _FOUND)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", parts: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule (host and path of the winning rule, else null) and verdict."""
    parts = parts or common.shuffle_parts(pages.sparkSession)
    host, path = host_and_path(url)
    known = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    best = common.cut(matches(known, rules, parts))
    found = common.spread_join(known.where("host <> ''"), best, ["host", "path"], parts).withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    names = [*known.columns, "rule", "verdict"]
    without = known.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    return found.select(*names).unionByName(without.select(*names))
