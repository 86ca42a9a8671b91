"""URL filters: rules first, then trust and distrust that spread over the links between hosts.

Rules name a host (and so its subdomains) and a path prefix; the longest that fits decides. For other URLs the host
decides: personalised PageRank spreads trust along the links from trusted hosts, and distrust against the links from
blocked ones (who links to a blocked host is suspect); a host is blocked where distrust has at least `threshold` of both.

Seeds come from the rules: a host with more allowed than blocked pages is trusted, one with more than half of its pages
blocked is blocked, each in proportion to its share of such pages. Links are those of the pages' href attributes that
name another host, weighted by how often they occur. The rank of a host without such links goes nowhere. A host that
neither spreads to has no ground to be blocked and is allowed.

Pages are reduced to hosts and pairs of hosts before anything is joined; a host with many pages is combined in the tasks
that read them.

Defined results: a null URL, or one without "://", has empty host and path, fits no rule and is allowed; a null page is
one without links, a very long one is searched whole; repeated rows count as often as they occur; only the three columns
named are read, so that others may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The value of an href attribute in any case, quoted or not, up to white space.
HREF = r"""(?i)[\t\n\f\r "'/]href[\t\n\f\r ]*=[\t\n\f\r ]*["']?[\t\n\f\r ]*([^"'>\t\n\f\r ]*)"""
#: Action, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def after_scheme(url: Column) -> Column:
    """What follows the first "://", null if there is none."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


class Rules:
    """Rules by host; `find` looks up a host and its parents, however many rules there are."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for action, name, prefix in rules:
            self.by_host.setdefault(name, []).append((prefix, action))
        for some in self.by_host.values():
            some.sort(key=lambda r: (-len(r[0]), r))

    def find(self, name: str, place: str) -> tuple[str | None, str | None]:
        """(rule, action) of the longest rule that fits, (None, None) if none does."""
        best, at = (-1, None, None), 0
        while True:
            parent = name[at:]
            for prefix, action in self.by_host.get(parent, ()):
                if place.startswith(prefix):
                    best = max(best, (len(parent) + len(prefix), parent + prefix, action), key=lambda b: b[0])
                    break
            dot = name.find(".", at)
            if dot < 0:
                return best[1:]
            at = dot + 1


def with_rules(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(id, host, path) to those with rule and action."""
    shipped = df.sparkSession.sparkContext.broadcast(Rules(rules))  # a list that the caller holds

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in it:
            found = [known.find(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rule, action = (pa.array([f[k] for f in found], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, action], names=["id", "host", "path", "rule", "action"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(find, f"id {kind}, host string, path string, rule string, action string")


def host_links(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, n): links between different hosts and how often they occur."""
    links = df.select(host(F.col(f"`{url_col}`")).alias("src"), F.explode(F.regexp_extract_all(F.col(f"`{html_col}`"), F.lit(HREF), F.lit(1))).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    found = links.select("src", host(full).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """Personalised PageRank of (kind, host, seed) over (kind, src, dst, n): (kind, host, rank)."""
    total = links.groupBy("kind", "src").agg(F.sum("n").alias("_all"))
    steps = cut(links.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("_all")).alias("share")))
    if not steps.head(1):  # nothing to spread over: ranks are the seeds' own part
        return seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    ranks = start
    for done in range(1, rounds + 1):
        moved = ranks.withColumnRenamed("host", "src").join(steps, ["kind", "src"])
        moved = moved.select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        ranks = start.union(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if done % 5 == 0 or done == rounds:
            ranks = cut(ranks)
    return ranks


def judge(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, damping: float = 0.85, rounds: int = 10,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of df."""
    url = F.col(f"`{url_col}`")
    judged = cut(with_rules(df.select(F.col(f"`{id_col}`").alias("id"), host(url).alias("host"), path(url).alias("path")), rules))
    hosts = judged.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("action") == "allow").alias("good"),
        F.count_if(F.col("action") == "block").alias("bad"),
    )
    hosts = cut(hosts.where("good > 0 OR bad > 0"))
    trusted = hosts.where("good > bad").select(F.lit("trust").alias("kind"), "host", F.col("good").alias("w"))
    blocked = hosts.where("bad * 2 > n").select(F.lit("distrust").alias("kind"), "host", F.col("bad").alias("w"))
    seeds = trusted.union(blocked)
    sums = seeds.groupBy("kind").agg(F.sum("w").alias("_sum"))  # two rows
    seeds = seeds.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("w") / F.col("_sum")).alias("seed"))
    links = cut(host_links(df, url_col, html_col))
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    ranks = propagate(seeds, both, damping, rounds)
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    spread = ranks.groupBy("host").agg(part("trust").alias("trust"), part("distrust").alias("distrust"))
    bad = F.round("distrust", 12) >= F.round((F.col("trust") + F.col("distrust")) * threshold, 12)
    suspects = cut(spread.where((F.col("distrust") > 0) & bad).select(F.col("host").alias("_host")))
    found = judged.join(small_side(suspects, suspects.count()), F.col("host") == F.col("_host"), "left")
    method = F.when(F.col("_host").isNotNull(), "block").otherwise("allow")
    return found.select("id", "host", "path", "rule", F.coalesce("action", method).alias("verdict"))
