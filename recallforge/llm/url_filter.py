"""Operator 4: URL filters by link-graph propagation over hosts.

Every page's url is judged by the longest rule that fits its host and path; where
none fits, by its host's place in the link graph.  Host edges (``host_edges``) are

* links: href, src and action values of the html that name a host, by themselves or
  through the page's ``<base>`` (weight: their number; a relative link without such a
  base stays on its host);
* names: the hosts of e-mail addresses in the html, and hosts of the table that it
  spells out (weight: the number of pages, for each of the two);
* parents: from a host to the nearest host above it that the table holds.

A host is a seed, by the part of its pages, if rules of a verdict fit most of them.
Trust is personalised PageRank from the allowed seeds along the edges, distrust the same
from the blocked seeds against them (who links to bad hosts is suspect).  Each is seen
from the host that gets it: of a walk that starts at the host, goes on with probability
``damping``, against the edges for trust and along them for distrust, by their weights,
the part that ends at seeds, from 0 to 1 (a seed itself is 1).  So a host's own links
count: one bad link among many is a small part, each step to a seed takes its share, and
neither depends on the size of the table or on how many others link to the seed.  A host
is blocked if its distrust exceeds ``ratio`` times its trust by more than ``margin``;
hosts that neither reaches are allowed.

All of it is DataFrame functions.  Only (host, mass) and (host, host, weight) move
in the rounds; in-links are summed map-side first, and the links of a host that has very
many are dealt out.  Ranks are cut in the shared folder every few rounds.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: then up to ``?``, ``#`` or the end.  Null url, or none with
``://``: both empty, allowed.  Null html: no links.  Very long html is read whole.
Repeated rows are judged each.  Empty table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recallforge.llm import _io

#: (rule, verdict): host suffix and path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING = 0.85
#: Well under MARGIN: what a round may still change, as part of a host's mass.
TOLERANCE = 1e-6
RATIO = 1.0
#: About an eighth of a host's links by weight, or fourteen steps to a blocked host.
MARGIN = 0.1
#: Rounds between two cuts of the lineage.
STRIDE = 4
_LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*([^"'\s>]+)"""
_BASE = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
#: A name with a dot that may be a host's, or ``@`` and an address's host.
_NAME = r"(?i)(?:@|(?<![a-z0-9.@-]))(?:[a-z0-9-]++\.)+[a-z]{2,}(?![a-z0-9-])"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, html, rule, by_rule: the longest rule that fits."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, _, prefix = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rows.withColumns({"rule": rule, "by_rule": verdict})


def _named(link: Column) -> Column:
    """The host that a link itself names, else empty: absolute, ``//host``, mail."""
    at = F.regexp_extract(link, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    mail = F.regexp_extract(link, r"(?i)^mailto:[^@?]*@([^?]*)", 1)
    return F.translate(F.when(at != "", at).otherwise(mail), _UPPER, _LOWER)


def host_edges(rows: DataFrame) -> DataFrame:
    """src, dst, weight between different hosts, from ``rows`` (host, html)."""
    rows = rows.where("host <> ''").select("host", "html")
    base = _named(F.regexp_extract("html", _BASE, 1))
    links = rows.select("host", base.alias("base"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    # a link without a host of its own goes to that of <base>, if it names one
    local = ~F.col("link").rlike(r"(?i)^[a-z][a-z0-9+.-]*:")
    dst = F.when(_named(F.col("link")) != "", _named(F.col("link"))).when(local, F.col("base")).otherwise("")
    linked = links.select(F.col("host").alias("src"), dst.alias("dst")).where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))

    spelt = rows.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_NAME), F.lit(0)), lambda x: F.translate(x, _UPPER, _LOWER)))).alias("dst"))
    mail = F.col("dst").startswith("@")
    spelt = spelt.select("src", mail.alias("mail"), F.when(mail, F.substring("dst", 2, 1 << 30)).otherwise(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst", "mail").agg(F.count("*").cast("double").alias("weight"))
    hosts = rows.select(F.col("host").alias("dst")).distinct()
    named = spelt.where("mail").unionByName(spelt.where("not mail").join(hosts, "dst", "left_semi")).select("src", "dst", "weight")

    # a.b.c: b.c, then c
    parts = F.split("dst", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    up = hosts.where(F.size(parts) > 1).select(F.col("dst").alias("src"), F.explode(above).alias("dst")).join(hosts, "dst", "left_semi")
    parent = up.groupBy("src").agg(F.max_by("dst", F.length("dst")).alias("dst")).select("src", "dst", F.lit(1.0).alias("weight"))
    return linked.unionByName(named).unionByName(parent).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _walk(edges: DataFrame, seeds: DataFrame, end: str, *, damping: float, rounds: int | None) -> DataFrame:
    """host, mass: ``seeds`` (host, mass) propagated over (src, dst, weight), an edge's
    share being that of the edges at its ``end``, until no mass changes by more than
    TOLERANCE of itself, or less than TOLERANCE of the seeds' is still on its way;
    ``rounds``, if given, is the exact number instead."""
    spread = edges.groupBy(end).agg(F.sum("weight").alias("all"))
    sizes = edges.groupBy(end).agg(F.count("*").alias("n"))
    total = _io.salted_join(edges, spread, end, _io.hot_keys(sizes, end, "n", edges.count()), ["src", "dst"])
    shares = _io.cut(total.select("src", "dst", (F.col("weight") / F.col("all")).alias("share")))
    hot = _io.cut(_io.hot_keys(shares.groupBy("src").agg(F.count("*").alias("n")), "src", "n", shares.count()))
    zero = F.lit(0.0).alias("before")
    restart = seeds.select("host", (F.col("mass") * (1 - damping)).alias("mass"), zero)
    moving = F.abs(F.col("mass") - F.col("before")) > TOLERANCE * F.col("mass")
    # after so many rounds less than TOLERANCE of the seeds' mass is on its way
    most, done, mass = rounds if rounds is not None else math.ceil(math.log(TOLERANCE / 2) / math.log(damping)), 0, seeds
    while done < most:
        for k in range(min(STRIDE, most - done), 0, -1):
            passed = _io.salted_join(shares, mass.withColumnRenamed("host", "src"), "src", hot, ["dst"])
            moved = passed.select(F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"), zero)
            step = moved.unionByName(restart)
            if k == 1:  # the last round before a cut is compared with the one before it
                step = step.unionByName(mass.select("host", F.lit(0.0).alias("mass"), F.col("mass").alias("before")))
            step = step.groupBy("host").agg(F.sum("mass").alias("mass"), F.sum("before").alias("before"))
            mass, done = step.select("host", "mass"), done + 1
        step = _io.cut(step)
        mass = step.select("host", "mass")
        if rounds is None and step.where(moving).isEmpty():
            break
    return mass


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """host, mass: personalised PageRank of (src, dst, weight) from seeds (host,
    share), settled or after ``rounds``; mass of hosts without links is not passed on."""
    return _walk(edges, seeds.select("host", F.col("share").alias("mass")), "src", damping=damping, rounds=rounds)


def filter_urls(pages: DataFrame, rules=RULES, *, damping: float = DAMPING, rounds: int | None = None, ratio: float = RATIO, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    rows = judged(pages, rules)
    edges = _io.cut(host_edges(rows))
    by = F.col("by_rule")
    votes = rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(by == "allow").alias("allow"), F.count_if(by == "block").alias("block"))
    # a path rule alone makes no seed: most pages of the host must fall under it
    votes = votes.select("host", *[F.when(2 * F.col(c) > F.col("pages"), F.col(c) / F.col("pages")).otherwise(0.0).alias(c) for c in ("allow", "block")])
    seeds = _io.cut(votes.where("allow > 0 or block > 0"))

    def reached(links: DataFrame, column: str, name: str) -> DataFrame:
        """host, name: the part of a walk from the host that ends at seeds of ``column``."""
        mass = _walk(links, seeds.where(F.col(column) > 0).select("host", F.col(column).alias("mass")), "dst", damping=damping, rounds=rounds)
        return mass.select("host", F.least(F.lit(1.0), F.col("mass") / (1 - damping)).alias(name))

    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    scores = reached(edges, "allow", "trust").join(reached(back, "block", "distrust"), "host", "full").fillna(0.0, ["trust", "distrust"])
    bad = F.col("distrust") > ratio * F.col("trust") + margin
    scores = scores.select("host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"), F.when(bad, "block").otherwise("allow").alias("by_host"))
    return rows.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_io.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
