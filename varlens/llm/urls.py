"""URL filters: rules by host and path, and trust propagated over host links.

A url's verdict is that of the longest rule that fits it.  Where none fits, its
host decides.  Rules seed the hosts: a host's trust seed is the share of its
pages that rules allow, its distrust seed the share that they block.  Trust
flows along links (personalised PageRank from the trusted seeds); distrust flows
against them, from blocked hosts to those that link there.  Scores are in units
of a lone seed: ``score = seed + DAMPING * (flow)``.  A host is blocked if its
distrust is at least ``THRESHOLD`` and above its trust.

Everything runs as DataFrame operations: pages are reduced to host links with
counts before any shuffle of whole rows, and hot hosts are split by the
skew-aware joins.  Scores are written out each round.

Defined results: a null url, or one without ``://``, has empty host and path and
no rule; the empty host is an ordinary host; links to the own host don't count;
a repeated page counts as often as it stands there; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlens.llm.common import stored

DAMPING, THRESHOLD = 0.85, 0.5
#: The largest change of a score that ends the rounds.
TOLERANCE = 1e-4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules of the query over the driver's pages.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    on_host = (host == rule.host) | host.endswith(f".{rule.host}")
    return on_host & path.startswith(rule.path)


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column, of) -> Column:
    """``of(rule)`` for the longest rule that fits (the first of equals), else null."""
    best = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        best = F.when(fits(rule, host, path), F.lit(of(rule))).otherwise(best)
    return best


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links of the pages' html to other hosts."""
    target = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1)))
    links = pages.select(host_of(F.col("url")).alias("src"), target.alias("target"))
    full = F.when(F.col("target").startswith("//"), F.concat(F.lit("http:"), F.col("target"))).otherwise(F.col("target"))
    return (links.select("src", host_of(full).alias("dst")).where(F.col("src") != F.col("dst"))
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, trust, distrust) over ``links``
    (src, dst, n), until no score changes by ``tolerance``, or for ``rounds``.  The
    changes of a round add up to ``damping`` times those of the round before at
    most, and those of the first to ``damping`` times the seeds, which bounds the
    number of rounds."""
    links = stored(links)
    seeds = stored(seeds)
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    into = links.groupBy("dst").agg(F.sum("n").alias("total"))
    forward = links.join(out, "src").select(F.col("src").alias("from"), F.col("dst").alias("to"),
                                            (F.col("n") / F.col("total")).alias("t"), F.lit(0.0).alias("d"))
    back = links.join(into, "dst").select(F.col("dst").alias("from"), F.col("src").alias("to"),
                                          F.lit(0.0).alias("t"), (F.col("n") / F.col("total")).alias("d"))
    flows = forward.unionByName(back)
    if links.isEmpty():  # no link: the seeds are the scores
        return seeds
    flows = stored(flows)
    scores = seeds
    most = rounds
    if most is None:
        total = seeds.agg(F.greatest(F.sum("trust"), F.sum("distrust"))).first()[0] or 0.0
        most = 2 + max(0, math.ceil(math.log(max(total, tolerance) / tolerance) / -math.log(damping)))
    for _ in range(most):
        moved = (scores.withColumnRenamed("host", "from").join(flows, "from")
                 .select(F.col("to").alias("host"), (damping * F.col("trust") * F.col("t")).alias("trust"),
                         (damping * F.col("distrust") * F.col("d")).alias("distrust")))
        new = stored(seeds.unionByName(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
        old = scores.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        change = new.join(old, "host", "left").agg(F.max(F.greatest(
            F.abs(F.col("trust") - F.coalesce("t0", F.lit(0.0))), F.abs(F.col("distrust") - F.coalesce("d0", F.lit(0.0)))))).first()[0]
        scores = new
        if change is None or change < tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"scores did not settle in {most} rounds")
    return scores


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule (text or null), verdict, trust and distrust
    (null where a rule decides)."""
    kept = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "trust", "distrust")])
    placed = kept.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = placed.withColumns({"rule": longest_rule(rules, F.col("host"), F.col("path"), lambda r: r.text),
                                "verdict": longest_rule(rules, F.col("host"), F.col("path"), lambda r: r.verdict)})
    seeds = (ruled.groupBy("host").agg(F.avg((F.coalesce("verdict", F.lit("")) == "allow").cast("double")).alias("trust"),
                                       F.avg((F.coalesce("verdict", F.lit("")) == "block").cast("double")).alias("distrust")))
    scores = propagate(seeds, host_links(pages))
    decided = ruled.where(F.col("rule").isNotNull()).withColumns({"trust": F.lit(None).cast("double"), "distrust": F.lit(None).cast("double")})
    blocked = (F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.col("trust"))
    rest = (ruled.where(F.col("rule").isNull()).drop("verdict").join(scores, "host", "left")
            .withColumn("verdict", F.when(blocked, "block").otherwise("allow")))
    return decided.unionByName(rest)
