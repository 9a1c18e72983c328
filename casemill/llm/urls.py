"""URL verdicts: longest matching rule, else trust and distrust carried over the links of hosts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.session import durable

_ABSOLUTE = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Distrust must exceed trust by this share, which is more than sums and the last rounds may be off.
MARGIN = 1e-9
#: Changes below this, at the end of what a double holds, do not keep the rounds going.
_TINY = 1e-300


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """{rule, verdict} of the longest rule that fits; of equally long ones the first listed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts; links without a host stay on their own."""
    found = pages.select(
        url_host(F.col(url)).alias("src"),
        F.explode(F.regexp_extract_all(F.col(html), F.lit(_ABSOLUTE), F.lit(1))).alias("dst"),
    )
    found = found.withColumn("dst", F.translate("dst", _UPPER, _LOWER))
    return found.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(
    seeds: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int | None = None, every: int = 4, tolerance: float = 1e-10
) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) over links (src, dst, n).

    Trust follows the links, a host's shares by link counts; distrust follows them backwards,
    so that linking to what is blocked costs.  Each round is ``(1 - damping) x seed + damping x
    inflow``; mass on hosts without links in the direction asked for is not passed on.  Both
    are rows of one table, so a round is one join and one partially aggregated sum.  Lineage
    is cut every few rounds; there the rounds stop if no host's score has moved by more than
    ``tolerance`` of itself since the last cut, so a host that is reached late keeps them going.
    The sum of all errors is then at most ``tolerance x r / (1 - r)`` of the sum of all scores,
    r = damping^every (1.1e-10 as set).  ``rounds`` is for those who want fewer.
    """
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    )
    out = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    shares = durable(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("share")))
    seed = durable(
        seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "score"))
        .filter("score > 0")
    )
    state, last = seed, None
    for turn in count() if rounds is None else range(rounds):
        flow = state.join(shares, ["kind", "host"]).select("kind", F.col("to").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
        base = seed.select("kind", "host", ((1 - damping) * F.col("score")).alias("score"))
        state = flow.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if (turn + 1) % every == 0 or turn + 1 == rounds:
            state = durable(state)
            if last is not None or turn + 1 == every:
                old = (last if last is not None else seed).withColumnRenamed("score", "old")
                new, old_score = F.coalesce("score", F.lit(0.0)), F.coalesce("old", F.lit(0.0))
                moves = F.abs(new - old_score) > F.greatest(tolerance * F.greatest(new, old_score), F.lit(_TINY))
                if state.join(old, ["kind", "host"], "full").filter(moves).isEmpty():
                    break
            last = state
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return state.groupBy("host").agg(pick("trust"), pick("distrust"))


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", html: str = "html",
    damping: float = 0.85, rounds: int | None = None, threshold: float = 1.0,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page.

    Seeds are the hosts of ruled pages: their share of all ruled pages that is allowed is
    trust, that is blocked distrust.  A page without a rule is blocked if its host's distrust
    exceeds ``threshold`` times its trust by ``MARGIN`` of that; without any evidence it is
    allowed.  Scores are shares, so only their ratio counts, however large the table is.

    Null urls and urls without ``://`` have empty host and path, fit no rule and take no part
    in the graph; null html has no links.  Repeated rows count as often as they occur.  An
    empty table gives no rows.  Other columns are not looked at.  The table of hosts is joined
    by Spark's choice, skewed hosts included.
    """
    seen = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    seen = seen.withColumn("_m", matching_rule(F.col("host"), F.col("path"), rules))
    counts = seen.groupBy("host").agg(
        F.count_if(F.col("_m.verdict") == "allow").alias("a"), F.count_if(F.col("_m.verdict") == "block").alias("b")
    )
    total = counts.agg(F.sum(F.col("a") + F.col("b")).alias("all"))
    seeds = counts.filter("a + b > 0").join(F.broadcast(total)).select(  # the one row of a global sum
        "host", (F.col("a") / F.col("all")).alias("trust"), (F.col("b") / F.col("all")).alias("distrust")
    )
    scores = propagate(seeds, host_links(pages, url, html), damping, rounds)
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    # The margin keeps sums that differ in their last bits on one side.
    method = F.when((distrust > 0) & (distrust > threshold * trust * (1 + MARGIN)), "block").otherwise("allow")
    return seen.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("_m.rule").alias("rule"), F.coalesce("_m.verdict", method).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
