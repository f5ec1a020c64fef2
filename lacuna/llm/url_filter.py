"""Judging URLs by rules and by trust that spreads over host links.

Rules decide the URLs they fit. Their hosts seed trust and distrust: trust is a personalised
PageRank from allowed hosts along links; distrust comes against them from blocked hosts to those
that link there, each taking the share of its own links, so however many others link to a
blocked host, it takes the same. A host whose distrust exceeds its trust by a threshold is blocked. All steps are column expressions, joins and sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.lineage import cut

ROUNDS = 12
DAMPING = 0.85
#: In units of a host of which every page is blocked.
THRESHOLD = 0.5
#: Ranks count as settled when the rounds of one job change them by no more than this in sum.
TOLERANCE = 1e-6
#: Rounds of propagation in one job, before its table is written.
ROUNDS_A_JOB = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; '' without any."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; '' without a host part."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest fitting rule, null when none fits.

    A rule ``host/path`` fits its host and all subdomains when the path starts with
    its own. Of rules of one length the first by code point wins.
    """
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        at = rule.index("/")
        name, start = rule[:at], rule[at:]
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(best)
    return best


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, pages): pages of host ``src`` that link to another host ``dst``."""
    targets = F.array_distinct(F.transform(
        F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lower_ascii))
    return (pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
            .filter((F.col("src") != F.col("dst")) & (F.col("src") != ""))
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages")))


def _shares(edges: DataFrame, kind: str, source: str, target: str) -> DataFrame:
    total = edges.groupBy(source).agg(F.sum("pages").alias("total"))
    return edges.join(total, source).select(
        F.lit(kind).alias("kind"), F.col(source).alias("host"), F.col(target).alias("to"),
        (F.col("pages") / F.col("total")).alias("share"))


def _taken(edges: DataFrame) -> DataFrame:
    """Links of both kinds for judging: a host's distrust is shared by what its own links say."""
    trust = _shares(edges, "trust", "src", "dst")
    return trust.unionByName(trust.select(
        F.lit("distrust").alias("kind"), F.col("to").alias("host"), F.col("host").alias("to"), "share"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS,
              damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank) after ``rounds`` rounds of personalised PageRank.

    ``seeds`` holds (kind, host, weight) of kinds 'trust' (follows links) and 'distrust'
    (goes against them). A round keeps ``1 - damping`` of the seed. It is one join on the host and one sum that combines
    before the shuffle, so hubs arrive as one row per task; hub rows of the join are left to
    skew splitting, as their other side has one row. Rank of hosts without links is
    not passed on.
    """
    links = cut(_shares(edges, "trust", "src", "dst").unionByName(
        _shares(edges, "distrust", "dst", "src")))
    start = cut(seeds.select("kind", "host", F.col("weight").alias("rank")))
    rank = start
    for done in range(1, rounds + 1):
        rank = _round(rank, links, start, damping)
        if done % ROUNDS_A_JOB == 0 and done < rounds:
            rank = cut(rank)
    return rank


def _round(rank: DataFrame, links: DataFrame, start: DataFrame, damping: float) -> DataFrame:
    moved = rank.join(links, ["kind", "host"]).select(
        "kind", F.col("to").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
    kept = start.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank"))
    return moved.unionByName(kept).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))


def settle(links: DataFrame, seeds: DataFrame, damping: float = DAMPING,
           tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank): ``1 - damping`` of the seed and what comes over ``links``, in the limit.

    From ``1 - damping`` of the seeds ranks only rise, so the change of a job is the growth of their
    sum, and every later job's is smaller by ``damping ** ROUNDS_A_JOB`` at least: in sum for trust, in
    the largest of a host for distrust. No host is further than about 1.1 tolerances from its limit.
    """
    start = cut(seeds.select("kind", "host", F.col("weight").alias("rank")))

    def total(ranks: DataFrame):
        # decimals add up to the same in any order
        return ranks.agg(F.sum(F.col("rank").cast("decimal(38,18)"))).first()[0] or 0

    rank = cut(start.withColumn("rank", F.col("rank") * (1 - damping)))
    before, now = None, total(rank)
    while before is None or now - before > tolerance:
        for _ in range(ROUNDS_A_JOB):
            rank = _round(rank, links, start, damping)
        rank = cut(rank)
        before, now = now, total(rank)
    return rank


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], tolerance: float = TOLERANCE,
               damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``rules`` are (verdict, ``host/path``) pairs. A seed weighs the share of its host's pages
    that the rules allow, or block. A URL that no rule fits gets its host's verdict:
    block if distrust - trust, to 12 decimals, exceeds ``threshold`` times what a wholly
    blocked host gets from its own seed, else allow; that includes hosts that no link
    reaches, null URLs and pages without html. Repeated rows stay repeated; other columns
    are ignored.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    judged = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    by_host = judged.groupBy("host").agg(*(
        F.avg((F.coalesce(F.col("fit.verdict"), F.lit("")) == verdict).cast("double")).alias(kind)
        for kind, verdict in (("trust", "allow"), ("distrust", "block"))))
    seeds = by_host.select("host", F.explode(F.create_map(
        F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "weight"),
    ).filter("weight > 0")
    ranks = settle(cut(_taken(cut(host_edges(rows)))), seeds, damping, tolerance)
    blocked = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(-F.col("rank"))).alias("net"),
    ).filter(F.round("net", 12) > threshold * (1 - damping)).select("host", F.lit(True).alias("blocked"))
    return judged.join(blocked, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
