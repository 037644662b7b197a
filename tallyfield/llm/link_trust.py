"""URL filters: rules for hosts and paths, and for what they leave open the trust of the host in the link graph.

A rule names a host and the beginning of a path; it fits the host and all its subdomains, and the longest rule that
fits a url decides it. Hosts most of whose pages are allowed, or blocked, by rules are the seeds of two walks with
restart over the links between hosts: personalised PageRank carries trust from the allowed seeds along the links, the
same over reversed links carries distrust from the blocked seeds to whoever links to them. A host whose distrust
reaches the threshold and exceeds its trust is blocked.

Everything is column expressions, joins and aggregations. Pages are reduced to links counted by pair of hosts before
they are shuffled, so a host with a third of all pages is one row; no page takes part in the rounds.

Defined results: a null url, or one without ``://``, has an empty host and path, which only a rule for an empty host
can fit; a null html has no links; links inside a host, and links that are not of the form ``//host`` or
``http(s)://host``, carry nothing; rows with the same id are pages of their own; an empty table gives an empty table;
columns other than the named ones are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Links of a page: the value of href in a and area elements, with its quotes.
_WHITE = r"[ \t\r\n\f]"
LINKS = rf"(?i)<a(?:rea)?{_WHITE}(?:[^>]*?{_WHITE})?href{_WHITE}*={_WHITE}*(\"[^\"]*\"|'[^']*'|[^ \t\r\n\f>\"']+)"
#: Host of a link that names one.
LINK_HOST = r"(?i)^(?:https?:)?//([^/?#]*)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it has no ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    return lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fits): the rules for a host or a parent of it, longest first."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = rules.select(
        F.col("host").alias("parent"),
        F.struct(
            (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("n_host"), F.concat("host", "path").alias("rule"), "path", "verdict"
        ).alias("fit"),
    )
    fits = hosts.select("host", F.explode(parents).alias("parent")).join(named, "parent").groupBy("host").agg(F.collect_list("fit").alias("fits"))
    return hosts.join(fits.select("host", F.sort_array("fits", asc=False).alias("fits")), "host", "left")


def rank_hosts(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, still: float = 1e-9) -> DataFrame:
    """(host, trust, distrust) of every host with a seed or an edge.

    ``edges``: (src, dst, n); ``seeds``: (host, trusted, blocked), each seed 1. Trust follows the edges and is shared
    by their counts, distrust goes back along them likewise; both start again at the seeds with 1 - ``damping``. Ends
    after ``rounds``, or when no score moves by more than ``still``.
    """
    # loops carry nothing
    edges = edges.filter("src <> dst")
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    shares = edges.join(out, "src").join(into, "dst")
    shares = cut_lineage(shares.select("src", "dst", (F.col("n") / F.col("out")).alias("ahead"), (F.col("n") / F.col("into")).alias("back")), "edges")
    start = seeds.select("host", (F.col("trusted") * (1 - damping)).alias("trust"), (F.col("blocked") * (1 - damping)).alias("distrust"))
    start = cut_lineage(start, "seeds")
    nothing = F.lit(0.0)
    scores = start
    for _ in range(rounds):
        trust = shares.join(scores.filter("trust > 0"), F.col("src") == F.col("host"))
        distrust = shares.join(scores.filter("distrust > 0"), F.col("dst") == F.col("host"))
        moved = (
            start.select("host", "trust", "distrust", nothing.alias("was_trust"), nothing.alias("was_distrust"))
            .union(trust.select("dst", damping * F.col("trust") * F.col("ahead"), nothing, nothing, nothing))
            .union(distrust.select("src", nothing, damping * F.col("distrust") * F.col("back"), nothing, nothing))
            .union(scores.select("host", nothing, nothing, "trust", "distrust"))
            .groupBy("host")
            .agg(*(F.sum(c).alias(c) for c in ("trust", "distrust", "was_trust", "was_distrust")))
        )
        moved = cut_lineage(moved, "scores")
        scores = moved.select("host", "trust", "distrust")
        change = F.greatest(F.abs(F.col("trust") - F.col("was_trust")), F.abs(F.col("distrust") - F.col("was_distrust")))
        if moved.filter(change > still).isEmpty():
            break
    return scores


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    link = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINKS), F.lit(1)))
    found = pages.select(url_parts(F.col(url_col))[0].alias("src"), link.alias("link"))
    bare = F.regexp_replace("link", "^[\"' \t\r\n\f]+", "")
    # a quote that closes the value comes after a host that nothing else has ended
    dst = lower(F.regexp_replace(F.regexp_extract(bare, LINK_HOST, 1), "[\"' \t\r\n\f]+$", ""))
    return found.select("src", dst.alias("dst")).filter("dst <> '' AND src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    page_id: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    seed_share: float = 0.5,
    threshold: float = 0.01,
    damping: float = 0.85,
    rounds: int = 20,
) -> DataFrame:
    """(id, host, path, rule, verdict) for every page.

    A host is a seed if more than ``seed_share`` of its pages are allowed, or blocked, by rules. A page without a rule
    is blocked if its host's distrust is at least ``threshold`` and more than its trust, and allowed otherwise.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(page_id).alias("id"), host.alias("host"), path.alias("path"))
    hosts = rules_of_hosts(urls.select("host").distinct(), table)
    fit = F.get(F.filter("fits", lambda f: F.startswith(F.col("path"), f["path"])), F.lit(0))
    ruled = urls.join(cut_lineage(hosts, "hosts"), "host").withColumn("fit", fit)
    ruled = cut_lineage(ruled.select("id", "host", "path", "fit.rule", "fit.verdict"), "ruled")

    def most(verdict):
        return (F.sum(F.when(F.col("verdict") == verdict, 1).otherwise(0)) > seed_share * F.count("*")).cast("int")

    seeds = ruled.groupBy("host").agg(most("allow").alias("trusted"), most("block").alias("blocked"))
    scores = rank_hosts(host_links(pages, url_col, html_col), seeds, damping, rounds)
    bad = cut_lineage(scores.filter((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select("host"), "blocked")
    judged = ruled.join(bad.withColumn("bad", F.lit(True)), "host", "left")
    verdict = F.coalesce("verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return judged.select(F.col("id").alias(page_id), "host", "path", "rule", verdict.alias("verdict"))
