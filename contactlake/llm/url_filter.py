"""URL filter by rules and by propagation over the host graph.

Host and path are cut from the url; the longest rule that fits gives its
verdict. Every other page is judged by its host: trust flows from hosts that
allow rules name along links (personalised PageRank), distrust flows from
hosts that block rules name against the links (PageRank of the reversed
graph, as who links to a bad host is suspect). A host is blocked if its
distrust exceeds ``threshold`` and its trust, both relative to an even share
of the whole; all others are allowed.

A host is a trusted and a blocked seed by the shares of its pages that rules
allow and block. Edges run between different
hosts, from a page's host to the host of every absolute or scheme-relative
link in it (``href`` of ``a`` and ``area``, outside comments, scripts and
styles), weighed by the number of links; they are summed by host pair
before anything is joined. A host without links gives its score back to the
seeds. Both scores run side by side over one edge list until a round moves
less than ``TOLERANCE`` of the mass of each; as a round shrinks what is still
to move by the damping, that takes at most 87 rounds, whatever the graph. Only
DataFrame operations are used; the lineage is cut every round, which is small:
one row a host.

Defined cases: a null url or one without ``://`` has an empty host and path,
fits no rule, and is allowed; null html has no links; repeated rows are judged
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

DAMPING = 0.85
TOLERANCE = 1e-6
THRESHOLD = 2.0
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_AUTHORITY = r"(?s)^.*?://([^/?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript|textarea)\b.*?(?:</\1\s*>|\z)"
_LINK = r"""(?i)<a(?:rea)?\s(?:[^>]*?\s)?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, _AUTHORITY, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _AUTHORITY + r"([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts, summed."""
    links = pages.select(host_of(F.col(url_col)).alias("src"),
                         F.explode(F.regexp_extract_all(F.regexp_replace(F.col(html_col), _UNREAD, " "),
                                                        F.lit(_LINK), F.lit(1))).alias("link"))
    dst = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link")))
    return (links.select("src", dst.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def host_scores(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None,
                tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from (src, dst, n) and (host, good, bad); scores are times an even share.

    Rounds go on until one moves less than ``tolerance`` of either score;
    ``rounds`` sets a fixed number instead.

    ``seeds`` has every host to be judged, with its weight as a trusted and as
    a blocked seed; hosts that only occur in edges are added.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    total = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.lit(total[c] or 1.0)
    hosts = ends.join(seeds, "host", "full_outer").select("host", share("good").alias("good"), share("bad").alias("bad"))
    out = edges.groupBy(F.col("src").alias("h")).agg(F.sum("n").alias("n_out"))
    back = edges.groupBy(F.col("dst").alias("h")).agg(F.sum("n").alias("n_in"))
    flows = cut(edges.join(out, F.col("src") == F.col("h")).drop("h")
                .join(back, F.col("dst") == F.col("h")).drop("h")
                .select("src", "dst", (F.col("n") / F.col("n_out")).alias("forth"),
                        (F.col("n") / F.col("n_in")).alias("back")))
    scores = cut(hosts.join(out.select(F.col("h").alias("host"), F.lit(True).alias("leads")), "host", "left")
                 .join(back.select(F.col("h").alias("host"), F.lit(True).alias("is_led_to")), "host", "left")
                 .select("host", "good", "bad", "leads", "is_led_to", F.col("good").alias("trust"),
                         F.col("bad").alias("distrust"), F.lit(1.0).alias("step"), F.lit(1.0).alias("step_bad")))
    # what flows on from a host with links; the rest returns to the seeds
    state = [F.sum(F.when(F.col("leads"), F.col("trust"))).alias("trust"),
             F.sum(F.when(F.col("is_led_to"), F.col("distrust"))).alias("distrust"),
             F.greatest(F.sum("step"), F.sum("step_bad")).alias("step")]
    if not flows.isEmpty():
        for k in itertools.count():
            moved = scores.agg(*state).first()
            if (moved["step"] < tolerance) if rounds is None else k == rounds:
                break
            to_dst = flows.join(scores, flows.src == scores.host).select(
                F.col("dst").alias("to"), (F.col("trust") * F.col("forth")).alias("trust"), F.lit(0.0).alias("distrust"))
            to_src = flows.join(scores, flows.dst == scores.host).select(
                F.col("src").alias("to"), F.lit(0.0).alias("trust"), (F.col("distrust") * F.col("back")).alias("distrust"))
            came = to_dst.unionByName(to_src).groupBy("to").agg(
                F.sum("trust").alias("came"), F.sum("distrust").alias("came_bad"))
            new = lambda c, seed, at: (damping * F.coalesce(F.col(at), F.lit(0.0))
                                       + F.lit(1 - damping * (moved[c] or 0.0)) * F.col(seed))
            trust, distrust = new("trust", "good", "came"), new("distrust", "bad", "came_bad")
            scores = cut(scores.join(came, F.col("host") == F.col("to"), "left")
                         .select("host", "good", "bad", "leads", "is_led_to", trust.alias("trust"),
                                 distrust.alias("distrust"), F.abs(trust - F.col("trust")).alias("step"),
                                 F.abs(distrust - F.col("distrust")).alias("step_bad")))
    n = scores.count()
    return scores.select("host", (F.col("trust") * n).alias("trust"), (F.col("distrust") * n).alias("distrust"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES,
          damping: float = DAMPING, rounds: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """id, host, path, rule, verdict, trust and distrust of the host, of every row."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"),
                          rule_of(host, path, rules).alias("by"))
    seeds = judged.where("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce(F.col("by.verdict"), F.lit("")) == "allow").cast("double")).alias("good"),
        F.avg((F.coalesce(F.col("by.verdict"), F.lit("")) == "block").cast("double")).alias("bad"))
    scores = host_scores(cut(host_edges(pages, url_col, html_col)), cut(seeds), damping, rounds)
    bad = (F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce(F.col("by.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return (judged.join(scores.withColumnRenamed("host", "s_host"), F.col("host") == F.col("s_host"), "left")
            .select(F.col("id").alias(id_col), "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"),
                    "trust", "distrust"))
