"""URL filter: host and path rules, and trust propagated over the graph of hosts.

A rule fits its host and all subdomains; the longest that fits decides. Pages
without a rule are judged by their host: trust starts at hosts whose pages the
rules allow and follows links; distrust starts at hosts whose pages they block
and runs against the links (who links to a bad host is less trusted). Both are
personalised PageRanks, computed in rounds of joins over host edges until no
host's score changes by more than a tiny share of itself.

Edges are links between hosts in the pages, and the tie between a host and its
parent domain when both have pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.llm.common import stage, unstage

# The production rules (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DAMPING = 0.85
ROUNDS = 100  # no cap: a walk has weight 0.85 ** 100 left after these, and that share of a score is the tolerance
TOLERANCE = DAMPING ** ROUNDS
STEPS = 8  # rounds between two looks at the scores
# A host is blocked from this share of distrust in trust and distrust together.
BLOCK_SHARE = 0.5
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """The host (A-Z lower-cased) and path of a url; both empty without ``://`` or for null."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER), F.regexp_extract(url, parts, 2)


def _fitting(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, rules: the rules whose host this is or lies under."""
    spark = hosts.sparkSession
    known = spark.createDataFrame([(h, p, v, h + p) for v, h, p in rules], "rule_host string, path string, verdict string, rule string")
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))).alias("rule_host"))
    return above.join(known, "rule_host").groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "path", "verdict")), asc=False).alias("rules"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """The pages with host, path, rule and its verdict (both null if none fits)."""
    host, path = host_and_path(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path})
    fitting = _fitting(pages.select("host").distinct(), rules)
    best = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    out = pages.join(fitting, "host", "left").withColumn("best", F.get(best, F.lit(0)))
    return out.withColumns({"rule": F.col("best.rule"), "verdict": F.col("best.verdict")}).drop("rules", "best")


def host_edges(pages: DataFrame) -> DataFrame:
    """a, b, n: links from host to host (pages need host and html) and ties to parent domains."""
    links = pages.select(F.col("host").alias("a"), F.explode(F.regexp_extract_all(
        F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("b"))
    links = links.select("a", F.translate(F.regexp_replace("b", r"^[^@]*@|:\d*$", ""), _UPPER, _LOWER).alias("b"))
    links = links.where("a <> b AND a <> '' AND b <> ''").groupBy("a", "b").agg(F.count("*").alias("n"))
    hosts = pages.select("host").where("host <> ''").distinct()
    ties = hosts.select(F.col("host").alias("a"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("b"))
    ties = ties.join(hosts.select(F.col("host").alias("b")), "b", "left_semi").select("a", "b")
    ties = ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("n", F.lit(1))
    return links.unionByName(ties).groupBy("a", "b").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """host, trust, distrust from seeds (host, trust, distrust) over edges (a, b, n).

    Trust follows an edge in proportion to its count among those that leave,
    distrust runs back in proportion among those that arrive. Rounds go on until
    none adds more than TOLERANCE of its new score to any host's trust or
    distrust, so also until no further host is reached.
    """
    leave = edges.groupBy("a").agg(F.sum("n").alias("total"))
    arrive = edges.groupBy("b").agg(F.sum("n").alias("total"))
    moves = edges.join(leave, "a").select(
        F.col("a").alias("host"), F.lit("trust").alias("kind"), F.col("b").alias("to"), (F.col("n") / F.col("total")).alias("share"))
    moves = moves.unionByName(edges.join(arrive, "b").select(
        F.col("b").alias("host"), F.lit("distrust").alias("kind"), F.col("a").alias("to"), (F.col("n") / F.col("total")).alias("share")))
    start = seeds.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("score")),
        F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("score")))).alias("s")).select("host", "s.kind", "s.score")
    start = stage(start.where("score > 0").withColumn("score", F.col("score") * (1 - DAMPING)), "seeds")
    moves = stage(moves, "moves")
    # walk is what the last round has added to the score. A host without a move stays: each round takes the
    # scores along by a join with moves and stays, so rounds can follow each other in one plan.
    scores = start.withColumn("walk", F.col("score"))
    more = not moves.isEmpty()
    if more:
        stays = moves.select("host", "kind").unionByName(moves.select(F.col("to").alias("host"), "kind")).unionByName(
            start.select("host", "kind")).distinct().withColumns({"to": F.col("host"), "share": F.lit(None).cast("double")})
        moves = stage(moves.unionByName(stays), "steps")
    while more:
        before = scores
        for _ in range(STEPS):
            step = F.coalesce(F.col("walk") * F.col("share") * DAMPING, F.lit(0.0))
            scores = scores.join(moves, ["host", "kind"]).where("share IS NULL OR walk > 0").select(
                F.col("to").alias("host"), "kind", F.when(F.col("share").isNull(), F.col("score")).otherwise(step).alias("score"),
                step.alias("walk")).groupBy("host", "kind").agg(F.sum("score").alias("score"), F.sum("walk").alias("walk"))
        scores = stage(scores, "scores")
        unstage(before)
        more = not scores.where(F.col("walk") > TOLERANCE * F.col("score")).isEmpty()
    both = scores.groupBy("host").agg(*(
        F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))
    return both


def filter_pages(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    The verdict is that of the longest fitting rule; without one, a page is
    blocked if its host's share of distrust reaches BLOCK_SHARE, else allowed
    (so also a page without a host). Null urls and urls without ``://`` have an
    empty host and path. Null html has no links, null page_ids are carried,
    repeated rows are judged each. Other columns are ignored, whatever their
    names; an empty table gives an empty table.
    """
    pages = pages.select("page_id", "url", "html")
    seen = stage(judged(pages.select("page_id", "url"), rules), "pages")
    host, _ = host_and_path(F.col("url"))
    edges = stage(host_edges(pages.select(host.alias("host"), "html")), "edges")
    seeds = seen.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.avg(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    scores = propagate(seeds, edges)
    blocked = (F.col("distrust") > 0) & (F.col("distrust") >= BLOCK_SHARE * (F.col("trust") + F.col("distrust")))
    return seen.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
