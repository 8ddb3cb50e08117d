"""URL verdicts: rules by host and path, then trust over the link graph.

DataFrame functions only. Hosts and links come out of the pages by SQL
expressions; host edges are counted with partial aggregation. Two personalised
PageRanks run side by side as one table: trust flows along links from hosts
that the rules mostly allow, distrust flows against them from hosts that the
rules mostly block. A host whose distrust exceeds its trust is blocked where
no rule speaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, free_shuffles, stage_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Scripts, styles and comments, to their end or the page's.
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
_LINK = r"""(?i)<(?:a|area)\s[^>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule is
    ``host/path``; it fits the host and its subdomains where the path starts
    with the rule's. Equal lengths: block first, then by name."""
    rule = verdict = F.lit(None).cast("string")
    for v, name in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        h, _, p = name.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, pages): how many pages of src link to another host dst."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace(F.col(html), _UNSEEN, " "), F.lit(_LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER)))
    rows = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(found).alias("dst"))
    return rows.where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("pages"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 500, tolerance: float = 1e-6) -> DataFrame:
    """(kind, host, rank) from seeds (kind, host, seed; each kind's seeds sum to
    1) over edges (kind, src, dst, share; shares of a src sum to 1). Rank that
    reaches hosts without edges goes back to the seeds. Rounds end when
    no more than ``tolerance`` moves in all; ranks that have not settled after
    ``rounds`` are an error, not a result."""
    if edges.isEmpty():
        return seeds.select("kind", "host", F.col("seed").alias("rank"))
    out = edges.select("kind", F.col("src").alias("host")).distinct().withColumn("leads", F.lit(True))
    state = stage_table(seeds.join(out, ["kind", "host"], "left").select("kind", "host", "seed", F.coalesce("leads", F.lit(False)).alias("leads"), F.col("seed").alias("rank")), "rank")
    totals = lambda table, moved: {r.kind: r for r in table.groupBy("kind").agg(F.sum(F.when(~F.col("leads"), F.col("rank")).otherwise(0.0)).alias("lost"), F.sum(moved).alias("moved")).collect()}  # noqa: E731 - two rows
    of = totals(state, F.lit(0.0))
    for k in range(rounds):
        moved = edges.join(state.where("rank > 0").select("kind", F.col("host").alias("src"), "rank"), ["kind", "src"])
        moved = moved.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        back = F.lit(0.0)
        for kind, x in of.items():
            back = F.when(F.col("kind") == kind, F.lit(float(x.lost))).otherwise(back)
        rank = (1 - damping) * F.col("seed") + damping * (F.coalesce("got", F.lit(0.0)) + back * F.col("seed"))
        new = stage_table(state.select("kind", "host", "seed", "leads", F.col("rank").alias("old")).join(moved, ["kind", "host"], "left").select("kind", "host", "seed", "leads", rank.alias("rank"), "old"), "rank")
        of = totals(new, F.abs(F.col("rank") - F.col("old")))
        change = sum(x.moved for x in of.values())
        drop_table(state)
        if k % 8 == 7:
            free_shuffles(new.sparkSession)
        state = new
        if change < tolerance:
            return state.select("kind", "host", "rank")
    raise RuntimeError(f"ranks still move by {change} after {rounds} rounds")


def url_verdicts(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    seed_share: float = 0.5,
    threshold: float = 1.0,
    damping: float = 0.85,
    rounds: int = 500,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: id_col, host, path, rule (null if none fits), verdict.

    Rules are ("allow" or "block", "host/path"). Hosts most of whose pages (more
    than ``seed_share``) the rules allow are trusted, those mostly blocked are
    distrusted. Without a rule a page is blocked if its host's distrust exceeds
    ``threshold`` times its trust, else allowed: hosts that nothing reaches are
    allowed (ties too). Null urls and urls without ``://`` have an empty host
    and path, take no part in the graph and are allowed. Null pages have no
    links. Repeated rows count and are repeated. Other columns are ignored.
    Empty input: no rows.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    source = source.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = source.select("id", "host", "path", rule.alias("rule"), verdict.alias("said"))
    edges = stage_table(host_edges(source), "edges")
    by_host = judged.where("host != ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked")
    )
    nodes = by_host.union(edges.select("dst").distinct().select(F.col("dst").alias("host"), F.lit(0).alias("n"), F.lit(0).alias("allowed"), F.lit(0).alias("blocked")))
    nodes = nodes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    marked = nodes.select("host", (F.col("allowed") > seed_share * F.col("n")).cast("double").alias("trust"), (F.col("blocked") > seed_share * F.col("n")).cast("double").alias("distrust"))
    marked = stage_table(marked, "hosts")
    total = marked.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    seeds = None
    for kind in ("trust", "distrust"):
        part = marked.select(F.lit(kind).alias("kind"), "host", (F.col(kind) / F.lit(max(total[kind] or 0.0, 1.0))).alias("seed"))
        seeds = part if seeds is None else seeds.union(part)
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "pages").union(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "pages"))
    out = both.groupBy("kind", "src").agg(F.sum("pages").alias("all"))
    both = stage_table(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("pages") / F.col("all")).alias("share")), "shares")
    ranks = propagate(seeds, both, damping, rounds)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    bad = ranks.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust")).where(F.col("distrust") > threshold * F.col("trust"))
    out = judged.join(bad.select("host", F.lit("block").alias("found")), "host", "left")
    verdict = F.coalesce("said", F.when(F.col("host") != "", F.col("found")), F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
