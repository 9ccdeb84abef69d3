"""URL filters: explicit rules first, then trust and distrust propagated over the host graph.

A rule names a host and a path; it fits the host and all its subdomains where the url's path starts with the rule's, and
the longest rule wins (ties: the smaller text; of one text given twice, ``block``).  Rules are a short list held in the plan.

Urls without a rule get the verdict of their host.  Hosts with more allowed than blocked urls are trusted seeds, hosts with
more blocked than allowed ones blocked seeds.  Over the distinct host edges two personalised PageRanks run side by side:
trust flows along edges from the trusted seeds, distrust against them from the blocked seeds.  A host is blocked where its
distrust exceeds ``threshold`` times its trust; hosts that neither reaches are allowed.

Edges are the links of the pages to other hosts, and both ways between a domain and its direct subdomains, down to domains
of two labels.  Masses are whole numbers, so sums do not depend on their order.  After ``rounds`` rounds what is missing of a
seed's mass is at most ``0.85 ** rounds`` of it.

Only DataFrame functions are used.  Html is scanned where it lies and leaves a page as its distinct hosts; edges are
made distinct and masses summed before they are shuffled.  A host with many edges or pages is split by the skew join.

Edge rows: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; null html has no links;
hosts of more than 253 characters are no names of the host system and have no edges (rules still judge them); null or repeated
page ids are judged row by row; other columns are ignored, or carried untouched by ``allowed``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.session import cut

Rule = tuple[str, str, str]  # verdict, host, path
MAX_RULES, MAX_HOST = 1000, 253
MASS, DAMPING = 10**15, 85  # whole mass of the seeds; percent of a mass that moves on
ROUNDS, THRESHOLD = 12, 1
LINK = r"""(?i)href[\t\n\f\r ]*=[\t\n\f\r ]*["']?[\t\n\f\r ]*(?:https?:)?//([^/?#"'>\t\n\f\r ]+)"""


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def location(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = lowered(F.regexp_extract(rest, r"\A[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def ruling(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    # of two verdicts for one text the larger word, "block", comes first
    ordered = sorted(sorted(rules, reverse=True), key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    found = None
    for verdict, name, start in ordered:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def located(pages: DataFrame, rules: list[Rule], url: str = "url", *more: Column) -> DataFrame:
    """host, path, rule, verdict (null without a rule) and the columns ``more`` of every row."""
    host, path = location(F.col(url).cast("string"))
    split = pages.select(*more, host.alias("host"), path.alias("path"))
    names = split.columns[: len(more)]
    ruled = split.withColumn("ruled", ruling(F.col("host"), F.col("path"), rules))
    return ruled.select(*names, "host", "path", "ruled.rule", "ruled.verdict")


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (src, dst) between unlike hosts."""
    host, _ = location(F.col(url).cast("string"))
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), 1), lowered))
    named = lambda c: (F.col(c) != "") & (F.length(c) <= MAX_HOST)
    # A page's own host comes along as a link to itself, so that hosts without links have their domains too.
    links = pages.select(host.alias("src"), F.explode(F.array_union(F.array(host), F.coalesce(found, F.array().cast("array<string>")))).alias("dst"))
    links = cut(links.where(named("src") & named("dst")).distinct())
    labels = links.select(F.col("dst").alias("host")).union(links.select("src")).distinct().select(F.split("host", r"\.").alias("l"))
    tail = lambda i: F.array_join(F.slice("l", i, F.size("l")), ".")
    pairs = F.transform(F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.struct(tail(i).alias("low"), tail(i + 1).alias("high")))
    tree = labels.where(F.size("l") > 2).select(F.inline(pairs)).distinct()
    return links.union(tree).union(tree.select("high", "low")).where("src <> dst").distinct()


def seeds(verdicts: DataFrame) -> DataFrame:
    """(host, trusted): hosts with more allowed than blocked urls, or the other way round; ``verdicts`` holds host and verdict."""
    balance = F.sum(F.when(F.col("verdict") == "allow", 1).when(F.col("verdict") == "block", -1))
    votes = verdicts.where("verdict is not null and host <> ''").groupBy("host").agg(balance.alias("n"))
    return votes.where("n <> 0").select("host", (F.col("n") > 0).alias("trusted"))


def propagate(edges: DataFrame, sown: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust): masses after ``rounds`` rounds from the seeds ``sown`` (host, trusted) over distinct ``edges``."""
    edges = cut(edges)
    arc = lambda a, b, kind: edges.select(F.col(a).alias("host"), F.col(b).alias("to"), F.lit(kind).alias("trusted"))
    arcs = arc("src", "dst", True).union(arc("dst", "src", False))
    degrees = arcs.groupBy("host", "trusted").agg(F.count(F.lit(1)).alias("degree"))
    arcs = cut(arcs.join(degrees, ["host", "trusted"]))
    share = sown.groupBy("trusted").agg(F.count(F.lit(1)).alias("seeds")).select("trusted", F.expr(f"{MASS} div seeds").alias("mass"))
    start = cut(sown.join(share, "trusted").select("host", "trusted", "mass"))  # two rows of shares: Spark broadcasts them itself
    again = start.select("host", "trusted", F.expr(f"(mass * {100 - DAMPING}) div 100").alias("mass"))
    state = start
    for _ in range(rounds):
        moved = arcs.join(state, ["host", "trusted"]).select(
            F.col("to").alias("host"), "trusted", F.expr(f"(mass * {DAMPING}) div (degree * 100)").alias("mass")
        )
        state = cut(moved.union(again).groupBy("host", "trusted").agg(F.sum("mass").alias("mass")))
    side = lambda kind, name: F.coalesce(F.sum(F.when(F.col("trusted") == F.lit(kind), F.col("mass"))), F.lit(0)).alias(name)
    return state.groupBy("host").agg(side(True, "trust"), side(False, "distrust"))


def blocked_hosts(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html", rounds: int = ROUNDS, threshold: int = THRESHOLD) -> DataFrame:
    """(host) whose distrust exceeds ``threshold`` times its trust."""
    masses = propagate(host_edges(pages, url, html), seeds(located(pages, rules, url)), rounds)
    return cut(masses.where(F.col("distrust") > F.col("trust") * threshold).select("host"))


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", html: str = "html", rounds: int = ROUNDS, threshold: int = THRESHOLD, carry: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages``, with ``carry`` also the whole row as ``row``."""
    more = [F.col(page_id).alias("page_id")] + ([F.struct(*[F.col(c) for c in pages.columns]).alias("row")] if carry else [])
    bad = blocked_hosts(pages, rules, url, html, rounds, threshold).select("host", F.lit("block").alias("graph"))
    rows = located(pages, rules, url, *more).join(bad, "host", "left")
    verdict = F.coalesce("verdict", "graph", F.lit("allow")).alias("verdict")
    return rows.select(*(["page_id", "row"] if carry else ["page_id"]), "host", "path", "rule", verdict)


def allowed(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html", rounds: int = ROUNDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``pages`` whose verdict is ``allow``, all columns as they were."""
    return judge(pages, rules, url, url, html, rounds, threshold, carry=True).where("verdict = 'allow'").select("row.*")
