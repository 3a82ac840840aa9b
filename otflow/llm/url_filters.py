"""URL filters: rules first, then link-graph propagation for what no rule fits.

Trust flows forward along host edges from hosts with allowed pages (personalised
PageRank), distrust flows backward from hosts with blocked pages: a host that
links to bad hosts is suspect. Each kind of seed has a mass of one in all, shared
by pages. A host whose share of distrust exceeds the threshold is blocked.

Edges are links in html to another host, and one in each direction between a host
and its parent domain (``blog.example.org`` and ``example.org``; domains of two
labels have no parent), so that hosts of one domain, and hosts without links, have
a neighbourhood. All steps are DataFrame operations; pages are reduced to host
pairs before the graph is built, so that a host with a third of all pages is one
vertex, and scores come back to the pages of hosts with more than a thousandth of
all rows (a thousand hosts at most) by a broadcast, to all others by a shuffle.

Nulls and oddities: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed. Repeated rows are judged one by one, each
adds to its host's evidence. Null html has no links. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules become literals of the plan; longer lists are refused rather than shipped unchecked.
MAX_RULES = 20_000


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def best_rule(host: Column, path: Column, allow: list[str], block: list[str]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does.

    A map from a rule's host to its paths is looked up for each suffix of the
    host, so that the work per page follows the host's labels, not the rules."""
    if len(allow) + len(block) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rules = sorted({(*split_rule(r), r, v) for v, rs in (("allow", allow), ("block", block)) for r in rs})
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    entry = lambda p, r, v: F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"))
    by_host = F.create_map(*itertools.chain.from_iterable((F.lit(h), F.array(*[entry(p, r, v) for _, p, r, v in g])) for h, g in itertools.groupby(rules, key=lambda x: x[0])))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(by_host, s)), lambda x: x.isNotNull())), lambda x: F.startswith(path, x["path"]))
    ranked = F.transform(fitting, lambda x: F.struct(F.length(x["rule"]).alias("n"), x["rule"].alias("rule"), x["verdict"].alias("verdict")))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links in html to another host. Relative links stay within a host and add nothing."""
    target = F.explode(F.regexp_extract_all("html", F.lit(r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), 1))
    links = pages.where(F.contains("html", F.lit("//"))).select("host", target.alias("link"))
    full = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return links.select(F.col("host").alias("src"), host_of(full).alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def domain_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): an edge in each direction between hosts, or their domains, and the next domain above."""
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = hosts.where(F.size(labels) > 2).select(F.explode(F.arrays_zip(F.slice(chain, 1, F.size(chain) - 1).alias("a"), F.slice(chain, 2, F.size(chain)).alias("b"))).alias("x")).select("x.a", "x.b").distinct()
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return steps.select(ends.alias("x")).select("x.src", "x.dst", F.lit(1.0).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 10, cut_every: int = 5) -> DataFrame:
    """Personalised PageRank of several kinds at once.

    edges: (kind, src, dst, weight); seeds: (kind, host, mass). Mass of vertices
    without outgoing edges is lost to the graph, which only scales what they
    would have passed on. Returns (kind, host, mass)."""
    total = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    share = materialise(edges.join(total, ["kind", "src"]).select(F.col("kind").alias("of"), "src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    if share.isEmpty():
        return seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass"))
    start = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass"))
    mass = start
    for step in range(1, iterations + 1):
        moved = mass.join(share, (F.col("kind") == F.col("of")) & (F.col("host") == F.col("src"))).select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
        mass = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if step % cut_every == 0:
            mass = materialise(mass)
    return mass


def filter_urls(pages: DataFrame, allow: list[str], block: list[str], threshold: float = 0.5, **graph) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row of ``pages``.

    ``verdict`` is the longest fitting rule's; without one, ``block`` if the
    host's distrust is more than ``threshold`` of its trust and distrust, else
    ``allow`` (also where it has neither)."""
    judged = pages.select("page_id", "html", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path")).withColumn("best", best_rule(F.col("host"), F.col("path"), allow, block))
    of = lambda verdict: F.sum(F.when(F.col("best.verdict") == verdict, 1.0).otherwise(0.0))
    hosts = materialise(judged.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), of("allow").alias("allow"), of("block").alias("block")))
    total = hosts.agg(F.sum("pages").alias("pages"), F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    seeds = [hosts.where(F.col(kind) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(kind) / F.lit(total[kind] or 1.0)).alias("mass")) for kind in ("allow", "block")]
    links = host_links(judged).unionByName(domain_links(hosts.where("host <> ''"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    edges = links.select(F.lit("allow").alias("kind"), "src", "dst", "weight").unionByName(links.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    mass = propagate(edges, seeds[0].unionByName(seeds[1]), **graph)
    scores = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "allow", F.col("mass")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "block", F.col("mass")).otherwise(0.0)).alias("distrust"))
    scores = materialise(hosts.select("host", "pages").join(scores, "host"))
    hot = F.col("pages") * 1000 > F.lit(total["pages"] or 0)
    many = F.broadcast(scores.where(hot).select(F.col("host").alias("_host"), F.col("trust").alias("_trust"), F.col("distrust").alias("_distrust")))  # less than 1,000 rows
    few = scores.where(~hot).select(F.col("host").alias("_key"), "trust", "distrust")
    held = judged.drop("html").join(many, F.col("host") == F.col("_host"), "left")
    # pages of hot hosts have no partner in the second join and are spread over its tasks
    key = F.when(F.col("_host").isNotNull(), F.concat(F.lit(" "), F.xxhash64("page_id", "path").cast("string"))).otherwise(F.col("host"))
    held = held.withColumn("_of", key).join(few, F.col("_of") == F.col("_key"), "left")
    held = held.withColumns({k: F.coalesce(f"_{k}", k, F.lit(0.0)) for k in ("trust", "distrust")})
    own = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit("block")).otherwise(F.lit("allow"))
    return held.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), own).alias("verdict"), "trust", "distrust")
