"""URL filter: explicit rules, then trust and distrust spread over the host graph.

Pages that a rule fits seed the graph: personalised PageRank carries trust from
the hosts of allowed pages along their edges, and distrust from the hosts of
blocked pages against the edges. Edges are links to other hosts, and every page
also counts as a link from its host to the domain above, and from that on to the
next: a domain gains from trusted subdomains, and a subdomain of a distrusted
domain is distrusted. A host with more distrust than trust is blocked for its
pages without a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The host in any attribute whose value is an absolute url.
LINK = r"""(?i)\s[a-z][a-z0-9:-]*\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, ROUNDS = 0.85, 10
#: Distrust that is over trust by less than this share of itself counts as equal: sums differ in their last digits with the order of their rows.
EQUAL = 1e-9


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as a struct (length, rule, verdict), or null. The rules are a short configured list, at most 1,000."""
    if len(rules) > 1000:
        raise ValueError("at most 1,000 rules")
    fits = []
    for verdict, rule in rules:
        of, _, prefix = rule.partition("/")
        fit = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{prefix}")
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: how many pages of a host, or of one below it, lead to another host.

    A page leads to each host that any attribute of its html links to, and up
    from its own host to the domain without the first label, and so on to the
    domain of two labels. Hosts of digits and stops alone have no domain.
    """
    own = F.col("host")
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    labels = F.split(own, r"\.")
    above = lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), ".")
    climbs = F.when((F.size(labels) > 2) & ~own.rlike(r"^[0-9.:]*$"), F.transform(F.sequence(F.lit(0), F.size(labels) - 3), lambda k: F.struct(above(k).alias("src"), above(k + 1).alias("dst"))))
    edges = F.concat(F.transform(targets, lambda h: F.struct(own.alias("src"), h.alias("dst"))), F.coalesce(climbs, F.array().cast("array<struct<src:string,dst:string>>")))
    pairs = pages.select(host_of(F.col("url")).alias("host"), "html").select(F.explode(edges).alias("e")).select("e.*")
    return pairs.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _settled(mass: DataFrame, asked: DataFrame, damping: float, ratio: float) -> bool:
    """Whether further rounds can turn no verdict of the hosts ``asked``: one row comes to the driver."""
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)).otherwise(0.0))
    rows = mass.select("kind", "host", "score", "change", "new").unionByName(asked.select(F.lit("asked").alias("kind"), "host"), allowMissingColumns=True)
    hosts = rows.groupBy("host").agg(
        of("trust", "score").alias("trust"), of("distrust", "score").alias("distrust"), (of("distrust", "change") + ratio * of("trust", "change")).alias("change"),
        F.max("new").alias("new"), F.max(F.col("kind") == "asked").alias("asked"),
    )
    gap = F.greatest(F.abs(F.col("distrust") * (1 - EQUAL) - ratio * F.col("trust")), EQUAL * F.col("distrust"))
    contested = F.col("asked") & (F.col("trust") > 0) & (F.col("distrust") > 0)
    row = hosts.agg(F.max("new").alias("new"), F.sum("change").alias("change"), F.min(F.when(contested, gap)).alias("gap")).first()
    return not row.new and (row.gap is None or row.change * damping / (1 - damping) <= row.gap)


def standing(judged: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, ratio: float = 1.0) -> DataFrame:
    """``(host, trust, distrust)`` of hosts that any reaches.

    ``judged`` has ``host, verdict`` (of a rule, or null) for each page. Both
    walks go together, told apart by ``kind``; each round is one join of what
    the last one added with the links and one sum that combines before its
    shuffle. After ``rounds`` of them the walks go on until no new host is
    reached and what is still on its way can turn no verdict; scores are the
    sums up to there. What reaches a host that leads nowhere stays there: it is
    counted, and does not go back to the seeds.
    """
    seen = judged.where("verdict is not null and host <> ''").groupBy("host", "verdict").agg(F.count("*").cast("double").alias("n"))
    seeds = cut(seen.select(F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host", "n"))
    total = {row.kind: row.n for row in seeds.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # two rows at most
    share = F.col("n") / F.when(F.col("kind") == "trust", F.lit(total.get("trust", 1.0))).otherwise(F.lit(total.get("distrust", 1.0)))
    start = seeds.select("kind", "host", (share * (1 - damping)).alias("score"))
    found = cut(links)
    mass = start.withColumn("change", F.col("score")).withColumn("new", F.lit(1))
    if total and not found.isEmpty():
        away = found.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
        back = found.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
        steps = away.unionByName(back)
        out = steps.groupBy("kind", "host").agg(F.sum("n").alias("all"))
        steps = cut(steps.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all") * damping).alias("share")))
        asked = cut(judged.where("verdict is null and host <> ''").select("host").distinct())
        done = 0
        while done < rounds or not _settled(mass, asked, damping, ratio):
            added = (F.col("change") * F.col("share")).alias("change")
            moved = mass.where("change > 0").join(steps, ["kind", "host"]).select("kind", F.col("to").alias("host"), added).withColumn("score", F.col("change"))
            both = mass.select("kind", "host", F.lit(0.0).alias("change"), "score", F.lit(0).alias("new")).unionByName(moved.withColumn("new", F.lit(1)))
            mass = cut(both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("change").alias("change"), F.min("new").alias("new")))
            done += 1
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    return mass.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def over(trust: Column, distrust: Column, ratio: float) -> Column:
    """Whether distrust is over ``ratio`` times trust, however small both are."""
    return distrust * (1 - EQUAL) > ratio * trust


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, ratio: float = 1.0) -> DataFrame:
    """Judge every page's url: ``page_id, host, path, rule, verdict, trust, distrust``.

    A rule fits its host and all subdomains, if the path starts with the rule's
    path; the longest wins, and of equally long ones the last in string order.
    Without a rule the verdict is ``block`` where the host's distrust is over
    ``ratio`` times its trust (by more than EQUAL of itself; scores are not
    rounded), else ``allow``; a host that nothing reaches is
    allowed. A null url, or one without ``://``, has an empty host and path, no
    rule, and is allowed. Null html has no links; long html counts whole. Null page ids are kept;
    repeated rows come out repeated and weigh as often. Other columns are not
    looked at.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    reached = cut(standing(judged.select("host", F.col("fit.verdict").alias("verdict")), host_links(pages), ratio=ratio))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("fit.verdict", F.when(over(trust, distrust, ratio), "block").otherwise("allow"))
    return judged.join(reached, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
