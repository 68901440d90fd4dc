"""URL filters: rules first, then trust and distrust propagated over the graph of hosts.

Hosts are linked by the absolute links of their pages, and a host to its parent domain; no edge leads
from a parent to its subdomains, so that neither rank passes from one to an unrelated sibling. Trust is
a personalised PageRank that starts from hosts by the share of their pages that rules allow; distrust
is one over the reversed edges, so that who links to a bad host is distrusted, and so are a bad
domain's subdomains. Distrust starts from blocked seeds: hosts of whose pages rules block at least half
(by that share) and listed ones. A host is blocked when its distrust is more than THRESHOLD of both
together. DataFrame functions only; edges are aggregated per pair of hosts before any iteration, ranks
are written to the shared folder every few iterations, and a hub's edges are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Steps end when the ranks of all hosts together change by no more than TOLERANCE of the seeds; what the
#: steps not taken could add is DAMPING / (1 - DAMPING) times that. MOST is reached by no damped walk before.
DAMPING, CUT, TOLERANCE, MOST = 0.85, 3, 1e-6, 90
THRESHOLD = 0.5
#: Share of its pages that rules block from which a host is a blocked seed.
BLOCKED_SHARE = 0.5
#: By default, a host with one of these words among the words of its name is a blocked seed, too.
BLOCKED_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "warez", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    """What follows the first ://, empty for a null or one without."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits; rules are few and become one expression."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        h, p = split_rule(rule)
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def host_edges(pages: DataFrame, html: str | None) -> DataFrame:
    """(src, dst, w): links between different hosts of pages (host, html), and from hosts to their parent domains."""
    up = F.regexp_replace("host", r"^[^.]+\.", "")
    out = pages.where(F.col("host").rlike(r"^[^.]+\.[^.]+\.[^.]+")).select(F.col("host").alias("src"), up.alias("dst")).groupBy("src", "dst").agg(F.lit(1.0).alias("w"))
    if html is not None:
        links = pages.select("host", F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), 1)).alias("dst"))
        links = links.select(F.col("host").alias("src"), F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
        out = out.unionByName(links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")))
    return out.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, w) and seeds (host, trust, distrust)."""
    away = edges.groupBy("src").agg(F.sum("w").alias("away"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("into"))
    edges = materialize(edges.join(away, "src").join(into, "dst").select("src", "dst", (DAMPING * F.col("w") / F.col("away")).alias("forth"), (DAMPING * F.col("w") / F.col("into")).alias("back")))
    start = materialize(seeds.select("host", ((1 - DAMPING) * F.col("trust")).alias("trust"), ((1 - DAMPING) * F.col("distrust")).alias("distrust")).where("trust > 0 or distrust > 0"))

    def moved(rank: DataFrame) -> DataFrame:
        """What a step along the edges brings to each host."""
        forth = edges.join(rank.where("trust > 0"), edges.src == F.col("host")).select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("trust"), F.lit(0.0).alias("distrust"))
        back = edges.join(rank.where("distrust > 0"), edges.dst == F.col("host")).select(F.col("src").alias("host"), F.lit(0.0).alias("trust"), (F.col("distrust") * F.col("back")).alias("distrust"))
        return forth.unionByName(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))

    # the rank is the sum of what each step brings; a host that gets less and less is one row of each
    mass = start.agg(F.sum("trust") + F.sum("distrust")).first()[0] or 0.0
    rank = step = start
    for _ in range(0, MOST, CUT):
        steps = []
        for _ in range(CUT):
            step = moved(step)
            steps.append(step)
        # each step is the next one's input: written one by one, three together in the rank
        step = materialize(steps[-1])
        total = rank
        for s in [*steps[:-1], step]:
            total = total.unionByName(s)
        before, rank = rank, materialize(total.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
        if before is not start:
            discard(before)
        left = step.agg(F.sum("trust") + F.sum("distrust")).first()[0] or 0.0
        if left <= tolerance * mass:
            break
    return rank


def filter_urls(pages: DataFrame, rules: dict[str, str], url: str = "url", html: str | None = "html", blocked_words: tuple[str, ...] = BLOCKED_WORDS, id_col: str = "page_id", blocked_hosts: DataFrame | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict) per row of pages; rules: {rule: 'allow' or 'block'}.

    blocked_hosts: a table with a column host, more seeds of distrust.

    A null url, or one without ://, has an empty host and path, which no rule fits and which is
    allowed. A host without trust or distrust is allowed. Repeated rows are judged alike; an empty
    table gives no rows. A null html has no links."""
    src = pages.select(F.col(id_col), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), *([F.col(html)] if html else []))
    src = src.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule, v in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(v)).otherwise(verdict)
    allowed = F.col("rule").isin([r for r, v in rules.items() if v == "allow"])
    words = F.split(F.col("host"), r"[.\-_0-9:@]+")
    refused = F.col("rule").isin([r for r, v in rules.items() if v == "block"])
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    seeds = src.where("host <> ''").groupBy("host").agg(share(allowed).alias("trust"), share(refused).alias("refused"))
    listed = F.arrays_overlap(words, F.array(*[F.lit(w) for w in blocked_words])) if blocked_words else F.lit(False)
    if blocked_hosts is not None:
        seeds = seeds.join(blocked_hosts.select("host").distinct().withColumn("known", F.lit(True)), "host", "left")
        listed = listed | F.coalesce(F.col("known"), F.lit(False))
    seeds = seeds.withColumn("distrust", F.when(listed, 1.0).when(F.col("refused") >= BLOCKED_SHARE, F.col("refused")).otherwise(0.0))
    seeds = seeds.withColumn("trust", F.when(F.col("distrust") > 0, 0.0).otherwise(F.col("trust")))
    rank = propagate(host_edges(src.where("host <> ''"), html), seeds)
    bad = rank.where(F.col("distrust") > THRESHOLD * (F.col("trust") + F.col("distrust"))).select("host", F.lit(True).alias("bad"))
    out = src.drop(*([html] if html else [])).join(bad, "host", "left")
    method = F.when(F.col("bad"), "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce(verdict, method).alias("verdict"))
