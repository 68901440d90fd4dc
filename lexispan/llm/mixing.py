"""Mixing sources to target weights by Poisson replication.

Each document of source s is repeated k times, k drawn from a Poisson distribution whose mean is the
repetition rate that brings s to its target weight: weight * total / rows of s. The draw inverts the
distribution at a number hashed from the seed and the id, so it needs no state, does not depend on
partitions and is the same on each run. The copies are then put in the order of a hash over all.
DataFrame functions only; the counts per source are aggregated before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A mean beyond this is drawn as a sum of equal parts, so that exp(-mean) stays exact.
PART = 32.0
_EXPLODE = 10_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and parts."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def poisson(u: Column, mean: Column) -> Column:
    """The least k whose Poisson distribution function exceeds u; mean is PART at most."""
    zero = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.when(s["cdf"] > u, s).otherwise(F.struct(i.cast("int").alias("k"), p.alias("p"), (s["cdf"] + p).alias("cdf")))

    most = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    return F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda s: s["k"])


def repetitions(rate: Column, seed: int, key: Column) -> Column:
    """How often a document is repeated."""
    parts = F.greatest(F.lit(1), F.ceil(rate / PART).cast("int"))
    one = poisson(uniform(seed, key, F.lit(0)), rate)
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, j: acc + poisson(uniform(seed, key, j), rate / parts))
    return F.when(rate <= 0, 0).when(parts == 1, one).otherwise(many)


def source_rates(df: DataFrame, source: str, weights: dict[str, float] | None, total: int | None, alpha: float) -> DataFrame:
    """(source, rate). Without weights a source's weight is its rows to the power alpha."""
    rows = df.groupBy(F.col(source).alias("__source")).agg(F.count(F.lit(1)).alias("__rows"))
    if weights is None:
        weight = F.pow(F.col("__rows").cast("double"), F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("__source") == name, F.lit(float(w))).otherwise(weight)
    rows = materialize(rows.withColumn("__weight", weight))
    weighed, count = rows.agg(F.sum("__weight"), F.sum("__rows")).first()
    goal = float(total if total is not None else count or 0)
    return rows.select("__source", (F.col("__weight") * F.lit(goal / (weighed or 1.0)) / F.col("__rows")).alias("__rate"))


def mix_sources(df: DataFrame, weights: dict[str, float] | None = None, *, total: int | None = None, alpha: float = 0.5, seed: int = 0, source: str = "source", key: str = "doc_id") -> DataFrame:
    """df's rows repeated to the target weights, with copy (int from 0) and shuffle_key, in its order.

    A weight of 0, or a source that weights lacks, gives no rows; a null source is a source of its
    own. Rows of one key are drawn alike, and a null key counts as empty text. total is the expected
    number of rows, df's own by default. Own columns named copy or shuffle_key are replaced."""
    own = [c for c in df.columns if c not in ("copy", "shuffle_key")]
    # a table of known size: the engine broadcasts it while that is small, else joins on the source and splits hot ones
    rates = source_rates(df, source, weights, total, alpha)
    out = df.select(*[F.col(f"`{c}`") for c in own]).withColumn("__source", F.col(source))
    out = out.join(rates.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s")))
    n = repetitions(F.col("__rate"), seed, F.col(key))
    out = out.withColumn("__n", n).where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("copy").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in own], "copy", order.alias("shuffle_key")).orderBy("shuffle_key")
