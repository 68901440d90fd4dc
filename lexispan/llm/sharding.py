"""Reproducible shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to N-1 by their values (not by file or partition), the number is permuted by a
keyed bijection of [0, N), and the permuted number p gives shard p mod n and slot p div n. So shard
sizes differ by one at most, slots have no gap, and each row's place can be computed, or turned back
into its row number, without a table.

Only DataFrame functions run here. Repeated rows are counted before the sort and expanded after it,
so that a value that makes up a third of all rows is one row while it is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROUNDS = 6
_P = 2**31 - 1
_KEYS = (402653189, 805306457, 1610612741, 201326611, 100663319, 50331653)
_WALK = 64
_EXPLODE = 10_000


def radices(n: int) -> tuple[int, int]:
    """a * b >= n with fewer than a numbers to spare, both near the square root."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _round(x: Column, key: Column) -> Column:
    y = (x + key) % F.lit(_P)
    z = (y * y % F.lit(_P) * y + F.lit(12345)) % F.lit(_P)
    return F.shiftright(z, 7) + z * F.lit(3)


def _mod(x: Column, m: int) -> Column:
    return F.pmod(x, F.lit(m).cast("long"))


def round_keys(seed: int) -> list[int]:
    return [(k + seed * 7919) % _P for k in _KEYS]


def feistel(x: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """One pass of the network over [0, a*b): x is split into x div b (below a) and x mod b.

    The rounds run in an aggregate over their keys, two a step, so that no expression nests."""
    a, b = radices(n)
    keys = round_keys(seed)
    pairs = [F.struct(F.lit(keys[k]).cast("long").alias("l"), F.lit(keys[k + 1]).cast("long").alias("r")) for k in range(0, ROUNDS, 2)]

    def forward(s: Column, k: Column) -> Column:
        left = _mod(s["l"] + _round(s["r"], k["l"]), a)
        return F.struct(left.alias("l"), _mod(s["r"] + _round(left, k["r"]), b).alias("r"))

    def backward(s: Column, k: Column) -> Column:
        right = _mod(s["r"] - _round(s["l"], k["r"]), b)
        return F.struct(_mod(s["l"] - _round(right, k["l"]), a).alias("l"), right.alias("r"))

    start = F.struct(((x - _mod(x, b)) / F.lit(b)).cast("long").alias("l"), _mod(x, b).alias("r"))
    steps = F.array(*(pairs[::-1] if inverse else pairs))
    return F.aggregate(steps, start, backward if inverse else forward, lambda s: s["l"] * F.lit(b) + s["r"])


def permute(x: Column, n: int, seed: int = 0, inverse: bool = False) -> Column:
    """A bijection of [0, n): the network is applied again while its value is n or more.

    Under sqrt(n) values lie beyond n. Below 4096 rows they are fewer than the steps allowed, and no
    walk visits one twice, so every walk ends; above, a walk of 64 steps has odds under 2**-384, and
    one that did not end would raise an error."""
    if n <= 1:
        return x * F.lit(0)
    step = lambda v, _: F.when(v < n, v).otherwise(feistel(v, n, seed, inverse))
    end = lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    # every row takes the first pass; only those beyond n walk on
    walk = lambda v: F.when(v < n, v).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), v, step, end))
    return F.transform(F.array(feistel(x, n, seed, inverse)), walk)[0]


def number_rows(df: DataFrame, order_by: list[str]) -> tuple[DataFrame, int]:
    """df with row_number, its place from 0 in the order of order_by and then of its other columns, and N.

    Ties in all columns are repeated rows, which are alike: any order of them is the same result."""
    order = [*order_by, *[c for c in df.columns if c not in order_by]]
    grouped = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__count"))
    part = materialize(grouped.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order]).withColumn("__part", F.spark_partition_id()))
    # a row for each partition of the sort, so the window over all of them is small
    sums = part.groupBy("__part").agg(F.sum("__count").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), "__n")
    n = part.agg(F.sum("__count")).first()[0] or 0
    within = Window.partitionBy("__part").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    placed = part.withColumn("__at", F.coalesce(F.sum("__count").over(within), F.lit(0))).join(F.broadcast(sums.drop("__n")), "__part")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__count") - 1) / _EXPLODE)))
    placed = placed.withColumn("__block", block)
    size = F.least(F.lit(_EXPLODE).cast("long"), F.col("__count") - F.col("__block") * _EXPLODE)
    placed = placed.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
    number = F.col("__before") + F.col("__at") + F.col("__block") * _EXPLODE + F.col("__i")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], number.cast("long").alias("row_number")), int(n)


def shard_rows(df: DataFrame, n_shards: int, order_by: list[str], seed: int = 0) -> DataFrame:
    """df with row_number, shard (0 to n_shards-1) and slot (from 0, without gaps).

    Nulls sort first; an empty table gives an empty result; a df that has columns of these three
    names loses them to the result's. Map columns can't be grouped and aren't supported."""
    df = df.drop("row_number", "shard", "slot")
    rows, n = number_rows(df, order_by)
    p = permute(F.col("row_number"), n, seed)
    rows = rows.withColumn("__p", p)
    shard = _mod(F.col("__p"), n_shards)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], "row_number", shard.cast("int").alias("shard"), ((F.col("__p") - shard) / n_shards).cast("long").alias("slot"))


def row_number_of(shard: Column, slot: Column, n: int, n_shards: int, seed: int = 0) -> Column:
    """The global row number that lies at this slot of this shard."""
    return permute(slot * F.lit(n_shards) + shard, n, seed, inverse=True)
