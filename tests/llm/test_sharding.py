from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexispan.llm.sharding import permute, radices, row_number_of, shard_rows


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation_and_inverse(spark, n):
    df = spark.range(n).select("id", permute(F.col("id"), n, 5).alias("p"))
    rows = df.select("id", "p", permute(F.col("p"), n, 5, inverse=True).alias("back")).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)
    if n == 1000:
        assert sum(abs(r.p - r.id) < 50 for r in rows) < 200
        other = [r.p for r in spark.range(n).select(permute(F.col("id"), n, 6).alias("p")).collect()]
        assert other != [r.p for r in rows]


def test_spare_places_are_few():
    for n in [*range(1, 500), 10**6, 10**9 + 7]:
        a, b = radices(n)
        assert n <= a * b < n + a


def shards(spark, rows, n_shards, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as shard", "1 as slot")
    return shard_rows(df, n_shards, ["doc_id"], **kw).collect()


def test_laws_and_edges(spark):
    rows = [(i, f"t{i}") for i in range(101)] + [(None, None), (None, None), (5, "t5"), (5, "t5"), (7, None), (8, "")]
    out = shards(spark, rows, 8, seed=3)
    assert sorted(((r.doc_id is not None, r.doc_id, r.text) for r in out), key=repr) == sorted(((d is not None, d, t) for d, t in rows), key=repr)
    per = Counter(r.shard for r in out)
    assert max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(per[s]))
    assert sorted(r.row_number for r in out) == list(range(len(rows)))
    again = shards(spark, rows[::-1], 8, seed=3)
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))
    back = spark.createDataFrame([(r.shard, r.slot, r.row_number) for r in out], "s long, t long, n long")
    assert back.where(row_number_of(F.col("s"), F.col("t"), len(rows), 8, 3) != F.col("n")).count() == 0
    assert shards(spark, [], 8) == []


def test_a_hot_row_is_spread(spark):
    out = shards(spark, [(1, "x")] * 25_000 + [(2, "y")], 4)
    assert sorted(Counter(r.shard for r in out).values()) == [6250, 6250, 6250, 6251]
