import random

from pyspark.sql import functions as F

from arbolex.operators.joins import hot_join, hottest
from arbolex.operators.numbering import number_rows


def test_numbers_and_running_sums_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", i, rng.randrange(100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    got = number_rows(df, ["k"], by=["g"], group_size="size", running={"cum": "v"}).collect()
    want, seen = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        rn, total = seen.get(g, (0, 0))
        seen[g] = (rn + 1, total + v)
        want[k] = (rn + 1, total + v)
    assert len(got) == len(rows)
    for r in got:
        assert (r.rn, r.cum) == want[r.k]
        assert r.size == seen[r.g][0]


def test_whole_table_numbering(spark):
    df = spark.range(1000).repartition(5).withColumn("w", (F.col("id") * 37) % 1009)
    got = {r.w: r.rn for r in number_rows(df, [F.col("w").desc()]).collect()}
    order = sorted(got, reverse=True)
    assert [got[w] for w in order] == list(range(1, 1001))


def test_hot_join_equals_plain_join(spark):
    left = spark.createDataFrame([(w, i) for i, w in enumerate("aaaaabbcdde")], "word string, i int")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4), ("z", 9)], "word string, id int")
    counts = left.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    for how in ("left", "inner"):
        hot = hottest(counts, ["word"], limit=3)
        got = sorted((tuple(r) for r in hot_join(left, right, ["word"], hot, how).collect()), key=str)
        want = sorted((tuple(r) for r in left.join(right, ["word"], how).collect()), key=str)
        assert got == want
