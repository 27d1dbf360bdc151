"""Mixing sources to target weights on a low-discrepancy schedule.

Sources in order of their names get the weights of a cycle; together they shall fill a total of words. A source gives
at most ``repeats`` times its words, and what it cannot give is shared by weight among the others.

The mix is a schedule of slots. Slot ``i`` maps the golden-ratio point ``frac(i * phi)`` through the cumulative target
shares, which gives its source; any stretch of slots so holds the sources near their shares. The slots of a source are
ranked, and its target is cut into as many blocks of equal words: slot rank ``r`` takes block ``r`` of the source's
documents, which stand in an order shuffled by a hash of their id and start over when they are used up. A source that
the schedule misses gets one slot after its end.

Everything is a DataFrame expression. Ranks and running sums are taken in two levels, inside bounded buckets and over
the buckets' sums, so a source that holds a third of all rows is no single task; slots meet documents by block number.

Defined results. A null text has no words; a document without words is taken with 0. The null source is a source of
its own, the last. Rows that share an id are documents of their own next to each other in the shuffled order; rows
equal in id and size may share what is taken either way. Rows without id stand anywhere in that order. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolex.session import materialize

# The golden ratio's fraction in units of 2^-31.
GOLDEN, UNIT = 1327217885, 1 << 31
#: words in a block, documents in a bucket, slots in a stretch, cells of the unit interval
BLOCK, BUCKET, STRETCH, GRID = 1000, 2000, 4096, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """source, source_size, docs, target: one row per source; few rows, whatever the number of documents.

    A source is capped if ``repeats * size`` lies below its share of what the uncapped ones still have to give. In the
    order of capacity per weight the capped ones come first, so one running sum settles all rounds of resharing.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * repeats)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    rest = first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
        # the first source that is not capped sets the level of all that follow
        .withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return rows.select("source", "source_size", "docs", "total", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """source, rank, slots, words: every slot with its rank in its source and the source's number of slots."""
    spark = targets.sparkSession
    # one task over one row per source
    upto = Window.orderBy(F.col("source").asc_nulls_last())
    shares = targets.where("target > 0").select(
        "source", F.round("target").cast("long").alias("words"), F.sum("target").over(upto).alias("hi"), "target"
    )
    whole = F.max("hi").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shares = shares.select("source", "words", ((F.col("hi") - F.col("target")) / whole).alias("lo"),
                           F.when(F.col("hi") == whole, F.lit(2.0)).otherwise(F.col("hi") / whole).alias("hi"))
    total = targets.agg(F.max("total")).first()[0] or 0
    n = max(1, -(-total // block))
    slots = spark.range(n).select(
        F.col("id").alias("slot"), (F.pmod(F.pmod("id", F.lit(UNIT)) * GOLDEN, F.lit(UNIT)) / F.lit(float(UNIT))).alias("u")
    )
    slots = slots.withColumn("cell", F.floor(F.col("u") * GRID))
    cells = shares.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1))))
    )
    dealt = slots.join(cells, "cell").where("u >= lo and u < hi").select("source", "slot", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    dealt = materialize(dealt, "slots")
    stretches = dealt.groupBy("source", "stretch").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(
        "source", "stretch", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("source")).alias("slots"),
    )
    inside = Window.partitionBy("source", "stretch").orderBy("slot")
    ranked = same_source(dealt.withColumn("place", F.row_number().over(inside) - 1), stretches, "stretch").select(
        "source", (F.col("before") + F.col("place")).alias("rank"), "slots"
    )
    found = stretches.groupBy("source").agg(F.max("slots").alias("slots"))
    missed = same_source(shares.select("source", "words"), found, how="left").where("slots is null")
    ranked = ranked.unionByName(missed.select("source", F.lit(0).cast("long").alias("rank"), F.lit(1).cast("long").alias("slots")))
    return same_source(ranked, shares.select("source", "words"))


def same_source(left: DataFrame, right: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """Join on the source, null being equal to null, and on further columns; the left side's columns stay."""
    right = right.select([F.col(c).alias(f"_{c}") if c in ("source", *more) else F.col(c) for c in right.columns])
    on = F.col("source").eqNullSafe(F.col("_source"))
    for c in more:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return left.join(right, on, how).drop("_source", *[f"_{c}" for c in more])


def laid_out(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The documents with the first word (``at``) of each on the line of its source, in shuffled order."""
    counts = targets.select("source", "source_size", "target", "docs")
    rows = same_source(sizes, F.broadcast(counts) if counts.count() <= 10_000 else counts)
    mark = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    buckets = F.ceil(F.col("docs") / BUCKET)
    rows = rows.withColumn("bucket", F.floor(mark * buckets / F.lit(1 << 32)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return same_source(rows, sums, "bucket").withColumn("at", F.col("before") + F.col("within")).drop("before", "within", "bucket", "docs")


def mixed(
    documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, block: int = BLOCK, seed: str = "mix",
    row: str | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; the mix has as many words as all documents.

    ``row`` names a column that tells the rows apart; it is returned too, and needed to find the rows again where ids
    are null or repeated.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    sizes = documents.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), number.alias("row")
    )
    # rows without id are told apart by their number, so that they fall into many buckets
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", F.lit("row"), F.col("row").cast("string")))
    sizes = materialize(sizes.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), name))), "sizes")
    targets = materialize(source_targets(sizes, weights, repeats), "targets")
    slots = schedule(targets, block)
    # slot r of n takes the words [r * words / n, (r + 1) * words / n) of the source's endlessly repeated line
    edge = lambda r: F.floor(F.col("words") * r / F.col("slots"))
    taken = slots.select("source", "rank", edge(F.col("rank")).alias("from"), edge(F.col("rank") + 1).alias("to"))
    lines = same_source(
        materialize(laid_out(sizes, targets), "line").where("size > 0 and target > 0"),
        slots.groupBy("source").agg(F.max("slots").alias("slots"), F.max("words").alias("words")),
    )
    lines = lines.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats)))).withColumn(
        "first", F.col("at") + F.col("turn") * F.col("source_size")
    )
    lines = lines.withColumn("end", F.least(F.col("first") + F.col("size"), F.col("words"))).where("first < end")
    # ranks whose blocks can touch the document: one more on either side against rounding
    touch = lambda word: F.floor(F.col(word) * F.col("slots") / F.col("words"))
    lines = lines.withColumn(
        "rank", F.explode(F.sequence(F.greatest(touch("first") - 1, F.lit(0)), F.least(touch("end") + 1, F.col("slots") - 1)))
    ).select("row", "source", "rank", "first", "end")
    overlap = F.least("end", "to") - F.greatest("first", "from")
    got = (
        same_source(lines, taken, "rank")
        .select("row", overlap.alias("words"))
        .where("words > 0")
        .groupBy("row")
        .agg(F.sum("words").alias("taken"))
    )
    with_target = same_source(sizes, F.broadcast(targets) if targets.count() <= 10_000 else targets)
    return with_target.join(got, "row", "left").select(
        "doc_id", *([F.col("row").alias(row)] if row else []), "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )
