"""Connected components and dense ordinals over tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of ``edges(a, b)``; the root is a component's smallest node.

    Large-star and small-star steps in turn, each a join over written tables, until every component is a star.
    """
    now = materialize(edges.filter("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    while True:
        last, both = now, now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written first, so that the joins' sides are plain tables: small ones are broadcast, hot partitions split.
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = materialize(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        drop(last, low)
        # After the large step every edge points to a smaller end.
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        hung = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        now = materialize(hung.filter("a <> b").distinct(), "small")
        drop(large, low)
        # Done when every node hangs on one smaller node, and that on none: then a component is a star.
        size = now.agg(F.count("*").alias("n"), F.countDistinct("a").alias("nodes")).first()
        if size.n == size.nodes and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """``df`` with each row's place from 1 in the given order, without bringing all rows to one task.

    Rows are range-sorted and written once; only the row count of each partition reaches the driver.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "ordered")
    part = F.shiftrightunsigned("__at", 33)
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()
    start, bases = 1, []
    for p, n in sorted((r.p, r.n) for r in sizes):
        bases.append((p, start))
        start += n
    table = df.sparkSession.createDataFrame(bases, "__p long, __base long")
    # One row a partition of the sort.
    joined = placed.withColumn("__p", part).join(F.broadcast(table), "__p")
    return joined.withColumn(name, F.col("__base") + F.col("__at") - F.shiftleft("__p", 33)).drop("__p", "__base", "__at")
