"""Prefix scans over ordered groups of any size.

Rows are sorted into ranges, so a group of any size is spread over tasks.  Each range is scanned by itself, then the totals
of ranges (a row for each group and range), then both are put together: a place in a group, a rate limit's start times
(a running maximum), an ordered running average (a composition of affine maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

#: Rows of a group that one step folds.
CHUNK = 4096


def _ranged(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``__range``, the range of the sort that a row lies in, and ``__i``, its place from 0 in its group there."""
    placed = df.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id())
    return placed.withColumn("__i", F.row_number().over(W.partitionBy(key, "__range").orderBy(*order)) - 1)


def _totals(scanned: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """For each group and range ``aggs``, and ``__base``, the group's rows in earlier ranges."""
    t = scanned.groupBy(key, "__range").agg(F.count("*").alias("__n"), *aggs)
    earlier = W.partitionBy(key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    return t.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).cast("long"))


def with_place(df: DataFrame, key: str, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with each row's place from 0 in its group, by ``order``, which tells a group's rows apart (else ties fall as they may)."""
    scanned = materialize(_ranged(df, key, order), "ranged")
    totals = _totals(scanned, key).select(F.col(key).alias("__key"), "__range", "__base")
    joined = scanned.alias("s").join(totals.alias("t"), F.col(f"s.{key}").eqNullSafe(F.col("t.__key")) & (F.col("s.__range") == F.col("t.__range")))
    return joined.select(*(F.col(f"s.{c}") for c in df.columns), (F.col("t.__base") + F.col("s.__i")).alias(name))


def rate_limited(requests: DataFrame, rate: float, key: str = "host", at: str = "arrival", order: list[str] = ("id",), name: str = "start") -> DataFrame:
    """``requests`` with the time at which each may start: at most ``rate`` a second in each group, a burst of one, in the
    order of arrival.

    A request starts when it arrives or a gap after the start before it, whatever is later; so the i-th of a group starts
    at i gaps plus the largest of ``arrival - i gaps`` up to it, exact to the microsecond.  Rows without group or time
    have no start; a rate of zero or less limits nothing.
    """
    sound = requests.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    rest = requests.filter(F.col(key).isNull() | F.col(at).isNull()).withColumn(name, F.lit(None).cast("timestamp"))
    if rate <= 0:
        return sound.withColumn(name, F.col(at).cast("timestamp")).unionByName(rest)
    gap = F.lit(round(1e6 / rate)).cast("long")
    slack = F.unix_micros(F.col(at).cast("timestamp")) - gap * F.col("__i")
    scanned = materialize(_ranged(sound, key, [at, *order]).withColumn("__slack", slack), "ranged")
    totals = _totals(scanned, key, F.max("__slack").alias("__top"))
    earlier = W.partitionBy(key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    prior = totals.withColumn("__prior", F.max(F.col("__top") - gap * F.col("__base")).over(earlier)).select(key, "__range", "__base", "__prior")
    so_far = F.max("__slack").over(W.partitionBy(key, "__range").orderBy("__i").rowsBetween(W.unboundedPreceding, 0))
    joined = scanned.withColumn("__high", so_far).join(prior, [key, "__range"])
    start = gap * (F.col("__base") + F.col("__i")) + F.greatest(F.col("__prior"), F.col("__high") - gap * F.col("__base"))
    return joined.select(*requests.columns, F.timestamp_micros(start).alias(name)).unionByName(rest)


def running_sum(df: DataFrame, key: str, place: str, value: str, name: str = "before", chunk: int = CHUNK) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of a group whose ``place`` (from 0, whole) is smaller."""
    part = F.floor(F.col(place) / chunk)
    own = df.withColumn("__part", part)
    totals = own.groupBy(key, "__part").agg(F.sum(value).alias("__sum"))
    earlier = W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(key, "__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    within = F.sum(value).over(W.partitionBy(key, "__part").orderBy(place).rowsBetween(W.unboundedPreceding, -1))
    return own.withColumn("__within", F.coalesce(within, F.lit(0))).join(base, [key, "__part"]).select(*df.columns, (F.col("__base") + F.col("__within")).alias(name))


def composed(maps: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
    """``(key, scale, shift)``: of each group all ``maps(key, place, scale, shift)`` x -> scale x + shift, one after another by place.

    ``chunk`` of them are folded into one, in any group side by side, and those again, until one is left; so no row holds
    more than ``chunk`` maps, and a group of n takes log n rounds to that base.
    """
    now = maps.select(key, F.col("place").cast("long").alias("place"), "scale", "shift")
    step = lambda m, x: F.struct((m["scale"] * x["scale"]).alias("scale"), (m["shift"] * x["scale"] + x["shift"]).alias("shift"))
    one = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"))
    while True:
        folded = now.groupBy(key, F.floor(F.col("place") / chunk).alias("place")).agg(F.aggregate(F.sort_array(F.collect_list(F.struct("place", "scale", "shift"))), one, step).alias("m"))
        now = materialize(folded.select(key, "place", "m.scale", "m.shift"), "maps")
        if now.filter("place > 0").isEmpty():
            return now.drop("place")


def running_average(pairs: DataFrame, key: str = "cluster_id", chunk: int = CHUNK) -> DataFrame:
    """``(key, avg_similarity)``: the average that each group of ``pairs(key, a, b, similarity)`` comes to, pair by pair in order.

    A pair counts once beside the average so far, which counts as often as there are different members before it: with n
    of them the average becomes (n average + similarity) / (n + 1), an affine map.
    """
    placed = materialize(with_place(pairs.select(key, "a", "b", "similarity"), key, ["a", "b", "similarity"]), "placed")
    members = placed.select(key, "place", F.explode(F.array("a", "b")).alias("member"))
    first = members.groupBy(key, "member").agg(F.min("place").alias("place")).groupBy(key, "place").agg(F.count("*").alias("new"))
    known = running_sum(placed.join(first, [key, "place"], "left").select(key, "place", "similarity", F.coalesce("new", F.lit(0)).alias("new")), key, "place", "new", "n", chunk)
    maps = known.select(key, "place", (F.col("n") / (F.col("n") + 1)).alias("scale"), (F.col("similarity") / (F.col("n") + 1)).alias("shift"))
    return composed(maps, key, chunk).select(key, F.col("shift").alias("avg_similarity"))
