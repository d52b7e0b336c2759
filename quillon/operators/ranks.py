"""Exact ranks and percentiles without bringing a group to one task: histograms of value ranges come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that one histogram has of each group.
BUCKETS = 4096


def _bucket(x: Column, low: Column, high: Column) -> Column:
    """Which of BUCKETS equal ranges between low and high a value is in; rising with the value."""
    share = (x.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))
    return F.when(high > low, F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0)).cast("int")


def with_rank(rows: DataFrame, by: list[str], order: str, name: str = "rank") -> DataFrame:
    """`rows` and their place (from 1) in their group by a number; rows with equal numbers get places in some order, and a
    null number no row. A group is cut into ranges of the number, which are counted, and rows are numbered inside their
    range, so that a task gets a range and not the group. Groups are compared as values, null with null."""
    keyed = rows.where(F.col(order).isNotNull()).withColumn("rank_group", F.to_json(F.struct(*by)) if by else F.lit(""))
    keys = ["rank_group"]
    ends = keyed.groupBy(keys).agg(F.min(order).alias("rank_low"), F.max(order).alias("rank_high"))
    placed = keyed.join(ends, keys).withColumn("rank_bucket", _bucket(F.col(order), F.col("rank_low"), F.col("rank_high")))
    counts = placed.groupBy(*keys, "rank_bucket").agg(F.count("*").alias("rank_count"))
    before = F.coalesce(F.sum("rank_count").over(W.partitionBy(keys).orderBy("rank_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("rank_before", before).drop("rank_count")
    inside = F.row_number().over(W.partitionBy(*keys, "rank_bucket").orderBy(order))
    return placed.join(counts, [*keys, "rank_bucket"]).withColumn(name, F.col("rank_before") + inside).select(*rows.columns, name)


def average_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): each value's average place among all rows by a number column: the rows before it and half of its own and one. Values are counted
    first, so equal ones never meet in a task; counts are summed over ranges of the value, then inside each range."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rank_n"))
    ends = counts.agg(F.min(column).alias("rank_low"), F.max(column).alias("rank_high"))  # one row
    placed = counts.join(F.broadcast(ends)).withColumn("rank_bucket", _bucket(F.col(column), F.col("rank_low"), F.col("rank_high")))
    whole = placed.groupBy("rank_bucket").agg(F.sum("rank_n").alias("rank_all"))
    before = F.coalesce(F.sum("rank_all").over(W.orderBy("rank_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # BUCKETS rows at most
    inside = F.coalesce(F.sum("rank_n").over(W.partitionBy("rank_bucket").orderBy(column).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    both = placed.join(whole.select("rank_bucket", before.alias("rank_before")), "rank_bucket")
    return both.select(column, (F.col("rank_before") + inside + (F.col("rank_n") + 1) / 2).alias(name))


def percentiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float, str]], steps: int = 2) -> DataFrame:
    """By group, exact percentiles of number columns: name -> (column, p from 0 to 1, "linear" or "nearest").

    linear: interpolated at place p (n - 1); nearest: the value at place min(int(n p), n - 1); places count from 0, nulls
    are left out, and a group without values has 0. `steps` histograms narrow each place down to a range; only the
    distinct values of that range are sorted.
    """
    one = "percentile_all"
    rows, keys = (rows, by) if by else (rows.withColumn(one, F.lit(1)), [one])
    groups = rows.select(keys).distinct()
    out = groups
    for column in dict.fromkeys(c for c, _, _ in wanted.values()):
        mine = {k: (p, kind) for k, (c, p, kind) in wanted.items() if c == column}
        values = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("v"))
        n = F.col("n")
        places = []
        for k, (p, kind) in mine.items():
            at = (n - 1) * F.lit(float(p)) if kind == "linear" else F.least(F.floor(n * F.lit(float(p))), n - 1)
            for half, place in (("low", F.floor(at)), ("high", F.ceil(at))):
                places.append(F.struct(F.lit(k).alias("name"), F.lit(half).alias("half"), at.cast("double").alias("at"), place.cast("long").alias("place")))
        ends = values.groupBy(keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        spots = ends.select(*keys, "low", "high", F.explode(F.array(*places)).alias("x")).select(*keys, "low", "high", "x.*")
        spot = [*keys, "name", "half"]
        for _ in range(steps):
            near = values.join(spots, keys).where("v BETWEEN low AND high").withColumn("b", _bucket(F.col("v"), F.col("low"), F.col("high")))
            counted = near.groupBy(*spot, "at", "place", "b").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
            spots = _found(counted, spot, "b").select(*spot, "at", (F.col("place") - F.col("before")).alias("place"), "low", "high")
        near = values.join(spots, keys).where("v BETWEEN low AND high").groupBy(*spot, "at", "place", "v").agg(F.count("*").alias("c"))
        hit = _found(near, spot, "v").groupBy(*keys, "name").agg(F.max(F.when(F.col("half") == "low", F.col("v"))).alias("a"), F.max(F.when(F.col("half") == "high", F.col("v"))).alias("b"), F.max("at").alias("at"))
        value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
        wide = hit.groupBy(keys).agg(*[F.max(F.when(F.col("name") == k, value)).alias(k) for k in mine])
        on = [F.col(f"g.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
        out = out.alias("g").join(wide.alias("w"), on, "left").select("g.*", *[F.coalesce(f"w.{k}", F.lit(0.0)).alias(k) for k in mine])
    return out if by else out.drop(one)


def _found(counted: DataFrame, spot: list[str], order: str) -> DataFrame:
    """Of counts `c` by spot and range or value, the ones that hold the place, with what is `before` them."""
    before = F.sum("c").over(W.partitionBy(spot).orderBy(order)) - F.col("c")
    return counted.withColumn("before", before).where("before <= place AND place < before + c")
