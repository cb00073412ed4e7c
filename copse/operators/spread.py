"""Orders and links over rows of one key that no single task can hold: sums, numbers, last values and chains' ends.

An order is cut into ranges (one sort by range, written once, as two readings of a range partitioning need not agree); windows work within a
range, and one row for each key and range carries sums or last values to the ranges after it. What `summed`, `numbered` and `carried` return reads
that table (`written_at`): who has written what is made of it can have it forgotten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.sources.scratch import forget, written


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` with `_range`: rows of a key in ranges of its order, in as many as there are shuffle partitions over all keys."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id().cast("long")), "ranged")


def _led(table: DataFrame, before: DataFrame) -> DataFrame:
    """Ranged rows (`_lead` 1), and ahead of each key's rows in a range the one that brings what the ranges before carry (`_lead` 0): a window over both needs no join."""
    return table.withColumn("_lead", F.lit(1)).unionByName(before.withColumn("_lead", F.lit(0)), allowMissingColumns=True)


def summed(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`df` with `name`: the sum of `value`, a whole number, over the rows of a key before each."""
    table = ranged(df.withColumn("_value", value.cast("long")), keys, order)
    sums = table.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = sums.withColumn("_value", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    rows = _led(table, before.where("_value is not null").drop("_sum"))
    earlier = Window.partitionBy(*keys, "_range").orderBy("_lead", *order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn(name, F.coalesce(F.sum("_value").over(earlier), F.lit(0))).where("_lead = 1").drop("_range", "_lead", "_value")
    out.written_at = table.written_at
    return out


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """`df` with `name`: places from 0 within a key, as `row_number` would give."""
    return summed(df, keys, order, F.lit(1), name)


def carried(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`df` with `name`: the last `value` that is not null of this row and those before it within a key."""
    table = ranged(df, keys, order)
    last = table.where(F.col(value).isNotNull()).groupBy(*keys, "_range").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    few = last.unionByName(table.select(*keys, "_range").distinct(), allowMissingColumns=True).groupBy(*keys, "_range").agg(F.first("_last", True).alias("_last"))
    before = few.withColumn(value, F.last("_last", True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    rows = _led(table, before.where(F.col(value).isNotNull()))
    so_far = Window.partitionBy(*keys, "_range").orderBy("_lead", *order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(name, F.last(value, True).over(so_far)).where("_lead = 1").drop("_range", "_lead")
    out.written_at = table.written_at
    return out


def ends(links: DataFrame, **weights: Column) -> DataFrame:
    """(doc_id, id, end, steps, weights...) of every id in `links`(doc_id, id, to; one row an id): the end of its chain, null if it runs into a cycle.

    An id that no row has, or whose `to` is null, is an end. Every round doubles how far each id sees, so there are about log(longest chain) of them; every
    round finds some id's end as long as an id has one, so when none does the rest are cycles. `weights`: what is summed over the ids that a chain leaves.
    """
    sums = ["steps", *weights]
    columns = ["doc_id", "id", "end", *sums]
    start = links.where("to is not null").select("doc_id", "id", F.col("to").alias("end"), F.lit(1).cast("long").alias("steps"), *(w.cast("long").alias(n) for n, w in weights.items()))
    start = written(start, "links")
    heads = start.select("doc_id", F.col("id").alias("end"), F.lit(True).alias("_goes_on"))
    rounds = [written(start.join(heads, ["doc_id", "end"], "left").select(*columns, F.col("_goes_on").isNull().alias("_done")), "ends")]
    while True:
        counts = dict(map(tuple, rounds[-1].groupBy("_done").count().collect()))
        if not counts.get(False) or not counts.get(True):
            break
        open_ = rounds[-1].where("not _done")
        known = reduce(DataFrame.unionByName, (r.where("_done") for r in rounds), open_)
        ahead = known.select("doc_id", F.col("id").alias("end"), F.col("end").alias("_end"), *(F.col(n).alias(f"_{n}") for n in sums), F.col("_done").alias("_found"))
        step = open_.join(ahead, ["doc_id", "end"])
        rounds.append(written(step.select("doc_id", "id", F.col("_end").alias("end"), *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums), F.col("_found").alias("_done")), "ends"))
    forget(start)
    lost = rounds[-1].where("not _done").select("doc_id", "id", *(F.lit(None).cast(start.schema[c].dataType).alias(c) for c in columns[2:]))
    return reduce(DataFrame.unionByName, (r.where("_done").select(*columns) for r in rounds), lost)
