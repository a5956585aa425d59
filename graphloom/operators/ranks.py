"""Places in a global order and exact percentiles without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.session import materialise

#: Rows of which the last ones of a percentile search are sorted on the driver.
FEW = 20_000


def running(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of a whole number over all rows before them in the order.

    Rows are dealt by ranges of the order and written; each range is summed up by itself, from the sums of those before.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(rows.withColumn("_value", value.cast("bigint")).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum("_value").alias("_sum"))  # a row a range
    before = sums.select("_range", (F.sum("_sum").over(W.orderBy("_range")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_value").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("_value")
    return dealt.join(F.broadcast(before), "_range").withColumn(name, inside + F.col("_before")).drop("_range", "_before", "_value")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in the order, from 0 on."""
    return running(rows, order, F.lit(1), name)


def percentile(rows: DataFrame, column: str, share: float) -> float | None:
    """The interpolated percentile (share between 0 and 1) of a column's values that are not null; None without any.

    Approximate quantiles close in on the two values between which it lies, until few rows are left between the bounds.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n = values.count()
    if not n:
        return None
    at = share * (n - 1)
    low, high = int(at), min(int(at) + 1, n - 1)
    inside, before, size = values, 0, n
    while size > FEW:
        near = [max((low - before) / size - 0.001, 0.0), min((high - before + 1) / size + 0.001, 1.0)]
        a, b = inside.agg(F.percentile_approx("v", F.array(*map(F.lit, near)), 10_000)).head()[0]
        under, equal, upto = inside.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v") == a), F.count_if(F.col("v") <= b)).head()
        if before + under <= low and high < before + under + equal:
            return float(a)
        if not (before + under <= low and high < before + upto) or upto - under == size:
            break  # no closer: the rest is counted by value
        inside, before, size = inside.where(F.col("v").between(a, b)), before + under, upto - under
    if size <= FEW:
        left = sorted(r["v"] for r in inside.toArrow().to_pylist())
        x, y = left[low - before], left[high - before]
    else:
        counts = numbered(inside.groupBy("v").agg(F.count("*").alias("n")), ["v"], "place")
        upto = counts.withColumn("upto", F.sum("n").over(W.orderBy("place"))).where(f"upto > {low - before}").orderBy("place").limit(2).toArrow().to_pylist()
        x = upto[0]["v"]
        y = x if upto[0]["upto"] > high - before else upto[1]["v"]
    return x + (at - low) * (y - x)
