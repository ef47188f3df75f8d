"""Exact percentiles of large groups without gathering a group's values in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half the width, in ranks, of the parts that are cut out around a percentile, and the accuracy of the sketch that cuts them.
_MARGIN, _ACCURACY = 0.002, 5000


def percentiles(df: DataFrame, key: str, value: str, fractions: list[float], name: str = "percentiles") -> DataFrame:
    """Of each group its percentiles as array<double>, equal to F.percentile's; nulls do not count, groups without values give no row.

    A sketch cuts the values into parts; the parts are counted, and only values of those that hold a wanted rank are counted
    one by one. The sketch decides how much that is, never the result. Three passes; the groups must fit a broadcast.
    """
    k, v, n = F.col("__key"), F.col("__v"), F.col("__n")
    own = df.select(F.col(key).alias("__key"), F.col(value).cast("double").alias("__v")).where(v.isNotNull())
    cuts = sorted({min(max(f + e, 0.0), 1.0) for f in fractions for e in (-_MARGIN, _MARGIN)})
    about = own.groupBy("__key").agg(F.percentile_approx("__v", cuts, _ACCURACY).alias("__cuts")).withColumnRenamed("__key", "__of")
    part = F.lit(0)
    for i in range(len(cuts)):
        part = part + (v > F.col("__cuts")[i]).cast("int")
    placed = own.join(F.broadcast(about), k.eqNullSafe(F.col("__of"))).select("__key", "__v", part.alias("__part"))

    at = [(n - 1) * F.lit(f) for f in fractions]
    ranks: list[tuple[Column, Column]] = [(F.floor(p), F.ceil(p)) for p in at]
    holds = lambda first, end: [(r >= first) & (r < end) for pair in ranks for r in pair]
    every = Window.partitionBy("__key")
    counts = placed.groupBy("__key", "__part").agg(F.count("*").alias("__c"))
    counts = counts.select("__key", "__part", "__c", F.sum("__c").over(every).alias("__n"), (F.sum("__c").over(every.orderBy("__part")) - F.col("__c")).alias("__below"))
    wanted = counts.where(F.greatest(*holds(F.col("__below"), F.col("__below") + F.col("__c"))))
    wanted = wanted.select(k.alias("__of"), F.col("__part").alias("__in"), "__n", "__below")

    found = placed.join(F.broadcast(wanted), k.eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__in")))
    found = found.groupBy("__key", "__part", "__n", "__below", "__v").agg(F.count("*").alias("__c"))
    end = F.col("__below") + F.sum("__c").over(Window.partitionBy("__key", "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("__end", end)
    there = holds(F.col("__end") - F.col("__c"), F.col("__end"))
    got = found.groupBy("__key", "__n").agg(*[F.max(F.when(c, v)).alias(f"__r{i}") for i, c in enumerate(there)])

    def between(i: int) -> Column:
        low, high, (first, last) = F.col(f"__r{2 * i}"), F.col(f"__r{2 * i + 1}"), ranks[i]
        return F.when(low == high, low).otherwise((last - at[i]) * low + (at[i] - first) * high)

    return got.select(k.alias(key), F.array(*[between(i) for i in range(len(fractions))]).alias(name))
