"""Exact order statistics, for the whole ledger and per group, without ever
sorting one group in one task.

``percentile`` keeps every distinct value of a group in a single reducer's
memory. Here equal values are merged first, then values are counted in bins of
about one percent width (at most a few thousand per group). Only the bin that
holds a wanted rank is looked at further. As long as one of these has more than
``SORTED`` distinct values, all of them are counted again in the finer bins of
the next of ``BINS_PER_OCTAVE``; what is sorted in the end are the few values of
the last bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_analytics.sources.materialize import materialize

# widths of about 1 %, 0.0005 % and 3e-9; a bin has at most a few thousand of the next finer ones
BINS_PER_OCTAVE = (1 << 6, 1 << 17, 1 << 28)

#: Distinct values of a bin that are sorted as they are.
SORTED = 10_000

# name -> 0-based rank in ascending order, as a function of the row count
RANKS = {
    "median_lo": lambda n: F.floor((n - 1) / 2),
    "median_hi": lambda n: F.floor(n / 2),
    "p75": lambda n: F.least(F.floor(n * 0.75), n - 1),
}


def _bin(value: Column, level: int = 0) -> Column:
    return F.floor(F.log2(value) * BINS_PER_OCTAVE[level])


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, bin): one row per distinct positive value per group, stored."""
    usable = (F.col(value) > 0) & _bin(F.col(value)).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    counts = df.where(usable).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.withColumn("bin", _bin(F.col(value))), "value-counts")


def order_statistics(counts: DataFrame, keys: list[str], value: str, ranks: list[str]) -> DataFrame:
    """One row per group: keys and one column per name in ``ranks``.

    ``counts`` is a :func:`value_counts` result. Jobs run while bins are refined.
    """
    bins = counts.groupBy(*keys, "bin").agg(F.sum("n").alias("bin_n"), F.count(F.lit(1)).alias("values"))
    group = Window.partitionBy(*keys)
    running = bins.select(
        *keys, "bin", (F.sum("bin_n").over(group.orderBy("bin")) - F.col("bin_n")).alias("before"), "bin_n", "values",
        F.sum("bin_n").over(group).alias("total"),
    )
    targets = F.array(*[F.struct(F.lit(r).alias("name"), RANKS[r](F.col("total")).alias("rank")) for r in ranks])
    wanted = _holding(running.withColumn("targets", targets), keys)
    left = counts
    for level in range(1, len(BINS_PER_OCTAVE)):
        if wanted.where(F.col("values") > SORTED).isEmpty():
            break
        # the rows of the wanted bins only, in bins of the next level
        left = left.drop("before", "targets").join(wanted.drop("values"), [*keys, "bin"])
        left = materialize(left.withColumn("bin", _bin(F.col(value), level)), "wanted-values")
        bins = left.groupBy(*keys, "before", "targets", "bin").agg(F.sum("n").alias("bin_n"), F.count(F.lit(1)).alias("values"))
        group = Window.partitionBy(*keys, "before").orderBy("bin")
        running = bins.withColumn("start", F.col("before") + F.sum("bin_n").over(group) - F.col("bin_n"))
        wanted = _holding(running.drop("before").withColumnRenamed("start", "before"), keys)
    left = left.drop("before", "targets").join(wanted.drop("values"), [*keys, "bin"])
    inside = Window.partitionBy(*keys, "bin").orderBy(value)
    upto = F.col("before") + F.sum("n").over(inside)
    picked = left.withColumn("upto", upto).select(
        *keys, value,
        F.explode(F.filter("targets", lambda t: (t["rank"] < F.col("upto")) & (t["rank"] >= F.col("upto") - F.col("n")))).alias("target"),
    )
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("target.name") == r, F.col(value))).alias(r) for r in ranks]
    )


def _holding(running: DataFrame, keys: list[str]) -> DataFrame:
    """The bins of ``running`` (before, bin_n, values, targets) that hold a wanted rank, with those
    ranks, stored: at most one per group and rank."""
    end = F.col("before") + F.col("bin_n")
    held = F.filter("targets", lambda t: (t["rank"] >= F.col("before")) & (t["rank"] < end))
    kept = running.withColumn("targets", held).where(F.size("targets") > 0)
    return materialize(kept.select(*keys, "bin", "before", "targets", "values"), "wanted-bins")
