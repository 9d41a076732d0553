"""Whole-ledger scalars, computed once and handed to the detectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_analytics.operators.order_stats import order_statistics, value_counts
from ledger_analytics.sources.materialize import scratch


@dataclass(frozen=True)
class LedgerProfile:
    n: int
    max_amount: float
    median: float          # interpolated
    upper_median: float    # sorted[n // 2]
    p75: float             # sorted[floor(0.75 n)]
    mean_log: float        # mean of log1p(amount)
    std_log: float         # population deviation of log1p(amount)
    min_log: float
    max_log: float
    min_txn: int
    max_txn: int


def profile_frame(ledger: DataFrame) -> DataFrame:
    """The profile as a one-row DataFrame; no row when the ledger is empty."""
    x = F.log1p("amount")
    totals = ledger.agg(
        F.count(F.lit(1)).alias("n"),
        F.max("amount").alias("max_amount"),
        F.avg(x).alias("mean_log"),
        F.stddev_pop(x).alias("std_log"),
        F.min(x).alias("min_log"),
        F.max(x).alias("max_log"),
        F.min("txn_id").alias("min_txn"),
        F.max("txn_id").alias("max_txn"),
    )
    # the constant group key gives the generic per-group operator one group;
    # what is windowed over it are at most a few thousand bins, not rows
    counts = value_counts(ledger.withColumn("all", F.lit(0)), ["all"], "amount")
    ranks = order_statistics(counts, ["all"], "amount", ["median_lo", "median_hi", "p75"])
    return (
        totals.withColumn("all", F.lit(0))
        .join(ranks, "all")
        .select(
            "n",
            "max_amount",
            ((F.col("median_lo") + F.col("median_hi")) / 2).alias("median"),
            F.col("median_hi").alias("upper_median"),
            "p75",
            "mean_log",
            "std_log",
            "min_log",
            "max_log",
            "min_txn",
            "max_txn",
        )
    )


def profile_ledger(ledger: DataFrame) -> LedgerProfile:
    with scratch(ledger.sparkSession):
        row = profile_frame(ledger).first()
    if row is None:
        return LedgerProfile(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0)
    return LedgerProfile(**row.asDict())
