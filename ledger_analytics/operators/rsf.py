"""Relative size factor: each amount against what its vendor usually bills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_analytics.config import AnalysisConfig
from ledger_analytics.functions.numeric import total_amount
from ledger_analytics.operators.order_stats import order_statistics, value_counts
from ledger_analytics.operators.profile import LedgerProfile
from ledger_analytics.operators.skew import join_attributes


def vendor_stats(ledger: DataFrame) -> DataFrame:
    """(vendor, vendor_median, vendor_mean, vendor_std, vendor_count)."""
    moments = ledger.groupBy("vendor").agg(
        (total_amount(F.col("amount")) / F.count(F.lit(1))).alias("vendor_mean"),
        F.stddev_pop("amount").alias("vendor_std"),
        F.count(F.lit(1)).alias("vendor_count"),
    )
    counts = value_counts(ledger.select("vendor", "amount"), ["vendor"], "amount")
    medians = order_statistics(counts, ["vendor"], "amount", ["median_lo", "median_hi"]).select(
        "vendor", ((F.col("median_lo") + F.col("median_hi")) / 2).alias("vendor_median")
    )
    return moments.join(medians, "vendor")


def with_rsf(
    ledger: DataFrame, profile: LedgerProfile, config: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """Add rsf, rsf_flag, rsf_zscore, vendor_median, vendor_count.

    The statistics hold one row per vendor; rows of vendors that dominate the ledger
    get theirs without a shuffle.
    """
    low_sample = (F.col("vendor_count") < config.rsf_min_vendor_rows) & F.lit(profile.median > 0)
    baseline = F.when(low_sample, F.lit(profile.median)).otherwise(F.col("vendor_median"))
    rsf = F.col("amount") / baseline
    zscore = F.when(
        F.col("vendor_std") > 0, (F.col("amount") - F.col("vendor_mean")) / F.col("vendor_std")
    ).otherwise(0.0)
    return join_attributes(ledger, vendor_stats(ledger), "vendor", "vendor_count", profile.n, "vendor-stats").select(
        *ledger.columns,
        rsf.alias("rsf"),
        (rsf > config.rsf_threshold).alias("rsf_flag"),
        zscore.alias("rsf_zscore"),
        "vendor_median",
        "vendor_count",
    )


def top_rsf_vendors(rsf_rows: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` vendors with the largest flagged amount."""
    flag = F.col("rsf_flag")
    return (
        rsf_rows.groupBy("vendor")
        .agg(
            F.count_if(flag).alias("flag_count"),
            total_amount(F.when(flag, F.col("amount"))).alias("total_exposure"),
            F.max("rsf").alias("max_rsf"),
            F.min("txn_id").alias("first_txn"),
        )
        .where(F.col("flag_count") > 0)
        .orderBy(F.desc("total_exposure"), "first_txn")
        .limit(n)
        .drop("first_txn")
    )
