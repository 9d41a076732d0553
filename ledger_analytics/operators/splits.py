"""Split invoices: a vendor's payments within seven days that stay below an
approval threshold one by one, cross it together, and are of similar size.

An anchor row's window is every later row of its day (in txn_id order) plus the
vendor's rows of the next seven days. It qualifies only if its sum is at most
3.5 times a threshold and its smallest amount is close to its largest. Both
conditions can only get worse as the window grows, so most rows are ruled out
from sums per vendor and day, before any rows are brought together:

1. sums per (vendor, day, block of txn_ids), combined map-side;
2. from them, what lies behind each block: later blocks of the day and the
   following days. A block whose tail already fails for the largest threshold
   cannot hold an anchor and is dropped;
3. only rows of the remaining blocks are put in order to test each as an anchor.

A vendor or a single vendor-day holding a third of the ledger therefore costs a
map-side sum, not a sort. A row belongs to the earliest anchor whose window
reaches it, which per vendor and day is one record to join with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_analytics.config import AnalysisConfig
from ledger_analytics.functions.numeric import exact_amount
from ledger_analytics.functions.text import vendor_group
from ledger_analytics.operators.profile import LedgerProfile
from ledger_analytics.operators.skew import never_broadcast

# a vendor-day is cut into at most this many blocks, and none smaller than this
_MAX_BLOCKS = 1 << 16
_MIN_BLOCK = 1 << 20
_STATS = ("total", "size", "low", "high")


def _stats(amount: Column) -> list[Column]:
    return [
        F.sum(amount).alias("total"),
        F.count(F.lit(1)).alias("size"),
        F.min("amount").alias("low"),
        F.max("amount").alias("high"),
    ]


def _over(window, prefix: str) -> list[Column]:
    aggs = {"total": F.sum, "size": F.sum, "low": F.min, "high": F.max}
    return [aggs[s](s).over(window).alias(f"{prefix}_{s}") for s in _STATS]


def _join_stats(a: str, b: str, out: str) -> list[Column]:
    """Combine two possibly empty parts of a window."""
    zero = {"total": F.lit(0).cast("decimal(38,6)"), "size": F.lit(0).cast("long")}
    cols = []
    for s in ("total", "size"):
        cols.append((F.coalesce(f"{a}_{s}", zero[s]) + F.coalesce(f"{b}_{s}", zero[s])).alias(f"{out}_{s}"))
    cols.append(F.least(f"{a}_low", f"{b}_low").alias(f"{out}_low"))
    cols.append(F.greatest(f"{a}_high", f"{b}_high").alias(f"{out}_high"))
    return cols


def _block(profile: LedgerProfile) -> Column:
    width = max(_MIN_BLOCK, -(-(profile.max_txn - profile.min_txn + 1) // _MAX_BLOCKS))
    return F.floor((F.col("txn_id") - profile.min_txn) / width)


def split_anchors(
    ledger: DataFrame, profile: LedgerProfile, config: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """Qualifying windows: (vendor_group, day, anchor_txn_id, cluster_total, cluster_size,
    suspected_threshold)."""
    thresholds = [float(t) for t in config.approval_thresholds]
    top = max(thresholds)
    ratio, similarity = config.split_max_ratio, config.split_similarity

    def similar(low: Column, high: Column) -> Column:
        return (high - low) / high <= similarity

    def still_possible(p: str) -> Column:
        empty = F.coalesce(f"{p}_size", F.lit(0)) == 0
        return empty | (
            (F.col(f"{p}_total") <= top * ratio)
            & (F.col(f"{p}_high") < top)
            & similar(F.col(f"{p}_low"), F.col(f"{p}_high"))
        )

    rows = ledger.select(
        "txn_id",
        vendor_group(F.col("vendor")).alias("vendor_group"),
        F.unix_date("date").alias("day"),
        "amount",
        _block(profile).alias("block"),
    )
    # said once here, not inferred per join: the sums below are then shuffled once
    rows = rows.where("vendor_group IS NOT NULL AND day IS NOT NULL AND block IS NOT NULL")
    blocks = rows.groupBy("vendor_group", "day", "block").agg(*_stats(exact_amount(F.col("amount"))))
    days = blocks.groupBy("vendor_group", "day").agg(
        F.sum("total").alias("total"),
        F.sum("size").alias("size"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    # one record per vendor and day: the window below is bounded by the calendar
    next_days = (
        Window.partitionBy("vendor_group").orderBy("day").rangeBetween(1, config.split_window_days)
    )
    days = days.select("vendor_group", "day", *_over(next_days, "next")).where(still_possible("next"))

    later_blocks = (
        Window.partitionBy("vendor_group", "day")
        .orderBy(F.desc("block"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    tails = blocks.select(
        "vendor_group", "day", "block", *_STATS, *_over(later_blocks, "later")
    ).join(days, ["vendor_group", "day"])
    tails = tails.select(
        "vendor_group", "day", "block", "size", *_join_stats("later", "next", "tail")
    ).where(still_possible("tail") & (F.col("size") + F.col("tail_size") >= 2))

    same_block = (
        Window.partitionBy("vendor_group", "day", "block")
        .orderBy(F.desc("txn_id"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    own = (
        never_broadcast(rows).join(tails.drop("size"), ["vendor_group", "day", "block"])
        .withColumn("total", exact_amount(F.col("amount")))
        .withColumn("size", F.lit(1).cast("long"))
        .withColumn("low", F.col("amount"))
        .withColumn("high", F.col("amount"))
    )
    tail = [f"tail_{s}" for s in _STATS]
    windows = own.select("vendor_group", "day", "txn_id", *tail, *_over(same_block, "own")).select(
        "vendor_group", "day", "txn_id", *_join_stats("own", "tail", "window")
    )
    total, high = F.col("window_total"), F.col("window_high")
    threshold = F.coalesce(
        *[
            F.when((high < t) & (total >= t) & (total <= t * ratio), F.lit(t))
            for t in thresholds
        ]
    )
    return (
        windows.where((F.col("window_size") >= 2) & similar(F.col("window_low"), high))
        .select(
            "vendor_group",
            "day",
            F.col("txn_id").alias("anchor_txn_id"),
            total.cast("double").alias("cluster_total"),
            F.col("window_size").alias("cluster_size"),
            threshold.alias("suspected_threshold"),
        )
        .where(F.col("suspected_threshold").isNotNull())
    )


def split_invoices(
    ledger: DataFrame, profile: LedgerProfile, config: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """(txn_id, split_cluster_id, cluster_total, cluster_size, suspected_threshold) of the
    rows in a suspected cluster; each row keeps the first cluster that reaches it."""
    anchors = split_anchors(ledger, profile, config)
    first_of_day = anchors.groupBy("vendor_group", "day").agg(
        F.min(
            F.struct("anchor_txn_id", "cluster_total", "cluster_size", "suspected_threshold")
        ).alias("cluster")
    )
    # the earliest anchor day wins; an anchor of an earlier day reaches the whole day
    reached = (
        first_of_day.select(
            "vendor_group",
            F.col("day").alias("anchor_day"),
            F.explode(F.sequence(F.col("day"), F.col("day") + config.split_window_days)).alias("day"),
            "cluster",
        )
        .groupBy("vendor_group", "day")
        .agg(F.min(F.struct("anchor_day", "cluster")).alias("first"))
    )
    rows = ledger.select(
        "txn_id", vendor_group(F.col("vendor")).alias("vendor_group"), F.unix_date("date").alias("day")
    )
    cluster = F.col("first.cluster")
    return (
        never_broadcast(rows).join(reached, ["vendor_group", "day"])
        .where(
            (F.col("first.anchor_day") < F.col("day")) | (cluster["anchor_txn_id"] <= F.col("txn_id"))
        )
        .select(
            "txn_id",
            F.concat(F.lit("SPLIT-"), cluster["anchor_txn_id"]).alias("split_cluster_id"),
            cluster["cluster_total"].alias("cluster_total"),
            cluster["cluster_size"].alias("cluster_size"),
            cluster["suspected_threshold"].alias("suspected_threshold"),
        )
    )
