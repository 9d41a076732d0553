"""Exact duplicates: same date, two-decimal amount and normalised vendor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_analytics.functions.numeric import amount_cents
from ledger_analytics.functions.text import vendor_key
from ledger_analytics.operators.skew import never_broadcast


def exact_duplicates(ledger: DataFrame) -> DataFrame:
    """(txn_id, dup_count, dup_group_key) of the rows that have a copy.

    Groups are counted with map-side combining, so a group of any size is cheap,
    and only keys seen twice are joined back. A window over the key would put
    all copies of a record into one task.
    """
    keyed = ledger.select(
        "txn_id",
        "date",
        amount_cents(F.col("amount")).alias("amount2"),
        vendor_key(F.col("vendor")).alias("vendor_key"),
    )
    key = ["date", "amount2", "vendor_key"]
    repeated = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("dup_count")).where("dup_count > 1")
    return never_broadcast(keyed).join(repeated, key).select(
        "txn_id",
        "dup_count",
        F.concat_ws("|", "date", F.col("amount2").cast("decimal(38,2)"), "vendor_key").alias("dup_group_key"),
    )
