"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  data directory (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_COPIES  replicate the derived ledger this many times, with new ids, vendors and
              days (default 1), to see how time grows with the rows
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import driver_queries as dq  # noqa: E402
from ledger_analytics.sources.materialize import materialize  # noqa: E402

HEADLINE = [
    "ledger_profile", "benford_summary", "round_number", "relative_size", "exact_duplicates",
    "fuzzy_duplicates", "split_invoices", "description_audit", "isolation_forest", "full_analysis",
    "composite_score", "portfolio", "vendor_risk", "vendor_view", "detector_counts", "tiers_by_month",
    "flagged_transactions", "csv_ledger",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def replicated(ledger: DataFrame, copies: int) -> DataFrame:
    """Every copy keeps the shape of the ledger: half of its vendors are its own."""
    c = F.col("copy")
    own = F.crc32("vendor") % 2 == 0
    return (
        ledger.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumn("txn_id", F.col("txn_id") + c * 10_000_000)
        .withColumn("vendor", F.when(own & (c > 0), F.concat("vendor", F.md5(c.cast("string")))).otherwise(F.col("vendor")))
        .withColumn("date", F.date_add("date", (c * 11).cast("int")))
        .drop("copy")
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    copies = int(os.environ.get("BENCH_COPIES", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledger-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # broadcast by measured size only: estimates from compressed files are far too low
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    times: dict[str, float] = {}
    start = time.perf_counter()
    ledger = dq.stored_ledger(spark, sf_dir)
    if copies > 1:
        ledger = materialize(replicated(ledger, copies), "replicated")
        dq._stored[(spark.sparkContext.applicationId, sf_dir, "ledger")] = ledger
    times["store_ledger"] = time.perf_counter() - start
    for name in HEADLINE:
        start = time.perf_counter()
        run(dq.QUERIES[name](spark, sf_dir))
        times[name] = time.perf_counter() - start
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "ledger_rows": ledger.count(),
                "cores": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
