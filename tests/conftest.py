import datetime as dt
import math
import os
import random
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledger_analytics.schema import LEDGER  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("ledger-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Build a ledger from dicts; ids follow the list, other fields have defaults."""

    def build(rows):
        out = []
        for i, r in enumerate(rows):
            date = r.get("date", dt.date(2024, 1, 1))
            if isinstance(date, str):
                date = dt.date.fromisoformat(date)
            out.append(
                (
                    r.get("txn_id", i),
                    r.get("invoice_id", f"INV-{i}"),
                    date,
                    r.get("vendor", "Acme"),
                    float(r["amount"]),
                    r.get("description"),
                    r.get("category"),
                    r.get("approved_by"),
                    r.get("address"),
                )
            )
        return spark.createDataFrame(out, LEDGER)

    return build


@pytest.fixture(scope="session")
def lognormal():
    """n rows with log-normal amounts over ten vendors and twelve month starts."""

    def rows(n, seed=42):
        rng = random.Random(seed)
        return [
            {
                "vendor": f"Vendor {chr(65 + i % 10) * 4}",
                "amount": round(math.exp(9 + 1.2 * rng.gauss(0, 1)), 2),
                "date": dt.date(2024, 1 + i % 12, 1),
                "description": f"Delivery of spare parts for plant {i}",
            }
            for i in range(n)
        ]

    return rows
