"""The ledger schema and helpers that give a DataFrame that shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_analytics.functions.numeric import is_amount

LEDGER = T.StructType(
    [
        T.StructField("txn_id", T.LongType()),
        T.StructField("invoice_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("vendor", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("approved_by", T.StringType()),
        T.StructField("address", T.StringType()),
    ]
)
REQUIRED = ["txn_id", "invoice_id", "date", "vendor", "amount"]


def to_ledger(df: DataFrame) -> DataFrame:
    """Select the nine ledger columns of ``df`` in order, typed; absent ones become null.

    ``txn_id`` must be unique and grow in input order: it is the identity and
    the last tie-break everywhere.
    """
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"ledger columns missing: {missing}")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LEDGER
        ]
    )


def is_valid_row() -> Column:
    """Row guard: identity, date and vendor present and a positive amount within range."""
    present = [F.col(c).isNotNull() for c in REQUIRED]
    cond = (F.col("amount") > 0) & is_amount(F.col("amount"))
    for p in present:
        cond = cond & p
    return cond
