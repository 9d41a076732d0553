"""Pages of sorted transactions, for any page of a large ledger."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_analytics.plans.reports import sort_columns
from ledger_analytics.sources.materialize import checkpoint_root


@dataclass(frozen=True)
class PageIndex:
    """Transactions dealt into ranges of the sort order and sorted within, one folder each,
    and the number of rows before each range. A page reads the ranges that it lies in, so
    page 1 000 000 costs what page 1 does; nothing is sorted but when the index is built."""

    rows: DataFrame
    #: By range: its number of rows and the rows before it.
    ranges: dict[int, tuple[int, int]]

    @classmethod
    def build(cls, scored: DataFrame, key: str = "composite_risk", ascending: bool = False, parts: int | None = None) -> "PageIndex":
        """``parts`` is the number of ranges, by default that of shuffle partitions."""
        spark = scored.sparkSession
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = sort_columns(key, ascending)
        ordered = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        # the upper bits of these ids are the partition, the lower ones count its rows
        numbered = ordered.withColumn("__at", F.monotonically_increasing_id())
        numbered = numbered.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        path = f"{checkpoint_root(spark)}/ledger_analytics/pages-{uuid.uuid4().hex}"
        numbered.write.partitionBy("__part").parquet(path)
        rows = spark.read.parquet(path) if numbered.limit(1).count() else numbered
        counts = {r["__part"]: r["n"] for r in rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most parts
        ranges, before = {}, 0
        for part in sorted(counts):
            ranges[part] = (counts[part], before)
            before += counts[part]
        return cls(rows, ranges)

    @property
    def total(self) -> int:
        return sum(n for n, _ in self.ranges.values())

    def page(self, number: int = 1, size: int = 50) -> DataFrame:
        """The rows of a page, in order, with ``position`` counted from 1."""
        first, last = (number - 1) * size + 1, number * size
        held = {p: before for p, (n, before) in self.ranges.items() if before < last and before + n >= first}
        rows = self.rows.where(F.col("__part").isin(*held)) if held else self.rows.where("false")
        before = F.coalesce(*[F.when(F.col("__part") == p, F.lit(b)) for p, b in held.items()], F.lit(0))
        position = (before + F.col("__at") + 1).cast("long")
        kept = [c for c in self.rows.columns if c not in ("__part", "__at")]
        return rows.withColumn("position", position).where(F.col("position").between(first, last)).select(*kept, "position").orderBy("position")
