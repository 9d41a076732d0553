"""Benford digit tests and the round-number test."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledger_analytics import fixed_values as fv
from ledger_analytics.config import AnalysisConfig
from ledger_analytics.functions.numeric import first_digit, is_round, second_digit


def _expected_pct() -> Column:
    d = F.col("digit")
    second = reduce(add, [F.log10(1 + 1 / (F.lit(10 * k) + d)) for k in range(1, 10)])
    # digit 0 has no first-digit frequency: keep the division away from it
    first = F.log10(1 + 1 / F.greatest(d, F.lit(1)))
    return 100 * F.when(F.col("digit_position") == 1, first).otherwise(second)


def digit_dimension(spark: SparkSession) -> DataFrame:
    """The 19 rows (digit_position, digit, expected_pct) every report is filled up to."""
    rows = spark.range(19).select(
        F.when(F.col("id") < 9, 1).otherwise(2).alias("digit_position"),
        F.when(F.col("id") < 9, F.col("id") + 1).otherwise(F.col("id") - 9).cast("int").alias("digit"),
    )
    return rows.withColumn("expected_pct", _expected_pct())


def digit_report(ledger: DataFrame) -> DataFrame:
    """(digit_position, digit, n, observed_pct, expected_pct) for both positions.

    One scan: rows are counted by the pair (first, second digit), at most 99
    groups, and the two distributions are sums of those counts.
    """
    pairs = ledger.groupBy(
        first_digit(F.col("amount")).alias("d1"), second_digit(F.col("amount")).alias("d2")
    ).agg(F.count(F.lit(1)).alias("n"))
    counts = (
        pairs.select(
            "n",
            F.inline(
                F.array(
                    F.struct(F.lit(1).alias("digit_position"), F.col("d1").alias("digit")),
                    F.struct(F.lit(2).alias("digit_position"), F.col("d2").alias("digit")),
                )
            ),
        )
        .where(F.col("digit").isNotNull())
        .groupBy("digit_position", "digit")
        .agg(F.sum("n").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("digit_position"))
    return (
        F.broadcast(digit_dimension(ledger.sparkSession))
        .join(counts, ["digit_position", "digit"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        .select(
            "digit_position",
            "digit",
            "n",
            F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)).alias("observed_pct"),
            "expected_pct",
        )
    )


def mad_category(mad: Column, position: Column, field: str) -> Column:
    """``label``, ``range`` or ``description`` of the MAD band."""
    at = {"label": 1, "range": 2, "description": 3}[field]

    def bands(rows):
        out = F.lit(rows[-1][at])
        for band in reversed(rows[:-1]):
            out = F.when(mad < band[0], band[at]).otherwise(out)
        return out

    return F.when(position == 1, bands(fv.MAD_BANDS[1])).otherwise(bands(fv.MAD_BANDS[2]))


def chi_critical(position: Column) -> Column:
    crit = fv.CHI_SQUARE_CRITICAL
    return F.when(position == 1, crit[1]).otherwise(crit[2])


def benford_summary(digits: DataFrame) -> DataFrame:
    """One row per digit position from a :func:`digit_report`.

    ``chi_square`` is taken over percentages; ``chi_square_counts`` is the
    textbook statistic over counts. ``mad`` is a fraction.
    """
    gap = F.col("observed_pct") - F.col("expected_pct")
    s = digits.groupBy("digit_position").agg(
        F.sum("n").alias("total_records"),
        F.sum(gap * gap / F.col("expected_pct")).alias("chi_square"),
        (F.avg(F.abs(gap)) / 100).alias("mad"),
    )
    empty = F.col("total_records") == 0
    pos = F.col("digit_position")
    accept = F.when(pos == 1, fv.CONFORMITY_CUTOFFS[1][0]).otherwise(fv.CONFORMITY_CUTOFFS[2][0])
    marginal = F.when(pos == 1, fv.CONFORMITY_CUTOFFS[1][1]).otherwise(fv.CONFORMITY_CUTOFFS[2][1])
    s = s.select(
        "digit_position",
        "total_records",
        F.when(empty, 0.0).otherwise(F.col("chi_square")).alias("chi_square"),
        F.when(empty, 0.0).otherwise(F.col("mad")).alias("mad"),
    )
    return s.select(
        "*",
        (F.col("chi_square") * F.col("total_records") / 100).alias("chi_square_counts"),
        F.when(F.col("mad") < accept, "ACCEPTABLE")
        .when(F.col("mad") < marginal, "MARGINAL")
        .otherwise("NON_CONFORMING")
        .alias("conformity"),
    )


def round_number_report(ledger: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """One row: round_count, round_rate, flagged."""
    hit = is_round(F.col("amount"), config.round_thresholds, config.round_margin)
    t = ledger.agg(F.count_if(hit).alias("round_count"), F.count(F.lit(1)).alias("n"))
    rate = F.coalesce(F.try_divide("round_count", "n"), F.lit(0.0))
    return t.select(
        "round_count",
        rate.alias("round_rate"),
        (rate > config.round_rate_limit).alias("flagged"),
    )


def threshold_distribution(ledger: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """(threshold, n): rows within the margin on either side, thresholds nobody is near omitted.

    One pass of conditional counts, turned into rows afterwards, in place of a
    join of every row with the threshold list.
    """
    near = [
        F.count_if(F.abs(F.col("amount") - t) <= config.round_margin).alias(f"t{i}")
        for i, t in enumerate(config.round_thresholds)
    ]
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n"))
            for i, t in enumerate(config.round_thresholds)
        ]
    )
    return ledger.agg(*near).select(F.inline(rows)).where(F.col("n") > 0)
