"""Composite score per row and the portfolio summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_analytics import fixed_values as fv
from ledger_analytics.config import AnalysisConfig
from ledger_analytics.functions.numeric import js_round, just_below, total_amount


def tier_of(score: Column) -> Column:
    out = F.lit("LOW")
    for tier, floor in reversed(fv.TIER_FLOORS):
        out = F.when(score >= floor, tier).otherwise(out)
    return out


def with_composite(rows: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Add composite_risk, risk_tier, triggered_detectors from the detector columns.

    Needs isolation_score, is_outlier, rsf, rsf_flag, is_exact_duplicate,
    is_split_invoice, description_risk, fuzzy_dup_group, is_round_number,
    ofac_hit, edgar_verified, address_valid. The last three are null when not
    checked, and then count for nothing.
    """
    c = F.col
    near = just_below(c("amount"), config.round_thresholds, config.round_margin)
    unverified = c("edgar_verified").eqNullSafe(False) & c("rsf_flag")
    sanctioned = c("ofac_hit").eqNullSafe(True)
    bad_address = c("address_valid").eqNullSafe(False)
    fuzzy = c("fuzzy_dup_group").isNotNull()

    def points(cond: Column, n: float) -> Column:
        return F.when(cond, float(n)).otherwise(0.0)

    rsf_points = (
        F.when(c("rsf_flag"), F.least(F.lit(1.0), (c("rsf") - 3) / 7 + 0.5) * 25)
        .when(c("rsf") > 2.0, (c("rsf") - 2.0) * 7.5)
        .otherwise(0.0)
    )
    # the weights add up to 100, so a running total cannot pass it before the bonuses
    score = (
        c("isolation_score") / 100 * 30
        + rsf_points
        + points(c("is_exact_duplicate"), 20)
        + points(c("is_split_invoice"), 10)
        + c("description_risk") / 100 * 8
        + points(fuzzy, 5)
        + points(c("is_round_number"), 2)
        + points(near, 8)
    )
    score = F.greatest(score, points(sanctioned, 100))
    score = score + points(unverified, 15) + points(bad_address, 10)

    fired = [
        (c("is_outlier"), "ISOLATION_FOREST"),
        (c("rsf_flag"), "RSF"),
        (c("is_exact_duplicate"), "EXACT_DUPLICATE"),
        (c("is_split_invoice"), "SPLIT_INVOICE"),
        (c("description_risk") >= 30, "DESCRIPTION_AUDIT"),
        (fuzzy, "FUZZY_DUPLICATE"),
        (c("is_round_number") | near, "ROUND_NUMBER"),
        (sanctioned, "OFAC_HIT"),
        (unverified, "EDGAR_UNVERIFIED"),
        (bad_address, "ADDRESS_INVALID"),
    ]
    return rows.select(
        "*",
        F.least(F.lit(100), js_round(score)).cast("int").alias("composite_risk"),
        F.array_compact(F.array(*[F.when(on, name) for on, name in fired])).alias(
            "triggered_detectors"
        ),
    ).withColumn("risk_tier", tier_of(c("composite_risk")))


def is_flagged() -> Column:
    return F.col("risk_tier").isin(*fv.FLAGGED_TIERS)


def portfolio_summary(scored: DataFrame, benford_mad: float | Column) -> DataFrame:
    """One row of portfolio rates, exposure, score and tier."""
    mad = benford_mad if isinstance(benford_mad, Column) else F.lit(float(benford_mad))

    def rate(col: str) -> Column:
        return F.coalesce(F.avg(F.col(col).cast("int")), F.lit(0.0)).alias(f"{col}_rate")

    flagged = is_flagged()
    t = scored.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.coalesce(F.count_if(flagged), F.lit(0)).alias("flagged_transactions"),
        total_amount(F.when(flagged, F.col("amount"))).alias("estimated_exposure"),
        F.coalesce(F.avg("composite_risk"), F.lit(0.0)).alias("mean_risk"),
        rate("is_outlier"),
        rate("rsf_flag"),
        rate("is_exact_duplicate"),
        rate("is_round_number"),
    ).withColumn("benford_mad", F.when(F.col("total_transactions") > 0, mad).otherwise(0.0))
    raw = F.least(
        F.lit(100.0),
        F.least(F.col("mean_risk") * 1.8, F.lit(60.0))
        + F.least(F.col("is_exact_duplicate_rate") * 200, F.lit(20.0))
        + F.least(F.col("benford_mad") * 1000, F.lit(20.0)),
    )
    return t.withColumn("raw_score", raw).select(
        js_round(F.col("raw_score")).cast("int").alias("score"),
        tier_of(F.col("raw_score")).alias("tier"),
        F.col("is_outlier_rate").alias("outlier_rate"),
        "rsf_flag_rate",
        F.col("is_exact_duplicate_rate").alias("duplicate_rate"),
        "benford_mad",
        F.col("is_round_number_rate").alias("round_number_rate"),
        "total_transactions",
        "flagged_transactions",
        "estimated_exposure",
    )
