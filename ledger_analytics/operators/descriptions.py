"""Description audit: weighted patterns over the payment text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_analytics import fixed_values as fv
from ledger_analytics.config import AnalysisConfig
from ledger_analytics.functions.numeric import js_round
from ledger_analytics.functions.text import java_pattern, required_text, utf16_length, ws_trim
from ledger_analytics.operators.profile import LedgerProfile


def _matches(pattern: str) -> Column:
    """Whether the description matches. Most descriptions lack the letters a pattern starts with,
    and are turned down without it."""
    text, found = required_text(pattern), F.col("_desc").rlike(java_pattern(pattern))
    return F.col("_lower").contains(text) & found if text else found


def with_description_audit(
    ledger: DataFrame, profile: LedgerProfile, config: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """Add description_risk (0-100) and triggered_keywords. No shuffle."""
    desc, amount = F.col("_desc"), F.col("amount")
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    _matches(pattern),
                    F.struct(F.lit(weight).alias("weight"), F.lit(label).alias("label")),
                )
                for pattern, weight, label in fv.DESCRIPTION_PATTERNS
            ]
        )
    )
    short = F.struct(F.lit(20).alias("weight"), F.lit(fv.SHORT_DESCRIPTION_LABEL).alias("label"))
    missing = desc == ""
    above_p75 = amount > profile.p75
    above_half = amount > max(profile.max_amount, 1.0) * 0.5
    capped = F.col("_raw").cast("double")
    # capping after each factor and once at the end give the same score
    weighted = capped * F.when(above_p75, 1.3).otherwise(1.0)
    weighted = F.least(weighted, F.lit(100.0)) * F.when(above_half, 1.2).otherwise(1.0)
    absent = F.lit(float(config.missing_description_score)) * F.when(above_p75, 1.4).otherwise(1.0)
    risk = F.when(missing, absent).otherwise(weighted)
    return (
        ledger.withColumn("_desc", F.coalesce(ws_trim(F.col("description")), F.lit("")))
        .withColumn("_lower", F.lower(desc))
        .withColumn("_hits", hits)
        .withColumn(
            "_hits",
            F.when((F.size("_hits") == 0) & (utf16_length(desc) < 5), F.array(short)).otherwise(
                F.col("_hits")
            ),
        )
        .withColumn("_raw", F.aggregate("_hits", F.lit(0), lambda s, h: s + h["weight"]))
        .select(
            *ledger.columns,
            F.least(F.lit(100), js_round(risk)).cast("int").alias("description_risk"),
            F.when(missing, F.array(F.lit(fv.MISSING_DESCRIPTION_LABEL)))
            .otherwise(F.transform("_hits", lambda h: h["label"]))
            .alias("triggered_keywords"),
        )
    )
