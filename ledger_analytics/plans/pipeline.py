"""The whole analysis: detectors, screening, scores and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_analytics.config import AnalysisConfig
from ledger_analytics.functions.numeric import first_digit, is_round, second_digit
from ledger_analytics.functions.text import vendor_lower
from ledger_analytics.operators.benford import (
    benford_summary,
    digit_report,
    round_number_report,
    threshold_distribution,
)
from ledger_analytics.operators.descriptions import with_description_audit
from ledger_analytics.operators.duplicates import exact_duplicates
from ledger_analytics.operators.forest import fit_forest, with_isolation
from ledger_analytics.operators.fuzzy import fuzzy_duplicates
from ledger_analytics.operators.profile import LedgerProfile, profile_ledger
from ledger_analytics.operators.rsf import with_rsf
from ledger_analytics.operators.scoring import portfolio_summary, with_composite
from ledger_analytics.operators.screening import ScreeningLists, suspect_vendors, vendor_verdicts
from ledger_analytics.operators.skew import join_attributes
from ledger_analytics.operators.splits import split_invoices
from ledger_analytics.schema import is_valid_row
from ledger_analytics.sources.materialize import materialize, scratch


@dataclass(frozen=True)
class AnalysisResult:
    """The result bundle; every member is a DataFrame."""

    transactions: DataFrame
    benford_digits: DataFrame
    benford: DataFrame
    round_number: DataFrame
    round_thresholds: DataFrame
    portfolio: DataFrame


def pair_signals(
    ledger: DataFrame, profile: LedgerProfile, config: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """Exact duplicates, fuzzy duplicates and split invoices: one narrow record per
    row that at least one of the three flags.

    Merging them by txn_id first means that the wide ledger is joined once instead
    of once per detector, on a key that cannot be skewed.
    """
    return (
        exact_duplicates(ledger)
        .join(fuzzy_duplicates(ledger, profile, config), "txn_id", "full")
        .join(split_invoices(ledger, profile, config), "txn_id", "full")
    )


def with_pair_signals(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """Add the duplicate, fuzzy-duplicate and split columns to all rows."""
    return rows.join(signals, "txn_id", "left").select(
        *rows.columns,
        F.col("dup_count").isNotNull().alias("is_exact_duplicate"),
        F.coalesce("dup_count", F.lit(1)).alias("dup_count"),
        "dup_group_key",
        "fuzzy_dup_group",
        "fuzzy_match_txn_id",
        "fuzzy_distance",
        F.col("split_cluster_id").isNotNull().alias("is_split_invoice"),
        "split_cluster_id",
        "cluster_total",
        "cluster_size",
        "suspected_threshold",
    )


def with_row_signals(
    ledger: DataFrame, profile: LedgerProfile, config: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """Add what needs no other row: digits, round flag, description audit."""
    amount = F.col("amount")
    rows = ledger.select(
        "*",
        F.coalesce(first_digit(amount), F.lit(1)).alias("benford_first_digit"),
        second_digit(amount).alias("benford_second_digit"),
        is_round(amount, config.round_thresholds, config.round_margin).alias("is_round_number"),
    )
    return with_description_audit(rows, profile, config)


def with_verdicts(rows: DataFrame, verdicts: DataFrame | None, ledger: DataFrame | None = None) -> DataFrame:
    """Add edgar_verified, ofac_hit, address_valid by lower-case vendor; null if unknown.

    Vendors are counted in ``ledger``, if given: the table that ``rows`` were made of, row by row.
    """
    names = ["edgar_verified", "ofac_hit", "address_valid"]
    if verdicts is None:
        return rows.select("*", *[F.lit(None).cast("boolean").alias(c) for c in names])
    counted = rows if ledger is None else ledger
    name = vendor_lower(F.col("vendor")).alias("vendor_lower")
    keyed = rows.select("*", name)
    counts = counted.groupBy(name).agg(F.count(F.lit(1)).alias("vendor_rows"))
    known = counts.join(verdicts.select("vendor_lower", *names), "vendor_lower", "left")
    return join_attributes(keyed, known, "vendor_lower", "vendor_rows", counted.count(), "verdicts").select(*rows.columns, *names)


def _scored(
    ledger: DataFrame, config: AnalysisConfig, lists: ScreeningLists | None, verdicts: DataFrame | None
) -> DataFrame:
    """All detectors and scores, stored."""
    profile = profile_ledger(ledger)
    rows = with_rsf(ledger, profile, config)
    signals = pair_signals(ledger, profile, config)
    forest = fit_forest(ledger, profile, config)
    if verdicts is None and lists is not None:
        signals = materialize(signals, "pair-signals")  # read for the suspects and again for all rows
        suspects = suspect_vendors(with_isolation(with_pair_signals(rows, signals), forest))
        verdicts = vendor_verdicts(ledger, suspects, lists, config)
    # the verdicts come first, while the rows are narrow; their place is behind the detectors
    names = ["edgar_verified", "ofac_hit", "address_valid"]
    rows = with_pair_signals(with_verdicts(rows, verdicts, ledger), signals)
    rows = with_isolation(with_row_signals(rows, profile, config), forest)
    rows = rows.select(*[c for c in rows.columns if c not in names], *names)
    return materialize(with_composite(rows, config), "scored", keep=True)


def analyze(
    ledger: DataFrame,
    config: AnalysisConfig = AnalysisConfig(),
    lists: ScreeningLists | None = None,
    verdicts: DataFrame | None = None,
) -> AnalysisResult:
    """Run every detector over ``ledger`` and score its rows.

    Rows that the row guard turns down (no id, date or vendor, an amount that is not
    positive or out of range) are left out. Jobs run while the analysis is built.
    External checks come either as ready ``verdicts`` (vendor_lower,
    edgar_verified, ofac_hit, address_valid) or are made from ``lists``.
    The ledger is read once per detector with only the columns it needs, so it
    should be a stored table; the scored rows are written to the checkpoint
    folder once because every report reads them. Other tables written on the way are
    removed.
    """
    ledger = ledger.where(is_valid_row())
    with scratch(ledger.sparkSession):
        transactions = _scored(ledger, config, lists, verdicts)
    digits = digit_report(ledger)
    summary = benford_summary(digits)
    first_mad = summary.where("digit_position = 1").select("mad").scalar()
    return AnalysisResult(
        transactions=transactions,
        benford_digits=digits,
        benford=summary,
        round_number=round_number_report(ledger, config),
        round_thresholds=threshold_distribution(ledger, config),
        portfolio=portfolio_summary(transactions, first_mad),
    )
