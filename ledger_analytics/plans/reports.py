"""Roll-ups and display tables over the scored transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_analytics import fixed_values as fv
from ledger_analytics.functions.numeric import total_amount
from ledger_analytics.operators.benford import chi_critical, mad_category
from ledger_analytics.operators.order_stats import order_statistics, value_counts
from ledger_analytics.operators.scoring import is_flagged

# What each detector looks at and why, for the explanation sheet.
EXPLANATIONS = {
    "BENFORD_1ST": (
        "Leading digits are not distributed as Benford's law predicts.",
        "In naturally grown amounts a leading 1 is about six times as frequent as a leading 9. "
        "Invented or adjusted figures rarely keep that shape.",
    ),
    "BENFORD_2ND": (
        "Second digits are not distributed as Benford's law predicts.",
        "Second digits fall off gently from 0 to 9. Peaks point to rounding or to amounts chosen "
        "around a limit.",
    ),
    "ROUND_NUMBER": (
        "The amount is a full thousand or ends just under an approval limit.",
        "Real invoices seldom come to a full thousand, or to a few dollars less than the amount "
        "that would need a signature.",
    ),
    "ISOLATION_FOREST": (
        "The amount stands apart from the rest of the ledger.",
        "Random splits of the amounts separate unusual values in few steps; the fewer steps on "
        "average, the higher the score.",
    ),
    "RSF": (
        "The amount is large compared with what this vendor usually bills.",
        "The amount divided by the vendor's median. More than three times the median suggests a "
        "keying error or an inflated invoice.",
    ),
    "EXACT_DUPLICATE": (
        "Another payment has the same vendor, date and amount.",
        "Two payments that agree in all three are likely one invoice paid twice.",
    ),
    "FUZZY_DUPLICATE": (
        "A payment of similar size went to a vendor with nearly the same name.",
        "One or two changed letters in a vendor name get past exact duplicate checks.",
    ),
    "SPLIT_INVOICE": (
        "Payments within a week stay under an approval limit one by one and cross it together.",
        "A purchase cut into similar parts avoids the approval the whole would need.",
    ),
    "DESCRIPTION_AUDIT": (
        "The payment text is missing, vague or names a risky category.",
        "Texts such as a bare 'consulting' or 'misc' say nothing that could be checked.",
    ),
    "EDGAR_UNVERIFIED": (
        "The vendor is not in the company registry and the amount is unusually large.",
        "A registry match confirms a company; no match alone is common, with a large amount it is not.",
    ),
    "OFAC_HIT": (
        "The vendor name matches a sanctions list entry.",
        "Payments to listed parties are prohibited, so a match raises the score to its maximum.",
    ),
    "ADDRESS_INVALID": (
        "The vendor address cannot be found or is not a place of business.",
        "Made-up vendors tend to have made-up, residential or mail-drop addresses.",
    ),
}


def detector_dimension(spark: SparkSession, detectors: list[str] | None = None) -> DataFrame:
    """(ordinal, detector, name, label, short, long, basis), in the given or standard order."""
    info = {key: (name, label, basis) for key, name, label, basis in fv.DETECTORS}
    rows = [
        (i, d, info[d][0], info[d][1], *EXPLANATIONS[d], info[d][2])
        for i, d in enumerate(detectors or list(info))
    ]
    return spark.createDataFrame(
        rows,
        "ordinal int, detector string, name string, label string, short string, long string, basis string",
    )


# --- filters, order, pages -------------------------------------------------


def filter_transactions(
    scored: DataFrame,
    tier: str | None = None,
    search: str | None = None,
    min_amount: float | None = None,
    max_amount: float | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    detector: str | None = None,
) -> DataFrame:
    """The transaction view's filters; an argument left out does not restrict."""
    tests: list[Column] = []
    if tier is not None and tier != "ALL":
        if tier not in fv.TIERS:
            raise ValueError(f"unknown tier {tier}")
        tests.append(F.col("risk_tier") == tier)
    if search:
        text = F.lower(F.lit(search))
        tests.append(
            F.contains(F.lower("vendor"), text) | F.contains(F.lower("invoice_id"), text)
        )
    if min_amount is not None:
        tests.append(F.col("amount") >= min_amount)
    if max_amount is not None:
        tests.append(F.col("amount") <= max_amount)
    if date_from:
        tests.append(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to:
        tests.append(F.col("date") <= F.lit(date_to).cast("date"))
    if detector:
        tests.append(F.array_contains("triggered_detectors", detector))
    return reduce(lambda df, t: df.where(t), tests, scored)


def sort_columns(key: str, ascending: bool) -> list[Column]:
    """Order by date, vendor, amount or composite_risk; ties in input order."""
    if key not in ("date", "vendor", "amount", "composite_risk"):
        raise ValueError(f"cannot sort by {key}")
    col = F.collate(F.col("vendor"), "UNICODE") if key == "vendor" else F.col(key)
    return [col.asc() if ascending else col.desc(), F.col("txn_id").asc()]


def sort_transactions(
    scored: DataFrame, key: str = "composite_risk", ascending: bool = False
) -> DataFrame:
    return scored.orderBy(*sort_columns(key, ascending))


def page(ordered: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    return ordered.offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int = 50) -> DataFrame:
    """One row: n and total_pages, at least one."""
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.greatest(F.ceil(F.col("n") / size), F.lit(1)).alias("total_pages")
    )


def flagged_transactions(scored: DataFrame) -> DataFrame:
    return scored.where(is_flagged()).orderBy(F.desc("composite_risk"), "txn_id")


# --- vendors ---------------------------------------------------------------


def vendor_risk(scored: DataFrame) -> DataFrame:
    """Counts, spend, average and highest score per vendor."""
    return scored.groupBy("vendor").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        total_amount(F.col("amount")).alias("total_spend"),
        F.round(F.avg("composite_risk"), 2).alias("avg_risk_score"),
        F.max("composite_risk").alias("max_risk_score"),
        F.count_if(is_flagged()).alias("flagged_transactions"),
        F.min("txn_id").alias("first_txn"),
    )


_TIER_RANK = {t: i for i, t in enumerate(reversed(fv.TIERS))}


def vendor_view(scored: DataFrame) -> DataFrame:
    """Vendor page: counts, spend, upper median, average score, flagged rows, worst tier."""
    rank = F.coalesce(*[F.when(F.col("risk_tier") == t, r) for t, r in _TIER_RANK.items()])
    totals = scored.groupBy("vendor").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        total_amount(F.col("amount")).alias("total_spend"),
        F.avg("composite_risk").alias("avg_score"),
        F.count_if(is_flagged()).alias("flagged"),
        F.max(rank).alias("tier_rank"),
        F.min("txn_id").alias("first_txn"),
    )
    medians = order_statistics(
        value_counts(scored.select("vendor", "amount"), ["vendor"], "amount"),
        ["vendor"],
        "amount",
        ["median_hi"],
    )
    tier = F.coalesce(*[F.when(F.col("tier_rank") == r, t) for t, r in _TIER_RANK.items()])
    return totals.join(medians, "vendor").select(
        "vendor",
        "transaction_count",
        "total_spend",
        F.col("median_hi").alias("median_amount"),
        "avg_score",
        "flagged",
        tier.alias("max_tier"),
        "first_txn",
    )


def top_vendors(view: DataFrame, n: int = 100) -> DataFrame:
    return view.orderBy(F.desc("avg_score"), "first_txn").limit(n)


def vendor_totals(view: DataFrame) -> DataFrame:
    """One row: vendors, flagged vendors, flagged rows, spend."""
    return view.agg(
        F.count(F.lit(1)).alias("vendors"),
        F.count_if(F.col("flagged") > 0).alias("flagged_vendors"),
        F.coalesce(F.sum("flagged"), F.lit(0)).alias("total_flagged"),
        total_amount(F.col("total_spend")).alias("total_spend"),
    )


def vendor_transactions(scored: DataFrame, vendor: str) -> DataFrame:
    return scored.where(F.col("vendor") == vendor).orderBy(F.desc("composite_risk"), "txn_id")


def top_flagged_vendor(scored: DataFrame) -> DataFrame:
    """The vendor with the most flagged rows; the first seen on a tie."""
    return (
        scored.where(is_flagged())
        .groupBy("vendor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("txn_id").alias("first_txn"))
        .orderBy(F.desc("n"), "first_txn")
        .limit(1)
        .select("vendor", "n")
    )


# --- detectors -------------------------------------------------------------


def detector_counts(scored: DataFrame, detectors: list[str] | None = None) -> DataFrame:
    """(ordinal, detector, name, n, rate, is_passing) with a row for every detector."""
    dim = detector_dimension(scored.sparkSession, detectors)
    fired = (
        scored.select(F.explode("triggered_detectors").alias("detector"))
        .groupBy("detector")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = scored.agg(F.count(F.lit(1)).alias("n")).scalar()
    n = F.coalesce(F.col("n"), F.lit(0))
    return F.broadcast(dim).join(fired, "detector", "left").select(
        "ordinal",
        "detector",
        "name",
        n.alias("n"),
        F.coalesce(F.try_divide(n, total), F.lit(0.0)).alias("rate"),
        (n == 0).alias("is_passing"),
    )


def detector_chart(scored: DataFrame, enabled: list[str]) -> DataFrame:
    """Counts of the enabled detectors, largest first."""
    counts = detector_counts(scored, fv.DASHBOARD_DETECTORS)
    return counts.where(F.col("detector").isin(*enabled)).orderBy(F.desc("n"), "ordinal")


def top_detectors(scored: DataFrame, n: int = 3) -> DataFrame:
    counts = detector_counts(scored, fv.DASHBOARD_DETECTORS)
    return counts.where("n > 0").orderBy(F.desc("n"), "ordinal").limit(n)


# --- scores and time -------------------------------------------------------


def score_histogram(scored: DataFrame) -> DataFrame:
    """(bin, n) for the ten bins of width 10; 100 falls into the last."""
    counts = scored.groupBy(
        F.least(F.floor(F.col("composite_risk") / 10), F.lit(9)).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    bins = scored.sparkSession.range(10).select(F.col("id").alias("bin"))
    return F.broadcast(bins).join(counts, "bin", "left").select(
        F.col("bin").cast("int").alias("bin"), F.coalesce("n", F.lit(0)).alias("n")
    )


def tier_counts(scored: DataFrame) -> DataFrame:
    """One row: ALL and one column per tier."""
    return scored.agg(
        F.count(F.lit(1)).alias("ALL"),
        *[F.count_if(F.col("risk_tier") == t).alias(t) for t in fv.TIERS],
    )


def _tiers_by(scored: DataFrame, period: Column, name: str) -> DataFrame:
    return (
        scored.groupBy(period.alias(name))
        .agg(*[F.count_if(F.col("risk_tier") == t).alias(t) for t in fv.TIERS])
        .orderBy(name)
    )


def tiers_by_month(scored: DataFrame) -> DataFrame:
    return _tiers_by(scored, F.date_format("date", "yyyy-MM"), "month")


def tiers_by_day(scored: DataFrame) -> DataFrame:
    return _tiers_by(scored, F.col("date"), "date")


# --- display rows ----------------------------------------------------------


def money(c: Column) -> Column:
    """Dollars without cents. Rounded first: the formatter alone rounds half to even."""
    return F.concat(F.lit("$"), F.format_number(F.round(c), 0))


def exposure_text(c: Column) -> Column:
    return (
        F.when(c >= 1_000_000, F.concat(F.lit("$"), fixed(c / 1_000_000, 2), F.lit(" million")))
        .when(c >= 1_000, F.concat(F.lit("$"), fixed(c / 1_000, 1), F.lit("k")))
        .otherwise(money(c))
    )


def fixed(c: Column, places: int) -> Column:
    """Text with a fixed number of decimals."""
    return c.cast(f"decimal(38,{places})").cast("string")


def detector_message(detector: str) -> Column:
    fired_text, clear_text = fv.DETAIL_MESSAGES[detector]
    values = {
        "RSF": fixed(F.col("rsf"), 1),
        "ISOLATION_FOREST": F.col("isolation_score").cast("string"),
        "DESCRIPTION_AUDIT": F.col("description_risk").cast("string"),
        "BENFORD_1ST": F.col("benford_first_digit").cast("string"),
    }

    def text(template: str) -> Column:
        if "%s" not in template:
            return F.lit(template)
        before, after = template.split("%s")
        return F.concat(F.lit(before), values[detector], F.lit(after))

    out = F.when(F.array_contains("triggered_detectors", detector), text(fired_text)).otherwise(
        text(clear_text)
    )
    if detector == "EDGAR_UNVERIFIED":
        out = F.when(F.col("edgar_verified"), fv.DETAIL_REGISTRY_CONFIRMED).otherwise(out)
    if detector in fv.DETAIL_NOT_CHECKED:
        out = F.when(_verdict(detector).isNull(), fv.DETAIL_NOT_CHECKED[detector]).otherwise(out)
    return out


def _verdict(detector: str) -> Column:
    return F.col(
        {
            "OFAC_HIT": "ofac_hit",
            "EDGAR_UNVERIFIED": "edgar_verified",
            "ADDRESS_INVALID": "address_valid",
        }[detector]
    )


def detector_status(detector: str) -> Column:
    """PASS, FAIL, INFO (no registry match, nothing else wrong) or N/A (not checked)."""
    fired = F.array_contains("triggered_detectors", detector)
    out = F.when(fired, "FAIL").otherwise("PASS")
    if detector == "EDGAR_UNVERIFIED":
        out = F.when(F.col("edgar_verified"), "PASS").when(fired, "FAIL").otherwise("INFO")
    if detector in fv.DETAIL_NOT_CHECKED:
        out = F.when(_verdict(detector).isNull(), "N/A").otherwise(out)
    return out


def display_rows(scored: DataFrame) -> DataFrame:
    """Rows of the transaction table with the detector drill-down."""
    names = {key: name for key, name, _, _ in fv.DETECTORS}
    labels = F.create_map(*[F.lit(x) for key, _, label, _ in fv.DETECTORS for x in (key, label)])
    titles = F.create_map(*[F.lit(x) for pair in fv.TIER_TITLES.items() for x in pair])
    results = F.array(
        *[
            F.struct(
                F.lit(names[d]).alias("name"),
                detector_message(d).alias("description"),
                detector_status(d).alias("status"),
            )
            for d in fv.DETAIL_DETECTORS
        ]
    )
    return scored.select(
        "txn_id",
        F.col("invoice_id").alias("id"),
        "date",
        "vendor",
        money(F.col("amount")).alias("amount"),
        F.coalesce(F.element_at(titles, F.col("risk_tier")), F.lit("Low")).alias("risk"),
        F.col("composite_risk").alias("score"),
        F.transform("triggered_detectors", lambda d: F.element_at(labels, d)).alias("detectors"),
        results.alias("detector_results"),
    )


def score_details(scored: DataFrame) -> DataFrame:
    """(txn_id, label, value, bar): the five raw scores of a transaction."""
    c = F.col
    items = [
        ("Isolation Score", fixed(c("isolation_score"), 2), c("isolation_score").cast("double")),
        ("RSF", F.concat(fixed(c("rsf"), 2), F.lit("x")), F.least(c("rsf") * 20, F.lit(100.0))),
        ("Description Risk", fixed(c("description_risk"), 2), c("description_risk").cast("double")),
        ("Benford 1st digit", c("benford_first_digit").cast("string"), F.lit(0.0)),
        ("Duplicate count", c("dup_count").cast("string"), F.when(c("dup_count") > 1, 100.0).otherwise(0.0)),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("label"), value.alias("value"), bar.alias("bar"))
            for label, value, bar in items
        ]
    )
    return scored.select("txn_id", F.inline(rows))


def report_rows(scored: DataFrame) -> DataFrame:
    """The columns of the transaction sheets."""

    def yes(flag: Column) -> Column:
        return F.when(flag, "YES").otherwise("")

    c = F.col
    return scored.select(
        "txn_id",
        c("invoice_id").alias("Invoice"),
        c("date").alias("Date"),
        c("vendor").alias("Vendor"),
        c("amount").alias("Amount"),
        F.coalesce("description", F.lit("")).alias("Description"),
        c("risk_tier").alias("Risk Tier"),
        c("composite_risk").alias("Composite Score"),
        c("isolation_score").alias("Isolation Score"),
        F.round("rsf", 2).alias("RSF"),
        yes(c("rsf_flag")).alias("RSF Flagged"),
        yes(c("is_exact_duplicate")).alias("Exact Duplicate"),
        yes(c("fuzzy_dup_group").isNotNull()).alias("Fuzzy Duplicate"),
        yes(c("is_split_invoice")).alias("Split Invoice"),
        yes(c("is_round_number")).alias("Round Number"),
        c("description_risk").alias("Description Risk"),
        F.array_join("triggered_detectors", ", ").alias("Detectors Triggered"),
    )


def _percent(c: Column) -> Column:
    return F.concat(fixed(c * 100, 2), F.lit("%"))


def executive_summary(portfolio: DataFrame, benford: DataFrame) -> DataFrame:
    """(ordinal, Metric, Value): thirteen lines of text."""
    pos, mad = F.col("digit_position"), F.col("mad")
    b = benford.agg(
        *[F.max(F.when(pos == p, mad)).alias(f"mad{p}") for p in (1, 2)],
    )
    mads = {p: b.select(f"mad{p}").scalar() for p in (1, 2)}
    lines = [
        ("Total Transactions", F.col("total_transactions").cast("string")),
        ("Flagged Transactions", F.col("flagged_transactions").cast("string")),
        ("Estimated Exposure", fixed(F.col("estimated_exposure"), 2)),
        ("Portfolio Risk Score", F.col("score").cast("string")),
        ("Risk Tier", F.col("tier")),
        ("Outlier Rate", _percent(F.col("outlier_rate"))),
        ("RSF Flag Rate", _percent(F.col("rsf_flag_rate"))),
        ("Duplicate Rate", _percent(F.col("duplicate_rate"))),
        ("Round Number Rate", _percent(F.col("round_number_rate"))),
        ("Benford 1st-digit MAD", fixed(F.col("benford_mad"), 4)),
        ("Benford 1st conformity", mad_category(F.col("mad1"), F.lit(1), "label")),
        ("Benford 2nd-digit MAD", fixed(F.col("mad2"), 4)),
        ("Benford 2nd conformity", mad_category(F.col("mad2"), F.lit(2), "label")),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(m).alias("Metric"), v.alias("Value"))
            for i, (m, v) in enumerate(lines)
        ]
    )
    return (
        portfolio.select("*", mads[1].alias("mad1"), mads[2].alias("mad2"))
        .select(F.inline(rows))
        .orderBy("ordinal")
    )


def detector_explanations(scored: DataFrame) -> DataFrame:
    counts = detector_counts(scored)
    dim = detector_dimension(scored.sparkSession)
    return (
        dim.join(counts.select("detector", "n", "rate"), "detector")
        .orderBy("ordinal")
        .select(
            "ordinal",
            F.col("name").alias("Detector"),
            F.col("short").alias("Short Description"),
            F.col("long").alias("Full Explanation"),
            F.col("basis").alias("Methodology Basis"),
            F.col("n").alias("Transactions Flagged"),
            _percent(F.col("rate")).alias("Flag Rate"),
        )
    )


CHI_SQUARE_NOTE = (
    "Chi-square adds up the squared gaps between observed and expected digit shares; larger means "
    "further from Benford. Critical values at 5%: 15.51 (first digit, 8 degrees of freedom) and "
    "16.92 (second digit, 9)."
)


def benford_rows(benford: DataFrame) -> DataFrame:
    """Two lines of the Benford sheet."""
    pos, mad = F.col("digit_position"), F.col("mad")
    return benford.orderBy("digit_position").select(
        F.when(pos == 1, "1st digit").otherwise("2nd digit").alias("Position"),
        F.round(mad, 4).alias("MAD"),
        mad_category(mad, pos, "label").alias("MAD Category"),
        mad_category(mad, pos, "range").alias("MAD Range (Nigrini)"),
        mad_category(mad, pos, "description").alias("MAD Interpretation"),
        F.round("chi_square", 4).alias("Chi-Square"),
        chi_critical(pos).alias("Chi-Square Critical (α=0.05)"),
        F.when(F.col("chi_square") > chi_critical(pos), "YES").otherwise("NO").alias(
            "Chi-Square Significant"
        ),
        F.lit(CHI_SQUARE_NOTE).alias("Chi-Square Note"),
    )


def vendor_rows(scored: DataFrame) -> DataFrame:
    """The vendor sheet, riskiest first."""
    return (
        vendor_risk(scored)
        .orderBy(F.desc("avg_risk_score"), "first_txn")
        .select(
            F.col("vendor").alias("Vendor"),
            F.col("transaction_count").alias("Transaction Count"),
            F.col("total_spend").alias("Total Spend"),
            F.col("avg_risk_score").alias("Avg Risk Score"),
            F.col("max_risk_score").alias("Max Risk Score"),
            F.col("flagged_transactions").alias("Flagged Transactions"),
        )
    )


def report_tables(result) -> dict[str, DataFrame]:
    """The six sheets of the risk report, by name."""
    scored = result.transactions
    return {
        "executive_summary": executive_summary(result.portfolio, result.benford),
        "flagged_transactions": report_rows(flagged_transactions(scored)).drop("txn_id"),
        "all_transactions": report_rows(scored).drop("txn_id"),
        "detector_explanations": detector_explanations(scored).drop("ordinal"),
        "benford_analysis": benford_rows(result.benford),
        "vendor_risk": vendor_rows(scored),
    }


def write_report(result, path: str, format: str = "csv") -> dict[str, str]:
    """Write each sheet to its own directory under ``path``; returns the directories."""
    out = {}
    for name, df in report_tables(result).items():
        out[name] = f"{path.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        if format == "csv":
            writer.option("header", True).option("escape", '"').csv(out[name])
        else:
            writer.format(format).save(out[name])
    return out
