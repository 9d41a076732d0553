import datetime as dt

import pytest
from helpers import by_id
from pyspark.sql import functions as F

from ledger_analytics import fixed_values as fv
from ledger_analytics.config import AnalysisConfig
from ledger_analytics.functions.numeric import first_digit, is_round, just_below, second_digit
from ledger_analytics.functions.text import java_pattern, required_text
from ledger_analytics.operators import benford, descriptions, duplicates, fuzzy, rsf, splits
from ledger_analytics.operators.forest import fit_forest, with_isolation
from ledger_analytics.operators.profile import profile_ledger
from ledger_analytics.operators.scoring import with_composite
from ledger_analytics.plans.pipeline import analyze

CFG = AnalysisConfig()


def amounts(*values, **fields):
    return [{"amount": v, **fields} for v in values]


# --- Benford -----------------------------------------------------------------


def first(df):
    return benford.benford_summary(benford.digit_report(df)).where("digit_position = 1").first()


def test_benford_natural_amounts_conform(make, lognormal):
    df = make(lognormal(1000))
    s = first(df)
    assert (s.conformity, s.total_records) == ("ACCEPTABLE", 1000)
    assert s.mad < 0.012
    one = benford.digit_report(df).where("digit_position = 1 AND digit = 1").first()
    assert one.observed_pct > 25


def test_benford_uniform_digits_do_not_conform(make):
    s = first(make(amounts(*[d * 10000 + i for d in range(1, 10) for i in range(100)])))
    assert s.conformity == "NON_CONFORMING" and s.mad > 0.015


def test_benford_expected_shares(make):
    rows = benford.digit_report(make(amounts(5))).collect()
    expected = {(r.digit_position, r.digit): r.expected_pct for r in rows}
    assert len(rows) == 19
    assert expected[1, 1] == pytest.approx(30.103, abs=1e-3)
    assert expected[1, 9] == pytest.approx(4.576, abs=1e-3)
    assert 11 < expected[2, 0] < 13


def test_benford_empty(make):
    rows = benford.benford_summary(benford.digit_report(make([]))).collect()
    assert [(r.total_records, r.mad, r.conformity) for r in rows] == [(0, 0.0, "ACCEPTABLE")] * 2


def test_second_digit_needs_two_digits(make):
    s = benford.benford_summary(benford.digit_report(make(amounts(5, 123)))).where("digit_position = 2")
    assert s.first().total_records == 1


@pytest.mark.parametrize(
    "amount, d1, d2",
    [(5.5, 5, 5), (0.05, 5, None), (100.0, 1, 0), (12345678.9, 1, 2), (5.0, 5, None),
     (1.23e7, 1, 2), (1e15, 1, 0), (0.0123, 1, 2), (20.5, 2, 0)],
)
def test_digits(make, amount, d1, d2):
    r = make(amounts(amount)).select(first_digit(F.col("amount")), second_digit(F.col("amount"))).first()
    assert tuple(r) == (d1, d2)


# --- round numbers -------------------------------------------------------------


def test_round_rate_flags(make, lognormal):
    rows = [{"amount": 1000 * (i + 1)} for i in range(20)] + lognormal(80)
    r = benford.round_number_report(make(rows)).first()
    assert r.flagged and r.round_count >= 20


def test_round_natural_amounts(make, lognormal):
    assert benford.round_number_report(make(lognormal(200))).first().round_rate < 0.15


def test_just_below(make):
    a = F.col("amount")
    got = make(amounts(9998, 4999, 985, 984.99, 1000)).select(
        is_round(a, CFG.round_thresholds, 15), just_below(a, CFG.round_thresholds, 15)
    )
    assert [tuple(r) for r in got.collect()] == [
        (True, True), (True, True), (True, True), (False, False), (True, False)
    ]


def test_threshold_distribution_is_two_sided(make):
    got = {r.threshold: r.n for r in benford.threshold_distribution(make(amounts(9990, 510, 80000))).collect()}
    assert got == {9999.0: 1, 10000.0: 1, 500.0: 1}


def test_round_empty(make):
    r = benford.round_number_report(make([])).first()
    assert tuple(r) == (0, 0.0, False)


# --- isolation forest ----------------------------------------------------------


def isolation(df, cfg=CFG):
    return with_isolation(df, fit_forest(df, profile_ledger(df), cfg))


def test_isolation_scores_every_row(make, lognormal):
    rows = isolation(make(lognormal(200))).collect()
    assert len(rows) == 200 and all(0 <= r.isolation_score <= 100 for r in rows)
    rate = sum(r.is_outlier for r in rows) / 200
    assert abs(rate - 0.05) < 0.03


def test_isolation_finds_the_extreme(make, lognormal):
    got = by_id(isolation(make(lognormal(100) + amounts(750_000))))
    assert got[100].isolation_score > 70 and got[100].is_outlier


def test_isolation_single_row_and_constant(make):
    one = isolation(make(amounts(5000))).collect()
    assert [(r.isolation_score, r.is_outlier) for r in one] == [(0, False)]
    same = isolation(make(amounts(*[5000] * 30))).collect()
    assert {(r.isolation_score, r.is_outlier) for r in same} == {(0, True)}


def test_isolation_empty(make):
    assert isolation(make([])).count() == 0


def test_isolation_does_not_depend_on_partitions(make, lognormal):
    df = make(lognormal(300) + amounts(1, 900_000))
    results = []
    for n in (1, 4, 17):
        got = isolation(df.repartition(n, "invoice_id")).select("txn_id", "raw_score", "isolation_score")
        results.append(sorted(tuple(r) for r in got.collect()))
    assert results[0] == results[1] == results[2]


def test_isolation_orders_by_rarity(make, lognormal):
    got = by_id(isolation(make(lognormal(400) + amounts(8000, 5_000_000, 0.5))))
    assert got[401].isolation_score > got[400].isolation_score
    assert got[402].isolation_score > got[400].isolation_score


# --- relative size ---------------------------------------------------------------


def rsf_rows(df):
    return by_id(rsf.with_rsf(df, profile_ledger(df)))


def test_rsf_flags_spike(make):
    got = rsf_rows(make(amounts(*[5000 + i for i in range(15)], 75_000)))
    assert got[15].rsf_flag and got[15].rsf > 10 and not got[0].rsf_flag


def test_rsf_moderate_is_clear(make):
    got = rsf_rows(make(amounts(*[10_000 + i for i in range(10)], 22_000)))
    assert not got[10].rsf_flag


def test_rsf_single_row(make):
    got = rsf_rows(make(amounts(50_000)))
    assert (got[0].rsf, got[0].rsf_zscore) == (1.0, 0.0)


def test_rsf_fallback_below_five_rows(make):
    rows = [{"vendor": "big", "amount": 100.0}] * 9
    got = rsf_rows(make(rows + [{"vendor": "four", "amount": 1000.0}] * 4))
    assert got[10].rsf == 10.0 and got[10].vendor_median == 1000.0
    got = rsf_rows(make(rows + [{"vendor": "five", "amount": 1000.0}] * 5))
    assert got[10].rsf == 1.0


def test_top_vendors_by_exposure(make):
    rows = [{"vendor": v, "amount": 100.0} for v in "abc" for _ in range(9)]
    rows += [{"vendor": "a", "amount": 500.0}, {"vendor": "b", "amount": 900.0}]
    df = make(rows)
    top = rsf.top_rsf_vendors(rsf.with_rsf(df, profile_ledger(df)), 5).collect()
    assert [(r.vendor, r.flag_count, r.total_exposure) for r in top] == [("b", 1, 900.0), ("a", 1, 500.0)]


# --- duplicates -------------------------------------------------------------------


def exact(df):
    got = by_id(duplicates.exact_duplicates(df))
    return {i: r.dup_count for i, r in got.items()}


def test_exact_duplicates(make):
    rows = [{"amount": 12_450, "date": d} for d in ("2024-03-15", "2024-03-15", "2024-03-16")]
    assert exact(make(rows)) == {0: 2, 1: 2}
    assert exact(make(amounts(7, 7, 7))) == {0: 3, 1: 3, 2: 3}
    assert exact(make(amounts(1000, 1001))) == {}


def test_exact_duplicates_ignore_case_and_blanks(make):
    rows = [{"amount": 5000, "vendor": v} for v in ("ACME Corp", "acme corp", " Acme\t  Corp ")]
    assert exact(make(rows)) == {0: 3, 1: 3, 2: 3}


def fuzzy_rows(df, cfg=CFG):
    return by_id(fuzzy.fuzzy_duplicates(df, profile_ledger(df), cfg))


def test_fuzzy_pair(make):
    got = fuzzy_rows(make([{"amount": 5000, "vendor": v} for v in ("Meridian IT", "Meridan IT")]))
    assert {i: (r.fuzzy_match_txn_id, r.fuzzy_distance) for i, r in got.items()} == {0: (1, 1), 1: (0, 1)}
    assert len({r.fuzzy_dup_group for r in got.values()}) == 1


def test_fuzzy_bands(make):
    rows = [{"amount": 1000, "vendor": "Meridian"}, {"amount": 3000, "vendor": "Meridan"}]
    assert set(fuzzy_rows(make(rows))) == {0, 1}
    rows[1]["amount"] = 4000
    assert fuzzy_rows(make(rows)) == {}


def test_fuzzy_ignores_exact_duplicates(make):
    rows = [{"amount": 5000, "vendor": "A  B"}, {"amount": 5000, "vendor": "A B"}]
    assert fuzzy_rows(make(rows)) == {}
    rows.append({"amount": 5000, "vendor": "A B", "date": dt.date(2024, 2, 2)})
    assert set(fuzzy_rows(make(rows))) == {0, 2}


def test_fuzzy_material_only_needs_a_material_side(make):
    rows = [{"amount": a, "vendor": v} for a, v in
            ((100, "Meridian"), (150, "Meridan"), (900, "Solid"), (950, "Solod"), (5000, "x"), (100, "y"))]
    cfg = AnalysisConfig(fuzzy_material_only=True)
    # upper median is 900: the two Meridian rows are both below it
    assert set(fuzzy_rows(make(rows), cfg)) == {2, 3}
    assert set(fuzzy_rows(make(rows))) == {0, 1, 2, 3}


# --- split invoices ----------------------------------------------------------------


def split_rows(df, thresholds=(10_000,)):
    cfg = AnalysisConfig(approval_thresholds=thresholds)
    return by_id(splits.split_invoices(df, profile_ledger(df), cfg))


def on_days(*pairs):
    start = dt.date(2024, 6, 1)
    return [{"amount": a, "date": start + dt.timedelta(days=d), "vendor": "OfficeMax"} for d, a in pairs]


def test_split_cluster(make):
    got = split_rows(make(on_days((0, 9333), (2, 9333), (4, 9334))))
    assert set(got) == {0, 1, 2}
    assert {(r.cluster_total, r.cluster_size, r.suspected_threshold) for r in got.values()} == {(28_000.0, 3, 10_000.0)}


@pytest.mark.parametrize(
    "pairs, flagged",
    [
        ([(0, 12_000), (1, 9_000)], set()),
        ([(0, 9_500), (7, 9_500)], {0, 1}),
        ([(0, 9_500), (8, 9_500)], set()),
        ([(0, 9_900), (0, 5_000), (0, 9_900)], set()),
        ([(0, 5_000), (0, 9_900), (0, 9_900)], {1, 2}),
        ([(0, 8_750)] * 4, {0, 1, 2, 3}),
        ([(0, 8_751)] * 4, {1, 2, 3}),
    ],
)
def test_split_edges(make, pairs, flagged):
    assert set(split_rows(make(on_days(*pairs)))) == flagged


def test_split_needs_one_vendor(make):
    assert split_rows(make([{"amount": 9500, "vendor": v} for v in ("a", "b")])) == {}
    assert set(split_rows(make([{"amount": 9500, "vendor": v} for v in ("Ab ", " aB")]))) == {0, 1}


# --- descriptions -----------------------------------------------------------------


def audit(df):
    return by_id(descriptions.with_description_audit(df, profile_ledger(df)))


@pytest.mark.parametrize(
    "text, risk, labels",
    [
        ("Nana", 45, ["empty: N/A placeholder"]),
        ("12345", 50, ["empty: numeric only"]),
        ("abc", 20, ["length: very short description"]),
        ("\U0001f600\U0001f600\U0001f600", 0, []),
        ("Consulting", 20, ["vague: consulting (only)"]),
        ("consulting day", 0, []),
        ("Work performed", 20, ["vague: work performed"]),
        ("émisc", 35, ["vague: miscellaneous"]),
        ("Misc services", 60, ["vague: miscellaneous", "vague: services (only)"]),
        ("Professional services", 40, ["vague: services (only)", "vague: professional services"]),
        ("N/A", 45, ["empty: N/A placeholder"]),
        ("Replacement of the ventilation filters in hall 3", 0, []),
        (None, 60, ["missing: no description provided"]),
        ("   ", 60, ["missing: no description provided"]),
    ],
)
def test_description_patterns(make, text, risk, labels):
    # the other rows keep this one below the 75th percentile and below half the maximum
    rows = [{"amount": 10, "description": text}] + amounts(100, 100, 100, description="Steel plates")
    r = audit(make(rows))[0]
    assert (r.description_risk, r.triggered_keywords) == (risk, labels)


def test_description_amount_weights(make):
    rows = amounts(10, 10, 10, 10, description="Steel plates") + amounts(50_000, description="Miscellaneous")
    assert audit(make(rows))[4].description_risk == round(35 * 1.3 * 1.2)
    rows = amounts(*[10] * 10, 100_000, description="Steel plates") + amounts(500)
    assert audit(make(rows))[11].description_risk == 84


# --- composite ----------------------------------------------------------------------


def composite(spark, **over):
    row = dict(amount=1234.0, isolation_score=0, is_outlier=False, rsf=1.0, rsf_flag=False,
               is_exact_duplicate=False, is_split_invoice=False, description_risk=0,
               fuzzy_dup_group=None, is_round_number=False, edgar_verified=None, ofac_hit=None,
               address_valid=None)
    row.update(over)
    schema = ("amount double, isolation_score int, is_outlier boolean, rsf double, rsf_flag boolean, "
              "is_exact_duplicate boolean, is_split_invoice boolean, description_risk int, "
              "fuzzy_dup_group string, is_round_number boolean, edgar_verified boolean, "
              "ofac_hit boolean, address_valid boolean")  # fmt: skip
    r = with_composite(spark.createDataFrame([tuple(row.values())], schema)).first()
    return r.composite_risk, r.risk_tier, r.triggered_detectors


@pytest.mark.parametrize(
    "over, score, fired",
    [
        (dict(rsf=2.5), 4, []),
        (dict(rsf=3.0), 8, []),
        (dict(rsf=6.5, rsf_flag=True), 25, ["RSF"]),
        (dict(rsf=100.0, rsf_flag=True), 25, ["RSF"]),
        (dict(amount=9990.0, is_round_number=True), 10, ["ROUND_NUMBER"]),
        (dict(ofac_hit=True), 100, ["OFAC_HIT"]),
        (dict(edgar_verified=False), 0, []),
        (dict(edgar_verified=False, rsf=6.5, rsf_flag=True), 40, ["RSF", "EDGAR_UNVERIFIED"]),
        (dict(address_valid=False), 10, ["ADDRESS_INVALID"]),
        (dict(address_valid=True, ofac_hit=False, edgar_verified=True), 0, []),
        (dict(description_risk=30), 2, ["DESCRIPTION_AUDIT"]),
        (dict(isolation_score=100, is_outlier=True), 30, ["ISOLATION_FOREST"]),
        (dict(is_exact_duplicate=True, is_split_invoice=True, fuzzy_dup_group="g"), 35,
         ["EXACT_DUPLICATE", "SPLIT_INVOICE", "FUZZY_DUPLICATE"]),
    ],
)
def test_composite(spark, over, score, fired):
    got = composite(spark, **over)
    assert (got[0], got[2]) == (score, fired)


def test_tiers(spark):
    assert composite(spark, ofac_hit=True)[1] == "CRITICAL"
    base = dict(isolation_score=100, is_exact_duplicate=True, is_split_invoice=True)
    assert composite(spark, **base)[:2] == (60, "HIGH")
    assert composite(spark, isolation_score=100)[:2] == (30, "MEDIUM")
    assert composite(spark)[:2] == (0, "LOW")


# --- the whole ------------------------------------------------------------------------


def test_pipeline_empty(make):
    result = analyze(make([]))
    p = result.portfolio.first()
    assert result.transactions.count() == 0
    assert (p.score, p.tier, p.total_transactions, p.estimated_exposure) == (0, "LOW", 0, 0.0)


def test_pipeline_shell_vendor(make, lognormal):
    shell = [{"vendor": "Shell Holding", "amount": a, "date": "2024-05-05"} for a in (680_000, 750_000, 820_000)]
    result = analyze(make(lognormal(200) + shell))
    got = by_id(result.transactions)
    assert result.portfolio.first().score > 30
    assert all(got[i].rsf_flag for i in (200, 201, 202))
    exposure = sum(r.amount for r in got.values() if r.risk_tier in ("HIGH", "CRITICAL"))
    assert result.portfolio.first().estimated_exposure == pytest.approx(exposure)


def test_pipeline_duplicates_and_shape(make, lognormal):
    pair = [{"vendor": "Twin", "amount": 4321.0, "date": "2024-05-05"}] * 2
    got = by_id(analyze(make(lognormal(50) + pair)).transactions)
    assert all("EXACT_DUPLICATE" in got[i].triggered_detectors for i in (50, 51))
    assert all(0 <= r.composite_risk <= 100 for r in got.values())
    assert {r.edgar_verified for r in got.values()} == {None}


def test_required_text_is_in_every_match(make, spark):
    assert required_text(r"\bfees?\b$") == "fee"
    assert required_text(r"\bmisc(ellaneous)?\b") == "misc"
    assert required_text(r"\bab|c\b") == "" and required_text(r"^\d+$") == ""
    texts = ["MISC", "Fee", "feES", "a İ GIFT", "Kloan loan", "write-off", "cash advance", "coffee", "n/a", "égift"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, _, _ in fv.DESCRIPTION_PATTERNS:
        found = rows.where(F.col("t").rlike(java_pattern(pattern)))
        assert found.where(~F.lower("t").contains(required_text(pattern))).isEmpty()
