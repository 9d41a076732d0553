"""How the detectors join the ledger with what is derived from it."""

import re

import pytest

from ledger_analytics.operators import duplicates, fuzzy, splits
from ledger_analytics.operators.profile import profile_ledger
from ledger_analytics.operators.screening import ScreeningLists
from ledger_analytics.plans import pipeline
from ledger_analytics.sources.materialize import materialize


@pytest.mark.parametrize(
    "find, keys",
    [
        (lambda led, p: duplicates.exact_duplicates(led), ["date amount2 vendor_key"]),
        (fuzzy.fuzzy_duplicates, ["name band"]),
        (splits.split_invoices, ["vendor_group day block", "vendor_group day"]),
    ],
)
def test_ledger_is_not_sent_through_the_driver(spark, make, tmp_path, find, keys):
    # few distinct values: the files are far below the broadcast limit, whatever the number of rows
    rows = [{"vendor": f"Vendor {'ABCDEF'[i % 6] * 3}", "amount": 9000.0 + i % 7, "description": None} for i in range(300)]
    make(rows).write.parquet(str(tmp_path / "ledger"))
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    plan = find(ledger, profile_ledger(ledger))._jdf.queryExecution().sparkPlan().toString()
    joined = {(kind, " ".join(re.findall(r"(\w+)#", on))) for kind, on in re.findall(r"(\w+Join) \[([^\]]*)\]", plan)}
    for k in keys:
        assert ("SortMergeJoin", k) in joined, joined


def test_rows_are_stored_once_with_the_verdicts(spark, make, monkeypatch):
    stored = []

    def store(df, name, keep=False):
        stored.append((name, df.columns))
        return materialize(df, name, keep)

    monkeypatch.setattr(pipeline, "materialize", store)
    led = make([{"vendor": f"Vendor {'AB'[i % 2] * 4}", "amount": 100.0 + i} for i in range(60)])
    given = spark.createDataFrame([("vendor aaaa", True, False, True)], "vendor_lower string, edgar_verified boolean, ofac_hit boolean, address_valid boolean")
    for options in ({"verdicts": given}, {"lists": ScreeningLists(registry=spark.createDataFrame([("Vendor AAAA", "1")], "entity_name string, cik string"))}):
        stored.clear()
        rows = pipeline.analyze(led, **options).transactions
        assert [n for n, columns in stored if "vendor" in columns] == ["scored"]
        names = ["isolation_score", "is_outlier", "edgar_verified", "ofac_hit", "address_valid", "composite_risk"]
        at = rows.columns.index("isolation_score")
        assert rows.columns[at : at + 6] == names
        assert rows.where("vendor = 'Vendor AAAA' AND edgar_verified").count() == 30
