import datetime as dt
from decimal import Decimal
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledger_analytics.config import AnalysisConfig
from ledger_analytics.operators import skew
from ledger_analytics.plans import reports
from ledger_analytics.plans.pages import PageIndex
from ledger_analytics.plans.pipeline import analyze
from ledger_analytics.sources import materialize as materialize_module
from ledger_analytics.sources.history import RunHistory
from ledger_analytics.sources.ledger_files import (
    auto_mapping,
    infer_amount_column,
    infer_date_format,
    load_csv,
    load_frame,
    parse_amount,
    parse_date,
    split_cells,
)

RUN = dt.date(2001, 2, 3)
CFG = AnalysisConfig(run_date=RUN)


def write(tmp_path, text, name="ledger.csv"):
    p = tmp_path / name
    p.write_text(text, encoding="utf8")
    return str(p)


def load(spark, tmp_path, text, mapping=None):
    return load_csv(spark, write(tmp_path, text), mapping, CFG, store=False)


# --- CSV -----------------------------------------------------------------------------


def test_csv_rows_rejects_and_counters(spark, tmp_path):
    got = load(
        spark,
        tmp_path,
        'Invoice_Number , Posting_Date,Supplier,AMT,Memo\n'
        'A1,2024-01-05,"Acme, Inc","$1,234.50","say ""hi"""\n'
        '\n'
        ',2024-01-06,  ,12abc, \n'
        'A3,2024-01-07,Bolt,(500),x\n'
        'A4,2024-01-07,Bolt,-5,x\n'
        'A5,2024-01-07,Bolt,0,x\n'
        'A6,2024-01-07,Bolt,,x\n'
        '   \n'
        'A7,bad date,Bolt,7.5\n'
        'A8,2024-01-08,Bolt,8,note,extra,cells\n',
    )
    assert got.mapping == {"amount": "amt", "date": "posting_date", "vendor": "supplier",
                           "invoice_id": "invoice_number", "description": "memo"}
    assert got.date_format == "ISO"
    rows = [tuple(r) for r in got.ledger.orderBy("txn_id").drop("category", "approved_by", "address").collect()]
    assert rows == [
        (2, "A1", dt.date(2024, 1, 5), "Acme, Inc", 1234.5, 'say "hi"'),
        (3, "ROW-3", dt.date(2024, 1, 6), "Unknown", 12.0, None),
        (8, "A7", RUN, "Bolt", 7.5, None),
        (9, "A8", dt.date(2024, 1, 8), "Bolt", 8.0, "note"),
    ]
    assert sorted(tuple(r) for r in got.rejects.collect()) == [
        (4, "amount", 'Unparseable amount: "(500)"'), (7, "amount", 'Unparseable amount: ""')
    ]
    assert {r.outcome: r.n for r in got.counters.collect()} == {"ok": 4, "credit": 2, "skip": 2}
    p = got.profile.first()
    assert (p.ok_rows, p.credit_rows, p.skip_rows, p.size_warning) == (4, 2, 2, False)
    assert (p.amount_column, p.category_column, p.date_format, p.date_warning) == ("amt", None, "ISO", False)


def test_csv_last_of_equal_headers_and_explicit_mapping(spark, tmp_path):
    got = load(spark, tmp_path, "amount,vendor,Amount,who\n1,a,10,b\n2,a,20,c\n", {"vendor": "WHO", "amount": "amount"})
    assert [(r.vendor, r.amount) for r in got.ledger.orderBy("txn_id").collect()] == [("b", 10.0), ("c", 20.0)]


@pytest.mark.parametrize("text", ["amount,vendor\n", "\n\n"])
def test_csv_without_rows(spark, tmp_path, text):
    got = load(spark, tmp_path, text)
    assert got.ledger.count() == 0 and got.rejects.count() == 0


def test_csv_line_numbers_over_splits(spark, tmp_path):
    for part in range(3):
        lines = [f"{part}-{i},{i + 1}" for i in range(200 * (part + 1))]
        write(tmp_path, "\n".join(["invoice_id,amount", *lines]) + "\n", f"part-{part}.csv")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = load_csv(spark, str(tmp_path), config=CFG, store=False).ledger
        rows = got.select("txn_id", "invoice_id").orderBy("txn_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.txn_id for r in rows] == list(range(2, 1202))
    assert [r.invoice_id for r in rows] == [f"{p}-{i}" for p in range(3) for i in range(200 * (p + 1))]


def test_csv_headers_per_file(spark, tmp_path):
    write(tmp_path, "amount,vendor,date\n1,a,2024-01-02\n2,b,2024-01-03\n", "a.csv")
    write(tmp_path, "\n vendor ,Date,amount,memo\nacme,2024-01-04,3,m\n\n", "b.csv")
    write(tmp_path, "\n", "c.csv")
    got = load_csv(spark, str(tmp_path), config=CFG, store=False)
    assert [(r.txn_id, r.vendor, r.amount, str(r.date), r.description) for r in got.ledger.orderBy("txn_id").collect()] == [
        (2, "a", 1.0, "2024-01-02", None), (3, "b", 2.0, "2024-01-03", None), (4, "acme", 3.0, "2024-01-04", "m"),
    ]


def test_cells(spark):
    cases = {
        "a,b": ["a", "b"], ",": ["", ""], "": [""], 'a"b,c"d,e': ["ab,cd", "e"], '"x""y",z': ['x"y', "z"], '"open, to the end': ["open, to the end"],
        '""': [""], '"""",q': ['"', "q"], 'x""y': ["xy"], " a , b ": [" a ", " b "], '"a""': ['a"'], ",,x,": ["", "", "x", ""],
        "," * 3000: [""] * 3001, '"' + '""' * 5000 + '"': ['"' * 5000],
    }
    df = spark.createDataFrame([(k,) for k in cases], "line string").select("line", split_cells(F.col("line")).alias("cells"))
    assert {r.line: r.cells for r in df.collect()} == cases


def test_stored_load_reads_back(spark, tmp_path):
    got = load_csv(spark, write(tmp_path, "amount,vendor\n5,x\n"), config=CFG)
    assert [(r.amount, r.vendor, r.date) for r in got.ledger.collect()] == [(5.0, "x", RUN)]


# --- mapping and inference -------------------------------------------------------------


def test_auto_mapping_takes_the_first_alias():
    assert auto_mapping(["value", " Total ", "Amt"])["amount"] == "amt"
    assert auto_mapping(["lifnr", "budat", "belnr", "dmbtr", "sgtxt", "addr", "category", "approved_by"]) == {
        "vendor": "lifnr", "date": "budat", "invoice_id": "belnr", "amount": "dmbtr", "description": "sgtxt",
        "address": "addr", "category": "category", "approved_by": "approved_by",
    }


def test_amount_inference(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "x", "$1,000", "9.5"), ("2024-01-02", "y", "7", "-1"), ("2024-01-03", "3", "n/a", "1")],
        "day string, who string, paid string, `tax.rate` string",
    )
    assert infer_amount_column(df) == "paid"
    assert infer_amount_column(df.select("who", "tax.rate" if False else F.col("`tax.rate`"))) == "tax.rate"
    assert infer_amount_column(df.select("day", "who")) is None


@pytest.mark.parametrize(
    "values, want",
    [
        (["2024-01-05", "2024-1-6", "5/6/2024"], "ISO"),
        (["13/05/2024", "01/02/2024"], "EU (DD/MM)"),
        (["05-13-24", "01.02.2024"], "US (MM/DD)"),
        (["05/06/2024"], "ambiguous"),
        (["13/05/2024", "05/13/2024"], "ambiguous"),
        (["May 5, 2024", ""], "unknown"),
        (["2024-01-05", "5/6/2024"], "ambiguous"),
    ],
)
def test_date_format(spark, values, want):
    assert infer_date_format(spark.createDataFrame([(v,) for v in values], "d string"), "d") == want


@pytest.mark.parametrize(
    "text, fmt, want",
    [
        ("15/05/2024", "EU (DD/MM)", "2024-05-15"), ("05/15/2024", "US (MM/DD)", "2024-05-15"),
        ("05.06.24", "EU (DD/MM)", "2024-06-05"), ("05/06/71", "US (MM/DD)", "1971-05-06"),
        ("05/06/60", "US (MM/DD)", "2060-05-06"), ("05/06/60", "ambiguous", "1960-05-06"),
        ("05/06/2024", "ambiguous", "2024-05-06"), ("2024-1-5", "EU (DD/MM)", "2024-01-05"),
        ("2024-01-05T10:00:00Z", "ISO", "2024-01-05"), ("31/02/2024", "EU (DD/MM)", None),
        ("2024-13-01", "ISO", None), ("", "ISO", None), ("soon", "unknown", None),
        ("May 5, 2024", "unknown", "2024-05-05"), ("5 March 2024", "unknown", "2024-03-05"),
    ],
)
def test_parse_date(spark, text, fmt, want):
    got = spark.createDataFrame([(text,)], "d string").select(parse_date(F.col("d"), fmt)).first()[0]
    assert got == (dt.date.fromisoformat(want) if want else None)


@pytest.mark.parametrize(
    "text, want",
    [("$1,234.50", 1234.5), ("12abc", 12.0), ("(500)", None), ("€5", None), ("-5", -5.0), (" 1 000 ", 1000.0),
     ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("+7", 7.0), ("", None), ("abc", None)],
)
def test_parse_amount(spark, text, want):
    assert spark.createDataFrame([(text,)], "a string").select(parse_amount(F.col("a"))).first()[0] == want


def test_load_frame_keeps_types(spark):
    df = spark.createDataFrame(
        [(7, dt.date(2024, 1, 5), "Acme", 1.25e7, "x"), (9, None, None, -3.0, None)],
        "Key long, Trans_Date date, Payee string, Total double, `Memo` string",
    )
    got = load_frame(df, id_column="Key", config=CFG, store=False)
    row = got.ledger.first()
    assert (row.txn_id, row.date, row.vendor, row.amount, row.description) == (
        7, dt.date(2024, 1, 5), "Acme", 1.25e7, "x"
    )
    assert {r.outcome: r.n for r in got.counters.collect()} == {"ok": 1, "credit": 1}


# --- history and report ----------------------------------------------------------------


@pytest.fixture(scope="module")
def result(make, lognormal):
    rows = lognormal(60) + [{"vendor": "Shell, Inc", "amount": 900_000, "description": 'a "b", c'}] * 2
    return analyze(make(rows))


def test_history_keeps_and_deletes(spark, tmp_path, result):
    store = RunHistory(spark, str(tmp_path / "runs"), keep_results=2, keep_summaries=4)
    assert store.history().count() == 0 and store.load("1") is None
    for day in range(1, 6):
        store.append(result, f"{day}", "f.csv", dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc))
    assert [r.run_id for r in store.history().collect()] == ["5", "4", "3", "2"]
    assert [store.load(str(d)) is not None for d in range(1, 6)] == [False, False, False, True, True]
    again = store.load("5")
    assert again.transactions.count() == result.transactions.count()
    assert again.portfolio.first() == result.portfolio.first()
    assert [r.run_id for r in store.delete("5").collect()] == ["4", "3", "2"]
    assert store.load("5") is None
    with pytest.raises(ValueError):
        store.append(result, "../x", "f.csv")


def test_history_keeps_all_by_default(spark, tmp_path, result):
    store = RunHistory(spark, str(tmp_path / "runs"))
    for day in range(1, 6):
        store.append(result, f"{day}", "f.csv", dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc))
    assert all(store.load(str(d)) is not None for d in range(1, 6))
    store.prune(keep_results=1)
    assert [store.load(str(d)) is not None for d in range(1, 6)] == [False] * 4 + [True]
    assert store.history().count() == 5


def test_interrupted_append_leaves_no_run(spark, tmp_path, result):
    store = RunHistory(spark, str(tmp_path / "runs"))
    store.append(result, "a", "f.csv", dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc))
    broken = replace(result, round_number=result.round_number.withColumn("x", F.raise_error(F.lit("lost"))))
    for run_id in ("a", "b"):
        with pytest.raises(Exception, match="lost"):
            store.append(broken, run_id, "g.csv")
    # the old run is as it was, the new one is not there, and what it wrote can be swept away
    assert [(r.run_id, r.filename) for r in store.history().collect()] == [("a", "f.csv")]
    assert store.load("b") is None and store.load("a").portfolio.first() == result.portfolio.first()
    assert len(store.sweep()) == 2 and store.sweep() == []
    assert store.load("a").transactions.count() == result.transactions.count()


def test_manifest_that_is_being_written_is_no_run(spark, tmp_path, result):
    store = RunHistory(spark, str(tmp_path / "runs"))
    store.append(result, "a", "f.csv")
    (tmp_path / "runs" / "runs" / "_0123").write_text('{"run_id": "half')
    assert [r.run_id for r in store.history().collect()] == ["a"]


def test_writers_of_different_runs_do_not_meet(spark, tmp_path, result):
    stores = [RunHistory(spark, str(tmp_path / "runs")) for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda s: s[1].append(result, f"run-{s[0]}", "f.csv"), enumerate(stores)))
    assert {r.run_id for r in stores[0].history().collect()} == {"run-0", "run-1", "run-2"}
    assert all(stores[0].load(f"run-{i}") is not None for i in range(3))


def test_run_stored_again_replaces_the_old_one(spark, tmp_path, result):
    store = RunHistory(spark, str(tmp_path / "runs"))
    store.append(result, "a", "f.csv")
    smaller = replace(result, transactions=result.transactions.limit(3))
    assert [r.filename for r in store.append(smaller, "a", "g.csv").collect()] == ["g.csv"]
    assert store.load("a").transactions.count() == 3 and store.sweep() == []


def test_analysis_leaves_only_its_rows(spark, tmp_path, make, lognormal, monkeypatch):
    monkeypatch.setattr(materialize_module, "checkpoint_root", lambda spark: str(tmp_path))
    ledger = make(lognormal(60))
    verdicts = spark.createDataFrame([("vendor aaaa", True, False, None)], "vendor_lower string, edgar_verified boolean, ofac_hit boolean, address_valid boolean")
    got = analyze(ledger, verdicts=verdicts)
    tables = [p.name.split("-")[0] for p in (tmp_path / "ledger_analytics").iterdir()]
    assert tables == ["scored"] and got.transactions.count() == 60 and got.portfolio.count() == 1
    # an outer block takes what an inner one keeps, and a failure leaves nothing
    with pytest.raises(ZeroDivisionError), materialize_module.scratch(spark):
        analyze(ledger)
        materialize_module.materialize(ledger, "more")
        1 / 0
    assert len(list((tmp_path / "ledger_analytics").iterdir())) == 1


def test_report_sheets(spark, tmp_path, result):
    paths = reports.write_report(result, str(tmp_path / "report"), format="parquet")
    counts = {name: spark.read.parquet(p).count() for name, p in paths.items()}
    n = result.transactions.count()
    flagged = result.portfolio.first().flagged_transactions
    assert counts == {
        "executive_summary": 13, "flagged_transactions": flagged, "all_transactions": n,
        "detector_explanations": 12, "benford_analysis": 2, "vendor_risk": 11,
    }


# --- views -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        (1, "INV-1", dt.date(2024, 1, 1), "Zebra", 10.0, 0, "LOW", []),
        (2, "INV-2", dt.date(2024, 1, 2), "apple", 30.0, 9, "LOW", ["RSF"]),
        (3, "INV-3", dt.date(2024, 2, 1), "Éclair", 20.0, 10, "LOW", []),
        (4, "X%_4", dt.date(2024, 2, 2), "Zebra", 40.0, 99, "CRITICAL", ["RSF", "OFAC_HIT"]),
        (5, "INV-5", dt.date(2024, 3, 2), "apple", 50.0, 100, "CRITICAL", ["OFAC_HIT"]),
    ]
    return spark.createDataFrame(
        rows,
        "txn_id long, invoice_id string, date date, vendor string, amount double, composite_risk int, "
        "risk_tier string, triggered_detectors array<string>",
    )


def ids(df):
    return [r.txn_id for r in df.collect()]


def test_filters(small):
    f = reports.filter_transactions
    assert ids(f(small, tier="CRITICAL")) == [4, 5] and ids(f(small, tier="ALL")) == [1, 2, 3, 4, 5]
    assert ids(f(small, search="%_")) == [4] and ids(f(small, search="ZEB")) == [1, 4]
    assert ids(f(small, min_amount=20, max_amount=40)) == [2, 3, 4]
    assert ids(f(small, date_from="2024-02-01", date_to="2024-02-02")) == [3, 4]
    assert ids(f(small, detector="OFAC_HIT")) == [4, 5]


def test_sort_and_pages(small):
    assert ids(reports.sort_transactions(small)) == [5, 4, 3, 2, 1]
    assert ids(reports.sort_transactions(small, "vendor", True)) == [2, 5, 3, 1, 4]
    assert ids(reports.sort_transactions(small, "vendor", False)) == [1, 4, 3, 2, 5]
    assert ids(reports.page(reports.sort_transactions(small, "amount", True), 2, 2)) == [2, 4]
    assert tuple(reports.page_count(small, 2).first()) == (5, 3)
    assert tuple(reports.page_count(small.limit(0), 2).first()) == (0, 1)


@pytest.mark.parametrize("key, ascending", [("amount", True), ("date", False), ("vendor", True), ("composite_risk", False)])
def test_page_index(spark, key, ascending):
    rows = [(i, f"V{(i * 7) % 5}{'a' if i % 2 else 'B'}", float(i % 13), dt.date(2024, 1, 1 + i % 9), i % 4) for i in range(230)]
    df = spark.createDataFrame(rows, "txn_id long, vendor string, amount double, date date, composite_risk int").repartition(3)
    index = PageIndex.build(df, key, ascending, parts=6)
    want = [r.txn_id for r in reports.sort_transactions(df, key, ascending).collect()]
    assert index.total == 230 and len(index.ranges) > 2
    got = [(r.position, r.txn_id) for n in range(1, 8) for r in index.page(n, 40).collect()]
    assert got == list(enumerate(want, 1))
    plan = index.page(3, 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "__part" in plan and index.page(9, 40).collect() == []
    assert PageIndex.build(df.where("false"), key, ascending).page(1).collect() == []


def test_unknown_tier(small):
    with pytest.raises(ValueError):
        reports.filter_transactions(small, tier="SEVERE")


def test_heavy_keys_are_joined_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY", 4)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"v{i % 40}") for i in range(400)] + [(900, None)], "id int, k string")
    counts = rows.where("k IS NOT NULL AND k <> 'v2'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = skew.join_attributes(rows, counts, "k", "n", 400, "counts")
    assert got.columns == ["k", "id", "n"] or set(got.columns) == {"id", "k", "n"}
    want = {r.id: None if r.k in (None, "v2") else (200 if r.k == "hot" else 10) for r in rows.collect()}
    assert {r.id: r.n for r in got.collect()} == want


def test_histogram_and_ties(small):
    got = {r.bin: r.n for r in reports.score_histogram(small).collect()}
    assert got == {0: 2, 1: 1, 9: 2, **{b: 0 for b in range(2, 9)}}
    # both vendors have one flagged row: the one seen first wins
    assert tuple(reports.top_flagged_vendor(small).first()) == ("Zebra", 1)


def test_unknown_tier_is_refused(small):
    with pytest.raises(ValueError, match="unknown tier SEVERE"):
        reports.filter_transactions(small, tier="SEVERE")
    assert reports.filter_transactions(small, tier="ALL").count() == 5


def test_vendor_view(small):
    got = {r.vendor: r for r in reports.vendor_view(small).collect()}
    assert (got["Zebra"].median_amount, got["Zebra"].max_tier, got["Zebra"].flagged) == (40.0, "CRITICAL", 1)
    assert tuple(reports.vendor_totals(reports.vendor_view(small)).first()) == (3, 2, 2, 150.0)


def test_detector_counts(small):
    got = {r.detector: (r.n, r.rate, r.is_passing) for r in reports.detector_counts(small).collect()}
    assert len(got) == 12 and got["RSF"] == (2, 0.4, False) and got["BENFORD_1ST"] == (0, 0.0, True)
    assert [r.detector for r in reports.top_detectors(small).collect()] == ["RSF"]


def test_money(spark):
    df = spark.createDataFrame([(2.5,), (1234.0,), (1_500_000.0,), (999.4,)], "a double")
    got = [tuple(r) for r in df.select(reports.money(F.col("a")), reports.exposure_text(F.col("a"))).collect()]
    assert got == [("$3", "$3"), ("$1,234", "$1.2k"), ("$1,500,000", "$1.50 million"), ("$999", "$999")]


def test_all_rows_decide_in_any_order(spark):
    rows = [(i, str(i), f"{1 + i % 12:02d}/{1 + i % 9:02d}/2024", "v") for i in range(60)]
    rows += [(i, f"R{i}", "25/03/2024", "v") for i in range(60, 130)]
    rows = [(i, ref, str(10.5 + i), date, v) for i, ref, date, v in rows]
    got = []
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "key long, ref string, money string, date string, vendor string")
        loaded = load_frame(df, {"date": "date", "vendor": "vendor"}, id_column="key", config=AnalysisConfig(), store=False)
        got.append((loaded.mapping, loaded.date_format, sorted(loaded.ledger.collect())))
    assert got[0] == got[1] and got[0][0]["amount"] == "money" and len(got[0][2]) == 130


def test_undated_rows_and_odd_amounts_are_rejected(spark):
    df = spark.createDataFrame(
        [(1, "5", "2024-01-02", "v"), (2, "5", "soon", "v"), (3, "1e400", "2024-01-02", "v"), (4, "1e30", "2024-01-02", "v"), (5, "-3", "x", "v")],
        "key long, amount string, date string, vendor string",
    )
    loaded = load_frame(df, id_column="key", store=False)
    assert [r.txn_id for r in loaded.ledger.collect()] == [1]
    assert {r.outcome: r.n for r in loaded.counters.collect()} == {"ok": 1, "undated": 1, "skip": 2, "credit": 1}
    assert {(r.row, r.field, r.message) for r in loaded.rejects.collect()} == {
        (2, "date", 'Unreadable date: "soon"'), (3, "amount", 'Unparseable amount: "1e400"'), (4, "amount", 'Unparseable amount: "1e30"'),
    }
    with pytest.raises(ValueError):
        load_frame(df, store=False)


def test_report_csv_is_read_by_the_loader(spark, tmp_path, result):
    paths = reports.write_report(result, str(tmp_path / "csv"))
    sheet = spark.read.options(header=True, escape='"', multiLine=True).csv(paths["all_transactions"])
    assert any(r.asDict().get("Description") == 'a "b", c' or 'a "b", c' in [str(v) for v in r] for r in sheet.collect())


def test_typed_columns_are_read_as_their_text_is(spark):
    # numbers and dates are not made into text to be read again; what is read stays the same
    schema = "key long, paid double, whole int, tiny float, exact decimal(20,4), yes boolean, day date, at timestamp, note string"
    big = dt.datetime(2024, 2, 29, 23, 59, 59)
    rows = [
        (1, 12.5, 3, 0.1, Decimal("7.0001"), True, dt.date(2024, 2, 29), big, " $1,000.50 "),
        (2, float("nan"), -3, float("inf"), Decimal("-1"), False, dt.date(1, 1, 1), dt.datetime(1970, 1, 1), "12a"),
        (3, float("inf"), 0, 1.5, None, None, None, None, None),
        (4, 1e-7, None, None, Decimal("0"), True, dt.date(9999, 12, 31), big, "e5"),
        (5, 1.5e20, 2147483647, 2.5, Decimal("1"), True, dt.date(1999, 12, 31), big, "\u00a03e2"),
    ]
    typed = spark.createDataFrame(rows, schema)
    text = typed.select("key", *[F.col(c).cast("string").alias(c) for c in typed.columns[1:]])
    for amount in typed.columns[1:]:
        assert infer_amount_column(typed.select(amount)) == infer_amount_column(text.select(amount)), amount
        for date in ("day", "at", "note"):
            got = [load_frame(df, {"amount": amount, "date": date}, id_column="key", store=False) for df in (typed, text)]
            assert got[0].date_format == got[1].date_format
            assert repr(got[0].rows.orderBy("txn_id").collect()) == repr(got[1].rows.orderBy("txn_id").collect()), (amount, date)
    plan = load_frame(typed.select("key", "paid", "at"), {"date": "at", "vendor": "at"}, id_column="key", store=False).rows.select("amount", "date")
    assert "regexp" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()
