"""Queries registered with the driver, over a ledger derived from its tables.

The tables hold no payment ledger, so one is built from orders and customers:
vendors are customer groups, with planted spellings, one-off vendors, round
amounts, clusters under a limit and duplicates. ``driver_oracle`` states the same
derivation and every query in SQL.

``isolation_forest``, ``isolation_small``, ``full_analysis``, ``full_portfolio`` and
``given_verdicts`` use the forest. The other queries that need scores take the two
isolation columns from the amount by a fixed rule, which keeps their SQL short.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_analytics import fixed_values as fv
from ledger_analytics.config import AnalysisConfig
from ledger_analytics.functions.numeric import first_digit, is_round, just_below, second_digit, total_amount
from ledger_analytics.operators import benford, descriptions, duplicates, fuzzy, rsf, screening, splits
from ledger_analytics.operators.forest import fit_forest, with_isolation
from ledger_analytics.operators.profile import LedgerProfile, profile_frame, profile_ledger
from ledger_analytics.operators.scoring import portfolio_summary, with_composite
from ledger_analytics.operators.screening import ScreeningLists
from ledger_analytics.plans import pipeline, reports
from ledger_analytics.plans.pages import PageIndex
from ledger_analytics.plans.pipeline import AnalysisResult, analyze
from ledger_analytics.schema import is_valid_row, to_ledger
from ledger_analytics.sources.history import RunHistory
from ledger_analytics.sources.ledger_files import LoadResult, load_csv, load_frame
from ledger_analytics.sources.materialize import checkpoint_root, materialize

Query = Callable[[SparkSession, str], DataFrame]
RUN_DATE = dt.date(2000, 1, 1)

V0 = "upper(substr(md5(cast(c_nationkey as string)), 1, 8)) || ' ' || c_mktsegment"
VENDOR = f"""CASE WHEN k % 97 = 0 THEN lower({V0})
     WHEN k % 89 = 0 THEN substr({V0}, 1, length({V0}) - 1)
     WHEN k % 83 = 0 THEN 'ONEOFF ' || md5(cast(k AS string))
     ELSE {V0} END"""
AMOUNT = """CASE WHEN k % 23 = 0 THEN cast(1000 * (1 + k % 40) AS double)
     WHEN k % 29 = 0 THEN cast(9990 AS double)
     WHEN k % 7 = 0 THEN cast(9000 + (k % 13) * 50 AS double)
     WHEN k % 11 = 0 THEN floor(o_totalprice * 2) / 100
     ELSE o_totalprice END"""
DESCRIPTION = """CASE k % 8 WHEN 0 THEN 'Miscellaneous' WHEN 1 THEN NULL WHEN 2 THEN 'Consulting'
     WHEN 3 THEN 'Office chairs order' WHEN 4 THEN 'n/a' WHEN 5 THEN 'Gift cards'
     WHEN 6 THEN '12345' ELSE 'Server rack installation' END"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    cores = spark.sparkContext.defaultParallelism
    if orders.rdd.getNumPartitions() < cores:
        # a table in one small file would keep everything up to the first shuffle on one core
        orders = orders.repartition(cores)
    return (
        orders
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .withColumnRenamed("o_orderkey", "k")
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(
        F.expr("k * 10").alias("txn_id"),
        F.expr("'INV-' || k").alias("invoice_id"),
        F.expr("cast(o_orderdate AS date)").alias("date"),
        F.expr(VENDOR).alias("vendor"),
        F.expr(AMOUNT).alias("amount"),
        F.expr(DESCRIPTION).alias("description"),
        F.col("c_mktsegment").alias("category"),
        F.col("o_orderpriority").alias("approved_by"),
        F.expr("'NATION ' || c_nationkey").alias("address"),
    )
    copies = (
        rows.where("txn_id % 1010 = 0")
        .withColumn("txn_id", F.expr("txn_id + 1"))
        .withColumn("vendor", F.upper("vendor"))
    )
    return to_ledger(rows.unionByName(copies)).where(is_valid_row())


def _lists(spark: SparkSession, sf_dir: str) -> ScreeningLists:
    orders = _orders(spark, sf_dir)
    groups = orders.select("c_nationkey", "c_mktsegment").distinct()
    names = materialize(groups.select(F.col("c_nationkey").alias("n"), F.expr(V0).alias("v0")).distinct(), "list-names")
    oneoff = orders.where("k % 83 = 0").select("k", F.expr("'ONEOFF ' || md5(cast(k AS string))").alias("name"))
    sanctions = (
        # exact, one letter off, and a three-word name that longer vendor names contain
        oneoff.where("k % 5 = 0").selectExpr("name AS entity_name", "'SDN' AS list_type")
        .unionByName(oneoff.where("k % 5 = 1").selectExpr(
            "substr(name, 1, length(name) - 1) || 'x' AS entity_name", "'SDN' AS list_type"))
        .unionByName(names.where("n % 7 = 0").selectExpr(
            "v0 || ' HOLDINGS' AS entity_name", "'NON-SDN' AS list_type"))
    )
    registry = names.where("n % 2 = 0").selectExpr(
        "v0 || ',' AS entity_name", "'CIK' || n AS cik"
    ).unionByName(
        names.where("n % 3 = 0").selectExpr("v0 || ' Holdings Trading' AS entity_name", "'CIK9' || n AS cik")
    )
    geocodes = (
        names.where("n % 5 <> 0")
        .selectExpr("n").distinct()
        .selectExpr(
            "'nation  ' || n || '.' AS address",
            "CASE WHEN n % 2 = 1 THEN 'Residential' ELSE 'office' END AS address_type",
        )
    )
    return ScreeningLists(materialize(sanctions, "sanctions"), materialize(registry, "registry"), materialize(geocodes, "geocodes"))


def screened_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors of the ledger, also with a longer form of each name."""
    names = ledger(spark, sf_dir).select(F.lower("vendor").alias("vendor_lower")).distinct()
    longer = names.select(F.concat("vendor_lower", F.lit(" holdings trading co")).alias("vendor_lower"))
    return names.unionByName(longer)


# --- shared stored tables ----------------------------------------------------
# As in a real analysis, the ledger is stored before the detectors read it many
# times, and the scored rows before the reports do. Each is built once per
# application and data directory.

_stored: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = make()
    return _stored[key]


def lists(spark: SparkSession, sf_dir: str) -> ScreeningLists:
    return _once(spark, sf_dir, "lists", lambda: _lists(spark, sf_dir))


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "ledger", lambda: materialize(ledger(spark, sf_dir), "ledger"))


def profile(spark: SparkSession, sf_dir: str) -> LedgerProfile:
    return _once(spark, sf_dir, "profile", lambda: profile_ledger(stored_ledger(spark, sf_dir)))


def with_stand_in_isolation(rows: DataFrame) -> DataFrame:
    score = F.expr("cast(floor(amount) % 101 AS int)")
    return rows.withColumn("isolation_score", score).withColumn(
        "is_outlier", F.col("isolation_score") >= 96
    )


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    led, prof = stored_ledger(spark, sf_dir), profile(spark, sf_dir)
    rows = pipeline.with_pair_signals(rsf.with_rsf(led, prof), pipeline.pair_signals(led, prof))
    return with_stand_in_isolation(pipeline.with_row_signals(rows, prof))


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "detected", lambda: materialize(_detected(spark, sf_dir), "detected"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    suspects = screening.suspect_vendors(detected(spark, sf_dir))
    return screening.vendor_verdicts(stored_ledger(spark, sf_dir), suspects, lists(spark, sf_dir))


def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_composite(pipeline.with_verdicts(detected(spark, sf_dir), verdicts(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "scored", lambda: materialize(composite(spark, sf_dir), "scored"))


def digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "digits", lambda: materialize(benford.digit_report(stored_ledger(spark, sf_dir)), "digits"))


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = benford.benford_summary(digits(spark, sf_dir)).where("digit_position = 1")
    return portfolio_summary(scored(spark, sf_dir), first.select("mad").scalar())


# --- output shaping for the comparison ---------------------------------------


def six_decimals(c: Column) -> Column:
    """Spelled out: the rounding functions of the two engines differ on exact halves."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def flat(df: DataFrame, sep: str = "|") -> DataFrame:
    """Six decimals, arrays as text, plain column order."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind == "double":
            c = six_decimals(c)
        elif kind == "array" and f.dataType.elementType.typeName() == "string":
            c = F.array_join(c, sep)
        out.append(c.alias(f.name))
    return df.select(*out)


# --- sources -------------------------------------------------------------------


def messy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as a bookkeeping export: padded and aliased headers, money text, credits,
    unreadable amounts, European dates, blanks."""
    return _orders(spark, sf_dir).selectExpr(
        "CASE WHEN k % 5 = 0 THEN '' ELSE 'INV-' || k END AS `Invoice_Number `",
        "date_format(o_orderdate, 'dd/MM/yyyy') AS `Posting_Date`",
        f"CASE WHEN k % 6 = 0 THEN '  ' ELSE ' ' || {V0} || ', Inc ' END AS ` Supplier`",
        "CASE WHEN k % 10 = 0 THEN '-' || o_totalprice WHEN k % 17 = 0 THEN '(' || o_totalprice || ')' "
        "WHEN k % 19 = 0 THEN '' ELSE '$' || format_number(o_totalprice, 2) END AS `AMT`",
        "CASE WHEN k % 4 = 0 THEN 'He said \"rush\", twice' ELSE ' desk ' || k END AS `Memo`",
        "cast(k AS string) AS `Doc`",
    )


def _csv_dir(spark: SparkSession, sf_dir: str) -> str:
    def write() -> str:
        path = f"{checkpoint_root(spark)}/ledger_analytics/csv-{uuid.uuid4().hex}"
        messy_text(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
        return path

    return _once(spark, sf_dir, "csv", write)


def loaded_csv(spark: SparkSession, sf_dir: str) -> LoadResult:
    return _once(
        spark,
        sf_dir,
        "loaded",
        lambda: load_csv(spark, _csv_dir(spark, sf_dir), config=AnalysisConfig(run_date=RUN_DATE)),
    )


def csv_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    # line numbers follow the files, so generated invoice ids are shown as such only
    return loaded_csv(spark, sf_dir).ledger.select(
        F.regexp_replace("invoice_id", r"^ROW-\d+$", "ROW").alias("invoice_id"),
        "date", "vendor", six_decimals(F.col("amount")).alias("amount"), "description",
    )


def csv_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_csv(spark, sf_dir).rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("txn_id").alias("distinct_lines"),
        F.min("txn_id").alias("first_line"),
        F.max("txn_id").alias("last_line"),
        F.count_if(F.col("invoice_id") == F.concat(F.lit("ROW-"), "txn_id")).alias("generated_ids"),
    )


def csv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_csv(spark, sf_dir).profile


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_csv(spark, sf_dir).rejects.groupBy("field", "message").agg(F.count(F.lit(1)).alias("n"))


def csv_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_csv(spark, sf_dir).counters


def frame_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a ledger: explicit mapping, amount column inferred from its content."""
    lines = _table(spark, sf_dir, "lineitem").selectExpr(
        "l_extendedprice AS price", "l_orderkey * 10 + l_linenumber AS line_key", "l_returnflag AS kind",
        "l_shipdate AS shipped", "'S' || l_suppkey AS payee_name",
    )
    got = load_frame(
        lines,
        {"date": "shipped", "vendor": "payee_name", "invoice_id": "line_key", "category": "kind"},
        id_column="line_key",
        config=AnalysisConfig(run_date=RUN_DATE),
        store=False,
    )
    return flat(got.ledger.select("txn_id", "invoice_id", "date", "vendor", "amount", "category"))


def csv_late_amount_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first rows have a number in the reference column."""
    rows = _orders(spark, sf_dir).selectExpr(
        "k AS row_key", "CASE WHEN k <= 400 THEN '' || k ELSE 'R' || k END AS ref", "cast(o_totalprice AS string) AS money",
        "cast(cast(o_orderdate AS date) AS string) AS date", "c_mktsegment AS vendor",
    )
    got = load_frame(rows, {"date": "date", "vendor": "vendor"}, id_column="row_key", store=False)
    return flat(got.ledger.select("txn_id", "amount", "date"))


def _raw_csv(lines: DataFrame, header: str, path: str) -> str:
    """Write lines as they are, below a header line."""
    raw = {"header": True, "sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.toDF(header).write.options(**raw).csv(path)
    return path


def _csv_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/ledger_analytics/csv-{uuid.uuid4().hex}"


def csv_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose columns stand in another order, and of which some lack one."""
    rows, base = _orders(spark, sf_dir), _csv_folder(spark)
    day = "cast(cast(o_orderdate AS date) AS string)"
    paths = [
        _raw_csv(rows.where("k % 3 = 0").selectExpr(f"concat_ws(',', o_totalprice, c_mktsegment, {day}, o_orderpriority)"), "amount,vendor,date,memo", f"{base}/a"),
        _raw_csv(rows.where("k % 3 = 1").selectExpr(f"concat_ws(',', o_orderpriority, {day}, c_mktsegment, o_totalprice)"), "Memo,DATE,vendor, Amount", f"{base}/b"),
        _raw_csv(rows.where("k % 3 = 2").selectExpr(f"concat_ws(',', {day}, o_totalprice, 'INV-' || k)"), "date,amount,invoice_id", f"{base}/c"),
    ]
    led = load_csv(spark, paths).ledger
    invoice = F.when(F.col("invoice_id").startswith("INV-"), F.col("invoice_id")).otherwise("ROW").alias("invoice_id")
    return flat(led.select(invoice, "vendor", "amount", "date", "description"))


def csv_inner_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that open inside of a cell, doubled ones, and one that stays open."""
    name = """CASE k % 4 WHEN 0 THEN 'Bob "The, Builder ' || k || '" Ltd' WHEN 1 THEN '"A ""B"", C ' || k || '"'
      WHEN 2 THEN 'plain ' || k ELSE 'x""y ' || k END"""
    memo = "CASE WHEN k % 5 = 0 THEN '\"open, to the end ' || k ELSE 'memo' END"
    lines = _orders(spark, sf_dir).selectExpr(f"{name} || ',' || o_totalprice || ',' || cast(cast(o_orderdate AS date) AS string) || ',' || {memo}")
    led = load_csv(spark, _raw_csv(lines, "vendor,amount,date,memo", f"{_csv_folder(spark)}/q")).ledger
    return flat(led.select("vendor", "amount", "date", "description"))


def csv_short_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with cells missing at the end or too many, blank lines, equal headers."""
    line = """CASE k % 4 WHEN 0 THEN '1,' || k || ',' || o_totalprice
      WHEN 1 THEN '1,' || k || ',' || o_totalprice || ',' || c_mktsegment || ',memo,extra,"more, cells"'
      WHEN 2 THEN '   ' ELSE '1,' || k || ',' || o_totalprice || ',' || c_mktsegment || ',memo' END"""
    path = _raw_csv(_orders(spark, sf_dir).selectExpr(line), "amount,invoice_id,Amount,vendor,memo", f"{_csv_folder(spark)}/s")
    led = load_csv(spark, path, config=AnalysisConfig(run_date=RUN_DATE)).ledger
    return flat(led.select("invoice_id", "vendor", "amount", "date", "description"))


def csv_late_date_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days above twelve come after many undecided dates only."""
    rows = _orders(spark, sf_dir).where("k > 1000 OR day(o_orderdate) <= 12").selectExpr(
        "k AS row_key", "cast(o_totalprice AS string) AS amount", "date_format(o_orderdate, 'dd/MM/yyyy') AS date", "c_mktsegment AS vendor"
    )
    return load_frame(rows, id_column="row_key", store=False).ledger.select("txn_id", "date")


def _odd_rows(spark: SparkSession, sf_dir: str) -> LoadResult:
    rows = _orders(spark, sf_dir).selectExpr(
        "k AS row_key",
        "CASE k % 9 WHEN 0 THEN '1e400' WHEN 1 THEN '2000000000000000000' WHEN 2 THEN '1e30' ELSE cast(o_totalprice AS string) END AS amount",
        "CASE WHEN k % 11 = 0 THEN '2024-02-31' ELSE cast(cast(o_orderdate AS date) AS string) END AS date",
        "c_mktsegment AS vendor",
    )
    return load_frame(rows, id_column="row_key", store=False)


def csv_extreme_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts out of range are rejected, and detectors run on the rest."""
    ok = _odd_rows(spark, sf_dir).ledger
    stats = rsf.vendor_stats(ok).select("vendor", "vendor_count", "vendor_median")
    return flat(stats)


def csv_date_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_rows(spark, sf_dir).rejects.groupBy("field", "message").agg(F.count(F.lit(1)).alias("n"))


# --- history -------------------------------------------------------------------


def _bundle(spark: SparkSession, sf_dir: str) -> AnalysisResult:
    led = stored_ledger(spark, sf_dir)
    return AnalysisResult(
        transactions=scored(spark, sf_dir),
        benford_digits=digits(spark, sf_dir),
        benford=benford.benford_summary(digits(spark, sf_dir)),
        round_number=benford.round_number_report(led),
        round_thresholds=benford.threshold_distribution(led),
        portfolio=portfolio(spark, sf_dir),
    )


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store two runs, delete the newer, and reload the other one's summary and rows."""
    store = RunHistory(spark, f"{checkpoint_root(spark)}/ledger_analytics/history-{uuid.uuid4().hex}")
    bundle = _bundle(spark, sf_dir)
    for i in (1, 2):
        store.append(bundle, f"run-{i}", "orders", dt.datetime(2024, 1, i, tzinfo=dt.timezone.utc))
    history = store.delete("run-2")
    rows = store.load("run-1").transactions.agg(F.count(F.lit(1)).alias("n")).scalar()
    return history.select(
        "run_id", "filename", "total_transactions", "flagged_transactions", "score", "tier",
        rows.alias("stored_rows"),
    )


def stored_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a stored run, read back after another run was stored and this one again."""
    store = RunHistory(spark, f"{checkpoint_root(spark)}/ledger_analytics/history-{uuid.uuid4().hex}")
    bundle = _bundle(spark, sf_dir)
    few = replace(bundle, transactions=bundle.transactions.where("risk_tier = 'LOW'"))
    for run_id, result in (("run-1", few), ("run-2", few), ("run-1", bundle)):
        store.append(result, run_id, "orders")
    return flat(store.load("run-1").transactions.select(
        "txn_id", "invoice_id", "date", "vendor", "amount", "rsf", "description_risk", "is_exact_duplicate",
        "is_split_invoice", "ofac_hit", "composite_risk", "risk_tier", "triggered_detectors",
    ))


def _sheet(name: str) -> Query:
    """A sheet of the written report, read back from its files."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def write() -> dict[str, DataFrame]:
            base = f"{checkpoint_root(spark)}/ledger_analytics/report-{uuid.uuid4().hex}"
            bundle = _bundle(spark, sf_dir)
            paths = reports.write_report(bundle, base)
            sheets = reports.report_tables(bundle)
            # an empty cell is an empty text
            options = {"header": True, "multiLine": True, "escape": '"', "nullValue": "\u0000"}
            return {n: spark.read.schema(sheets[n].schema).options(**options).csv(paths[n]) for n in paths}

        return flat(_once(spark, sf_dir, "sheets", write)[name])

    return query


def risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the six-sheet report and read back the rows per sheet."""
    base = f"{checkpoint_root(spark)}/ledger_analytics/report-{uuid.uuid4().hex}"
    paths = reports.write_report(_bundle(spark, sf_dir), base)
    counts = [
        spark.read.option("header", True).option("multiLine", True).csv(path)
        .agg(F.lit(name).alias("sheet"), F.count(F.lit(1)).alias("n"))
        for name, path in paths.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# --- registry --------------------------------------------------------------------


def _on_ledger(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: flat(op(stored_ledger(spark, sf)))


def _on_profiled(op: Callable[[DataFrame, LedgerProfile], DataFrame]) -> Query:
    return lambda spark, sf: flat(op(stored_ledger(spark, sf), profile(spark, sf)))


def _on_scored(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: flat(op(scored(spark, sf)))


def _row_digits(led: DataFrame) -> DataFrame:
    a, cfg = F.col("amount"), AnalysisConfig()
    return led.select(
        "txn_id",
        F.coalesce(first_digit(a), F.lit(1)).alias("first_digit"),
        second_digit(a).alias("second_digit"),
        is_round(a, cfg.round_thresholds, cfg.round_margin).alias("is_round"),
        just_below(a, cfg.round_thresholds, cfg.round_margin).alias("just_below"),
    )


def _rsf_rows(led: DataFrame, prof: LedgerProfile) -> DataFrame:
    return rsf.with_rsf(led, prof).select(
        "txn_id", "rsf", "rsf_flag", "rsf_zscore", "vendor_median", "vendor_count"
    )


def _material_only(led: DataFrame, prof: LedgerProfile) -> DataFrame:
    cfg = replace(AnalysisConfig(), fuzzy_material_only=True)
    return fuzzy.fuzzy_duplicates(led, prof, cfg)


def _isolation(spark: SparkSession, sf: str, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    led = stored_ledger(spark, sf)
    rows = with_isolation(led, fit_forest(led, profile(spark, sf), config))
    return flat(rows.select("txn_id", "amount", "raw_score", "isolation_score", "is_outlier"))


def isolation_properties(spark: SparkSession, sf: str) -> DataFrame:
    """One row on the forest over the whole ledger: what holds for any random draw."""
    cfg = AnalysisConfig()
    rows = _isolation(spark, sf)
    same = rows.groupBy("amount").agg((F.min("isolation_score") == F.max("isolation_score")).alias("same"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.every(F.col("isolation_score").between(0, 100)).alias("scores_in_range"),
        (F.count_if("is_outlier") >= F.floor(F.count(F.lit(1)) * cfg.contamination)).alias("enough_outliers"),
        (F.min(F.when(F.col("is_outlier"), F.col("raw_score"))) >= F.max(F.when(~F.col("is_outlier"), F.col("raw_score")))).alias("outliers_on_top"),
    ).join(F.broadcast(same.agg(F.every("same").alias("equal_amounts_equal_scores"))))


def _full_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return flat(analyze(stored_ledger(spark, sf), lists=lists(spark, sf)).transactions)


def given_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The analysis with verdicts that the caller brings, for some of the vendors."""
    led = stored_ledger(spark, sf)
    names = led.select(F.lower("vendor").alias("vendor_lower")).distinct().where("ascii(vendor_lower) % 5 <> 0")
    given = names.selectExpr(
        "vendor_lower", "length(vendor_lower) % 3 <> 0 AS edgar_verified", "length(vendor_lower) % 17 = 0 AS ofac_hit",
        "CASE WHEN length(vendor_lower) % 2 = 0 THEN ascii(vendor_lower) % 2 = 0 END AS address_valid",
    )
    return flat(analyze(led, verdicts=given).transactions.select(
        "txn_id", "edgar_verified", "ofac_hit", "address_valid", "composite_risk", "risk_tier", "triggered_detectors"
    ))


def _full_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return flat(analyze(stored_ledger(spark, sf)).portfolio)


def _biggest_vendor_rows(df: DataFrame) -> DataFrame:
    top = df.groupBy("vendor").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "vendor").first()
    return reports.vendor_transactions(df, top["vendor"]).select("txn_id", "vendor", "composite_risk")


def _details(df: DataFrame) -> DataFrame:
    rows = reports.display_rows(df)
    results = F.array_join(
        F.transform("detector_results", lambda r: F.concat_ws("=", r["name"], r["status"], r["description"])),
        "; ",
    )
    return rows.withColumn("detector_results", results)


FILTER = dict(tier="MEDIUM", search="a", min_amount=5000.0, max_amount=200000.0,
              date_from="1996-01-01", date_to="1998-12-31", detector="DESCRIPTION_AUDIT")


def vendor_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_scored(reports.vendor_risk)(spark, sf_dir)


def _suspect_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return screening.suspect_addresses(
        screening.vendor_directory(stored_ledger(spark, sf)), screening.suspect_vendors(detected(spark, sf))
    )


def _sorted(key: str, ascending: bool, number: int) -> Query:
    """A page of the index over all scored rows, with the place of each row."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        index = _once(spark, sf, f"pages-{key}", lambda: PageIndex.build(scored(spark, sf), key, ascending))
        return flat(index.page(number).select("position", "txn_id", "vendor", "amount", "date", "composite_risk"))

    return query


def _benford(spark: SparkSession, sf: str) -> DataFrame:
    return benford.benford_summary(digits(spark, sf))


QUERIES: dict[str, Query] = {
    # sources and sinks
    "ledger_rows": lambda spark, sf: flat(ledger(spark, sf)),
    "csv_ledger": csv_ledger,
    "csv_line_numbers": csv_line_numbers,
    "csv_profile": csv_profile,
    "csv_rejects": csv_rejects,
    "csv_counters": csv_counters,
    "csv_mixed_headers": csv_mixed_headers,
    "csv_inner_quotes": csv_inner_quotes,
    "csv_short_rows": csv_short_rows,
    "frame_ledger": frame_ledger,
    "csv_late_amount_evidence": csv_late_amount_evidence,
    "csv_late_date_evidence": csv_late_date_evidence,
    "csv_extreme_amounts": csv_extreme_amounts,
    "csv_date_rejects": csv_date_rejects,
    "run_history": run_history,
    "stored_result_rows": stored_result_rows,
    "risk_report": risk_report,
    **{
        f"report_sheet_{name}": _sheet(name)
        for name in ("executive_summary", "flagged_transactions", "all_transactions", "detector_explanations",
                     "benford_analysis", "vendor_risk")
    },
    # detectors
    "ledger_profile": lambda spark, sf: flat(profile_frame(stored_ledger(spark, sf))),
    "row_digits": _on_ledger(_row_digits),
    "benford_digits": lambda spark, sf: flat(digits(spark, sf)),
    "benford_summary": lambda spark, sf: flat(_benford(spark, sf)),
    "round_number": _on_ledger(benford.round_number_report),
    "threshold_distribution": _on_ledger(benford.threshold_distribution),
    "vendor_stats": _on_ledger(rsf.vendor_stats),
    "relative_size": _on_profiled(_rsf_rows),
    "top_rsf_vendors": _on_profiled(lambda led, p: rsf.top_rsf_vendors(rsf.with_rsf(led, p))),
    "exact_duplicates": _on_ledger(duplicates.exact_duplicates),
    "similar_vendors": _on_ledger(
        lambda led: fuzzy.similar_names(led.select(F.lower("vendor").alias("v")).distinct(), "v")
    ),
    "fuzzy_duplicates": _on_profiled(fuzzy.fuzzy_duplicates),
    "fuzzy_duplicates_material": _on_profiled(_material_only),
    "split_anchors": _on_profiled(splits.split_anchors),
    "split_invoices": _on_profiled(splits.split_invoices),
    "split_invoices_limits": _on_profiled(
        lambda led, p: splits.split_invoices(led, p, replace(AnalysisConfig(), approval_thresholds=(30000.0, 180000.0)))
    ),
    "description_audit": _on_profiled(
        lambda led, p: descriptions.with_description_audit(led, p).select(
            "txn_id", "description_risk", "triggered_keywords"
        )
    ),
    "isolation_forest": _isolation,
    "isolation_small": lambda spark, sf: _isolation(
        spark, sf, AnalysisConfig(contamination=0.12, n_estimators=25, max_samples=64)
    ),
    "isolation_properties": isolation_properties,
    # screening
    "vendor_directory": _on_ledger(screening.vendor_directory),
    "suspect_vendors": lambda spark, sf: screening.suspect_vendors(detected(spark, sf)),
    "suspect_addresses": _suspect_addresses,
    "sanctions_screen": lambda spark, sf: screening.sanctions_verdicts(
        screened_names(spark, sf), lists(spark, sf).sanctions
    ),
    "sanctions_screen_ratio": lambda spark, sf: screening.sanctions_verdicts(
        screened_names(spark, sf), lists(spark, sf).sanctions, AnalysisConfig(sanctions_max_ratio=0.02)
    ),
    "registry_check": lambda spark, sf: flat(
        screening.registry_verdicts(screened_names(spark, sf), lists(spark, sf).registry)
    ),
    "address_check": lambda spark, sf: screening.address_verdicts(
        _suspect_addresses(spark, sf), lists(spark, sf).geocodes
    ),
    "vendor_verdicts": verdicts,
    # scores and roll-ups
    "composite_score": lambda spark, sf: flat(
        composite(spark, sf).select(
            "txn_id", "isolation_score", "rsf", "description_risk", "is_exact_duplicate",
            "is_split_invoice", "is_round_number", F.col("fuzzy_dup_group").isNotNull().alias("is_fuzzy"),
            "edgar_verified", "ofac_hit", "address_valid",
            "composite_risk", "risk_tier", "triggered_detectors",
        )
    ),
    "portfolio": lambda spark, sf: flat(portfolio(spark, sf)),
    "vendor_risk": vendor_risk,
    "vendor_view": _on_scored(reports.vendor_view),
    "top_vendors": _on_scored(lambda s: reports.top_vendors(reports.vendor_view(s))),
    "vendor_totals": _on_scored(lambda s: reports.vendor_totals(reports.vendor_view(s))),
    "vendor_transactions": _on_scored(_biggest_vendor_rows),
    "top_flagged_vendor": _on_scored(reports.top_flagged_vendor),
    "detector_counts": _on_scored(reports.detector_counts),
    "detector_chart": _on_scored(
        lambda s: reports.detector_chart(s, ["RSF", "SPLIT_INVOICE", "BENFORD_1ST", "ROUND_NUMBER"])
    ),
    "top_detectors": _on_scored(reports.top_detectors),
    "score_histogram": _on_scored(reports.score_histogram),
    "tier_counts": _on_scored(reports.tier_counts),
    "tiers_by_month": _on_scored(reports.tiers_by_month),
    "tiers_by_day": _on_scored(reports.tiers_by_day),
    # views
    "filter_transactions": _on_scored(
        lambda s: reports.filter_transactions(s, **FILTER).select("txn_id", "vendor", "amount", "date")
    ),
    "sorted_by_date": _sorted("date", True, 3),
    "sorted_by_amount": _sorted("amount", False, 2),
    "sorted_by_risk": _sorted("composite_risk", False, 20),
    "sorted_by_vendor": _sorted("vendor", True, 2),
    "sorted_page": _on_scored(
        lambda s: reports.page(reports.sort_transactions(s, "vendor", True), 2).select("txn_id", "vendor")
    ),
    "page_count": _on_scored(lambda s: reports.page_count(reports.filter_transactions(s, tier="HIGH"))),
    "flagged_transactions": _on_scored(
        lambda s: reports.flagged_transactions(s).select("txn_id", "composite_risk", "risk_tier")
    ),
    "display_rows": _on_scored(_details),
    "score_details": _on_scored(reports.score_details),
    "report_rows": _on_scored(reports.report_rows),
    "executive_summary": lambda spark, sf: reports.executive_summary(
        portfolio(spark, sf), _benford(spark, sf)
    ),
    "detector_explanations": _on_scored(
        lambda s: reports.detector_explanations(s).drop("Full Explanation", "Short Description")
    ),
    "benford_rows": lambda spark, sf: flat(
        reports.benford_rows(_benford(spark, sf)).drop("Chi-Square Note")
    ),
    "exposure_text": _on_scored(
        lambda s: s.groupBy("vendor").agg(reports.exposure_text(total_amount(F.col("amount"))).alias("spend"))
    ),
    # the whole, with the forest
    "full_analysis": _full_analysis,
    "full_portfolio": _full_portfolio,
    "given_verdicts": given_verdicts,
}
