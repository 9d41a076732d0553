"""Load a ledger with arbitrary column names and clean it.

``load_csv`` reads CSV files, ``load_frame`` any DataFrame. Both resolve which
column is which, infer the amount column and the date format when needed, and
sort rows into accepted, credit (zero or negative), unparseable and undated ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_analytics import fixed_values as fv
from ledger_analytics.config import AnalysisConfig
from ledger_analytics.functions.numeric import is_amount
from ledger_analytics.functions.text import WS, blank_to_null, ws_trim
from ledger_analytics.schema import LEDGER
from ledger_analytics.sources.materialize import materialize

# The numeric share a column needs, the size warning
AMOUNT_MIN_SHARE = 0.5
LARGE_LEDGER_ROWS = 50_000

# Fixed value: a number at the start of a cell, after "$", "," and blanks are removed
_NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
# Fixed value: day and month in either order, then the year
_DAY_MONTH = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\z"
# written-out dates that are read besides the numeric ones
_TEXT_DATES = ["MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d"]

ISO, US, EU, AMBIGUOUS, UNKNOWN = fv.DATE_FORMATS
_LEDGER_FIELDS = [f.name for f in LEDGER if f.name != "txn_id"]


def auto_mapping(headers: list[str]) -> dict[str, str]:
    """Ledger field -> header, by the alias lists; a field's first alias present wins.

    Fields without an alias list are taken when a header has their exact name.
    """
    present = {h.strip().lower() for h in headers}
    found = {}
    for name in _LEDGER_FIELDS:
        for alias in fv.HEADER_ALIASES.get(name, [name]):
            if alias in present:
                found[name] = alias
                break
    return found


@dataclass(frozen=True)
class LoadResult:
    """``rows`` holds every input row: row number, outcome, raw amount and ledger columns."""

    rows: DataFrame
    mapping: dict[str, str] = field(default_factory=dict)
    date_format: str = UNKNOWN

    @property
    def ledger(self) -> DataFrame:
        return self.rows.where("outcome = 'ok'").select(*[f.name for f in LEDGER])

    @property
    def rejects(self) -> DataFrame:
        """(row, field, message) of the rows whose amount or date cannot be read."""
        undated = F.col("outcome") == "undated"
        return self.rows.where("outcome IN ('skip', 'undated')").select(
            F.col("txn_id").alias("row"),
            F.when(undated, "date").otherwise("amount").alias("field"),
            F.concat(
                F.when(undated, fv.REJECT_DATE).otherwise(fv.REJECT_AMOUNT),
                F.lit('"'),
                F.when(undated, F.col("raw_date")).otherwise(F.col("raw_amount")),
                F.lit('"'),
            ).alias("message"),
        )

    @property
    def counters(self) -> DataFrame:
        """(outcome, n) over ok, credit, skip and undated."""
        return self.rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))

    @property
    def profile(self) -> DataFrame:
        """One row of what the loader decided and counted."""
        counts = self.rows.agg(
            *[F.count_if(F.col("outcome") == o).alias(f"{o}_rows") for o in ("ok", "credit", "skip")]
        )
        return counts.select(
            *[F.lit(self.mapping.get(f)).cast("string").alias(f"{f}_column") for f in _LEDGER_FIELDS],
            F.lit(self.date_format).alias("date_format"),
            F.lit(self.date_format == AMBIGUOUS).alias("date_warning"),
            "ok_rows",
            "credit_rows",
            "skip_rows",
            (F.col("ok_rows") > LARGE_LEDGER_ROWS).alias("size_warning"),
        )


def _column(name: str) -> Column:
    """Column by its literal name: headers may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def _cleaned(cell: Column) -> Column:
    return F.regexp_replace(F.coalesce(cell, F.lit("")), f"[$,]|{WS}", "")


def parse_amount(cell: Column) -> Column:
    """Leading number of the cell, null if there is none."""
    text = F.regexp_extract(_cleaned(cell), f"^{_NUMBER}", 0)
    return F.nullif(text, F.lit("")).try_cast("double")


_EXACT_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType)
_TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)


def _typed_amount(df: DataFrame, name: str) -> Column:
    """What :func:`parse_amount` reads from the text of a column, for numbers without making the text."""
    c = _column(name)
    if isinstance(df.schema[name].dataType, _EXACT_NUMBERS):
        number = c.cast("double")
        return F.when(F.abs(number) < float("inf"), number)
    return parse_amount(c.cast("string"))


def _typed_date(df: DataFrame, name: str, date_format: str) -> Column:
    """What :func:`parse_date` reads from the text of a column, for dates without making the text."""
    c = _column(name)
    if isinstance(df.schema[name].dataType, (T.DateType, *_TIMESTAMPS)):
        # the text of other years does not have four digits
        return F.when(F.year(c).between(0, 9999), c.cast("date"))
    return parse_date(c.cast("string"), date_format)


def row_outcome(amount: Column) -> Column:
    return F.when(~is_amount(amount), "skip").when(amount <= 0, "credit").otherwise("ok")


def infer_amount_column(df: DataFrame) -> str | None:
    """The first column with the most positive numbers, if at least half of the rows have one.

    A cell counts only if all of it is a number; else a date column would qualify
    by its year. Columns with a type of their own are not made into text.
    """
    types = {f.name: f.dataType for f in df.schema}

    def positive(c: str) -> Column:
        cell, kind = _column(c), types[c]
        if isinstance(kind, T.NumericType):
            return F.count_if((cell > 0) & (cell.cast("double") < float("inf")))
        if isinstance(kind, (T.BooleanType, T.DateType, *_TIMESTAMPS)):
            return F.count_if(F.lit(False))
        cell = cell.cast("string")
        # most texts that are no numbers show it by their first characters
        maybe = cell.rlike(rf"^[0-9+\-.eE$,{WS[1:-1]}]*+\z")
        whole = _cleaned(cell).rlike(rf"^{_NUMBER}\z")
        return F.count_if(F.when(maybe, whole & (parse_amount(cell) > 0)))

    n, *hits = df.agg(F.count(F.lit(1)), *[positive(c) for c in df.columns]).first()
    best = max(hits, default=0)
    if best == 0 or best < n * AMOUNT_MIN_SHARE:
        return None
    return df.columns[hits.index(best)]


def infer_date_format(df: DataFrame, column: str) -> str:
    """ISO, US, EU, ambiguous or unknown, from all rows of ``column``."""
    kind = df.schema[column].dataType
    if isinstance(kind, _TIMESTAMPS):  # the time of day is none of the formats
        return UNKNOWN
    if isinstance(kind, T.DateType):
        return UNKNOWN if df.where(F.year(_column(column)).between(0, 9999)).isEmpty() else ISO
    v = ws_trim(F.coalesce(_column(column).cast("string"), F.lit("")))
    iso = v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\z")
    slash = v.rlike(_DAY_MONTH)
    first = F.regexp_extract(v, _DAY_MONTH, 1).try_cast("int")
    second = F.regexp_extract(v, _DAY_MONTH, 2).try_cast("int")
    seen = df.agg(
        F.count_if(iso).alias("iso"),
        F.count_if(slash).alias("slash"),
        F.count_if(first > 12).alias("first"),
        F.count_if(second > 12).alias("second"),
    ).first()
    if seen["iso"] > seen["slash"]:
        return ISO
    if seen["slash"] == 0:
        return UNKNOWN
    if seen["first"] and not seen["second"]:
        return EU
    if seen["second"] and not seen["first"]:
        return US
    return AMBIGUOUS


def parse_date(cell: Column, date_format: str) -> Column:
    """Date of a cell under the inferred format, null if it cannot be read.

    Day/month dates follow the format; without a decision they are read
    month first. Two-digit years turn at 70, undecided ones at 50.
    """
    v = ws_trim(F.coalesce(cell, F.lit("")))
    decided = date_format in (US, EU)
    day, month = (1, 2) if date_format == EU else (2, 1)
    year = F.regexp_extract(v, _DAY_MONTH, 3).try_cast("int")
    full_year = F.when(year >= 100, year).when(year < (70 if decided else 50), year + 2000).otherwise(
        year + 1900
    )
    parts = [full_year] + [F.regexp_extract(v, _DAY_MONTH, g).try_cast("int") for g in (month, day)]
    numeric = F.concat_ws("-", *parts).try_cast("date")
    written = [F.try_to_date(v, fmt) for fmt in _TEXT_DATES]
    return (
        F.when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), v.try_cast("date"))
        .when(v.rlike(_DAY_MONTH), numeric)
        .otherwise(F.coalesce(*written))
    )


def _clean_rows(df: DataFrame, mapping: dict[str, str], date_format: str, config: AnalysisConfig) -> DataFrame:
    """Canonical columns of a DataFrame that has a txn_id."""

    def cell(name: str) -> Column:
        return _column(mapping[name]).cast("string") if name in mapping else F.lit(None).cast("string")

    amount = _typed_amount(df, mapping["amount"]) if "amount" in mapping else parse_amount(cell("amount"))
    date = _typed_date(df, mapping["date"], date_format) if "date" in mapping else parse_date(cell("date"), date_format)
    date = F.coalesce(date, F.lit(config.run_date).cast("date"))
    outcome = row_outcome(amount)
    return df.select(
        "txn_id",
        F.when((outcome == "ok") & date.isNull(), "undated").otherwise(outcome).alias("outcome"),
        F.coalesce(cell("amount"), F.lit("")).alias("raw_amount"),
        F.coalesce(cell("date"), F.lit("")).alias("raw_date"),
        F.coalesce(
            blank_to_null(cell("invoice_id")), F.concat(F.lit("ROW-"), F.col("txn_id"))
        ).alias("invoice_id"),
        date.alias("date"),
        F.coalesce(blank_to_null(cell("vendor")), F.lit("Unknown")).alias("vendor"),
        amount.alias("amount"),
        *[
            blank_to_null(cell(name)).alias(name)
            for name in ("description", "category", "approved_by", "address")
        ],
    )


def _resolve(df: DataFrame, mapping: dict[str, str] | None) -> tuple[dict[str, str], str]:
    headers = df.columns
    wanted = {k: v.strip().lower() for k, v in mapping.items()} if mapping else auto_mapping(headers)
    found = {k: v for k, v in wanted.items() if v in headers}
    if "amount" not in found and headers:
        found["amount"] = infer_amount_column(df) or headers[0]
    date_format = infer_date_format(df, found["date"]) if "date" in found else UNKNOWN
    return found, date_format


# a comma and a cell: characters outside of quotes, and quoted stretches, the last of which may
# be left open; two quotes inside of such a stretch stand for one
_CELL = r',((?:[^,"]++|"(?:[^"]++|"")*+(?:"|\z))*+)'
_QUOTED = r'"((?:[^"]++|"")*+)(?:"|\z)'
#: Different header lines that one load may have.
MOST_HEADERS = 10_000
#: Splits of the input up to which the table of them is sent to all tasks.
FEW_SPLITS = 100_000


def split_cells(line: Column) -> Column:
    """Cells of a comma-separated line. Quotes open and close anywhere in a cell."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))

    def plain(cell: Column) -> Column:
        bare = F.replace(F.regexp_replace(cell, _QUOTED, "$1"), F.lit('""'), F.lit('"'))
        return F.when(F.contains(cell, F.lit('"')), bare).otherwise(cell)

    return F.transform(cells, plain)


def _header_names(line: str | None) -> str:
    return (line or "").strip("\ufeff").strip().lower()


def _raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines that are not blank, with their file, split, and a number that ascends within a split."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    return lines.where(F.col("value").rlike(r"[^\x00-\x20]")).withColumn("at", F.monotonically_increasing_id())


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split of the input (file, start, first, before, leads, header): the number of
    its first line, how many data rows lie before it, whether it begins with the header line,
    and its file's header line."""
    found = lines.groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min_by("value", "at").alias("head")
    )
    of_file = Window.partitionBy("file").orderBy("start")
    found = found.withColumn("leads", (F.row_number().over(of_file) == 1).cast("int")).withColumn("header", F.first("head").over(of_file))
    # a row for each split of some hundred megabytes
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("n") - F.col("leads")).over(earlier), F.lit(0))
    return found.select("file", "start", "first", "leads", "header", before.alias("before"))


def load_csv(
    spark: SparkSession,
    path: str | list[str],
    mapping: dict[str, str] | None = None,
    config: AnalysisConfig = AnalysisConfig(),
    store: bool = True,
) -> LoadResult:
    """Read comma-separated files, each of which starts with a header line of its own.

    Blank lines are skipped, short rows padded, surplus cells ignored; of columns with the
    same header the last one counts. Files may have their columns in another order, or other
    columns: cells go by the header of their file. Quotes open and close anywhere in a cell.
    ``mapping`` names the header of each ledger field; without it headers are matched against
    the known aliases. The text is read twice, to count lines and find headers, and to cut
    it into cells; ``txn_id`` is the line number in the files read one after another, header
    lines counted once. With ``store`` the cells and the cleaned rows are written to the
    checkpoint folder, since an analysis reads them many times.
    """
    lines = _raw_lines(spark, path)
    splits = materialize(_splits(lines), "csv-splits")
    heads = splits.where("leads = 1").select("header").distinct().limit(MOST_HEADERS + 1)
    heads = [(r["header"], r["cells"]) for r in heads.select("header", split_cells(F.col("header")).alias("cells")).collect()]
    if len(heads) > MOST_HEADERS:
        raise ValueError(f"the files have more than {MOST_HEADERS} different header lines")
    first_head = splits.orderBy("file", "start").select("header").first()
    if not heads or first_head is None:
        extra = [T.StructField(c, T.StringType()) for c in ("outcome", "raw_amount", "raw_date")]
        return LoadResult(spark.createDataFrame([], T.StructType([*LEDGER, *extra])))
    # columns in the order of the first file, then what others have besides
    heads.sort(key=lambda h: (h[0] != first_head["header"], h[0]))
    at = [{_header_names(c): i for i, c in enumerate(cells) if _header_names(c)} for _, cells in heads]
    headers = list(dict.fromkeys(h for positions in at for h in positions))

    known = spark.createDataFrame([(h, i) for i, (h, _) in enumerate(heads)], "header string, kind int")
    places = splits.join(F.broadcast(known), "header").drop("header")
    few = splits.count() <= FEW_SPLITS
    rows = lines.join(F.broadcast(places) if few else places, ["file", "start"]).where("leads = 0 OR at > first")
    number = F.col("before") + F.col("at") - F.col("first") - F.col("leads") + 2
    rows = rows.select(number.alias("txn_id"), "kind", split_cells(F.col("value")).alias("cells"))
    rows = materialize(rows, "csv-cells") if store else rows

    def cell(header: str) -> Column:
        places = [positions.get(header) for positions in at]
        if len(set(places)) == 1:
            return F.get("cells", F.lit(places[0]))
        return F.get("cells", F.get(F.array(*[F.lit(p).cast("int") for p in places]), F.col("kind")))

    found, date_format = _resolve(rows.select(*[cell(h).alias(h) for h in headers]), mapping)
    columns = {name: f"c{headers.index(header)}" for name, header in found.items()}
    named = rows.select("txn_id", *[cell(h).alias(f"c{i}") for i, h in enumerate(headers) if h in found.values()])
    cleaned = _clean_rows(named, columns, date_format, config)
    return LoadResult(materialize(cleaned, "loaded") if store else cleaned, found, date_format)


def load_frame(
    df: DataFrame,
    mapping: dict[str, str] | None = None,
    id_column: str | None = None,
    config: AnalysisConfig = AnalysisConfig(),
    store: bool = True,
) -> LoadResult:
    """Clean a DataFrame from any Spark source by the same rules.

    ``id_column`` is a unique number in input order; without it Spark's increasing
    row ids are used, which are unique but follow the partitions; as they change from
    one evaluation to the next, the rows must then be stored.
    """
    if id_column is None and not store:
        raise ValueError("rows that are not stored need an id_column")
    found, date_format = _resolve(df.select(*[_column(c).alias(c.strip().lower()) for c in df.columns]), mapping)
    key = _column(id_column).cast("long") if id_column else F.monotonically_increasing_id()
    numbered = df.select(
        key.alias("txn_id"),
        *[
            _column(c).alias(c.strip().lower())
            for c in df.columns
            if c.strip().lower() in found.values() and c.strip().lower() != "txn_id"
        ],
    )
    rows = _clean_rows(numbered, found, date_format, config)
    return LoadResult(materialize(rows, "loaded") if store else rows, found, date_format)
