"""The registered queries in SQL (DuckDB), written from the definitions: plain
self-joins and windows, with none of the blocking the Spark side uses."""

from __future__ import annotations

from ledger_analytics import fixed_values as fv
from ledger_analytics.plans.reports import CHI_SQUARE_NOTE, EXPLANATIONS

V0 = "upper(substr(md5(cast(c_nationkey AS varchar)), 1, 8)) || ' ' || c_mktsegment"

# --- the derived ledger ----------------------------------------------------------

LEDGER = f"""
base AS (
  SELECT o_orderkey AS k, o_totalprice, cast(o_orderdate AS date) AS d, o_orderpriority, c_nationkey,
         c_mktsegment, {V0} AS v0
  FROM orders JOIN customer ON o_custkey = c_custkey),
single AS (
  SELECT k * 10 AS txn_id, 'INV-' || k AS invoice_id, d AS date,
    CASE WHEN k % 97 = 0 THEN lower(v0)
         WHEN k % 89 = 0 THEN substr(v0, 1, length(v0) - 1)
         WHEN k % 83 = 0 THEN 'ONEOFF ' || md5(cast(k AS varchar))
         ELSE v0 END AS vendor,
    CASE WHEN k % 23 = 0 THEN cast(1000 * (1 + k % 40) AS double)
         WHEN k % 29 = 0 THEN cast(9990 AS double)
         WHEN k % 7 = 0 THEN cast(9000 + (k % 13) * 50 AS double)
         WHEN k % 11 = 0 THEN floor(o_totalprice * 2) / 100
         ELSE o_totalprice END AS amount,
    CASE k % 8 WHEN 0 THEN 'Miscellaneous' WHEN 1 THEN NULL WHEN 2 THEN 'Consulting'
         WHEN 3 THEN 'Office chairs order' WHEN 4 THEN 'n/a' WHEN 5 THEN 'Gift cards'
         WHEN 6 THEN '12345' ELSE 'Server rack installation' END AS description,
    c_mktsegment AS category, o_orderpriority AS approved_by, 'NATION ' || c_nationkey AS address
  FROM base),
ledger AS (
  SELECT * FROM single
  UNION ALL
  SELECT txn_id + 1, invoice_id, date, upper(vendor), amount, description, category, approved_by, address
  FROM single WHERE txn_id % 1010 = 0)"""

# --- detectors -----------------------------------------------------------------

PROFILE = """
sorted AS (SELECT list_sort(list(amount)) AS a, count(*) AS n FROM ledger),
prof AS (
  SELECT n, a[n] AS max_amount, (a[(n + 1) // 2] + a[n // 2 + 1]) / 2 AS median,
         a[n // 2 + 1] AS upper_median, a[least(cast(floor(n * 0.75) AS bigint), n - 1) + 1] AS p75
  FROM sorted)"""

VENDOR_STATS = """
vstats AS (
  SELECT vendor, median(amount) AS vendor_median, cast(sum(cast(amount AS decimal(24, 6))) AS double) / count(*) AS vendor_mean,
         stddev_pop(amount) AS vendor_std, count(*) AS vendor_count
  FROM ledger GROUP BY vendor)"""

RSF = """
rsf AS (
  SELECT l.txn_id, l.vendor, l.amount, amount / b AS rsf, amount / b > 3.0 AS rsf_flag,
         CASE WHEN vendor_std > 0 THEN (amount - vendor_mean) / vendor_std ELSE 0 END AS rsf_zscore,
         vendor_median, vendor_count
  FROM (SELECT l.*, v.* EXCLUDE (vendor),
               CASE WHEN vendor_count < 5 AND p.median > 0 THEN p.median ELSE vendor_median END AS b
        FROM ledger l JOIN vstats v USING (vendor), prof p) l)"""

DUPS = r"""
keyed AS (
  SELECT *, cast(amount AS decimal(18, 2)) AS amount2,
         trim(regexp_replace(lower(vendor), '\s+', ' ', 'g')) AS vendor_key
  FROM ledger),
dups AS (
  SELECT txn_id, count(*) OVER (PARTITION BY date, amount2, vendor_key) AS dup_count,
         date || '|' || amount2 || '|' || vendor_key AS dup_group_key
  FROM keyed QUALIFY dup_count > 1)"""

SIMILAR = """
names AS (SELECT DISTINCT lower(vendor) AS name FROM ledger),
similar_names AS (
  SELECT a.name, b.name AS other, levenshtein(a.name, b.name) AS distance
  FROM names a JOIN names b ON a.name <> b.name AND levenshtein(a.name, b.name) <= 2)"""


def fuzzy(material_only: bool) -> str:
    return f"""
banded AS (
  SELECT k.*, lower(vendor) AS name, cast(floor(amount / 1000 + 0.5) AS bigint) AS band,
         {'amount >= (SELECT upper_median FROM prof)' if material_only else 'true'} AS material
  FROM keyed k),
fuzzy_pairs AS (
  SELECT a.txn_id, b.txn_id AS other, s.distance
  FROM banded a JOIN similar_names s ON s.name = a.name
       JOIN banded b ON b.name = s.other AND abs(a.band - b.band) <= 2
  WHERE (a.material OR b.material)
    AND NOT (a.vendor_key = b.vendor_key AND a.date = b.date AND a.amount2 = b.amount2)),
fuzzy AS (
  SELECT txn_id, 'FUZZY-' || least(txn_id, m.other) || '-' || greatest(txn_id, m.other) AS fuzzy_dup_group,
         m.other AS fuzzy_match_txn_id, cast(m.distance AS integer) AS fuzzy_distance
  FROM (SELECT txn_id, min({{'distance': distance, 'other': other}}) AS m FROM fuzzy_pairs GROUP BY txn_id))"""


SPLITS = """
grouped AS (
  SELECT txn_id, lower(trim(vendor)) AS g, date, amount, cast(amount AS decimal(24, 6)) AS exact FROM ledger),
clusters AS (
  SELECT a.g, a.date, a.txn_id AS anchor, sum(b.exact) AS total, count(*) AS size,
         min(b.amount) AS low, max(b.amount) AS high
  FROM grouped a JOIN grouped b ON a.g = b.g AND b.date BETWEEN a.date AND a.date + 7
       AND (b.date > a.date OR b.txn_id >= a.txn_id)
  GROUP BY ALL HAVING count(*) >= 2 AND (max(b.amount) - min(b.amount)) / max(b.amount) <= 0.15),
limits AS (SELECT unnest([1000, 2500, 5000, 10000, 25000, 50000, 100000]) AS t),
anchors AS (
  SELECT g, date, anchor, cast(total AS double) AS cluster_total, size AS cluster_size,
         cast(min(t) AS double) AS suspected_threshold
  FROM clusters JOIN limits ON high < t AND total >= t AND total <= t * 3.5 GROUP BY ALL),
splits AS (
  SELECT r.txn_id, 'SPLIT-' || a.anchor AS split_cluster_id, cluster_total, cluster_size, suspected_threshold
  FROM grouped r JOIN anchors a ON a.g = r.g AND r.date BETWEEN a.date AND a.date + 7
       AND (a.date < r.date OR a.anchor <= r.txn_id)
  QUALIFY row_number() OVER (PARTITION BY r.txn_id ORDER BY a.date, a.anchor) = 1)"""

ROUND = "(amount % 1000 = 0 OR {near})"
NEAR = "(" + " OR ".join(f"(amount < {t} AND {t} - amount <= 15)" for t in fv.ROUND_THRESHOLDS) + ")"
ROUND = ROUND.format(near=NEAR)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_HITS = ", ".join(
    f"CASE WHEN regexp_matches(t, {_quoted(p)}, 'i') THEN {{'w': {w}, 'l': {_quoted(label)}}} END"
    for p, w, label in fv.DESCRIPTION_PATTERNS
)
DESCRIPTIONS = f"""
texts AS (SELECT txn_id, amount, coalesce(trim(description), '') AS t FROM ledger),
hits AS (SELECT *, list_filter([{_HITS}], lambda x: x IS NOT NULL) AS h FROM texts),
risks AS (
  SELECT txn_id, amount, t, CASE WHEN len(h) = 0 AND length(t) < 5
           THEN [{{'w': 20, 'l': '{fv.SHORT_DESCRIPTION_LABEL}'}}] ELSE h END AS h
  FROM hits),
audit AS (
  SELECT txn_id,
    cast(least(100, floor(CASE WHEN t = '' THEN CASE WHEN amount > p75 THEN 60 * 1.4::double ELSE 60 END
         WHEN amount > greatest(max_amount, 1) * 0.5
           THEN least(100, (CASE WHEN amount > p75 THEN least(100, raw * 1.3::double) ELSE raw END) * 1.2::double)
         WHEN amount > p75 THEN least(100, raw * 1.3::double) ELSE raw END + 0.5)) AS integer)
      AS description_risk,
    CASE WHEN t = '' THEN ['{fv.MISSING_DESCRIPTION_LABEL}']
         ELSE list_transform(h, lambda x: x.l) END AS triggered_keywords
  FROM (SELECT *, cast(coalesce(list_sum(list_transform(h, lambda x: x.w)), 0) AS double) AS raw FROM risks), prof)"""

_CANON = (
    "ltrim(replace(rtrim(rtrim(cast(cast(amount AS decimal(28, 10)) AS varchar), '0'), '.'), '.', ''), '0')"
)
ROW_DIGITS = f"""
row_digits AS (
  SELECT txn_id, coalesce(try_cast(substr({_CANON}, 1, 1) AS integer), 1) AS first_digit,
         try_cast(nullif(substr({_CANON}, 2, 1), '') AS integer) AS second_digit,
         {ROUND} AS is_round, {NEAR} AS just_below
  FROM ledger)"""

BENFORD = """
dim AS (
  SELECT 1 AS digit_position, d AS digit, 100 * log10(1 + 1.0 / d) AS expected_pct
  FROM (SELECT unnest(range(1, 10)) AS d)
  UNION ALL
  SELECT 2, d, 100 * sum(log10(1 + 1.0 / (10 * k + d)))
  FROM (SELECT unnest(range(0, 10)) AS d), (SELECT unnest(range(1, 10)) AS k) GROUP BY d),
seen AS (
  SELECT 1 AS digit_position, first_digit AS digit FROM row_digits
  UNION ALL SELECT 2, second_digit FROM row_digits WHERE second_digit IS NOT NULL),
digits AS (
  SELECT dim.digit_position, dim.digit, count(seen.digit) AS n,
         100.0 * count(seen.digit) / sum(count(seen.digit)) OVER (PARTITION BY dim.digit_position)
           AS observed_pct, expected_pct
  FROM dim LEFT JOIN seen USING (digit_position, digit) GROUP BY 1, 2, expected_pct),
benford AS (
  SELECT *, CASE WHEN mad < CASE digit_position WHEN 1 THEN 0.012 ELSE 0.010 END THEN 'ACCEPTABLE'
       WHEN mad < CASE digit_position WHEN 1 THEN 0.015 ELSE 0.012 END THEN 'MARGINAL'
       ELSE 'NON_CONFORMING' END AS conformity
  FROM (SELECT digit_position, cast(sum(n) AS bigint) AS total_records,
               sum(power(observed_pct - expected_pct, 2) / expected_pct) AS chi_square,
               avg(abs(observed_pct - expected_pct)) / 100 AS mad,
               sum(power(observed_pct - expected_pct, 2) / expected_pct) * sum(n) / 100 AS chi_square_counts
        FROM digits GROUP BY digit_position))"""

# --- screening -----------------------------------------------------------------

LISTS = """
groups AS (SELECT DISTINCT c_nationkey AS n, v0 FROM base),
oneoff AS (SELECT k, 'ONEOFF ' || md5(cast(k AS varchar)) AS name FROM base WHERE k % 83 = 0),
sanctions AS (
  SELECT name AS entity_name, 'SDN' AS list_type FROM oneoff WHERE k % 5 = 0
  UNION ALL SELECT substr(name, 1, length(name) - 1) || 'x', 'SDN' FROM oneoff WHERE k % 5 = 1
  UNION ALL SELECT v0 || ' HOLDINGS', 'NON-SDN' FROM groups WHERE n % 7 = 0),
registry AS (
  SELECT v0 || ',' AS entity_name, 'CIK' || n AS cik FROM groups WHERE n % 2 = 0
  UNION ALL SELECT v0 || ' Holdings Trading', 'CIK9' || n FROM groups WHERE n % 3 = 0),
geocodes AS (
  SELECT DISTINCT 'nation  ' || n || '.' AS address, CASE WHEN n % 2 = 1 THEN 'Residential' ELSE 'office' END
    AS address_type FROM groups WHERE n % 5 <> 0)"""


def norm(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


DIRECTORY = """
directory AS (
  SELECT lower(vendor) AS vendor_lower, arg_min(vendor, txn_id) AS vendor,
         arg_min(address, txn_id) FILTER (coalesce(address, '') <> '') AS address
  FROM ledger GROUP BY 1)"""


def sanctions_screen(vendors: str, ratio: float = 1) -> str:
    close = f"(levenshtein(name, entity) <= 2 AND levenshtein(name, entity) <= {ratio} * length(name))"
    return f"""
entities AS (
  SELECT {norm('entity_name')} AS entity, min({{'matched_name': entity_name, 'list_type': list_type}}) AS listing
  FROM sanctions GROUP BY 1),
screened AS (SELECT vendor_lower, {norm('vendor_lower')} AS name FROM {vendors}),
found AS (
  SELECT vendor_lower, CASE WHEN name = entity THEN 0
      WHEN len(string_split(entity, ' ')) >= 3 AND contains(' ' || name || ' ', ' ' || entity || ' ') THEN 1
      ELSE 2 END AS kind,
    levenshtein(name, entity) AS distance, listing
  FROM screened JOIN entities ON name = entity OR {close}
    OR (len(string_split(entity, ' ')) >= 3 AND contains(' ' || name || ' ', ' ' || entity || ' '))),
best_hit AS (
  SELECT vendor_lower, min({{'kind': kind, 'distance': CASE kind WHEN 2 THEN distance ELSE 0 END,
                            'listing': listing}}) AS b
  FROM found GROUP BY 1),
sanctioned AS (
  SELECT vendor_lower, b IS NOT NULL AS ofac_hit, b.listing.matched_name AS matched_name,
         b.listing.list_type AS list_type,
         CASE b.kind WHEN 0 THEN 'exact' WHEN 1 THEN 'contains' WHEN 2 THEN 'fuzzy' END AS match_kind,
         cast(b.distance AS integer) AS match_distance
  FROM screened LEFT JOIN best_hit USING (vendor_lower))"""


def registry_check(vendors: str) -> str:
    def tokens(c: str) -> str:
        return f"list_filter(list_distinct(string_split({norm(c)}, ' ')), lambda x: x <> '')"

    return f"""
vtok AS (SELECT vendor_lower, {tokens('vendor_lower')} AS v FROM {vendors}),
rtok AS (SELECT entity_name, cik, {tokens('entity_name')} AS r FROM registry),
jac AS (
  SELECT vendor_lower, entity_name, cik, len(list_intersect(v, r)) /
         cast(len(v) + len(r) - len(list_intersect(v, r)) AS double) AS j
  FROM vtok JOIN rtok ON list_has_any(v, r)),
registered AS (
  SELECT vendor_lower, b IS NOT NULL AS edgar_verified, b.j AS confidence,
         b.e.entity_name AS entity_name, b.e.cik AS cik
  FROM vtok LEFT JOIN (
    SELECT vendor_lower, arg_min({{'j': j, 'e': {{'entity_name': entity_name, 'cik': cik}}}},
                                 {{'j': -j, 'e': entity_name, 'c': cik}}) AS b
    FROM jac WHERE j >= 0.7 GROUP BY 1) USING (vendor_lower))"""


STAND_IN = """
isolation AS (
  SELECT txn_id, cast(cast(floor(amount) AS bigint) % 101 AS integer) AS isolation_score,
         cast(floor(amount) AS bigint) % 101 >= 96 AS is_outlier FROM ledger)"""


def _draw(*parts: str) -> str:
    key = " || '/' || ".join(parts)
    return f"cast('0x' || substr(md5({key}), 1, 13) AS bigint)"


def _search_path(n: str) -> str:
    return f"""cast(floor(CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1
    ELSE 2 * (ln({n} - 1) + 0.5772156649::double) - 2 * ({n} - 1) / cast({n} AS double) END * 1e9 + 0.5) AS bigint)"""


def forest(contamination: float = 0.05, trees: int = 200, samples: int = 256) -> str:
    """The isolation forest: samples of ranks, trees grown by recursion, paths by running sums."""
    return f"""
celled AS (
  SELECT txn_id, amount, CASE WHEN high <= low THEN 0
      ELSE cast(greatest(least(floor((ln(1 + amount) - low) / (high - low) * 65536), 65535), 0) AS integer) END AS cell
  FROM ledger, (SELECT min(ln(1 + amount)) AS low, max(ln(1 + amount)) AS high FROM ledger)),
ranked AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS rank FROM celled),
sizes AS (SELECT count(*) AS n, least({samples}, count(*)) AS take FROM ledger),
runs AS (
  SELECT tree, i, i * n // take AS lo, (i + 1) * n // take AS hi
  FROM (SELECT unnest(range({trees})) AS tree), (SELECT unnest(range({samples})) AS i), sizes WHERE i < take),
samples AS (
  SELECT tree, list_sort(list(cell)) AS points
  FROM (SELECT tree, lo + {_draw("'42'", "tree", "'row'", "i")} % (hi - lo) AS rank FROM runs) JOIN ranked USING (rank)
  GROUP BY tree),
nodes AS (
  SELECT tree, 0 AS depth, 0 AS cell, points FROM samples
  UNION ALL
  SELECT tree, depth + 1, CASE WHEN above THEN cast(edge AS integer) ELSE cell END,
         list_filter(points, lambda x: (x >= edge) = above)
  FROM (SELECT nodes.*, points[1] + 1 + {_draw("'42'", "tree", "depth", "cell")} % (points[-1] - points[1]) AS edge
        FROM nodes, sizes WHERE points[1] < points[-1] AND depth < ceil(log2(take))), (VALUES (true), (false)) s(above)),
leaves AS (
  SELECT tree, nodes.cell, cast(depth AS bigint) * 1000000000 + {_search_path('len(points)')} AS path
  FROM nodes, sizes WHERE points[1] = points[-1] OR depth >= ceil(log2(take))),
steps AS (
  SELECT cell, path - lag(path, 1, 0) OVER (PARTITION BY tree ORDER BY cell) AS step FROM leaves),
edges AS (
  SELECT cell, cast(sum(sum(step)) OVER (ORDER BY cell) AS bigint) AS path FROM steps GROUP BY cell),
raws AS (
  SELECT txn_id, amount, power(2, -(path / ({trees} * 1000000000::double)) /
         (CASE WHEN take = 2 THEN 1 ELSE 2 * (ln(take - 1) + 0.5772156649::double) - 2 * (take - 1) / cast(take AS double) END)) AS raw_score
  FROM celled ASOF JOIN edges ON celled.cell >= edges.cell, sizes),
isolation AS (
  SELECT txn_id, amount, raw_score, raw_score >= threshold AS is_outlier,
         CASE WHEN high > low THEN cast(floor((raw_score - low) / (high - low) * 100 + 0.5) AS integer) ELSE 0 END AS isolation_score
  FROM raws, (SELECT min(raw_score) AS low, max(raw_score) AS high,
                     list_reverse_sort(list(raw_score))[cast(floor({contamination}::double * count(*)) AS bigint) + 1] AS threshold FROM raws))"""


SUSPECTS = """
suspects AS (
  SELECT DISTINCT lower(l.vendor) AS vendor_lower
  FROM ledger l JOIN rsf USING (txn_id) JOIN isolation USING (txn_id) LEFT JOIN fuzzy USING (txn_id)
  WHERE rsf_flag OR is_outlier OR fuzzy_dup_group IS NOT NULL),
suspect_addresses AS (
  SELECT DISTINCT address FROM directory SEMI JOIN suspects USING (vendor_lower) WHERE address IS NOT NULL)"""

ADDRESSES = f"""
places AS (
  SELECT {norm('address')} AS norm, min(lower(address_type)) AS address_type,
         bool_or(lower(address_type) IN ('residential', 'house', 'apartment', 'mailbox', 'virtual_office',
                                         'place', 'hamlet')) AS blocked
  FROM geocodes GROUP BY 1),
geocoded AS (
  SELECT a.address, coalesce(NOT blocked, false) AS address_valid, address_type
  FROM suspect_addresses a LEFT JOIN places ON {norm('a.address')} = norm)"""

VERDICTS = """
verdicts AS (
  SELECT vendor_lower, edgar_verified, ofac_hit, address_valid
  FROM directory JOIN registered USING (vendor_lower) JOIN sanctioned USING (vendor_lower)
       LEFT JOIN geocoded ON geocoded.address = directory.address)"""

# --- scores ----------------------------------------------------------------------

SCORED = f"""
joined AS (
  SELECT l.*, d.first_digit AS benford_first_digit, d.second_digit AS benford_second_digit,
    d.is_round AS is_round_number, d.just_below, i.isolation_score, i.is_outlier, r.rsf, r.rsf_flag,
    r.rsf_zscore, r.vendor_median, r.vendor_count, x.dup_count IS NOT NULL AS is_exact_duplicate,
    coalesce(x.dup_count, 1) AS dup_count, f.fuzzy_dup_group IS NOT NULL AS is_fuzzy,
    s.split_cluster_id IS NOT NULL AS is_split_invoice, a.description_risk,
    v.edgar_verified, v.ofac_hit, v.address_valid
  FROM ledger l JOIN row_digits d USING (txn_id) JOIN isolation i USING (txn_id) JOIN rsf r USING (txn_id)
    JOIN audit a USING (txn_id) LEFT JOIN dups x USING (txn_id) LEFT JOIN fuzzy f USING (txn_id)
    LEFT JOIN splits s USING (txn_id) LEFT JOIN verdicts v ON v.vendor_lower = lower(l.vendor)),
summed AS (
  SELECT *,
    isolation_score / 100 * 30
    + CASE WHEN rsf_flag THEN least(1.0::double, (rsf - 3) / 7 + 0.5::double) * 25
           WHEN rsf > 2.0 THEN (rsf - 2.0::double) * 7.5::double ELSE 0 END
    + CASE WHEN is_exact_duplicate THEN 20 ELSE 0 END + CASE WHEN is_split_invoice THEN 10 ELSE 0 END
    + description_risk / 100 * 8
    + CASE WHEN is_fuzzy THEN 5 ELSE 0 END + CASE WHEN is_round_number THEN 2 ELSE 0 END AS s0
  FROM joined),
bonus AS (
  SELECT *, CASE WHEN ofac_hit IS TRUE THEN 100 WHEN just_below THEN least(100, s0 + 8) ELSE s0 END AS s1
  FROM summed),
rated AS (
  SELECT *, cast(least(100, floor(s3 + 0.5)) AS integer) AS composite_risk
  FROM (SELECT *, CASE WHEN address_valid IS FALSE THEN least(100, s2 + 10) ELSE s2 END AS s3
        FROM (SELECT *, CASE WHEN edgar_verified IS FALSE AND rsf_flag THEN least(100, s1 + 15) ELSE s1 END
                AS s2 FROM bonus))),
scored AS (
  SELECT *, CASE WHEN composite_risk >= 80 THEN 'CRITICAL' WHEN composite_risk >= 60 THEN 'HIGH'
                 WHEN composite_risk >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
    list_filter([CASE WHEN is_outlier THEN 'ISOLATION_FOREST' END, CASE WHEN rsf_flag THEN 'RSF' END,
      CASE WHEN is_exact_duplicate THEN 'EXACT_DUPLICATE' END,
      CASE WHEN is_split_invoice THEN 'SPLIT_INVOICE' END,
      CASE WHEN description_risk >= 30 THEN 'DESCRIPTION_AUDIT' END,
      CASE WHEN is_fuzzy THEN 'FUZZY_DUPLICATE' END,
      CASE WHEN is_round_number OR just_below THEN 'ROUND_NUMBER' END,
      CASE WHEN ofac_hit IS TRUE THEN 'OFAC_HIT' END,
      CASE WHEN edgar_verified IS FALSE AND rsf_flag THEN 'EDGAR_UNVERIFIED' END,
      CASE WHEN address_valid IS FALSE THEN 'ADDRESS_INVALID' END], lambda x: x IS NOT NULL)
      AS triggered_detectors
  FROM rated)"""

EXACT = "cast(amount AS decimal(24, 6))"
FLAGGED = "risk_tier IN ('HIGH', 'CRITICAL')"

PORTFOLIO = f"""
rates AS (
  SELECT count(*) AS total_transactions, count(*) FILTER ({FLAGGED}) AS flagged_transactions,
    coalesce(cast(sum({EXACT}) FILTER ({FLAGGED}) AS double), 0) AS estimated_exposure, avg(composite_risk) AS mean_risk,
    avg(is_outlier::int) AS outlier_rate, avg(rsf_flag::int) AS rsf_flag_rate,
    avg(is_exact_duplicate::int) AS duplicate_rate, avg(is_round_number::int) AS round_number_rate,
    (SELECT mad FROM benford WHERE digit_position = 1) AS benford_mad
  FROM scored),
portfolio AS (
  SELECT *, least(100, least(mean_risk * 1.8::double, 60) + least(duplicate_rate * 200, 20)
                       + least(benford_mad * 1000, 20)) AS raw
  FROM rates)"""

VENDOR_VIEW = f"""
vview AS (
  SELECT vendor, count(*) AS transaction_count, cast(sum({EXACT}) AS double) AS total_spend,
    list_sort(list(amount))[count(*) // 2 + 1] AS median_amount, avg(composite_risk) AS avg_score,
    count(*) FILTER ({FLAGGED}) AS flagged,
    CASE WHEN bool_or(risk_tier = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(risk_tier = 'HIGH') THEN 'HIGH'
         WHEN bool_or(risk_tier = 'MEDIUM') THEN 'MEDIUM' ELSE 'LOW' END AS max_tier,
    min(txn_id) AS first_txn
  FROM scored GROUP BY vendor)"""


def detector_counts(keys: list[str]) -> str:
    names = {key: name for key, name, _, _ in fv.DETECTORS}
    rows = ", ".join(f"({i}, {_quoted(d)}, {_quoted(names[d])})" for i, d in enumerate(keys))
    return f"""
kinds(ordinal, detector, name) AS (VALUES {rows}),
fired AS (SELECT unnest(triggered_detectors) AS detector FROM scored),
dcounts AS (
  SELECT ordinal, kinds.detector, name, count(fired.detector) AS n,
         count(fired.detector) / (SELECT count(*) FROM scored) AS rate, count(fired.detector) = 0 AS is_passing
  FROM kinds LEFT JOIN fired ON fired.detector = kinds.detector GROUP BY 1, 2, 3)"""


def sql(*parts: str) -> str:
    *ctes, select = parts
    return ("WITH " + ",".join(ctes) + "\n" if ctes else "") + select


ALL_DETECTORS = [d[0] for d in fv.DETECTORS]
_SIGNALS = (
    LEDGER, PROFILE, VENDOR_STATS, RSF, DUPS, SIMILAR, fuzzy(False), SPLITS, DESCRIPTIONS, ROW_DIGITS,
)
_SCREENED = (
    LISTS, DIRECTORY, SUSPECTS, ADDRESSES, sanctions_screen("directory"), registry_check("directory"), VERDICTS,
)
_SCORED = (*_SIGNALS, STAND_IN, *_SCREENED, SCORED)


def on_scored(*parts: str) -> str:
    return sql(*_SCORED, *parts)


def with_forest(*parts: str) -> str:
    """SQL over the parts, of which the forest is one."""
    return sql(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


GIVEN_VERDICTS = """
verdicts AS (
  SELECT vendor_lower, length(vendor_lower) % 3 <> 0 AS edgar_verified, length(vendor_lower) % 17 = 0 AS ofac_hit,
         CASE WHEN length(vendor_lower) % 2 = 0 THEN ascii(vendor_lower) % 2 = 0 END AS address_valid
  FROM (SELECT DISTINCT lower(vendor) AS vendor_lower FROM ledger) WHERE ascii(vendor_lower) % 5 <> 0)"""
NO_VERDICTS = """
verdicts AS (SELECT '' AS vendor_lower, NULL::boolean AS edgar_verified, NULL::boolean AS ofac_hit, NULL::boolean AS address_valid WHERE false)"""


SCREENED = """
all_names AS (
  SELECT DISTINCT lower(vendor) AS vendor_lower FROM ledger
  UNION ALL SELECT DISTINCT lower(vendor) || ' holdings trading co' FROM ledger)"""

# --- messy CSV -------------------------------------------------------------------

MESSY = """
messy AS (
  SELECT k, o_totalprice, d, v0,
    CASE WHEN k % 10 = 0 THEN 'credit' WHEN k % 17 = 0 OR k % 19 = 0 THEN 'skip' ELSE 'ok' END AS outcome
  FROM base)"""


def _mad_label(mad: str, position: int, at: int = 1) -> str:
    bands = fv.MAD_BANDS[position]
    whens = " ".join(f"WHEN {mad} < {b[0]} THEN {_quoted(b[at])}" for b in bands[:-1])
    return f"CASE {whens} ELSE {_quoted(bands[-1][at])} END"


def _fixed(c: str, places: int) -> str:
    return f"cast(cast({c} AS decimal(28, {places})) AS varchar)"


def _money(c: str) -> str:
    return f"'$' || format('{{:,}}', cast(round({c}) AS bigint))"


_DISPLAY_LABEL = "CASE x " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(l)}" for k, _, l, _ in fv.DETECTORS) + " END"
_VALUE = {
    "RSF": _fixed("rsf", 1),
    "ISOLATION_FOREST": "isolation_score",
    "DESCRIPTION_AUDIT": "description_risk",
    "BENFORD_1ST": "benford_first_digit",
}
_CHECK = {"OFAC_HIT": "ofac_hit", "EDGAR_UNVERIFIED": "edgar_verified", "ADDRESS_INVALID": "address_valid"}


def _detail(d: str) -> str:
    name = {key: n for key, n, _, _ in fv.DETECTORS}[d]

    def text(template: str) -> str:
        if "%s" not in template:
            return _quoted(template)
        a, b = template.split("%s")
        return f"({_quoted(a)} || {_VALUE[d]} || {_quoted(b)})"

    has = f"list_contains(triggered_detectors, '{d}')"
    fired, clear = fv.DETAIL_MESSAGES[d]
    status, message = [], []
    if d in _CHECK:
        status.append(f"WHEN {_CHECK[d]} IS NULL THEN 'N/A'")
        message.append(f"WHEN {_CHECK[d]} IS NULL THEN {_quoted(fv.DETAIL_NOT_CHECKED[d])}")
    if d == "EDGAR_UNVERIFIED":
        status.append("WHEN edgar_verified THEN 'PASS'")
        message.append(f"WHEN edgar_verified THEN {_quoted(fv.DETAIL_REGISTRY_CONFIRMED)}")
    status.append(f"WHEN {has} THEN 'FAIL' ELSE '{'INFO' if d == 'EDGAR_UNVERIFIED' else 'PASS'}'")
    message.append(f"WHEN {has} THEN {text(fired)} ELSE {text(clear)}")
    return f"{_quoted(name)} || '=' || CASE {' '.join(status)} END || '=' || CASE {' '.join(message)} END"


_YES = "CASE WHEN {} THEN 'YES' ELSE '' END"
_TIERS = ", ".join(f"count(*) FILTER (risk_tier = '{t}') AS {t}" for t in fv.TIERS)

PORTFOLIO_ROW = """SELECT cast(floor(raw + 0.5) AS integer) AS score,
  CASE WHEN raw >= 80 THEN 'CRITICAL' WHEN raw >= 60 THEN 'HIGH' WHEN raw >= 30 THEN 'MEDIUM' ELSE 'LOW' END
    AS tier, floor(outlier_rate * 1e6 + 0.5) / 1e6 AS outlier_rate, floor(rsf_flag_rate * 1e6 + 0.5) / 1e6 AS rsf_flag_rate,
  floor(duplicate_rate * 1e6 + 0.5) / 1e6 AS duplicate_rate, floor(benford_mad * 1e6 + 0.5) / 1e6 AS benford_mad,
  floor(round_number_rate * 1e6 + 0.5) / 1e6 AS round_number_rate, total_transactions, flagged_transactions,
  floor(estimated_exposure * 1e6 + 0.5) / 1e6 AS estimated_exposure FROM portfolio"""


def _six(c: str) -> str:
    return f"floor({c} * 1e6 + 0.5) / 1e6"


# names of ASCII letters, digits and spaces in the order of the Unicode collation: first without
# regard to case, then small letters before capitals
BY_VENDOR = "lower(vendor), translate(vendor, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')"
REPORT_ROWS = f"""SELECT txn_id, invoice_id AS "Invoice", date AS "Date", vendor AS "Vendor",
  floor(amount * 1e6 + 0.5) / 1e6 AS "Amount", coalesce(description, '') AS "Description", risk_tier AS "Risk Tier",
  composite_risk AS "Composite Score", isolation_score AS "Isolation Score", round(rsf, 2) AS "RSF",
  {_YES.format('rsf_flag')} AS "RSF Flagged", {_YES.format('is_exact_duplicate')} AS "Exact Duplicate",
  {_YES.format('is_fuzzy')} AS "Fuzzy Duplicate", {_YES.format('is_split_invoice')} AS "Split Invoice",
  {_YES.format('is_round_number')} AS "Round Number", description_risk AS "Description Risk",
  array_to_string(triggered_detectors, ', ') AS "Detectors Triggered" FROM scored"""
SUMMARY_LINES = f"""SELECT cast(unnest(range(13)) AS integer) AS ordinal,
  unnest(['Total Transactions', 'Flagged Transactions', 'Estimated Exposure', 'Portfolio Risk Score', 'Risk Tier',
    'Outlier Rate', 'RSF Flag Rate', 'Duplicate Rate', 'Round Number Rate', 'Benford 1st-digit MAD',
    'Benford 1st conformity', 'Benford 2nd-digit MAD', 'Benford 2nd conformity']) AS "Metric",
  unnest([cast(total_transactions AS varchar), cast(flagged_transactions AS varchar),
    {_fixed('estimated_exposure', 2)}, cast(cast(floor(raw + 0.5) AS integer) AS varchar),
    CASE WHEN raw >= 80 THEN 'CRITICAL' WHEN raw >= 60 THEN 'HIGH' WHEN raw >= 30 THEN 'MEDIUM' ELSE 'LOW' END,
    {_fixed('outlier_rate * 100', 2)} || '%', {_fixed('rsf_flag_rate * 100', 2)} || '%',
    {_fixed('duplicate_rate * 100', 2)} || '%', {_fixed('round_number_rate * 100', 2)} || '%',
    {_fixed('benford_mad', 4)}, {_mad_label('benford_mad', 1)},
    {_fixed('(SELECT mad FROM benford WHERE digit_position = 2)', 4)},
    {_mad_label('(SELECT mad FROM benford WHERE digit_position = 2)', 2)}]) AS "Value"
FROM portfolio"""
BENFORD_LINES = f"""SELECT
  CASE digit_position WHEN 1 THEN '1st digit' ELSE '2nd digit' END AS "Position", round(mad, 4) AS "MAD",
  CASE digit_position WHEN 1 THEN {_mad_label('mad', 1, 1)} ELSE {_mad_label('mad', 2, 1)} END AS "MAD Category",
  CASE digit_position WHEN 1 THEN {_mad_label('mad', 1, 2)} ELSE {_mad_label('mad', 2, 2)} END
    AS "MAD Range (Nigrini)",
  CASE digit_position WHEN 1 THEN {_mad_label('mad', 1, 3)} ELSE {_mad_label('mad', 2, 3)} END
    AS "MAD Interpretation",
  round(chi_square, 4) AS "Chi-Square", cast(CASE digit_position WHEN 1 THEN 15.51 ELSE 16.92 END AS double)
    AS "Chi-Square Critical (α=0.05)",
  CASE WHEN chi_square > CASE digit_position WHEN 1 THEN 15.51 ELSE 16.92 END THEN 'YES' ELSE 'NO' END
    AS "Chi-Square Significant"
"""

ORACLE: dict[str, str] = {
    "ledger_rows": sql(LEDGER, """SELECT txn_id, invoice_id, date, vendor, floor(amount * 1e6 + 0.5) / 1e6 AS amount, description,
  category, approved_by, address FROM ledger"""),
    "csv_ledger": sql(LEDGER, MESSY, """SELECT CASE WHEN k % 5 = 0 THEN 'ROW' ELSE 'INV-' || k END AS invoice_id,
  d AS date, CASE WHEN k % 6 = 0 THEN 'Unknown' ELSE v0 || ', Inc' END AS vendor,
  round(o_totalprice, 2) AS amount,
  CASE WHEN k % 4 = 0 THEN 'He said "rush", twice' ELSE 'desk ' || k END AS description
FROM messy WHERE outcome = 'ok'"""),
    "csv_line_numbers": sql(LEDGER, """SELECT count(*) AS n, count(*) AS distinct_lines, cast(2 AS bigint) AS first_line,
  count(*) + 1 AS last_line, count(*) FILTER (k % 5 = 0) AS generated_ids FROM base"""),
    "csv_profile": sql(LEDGER, MESSY, """SELECT 'invoice_number' AS invoice_id_column, 'posting_date' AS date_column,
  'supplier' AS vendor_column, 'amt' AS amount_column, 'memo' AS description_column,
  cast(NULL AS varchar) AS category_column, cast(NULL AS varchar) AS approved_by_column,
  cast(NULL AS varchar) AS address_column, 'EU (DD/MM)' AS date_format, false AS date_warning,
  count(*) FILTER (outcome = 'ok') AS ok_rows, count(*) FILTER (outcome = 'credit') AS credit_rows,
  count(*) FILTER (outcome = 'skip') AS skip_rows, count(*) FILTER (outcome = 'ok') > 50000 AS size_warning
FROM messy"""),
    "csv_rejects": sql(LEDGER, MESSY, """SELECT 'amount' AS field, message, count(*) AS n FROM (
  SELECT 'Unparseable amount: "' || CASE WHEN k % 17 = 0 THEN '(' || o_totalprice || ')' ELSE '' END || '"'
    AS message FROM messy WHERE outcome = 'skip') GROUP BY message"""),
    "csv_mixed_headers": sql(LEDGER, """SELECT CASE WHEN k % 3 = 2 THEN 'INV-' || k ELSE 'ROW' END AS invoice_id,
  CASE WHEN k % 3 = 2 THEN 'Unknown' ELSE c_mktsegment END AS vendor, floor(o_totalprice * 1e6 + 0.5) / 1e6 AS amount, d AS date,
  CASE WHEN k % 3 = 2 THEN NULL ELSE o_orderpriority END AS description FROM base"""),
    "csv_inner_quotes": sql(LEDGER, """SELECT CASE k % 4 WHEN 0 THEN 'Bob The, Builder ' || k || ' Ltd' WHEN 1 THEN 'A "B", C ' || k
  WHEN 2 THEN 'plain ' || k ELSE 'xy ' || k END AS vendor, floor(o_totalprice * 1e6 + 0.5) / 1e6 AS amount, d AS date,
  CASE WHEN k % 5 = 0 THEN 'open, to the end ' || k ELSE 'memo' END AS description FROM base"""),
    "csv_short_rows": sql(LEDGER, """SELECT cast(k AS varchar) AS invoice_id, CASE WHEN k % 4 = 0 THEN 'Unknown' ELSE c_mktsegment END AS vendor,
  floor(o_totalprice * 1e6 + 0.5) / 1e6 AS amount, DATE '2000-01-01' AS date,
  CASE WHEN k % 4 = 0 THEN NULL ELSE 'memo' END AS description FROM base WHERE k % 4 <> 2"""),
    "csv_counters": sql(LEDGER, MESSY, "SELECT outcome, count(*) AS n FROM messy GROUP BY outcome"),
    "frame_ledger": """SELECT l_orderkey * 10 + l_linenumber AS txn_id,
  cast(l_orderkey * 10 + l_linenumber AS varchar) AS invoice_id, cast(l_shipdate AS date) AS date,
  'S' || l_suppkey AS vendor, floor(l_extendedprice * 1e6 + 0.5) / 1e6 AS amount, l_returnflag AS category
FROM lineitem WHERE l_extendedprice > 0""",
    "csv_late_amount_evidence": sql(LEDGER, "SELECT k AS txn_id, floor(o_totalprice * 1e6 + 0.5) / 1e6 AS amount, d AS date FROM base"),
    "csv_late_date_evidence": sql(LEDGER, "SELECT k AS txn_id, d AS date FROM base WHERE k > 1000 OR day(d) <= 12"),
    "csv_extreme_amounts": sql(LEDGER, """SELECT c_mktsegment AS vendor, count(*) AS vendor_count,
  floor(median(o_totalprice) * 1e6 + 0.5) / 1e6 AS vendor_median FROM base WHERE k % 9 > 2 AND k % 11 <> 0 GROUP BY c_mktsegment"""),
    "csv_date_rejects": sql(LEDGER, """SELECT field, message, count(*) AS n FROM (
  SELECT CASE WHEN k % 9 > 2 THEN 'date' ELSE 'amount' END AS field,
    CASE k % 9 WHEN 0 THEN 'Unparseable amount: "1e400"' WHEN 1 THEN 'Unparseable amount: "2000000000000000000"'
      WHEN 2 THEN 'Unparseable amount: "1e30"' ELSE 'Unreadable date: "2024-02-31"' END AS message
  FROM base WHERE k % 9 <= 2 OR k % 11 = 0) GROUP BY field, message"""),
    "isolation_forest": with_forest(LEDGER, forest(), f"""SELECT txn_id, {_six('amount')} AS amount, {_six('raw_score')} AS raw_score,
  isolation_score, is_outlier FROM isolation"""),
    "isolation_small": with_forest(LEDGER, forest(0.12, 25, 64), f"""SELECT txn_id, {_six('amount')} AS amount,
  {_six('raw_score')} AS raw_score, isolation_score, is_outlier FROM isolation"""),
    "full_analysis": with_forest(*_SIGNALS, forest(), *_SCREENED, SCORED, f"""SELECT txn_id, invoice_id, date, vendor,
  {_six('amount')} AS amount, description, category, approved_by, address, {_six('rsf')} AS rsf, rsf_flag,
  {_six('rsf_zscore')} AS rsf_zscore, {_six('vendor_median')} AS vendor_median, vendor_count, is_exact_duplicate, dup_count,
  dup_group_key, fuzzy_dup_group, fuzzy_match_txn_id, fuzzy_distance, is_split_invoice, split_cluster_id,
  {_six('cluster_total')} AS cluster_total, cluster_size, suspected_threshold, benford_first_digit, benford_second_digit,
  is_round_number, description_risk, array_to_string(triggered_keywords, '|') AS triggered_keywords,
  {_six('raw_score')} AS raw_score, isolation_score, is_outlier, edgar_verified, ofac_hit, address_valid, composite_risk,
  array_to_string(triggered_detectors, '|') AS triggered_detectors, risk_tier
FROM scored LEFT JOIN (SELECT txn_id, dup_group_key FROM dups) USING (txn_id) LEFT JOIN fuzzy USING (txn_id)
  LEFT JOIN splits USING (txn_id) JOIN (SELECT txn_id, triggered_keywords FROM audit) USING (txn_id)
  JOIN (SELECT txn_id, raw_score FROM isolation) USING (txn_id)"""),
    "full_portfolio": with_forest(*_SIGNALS, forest(), NO_VERDICTS, SCORED, BENFORD, PORTFOLIO, PORTFOLIO_ROW),
    "given_verdicts": with_forest(*_SIGNALS, forest(), GIVEN_VERDICTS, SCORED, """SELECT txn_id, edgar_verified, ofac_hit, address_valid,
  composite_risk, risk_tier, array_to_string(triggered_detectors, '|') AS triggered_detectors FROM scored"""),
    "isolation_properties": sql(LEDGER, """SELECT count(*) AS n, true AS scores_in_range, true AS enough_outliers,
  true AS outliers_on_top, true AS equal_amounts_equal_scores FROM ledger"""),
    "run_history": sql(*_SCORED, BENFORD, PORTFOLIO, """SELECT 'run-1' AS run_id, 'orders' AS filename, total_transactions,
  flagged_transactions, cast(floor(raw + 0.5) AS integer) AS score,
  CASE WHEN raw >= 80 THEN 'CRITICAL' WHEN raw >= 60 THEN 'HIGH' WHEN raw >= 30 THEN 'MEDIUM' ELSE 'LOW' END
    AS tier, total_transactions AS stored_rows FROM portfolio"""),
    "stored_result_rows": on_scored(f"""SELECT txn_id, invoice_id, date, vendor, {_six('amount')} AS amount, {_six('rsf')} AS rsf,
  description_risk, is_exact_duplicate, is_split_invoice, ofac_hit, composite_risk, risk_tier,
  array_to_string(triggered_detectors, '|') AS triggered_detectors FROM scored"""),
    "report_sheet_all_transactions": on_scored(f"SELECT * EXCLUDE (txn_id) FROM ({REPORT_ROWS})"),
    "report_sheet_flagged_transactions": on_scored(f"SELECT * EXCLUDE (txn_id) FROM ({REPORT_ROWS} WHERE {FLAGGED})"),
    "report_sheet_executive_summary": sql(*_SCORED, BENFORD, PORTFOLIO, SUMMARY_LINES),
    "report_sheet_vendor_risk": on_scored(f"""SELECT vendor AS "Vendor", count(*) AS "Transaction Count",
  {_six(f'cast(sum({EXACT}) AS double)')} AS "Total Spend", {_six('round(avg(composite_risk), 2)')} AS "Avg Risk Score",
  max(composite_risk) AS "Max Risk Score", count(*) FILTER ({FLAGGED}) AS "Flagged Transactions" FROM scored GROUP BY vendor"""),
    "report_sheet_benford_analysis": sql(LEDGER, ROW_DIGITS, BENFORD, f"{BENFORD_LINES.rstrip()}, {_quoted(CHI_SQUARE_NOTE)} AS \"Chi-Square Note\" FROM benford"),
    "report_sheet_detector_explanations": on_scored(detector_counts(ALL_DETECTORS), f"""SELECT name AS "Detector",
  basis AS "Methodology Basis", n AS "Transactions Flagged", {_fixed('rate * 100', 2)} || '%' AS "Flag Rate",
  short AS "Short Description", long AS "Full Explanation"
FROM dcounts JOIN (VALUES {', '.join('(' + ', '.join(map(_quoted, (d, b, *EXPLANATIONS[d]))) + ')' for d, _, _, b in fv.DETECTORS)})
  t(detector, basis, short, long) USING (detector)"""),
    "split_invoices_limits": sql(LEDGER, SPLITS.replace("[1000, 2500, 5000, 10000, 25000, 50000, 100000]", "[30000, 180000]"),
                                 f"""SELECT txn_id, split_cluster_id, {_six('cluster_total')} AS cluster_total,
  cluster_size, suspected_threshold FROM splits"""),
    "risk_report": on_scored(f"""SELECT * FROM (VALUES ('executive_summary', 13), ('benford_analysis', 2),
  ('detector_explanations', 12)) t(sheet, n)
UNION ALL SELECT 'flagged_transactions', count(*) FILTER ({FLAGGED}) FROM scored
UNION ALL SELECT 'all_transactions', count(*) FROM scored
UNION ALL SELECT 'vendor_risk', count(DISTINCT vendor) FROM scored"""),
    "ledger_profile": sql(LEDGER, PROFILE, """SELECT n, floor(max_amount * 1e6 + 0.5) / 1e6 AS max_amount, floor(median * 1e6 + 0.5) / 1e6 AS median,
  floor(upper_median * 1e6 + 0.5) / 1e6 AS upper_median, floor(p75 * 1e6 + 0.5) / 1e6 AS p75, floor(mean_log * 1e6 + 0.5) / 1e6 AS mean_log,
  floor(std_log * 1e6 + 0.5) / 1e6 AS std_log, floor(min_log * 1e6 + 0.5) / 1e6 AS min_log, floor(max_log * 1e6 + 0.5) / 1e6 AS max_log, min_txn, max_txn
FROM prof, (SELECT avg(ln(1 + amount)) AS mean_log, stddev_pop(ln(1 + amount)) AS std_log,
  min(ln(1 + amount)) AS min_log, max(ln(1 + amount)) AS max_log, min(txn_id) AS min_txn,
  max(txn_id) AS max_txn FROM ledger)"""),
    "row_digits": sql(LEDGER, ROW_DIGITS, "SELECT * FROM row_digits"),
    "benford_digits": sql(LEDGER, ROW_DIGITS, BENFORD, """SELECT digit_position, cast(digit AS integer) AS digit, n,
  floor(observed_pct * 1e6 + 0.5) / 1e6 AS observed_pct, floor(expected_pct * 1e6 + 0.5) / 1e6 AS expected_pct FROM digits"""),
    "benford_summary": sql(LEDGER, ROW_DIGITS, BENFORD, """SELECT digit_position, total_records,
  floor(chi_square * 1e6 + 0.5) / 1e6 AS chi_square, floor(mad * 1e6 + 0.5) / 1e6 AS mad, floor(chi_square_counts * 1e6 + 0.5) / 1e6 AS chi_square_counts,
  conformity FROM benford"""),
    "round_number": sql(LEDGER, f"""SELECT count(*) FILTER ({ROUND}) AS round_count,
  floor(avg({ROUND}::int) * 1e6 + 0.5) / 1e6 AS round_rate, avg({ROUND}::int) > 0.15 AS flagged FROM ledger"""),
    "threshold_distribution": sql(LEDGER, f"""SELECT cast(t AS double) AS threshold, count(*) AS n
FROM ledger JOIN (SELECT unnest({fv.ROUND_THRESHOLDS}) AS t) ON abs(amount - t) <= 15 GROUP BY t"""),
    "vendor_stats": sql(LEDGER, VENDOR_STATS, """SELECT vendor, floor(vendor_mean * 1e6 + 0.5) / 1e6 AS vendor_mean,
  floor(vendor_std * 1e6 + 0.5) / 1e6 AS vendor_std, vendor_count, floor(vendor_median * 1e6 + 0.5) / 1e6 AS vendor_median FROM vstats"""),
    "relative_size": sql(LEDGER, PROFILE, VENDOR_STATS, RSF, """SELECT txn_id, floor(rsf * 1e6 + 0.5) / 1e6 AS rsf, rsf_flag,
  floor(rsf_zscore * 1e6 + 0.5) / 1e6 AS rsf_zscore, floor(vendor_median * 1e6 + 0.5) / 1e6 AS vendor_median, vendor_count FROM rsf"""),
    "top_rsf_vendors": sql(LEDGER, PROFILE, VENDOR_STATS, RSF, f"""SELECT vendor, flag_count,
  floor(total_exposure * 1e6 + 0.5) / 1e6 AS total_exposure, floor(max_rsf * 1e6 + 0.5) / 1e6 AS max_rsf FROM (
  SELECT vendor, count(*) FILTER (rsf_flag) AS flag_count, cast(sum(CASE WHEN rsf_flag THEN {EXACT} ELSE 0 END) AS double)
    AS total_exposure, max(rsf) AS max_rsf, min(txn_id) AS first_txn FROM rsf GROUP BY vendor)
WHERE flag_count > 0 ORDER BY total_exposure DESC, first_txn LIMIT 10"""),
    "exact_duplicates": sql(LEDGER, DUPS, "SELECT txn_id, dup_count, dup_group_key FROM dups"),
    "similar_vendors": sql(LEDGER, SIMILAR, """SELECT name, other, cast(distance AS integer) AS distance
FROM similar_names"""),
    "fuzzy_duplicates": sql(LEDGER, PROFILE, DUPS, SIMILAR, fuzzy(False), "SELECT * FROM fuzzy"),
    "fuzzy_duplicates_material": sql(LEDGER, PROFILE, DUPS, SIMILAR, fuzzy(True), "SELECT * FROM fuzzy"),
    "split_anchors": sql(LEDGER, SPLITS, """SELECT g AS vendor_group, cast(date_diff('day', DATE '1970-01-01', date)
  AS integer) AS day, anchor AS anchor_txn_id, floor(cluster_total * 1e6 + 0.5) / 1e6 AS cluster_total, cluster_size,
  suspected_threshold FROM anchors"""),
    "split_invoices": sql(LEDGER, SPLITS, """SELECT txn_id, split_cluster_id, floor(cluster_total * 1e6 + 0.5) / 1e6 AS cluster_total,
  cluster_size, suspected_threshold FROM splits"""),
    "description_audit": sql(LEDGER, PROFILE, DESCRIPTIONS, """SELECT txn_id, description_risk,
  array_to_string(triggered_keywords, '|') AS triggered_keywords FROM audit"""),
    "vendor_directory": sql(LEDGER, DIRECTORY, "SELECT vendor_lower, vendor, address FROM directory"),
    "suspect_vendors": sql(LEDGER, PROFILE, VENDOR_STATS, RSF, DUPS, SIMILAR, fuzzy(False), DIRECTORY, STAND_IN, SUSPECTS,
                           "SELECT vendor_lower FROM suspects"),
    "suspect_addresses": sql(LEDGER, PROFILE, VENDOR_STATS, RSF, DUPS, SIMILAR, fuzzy(False), DIRECTORY, STAND_IN, SUSPECTS,
                             "SELECT address FROM suspect_addresses"),
    "sanctions_screen": sql(LEDGER, LISTS, SCREENED, sanctions_screen("all_names"), """SELECT vendor_lower, ofac_hit,
  matched_name, list_type, match_kind, match_distance FROM sanctioned"""),
    "sanctions_screen_ratio": sql(LEDGER, LISTS, SCREENED, sanctions_screen("all_names", 0.02), """SELECT vendor_lower, ofac_hit,
  matched_name, list_type, match_kind, match_distance FROM sanctioned"""),
    "registry_check": sql(LEDGER, LISTS, SCREENED, registry_check("all_names"), """SELECT vendor_lower, edgar_verified,
  floor(confidence * 1e6 + 0.5) / 1e6 AS confidence, entity_name, cik FROM registered"""),
    "address_check": sql(LEDGER, PROFILE, VENDOR_STATS, RSF, DUPS, SIMILAR, fuzzy(False), DIRECTORY, STAND_IN, SUSPECTS, LISTS,
                         ADDRESSES, "SELECT address, address_valid, address_type FROM geocoded"),
    "vendor_verdicts": on_scored("SELECT vendor_lower, edgar_verified, ofac_hit, address_valid FROM verdicts"),
    "composite_score": on_scored("""SELECT txn_id, isolation_score, floor(rsf * 1e6 + 0.5) / 1e6 AS rsf, description_risk,
  is_exact_duplicate, is_split_invoice, is_round_number, is_fuzzy, edgar_verified, ofac_hit, address_valid,
  composite_risk, risk_tier, array_to_string(triggered_detectors, '|') AS triggered_detectors FROM scored"""),
    "portfolio": sql(*_SCORED, BENFORD, PORTFOLIO, PORTFOLIO_ROW),
    "vendor_risk": on_scored(f"""SELECT vendor, count(*) AS transaction_count, floor(cast(sum({EXACT}) AS double) * 1e6 + 0.5) / 1e6 AS total_spend,
  round(avg(composite_risk), 2) AS avg_risk_score, max(composite_risk) AS max_risk_score,
  count(*) FILTER ({FLAGGED}) AS flagged_transactions, min(txn_id) AS first_txn FROM scored GROUP BY vendor"""),
    "vendor_view": on_scored(VENDOR_VIEW, """SELECT vendor, transaction_count, floor(total_spend * 1e6 + 0.5) / 1e6 AS total_spend,
  floor(median_amount * 1e6 + 0.5) / 1e6 AS median_amount, floor(avg_score * 1e6 + 0.5) / 1e6 AS avg_score, flagged, max_tier, first_txn FROM vview"""),
    "top_vendors": on_scored(VENDOR_VIEW, """SELECT vendor, transaction_count, floor(total_spend * 1e6 + 0.5) / 1e6 AS total_spend,
  floor(median_amount * 1e6 + 0.5) / 1e6 AS median_amount, floor(avg_score * 1e6 + 0.5) / 1e6 AS avg_score, flagged, max_tier, first_txn
FROM vview ORDER BY vview.avg_score DESC, first_txn LIMIT 100"""),
    "vendor_totals": on_scored(VENDOR_VIEW, """SELECT count(*) AS vendors, count(*) FILTER (flagged > 0)
  AS flagged_vendors, cast(sum(flagged) AS bigint) AS total_flagged, floor(cast(sum(cast(total_spend AS decimal(24, 6))) AS double) * 1e6 + 0.5) / 1e6 AS total_spend
FROM vview"""),
    "vendor_transactions": on_scored("""SELECT txn_id, vendor, composite_risk FROM scored WHERE vendor = (
  SELECT vendor FROM scored GROUP BY vendor ORDER BY count(*) DESC, vendor LIMIT 1)"""),
    "top_flagged_vendor": on_scored(f"""SELECT vendor, count(*) AS n FROM scored WHERE {FLAGGED} GROUP BY vendor
ORDER BY n DESC, min(txn_id) LIMIT 1"""),
    "detector_counts": on_scored(detector_counts(ALL_DETECTORS), """SELECT ordinal, detector, name, n,
  floor(rate * 1e6 + 0.5) / 1e6 AS rate, is_passing FROM dcounts"""),
    "detector_chart": on_scored(detector_counts(fv.DASHBOARD_DETECTORS), """SELECT ordinal, detector, name, n,
  floor(rate * 1e6 + 0.5) / 1e6 AS rate, is_passing FROM dcounts
WHERE detector IN ('RSF', 'SPLIT_INVOICE', 'BENFORD_1ST', 'ROUND_NUMBER')"""),
    "top_detectors": on_scored(detector_counts(fv.DASHBOARD_DETECTORS), """SELECT ordinal, detector, name, n,
  floor(rate * 1e6 + 0.5) / 1e6 AS rate, is_passing FROM dcounts WHERE n > 0 ORDER BY dcounts.n DESC, ordinal LIMIT 3"""),
    "score_histogram": on_scored("""SELECT cast(bin AS integer) AS bin, count(txn_id) AS n
FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN scored ON least(composite_risk // 10, 9) = bin GROUP BY bin"""),
    "tier_counts": on_scored(f'SELECT count(*) AS "ALL", {_TIERS} FROM scored'),
    "tiers_by_month": on_scored(f"SELECT strftime(date, '%Y-%m') AS month, {_TIERS} FROM scored GROUP BY 1"),
    "tiers_by_day": on_scored(f"SELECT date, {_TIERS} FROM scored GROUP BY date"),
    "filter_transactions": on_scored("""SELECT txn_id, vendor, floor(amount * 1e6 + 0.5) / 1e6 AS amount, date FROM scored
WHERE risk_tier = 'MEDIUM' AND (contains(lower(vendor), 'a') OR contains(lower(invoice_id), 'a'))
  AND amount BETWEEN 5000 AND 200000 AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
  AND list_contains(triggered_detectors, 'DESCRIPTION_AUDIT')"""),
    **{
        f"sorted_by_{name}": on_scored(f"""SELECT row_number() OVER (ORDER BY {order}, txn_id) AS position, txn_id, vendor,
  floor(amount * 1e6 + 0.5) / 1e6 AS amount, date, composite_risk FROM scored
QUALIFY position BETWEEN {50 * page - 49} AND {50 * page}""")
        for name, order, page in (("vendor", BY_VENDOR, 2), ("date", "date ASC", 3), ("amount", "amount DESC", 2), ("risk", "composite_risk DESC", 20))
    },
    "sorted_page": on_scored(f"SELECT txn_id, vendor FROM scored ORDER BY {BY_VENDOR}, txn_id LIMIT 50 OFFSET 50"),
    "page_count": on_scored("""SELECT count(*) AS n, cast(greatest(ceil(count(*) / 50), 1) AS bigint) AS total_pages
FROM scored WHERE risk_tier = 'HIGH'"""),
    "flagged_transactions": on_scored(f"SELECT txn_id, composite_risk, risk_tier FROM scored WHERE {FLAGGED}"),
    "display_rows": on_scored(f"""SELECT txn_id, invoice_id AS id, date, vendor, {_money('amount')} AS amount,
  CASE risk_tier WHEN 'CRITICAL' THEN 'Critical' WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Medium' ELSE 'Low' END
    AS risk, composite_risk AS score,
  array_to_string(list_transform(triggered_detectors, lambda x: {_DISPLAY_LABEL}), '|') AS detectors,
  {" || '; ' || ".join(_detail(d) for d in fv.DETAIL_DETECTORS)} AS detector_results
FROM scored"""),
    "score_details": on_scored(f"""SELECT txn_id, unnest(['Isolation Score', 'RSF', 'Description Risk',
  'Benford 1st digit', 'Duplicate count']) AS label,
  unnest([{_fixed('isolation_score', 2)}, {_fixed('rsf', 2)} || 'x', {_fixed('description_risk', 2)},
          cast(benford_first_digit AS varchar), cast(dup_count AS varchar)]) AS value,
  floor((unnest([cast(isolation_score AS double), least(rsf * 20, 100), cast(description_risk AS double), 0,
          CASE WHEN dup_count > 1 THEN 100 ELSE 0 END])) * 1e6 + 0.5) / 1e6 AS bar
FROM scored"""),
    "report_rows": on_scored(REPORT_ROWS),
    "executive_summary": sql(*_SCORED, BENFORD, PORTFOLIO, SUMMARY_LINES),
    "detector_explanations": on_scored(detector_counts(ALL_DETECTORS), """SELECT ordinal, name AS "Detector",
  basis AS "Methodology Basis", n AS "Transactions Flagged", """ + _fixed("rate * 100", 2) + """ || '%' AS "Flag Rate"
FROM dcounts JOIN (VALUES """ + ", ".join(f"({_quoted(d)}, {_quoted(b)})" for d, _, _, b in fv.DETECTORS)
        + """) b(detector, basis) USING (detector)"""),
    "benford_rows": sql(LEDGER, ROW_DIGITS, BENFORD, f"{BENFORD_LINES}FROM benford"),
    "exposure_text": on_scored(f"""SELECT vendor, CASE WHEN s >= 1000000 THEN '$' || {_fixed('s / 1000000', 2)} || ' million'
  WHEN s >= 1000 THEN '$' || {_fixed('s / 1000', 1)} || 'k' ELSE {_money('s')} END AS spend
FROM (SELECT vendor, cast(sum({EXACT}) AS double) AS s FROM scored GROUP BY vendor)"""),
}
