"""The redesigned operators against direct, quadratic definitions on random ledgers."""

import hashlib
import datetime as dt
import math
import random

import pytest
from helpers import by_id
from pyspark.sql import functions as F

from ledger_analytics.config import AnalysisConfig
from ledger_analytics.functions import similarity
from ledger_analytics.operators import fuzzy, order_stats, screening, splits
from ledger_analytics.operators.order_stats import order_statistics, value_counts
from ledger_analytics.operators.profile import profile_ledger

DAY0 = dt.date(2024, 1, 1)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


# --- fuzzy duplicates ---------------------------------------------------------------

NAMES = ["acme", "acne", "acmes", "a cme", "a  cme", " acme", "bolt co", "bolt  co", "bolt-co", "bold co",
         "Zeta", "zetta", "zeta ", "omega", "", "a"]


def random_fuzzy_rows(seed, n=120):
    rng = random.Random(seed)
    return [
        {
            "vendor": rng.choice(NAMES),
            "amount": rng.choice([500.0, 1499.99, 1500, 2500, 3499, 3500, 4500, 5000, 7000, 9999.99]),
            "date": DAY0 + dt.timedelta(days=rng.randrange(2)),
            "txn_id": 3 * i + 1,
        }
        for i in range(n)
    ]


def fuzzy_matches(rows, limit):
    """txn -> {(distance, txn)} of every row it matches."""
    ordered = sorted(r["amount"] for r in rows)
    median = ordered[len(rows) // 2]
    key = lambda r: (r["date"], f"{r['amount']:.2f}", " ".join(r["vendor"].lower().split()))
    band = lambda r: math.floor(r["amount"] / 1000 + 0.5)
    out = {}
    for a in rows:
        for b in rows:
            if a is b or abs(band(a) - band(b)) > 2 or key(a) == key(b):
                continue
            if len(rows) > limit and max(a["amount"], b["amount"]) < median:
                continue
            d = edit_distance(a["vendor"].lower(), b["vendor"].lower())
            if d in (1, 2):
                out.setdefault(a["txn_id"], set()).add((d, b["txn_id"]))
    return out


@pytest.mark.parametrize("seed, limit", [(1, 20_000), (2, 20_000), (3, 50), (4, 50), (5, 50)])
def test_fuzzy(make, seed, limit):
    rows = random_fuzzy_rows(seed)
    df = make(rows).repartition(seed)
    got = by_id(fuzzy.fuzzy_duplicates(df, profile_ledger(df), AnalysisConfig(fuzzy_material_only=limit < len(rows))))
    want = fuzzy_matches(rows, limit)
    assert set(got) == set(want)
    for txn, r in got.items():
        assert r.fuzzy_distance == min(want[txn])[0]
        assert (r.fuzzy_distance, r.fuzzy_match_txn_id) in want[txn]


def test_similar_names(spark):
    rng = random.Random(7)
    names = sorted({"".join(rng.choice("abé ") for _ in range(rng.randrange(0, 8))) for _ in range(150)})
    names += ["000000001", "000000012", "000001000", "x" * 40, "x" * 41, "x" * 43]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = {(r.name, r.other, r.distance) for r in fuzzy.similar_names(df, "v").collect()}
    want = {
        (a, b, edit_distance(a, b)) for a in names for b in names if a != b and edit_distance(a, b) <= 2
    }
    assert got == want


def test_similar_long_names(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SHARED", 6)
    rng = random.Random(3)
    names = set()
    for n in (16, 17, 18, 19, 20, 21, 30, 500):
        for _ in range(4):
            base = "".join(rng.choice("abcdef") for _ in range(n))
            names.add(base)
            for _ in range(6):
                v = list(base)
                for _ in range(rng.randrange(1, 4)):
                    at = rng.randrange(len(v))
                    kind = rng.randrange(3)
                    v[at : at + 1] = [[], [rng.choice("abcxyz")], [v[at], rng.choice("abcxyz")]][kind]
                names.add("".join(v))
    # numbered names, whose first and middle parts all are the same
    names |= {f"international trading company no {i:04d}" for i in range(0, 1500, 37)}
    names = sorted(names)
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = {(r.name, r.other, r.distance) for r in fuzzy.similar_names(df, "v").collect()}
    near = lambda a, b: abs(len(a) - len(b)) <= 2 and (len(a) < 100 or a[:20] == b[:20] or a[-20:] == b[-20:] or a[200:210] in b)
    want = {(a, b, d) for a in names for b in names if a != b and near(a, b) and (d := edit_distance(a, b)) <= 2}
    assert got == want and len(want) > 100
    keys = similarity._segment_keys(df.select(F.xxhash64("v").alias("id"), F.col("v").alias("s"), F.lit(0).alias("side")))
    assert keys.groupBy("id").count().agg(F.max("count")).first()[0] <= 18


# --- split invoices ------------------------------------------------------------------


def split_clusters(rows, thresholds):
    groups = {}
    for r in rows:
        groups.setdefault(r["vendor"].strip().lower(), []).append(r)
    out = {}
    for members in groups.values():
        members.sort(key=lambda r: (r["date"], r["txn_id"]))
        for i, anchor in enumerate(members):
            window = [r for r in members[i:] if (r["date"] - anchor["date"]).days <= 7]
            values = [r["amount"] for r in window]
            if len(window) < 2 or (max(values) - min(values)) / max(values) > 0.15:
                continue
            total = round(sum(values), 6)
            for t in thresholds:
                if max(values) < t <= total <= 3.5 * t:
                    for r in window:
                        out.setdefault(r["txn_id"], (f"SPLIT-{anchor['txn_id']}", total, len(window), t))
                    break
    return out


@pytest.mark.parametrize("seed", range(6))
def test_splits(make, seed, monkeypatch):
    # tiny blocks, so that days are cut into several of them
    monkeypatch.setattr(splits, "_MIN_BLOCK", 5)
    rng = random.Random(seed)
    pool = [[9000, 9500, 9900, 8750, 9333.33], [480, 500, 520, 2400, 2499.99], [4999, 4300, 26_000, 99_000]]
    rows = [
        {
            "vendor": rng.choice(["a", " A", "b", "c "]),
            "amount": rng.choice(pool[rng.randrange(1 + seed % 3)]),
            "date": DAY0 + dt.timedelta(days=int(rng.triangular(0, 40, 3))),
            "txn_id": 2 * i,
        }
        for i in range(30 + 30 * (seed % 3))
    ]
    thresholds = [1000, 2500, 5000, 10000, 25000, 50000, 100000]
    df = make(rows).repartition(1 + seed)
    got = by_id(splits.split_invoices(df, profile_ledger(df)))
    got = {
        i: (r.split_cluster_id, round(r.cluster_total, 6), r.cluster_size, r.suspected_threshold)
        for i, r in got.items()
    }
    assert got == split_clusters(rows, thresholds)


# --- order statistics ----------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 100])
def test_order_statistics(spark, n):
    rng = random.Random(n)
    data = {g: [round(rng.lognormvariate(5, 2), rng.randrange(3)) + 0.01 for _ in range(n)] for g in "xyz"}
    data["tied"] = [7.0] * n
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    ranks = ["median_lo", "median_hi", "p75"]
    got = order_statistics(value_counts(df.repartition(3), ["g"], "v"), ["g"], "v", ranks)
    want = {}
    for g, vs in data.items():
        s = sorted(vs)
        want[g] = (s[(n - 1) // 2], s[n // 2], s[min(int(n * 0.75), n - 1)])
    assert {r.g: (r.median_lo, r.median_hi, r.p75) for r in got.collect()} == want


@pytest.mark.parametrize("few", [1, 100, 10_000])
def test_order_statistics_inside_one_bin(spark, monkeypatch, few):
    monkeypatch.setattr(order_stats, "SORTED", few)
    rng = random.Random(1)
    # all distinct, within a millionth of each other, and close pairs
    data = {"near": [1000 + i * 1e-9 * rng.random() for i in range(900)], "cents": [10_000 + i / 100 for i in range(700)], "two": [5.0, 5.0 + 1e-12]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double").repartition(3)
    got = order_statistics(value_counts(df, ["g"], "v"), ["g"], "v", ["median_lo", "median_hi", "p75"]).collect()
    for r in got:
        s = sorted(data[r.g])
        n = len(s)
        assert (r.median_lo, r.median_hi, r.p75) == (s[(n - 1) // 2], s[n // 2], s[min(int(n * 0.75), n - 1)])
    assert len(got) == 3


# --- screening ------------------------------------------------------------------------


def words(name):
    return "".join(c if c.isalnum() else " " for c in name.lower()).split()


def random_names(seed, n):
    rng = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "delta", "inc", "inc", "inc", "llc", "co", "of", "north"]
    return sorted({" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 7))) for _ in range(n)})


def test_registry(spark):
    vendors, entities = random_names(1, 80), [n.title() + "." for n in random_names(2, 120)]
    v = spark.createDataFrame([(x,) for x in vendors], "vendor_lower string")
    r = spark.createDataFrame([(x, f"C{i}") for i, x in enumerate(entities)], "entity_name string, cik string")
    got = {x.vendor_lower: x for x in screening.registry_verdicts(v, r).collect()}
    assert set(got) == set(vendors)
    for name in vendors:
        a = set(words(name))
        best = max(len(a & set(words(e))) / len(a | set(words(e))) for e in entities)
        assert got[name].edgar_verified == (best >= 0.7)
        assert got[name].confidence == (pytest.approx(best) if best >= 0.7 else None)


def test_sanctions(spark):
    long = " ".join(f"w{i}" for i in range(400))
    vendors = random_names(3, 60) + ["bank melli iran trading co", "bank mely iran", "ab", "xbank melli irany", long, "inc inc inc inc llc"]
    entities = random_names(4, 60) + ["Bank Melli, Iran", "ac", "w7 w8 w9", "w398 w399 w400", "inc inc llc"]
    v = spark.createDataFrame([(x,) for x in vendors], "vendor_lower string")
    s = spark.createDataFrame([(x, "SDN") for x in entities], "entity_name string, list_type string")
    got = {x.vendor_lower: x for x in screening.sanctions_verdicts(v, s).collect()}
    assert len(got) == len(vendors)
    for name in vendors:
        norm = " ".join(words(name))
        kinds = set()
        for e in entities:
            w = " ".join(words(e))
            if norm == w:
                kinds.add("exact")
            elif len(words(e)) >= 3 and f" {w} " in f" {norm} ":
                kinds.add("contains")
            elif edit_distance(norm, w) <= 2:
                kinds.add("fuzzy")
        want = next((k for k in ("exact", "contains", "fuzzy") if k in kinds), None)
        assert (got[name].ofac_hit, got[name].match_kind) == (want is not None, want)


def test_addresses_and_suspects(spark, make):
    geo = spark.createDataFrame(
        [("1 Main St.", "office"), ("2 oak ave", "Residential"), ("3 Elm", "mailbox")],
        "address string, address_type string",
    )
    asked = spark.createDataFrame([("1 main  st",), ("2 Oak Ave",), ("3 Elm",), ("nowhere",)], "address string")
    got = {r.address: r.address_valid for r in screening.address_verdicts(asked, geo).collect()}
    assert got == {"1 main  st": True, "2 Oak Ave": False, "3 Elm": False, "nowhere": False}

    led = make([
        {"vendor": "Acme", "amount": 1, "address": None}, {"vendor": "ACME", "amount": 1, "address": "1 Main St"},
        {"vendor": "acme", "amount": 1, "address": "2 Oak Ave"}, {"vendor": "Other", "amount": 1, "address": "3 Elm"},
    ])
    directory = {r.vendor_lower: (r.vendor, r.address) for r in screening.vendor_directory(led).collect()}
    assert directory == {"acme": ("Acme", "1 Main St"), "other": ("Other", "3 Elm")}
    suspects = spark.createDataFrame([("acme",)], "vendor_lower string")
    verdicts = screening.vendor_verdicts(led, suspects, screening.ScreeningLists(geocodes=geo))
    got = {r.vendor_lower: (r.edgar_verified, r.ofac_hit, r.address_valid) for r in verdicts.collect()}
    assert got == {"acme": (None, None, True), "other": (None, None, None)}


# --- one result for any partitioning --------------------------------------------------


def test_signals_do_not_depend_on_partitions(make):
    from ledger_analytics.plans.pipeline import pair_signals

    rows = random_fuzzy_rows(11, 80)
    base = make(rows)
    results = []
    for n in (1, 4, 17):
        df = base.repartition(n, F.rand(n))
        results.append(sorted(map(str, pair_signals(df, profile_ledger(df)).collect())))
    assert results[0] == results[1] == results[2]


def test_a_key_shared_by_one_side_only_makes_no_variants(spark):
    # three hundred names end alike, and no listed one does: they meet nobody by that part
    names = [(i, f"{hashlib.md5(str(i).encode()).hexdigest()} holdings trading co", 0) for i in range(300)]
    near = [(-1, names[7][1][:-1] + "x", 1), (-2, names[9][1][2:], 1), (-3, "short name", 1)]
    df = spark.createDataFrame([*names, *near, (1000, "short nam", 0)], "id long, s string, side int")
    assert {(r["id"], r["other_id"]) for r in similarity.close_candidates(df).collect()} >= {(7, -1), (9, -2), (1000, -3)}
    alone = spark.createDataFrame([*names, (-3, "a listed name of another kind", 1)], "id long, s string, side int")
    seen = []
    keys = similarity.with_deletion_keys
    similarity.with_deletion_keys = lambda d, column, key: (seen.append(d), keys(d, column, key))[1]
    try:
        assert similarity.close_candidates(alone).count() == 0
    finally:
        similarity.with_deletion_keys = keys
    assert seen[1].count() == 0  # of what lies beside a shared part
