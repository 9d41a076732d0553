"""Fuzzy duplicates: a vendor name one or two edits away, in a nearby amount band.

The distance depends on names only, so names are compared once each, not once
per row. Rows are then tested by what their vendor's neighbours have in reach of
the row's band. That is an aggregate per (vendor, band): no pair of rows is
ever formed, however many rows two similar vendors have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_analytics.config import AnalysisConfig
from ledger_analytics.functions.numeric import amount_cents, js_round
from ledger_analytics.functions.similarity import close_candidates
from ledger_analytics.functions.text import vendor_key, vendor_lower
from ledger_analytics.operators.profile import LedgerProfile
from ledger_analytics.operators.skew import never_broadcast
from ledger_analytics.sources.materialize import materialize

_DISTANCES = (1, 2)
_REACH = 2  # bands


def similar_names(names: DataFrame, column: str) -> DataFrame:
    """(name, other, distance) for every ordered pair of distinct names within distance 2."""
    # Numbers stand in for the names while candidates are looked for: the keys
    # outnumber the names. Stored, so that the numbers stay the same.
    numbered = materialize(
        names.select(F.col(column).alias("name"), F.monotonically_increasing_id().alias("id")), "names"
    )
    candidates = close_candidates(numbered.select("id", F.col("name").alias("s"), F.lit(0).alias("side")))
    half = (
        candidates.join(numbered, "id")
        .join(numbered.select(F.col("id").alias("other_id"), F.col("name").alias("other")), "other_id")
        .withColumn("distance", F.levenshtein("name", "other", max(_DISTANCES)))
        .where(F.col("distance").isin(*_DISTANCES))
    )
    return half.select(
        F.inline(
            F.array(
                F.struct("name", "other", "distance"),
                F.struct(
                    F.col("other").alias("name"), F.col("name").alias("other"), F.col("distance")
                ),
            )
        )
    )


def _rows(ledger: DataFrame, profile: LedgerProfile, config: AnalysisConfig) -> DataFrame:
    amount = F.col("amount")
    return ledger.select(
        "txn_id",
        vendor_lower(F.col("vendor")).alias("name"),
        js_round(amount / config.fuzzy_band).alias("band"),
        (amount >= profile.upper_median if config.fuzzy_material_only else F.lit(True)).alias("material"),
        F.struct(F.col("date").alias("date"), amount_cents(amount).alias("amount2")).alias("key"),
    )


def _edge(agg, distance: int, only_material: bool) -> Column:
    cond = F.col("distance") == distance
    if only_material:
        cond = cond & F.col("material")
    return agg(F.when(cond, F.struct("key", "txn_id")))


def fuzzy_duplicates(
    ledger: DataFrame, profile: LedgerProfile, config: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """(txn_id, fuzzy_dup_group, fuzzy_match_txn_id, fuzzy_distance) of the matching rows.

    The match is a row at the smallest distance; the group names that pair of rows.
    """
    rows = _rows(ledger, profile, config)
    # stored once: comparing the names is the costly part and the pairs are read several times
    pairs = materialize(similar_names(rows.select("name").distinct(), "name"), "similar-vendors")
    # names that differ in whitespace only share exact-duplicate keys: for them the
    # key of the two rows must differ; for all others the key cannot be equal
    same_key = vendor_key(F.col("name")) == vendor_key(F.col("other"))
    pairs = pairs.withColumn("same_key", same_key)
    no_key = F.lit(None).cast("struct<date:date,amount2:double>")

    def partner_rows(pairs_of_kind: DataFrame, key: Column) -> DataFrame:
        present = (
            rows.join(pairs_of_kind.select(F.col("other").alias("name")).distinct(), "name", "left_semi")
            .groupBy("name", "band", "material", key.alias("key"))
            .agg(F.min("txn_id").alias("txn_id"))
        )
        return pairs_of_kind.join(present.withColumnRenamed("name", "other"), "other").select(
            "name",
            F.explode(F.sequence(F.col("band") - _REACH, F.col("band") + _REACH)).alias("band"),
            "distance",
            "material",
            "key",
            "txn_id",
        )

    in_reach = partner_rows(pairs.where(~F.col("same_key")), no_key).unionByName(
        partner_rows(pairs.where("same_key"), F.col("key"))
    )
    # Per (vendor, band) the partner rows with the smallest and the largest key are
    # enough: a row has a partner with another key iff one of these two differs.
    # A partner without a key restriction sorts first and always differs.
    edges = {
        (d, m, side): _edge(agg, d, m).alias(f"{side}_{d}_{'material' if m else 'any'}")
        for d in _DISTANCES
        for m in (True, False)
        for side, agg in (("lo", F.min), ("hi", F.max))
    }
    reach = in_reach.groupBy("name", "band").agg(*edges.values())

    def best(distance: int, only_material: bool) -> Column:
        kind = "material" if only_material else "any"
        lo, hi = F.col(f"lo_{distance}_{kind}"), F.col(f"hi_{distance}_{kind}")

        def differs(edge: Column) -> Column:
            return edge.isNotNull() & ~edge["key"].eqNullSafe(F.col("key"))

        txn = F.when(differs(lo), lo["txn_id"]).when(differs(hi), hi["txn_id"])
        return F.when(txn.isNotNull(), F.struct(F.lit(distance).alias("distance"), txn.alias("txn_id")))

    # a row below the material amount needs a partner that is above it
    match = F.when(F.col("material"), F.coalesce(*[best(d, False) for d in _DISTANCES])).otherwise(
        F.coalesce(*[best(d, True) for d in _DISTANCES])
    )
    found = never_broadcast(rows).join(reach, ["name", "band"]).select("txn_id", match.alias("match"))
    a, b = F.col("txn_id"), F.col("match.txn_id")
    return found.where(F.col("match").isNotNull()).select(
        "txn_id",
        F.concat_ws("-", F.lit("FUZZY"), F.least(a, b), F.greatest(a, b)).alias("fuzzy_dup_group"),
        b.alias("fuzzy_match_txn_id"),
        F.col("match.distance").alias("fuzzy_distance"),
    )
