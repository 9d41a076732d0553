"""Vendor screening against caller-supplied lists.

Verdicts are worked out once per distinct lower-case vendor and joined to the
rows afterwards. A list that is not given leaves its verdict null: not checked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_analytics.config import AnalysisConfig
from ledger_analytics.functions.similarity import close_candidates
from ledger_analytics.functions.text import name_tokens, normal_name, vendor_lower
from ledger_analytics.sources.materialize import materialize


@dataclass(frozen=True)
class ScreeningLists:
    """sanctions(entity_name, list_type), registry(entity_name, cik),
    geocodes(address, address_type); each optional."""

    sanctions: DataFrame | None = None
    registry: DataFrame | None = None
    geocodes: DataFrame | None = None


def vendor_directory(ledger: DataFrame) -> DataFrame:
    """(vendor_lower, vendor, address): first spelling and first non-empty address seen."""
    # the ledger is merged by hash to its few distinct spellings; only these are sorted
    seen = ledger.groupBy(vendor_lower(F.col("vendor")).alias("vendor_lower"), "vendor", "address").agg(
        F.min("txn_id").alias("first")
    )
    has_address = F.coalesce(F.col("address"), F.lit("")) != ""
    return seen.groupBy("vendor_lower").agg(
        F.min_by("vendor", "first").alias("vendor"),
        F.min_by("address", F.when(has_address, F.col("first"))).alias("address"),
    )


def suspect_vendors(rows: DataFrame) -> DataFrame:
    """(vendor_lower) with at least one RSF, isolation or fuzzy-duplicate finding."""
    hit = F.col("rsf_flag") | F.col("is_outlier") | F.col("fuzzy_dup_group").isNotNull()
    return rows.where(hit).select(vendor_lower(F.col("vendor")).alias("vendor_lower")).distinct()


def suspect_addresses(directory: DataFrame, suspects: DataFrame) -> DataFrame:
    """Distinct addresses of suspect vendors: the only ones worth geocoding."""
    return (
        directory.where(F.col("address").isNotNull())
        .join(suspects, "vendor_lower", "left_semi")
        .select("address")
        .distinct()
    )


def _contained(names: DataFrame, listed: DataFrame, least: int) -> DataFrame:
    """(id, listing_id): names that contain a listed one of ``least`` or more words, as whole words.

    A listed name meets others on its rarest word only, at that word's place; a listed name
    with a word that no name has meets nobody. A name gives one row per word.
    """
    tokens = F.split("s", " ")
    words = names.select("id", F.posexplode(tokens).alias("at", "word"))
    frequency = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    long = listed.where(F.size(tokens) >= least)
    parts = long.select(F.col("id").alias("listing_id"), F.size(tokens).alias("size"), F.posexplode(tokens).alias("place", "word"))
    rarest = parts.join(frequency, "word").groupBy("listing_id", "size").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "word", "place")).alias("key"))
    keys = rarest.where("known = size").select("listing_id", F.col("key.word").alias("word"), F.col("key.place").alias("place"))
    starts = words.join(keys, "word").where("at >= place").select("id", "listing_id", (F.col("at") - F.col("place") + 1).alias("start"))
    met = starts.join(names.select("id", tokens.alias("name")), "id").join(
        long.select(F.col("id").alias("listing_id"), tokens.alias("entity")), "listing_id"
    )
    return met.where(F.slice("name", F.col("start"), F.size("entity")) == F.col("entity")).select("id", "listing_id").distinct()


def sanctions_verdicts(
    vendors: DataFrame, sanctions: DataFrame, config: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """(vendor_lower, ofac_hit, matched_name, list_type, match_kind, match_distance) per vendor.

    ``vendors`` has vendor_lower. A vendor is hit when its normalised name equals a
    listed one, contains a listed name of three or more words, or is at most two
    edits away from one. All three are equi-joins of numbers; the best match is kept.
    """
    least = config.sanctions_min_entity_tokens
    names = vendors.select("vendor_lower", normal_name(F.col("vendor_lower")).alias("name")).where(
        F.col("name") != ""
    )
    listed = (
        sanctions.select(
            F.col("entity_name").alias("matched_name"),
            "list_type",
            normal_name(F.col("entity_name")).alias("entity"),
        )
        .where(F.col("entity") != "")
        # one record per normalised name: repeated listings would multiply the pairs
        .groupBy("entity")
        .agg(F.min(F.struct("matched_name", "list_type")).alias("listing"))
    )
    d = config.sanctions_max_distance
    if not 0 <= d <= 2:
        raise ValueError("sanctions_max_distance must be 0, 1 or 2")
    # numbers stand in for names and listings until the best match is known
    number = F.monotonically_increasing_id().alias("id")
    names = materialize(names.select(number, "vendor_lower", F.col("name").alias("s")), "screened-names")
    listed = materialize(listed.select(number, F.col("entity").alias("s"), "listing"), "listed-names")
    # the two tables are numbered apart: ids of listings are below zero
    both = names.select("id", "s", F.lit(0).alias("side")).unionByName(
        listed.select((-1 - F.col("id")).alias("id"), "s", F.lit(1).alias("side"))
    )
    near = close_candidates(both).select("id", (-1 - F.col("other_id")).alias("listing_id"))
    near = near.join(names.select("id", F.col("s").alias("name")), "id").join(
        listed.select(F.col("id").alias("listing_id"), F.col("s").alias("entity")), "listing_id"
    )
    near = near.withColumn("distance", F.levenshtein("name", "entity", d)).where("distance >= 0")
    if config.sanctions_max_ratio is not None:
        near = near.where(F.col("distance") <= config.sanctions_max_ratio * F.length("name"))
    exact = names.join(listed.select(F.col("id").alias("listing_id"), "s"), "s")
    kinds = [
        exact.select("id", "listing_id", F.lit(0).alias("kind"), F.lit(0).alias("distance")),
        _contained(names, listed, least).select("id", "listing_id", F.lit(1).alias("kind"), F.lit(0).alias("distance")),
        near.select("id", "listing_id", F.lit(2).alias("kind"), "distance"),
    ]
    found = reduce(DataFrame.unionByName, kinds).groupBy("id", "listing_id").agg(F.min(F.struct("kind", "distance")).alias("how"))
    found = found.join(listed.select(F.col("id").alias("listing_id"), "listing"), "listing_id")
    best = found.groupBy("id").agg(F.min(F.struct("how.kind", "how.distance", "listing")).alias("best"))
    best = best.join(names.select("id", "vendor_lower"), "id")
    kind = F.element_at(
        F.array(F.lit("exact"), F.lit("contains"), F.lit("fuzzy")), F.col("best.kind") + 1
    )
    return vendors.select("vendor_lower").join(best, "vendor_lower", "left").select(
        "vendor_lower",
        F.col("best").isNotNull().alias("ofac_hit"),
        F.col("best.listing.matched_name").alias("matched_name"),
        F.col("best.listing.list_type").alias("list_type"),
        F.when(F.col("best").isNotNull(), kind).alias("match_kind"),
        F.col("best.distance").alias("match_distance"),
    )


def registry_verdicts(
    vendors: DataFrame, registry: DataFrame, config: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """(vendor_lower, edgar_verified, confidence, entity_name, cik) per vendor.

    A vendor is verified when the token sets of its name and of a registered name
    have a Jaccard similarity of at least ``registry_min_jaccard``. Prefix
    filtering: sets that similar share one of their few rarest tokens, so names
    meet on those only and a word like "inc" brings nobody together. Confidence
    is null below the limit.
    """
    limit = config.registry_min_jaccard
    sides = {}
    for side, df, col in (("v", vendors, "vendor_lower"), ("r", registry, "entity_name")):
        sides[side] = df.select(
            *df.columns, F.array_sort(F.array_distinct(name_tokens(F.col(col)))).alias("tokens")
        ).where(F.size("tokens") > 0)
    sets = (
        sides["v"].select("tokens").distinct().withColumn("side", F.lit("v")).unionByName(
            sides["r"].select("tokens").distinct().withColumn("side", F.lit("r"))
        )
    )
    exploded = sets.select("side", "tokens", F.explode("tokens").alias("token"))
    rarity = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # rank each set's tokens from rare to common and keep the prefix
    ranked = (
        exploded.join(rarity, "token")
        .groupBy("side", "tokens")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by_rarity"))
    )
    size = F.size("tokens")
    prefix = F.slice("by_rarity", F.lit(1), size - F.ceil(size * limit).cast("int") + 1)
    keys = ranked.select("side", "tokens", F.explode(F.transform(prefix, lambda t: t["token"])).alias("token"))
    v = keys.where("side = 'v'").select("token", F.col("tokens").alias("v_tokens"))
    r = keys.where("side = 'r'").select("token", F.col("tokens").alias("r_tokens"))
    shared = F.size(F.array_intersect("v_tokens", "r_tokens"))
    union = F.size("v_tokens") + F.size("r_tokens") - shared
    matches = (
        v.join(
            r,
            (v["token"] == r["token"])
            & (F.size("r_tokens") >= F.size("v_tokens") * limit)
            & (F.size("v_tokens") >= F.size("r_tokens") * limit),
        )
        .select("v_tokens", "r_tokens", (shared / union).alias("confidence"))
        .where(F.col("confidence") >= limit)
        .distinct()
    )
    entities = sides["r"].groupBy(F.col("tokens").alias("r_tokens")).agg(
        F.min(F.struct("entity_name", "cik")).alias("entity")
    )
    best = (
        matches.join(entities, "r_tokens")
        .groupBy(F.col("v_tokens").alias("tokens"))
        .agg(F.min(F.struct((-F.col("confidence")).alias("rank"), F.col("entity"))).alias("best"))
    )
    verified = sides["v"].select("vendor_lower", "tokens").join(best, "tokens").drop("tokens")
    return vendors.select("vendor_lower").join(verified, "vendor_lower", "left").select(
        "vendor_lower",
        F.col("best").isNotNull().alias("edgar_verified"),
        (-F.col("best.rank")).alias("confidence"),
        F.col("best.entity.entity_name").alias("entity_name"),
        F.col("best.entity.cik").alias("cik"),
    )


def address_verdicts(
    addresses: DataFrame, geocodes: DataFrame, config: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """(address, address_valid, address_type): valid when it resolves to a place of business."""
    places = (
        geocodes.select(normal_name(F.col("address")).alias("norm"), F.lower("address_type").alias("address_type"))
        .groupBy("norm")
        .agg(
            F.max(F.coalesce("address_type", F.lit("")).isin(*config.blocked_address_types)).alias("blocked"),
            F.min("address_type").alias("address_type"),
        )
    )
    return (
        addresses.withColumn("norm", normal_name(F.col("address")))
        .join(places, "norm", "left")
        .select("address", F.coalesce(~F.col("blocked"), F.lit(False)).alias("address_valid"), "address_type")
    )


def vendor_verdicts(
    ledger: DataFrame,
    suspects: DataFrame,
    lists: ScreeningLists,
    config: AnalysisConfig = AnalysisConfig(),
) -> DataFrame:
    """(vendor_lower, edgar_verified, ofac_hit, address_valid), null where not checked."""
    directory = vendor_directory(ledger)
    out = directory.select("vendor_lower", "address")
    unchecked = F.lit(None).cast("boolean")
    if lists.registry is not None:
        v = registry_verdicts(directory.select("vendor_lower"), lists.registry, config)
        out = out.join(v.select("vendor_lower", "edgar_verified"), "vendor_lower", "left")
    else:
        out = out.withColumn("edgar_verified", unchecked)
    if lists.sanctions is not None:
        v = sanctions_verdicts(directory.select("vendor_lower"), lists.sanctions, config)
        out = out.join(v.select("vendor_lower", "ofac_hit"), "vendor_lower", "left")
    else:
        out = out.withColumn("ofac_hit", unchecked)
    if lists.geocodes is not None:
        v = address_verdicts(suspect_addresses(directory, suspects), lists.geocodes, config)
        # vendors without an address match nothing; a key of their own spreads them
        key = F.coalesce(F.concat(F.lit("a"), "address"), F.concat(F.lit("v"), "vendor_lower"))
        known = v.select(F.concat(F.lit("a"), "address").alias("key"), "address_valid")
        out = out.withColumn("key", key).join(known, "key", "left")
    else:
        out = out.withColumn("address_valid", unchecked)
    return out.select("vendor_lower", "edgar_verified", "ofac_hit", "address_valid")
