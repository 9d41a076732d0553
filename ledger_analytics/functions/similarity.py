"""Candidates for edit distance two, found without comparing strings with each other.

Short strings meet on their *deletion variants*: strings within distance two share a variant
with at most two characters removed. A string of ``n`` characters has about n²/2 of them, so
longer ones meet on *segments* instead: the shorter of two is cut into three parts, of which
two edits leave one untouched, and the longer one has that part at nearly the same place.
That is three keys to file a string under and fifteen to look others up. A part that many
strings share ("international") would bring them all together; under such a key the strings
meet on the deletion variants of what is left beside the part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_analytics.sources.materialize import materialize

#: Strings of up to so many characters meet on deletion variants.
SHORT = 18
#: Strings under one segment key that are compared with each other.
SHARED = 200


def with_deletion_keys(df: DataFrame, column: str, key: str) -> DataFrame:
    """Repeat each row of ``df`` for the 64-bit hash of every such variant of ``column``.

    Only strings that are close to each other meet under one key, so a key's group
    is bounded by the alphabet and the string length, not by how many strings
    there are. Hashes stand in for the variants to keep the following shuffle
    narrow; a clash only adds a candidate, which the distance test then rejects.

    The positions to remove (none, j, or i and j) are exploded instead of being
    mapped inside an array, which keeps the work in generated code. In a run of equal
    characters only the last is removed: removing another one gives the same string.
    """
    s, i, j = F.col(column), F.col("__i"), F.col("__j")
    length = F.length(s)

    def char(at):
        return F.substring(s, at, F.lit(1))

    first = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)))
    second = F.when(i == 0, F.sequence(F.lit(0), length)).otherwise(F.sequence(i + 1, length))
    last_of_run_j = (j == 0) | (char(j) != char(j + 1))
    last_of_run_i = (i == 0) | (i + 1 == j) | (char(i) != char(i + 1))
    variant = F.concat(
        F.substring(s, F.lit(1), i - 1),
        F.substring(s, i + 1, j - i - 1),
        F.substring(s, j + 1, length),
    )
    # a few bytes per string grow several hundredfold here: use all tasks a shuffle
    # may have, whatever the size of the input suggests
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        df.repartition(tasks)
        .withColumn("__i", F.explode(first))
        .withColumn("__j", F.explode(second))
        .where(last_of_run_i & last_of_run_j)
        .select(*df.columns, F.xxhash64(variant).alias(key))
    )


def _segments(length: Column) -> list[tuple[Column, Column]]:
    """(first position, length) of the three parts of a string, the last ones longer."""
    base, more = F.floor(length / 3).cast("int"), length % 3
    sizes = [base, base + (more == 2).cast("int"), base + (more >= 1).cast("int")]
    return [(F.lit(1), sizes[0]), (1 + sizes[0], sizes[1]), (1 + sizes[0] + sizes[1], sizes[2])]


def _segment_keys(strings: DataFrame) -> DataFrame:
    """(id, side, key, filed, rest): each string under its own parts (``filed``), and under the
    parts that a string up to two characters shorter may have in common with it."""
    length = F.length("s")

    def entry(shorter: Column, part: int, first: Column, size: Column, filed: bool) -> Column:
        cut = F.substring(F.col("s"), first, size)
        rest = F.concat(F.substring(F.col("s"), F.lit(1), first - 1), F.lit("\x00"), F.substring(F.col("s"), first + size, length))
        return F.struct(F.xxhash64(shorter, F.lit(part), cut).alias("key"), F.lit(filed).alias("filed"), rest.alias("rest"))

    entries = [F.array(entry(length, i, p, n, True)) for i, (p, n) in enumerate(_segments(length))]
    for less in (0, 1, 2):
        shorter = length - less
        for i, (p, n) in enumerate(_segments(shorter)):
            # edits before the part move it by their number, and so do those behind it
            lo = F.greatest(F.lit(1), p - i, p + less - (2 - i))
            hi = F.least(length - n + 1, p + i, p + less + (2 - i))
            found = F.transform(F.sequence(lo, hi), lambda at: entry(shorter, i, at, n, False))  # noqa: B023
            entries.append(F.when((shorter >= SHORT - 1) & (lo <= hi), found))
    every = F.flatten(F.array_compact(F.array(*entries)))
    return strings.where(length >= SHORT - 1).select("id", "side", F.inline(every))


def close_candidates(strings: DataFrame) -> DataFrame:
    """(id, other_id): pairs of ``strings`` (id, s, side) that may be within distance two; all
    that are, are among them. Pairs are of one string of side 0 and one of side 1, or, where
    there is only side 0, of two strings in the order of their ids."""
    sides = strings.agg(F.max("side")).first()[0]
    short = with_deletion_keys(strings.where(F.length("s") <= SHORT), "s", "key").select("key", "id", "side")
    keyed = materialize(_segment_keys(strings), "segment-keys")
    # a string needs one of the other side under its key, filed if it is sought and sought if it is filed
    roles = keyed.withColumn("role", F.col("filed").cast("int") + (2 * F.col("side") if sides else 0))
    partner = {0: 3, 1: 2, 2: 1, 3: 0} if sides else {0: 1, 1: 0}
    counted = roles.groupBy("key").agg(*[F.count_if(F.col("role") == r).alias(f"n{r}") for r in partner], F.min("id").alias("lo"), F.max("id").alias("hi"))
    kept = [F.when(F.col(f"n{p}") > 0, F.col(f"n{r}")).otherwise(0) for r, p in partner.items()]
    counted = counted.where("lo < hi").select("key", F.array(*[n > 0 for n in kept]).alias("roles"), sum(kept[1:], kept[0]).alias("n"))
    shared = materialize(counted.where("n > 0").select("key", "roles", (F.col("n") > SHARED).alias("many")), "segment-counts")
    met = roles.join(shared, "key").where(F.get("roles", F.col("role")))
    few = met.where("NOT many").select("key", "id", "side", "filed")
    many = with_deletion_keys(met.where("many").select("key", "id", "side", "filed", "rest"), "rest", "variant")
    few = few.unionByName(many.select(F.xxhash64("key", "variant").alias("key"), "id", "side", "filed"))

    # nearly all keys belong to one string; a sum per key finds the shared ones without a sort
    def both(keys: DataFrame, files: bool) -> DataFrame:
        several = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("side").alias("a"), F.max("side").alias("b"))
        several = several.where("lo < hi AND a < b" if sides else "lo < hi").select("key")
        kept = materialize(keys.join(several, "key", "left_semi"), "shared-keys")
        other = kept.select("key", F.col("id").alias("other_id"), F.col("side").alias("other_side"), *[F.col("filed").alias("other_filed")] * files)
        pairs = kept.join(other, "key").where("id <> other_id")
        if files:  # one is filed and the other looks it up
            pairs = pairs.where("filed AND NOT other_filed")
        return pairs.select("id", "side", "other_id", "other_side")

    pairs = both(short, False).unionByName(both(few, True))
    turned = (F.col("side") > F.col("other_side")) | ((F.col("side") == F.col("other_side")) & (F.col("id") > F.col("other_id")))
    a, b = F.when(turned, F.col("other_id")).otherwise(F.col("id")), F.when(turned, F.col("id")).otherwise(F.col("other_id"))
    crosses = F.col("side") != F.col("other_side")
    pairs = pairs.where(crosses) if sides else pairs
    return pairs.select(a.alias("id"), b.alias("other_id")).distinct()
