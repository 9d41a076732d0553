"""SimHash near-duplicates: fingerprints of word shingles, compared in bit-sliced form.

``fingerprints`` reads whole texts. ``simhash_groups`` links fingerprints that differ in
at most ``RADIUS`` bits. Two such fingerprints agree on at least ``BLOCKS - RADIUS`` of
``BLOCKS`` bit blocks, so every fingerprint is filed once for each choice of that many
blocks under the bits it has there, and only fingerprints filed together are compared.
The comparison stores bit planes vertically: one machine word holds one bit of 64
fingerprints, distances of 64 pairs are counted at a time by carry-save adders, and a
block of pairs is abandoned once all of them exceed the radius.

``one_per_group`` keeps one document of each group.

Defined results: a null, empty or blank text has no words and fingerprint zero; a text of
fewer than four words has one shingle, its whole word sequence. Equal fingerprints are one
node. Rows with equal ids are rows of one document only if the fingerprints are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_analytics.llm.arrow import extend, slices, utf8
from ledger_analytics.llm.columns import Numbered
from ledger_analytics.llm.graph import components, spanning_pairs
from ledger_analytics.llm.storage import Stored

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Bit blocks; more blocks give more and longer keys.
BLOCKS = 6
#: Fingerprints of one key that are compared in one piece; larger buckets are split.
BUCKET = 4096
#: Words of 64 pairs that are abandoned together.
PAIR_WORDS = 512
_BYTE_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, shingle: int, seed: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, seed)]
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    pairs = zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist())
    return [digest(joined[i:j], seed) for i, j in pairs]


def majority_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of ``hashes`` (runs begin at ``first``) the bits set in over half of it."""
    counts = np.diff(np.append(first, len(hashes)))
    out = np.zeros(len(first), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # byte-wide counters hold up to 255, so runs are cut into pieces of that many hashes
    n, at = counts[full], first[full]
    pieces = -(-n // 255)
    piece_of = np.repeat(np.arange(len(full)), pieces)
    within = np.arange(len(piece_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = at[piece_of] + 255 * within
    run = np.cumsum(pieces) - pieces
    bits = np.zeros(len(full), np.uint64)
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & _BYTE_LANES, cuts)
        total = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run, axis=0)
        for byte in range(8):
            set_ = (2 * total[:, byte] > n).astype(np.uint64)
            bits |= set_ << np.uint64(8 * byte + b)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` with ``fp0``, the fingerprint as a signed long."""

    def compute():
        def f(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            data, off = utf8(batch.column(batch.schema.get_field_index(text)))
            parts = [np.zeros(0, np.uint64)]
            for a, b in slices(off):
                raw = data[off[a] : off[b]].tobytes()
                local = (off[a : b + 1] - off[a]).tolist()
                each = [shingle_hashes(raw[i:j], shingle, seed) for i, j in zip(local, local[1:])]
                sizes = np.fromiter(map(len, each), np.int64, len(each))
                flat = np.fromiter((h for hs in each for h in hs), np.uint64, int(sizes.sum()))
                parts.append(majority_bits(flat, np.cumsum(sizes) - sizes))
            return {"fp0": pa.array(np.concatenate(parts).view(np.int64))}

        return f

    return extend(docs.select(*dict.fromkeys([*keep, text])), compute, [T.StructField("fp0", T.LongType())], keep)


# --- bit-sliced comparison ----------------------------------------------------


def bit_planes(values: np.ndarray) -> np.ndarray:
    """One row a bit; bit i of word w in row p is bit p of row 64 w + i of ``values`` (rows,
    words of a fingerprint); zero words follow."""
    n, m = values.shape
    words = -(-n // 64)
    padded = np.zeros((words * 64, m), np.uint64)
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    planes = np.zeros((64 * m, 2 * words + 2), np.uint64)
    planes[:, :words] = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
    return planes


def close_pairs(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one bucket at most ``radius`` bits apart. ``bucket`` is sorted; ``fp``
    has one row for each fingerprint.

    All pairs at one distance ``s`` in the sorted order are compared at once: the planes
    against themselves moved by s places.
    """
    sizes = np.unique(bucket, return_counts=True)[1]
    size = np.repeat(sizes, sizes)
    s, rows = 1, np.zeros(0, np.int64)
    planes, groups, fresh = None, None, True
    digits = radius.bit_length() + 1
    while True:
        live = np.flatnonzero(size > s)
        if not len(live):
            return
        if fresh or len(live) <= 0.8 * len(rows):
            rows, fresh = live, False
            planes, groups = bit_planes(fp[rows]), bucket[rows]
        n = len(rows)
        if n <= s:
            return
        same = np.zeros(-(-n // 64) * 64, bool)
        same[: n - s] = groups[s:] == groups[: n - s]
        alive = np.packbits(same, bitorder="little").view(np.uint64)
        far, bit = divmod(s, 64)
        for w in range(0, len(alive), PAIR_WORDS):
            mask = alive[w : w + PAIR_WORDS].copy()
            if not mask.any():
                continue
            m = len(mask)
            count = [np.zeros(m, np.uint64) for _ in range(digits)]
            for p in range(len(planes)):
                carry = planes[p, w + far : w + far + m]
                if bit:
                    carry = (carry >> np.uint64(bit)) | (planes[p, w + far + 1 : w + far + 1 + m] << np.uint64(64 - bit))
                carry = carry ^ planes[p, w : w + m]
                for d in range(digits):
                    count[d], carry = count[d] ^ carry, count[d] & carry
                mask &= ~carry  # past the last digit
                if p % 8 == 7:
                    mask &= ~exceeds(count, radius)
                    if not mask.any():
                        break
            else:
                i = np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")) + 64 * w
                if len(i):
                    yield rows[i], rows[i + s]
        s += 1


def exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Where a bit-sliced count (lowest digit first) is over ``radius``."""
    over, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for d in range(len(count) - 1, -1, -1):
        if radius >> d & 1:
            equal &= count[d]
        else:
            over |= equal & count[d]
            equal &= ~count[d]
    return over


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each bucket; rows (bucket, node, fingerprint words) come sorted."""

    def compare(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        bucket, node, fp = rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
        i = j = np.zeros(0, np.int64)
        for a, b in close_pairs(fp, bucket, radius):
            i, j = np.append(i, a), np.append(j, b)
            if len(i) > 1 << 20:
                i, j = spanning_pairs(len(fp), i, j)
        i, j = spanning_pairs(len(fp), i, j)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last bucket may go on
        if held and (cut or rows[0, 0] != held[0][0, 0]):
            yield from compare([*held, rows[:cut]])
            held = []
        elif cut:
            yield from compare([rows[:cut]])
        held.append(rows[cut:])
    if held:
        yield from compare(held)


def block_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of all choices of ``blocks - radius`` blocks, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(each, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(distinct: DataFrame, masks: list[list[int]], radius: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) of nodes that connect the same nodes as all pairs of fingerprints at most
    ``radius`` bits apart that agree in the bits of one of ``masks``.

    ``distinct`` has one row for each fingerprint: ``node`` and ``fp0``, ``fp1``, ... A bucket
    of over ``bucket`` rows is cut into parts, and each pair of parts is compared apart.
    """
    words = [c for c in distinct.columns if c.startswith("fp")]
    mask = F.array(*[F.array(*[F.lit(m).cast("long") for m in ms]) for ms in masks])
    filed = distinct.select("node", *words, F.posexplode(mask).alias("t", "mask"))
    key = F.xxhash64("t", *[F.col(w).bitwiseAND(F.col("mask")[i]) for i, w in enumerate(words)])
    filed = filed.select(key.alias("bucket"), "node", *words)
    large = filed.groupBy("bucket").count().where(F.col("count") > bucket)
    large = large.select("bucket", F.ceil(F.col("count") / (bucket // 2)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), "parts").cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least("part", o).alias("lo"), F.greatest("part", o).alias("hi")),
    )
    dealt = filed.join(large, "bucket", "left")
    small = dealt.where("parts IS NULL").select("bucket", "node", *words)
    split = (
        dealt.where("parts IS NOT NULL").withColumn("part", part)
        .select("node", *words, "bucket", F.explode(pairs).alias("p"))
        .select(F.xxhash64("bucket", "p.lo", "p.hi").alias("bucket"), "node", *words)
    )
    ordered = small.unionByName(split).repartition("bucket").sortWithinPartitions("bucket", "node")
    return ordered.mapInArrow(lambda it: _links(it, radius), "a long, b long")


def _grouped(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (with ``node``) and the smallest id of each one's component."""
    root = components(links)
    rooted = distinct.select("node", "first_id").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(rooted.join(lowest, "root").select("node", "component_id"), "node")


def simhash_groups(
    docs: DataFrame, keep: list[str], text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
    radius: int = RADIUS, blocks: int = BLOCKS, stored: Stored | None = None,
) -> DataFrame:
    """``keep`` columns of every row, its fingerprint ``fp0`` and ``component_id``: the smallest
    id of any document reachable over links between fingerprints at most ``radius`` bits
    apart. ``keep`` includes the id."""
    if blocks <= radius:
        raise ValueError("there must be more blocks than the radius")
    stored = stored or Stored(docs.sparkSession)
    rows = stored.table(fingerprints(docs, keep, text, shingle).withColumn("node", F.col("fp0")))
    distinct = stored.table(rows.groupBy("node", "fp0").agg(F.min(doc_id).alias("first_id")))
    masks = [[m] for m in block_masks(radius, blocks)]
    return _grouped(rows, distinct, fingerprint_links(distinct.select("node", "fp0"), masks, radius))


def one_per_group(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """The rows whose id is the smallest of their group by ``simhash_groups``, unchanged.

    Of several rows with that id one stays, the first by a hash of all its columns. A row
    without an id belongs to nobody and stays.
    """
    named = Numbered(docs)
    key = named[doc_id]
    stored = Stored(docs.sparkSession)
    groups = simhash_groups(named.df, [key], named[text], key, shingle, radius, stored=stored)
    first = F.count_if(F.col(key) == F.col("component_id"))
    ids = stored.table(groups.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(first.alias("n")).where("n <> 1"))
    stored.keep(ids)
    # fewer ids go than stay, and rows without an id meet none
    rows = named.df.join(ids.where("n = 0").select("id"), F.col(key) == F.col("id"), "left_anti")
    if ids.where("n > 1").isEmpty():  # no id twice: nothing to choose, and texts need not be grouped
        return named.back(rows)
    order = Window.partitionBy(key).orderBy(F.xxhash64(*named.columns))
    rows = rows.withColumn("nth", F.row_number().over(order))
    return named.back(rows.where(F.col(key).isNull() | (F.col("nth") == 1)))
