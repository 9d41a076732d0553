"""Hard negatives: nearest rows of other labels within a band of scores below each positive.

Scores are inner products of integer vectors. Every row is coded once: rotated at random and
cut to one bit a component, with the *alignment* of the vector with its code (their inner
product, the code taken as a unit vector) and the norm of the residual, which is orthogonal
to the code. What the first code leaves over is coded again under another rotation, up to
``STAGES`` codes. An anchor is rotated the same way and written in ``PLANES`` bit planes, so
its inner product with a code is a weighted sum of popcounts; times the alignment it estimates
the score. The estimate is off by at most the error of the bit planes, plus, by Cauchy and
Schwarz, the residual's norm times that of the anchor outside of the last code. These bounds
are exact, not probable, so a row whose interval cannot reach the scores wanted is dropped
without loss. Intervals of the rows that survive shrink code by code, and what is left in the
end is scored in integers.

``hard_negatives`` runs this twice over all rows: for the positives of each anchor (its best
rows of the same label), then for the negatives of each positive. Anchors and rows are dealt
into blocks by hash of the row; each pair of blocks is one group, of bounded size, which
returns the best few per anchor. Nothing is collected but row counts.

Defined results: rows with a null label or vector or a null or non-finite component take no
part, nor do vectors with a component beyond 2^26, whose scores could exceed a long; shorter
vectors count as followed by zeros; equal scores go by id, null last, then by row; repeated
rows are rows of their own, and each is another row to its copies; a null id is no anchor
unless the caller says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_analytics.llm.arrow import bounded_batches
from ledger_analytics.llm.storage import Stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Scores of negatives, as percentages of the positive's score.
BAND = (50, 95)
STAGES = 4
#: Bits of a component of a rotated anchor.
PLANES = 6
SEED = 42
#: Rows of a block of anchors and of a block of all rows.
ANCHORS, ROWS = 4096, 8192
#: Anchors that are compared with a block at a time, and pairs that are scored at a time.
TILE, SCORED = 64, 1 << 15
#: Estimates that are scored at once, to have a limit for the others.
SEEDS = 48
_LARGEST = 1 << 26


# --- codes ---------------------------------------------------------------------


def rotations(size: int, stages: int = STAGES, seed: int = SEED) -> list[np.ndarray]:
    """Random orthogonal matrices, the same in every task."""
    rng = np.random.default_rng(seed)
    return [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(stages)]


class Coder:
    """Codes of vectors of ``dim`` components, padded to whole words of 64 bits."""

    def __init__(self, dim: int, stages: int = STAGES):
        self.size = max(64, -(-dim // 64) * 64)
        self.words, self.stages = self.size // 64, stages
        self._rotations = rotations(self.size, stages)

    def rotated(self, x: np.ndarray) -> Iterator[np.ndarray]:
        for r in self._rotations:
            x = x @ r
            yield x

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits (row, stage, word), alignments and norms of residuals (row, stage)."""
        rest = np.zeros((len(x), self.size))
        rest[:, : x.shape[1]] = x
        bits, align, norm = [], [], []
        for r in self._rotations:
            rest = rest @ r
            up = rest >= 0
            a = np.abs(rest).sum(axis=1) / np.sqrt(self.size)
            rest = rest - np.where(up, 1, -1) * (a / np.sqrt(self.size))[:, None]
            bits.append(np.packbits(up, axis=1, bitorder="little").view(np.uint64))
            align.append(a)
            norm.append(np.linalg.norm(rest, axis=1))
        return np.stack(bits, axis=1), np.stack(align, axis=1), np.stack(norm, axis=1)


class Queries:
    """Anchors in bit planes, for each stage."""

    def __init__(self, coder: Coder, x: np.ndarray):
        padded = np.zeros((len(x), coder.size))
        padded[:, : x.shape[1]] = x
        self.norm = np.linalg.norm(padded, axis=1)
        self.root = np.sqrt(coder.size)
        self.planes, self.low, self.step, self.sum, self.error = [], [], [], [], []
        for q in coder.rotated(padded):
            low = q.min(axis=1, initial=0)
            step = np.maximum(q.max(axis=1, initial=0) - low, 1e-30) / ((1 << PLANES) - 1)
            v = np.rint((q - low[:, None]) / step[:, None]).astype(np.int64)
            self.error.append(np.linalg.norm(q - low[:, None] - step[:, None] * v, axis=1))
            bits = (v[:, None, :] >> np.arange(PLANES)[:, None]) & 1
            self.planes.append(np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64))
            self.low.append(low)
            self.step.append(step)
            self.sum.append(low * coder.size + step * v.sum(axis=1))

    def with_code(self, stage: int, i, code: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products of anchors ``i`` with unit codes, but for ``error``. Shapes of ``i``
        and of the codes (last axis: words) are broadcast."""
        planes = self.planes[stage][i]
        total = np.zeros(np.broadcast_shapes(planes.shape[:-2], code.shape[:-1]), np.int32)
        for p in range(PLANES):
            both = np.bitwise_count(planes[..., p, :] & code)
            total += (both[..., 0] if both.shape[-1] == 1 else both.sum(axis=-1)).astype(np.int32) << p
        on = self.low[stage][i] * ones + self.step[stage][i] * total
        return (2 * on - self.sum[stage][i]) / self.root


class Rows:
    """A block of coded rows."""

    def __init__(self, table: pa.Table, coder: Coder, dim: int):
        blob = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        n = table.num_rows
        self.row = table["row"].to_numpy()
        self.id = table["id"].to_pylist()
        self.order = np.array([np.iinfo(np.int64).max if v is None else v for v in self.id], np.int64)
        self.label = table["label"].to_numpy()
        self.x = blob("x", "<i4").reshape(n, dim).astype(np.int64)
        self.code = blob("code", "<u8").reshape(n, coder.stages, coder.words)
        self.align, self.rest = blob("align", "<f8").reshape(n, coder.stages), blob("rest", "<f8").reshape(n, coder.stages)
        self.ones = np.bitwise_count(self.code).sum(axis=2).astype(np.int64)
        self.norm = np.linalg.norm(self.x.astype(float), axis=1)


def scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of rows a[i] with b[j]."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), SCORED):
        some = slice(at, at + SCORED)
        out[some] = np.einsum("pd,pd->p", a[i[some]], b[j[some]])
    return out


class Intervals:
    """Estimates of the scores of a tile of anchors with rows, and how far they can be off."""

    def __init__(self, queries: Queries, tile: np.ndarray, rows: Rows, some: np.ndarray):
        self._q, self._rows, self.tile, self.some = queries, rows, tile, some
        shape = (len(tile), len(some))
        self.i, self.j = (np.broadcast_to(x, shape) for x in (np.arange(len(tile))[:, None], np.arange(len(some))[None, :]))
        self.estimate, self._planes = np.zeros(shape), np.zeros(shape)
        self.stage = 0
        self.slack = 1e-9 * queries.norm[tile].max(initial=0) * rows.norm[some].max(initial=0) + 1e-6
        self.refine()

    def refine(self) -> None:
        """Add the next code."""
        q, k = self.tile[self.i], self.stage
        r = self.some[self.j]
        if self.i.ndim == 2:  # all pairs of the tile: broadcast instead of gathering
            q, r = self.tile[:, None], self.some[None, :]
        align = self._rows.align[r, k]
        ip = self._q.with_code(k, q, self._rows.code[r, k], self._rows.ones[r, k])
        error = self._q.error[k][q]
        self.estimate = self.estimate + align * ip
        self._planes = self._planes + align * error
        # what the anchor has outside of this code is all that can meet the residual
        inside = np.maximum(np.abs(ip) - error, 0)
        outside = np.sqrt(np.maximum(self._q.norm[q] ** 2 - inside**2, 0))
        self.off = self._planes + outside * self._rows.rest[r, k] + self.slack
        self.stage += 1

    def keep(self, mask: np.ndarray) -> None:
        self.i, self.j, self.estimate, self.off, self._planes = (x[mask] for x in (self.i, self.j, self.estimate, self.off, self._planes))


def _best(order: list[np.ndarray], group: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first ``most`` of each group in the order of the keys (first key first)."""
    at = np.lexsort((*reversed(order), group))
    g = group[at]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return at[rank < most]


def _top(estimate: np.ndarray, most: int) -> np.ndarray:
    """Columns of the ``most`` largest values of each row."""
    if estimate.shape[1] <= most:
        return np.broadcast_to(np.arange(estimate.shape[1]), estimate.shape)
    return np.argpartition(estimate, estimate.shape[1] - most, axis=1)[:, -most:]


def _survivors(near: Intervals, reaches) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that ``reaches(i, low, high)`` keeps after all codes."""
    near.keep(reaches(near.i, near.estimate - near.off, near.estimate + near.off))
    while near.stage < STAGES and len(near.i):
        near.refine()
        near.keep(reaches(near.i, near.estimate - near.off, near.estimate + near.off))
    return near.i, near.j


def best_same(anchors: Rows, rows: Rows, coder: Coder, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and score of the best ``most`` other rows of each anchor's label."""
    queries = Queries(coder, anchors.x.astype(float))
    out = [(np.zeros(0, np.int64),) * 3]
    for label in np.unique(anchors.label):
        every, some = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        for t in range(0, len(every) if len(some) else 0, TILE):
            tile = every[t : t + TILE]
            near = Intervals(queries, tile, rows, some)
            near.refine()
            itself = anchors.row[tile][:, None] == rows.row[some][None, :]
            top = _top(np.where(itself, -np.inf, near.estimate), most)
            i = np.repeat(np.arange(len(tile)), top.shape[1])
            s = scores(anchors.x, rows.x, tile[i], some[top.ravel()]).reshape(top.shape)
            s = np.where(np.take_along_axis(itself, top, 1), np.iinfo(np.int64).min, s)
            limit = s.min(axis=1) if top.shape[1] == most else np.full(len(tile), np.iinfo(np.int64).min)
            i, j = _survivors(near, lambda i, low, high, limit=limit: high >= limit[i])
            other = ~itself[i, j]
            i, j = i[other], j[other]
            s = scores(anchors.x, rows.x, tile[i], some[j])
            best = _best([-s, rows.order[some[j]], rows.row[some[j]]], i, most)
            out.append((tile[i[best]], some[j[best]], s[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def best_banded(
    anchors: Rows, rows: Rows, coder: Coder, positive: np.ndarray, most: int, band: tuple[int, int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, number of the positive, row and score of the best ``most`` rows of other labels
    in the band below each positive. ``positive`` has the positives' scores by anchor, and the
    smallest integer where there are fewer."""
    queries = Queries(coder, anchors.x.astype(float))
    there = positive > np.iinfo(np.int64).min
    known = np.where(there, positive, -1)  # a band below a negative score is empty
    least, largest = -(-band[0] * known // 100), band[1] * known // 100
    out = [(np.zeros(0, np.int64),) * 4]
    for label in np.unique(anchors.label):
        every, some = np.flatnonzero((anchors.label == label) & (known >= 0).any(axis=1)), np.flatnonzero(rows.label != label)
        for t in range(0, len(every) if len(some) else 0, TILE):
            tile = every[t : t + TILE]
            lo, hi = least[tile], largest[tile]
            near = Intervals(queries, tile, rows, some)
            near.refine()
            limit = np.where(known[tile] >= 0, lo, np.iinfo(np.int64).max).astype(float)

            def raise_limit(top: np.ndarray, who: np.ndarray, p: int) -> None:
                """The score of the last of the best few in the band that are known already."""
                i = np.repeat(who, top.shape[1])
                s = scores(anchors.x, rows.x, tile[i], some[top.ravel()]).reshape(top.shape)
                inside = np.where((s >= lo[who, p, None]) & (s <= hi[who, p, None]), s, np.iinfo(np.int64).min)
                if top.shape[1] >= most:
                    limit[who, p] = np.maximum(limit[who, p], np.sort(inside, axis=1)[:, -most].astype(float))

            highest = _top(near.estimate, SEEDS)
            for p in range(positive.shape[1]):
                raise_limit(highest, np.flatnonzero(known[tile, p] >= 0), p)
                # those whose band lies below all these: the largest estimates that are in it
                short = np.flatnonzero((known[tile, p] >= 0) & (limit[:, p] <= lo[:, p]))
                if len(short):
                    below = np.where(near.estimate[short] <= hi[short, p, None], near.estimate[short], -np.inf)
                    raise_limit(_top(below, SEEDS), short, p)

            def reaches(i, low, high):
                wanted = np.zeros(i.shape, bool)
                for p in range(positive.shape[1]):
                    wanted |= (high >= limit[i, p]) & (low <= hi[i, p])
                return wanted

            i, j = _survivors(near, reaches)
            s = scores(anchors.x, rows.x, tile[i], some[j])
            for p in range(positive.shape[1]):
                held = np.flatnonzero((s >= limit[i, p]) & (s <= hi[i, p]) & (known[tile[i], p] >= 0))
                best = held[_best([-s[held], rows.order[some[j[held]]], rows.row[some[j[held]]]], i[held], most)]
                out.append((tile[i[best]], np.full(len(best), p), some[j[best]], s[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


# --- tables --------------------------------------------------------------------


def _coded(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, id, label, vector) coded; vectors out of range are left out."""
    coder = Coder(dim)
    n, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        vectors = batch.column(3)
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
        size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        x = np.zeros((len(size), dim))
        of = np.repeat(np.arange(len(size)), size)
        x[of, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(values * scale)
        row = (part << 40) + n + np.arange(len(size))
        n += len(size)
        ok = (np.abs(x) <= _LARGEST).all(axis=1)
        x, row = x[ok], row[ok]
        code, align, rest = coder.codes(x)
        blobs = [x.astype("<i4"), code.astype("<u8"), align.astype("<f8"), rest.astype("<f8")]
        kept = [batch.column(c).filter(pa.array(ok)) for c in range(3)]
        arrays = [pa.array(row), *kept, *[pa.array([r.tobytes() for r in b], pa.binary()) for b in blobs]]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "anchor", "id", "label", "x", "code", "align", "rest"])


_CODED = "row long, anchor boolean, id long, label long, x binary, code binary, align binary, rest binary"
_FOUND = "row long, id long, positive int, other_row long, other_id long, score long"


def _found(anchors: Rows, rows: Rows, i, positive, j, s) -> pa.Table:
    ids = lambda of, at: pa.array([of.id[k] for k in at.tolist()], pa.int64())
    columns = [pa.array(anchors.row[i]), ids(anchors, i), pa.array(positive, pa.int32()), pa.array(rows.row[j]), ids(rows, j), pa.array(s)]
    return pa.Table.from_arrays(columns, names=["row", "id", "positive", "other_row", "other_id", "score"])


def _in_blocks(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, compare) -> DataFrame:
    """``compare(anchors, rows)`` over all pairs of a block of anchors and a block of rows."""
    of_anchors, of_rows = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # both come from one table: columns of their own keep the sides apart
    rows = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns]).toDF(*rows.columns)
    left = anchors.withColumn("_a", block(of_anchors)).withColumn("_r", every(of_rows))
    right = rows.withColumn("_r", block(of_rows)).withColumn("_a", every(of_anchors))
    grouped = left.groupBy("_a", "_r").cogroup(right.groupBy("_a", "_r"))

    nothing = pa.schema([(f.name, pa.int32() if f.name == "positive" else pa.int64()) for f in T.StructType.fromDDL(_FOUND)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return compare(left, right) if left.num_rows and right.num_rows else nothing.empty_table()

    return grouped.applyInArrow(run, _FOUND)


def _ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, scale: int = SCALE,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for
    each row where ``anchors`` is true and each of its ``positives`` best other rows of the
    same label, the first ``negatives`` rows of other labels whose score is from ``band[0]``
    to ``band[1]`` percent of the positive's."""
    spark = rows.sparkSession
    bounded_batches(spark)
    stored = Stored(spark)
    usable = F.col(vector).isNotNull() & F.col(label).isNotNull()
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    plain = rows.where(usable & finite).select(
        F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    dim = plain.agg(F.max(F.size("vector"))).first()[0] or 0
    coded, n_rows = stored.write(plain.mapInArrow(lambda it: _coded(it, dim, scale), _CODED))
    chosen = coded.where("anchor")
    n_anchors = chosen.count()
    kept = ["row", "id", "label", "x", "code", "align", "rest"]

    def same(left: pa.Table, right: pa.Table) -> pa.Table:
        coder = Coder(dim)
        a, r = Rows(left, coder, dim), Rows(right, coder, dim)
        i, j, s = best_same(a, r, coder, positives)
        return _found(a, r, i, np.zeros(len(i), np.int32), j, s)

    near = _ranked(_in_blocks(chosen.select(*kept), coded.select(*kept), n_anchors, n_rows, same), ["row"], positives)
    near = stored.table(near.select("row", (F.col("rank") - 1).alias("positive"), "other_id", "score"))
    # at most ``positives`` to a row
    lists = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("positive", "score"))).alias("list"))
    wanted = chosen.select(*kept).join(lists.select("row", F.transform("list", lambda p: p["score"]).alias("positives")), "row")

    def banded(left: pa.Table, right: pa.Table) -> pa.Table:
        coder = Coder(dim)
        a, r = Rows(left, coder, dim), Rows(right, coder, dim)
        positive = np.full((left.num_rows, positives), np.iinfo(np.int64).min)
        for k, values in enumerate(left["positives"].to_pylist()):
            positive[k, : len(values)] = values
        i, p, j, s = best_banded(a, r, coder, positive, negatives, band)
        return _found(a, r, i, p, j, s)

    found = _ranked(_in_blocks(wanted, coded.select(*kept), n_anchors, n_rows, banded), ["row", "positive"], negatives)
    pairs = near.select("row", "positive", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["row", "positive"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
