"""Isolation forest on log amounts.

Only one feature is split on, so a row's score depends on nothing but where its
log amount falls. The log axis is cut into equal cells and the trees split on
cell edges. That turns the method into three bounded steps:

* count the ledger by cell (one partially combined aggregate, at most
  ``forest_cells`` groups, a few hundred kilobytes whatever the ledger's size);
* grow the trees, one task per share of the trees, each drawing its rows without
  replacement from those counts;
* look every row's score up by cell in a small broadcast table.

All draws are MD5 hashes of (seed, tree, what is drawn), so the trees depend on the
counts and the seed alone: the result is the same for any partitioning, any order of
rows and any other engine. A tree's rows are one of each of ``max_samples`` equal runs
of the ranks by cell; an inner node draws its edge by depth and first cell. Path lengths
are added as whole billionths, so their sums are exact in any order. Scores are
unchanged by shifting or scaling the feature, so the z-score is not applied before
cutting cells.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_analytics.config import AnalysisConfig
from ledger_analytics.operators.profile import LedgerProfile

# broadcast the lookup only while its (configured) size stays a few megabytes
_BROADCAST_CELLS = 1 << 18


def _mean_search_path(n: np.ndarray | int) -> np.ndarray:
    """Average depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


#: Path lengths are kept in this unit.
_PATH_UNIT = 1_000_000_000


def _draw(*parts: int | str) -> int:
    """A number of 52 bits, by hash."""
    return int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def _sample(n: int, take: int, seed: int, tree: int) -> np.ndarray:
    """``take`` distinct ranks below ``n``, ascending: one of each of as many equal runs."""
    edges = [i * n // take for i in range(take + 1)]
    return np.array([lo + _draw(seed, tree, "row", i) % (hi - lo) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])


def _grow(points: np.ndarray, max_depth: int, seed: int, tree: int) -> list[tuple[int, int]]:
    """Leaves of one tree over sorted cell numbers, as (first cell, path length in billionths)."""
    leaves: list[tuple[int, int]] = []
    todo = [(0, len(points), 0, 0)]  # slice of points, depth, first cell covered
    while todo:
        start, stop, depth, cell = todo.pop()
        low, high = (int(points[start]), int(points[stop - 1])) if stop > start else (0, 0)
        if stop - start <= 1 or depth >= max_depth or low == high:
            below = math.floor(float(_mean_search_path(stop - start)) * _PATH_UNIT + 0.5)
            leaves.append((cell, depth * _PATH_UNIT + below))
            continue
        edge = low + 1 + _draw(seed, tree, depth, cell) % (high - low)
        middle = start + int(np.searchsorted(points[start:stop], edge))
        todo.append((middle, stop, depth + 1, edge))
        todo.append((start, middle, depth + 1, cell))
    return leaves


@dataclass(frozen=True)
class ForestModel:
    min_log: float
    max_log: float
    cells: int
    scores: pd.DataFrame  # cell, raw_score, isolation_score, is_outlier

    def cell(self, amount: Column) -> Column:
        return _cell(amount, self.min_log, self.max_log, self.cells)


def _cell(amount: Column, low: float, high: float, cells: int) -> Column:
    if high <= low:
        return F.lit(0)
    at = F.floor((F.log1p(amount) - low) / (high - low) * cells)
    return F.greatest(F.least(at, F.lit(cells - 1)), F.lit(0)).cast("int")


def _path_lengths(spark: SparkSession, counts: pd.DataFrame, cfg: AnalysisConfig) -> np.ndarray:
    """Average path length of every occupied cell."""
    cells = counts["cell"].to_numpy()
    upto = counts["n"].to_numpy().cumsum()
    n = int(upto[-1])
    take = min(cfg.max_samples, n)
    max_depth = math.ceil(math.log2(take)) if take > 1 else 0
    seed = cfg.random_seed

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for trees in batches:
            for tree in trees["id"]:
                points = cells[np.searchsorted(upto, _sample(n, take, seed, int(tree)), side="right")]
                leaves = _grow(points, max_depth, seed, int(tree))
                yield pd.DataFrame(leaves, columns=["cell", "path"]).assign(tree=int(tree))

    slices = max(1, min(cfg.n_estimators, spark.sparkContext.defaultParallelism))
    leaves = (
        spark.range(0, cfg.n_estimators, 1, slices)
        .mapInPandas(fit, "cell int, path long, tree long")
        .toArrow()  # at most n_estimators * max_samples leaves
        .to_pandas()
        .sort_values(["tree", "cell"], kind="stable")
    )
    # each tree is a step function of the cell; sum the steps of all trees
    path, tree = leaves["path"].to_numpy(), leaves["tree"].to_numpy()
    first = np.r_[True, tree[1:] != tree[:-1]]
    step = np.where(first, path, path - np.r_[0, path[:-1]])
    edges = leaves["cell"].to_numpy()
    order = np.argsort(edges, kind="stable")
    total = np.cumsum(step[order])
    at = np.searchsorted(edges[order], cells, side="right") - 1
    return total[at] / (cfg.n_estimators * _PATH_UNIT)


def fit_forest(
    ledger: DataFrame, profile: LedgerProfile, config: AnalysisConfig = AnalysisConfig()
) -> ForestModel:
    low, high, cells = profile.min_log, profile.max_log, config.forest_cells
    counts = (
        ledger.groupBy(_cell(F.col("amount"), low, high, cells).alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"))
        .toArrow()  # at most forest_cells rows
        .to_pandas()
        .sort_values("cell", ignore_index=True)
    )
    empty = pd.DataFrame(
        {"cell": [], "raw_score": [], "isolation_score": [], "is_outlier": []}
    ).astype({"cell": "int32", "raw_score": "float64", "isolation_score": "int32", "is_outlier": bool})
    if counts.empty:
        return ForestModel(low, high, cells, empty)
    n = int(counts["n"].sum())
    if n == 1:  # one row cannot be isolated from anything
        only = pd.DataFrame(
            {"cell": [0], "raw_score": [None], "isolation_score": [0], "is_outlier": [False]}
        )
        return ForestModel(low, high, cells, only.astype(empty.dtypes.to_dict()))

    paths = _path_lengths(ledger.sparkSession, counts, config)
    norm = float(_mean_search_path(min(config.max_samples, n)))
    raw = np.power(2.0, -paths / norm)

    # score of the row at rank floor(contamination * n), counted from the top
    rank = math.floor(config.contamination * n)
    down = np.argsort(-raw, kind="stable")
    seen = np.cumsum(counts["n"].to_numpy()[down])
    threshold = raw[down][np.searchsorted(seen, rank, side="right")] if rank < n else 0.0

    spread = raw.max() - raw.min()
    risk = np.floor((raw - raw.min()) / spread * 100 + 0.5) if spread > 0 else np.zeros_like(raw)
    scores = pd.DataFrame(
        {
            "cell": counts["cell"].astype("int32"),
            "raw_score": raw,
            "isolation_score": risk.astype("int32"),
            "is_outlier": raw >= threshold,
        }
    )
    return ForestModel(low, high, cells, scores)


def with_isolation(ledger: DataFrame, model: ForestModel) -> DataFrame:
    """Add raw_score, isolation_score, is_outlier."""
    spark = ledger.sparkSession
    scores = spark.createDataFrame(
        pa.Table.from_pandas(model.scores, preserve_index=False),
        "cell int, raw_score double, isolation_score int, is_outlier boolean",
    )
    if len(model.scores) <= _BROADCAST_CELLS:
        scores = F.broadcast(scores)
    return (
        ledger.withColumn("cell", model.cell(F.col("amount"))).join(scores, "cell", "left").drop("cell")
    )
