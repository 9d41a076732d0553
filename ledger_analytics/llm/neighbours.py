"""Near-duplicate embeddings with an inverted multi-index.

Vectors are scaled to length one and cut into two halves, and each half has a codebook of
its own; a pair of code words is a cell of the product grid. Every distinct vector is filed
in its nearest cell, and visits cells in order of the summed distances of their code words
(the multi-sequence order). How many cells it visits is measured: blocks of vectors are
compared with all until ``PARTNERED`` of them have a partner, and as many cells are visited
as hold ``RECALL`` of the partners. Where ``MOST_QUERIES`` vectors have too few, partners are
too rare to measure, and each vector visits all cells that a partner can be in by distance.
Vectors that meet in a cell are verified by cosine in double precision.

Equal vectors are merged before all this and expanded after it, so a group of copies costs
one vector. Cells are worked off in blocks of ``BLOCK`` members by ``BLOCK`` visitors; a
block returns sums of links and a spanning set of edges, never its pairs.

The codebooks are fitted on at most ``SAMPLE`` vectors and the visits on at most
``MOST_QUERIES``, the first by hash. Links are only sought between equal labels.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and those without a label, link with nothing; vectors of different lengths do not link;
repeated ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_analytics.llm.graph import components, spanning_pairs
from ledger_analytics.llm.storage import Stored

COSINE = 0.93
RECALL = 0.995
SAMPLE = 8192
#: Vectors compared with all at a time, vectors with a partner that are wanted among them,
#: and how many are tried for that.
QUERIES = 512
PARTNERED = 64
MOST_QUERIES = 1 << 16
BLOCK = 2048
#: Members that a cell has on average, of the label with most vectors.
PER_CELL = 8
MAX_WORDS = 256


# --- index ---------------------------------------------------------------------


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Code words of the rows of ``x``; starts from rows spread over the sample."""
    k = min(k, len(x))
    words = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, words).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None]


class MultiIndex:
    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right

    @property
    def cells(self) -> int:
        return len(self.left) * len(self.right)

    def order(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The first ``visits`` cells of each row, nearest first. A cell whose code words
        are at ranks i and j of their codebooks comes after (i + 1)(j + 1) - 1 others, so
        only ranks with a product up to ``visits`` are looked at."""
        half = self.left.shape[1]
        a, b = _distances(x[:, :half], self.left), _distances(x[:, half:], self.right)
        ia, ib = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
        i, j = np.divmod(np.arange(self.cells), len(self.right))
        near = (i + 1) * (j + 1) <= visits
        i, j = i[near], j[near]
        first = np.argsort(a[:, i] + b[:, j], axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(ia, i[first], 1) * len(self.right) + np.take_along_axis(ib, j[first], 1)


    def reachable(self, x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home of each row, and (row, cell) for every cell that a vector at ``cosine`` or
        more can have as its home. A point that is nearer to code word i than to k is at least
        (d_i - d_k) / (2 |w_i - w_k|) away, with d the squared distances from the row."""
        half = self.left.shape[1]
        apart, home = [], []
        for part, words in ((x[:, :half], self.left), (x[:, half:], self.right)):
            d = _distances(part, words)
            between = 2 * np.sqrt(np.maximum(_distances(words, words), 0))
            least = np.zeros_like(d)
            for k in range(len(words)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    bound = (d - d[:, k : k + 1]) / between[k]
                bound[:, between[k] < 1e-6] = 0  # the same word
                np.maximum(least, bound, out=least)
            apart.append(least * least)
            home.append(d.argmin(axis=1))
        far = 2 - 2 * cosine + 1e-9
        row, i, j = np.nonzero(apart[0][:, :, None] + apart[1][:, None, :] <= far)
        return home[0] * len(self.right) + home[1], row, i * len(self.right) + j


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of length one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(embedding: str, label: str) -> Column:
    e = F.col(embedding)
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda v: v != 0), F.lit(False))


def _by_hash(distinct: DataFrame, seed: int) -> DataFrame:
    return distinct.orderBy(F.xxhash64("uid", F.lit(seed)), "uid")


def _visits(distinct: DataFrame, queries: DataFrame, index: MultiIndex, cosine: float, recall: float) -> int | None:
    """Cells to visit so that a vector finds ``recall`` of its partners, on average over vectors
    of ``queries`` that have partners, or None if too few of them were found. If all vectors were compared
    with all, and few have partners, the cells that hold every partner."""
    shares: dict[int, float] = {}
    partnered = looked = 0
    ask = QUERIES
    while partnered < PARTNERED and looked < MOST_QUERIES:
        ask = min(ask, MOST_QUERIES - looked)
        rows = _by_hash(queries, 5).offset(looked).limit(ask).collect()
        looked += len(rows)
        if rows:
            for rank, share, _ in (found := _partners(distinct, index, rows, cosine)):
                shares[rank] = shares.get(rank, 0.0) + share
            partnered += len({q for *_, qs in found for q in qs})
        if len(rows) < ask:
            if partnered < PARTNERED:
                return max(shares, default=0) + 1
            break
        ask = min(2 * ask, 8 * QUERIES)
    if partnered < PARTNERED:
        return None
    ranks = sorted(shares)
    sums = np.cumsum([shares[r] for r in ranks])
    return ranks[min(int(np.searchsorted(sums, recall * sums[-1])), len(ranks) - 1)] + 1


def _partners(distinct: DataFrame, index: MultiIndex, rows: list, cosine: float) -> list:
    """(rank, share, queries): for each rank among a query's cells, the sum over the queries
    ``rows`` of the share of their partners that is there, and the queries that have some."""
    uid, group = np.array([r["uid"] for r in rows]), np.array([r["group"] for r in rows])
    q = _matrix(pa.array([r["vec"] for r in rows], pa.list_(pa.float64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], int] = {}  # query, cell
        for batch in batches:
            ids, groups = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = _matrix(batch.column(2))
            home = index.order(x, 1)[:, 0]
            for at in range(0, len(q), QUERIES):
                part = slice(at, at + QUERIES)
                i, j = np.nonzero((q[part] @ x.T >= cosine) & (group[part, None] == groups[None]) & (uid[part, None] != ids[None]))
                for key, n in zip(*np.unique(np.stack([i + at, home[j]], 1), axis=0, return_counts=True)):
                    met[tuple(key.tolist())] = met.get(tuple(key.tolist()), 0) + int(n)
        keys = sorted(met)
        ranks, last = [], -1
        for i, cell in keys:
            if i != last:
                rank, last = np.argsort(index.order(q[i : i + 1], index.cells)[0]), i
            ranks.append(int(rank[cell]))
        arrays = [pa.array([k[0] for k in keys], pa.int32()), pa.array(ranks, pa.int32()), pa.array([met[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["q", "rank", "n"])

    met = distinct.select("uid", "group", "vec").mapInArrow(run, "q int, rank int, n long")
    met = met.groupBy("q", "rank").agg(F.sum("n").alias("n"))
    total = met.groupBy("q").agg(F.sum("n").alias("of"))
    share = met.join(total, "q").groupBy("rank").agg(F.sum(F.col("n") / F.col("of")).alias("s"), F.collect_set("q").alias("qs"))
    return [(r["rank"], r["s"], r["qs"]) for r in share.collect()]


# --- verification --------------------------------------------------------------


def _block(v: dict, m: dict, cosine: float) -> tuple[np.ndarray, ...]:
    """Link sums of visitors and members of one block, and spanning edges (visitor, member)."""
    near = v["x"] @ m["x"].T >= cosine
    near &= v["uid"][:, None] != m["uid"][None]
    # a pair that also meets the other way round is counted once
    for home in np.unique(v["home"]):
        rows = np.flatnonzero(v["home"] == home)
        both = np.bincount(m["of"][m["visits"] == home], minlength=len(m["uid"])) > 0
        near[np.ix_(rows, np.flatnonzero(both))] &= v["uid"][rows][:, None] < m["uid"][both][None]
    i, j = np.nonzero(near)
    n = len(v["uid"])
    a, b = spanning_pairs(n + len(m["uid"]), i, j + n)
    ids = np.concatenate([v["uid"], m["uid"]])
    return near @ m["n"], v["n"] @ near, ids[a], ids[b]


def _verify(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, members first."""

    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        member = t["member"].to_numpy(zero_copy_only=False)
        if member.all() or not member.any():
            return
        x = _matrix(t["vec"])
        columns = {c: t[c].to_numpy(zero_copy_only=False) for c in ("uid", "home", "n")}
        side = lambda k: {"x": x[k], **{c: a[k] for c, a in columns.items()}}
        v, m = side(~member), side(member)
        visits = t["visits"].filter(pa.array(member)).combine_chunks()
        m["visits"] = visits.flatten().to_numpy(zero_copy_only=False)
        m["of"] = np.repeat(np.arange(len(visits)), visits.value_lengths().to_numpy(zero_copy_only=False))
        sum_v, sum_m, a, b = _block(v, m, cosine)
        uid, n = np.concatenate([v["uid"], m["uid"]]), np.concatenate([sum_v, sum_m])
        uid, n = uid[n > 0], n[n > 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([uid, a])), pa.array(np.concatenate([uid, b])), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)]))],
            names=["a", "b", "n"],
        )

    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        block = batch.column(batch.schema.get_field_index("block")).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and block[a] != key:
                yield from flush(held)
                held = []
            key = block[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield from flush(held)


def _blocks(filed: DataFrame) -> DataFrame:
    """Members and visitors of each cell, dealt into blocks of bounded size."""
    members = filed.select("group", F.col("home").alias("cell"), F.lit(True).alias("member"), "uid", "home", "n", "vec", "visits")
    visitors = filed.select("group", F.explode("visits").alias("cell"), F.lit(False).alias("member"), "uid", "home", "n", "vec")
    visitors = visitors.withColumn("visits", F.array().cast("array<int>"))  # only those of members are asked for
    cell = ["group", "cell"]
    sizes = filed.groupBy("group", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m_parts"))
    guests = filed.select("group", F.explode("visits").alias("cell")).groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("v_parts"))
    parts = sizes.join(guests, cell)  # cells without members are not visited
    own, other = F.when(F.col("member"), F.col("m_parts")).otherwise(F.col("v_parts")), F.when(F.col("member"), F.col("v_parts")).otherwise(F.col("m_parts"))
    dealt = members.unionByName(visitors).join(parts, cell)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("uid", F.lit(3)), own).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    m, v = F.when(F.col("member"), F.col("own")).otherwise(F.col("other")), F.when(F.col("member"), F.col("other")).otherwise(F.col("own"))
    return dealt.select(F.xxhash64(*cell, m, v).alias("block"), "member", "uid", "home", "n", "vec", "visits")


def _links_of(distinct: DataFrame, stored: Stored, cosine: float, recall: float) -> DataFrame:
    """(a, b, n): with a = b the link sum n of a, else an edge. Vectors of one length."""
    # cells are shared by all labels, and the label with most vectors fills them most
    largest = distinct.groupBy("group").agg(F.count("*").alias("rows")).agg(F.max("rows")).first()[0]
    sample = _by_hash(distinct, 4).limit(SAMPLE).select("vec").collect()
    x = _matrix(pa.array([r["vec"] for r in sample], pa.list_(pa.float64())))
    half = x.shape[1] // 2

    def indexed(per_cell: int) -> MultiIndex:
        words = int(np.clip(np.ceil(np.sqrt(largest / per_cell)), 2, MAX_WORDS))
        return MultiIndex(k_means(x[:, :half], words), k_means(x[:, half:], words))

    index = indexed(PER_CELL)
    queries = stored.table(_by_hash(distinct, 5).limit(MOST_QUERIES).select("uid", "group", "vec"))
    visits = _visits(distinct, queries, index, cosine, recall)
    if visits is None:
        index = indexed(BLOCK)  # many cells are in reach: fewer and larger ones

    def cells_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home of each row, and the cells it visits with their number by row."""
        if visits is not None:
            order = index.order(x, visits)
            return order[:, 0], order.ravel(), np.full(len(x), order.shape[1])
        # partners reach each other's homes, so the one with the lower home goes
        home, row, cell = index.reachable(x, cosine)
        go = cell >= home[row]
        return home, cell[go], np.bincount(row[go], minlength=len(x))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for a in range(0, batch.num_rows, 64 if visits is None else batch.num_rows):
                some = batch.slice(a, 64) if visits is None else batch
                home, cell, n = cells_of(_matrix(some.column(some.schema.get_field_index("vec"))))
                at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(at, pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(home.astype(np.int32)), lists], names=[*some.schema.names, "home", "visits"]
                )

    kind = distinct.schema["vec"].dataType.simpleString()
    filed = stored.table(
        distinct.select("uid", "group", "n", "vec").mapInArrow(file, f"uid long, group long, n long, vec {kind}, home int, visits array<int>")
    )
    blocks = _blocks(filed).repartition("block").sortWithinPartitions("block", F.desc("member"), "uid")
    return blocks.mapInArrow(lambda it: _verify(it, cosine), "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    cosine: float = COSINE, recall: float = RECALL,
) -> DataFrame:
    """``vectors`` with ``n_links`` and ``component_id`` (the smallest id reachable)."""
    stored = Stored(vectors.sparkSession)
    kept = [c for c in vectors.columns if c not in ("n_links", "component_id")]
    ok = usable(embedding, label)
    rows = vectors.select(*kept).withColumn("_uid", F.when(ok, F.xxhash64(label, embedding)))
    distinct = stored.table(
        rows.where("_uid IS NOT NULL")
        .select(F.col("_uid").alias("uid"), F.xxhash64(label, F.size(embedding)).alias("group"), F.col(embedding).alias("vec"), F.col(vec_id).alias("id"))
        .groupBy("uid", "group", "vec").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    )
    found = None
    for r in distinct.select(F.size("vec").alias("d")).distinct().orderBy("d").collect():
        part = _links_of(distinct.where(F.size("vec") == r["d"]), stored, cosine, recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(*kept, F.lit(0).cast("long").alias("n_links"), F.col(vec_id).alias("component_id"))
    found = stored.table(found)
    sums = found.where("a = b").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("links"))
    root = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "uid")
    state = distinct.select("uid", "n", "first_id").join(sums, "uid", "left").join(root, "uid", "left")
    state = state.withColumn("root", F.coalesce("root", "uid"))
    lowest = state.groupBy("root").agg(F.min("first_id").alias("lowest"))
    state = state.join(lowest, "root").select(
        F.col("uid").alias("_uid"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("lowest").alias("component_id")
    )
    return rows.join(state, "_uid", "left").select(
        *kept, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", vec_id).alias("component_id")
    )
