"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they belong to.
Tokens flow from patterns to the quotas of their sources; the first copy of a pattern's
tokens is free and each further copy costs more than the one before, so the flow repeats
as little as the targets allow. Then each pattern's tokens are taken from its documents in
seeded order: so many whole copies of all, and one more of the documents that fit. The first
that does not fit ends a run of hashes; behind it the order goes on with documents that are
no larger than what is left, and so forth. Where a run ends is found from sums per hash
bucket, level by level until the bucket is small. A gap that is not small in the end, as in
sources of few documents, is closed by choosing a bounded number of documents anew.

Defined results: a null text has size 0; no source is a source like any other, last in
order; rows alike in id and size are taken alike. The flow runs on the driver over patterns and
sources, which are metadata: their number is checked against ``MAX_PATTERNS`` and more is
an error, never a cut.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_analytics.llm.columns import Numbered, with_spare
from ledger_analytics.llm.storage import Stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
SEED = 42
MAX_PATTERNS = 4_000
#: Bits of the seeded hash by which buckets are parted at each level, and rows of a bucket
#: that are sorted.
BUCKET_BITS, BUCKET_ROWS = 13, 50_000
#: Bounds of classes of large documents, as percentages of what is wanted.
SIZE_CLASSES = (1, 4, 16, 64)
#: Share of what is wanted that may be missed.
LEFT_OVER = 0.001
#: Documents of a pattern that are chosen anew to come nearer.
EXCHANGED = 48


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, repeats: float = MAX_REPEATS) -> dict:
    """Target of each source: ``share`` of all sizes dealt by weight (sources by code point,
    none last, weights repeating); no target is above ``repeats`` times its source's size,
    and what is above goes to the others by weight until none is."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict = {}
    left, open_ = share * sum(sizes.values()), order
    while open_:
        total = sum(weight[s] for s in open_)
        dealt = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if dealt[s] > repeats * sizes[s]]
        if not full:
            out.update(dealt)
            break
        for s in full:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


@dataclass
class _Edge:
    to: int
    room: int
    cost: int


def route(patterns: list[tuple[frozenset, int]], quotas: dict, repeats: int = MAX_REPEATS) -> list[int]:
    """Tokens taken from each pattern (sources, size) by the cheapest largest flow to ``quotas``.

    Successive cheapest augmenting paths. Only the copies of a pattern have a cost (0 for
    the first, 1, 2, ... for further ones), so paths are searched level by level of cost.
    """
    source_at = {s: 2 + len(patterns) + i for i, s in enumerate(quotas)}
    graph: list[list[_Edge]] = [[] for _ in range(2 + len(patterns) + len(quotas))]
    ends: list[tuple[int, int]] = []

    def link(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append(_Edge(b, room, cost))
        graph[b].append(_Edge(a, 0, -cost))
        ends.append((len(graph[a]) - 1, len(graph[b]) - 1))

    back: dict[tuple[int, int], tuple[int, int]] = {}

    def join(a: int, b: int, room: int, cost: int) -> None:
        link(a, b, room, cost)
        i, j = ends[-1]
        back[(a, i)], back[(b, j)] = (b, j), (a, i)

    for p, (names, size) in enumerate(patterns):
        for copy in range(repeats):
            join(0, 2 + p, size, copy)
        for s in names:
            join(2 + p, source_at[s], repeats * size, 0)
    for s, quota in quotas.items():
        join(source_at[s], 1, quota, 0)

    while True:
        cost, came = {0: 0}, {}
        queue = [0]
        while queue:  # cheapest paths; edge costs may be negative on the way back
            after = []
            for a in queue:
                for i, e in enumerate(graph[a]):
                    if e.room and cost[a] + e.cost < cost.get(e.to, 1 << 60):
                        cost[e.to], came[e.to] = cost[a] + e.cost, (a, i)
                        after.append(e.to)
            queue = list(dict.fromkeys(after))
        if 1 not in cost:
            break
        path, at = [], 1
        while at:
            a, i = came[at]
            path.append((a, i))
            at = a
        flow = min(graph[a][i].room for a, i in path)
        for a, i in path:
            b, j = back[(a, i)]
            graph[a][i].room -= flow
            graph[b][j].room += flow
    taken = []
    for p, (_, size) in enumerate(patterns):
        unused = sum(e.room for e in graph[0] if e.to == 2 + p)
        taken.append(repeats * size - unused)
    return taken


def with_mix(
    docs: DataFrame, memberships: Column, doc_id: str = "doc_id", text: str = "text", weights=WEIGHTS,
    share: float = SHARE, repeats: int = MAX_REPEATS, seed: int = SEED, max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """``docs`` with ``size`` (words), ``copies`` and ``taken`` (words, repeats counted), and
    maps ``source_sizes`` and ``source_targets`` of the document's sources. Old columns of
    these names give way. The size of a source is that of all documents in it."""
    made = ("size", "copies", "taken", "source_sizes", "source_targets")
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(
        *kept, n_words(text).alias("size"), F.array_sort(F.array_distinct(memberships)).alias("_in"),
        F.xxhash64(F.lit(seed), doc_id).alias("_h"),
    )
    rows = rows.withColumn("_pattern", F.to_json("_in"))
    stored = Stored(docs.sparkSession)
    narrow = stored.table(rows.select("_pattern", "size", "_h"))
    sums = narrow.groupBy("_pattern").agg(F.sum("size").alias("n"))
    found = [(r["_pattern"], json.loads(r["_pattern"]), r["n"]) for r in sums.limit(max_patterns + 1).collect()]
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    found.sort()
    sizes: dict = {}
    for _, names, n in found:
        for s in names:
            sizes[s] = sizes.get(s, 0) + n
    target = targets(sizes, weights, share, repeats)
    taken = route([(frozenset(names), n) for _, names, n in found], {s: round(t) for s, t in target.items()}, repeats)
    plan = []
    for (pattern, names, n), flow in zip(found, taken):
        whole, rest = divmod(flow, n) if n else (0, 0)
        plan.append((pattern, whole, rest, [(s, sizes[s], float(target[s])) for s in names]))
    runs, swaps = _chosen(narrow, {pattern: rest for pattern, _, rest, _ in plan if rest})
    plan = [(pattern, whole, of, runs.get(pattern, []), swaps.get(pattern, [])) for pattern, whole, _, of in plan]
    schema = (
        "_pattern string, whole long, of array<struct<source: string, size: long, target: double>>, "
        f"runs {_RUNS}, swaps array<struct<h: long, size: long>>"
    )
    # one row per pattern, at most max_patterns, with a run per round
    out = rows.join(F.broadcast(docs.sparkSession.createDataFrame(plan, schema)), "_pattern")
    stored.keep()
    swapped = F.exists("swaps", lambda x: (x["h"] == F.col("_h")) & (x["size"] == F.col("size")))
    copies = (F.col("whole") + (_in_a_run() != swapped).cast("int")).cast("int")
    return out.select(
        *kept, "size", copies.alias("copies"), (F.col("size") * copies).alias("taken"),
        F.transform("of", lambda s: F.struct(s["source"].alias("source"), s["size"].alias("size"))).alias("source_sizes"),
        F.transform("of", lambda s: F.struct(s["source"].alias("source"), s["target"].alias("target"))).alias("source_targets"),
    )


_LAST = (1 << 63) - 1
_RUNS = "array<struct<after: long, upto: long, least: long, most: long>>"
_STATE = "_pattern string, after long, room long, least long, most long, bucket long, before long"


def _in_a_run() -> Column:
    behind = lambda r: r["after"].isNull() | (F.col("_h") > r["after"])
    return F.exists("runs", lambda r: behind(r) & (F.col("_h") <= r["upto"]) & (F.col("size") > r["least"]) & (F.col("size") <= r["most"]))


def _chosen(narrow: DataFrame, rest: dict[str, int]) -> tuple[dict[str, list], dict[str, list]]:
    """Per pattern: runs (after, upto, least, most) of hashes, in which documents of over
    ``least`` and up to ``most`` words are taken, and if what is left then is not small, the
    documents (hash, size) that are taken or left against that: some ``EXCHANGED`` documents,
    the first by another hash, are chosen anew so that the sum is as near as they allow.

    Documents that are large against what is wanted come first, by classes of size, each
    class in proportion to its words, and in any case so much that the smaller ones can fill
    the rest. In a large corpus no document is large in this sense.
    """
    if not rest:
        return {}, {}
    spark = narrow.sparkSession
    bounds = {p: [0, *(n * share // 100 for share in SIZE_CLASSES), n] for p, n in rest.items()}
    frame = spark.createDataFrame([(p, b) for p, b in bounds.items()], "_pattern string, bounds array<long>")
    held = narrow.join(F.broadcast(frame), "_pattern").where((F.col("size") > 0) & (F.col("size") <= F.element_at("bounds", -1)))
    held = held.withColumn("class", F.size(F.filter("bounds", lambda b: b < F.col("size"))) - 1)
    # at most a row for each pattern and class
    found = held.groupBy("_pattern", "class").agg(F.sum("size").alias("n"), F.max("size").alias("largest")).collect()
    words = {(r["_pattern"], r["class"]): (r["n"], r["largest"]) for r in found}
    gap, runs = dict(rest), {p: [] for p in rest}

    def take(wanted: dict[str, tuple]) -> dict[str, tuple[int, int]]:
        ends = _longest_runs(narrow, wanted)
        for p, (upto, taken) in ends.items():
            after, _, least, most = wanted[p]
            runs[p].append((after, upto, least, most))
            gap[p] -= taken
        return ends

    for k in range(len(SIZE_CLASSES), 0, -1):
        smaller = {p: sum(words.get((p, j), (0, 0))[0] for j in range(k)) for p in rest}
        here = [p for p in rest if (p, k) in words and gap[p] > 0]
        room = {p: max(gap[p] * (n := words[p, k][0]) // (n + smaller[p]), gap[p] - smaller[p]) for p in here}
        ends = take({p: (None, min(room[p], gap[p]), bounds[p][k], bounds[p][k + 1]) for p in here})
        lacking = [p for p in here if gap[p] > smaller[p] and ends[p][0] < _LAST]
        take({p: (ends[p][0], min(gap[p], gap[p] - smaller[p] + words[p, k][1]), bounds[p][k], bounds[p][k + 1]) for p in lacking})
    after: dict = {}
    open_ = {p for p in rest if gap[p] > 0}
    while open_:
        wanted = {p: (after.get(p), gap[p], 0, min(bounds[p][1], gap[p]) if p in after else bounds[p][1]) for p in open_}
        for p, (upto, taken) in take(wanted).items():
            after[p] = upto
            nothing_fits = not taken and wanted[p][3] <= gap[p]
            if nothing_fits or upto == _LAST or gap[p] <= LEFT_OVER * rest[p]:
                open_.discard(p)
    left = [(p, rest[p], runs[p]) for p, g in gap.items() if g > LEFT_OVER * rest[p]]
    if not left:
        return runs, {}
    state = spark.createDataFrame(left, f"_pattern string, rest long, runs {_RUNS}")
    some = narrow.join(F.broadcast(state), "_pattern").where((F.col("size") > 0) & (F.col("size") <= F.col("rest")))
    some = some.groupBy("_pattern", "_h", "size", _in_a_run().alias("taken")).agg(F.sum("size").alias("n"))
    order = F.row_number().over(Window.partitionBy("_pattern").orderBy(F.xxhash64("_h", "size"), "_h", "size"))
    near: dict[str, list] = {}
    for r in some.withColumn("nth", order).where(F.col("nth") <= EXCHANGED).collect():
        near.setdefault(r["_pattern"], []).append(r)
    swaps = {}
    for p, rows in near.items():
        chosen = nearest_subset([r["n"] for r in rows], sum(r["n"] for r in rows if r["taken"]) + gap[p])
        swaps[p] = [(r["_h"], r["size"]) for r, x in zip(rows, chosen) if x != r["taken"]]
    return runs, swaps


def nearest_subset(sizes: list[int], target: int) -> list[bool]:
    """Which of ``sizes`` to take for a sum as near to ``target`` as possible."""
    sums = [1]  # bit s: some of the first sizes have the sum s
    for n in sizes:
        sums.append(sums[-1] | sums[-1] << n)
    miss = next(d for d in range(max(target, sum(sizes)) + 1) if (d <= target and sums[-1] >> (target - d) & 1) or sums[-1] >> (target + d) & 1)
    at = target - miss if miss <= target and sums[-1] >> (target - miss) & 1 else target + miss
    taken = [False] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        if not sums[i] >> at & 1:
            taken[i], at = True, at - sizes[i]
    return taken


def _of_size(narrow: DataFrame, state: list[tuple]) -> DataFrame:
    frame = narrow.sparkSession.createDataFrame(state, _STATE)
    return narrow.join(F.broadcast(frame), "_pattern").where("size > least AND size <= most AND (after IS NULL OR _h > after)")


def _longest_runs(narrow: DataFrame, wanted: dict[str, tuple]) -> dict[str, tuple[int, int]]:
    """Per pattern of ``wanted`` (after, room, least, most): the hash up to which all documents
    of over ``least`` and up to ``most`` words behind ``after`` fit into ``room``, and their words."""
    out: dict[str, tuple[int, int]] = {}
    state = [(p, *w, None, 0) for p, w in wanted.items()]
    bits = 0
    while state:
        rows = _of_size(narrow, state)
        if bits:
            rows = rows.where(F.shiftright("_h", 64 - bits) == F.col("bucket"))
        bits = min(64, bits + BUCKET_BITS)
        key = F.shiftright("_h", 64 - bits) if bits < 64 else F.col("_h")
        # at most 2 ** BUCKET_BITS rows a pattern
        sums = rows.groupBy("_pattern", "room", "before", key.alias("key")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        running = sums.withColumn("sum", F.col("before") + F.sum("n").over(Window.partitionBy("_pattern").orderBy("key")))
        over = F.col("sum") > F.col("room")
        found = running.groupBy("_pattern").agg(
            F.min(F.when(over, F.struct("key", "rows"))).alias("cut"), F.max(F.when(~over, F.struct("sum", "key"))).alias("fits")
        )
        cuts = {r["_pattern"]: r for r in found.collect()}
        again = []
        for p, *rest, before in state:
            r = cuts.get(p)
            fits = r["fits"]["sum"] if r and r["fits"] else before
            if r is None or r["cut"] is None:  # all fit, or there are none
                out[p] = (_LAST, fits)
            elif bits == 64:
                out[p] = (max(r["cut"]["key"] - 1, -_LAST - 1), fits)
            else:
                again.append(((p, *rest[:-1], r["cut"]["key"], fits), r["cut"]["rows"]))
        small = [x for x, n in again if n <= BUCKET_ROWS]
        if small:
            out |= _inside(narrow, small, bits)
        state = [x for x, n in again if n > BUCKET_ROWS]
    return out


def _inside(narrow: DataFrame, state: list[tuple], bits: int) -> dict[str, tuple[int, int]]:
    """The end of the run of each pattern inside of its bucket."""
    rows = _of_size(narrow, state).where(F.shiftright("_h", 64 - bits) == F.col("bucket"))
    rows = rows.groupBy("_pattern", "_h", "room", "before").agg(F.sum("size").alias("n"))
    rows = rows.withColumn("sum", F.col("before") + F.sum("n").over(Window.partitionBy("_pattern").orderBy("_h")))
    found = {r["_pattern"]: r for r in rows.where("sum <= room").groupBy("_pattern").agg(F.max("_h").alias("h"), F.max("sum").alias("sum")).collect()}
    out = {}
    for p, *_, bucket, before in state:
        r = found.get(p)
        out[p] = (r["h"], r["sum"]) if r else (max((bucket << (64 - bits)) - 1, -_LAST - 1), before)
    return out


def mixed_documents(docs: DataFrame, memberships: Column, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents of the mix, unchanged, each as often as it is taken."""
    wide, spare = with_spare(docs, memberships, "memberships")
    named = Numbered(wide)
    mix = with_mix(named.df, F.col(named[spare]), named[doc_id], named[text], **options).where("copies > 0")
    return named.back(mix.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))).drop(spare)
