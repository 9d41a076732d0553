"""Prefix trie of conversations, built as a z-fast trie.

A conversation is a path of turns. Every prefix has a 16-byte hash, chained turn by turn, and
a mark after the last turn makes each path end in a leaf of its own. The trie is compacted: a
node stands for the edge from its parent's depth ``a`` to its own depth ``b`` and holds the
prefix hashes and text sizes along it. Its *handle* is the prefix at the two-fattest depth of
(a, b], the one that most powers of two divide; a table maps handle hashes to nodes.

* *Locate.* The exit node of a path is found by fat binary search: probe the handle table at
  the two-fattest depth of the open interval; a hit whose whole edge lies on the path moves
  the lower end there, a hit whose edge does not ends the search at the node's parent, a miss
  moves the upper end. That takes as many joins as the length of the longest path has bits,
  and paths of under 16 turns, searched apart, take four.
* *Insert in batches.* A batch holds all paths that are not in the trie. Of those that leave
  it by the same next turn one (the first by hash) is inserted, the others are located again
  in the next batch, from a deeper node. All edges that are left at some depth are cut there.
  The choice by hash halves a chain of nested branches with each batch.
* *Expand.* Sums over subtrees (conversations, childless nodes, bytes) climb the compacted
  trie by pointer doubling: each node passes what it has to its 2^k-th ancestor in round k.
  Then each edge is expanded to one row per depth.

Equal conversations are one path with a count before anything is inserted. Turns travel as
hashes and sizes, never as texts. Lookups join many paths with few nodes, on keys that a third
of all paths may share: the node side has one row a key, so adaptive execution splits the
other side as it likes.

Defined results: a null role or text is empty; turns go by their number, null first, and turns
of the same number by role, then text; a conversation without an id takes no part; no
conversations give no rows, not even a root. A conversation's turn hashes (24 bytes a turn)
must fit into a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_analytics.llm.storage import Stored

HASH = 16
ROOT = bytes(HASH)
_END = b"end"
#: Bytes of ids that are digested as one piece.
CHUNK_BYTES = 1 << 16


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row per distinct prefix (node, conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens). ``ends``: the node at which each conversation ends
    (node, conv_id). ``node`` is the prefix hash; the turns of a node are the first ``depth``
    ones of conversation ``conv_id``."""

    nodes: DataFrame
    ends: DataFrame


# --- paths ---------------------------------------------------------------------


def turn_paths(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): for each conversation the hash and the text size of its turns, in order."""
    texts = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
    )
    tied = texts.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select("conv_id", F.col("turn").alias("at"))
    tied = Stored(rows.sparkSession).table(tied)
    same = (texts["conv_id"] == tied["conv_id"]) & texts["turn"].eqNullSafe(tied["at"])
    if tied.isEmpty():
        ranked = texts.withColumn("rank", F.lit(0))
    else:  # only these need their texts compared
        order = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
        ranked = texts.join(tied, same, "left_semi").withColumn("rank", order)
        ranked = ranked.unionByName(texts.join(tied, same, "left_anti").withColumn("rank", F.lit(0)))
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    item = F.struct("turn", "rank", key.alias("key"), F.octet_length("text").cast("long").alias("size"))
    grouped = ranked.select("conv_id", item.alias("item")).groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return grouped.select("conv_id", F.transform("items", lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"))).alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix hashes from the root on, with the end mark, and sums of sizes."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        paths, sums = [], []
        for turns in lists.to_pylist():
            h, total = ROOT, 0
            path, sizes = [h], []
            for t in turns:
                h = hashlib.md5(h + t["key"]).digest()
                total += t["size"]
                path.append(h)
                sizes.append(total)
            path.append(hashlib.md5(h + _END).digest())
            sizes.append(total)
            paths.append(b"".join(path))
            sums.append(sizes)
        columns = [ids, pa.array([len(s) for s in sums], pa.int32()), pa.array(paths, pa.binary()), pa.array(sums, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "len", "path", "sums"])


def _hash_at(path: Column, at: Column) -> Column:
    """The ``at``-th hash (from 0) of a row of hashes."""
    return F.substring(path, at * HASH + 1, F.lit(HASH))


def _hashes(path: Column, first: Column, n: Column) -> Column:
    return F.substring(path, first * HASH + 1, n * HASH)


def two_fattest(a: Column, b: Column) -> Column:
    """The number of (a, b] that most powers of two divide."""
    bits = F.length(F.bin(a.bitwiseXOR(b).cast("long"))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", b, bits), bits)


# --- locating ------------------------------------------------------------------

#: Compacted nodes: the edge (a, b], the hash above it (``up``), its first, last and handle
#: hash, all hashes along it, sums of sizes to its ends and along it, and for leaves the
#: conversation, its count and total size.
_NODE = ("a", "b", "up", "first", "extent", "handle", "edge", "before", "sums", "conv_id", "n", "total")


def _as_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of rows (a, b, up, edge, before, sums, conv_id, n, total)."""
    f = two_fattest(F.col("a"), F.col("b"))
    return edges.select(
        "a", "b", "up", _hash_at(F.col("edge"), F.lit(0)).alias("first"), _hash_at(F.col("edge"), F.col("b") - F.col("a") - 1).alias("extent"),
        _hash_at(F.col("edge"), f - F.col("a") - 1).alias("handle"), "edge", "before", "sums", "conv_id", "n", "total",
    )


def _searched(paths: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """``paths`` with ``low``, the depth of the deepest node whose whole edge lies on the path."""
    state = paths.withColumn("low", F.lit(0)).withColumn("high", F.col("len"))
    handles = nodes.select(F.col("handle").alias("probe"), F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.col("extent").alias("node_extent"))
    for _ in range(steps):
        open_ = F.col("low") < F.col("high")
        f = two_fattest(F.col("low"), F.col("high"))
        # a path that is done asks for its own end, which is not in the trie: no key is shared
        state = state.withColumn("f", f).withColumn("probe", _hash_at(F.col("path"), F.when(open_, F.col("f")).otherwise(F.col("len"))))
        met = state.join(handles, "probe", "left")
        hit = F.col("node_b").isNotNull()
        covered = hit & (F.col("node_b") <= F.col("len")) & (_hash_at(F.col("path"), F.col("node_b")) == F.col("node_extent"))
        low = F.when(covered, F.col("node_b")).when(hit, F.col("node_a")).otherwise(F.col("low"))
        high = F.when(covered, F.col("high")).when(hit, F.col("node_a")).when(open_, F.col("f") - 1).otherwise(F.col("high"))
        state = met.select(*paths.columns, low.alias("low"), high.alias("high"))
    return state.drop("high")


def located(paths: DataFrame, nodes: DataFrame | None, longest: int) -> DataFrame:
    """(pri, branch, p, first): where each path leaves the trie. ``p`` is the depth to which it
    is in the trie, ``branch`` its next prefix, ``first`` names the edge that it leaves."""
    if nodes is None:
        none = F.lit(None).cast("binary")
        return paths.select("pri", _hash_at(F.col("path"), F.lit(1)).alias("branch"), F.lit(0).alias("p"), none.alias("first"))
    found, least, bits = None, 0, 4
    while least <= longest:
        most = (1 << bits) - 1
        some = paths.where((F.col("len") > least) & (F.col("len") <= most))
        part = _searched(some, nodes, min(bits, longest.bit_length()))
        found = part if found is None else found.unionByName(part)
        least, bits = most, 2 * bits
    edges = nodes.select(F.col("first").alias("next"), F.col("edge"), F.col("b").alias("node_b"))
    at = found.withColumn("next", _hash_at(F.col("path"), F.col("low") + 1)).join(edges, "next", "left")
    along = F.sequence(F.lit(1), F.least(F.col("node_b"), F.col("len")) - F.col("low"))
    shared = F.filter(along, lambda i: _hash_at(F.col("edge"), i - 1) == _hash_at(F.col("path"), F.col("low") + i))
    p = F.when(F.col("edge").isNull(), F.col("low")).otherwise(F.col("low") + F.size(shared))
    at = at.withColumn("p", p)
    first = F.when(F.col("edge").isNotNull(), F.col("next"))
    return at.select("pri", _hash_at(F.col("path"), F.col("p") + 1).alias("branch"), "p", first.alias("first"))


# --- inserting -----------------------------------------------------------------


def _cut_edges(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """``nodes`` with edges cut where chosen paths leave them."""
    cuts = chosen.where("first IS NOT NULL").groupBy("first").agg(F.sort_array(F.collect_set("p")).alias("cuts"))
    ends = F.when(F.col("cuts").isNull(), F.array("a", "b")).otherwise(F.concat(F.array("a"), "cuts", F.array("b")))
    pieces = nodes.join(cuts, "first", "left").withColumn("ends", ends)
    pieces = pieces.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("ends") - 2)))
    lo, hi = F.get("ends", F.col("i")), F.get("ends", F.col("i") + 1)
    skip = lo - F.col("a")
    last = hi == F.col("b")
    return _as_nodes(
        pieces.select(
            lo.alias("a"), hi.alias("b"),
            F.when(skip == 0, F.col("up")).otherwise(_hash_at(F.col("edge"), skip - 1)).alias("up"),
            _hashes(F.col("edge"), skip, hi - lo).alias("edge"),
            F.when(skip == 0, F.col("before")).otherwise(F.get("sums", skip - 1)).alias("before"),
            F.slice("sums", skip + 1, hi - lo).alias("sums"),
            *[F.when(last, F.col(c)).alias(c) for c in ("conv_id", "n", "total")],
        )
    )


def _new_leaves(chosen: DataFrame, paths: DataFrame) -> DataFrame:
    p, rest = F.col("p"), F.col("len") - F.col("p")
    return _as_nodes(
        chosen.select("pri", "p").join(paths, "pri").select(
            p.alias("a"), F.col("len").alias("b"), _hash_at(F.col("path"), p).alias("up"), _hashes(F.col("path"), p + 1, rest).alias("edge"),
            F.when(p == 0, F.lit(0)).otherwise(F.get("sums", p - 1)).alias("before"), F.slice("sums", p + 1, rest).alias("sums"),
            "conv_id", "n", F.element_at("sums", -1).alias("total"),
        )
    )


def compacted(paths: DataFrame, stored: Stored) -> DataFrame | None:
    """Nodes of the trie of ``paths`` (pri, conv_id, n, len, path, sums); None without paths."""
    nodes, waiting = None, paths
    longest = paths.agg(F.max("len")).first()[0]
    left = 1 if longest else 0
    while left:
        where = stored.table(located(waiting, nodes, longest))
        first = where.groupBy("branch").agg(F.min("pri").alias("pri"))
        chosen = stored.table(where.join(first, ["branch", "pri"]).select("pri", "p", "first"))
        leaves = _new_leaves(chosen, waiting)
        new_nodes = stored.table(leaves if nodes is None else _cut_edges(nodes, chosen).unionByName(leaves))
        new_waiting, left = stored.write(waiting.join(chosen.select("pri"), "pri", "left_anti"))
        stored.keep(paths, new_nodes, new_waiting)
        nodes, waiting = new_nodes, new_waiting
    return nodes


# --- sums over subtrees, expansion ----------------------------------------------

_SUMS = {"n": F.sum, "conv_id": F.min, "leaves": F.sum, "held": F.sum, "own": F.sum}


def _climbed(own: DataFrame, stored: Stored) -> DataFrame:
    """Rows (id, n, conv_id, leaves, held, own) with the sums of all descendants added, from
    rows (id, up, ...): after k rounds those up to 2^k levels below. ``up`` of the root is null."""
    state, more = stored.table(own), True
    kept = state
    while more:
        adds = state.where("up IS NOT NULL").groupBy("up").agg(*[f(c).alias(f"{c}_below") for c, f in _SUMS.items()])
        summed = state.join(adds.withColumnRenamed("up", "id"), "id", "left")
        sums = [F.least(c, f"{c}_below") if f is F.min else F.col(c) + F.coalesce(f"{c}_below", F.lit(0)) for c, f in _SUMS.items()]
        summed = summed.select("id", "up", *[s.alias(c) for s, c in zip(sums, _SUMS)])
        # two above the root is nothing: the many children of the root need no join
        below_root = F.col("up").isNull() | (F.col("up") == F.lit(ROOT))
        top = summed.where(below_root).withColumn("up", F.lit(None).cast("binary"))
        hop = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        rest = summed.where(~below_root).join(hop, "up").withColumn("up", F.col("next")).drop("next")
        new = stored.table(top.unionByName(rest.select(*top.columns)))
        stored.keep(kept, new)
        state = new
        more = not state.where("up IS NOT NULL").isEmpty()
    return state.drop("up")


def prefix_trie(paths: DataFrame) -> Trie:
    """The trie of (conv_id, turns: array<struct<key: binary, size: long>>), one row a conversation."""
    stored = Stored(paths.sparkSession)
    schema = "conv_id long, len int, path binary, sums array<long>"
    each = stored.table(paths.select("conv_id", "turns").mapInArrow(_chained, schema))
    last = _hash_at(F.col("path"), F.col("len"))
    ends = each.select(_hash_at(F.col("path"), F.col("len") - 1).alias("node"), "conv_id")
    # equal conversations are one path
    same = each.groupBy(last.alias("end")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    distinct = stored.table(each.join(same.select("conv_id", "n"), "conv_id").withColumn("pri", F.xxhash64("conv_id")))
    building = Stored(paths.sparkSession)
    nodes = compacted(distinct, building)
    if nodes is None:
        empty = "node binary, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
        return Trie(paths.sparkSession.createDataFrame([], empty), ends)

    leaf = F.col("n").isNotNull()
    # the end mark is no node
    real = F.col("b") - F.col("a") - leaf.cast("int")
    nodes = nodes.withColumn("real", real)
    own = nodes.select(
        F.col("extent").alias("id"), "up", F.coalesce("n", F.lit(0)).alias("n"), "conv_id", (leaf & (F.col("real") > 0)).cast("long").alias("leaves"),
        F.coalesce(F.col("n") * F.col("total"), F.lit(0)).alias("held"), (F.element_at("sums", -1) - F.col("before")).alias("own"),
    )
    spark = paths.sparkSession
    root = spark.range(1).select(
        F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("conv_id"),
        *[F.lit(0).cast("long").alias(c) for c in ("leaves", "held", "own")],
    )
    climbing = Stored(spark)
    sums = _climbed(own.unionByName(root), climbing)
    kids = nodes.where("real > 0").groupBy("up").agg(F.count("*").alias("kids"))
    top = sums.where(F.col("id") == F.lit(ROOT)).join(kids.withColumnRenamed("up", "id"), "id", "left").first()

    known = sums.withColumnRenamed("conv_id", "low").withColumnRenamed("n", "convs").withColumnRenamed("id", "extent")
    rows = nodes.where("real > 0").drop("conv_id", "n").join(known, "extent")
    rows = rows.join(kids.withColumnRenamed("up", "extent"), "extent", "left")
    above = sums.select(F.col("id").alias("up"), F.col("conv_id").alias("above"))
    # the root's many children know their parent without a join
    of_root = F.col("up") == F.lit(ROOT)
    first = rows.where(of_root).withColumn("above", F.lit(top["conv_id"]).cast("long"))
    rows = first.unionByName(rows.where(~of_root).join(above, "up").select(*first.columns))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("real"))))
    i = F.col("i")
    prefix = F.when(i == 1, F.col("before")).otherwise(F.get("sums", i - 2))
    children = F.when(i < F.col("real"), F.lit(1)).otherwise(F.coalesce("kids", F.lit(0))).cast("long")
    # all turns below, as often as conversations have them, less once each
    saved = F.col("held") - F.col("convs") * prefix - (F.col("own") - (prefix - F.col("before")))
    expanded = rows.select(
        _hash_at(F.col("edge"), i - 1).alias("node"), F.col("low").alias("conv_id"), (F.col("a") + i).cast("int").alias("depth"),
        F.when(i == 1, F.col("above")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("convs").alias("n_convs"),
        children.alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
    )
    values = (bytearray(ROOT), top["conv_id"], 0, None, top["n"], top["kids"] or 0, top["leaves"] or 1, top["held"] - top["own"])
    return Trie(spark.createDataFrame([values], expanded.schema).unionByName(expanded), ends)


# --- digests of lists ------------------------------------------------------------


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, value), sorted, as stretches of one key: (key, first value, values joined)."""
    key, first, held, size = None, 0, [], 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["key", "first", "text"])

    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (k != key or size > CHUNK_BYTES):
                yield close()
                held, size = [], 0
            if not held:
                key, first = k, v
            held.append(str(v))
            size += len(held[-1]) + 1
    if held:
        yield close()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches, sorted by key and first value: (key, SHA-256 of all of the key's)."""
    key, digest = None, None

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "sha256"])

    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                if digest:
                    yield close()
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
    if digest:
        yield close()


def list_digests(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, sha256): per binary key the lowercase SHA-256 of its longs, ascending, joined by
    commas. Long lists are sorted and joined in pieces by many tasks; one task then reads a
    key's pieces, and never holds more than one of them."""
    ordered = rows.select(F.col(key).alias("key"), F.col(value).alias("value")).repartitionByRange("key", "value").sortWithinPartitions("key", "value")
    pieces = ordered.mapInArrow(_joined, "key binary, first long, text string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digested, "key binary, sha256 string")
