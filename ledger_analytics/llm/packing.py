"""Best-fit packing of token pieces into sequences, after Martello and Toth's reduction.

``token_pieces`` cuts documents into pieces of at most ``CAPACITY`` tokens. ``pack`` puts
pieces into as few sequences as it can. What fits together depends on lengths only, so the
packing is planned on the number of pieces of each length, a table of at most ``capacity``
rows however large the corpus is:

* *Dominance.* A piece is fixed together with at most two others if every set of pieces that
  fits beside it could be swapped for these without making room elsewhere smaller: nothing
  fits; one piece fills it exactly; at most one fits; at most two fit, and one piece is as
  long as any two, or two take the place of all other pairs. Some packing with the fewest
  sequences then has this sequence, so it is fixed for good, as often as the lengths are
  there, and the instance shrinks until no rule holds.
* *Best fit.* What remains goes, longest first, into the fullest sequence that has room.

The plan is a list of kinds of sequences, each with a number of copies; its length is bounded
by the capacity, not by the corpus. Pieces of one length are numbered without gaps (per task
while they are written, then sums over tasks), and a piece's number tells its sequence and
place. No task holds all pieces of a length, and none of a sequence need meet.

Defined results: null and empty texts have the end id only; rows with equal ids are packed
each for itself; a null length or one below 1 has no sequence; a length above the capacity
has a sequence of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_analytics.llm.arrow import bounded_batches
from ledger_analytics.llm.storage import Stored
from ledger_analytics.llm.tokens import encoded_slices

CAPACITY = 1024

#: A kind of sequence: how many there are, and lengths with how often each occurs in one.
Kind = tuple[int, list[tuple[int, int]]]


# --- pieces --------------------------------------------------------------------


def cut_lengths(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``n`` (at least 1) tokens: row, number and length of each piece. All pieces
    but the first of a text are full."""
    pieces = -(-n // capacity)
    row = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.where(piece == 0, (n - capacity * (pieces - 1))[row], capacity)
    return row, piece, length


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", end_id: int = 2
) -> DataFrame:
    """Rows (doc_id, piece, start, length, token_ids): the ids of every text and ``end_id``, cut.
    ``start`` is the number of ids of the document before the piece; ``token_ids`` are
    little-endian unsigned 32-bit integers."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, n in encoded_slices(batches, tokenizer, end_id):
            row, piece, length = cut_lengths(n, capacity)
            end = np.cumsum(length)
            start = (end - length) - (np.cumsum(n) - n)[row]
            offsets = pa.py_buffer(np.append(0, 4 * end).astype(np.int64))
            token_ids = pa.Array.from_buffers(pa.large_binary(), len(row), [None, offsets, pa.py_buffer(ids.astype("<u4"))])
            columns = [rows.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), token_ids.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "token_ids"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, piece int, start long, length long, token_ids binary")


# --- plan ----------------------------------------------------------------------


def dominant_set(count: list[int], j: int, capacity: int) -> list[int] | None:
    """Lengths that dominate all sets of pieces beside one of length ``j``, taken out of
    ``count`` already; None if no rule holds."""
    room = capacity - j
    there = [s for s in range(1, room + 1) if count[s]]
    if not there:
        return []
    longest = there[-1]
    if longest == room:
        return [longest]
    least = [s for s in there[:3] for _ in range(min(3, count[s]))][:3]
    fitting = sum(sum(least[: k + 1]) <= room for k in range(len(least)))  # as many of the shortest fit
    if fitting == 1:
        return [longest]
    if fitting > 2:
        return None

    def partner(x: int, most: int) -> int:
        """The longest piece of at most ``most`` and ``x`` that is there beside one of ``x``; 0 if none."""
        return next((s for s in reversed(there) if s <= min(most, x) and count[s] > (s == x)), 0)

    pairs = [(x, y) for x in there if (y := partner(x, room - x))]
    if longest >= max(x + y for x, y in pairs):
        return [longest]
    second = partner(longest, room - longest)
    # with the longest in place of the larger and ``second`` of the smaller piece of any pair
    if second and all(_fits_in(x, there, count, room, longest, second) for x in there):
        return [longest, second]
    return None


def _fits_in(y: int, there: list[int], count: list[int], room: int, longest: int, second: int) -> bool:
    """Whether pairs with ``y`` as their smaller piece fit into ``longest`` and ``second``."""
    if y <= second:
        return True
    larger = next((s for s in reversed(there) if y <= s <= room - y and count[s] > (s == y)), 0)
    return not larger or larger + y <= longest


def reduced(count: list[int], capacity: int) -> list[Kind]:
    """Fix dominating sets as long as there are any, taking their pieces out of ``count``."""
    fixed: list[Kind] = []
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while count[j]:
                count[j] -= 1
                beside = dominant_set(count, j, capacity)
                count[j] += 1
                if beside is None:
                    break
                # pieces that go make no other set possible, so the rule holds as long as these last
                need = Counter([j, *beside])
                copies = min(count[s] // k for s, k in need.items())
                for s, k in need.items():
                    count[s] -= copies * k
                fixed.append((copies, sorted(need.items(), reverse=True)))
                changed = True
    return fixed


def best_fit(count: list[int], capacity: int) -> list[Kind]:
    """All pieces of ``count``, longest first, each into the fullest sequence with room for it."""
    open_: dict[int, list[Kind]] = {}  # by room
    for size in range(capacity, 0, -1):
        left = count[size]
        while left:
            room = next((r for r in range(size, capacity) if open_.get(r)), capacity)
            copies, held = open_[room].pop() if room < capacity else (left, [])
            each = room // size  # they all go into one before the next is the fullest
            full = min(copies, left // each)
            if full:
                open_.setdefault(room - each * size, []).append((full, [*held, (size, each)]))
                left -= full * each
            if left and full < copies:
                open_.setdefault(room - left % each * size, []).append((1, [*held, (size, left)]))
                copies, left = copies - 1, 0
            if room < capacity and copies > full:
                open_.setdefault(room, []).append((copies - full, held))
    return [kind for room in sorted(open_) for kind in open_[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Kind]:
    """Kinds of sequences that hold ``counts[length]`` pieces of each length (up to the capacity)."""
    count = [0] * (capacity + 1)
    for size, n in counts.items():
        count[size] = n
    return reduced(count, capacity) + best_fit(count, capacity)


# --- placing -------------------------------------------------------------------


class _Places:
    """Sequence and offset of the pieces of a plan, by length and number."""

    def __init__(self, kinds: list[Kind], capacity: int):
        used: Counter = Counter()
        rows, sequence = [], 0
        for copies, held in kinds:
            offset = 0
            for size, each in held:
                rows.append((size, used[size], sequence, each, offset))
                used[size] += copies * each
                offset += size * each
            sequence += copies
        rows.sort()
        self.sequences, self.capacity = sequence, capacity
        self._rows = np.array(rows, np.int64).reshape(-1, 5)
        self._key = self._rows[:, 0] << np.int64(50) | self._rows[:, 1]

    def __call__(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self._rows):
            return self.sequences + number, np.zeros(len(size), np.int64)
        _, first, sequence, each, offset = self._rows[np.maximum(np.searchsorted(self._key, size << np.int64(50) | number, "right") - 1, 0)].T
        at = number - first
        alone = size > self.capacity
        return np.where(alone, self.sequences + number, sequence + at // each), np.where(alone, 0, offset + at % each * size)


def _numbered(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Rows (size, row) with the task and their number among the task's rows of that size."""
    seen = np.zeros(capacity + 2, np.int64)
    part = TaskContext.get().partitionId()
    for batch in batches:
        size = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(size, kind="stable")
        n = np.bincount(size, minlength=capacity + 2)
        number = np.empty(len(size), np.int64)
        number[order] = np.arange(len(size)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(seen, n)
        seen += n
        columns = [batch.column(0), batch.column(1), pa.array(np.full(len(size), part, np.int32)), pa.array(number)]
        yield pa.RecordBatch.from_arrays(columns, names=["size", "row", "part", "number"])


def pack(pieces: DataFrame, size: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, the place in the sequence, gapless from 0.
    Old columns of these names give way; all others come through unchanged."""
    if not 0 < capacity < 1 << 12:
        raise ValueError("the capacity must be from 1 to 4095")
    spark = pieces.sparkSession
    stored = Stored(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in pieces.columns])
    long = F.col(f"`{size}`").cast("long")
    code = F.when(long > capacity, F.lit(capacity + 1).cast("long")).when(long >= 1, long).otherwise(F.lit(0).cast("long"))
    wrapped = pieces.select(code.alias("size"), row.alias("row"))
    schema = T.StructType([*wrapped.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType())])
    # numbers depend on the order in which a task reads, so they are written once
    every = stored.table(wrapped.mapInArrow(lambda it: _numbered(it, capacity), schema))
    rows = every.where("size > 0")
    by_part = stored.table(rows.groupBy("size", "part").agg(F.count("*").alias("n")))
    counts = {r["size"]: r["n"] for r in by_part.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    places = spark.sparkContext.broadcast(_Places(plan({s: n for s, n in counts.items() if s <= capacity}, capacity), capacity))
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("size", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            sequence, offset = places.value(size, number)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(sequence), pa.array(offset)], names=["row", "sequence_id", "offset"])

    numbered = rows.join(first, ["size", "part"]).select("size", (F.col("first") + F.col("number")).alias("number"), "row")
    out_schema = T.StructType([wrapped.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    out = numbered.mapInArrow(place, out_schema)
    nothing = every.where("size = 0").select("row", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    return out.unionByName(nothing).select(*kept, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its token ids, and which document begins where."""
    items = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "token_ids")))
    grouped = packed.where("sequence_id IS NOT NULL").groupBy("sequence_id").agg(items.alias("items"))
    joined = F.aggregate("items", F.lit(b""), lambda ids, x: F.concat(ids, x["token_ids"]))
    return grouped.select("sequence_id", F.transform("items", lambda x: x.dropFields("token_ids")).alias("pieces"), joined.alias("token_ids"))
