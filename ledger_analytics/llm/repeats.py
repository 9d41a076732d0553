"""Removal of long repeated substrings by distributed suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. Sorting all suffixes of a corpus in one place is out of reach, so the work is
cut into shards that hold together what can be equal:

1. Texts are stored in parcels of some megabytes. In every string of ``LENGTH`` bytes the
   piece of ``PIECE`` bytes with the smallest hash is its anchor. Equal strings have equal
   anchors at equal places, so strings can only be equal if their anchors are.
2. Anchor hashes go to shards by hash range. A shard answers each parcel which of its
   anchors stand in several documents; text without such an anchor is not sorted. Every parcel
   has a row for every shard, so both grow with the input up to a bound, and what a parcel does
   it does for all shards at once: a row costs no more than its packing.
3. Around each such anchor a parcel sends the bytes that strings with that anchor can reach
   to the anchor's shard, once per parcel for equal surroundings, with the smallest id that
   has them. Copies, however many, are so merged before the shuffle.
4. A shard merges equal surroundings once more, sorts the suffixes of the rest by external
   induced sorting (``suffixes``), compares neighbours for a common prefix of ``LENGTH``
   bytes, takes the smallest id of each run of equal strings, and answers which strings
   are to go. It works through its anchors in pieces of ``SHARD_BYTES``.
5. An anchor that stands in more than ``HOT`` places (the edge of a line that very many
   documents have) is not sorted in one shard. Its parcels send the strings themselves, as
   hashes with the smallest id, and each string goes to a shard of its own hash.
6. Parcels join the answers and cut their texts.

Hashes only choose candidates: the strings that are removed are compared as bytes, but for
surroundings, which are taken as equal if their length and 64-bit hash are, and strings of
hot anchors, which are if two 64-bit hashes are.

Defined results: null and empty texts have no bytes; rows with equal ids are one document,
which never removes its own bytes; rows without an id come after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_analytics.llm.arrow import BATCH_BYTES, all_stretches, mix, prefix_sums, stretch_hashes, utf8
from ledger_analytics.llm.storage import Stored
from ledger_analytics.llm.suffixes import same_prefix, suffix_order, words_at

LENGTH = 50
PIECE = 24
#: Bytes of text in a parcel (a longer text is a parcel of its own).
PARCEL_BYTES = 8 << 20
#: Bytes of a parcel that are hashed at a time, so that their arrays stay in the processor's cache.
BLOCK = (1 << 18) - 256
#: Bytes of text for which there is a shard; beyond ``SHARDS`` shards they grow up to ``GROWTH`` times.
TEXT_PER_SHARD = 2 << 20
SHARDS, GROWTH = 256, 8
#: Surroundings that a shard sorts at a time.
SHARD_BYTES = 4 << 20
#: Places of an anchor beyond which its strings are dealt out one by one; the surroundings of
#: so many are about ``SHARD_BYTES``.
HOT = 50_000
#: Surroundings of hot anchors whose strings a parcel takes up at a time.
HOT_PORTION = 1 << 15

_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_LAST = np.iinfo(np.int64).max


# --- parcels -------------------------------------------------------------------


def _pack(a: np.ndarray) -> bytes:
    return _PACKER.compress(np.ascontiguousarray(a))


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(_UNPACKER.decompress(raw), kind)


def _parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) as parcels."""
    task, seq = TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal seq, held, size
        ids, known, n, data = (np.concatenate(x) for x in zip(*held))
        row = [[(task << 32) | seq], [len(data)], [_pack(ids)], [_pack(known)], [_pack(n)], [_pack(data)]]
        seq, held, size = seq + 1, [], 0
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        names = ["parcel", "n_bytes", "ids", "known", "lengths", "data"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)

    for batch in batches:
        known = np.asarray(batch.column(0).is_valid())
        ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
        data, off = utf8(batch.column(1))
        first = 0
        while first < len(ids):
            room = max(PARCEL_BYTES - size, 0)
            last = max(first + (not held), int(np.searchsorted(off, off[first] + room, "right")) - 1)
            if last > first:
                held.append((ids[first:last], known[first:last], np.diff(off[first : last + 1]), data[off[first] : off[last]]))
                size += int(off[last] - off[first])
                first = last
            if first < len(ids):
                yield close()
    if held:
        yield close()


class Strings:
    """Strings ``o`` bytes before the anchors numbered ``of``, and the distinct ones among them
    in order of hash, each with the smallest id that has it."""

    def __init__(self, o: np.ndarray, of: np.ndarray, h: np.ndarray, check: np.ndarray, ids: np.ndarray):
        self.o, self.of, self.ids = o, of, ids
        order = np.lexsort((ids, check, h))
        new = _changes(h[order], check[order])
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.hash, self.check, self.lowest = h[order][new], check[order][new], ids[order][new]


def _runs(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers."""
    cuts = [*np.flatnonzero(_changes(shard)).tolist(), len(shard)]
    for first, last in zip(cuts[:-1], cuts[1:]):
        yield int(shard[first]), slice(first, last)


def _shards(h: np.ndarray, n: int) -> np.ndarray:
    """Shard of each anchor: ranges of the hash."""
    return ((h >> np.uint64(24)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def _string_shards(h: np.ndarray, n: int) -> np.ndarray:
    """Shard of each string; these follow those of the anchors."""
    return n + _shards(h >> np.uint64(16), n)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys differ from those before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


class Parcel:
    """The texts of a parcel and their anchors."""

    def __init__(self, row: dict, length: int, piece: int):
        self.ids, self.known = _unpack(row["ids"], np.int64), _unpack(row["known"], bool)
        self.data = _unpack(row["data"], np.uint8)
        self.off = np.concatenate([[0], np.cumsum(_unpack(row["lengths"], np.int64))])
        self.length, self.piece, self.reach = length, piece, length - piece
        self.at, piece_hash = self._anchors()
        self.row = np.searchsorted(self.off, self.at, "right") - 1
        # texts of no bytes share an offset with the next; the last such row holds the byte
        self.hash = mix(piece_hash) >> np.uint64(16)

    def _anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the smallest piece of each string, the first of several."""
        span, at, hashes = self.reach + 1, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        low = np.uint64((1 << (BLOCK + self.length).bit_length()) - 1)
        for first in range(0, len(self.data) - self.length + 1, BLOCK):
            h = all_stretches(prefix_sums(self.data[first : first + BLOCK + self.length - 1]), self.piece)
            v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= span:
                v = np.minimum(v[:-width], v[width:])
                width *= 2
            if width < span:
                v = np.minimum(v[: len(v) - (span - width)], v[span - width :])
            # strings that start in one text and end in the next are none
            within = np.searchsorted(self.off, [first, first + len(v) + self.length])
            ends = self.off[within[0] : within[1]] - first
            if len(ends):
                edge = np.zeros(len(v) + 1, np.int32)
                np.add.at(edge, np.clip(ends - self.length + 1, 0, len(v)), 1)
                np.add.at(edge, np.clip(ends, 0, len(v)), -1)
                v = v[np.cumsum(edge[:-1]) == 0]
            v = (v[_changes(v)] & low).astype(np.int64)
            at.append(v + first)
            hashes.append(h[v])
        at, hashes = np.concatenate(at), np.concatenate(hashes)
        new = _changes(at)
        return at[new], hashes[new]

    def _hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of stretches that strings of one anchor can reach."""
        out, longest = np.empty(len(begin), np.uint64), self.reach + self.length
        order = np.argsort(begin)
        for block, part in _runs(begin[order] // BLOCK):
            part, first = order[part], block * BLOCK
            sums = prefix_sums(self.data[first : first + BLOCK + longest])
            out[part] = stretch_hashes(sums, begin[part] - first, end[part] - first)
        return out

    def bounds(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the bytes around anchors that their strings can reach."""
        at, row = self.at[which], self.row[which]
        return np.maximum(at - self.reach, self.off[row]), np.minimum(at + self.length, self.off[row + 1])

    def around(self, which: np.ndarray) -> np.ndarray:
        """Hashes of these bytes and of the anchors' places in them."""
        begin, end = self.bounds(which)
        place = mix((self.at[which] - begin).astype(np.uint64) * np.uint64(64) + (end - self.at[which]).astype(np.uint64))
        return mix(self._hashes(begin, end) ^ place)

    def strings(self, which: np.ndarray) -> Strings:
        """The strings around anchors."""
        begin, end = self.bounds(which)
        o = np.arange(self.reach + 1)[:, None]
        start = self.at[which] - o
        o, of = np.nonzero((start >= begin) & (start + self.length <= end))
        start = start[o, of]
        h, check = self._hashes(start, start + self.length), np.zeros(len(start), np.uint64)
        for at in [*range(0, self.length - 7, 8), self.length - 8]:
            check = mix(check ^ words_at(self.data, start + at))
        return Strings(o, of, h, check, self.ids[self.row[which]][of])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors in order of hash, the distinct hashes, the number in this order of each one's
        first anchor, and whether several documents have it."""
        order = np.argsort(self.hash)
        h, ids = self.hash[order], self.ids[self.row[order]]
        first = np.flatnonzero(_changes(h))
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        return order, h[first], first, several


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def _batches(rows: Iterator[tuple], names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= BATCH_BYTES:
            yield _batch(held, names, kinds)
            held, size = [], 0
    if held:
        yield _batch(held, names, kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


_REPLY = (["parcel", "shard", "answer"], [pa.int64(), pa.int32(), pa.binary()])


def _planes(values: np.ndarray, width: int) -> bytes:
    """Ascending numbers below 2 ** (8 * width), byte by byte, which packs well."""
    return _pack(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _unplanes(raw: bytes, width: int) -> np.ndarray:
    flat = _unpack(raw, np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view("<u8").reshape(-1)


def _hash_rows(parcel: int, p: Parcel, n: int) -> Iterator[tuple]:
    order, h, first, several = p.distinct()
    times = np.diff(np.append(first, len(order)))
    values = (h << np.uint64(1)) | several.astype(np.uint64)
    for shard, part in _runs(_shards(h, n)):
        more = np.flatnonzero(times[part] > 1)
        repeats = _pack(np.stack([more, times[part][more]])) if len(more) else None
        yield parcel, shard, _planes(values[part], 7), repeats


# --- shards --------------------------------------------------------------------


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one shard together; they come sorted by shard."""
    held: list[dict] = []
    for row in _rows(batches):
        if held and held[0]["shard"] != row["shard"]:
            yield held[0]["shard"], held
            held = []
        held.append(row)
    if held:
        yield held[0]["shard"], held


def _shared(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Which anchors of each parcel stand in several documents, as bits in order of hash;
    behind them, if there are such, which of these stand in more than ``hot`` places."""
    for shard, rows in _grouped(batches):
        each = [_unplanes(r["hashes"], 7) for r in rows]
        all_ = np.sort(np.concatenate(each))
        h, several = all_ >> np.uint64(1), (all_ & np.uint64(1)).astype(bool)
        first = np.flatnonzero(_changes(h))
        parcels = np.diff(np.append(first, len(h)))
        places, h = parcels.copy(), h[first]
        for r, v in zip(rows, each):
            if r["repeats"]:
                which, times = _unpack(r["repeats"], np.int64).reshape(2, -1)
                places[np.searchsorted(h, v[which] >> np.uint64(1))] += times - 1
        wanted = (parcels > 1) | np.logical_or.reduceat(several, first)
        shared, many = h[wanted], (places > hot)[wanted]
        out = []
        for r, v in zip(rows, each):
            mine = v >> np.uint64(1)
            where = np.searchsorted(shared, mine)
            hit = where < len(shared)
            hit[hit] = shared[where[hit]] == mine[hit]
            if hit.any():
                bits = [np.packbits(hit)]
                if many.any():
                    mine = np.zeros(len(hit), bool)
                    mine[hit] = many[where[hit]]
                    bits += [np.packbits(mine)] * bool(mine.any())
                out.append((r["parcel"], shard, _pack(np.concatenate(bits))))
        if out:
            yield _batch(out, *_REPLY)


def _wanted(p: Parcel, answers: list[dict], n: int) -> tuple[np.ndarray, ...]:
    """The parcel's anchors that several documents have (in order of hash, then of surroundings),
    the number of its surroundings for each, the first anchor of each surroundings (of the
    document with the smallest id), whether that one is hot, and the surroundings' hashes."""
    bits = {a["shard"]: a["answer"] for a in answers}
    anchors, h, first, _ = p.distinct()
    times = np.diff(np.append(first, len(anchors)))
    hit, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
    for shard, part in _runs(_shards(h, n)):
        if shard in bits:
            raw, count = _unpack(bits[shard], np.uint8), part.stop - part.start
            hit[part] = np.unpackbits(raw, count=count)
            behind = raw[-(-count // 8) :]
            if len(behind):
                hot[part] = np.unpackbits(behind, count=count)
    which, hot, times = anchors[np.repeat(hit, times)], np.repeat(hot[hit], times[hit]), times[hit]
    around, h = p.around(which), p.hash[which]
    several = np.flatnonzero(np.repeat(times > 1, times))
    order = several[np.lexsort((p.ids[p.row[which[several]]], around[several], h[several]))]
    which[several], around[several] = which[order], around[order]
    new = _changes(around, h)
    return which, np.cumsum(new) - 1, which[new], hot[new], around[new]


def _surrounding_rows(parcel: int, p: Parcel, answers: list[dict], n: int) -> Iterator[tuple]:
    _, _, firsts, hot, around = _wanted(p, answers, n)
    plain, around = firsts[~hot], around[~hot]
    h, ids = p.hash[plain], p.ids[p.row[plain]]
    begin, end = p.bounds(plain)
    shape = np.stack([p.at[plain] - begin, end - begin]).astype(np.uint8)
    for shard, part in _runs(_shards(h, n)):
        size = (end - begin)[part]
        index = np.arange(size.sum()) + np.repeat(begin[part] - (np.cumsum(size) - size), size)
        yield (
            parcel, shard, _planes(h[part], 6), _pack(around[part]), _pack(ids[part]),
            _pack(shape[:, part]), _pack(p.data[index]),
        )
    if hot.any():
        h, check, lowest, _ = _hot_strings(p, firsts[hot])
        for shard, part in _runs(_string_shards(h, n)):
            yield parcel, shard, _pack(h[part]), _pack(check[part]), _pack(lowest[part]), None, None


def _hot_portions(p: Parcel, firsts: np.ndarray) -> list[slice]:
    """Runs of hot anchors of bounded length. Anchors of one hash stay together, and with them
    equal strings."""
    h, cuts = p.hash[firsts], [0]
    while cuts[-1] < len(h):
        last = min(cuts[-1] + HOT_PORTION, len(h))
        back = int(np.searchsorted(h, h[last])) if last < len(h) else last
        cuts.append(back if back > cuts[-1] else int(np.searchsorted(h, h[last], "right")))
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]


def _hot_strings(p: Parcel, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, second hashes and smallest ids of the distinct strings around hot anchors, in order
    of hash, and the order in which the portions have them."""
    each = [(s.hash, s.check, s.lowest) for s in (p.strings(firsts[part]) for part in _hot_portions(p, firsts))]
    h, check, lowest = (np.concatenate(x) for x in zip(*each))
    order = np.lexsort((check, h))
    return h[order], check[order], lowest[order], order


def _removed_strings(rows: list[dict]) -> list[tuple]:
    """For each parcel's strings of hot anchors, which a smaller document has, as bits."""
    each = [tuple(_unpack(r[c], t) for c, t in [("hashes", np.uint64), ("around", np.uint64), ("ids", np.int64)]) for r in rows]
    h, check, ids = map(np.concatenate, zip(*each))
    order = np.lexsort((check, h))
    new = _changes(h[order], check[order])
    lowest = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    smaller = np.empty(len(order), bool)
    smaller[order] = lowest[np.cumsum(new) - 1] < ids[order]
    parts = np.split(smaller, np.cumsum([len(e[0]) for e in each])[:-1])
    return [(r["parcel"], r["shard"], _pack(np.packbits(mine))) for r, mine in zip(rows, parts) if mine.any()]


def _hot_masks(p: Parcel, firsts: np.ndarray, bits: dict[int, bytes], n: int) -> np.ndarray:
    """Which strings around hot anchors go, as bits by start."""
    h, _, _, order = _hot_strings(p, firsts)
    smaller = np.zeros(len(h), bool)
    for shard, part in _runs(_string_shards(h, n)):
        if shard in bits:
            smaller[order[part]] = np.unpackbits(_unpack(bits[shard], np.uint8), count=part.stop - part.start)
    out, used = np.zeros(len(firsts), np.uint32), 0
    for part in _hot_portions(p, firsts):
        s = p.strings(firsts[part])
        gone = smaller[used:][s.number] | (s.ids > s.lowest[s.number])
        np.bitwise_or.at(out, part.start + s.of[gone], np.uint32(1) << s.o[gone].astype(np.uint32))
        used += len(s.hash)
    return out


def _removed(batches: Iterator[pa.RecordBatch], length: int, piece: int) -> Iterator[pa.RecordBatch]:
    """For each parcel's surroundings, which strings a smaller document has, as bits by start."""
    for shard, rows in _grouped(batches):
        if rows[0]["shape"] is None:
            if out := _removed_strings(rows):
                yield _batch(out, *_REPLY)
            continue
        h = np.concatenate([_unplanes(r["hashes"], 6) for r in rows])
        around = np.concatenate([_unpack(r["around"], np.uint64) for r in rows])
        each = [_unpack(r["ids"], np.int64) for r in rows]
        ids, rows_end = np.concatenate(each), np.cumsum([len(x) for x in each])
        before, size = np.concatenate([_unpack(r["shape"], np.uint8).reshape(2, -1) for r in rows], axis=1)
        total = np.cumsum(size, dtype=np.int64)
        begin, data = total - size, np.empty(total[-1], np.uint8)
        for r, first in zip(rows, begin[np.append(0, rows_end[:-1])]):
            part = _unpack(r.pop("data"), np.uint8)
            data[first : first + len(part)] = part
        # equal surroundings of several parcels are one, of the smallest id
        order = np.lexsort((ids, around, h))
        new = np.flatnonzero(_changes(h[order], around[order]))
        kept, times = order[new], np.diff(np.append(new, len(order)))
        h = h[kept]
        del around, total, each
        # an anchor with one surroundings left: its strings stand nowhere else
        alone = _changes(h) & np.append(_changes(h)[1:], True)
        bits = np.zeros(len(order), np.uint32)
        for some, find in (np.flatnonzero(alone), _own_ids), (np.flatnonzero(~alone), _sorted_ids):
            for part in _portions(h[some], size[kept[some]]):
                part = some[part]
                k, several = kept[part], times[part]
                smaller = find(ids[k], before[k].astype(np.int64), size[k].astype(np.int64), begin[k], data, length, length - piece)
                of = np.repeat(np.arange(len(k)), several)
                mine = order[np.arange(len(of)) + np.repeat(new[part] - (np.cumsum(several) - several), several)]
                # a string goes if its smallest id is below the id of the surroundings
                for o in range(length - piece + 1):
                    bits[mine] |= (smaller[o][of] < ids[mine]).astype(np.uint32) << np.uint32(o)
        out = []
        for r, mine in zip(rows, np.split(bits, rows_end[:-1])):
            if mine.any():
                out.append((r["parcel"], shard, _pack(mine)))
        if out:
            yield _batch(out, *_REPLY)


def _portions(h: np.ndarray, size: np.ndarray) -> Iterator[slice]:
    """Runs of surroundings of ``SHARD_BYTES``, or of one anchor."""
    total, first = np.cumsum(size, dtype=np.int64), 0
    while first < len(h):
        last = int(np.searchsorted(total, int(total[first]) - int(size[first]) + SHARD_BYTES, "right"))
        if last < len(h):  # go back to a change of anchor, or on to the next
            back = int(np.searchsorted(h, h[last]))
            last = back if back > first else int(np.searchsorted(h, h[last], "right"))
        yield slice(first, last)
        first = last


def _own_ids(ids, before, size, begin, data, length: int, reach: int) -> np.ndarray:
    """As ``_sorted_ids``, where no two surroundings have an anchor in common."""
    o = np.arange(reach + 1)[:, None]
    return np.where((o <= before) & (before - o + length <= size), ids, _LAST)


def _sorted_ids(ids, before, size, begin, data, length: int, reach: int) -> np.ndarray:
    """Smallest id that has the string which starts ``o`` bytes before the anchor, by ``o`` and
    surroundings; the largest number where there is no such string. Found by sorting the suffixes
    of the surroundings."""
    out = np.full((reach + 1, len(ids)), _LAST, np.int64)
    end = np.cumsum(size)
    text = data[np.arange(size.sum()) + np.repeat(begin - (end - size), size)]
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), size)
    order = suffix_order(text, depth=-(-length // 8) * 8)
    order = order[order + length <= end[owner[order]]]
    # strings of this anchor only: those that cover the piece
    own = owner[order]
    o = before[own] - (order - (end - size)[own])
    fits = (o >= 0) & (o <= reach)
    order, own, o = order[fits], own[fits], o[fits]
    if len(order):
        run = np.flatnonzero(np.append(True, ~same_prefix(text, order, length)))
        low = np.minimum.reduceat(ids[own], run)
        out[o, own] = np.repeat(low, np.diff(np.append(run, len(order))))
    return out


# --- the whole -----------------------------------------------------------------


def _cut(p: Parcel, n: int, answers: list[dict], strings: list[dict]) -> pa.RecordBatch:
    """The rows of a parcel without the bytes that go."""
    cover = np.zeros(len(p.data) + 1, np.int32)
    bits = {a["shard"]: a["answer"] for a in strings}
    which, of, firsts, hot, _ = _wanted(p, answers, n)
    mask, plain = np.zeros(len(firsts), np.uint32), np.flatnonzero(~hot)
    for shard, part in _runs(_shards(p.hash[firsts[plain]], n)):
        if shard in bits:
            mask[plain[part]] = _unpack(bits[shard], np.uint32)
    if hot.any():
        mask[hot] = _hot_masks(p, firsts[hot], bits, n)
    # a document with larger id than the first with equal surroundings loses all of them
    later = p.ids[p.row[which]] > p.ids[p.row[firsts]][of]
    begin, end = p.bounds(which)
    full = later & (end - begin >= p.length)
    np.add.at(cover, begin[full], 1)
    np.add.at(cover, end[full], -1)
    at, mask = p.at[which][~later], mask[of[~later]]
    at, mask = at[mask > 0], mask[mask > 0]
    for o in range(p.reach + 1):
        start = at[(mask >> np.uint32(o)) & 1 > 0] - o
        cover[start] += 1  # no two anchors stand at one place
        cover[start + p.length] -= 1
    gone = np.cumsum(cover[:-1], out=cover[:-1]) > 0
    del cover
    kept = p.data[~gone]
    at = p.off - np.concatenate([[0], np.cumsum(gone, dtype=np.int32)])[p.off]
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
    edge[p.off[:-1][p.off[:-1] < len(gone)]] = gone[p.off[:-1][p.off[:-1] < len(gone)]]
    start = np.flatnonzero(edge == 1)
    # ends of runs, within texts
    after = np.append(gone[1:], False)
    last = p.off[1:][p.off[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(gone & ~after) + 1
    spans_at = np.searchsorted(start, p.off).astype(np.int32)
    base = p.off[np.searchsorted(p.off, start, "right") - 1]
    spans = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], names=["start", "end"])
    text = pa.Array.from_buffers(pa.large_binary(), len(p.ids), [None, pa.py_buffer(at), pa.py_buffer(kept)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(p.ids, mask=~p.known), pa.array(np.diff(p.off)), text.cast(pa.binary()),
            pa.ListArray.from_arrays(pa.array(spans_at), spans),
        ],
        names=["doc_id", "n_bytes", "kept", "spans"],
    )


def _answers(replies: DataFrame, name: str) -> DataFrame:
    """A parcel's answers together: no more than it has anchors."""
    return replies.groupBy("parcel").agg(F.collect_list(F.struct("shard", "answer")).alias(name))


def _n_shards(n_bytes: int, bytes_per_shard: int) -> int:
    """Every parcel sends a row to every shard, so shards grow before they become many."""
    n = -(-n_bytes // bytes_per_shard)
    return max(8, min(n, SHARDS), -(-n // GROWTH))


def without_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, piece: int = PIECE,
    parcel_bytes_per_shard: int = TEXT_PER_SHARD, hot: int = HOT,
) -> DataFrame:
    """Rows (doc_id, n_bytes, kept: the bytes that stay, spans: the maximal removed runs). The
    result does not depend on ``hot``, from which on an anchor's strings are dealt out."""
    if not 8 <= piece < length <= piece + 31:
        raise ValueError("piece must be at least 8 and less than length, by no more than 31")
    stored = Stored(docs.sparkSession)
    schema = "parcel long, n_bytes long, ids binary, known binary, lengths binary, data binary"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parcels = stored.table(rows.mapInArrow(_parcels, schema))
    total = parcels.agg(F.sum("n_bytes")).first()[0] or 0
    n = _n_shards(int(total), parcel_bytes_per_shard)

    def hashes(batches):
        for row in _rows(batches):
            made = _hash_rows(row["parcel"], Parcel(row, length, piece), n)
            yield from _batches(made, ["parcel", "shard", "hashes", "repeats"], [*_REPLY[1], pa.binary()])

    def around(batches):
        names = ["parcel", "shard", "hashes", "around", "ids", "shape", "data"]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        for row in _rows(batches):
            made = _surrounding_rows(row["parcel"], Parcel(row, length, piece), row["shared"], n)
            yield from _batches(made, names, kinds)

    def cut(batches):
        for row in _rows(batches):
            yield _cut(Parcel(row, length, piece), n, row["shared"] or [], row["strings"] or [])

    reply = "parcel long, shard int, answer binary"
    to_shards = lambda df: df.repartition("shard").sortWithinPartitions("shard", "parcel")
    anchors = to_shards(parcels.mapInArrow(hashes, "parcel long, shard int, hashes binary, repeats binary"))
    shared = stored.table(_answers(anchors.mapInArrow(lambda it: _shared(it, hot), reply), "shared"))
    sent = parcels.join(shared, "parcel").mapInArrow(
        around, "parcel long, shard int, hashes binary, around binary, ids binary, shape binary, data binary"
    )
    strings = to_shards(sent).mapInArrow(lambda it: _removed(it, length, piece), reply)
    strings = stored.table(_answers(strings, "strings"))
    whole = parcels.join(shared, "parcel", "left").join(strings, "parcel", "left")
    return whole.mapInArrow(cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")
