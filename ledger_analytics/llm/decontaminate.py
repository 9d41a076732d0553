"""Benchmark decontamination: a prefix-filtered set join of documents and item windows.

Each item is cut into windows of ``WINDOW`` consecutive words (a shorter item is one
window). A window is contained in a document if its words stand there in a row. All its
shingles must then occur, so by the prefix filter one token is enough to find it: the
rarest, by counts over all documents. A document position with that shingle gives a
candidate; the length and position bound asks that the window, laid at the one place
where it can stand, lies within the document; then all its words are compared by hash,
and at last byte by byte.

The item windows go to the tasks in blocks of at most ``BLOCK_BYTES``; more windows are
more passes over the documents, never a larger broadcast.

Defined results: null and empty texts have no words and no hits; items without words, and
items without an id, have no windows; repeated items all count by their own id; repeated
document rows are rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_analytics.llm.arrow import LOWER, WORD_BYTE, all_stretches, extend, prefix_sums, runs, slices, stretch_hashes, utf8
from ledger_analytics.llm.columns import Numbered
from ledger_analytics.llm.storage import Stored

WINDOW = 10
SHINGLE = 5
#: Text of the windows that are sent to the tasks at a time.
BLOCK_BYTES = 16 << 20


class Words:
    """The words of some texts, by position and hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.low = LOWER[data]
        self.start, self.end, self.first = runs(WORD_BYTE[self.low], off)
        self.hash = stretch_hashes(prefix_sums(self.low), self.start, self.end)
        self._sums = prefix_sums(self.hash)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; may run over the end of a text."""
        return all_stretches(self._sums, k)

    def text(self, i: int, j: int) -> bytes:
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j]))


def item_windows(items: DataFrame, text: str, item_id: str, window: int) -> DataFrame:
    """Distinct windows (words: their text with single spaces, ids: the items that have them)."""
    ids = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("t"))
    lower = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = ids.select("item", words.alias("w")).where(F.size("w") > 0).select("item", "w", F.explode(starts).alias("at"))
    each = each.select("item", F.array_join(F.slice("w", F.col("at"), window), " ").alias("words"))
    return each.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("ids"))


class Windows:
    """A block of windows as arrays; plain data, so that it can be sent to the tasks."""

    def __init__(self, rows: list, shingle: int):
        self.text = [r["words"].encode() for r in rows]
        self.ids = [r["ids"] for r in rows]
        off = np.cumsum([0, *map(len, self.text)])
        words = Words(np.frombuffer(b"".join(self.text), np.uint8), off)
        self.length = np.diff(words.first)
        self.hash = np.zeros((len(rows), int(self.length.max(initial=0))), np.uint64)
        for c in range(self.hash.shape[1]):
            has = np.flatnonzero(self.length > c)
            self.hash[has, c] = words.hash[words.first[has] + c]
        self.k = np.minimum(self.length, shingle)
        self.sizes = np.unique(self.k).tolist()
        parts = []
        for k in self.sizes:
            of = np.flatnonzero(self.k == k)
            n = self.length[of] - k + 1
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(of, n)
            parts.append((of, place, words.shingles(k)[words.first[of] + place], np.full(len(of), k)))
        # one entry for each shingle of each window
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.of, self.place, self.shingle, self.size = (np.concatenate(x) for x in zip(none, *parts))

    def known(self, k: int) -> np.ndarray:
        return np.unique(self.shingle[self.size == k])


def _blocks(windows: DataFrame, limit: int):
    """Windows in pieces of at most ``limit`` bytes each, one piece on the driver at a time."""
    total = windows.agg(F.sum(F.octet_length("words") + F.size("ids") * 16 + 64)).first()[0] or 0
    n = max(1, -(-int(total) * 2 // limit))
    for i in range(n):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(n)) == i).orderBy("words").collect()
        if rows:
            yield rows


def _count(docs: DataFrame, text: str, block: Windows) -> dict[int, dict[int, int]]:
    """How often each shingle of the block stands in the documents, by size."""

    def run(batches):
        known = {k: block.known(k) for k in block.sizes}
        counts = {k: np.zeros(len(v), np.int64) for k, v in known.items()}
        for batch in batches:
            data, off = utf8(batch.column(0))
            for a, b in slices(off):
                local = off[a : b + 1] - off[a]
                words = Words(data[off[a] : off[b]], local)
                for k, all_ in known.items():
                    pos, which = _find(words.shingles(k), all_)
                    doc = np.searchsorted(words.first, pos, "right") - 1
                    counts[k] += np.bincount(which[pos + k <= words.first[doc + 1]], minlength=len(all_))
        for k, c in counts.items():
            has = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(has), k, np.int32)), pa.array(known[k][has].view(np.int64)), pa.array(c[has])],
                names=["k", "h", "n"],
            )

    rows = docs.select(text).mapInArrow(run, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).collect()
    out: dict[int, dict[int, int]] = {k: {} for k in block.sizes}
    for r in rows:
        out[r["k"]][r["h"] % (1 << 64)] = r["n"]
    return out


def _find(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``hashes`` that are in the sorted ``known``, and where."""
    # a table of the top bits keeps most positions from the binary search
    seen = np.zeros(1 << 20, bool)
    seen[(known >> np.uint64(44)).astype(np.int64)] = True
    pos = np.flatnonzero(seen[(hashes >> np.uint64(44)).astype(np.int64)])
    which = np.searchsorted(known, hashes[pos])
    hit = which < len(known)
    hit[hit] = known[which[hit]] == hashes[pos[hit]]
    return pos[hit], which[hit]


def _hits(docs: DataFrame, keep: list[str], text: str, block: Windows, counts: dict[int, dict[int, int]]) -> DataFrame:
    freq = np.array([counts[k].get(h, 0) for k, h in zip(block.size.tolist(), block.shingle.tolist())], np.int64)
    order = np.lexsort((block.place, block.shingle, freq, block.of))
    first = order[np.unique(block.of[order], return_index=True)[1]]
    # a window whose rarest shingle stands nowhere can be nowhere
    first = first[freq[first] > 0]
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.LongType(), False)),
        T.StructField("item_ids", T.ArrayType(T.StringType(), False)),
    ]

    def compute():
        by_size = []
        for k in block.sizes:
            mine = first[block.size[first] == k]
            mine = mine[np.argsort(block.shingle[mine], kind="stable")]
            known, at, n = np.unique(block.shingle[mine], return_index=True, return_counts=True)
            if len(known):
                by_size.append((k, known, at, n, block.of[mine], block.place[mine]))

        def f(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            data, off = utf8(batch.column(batch.schema.get_field_index(text)))
            sizes, hits, ids = [], [], []
            for a, b in slices(off):
                words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                sizes.append(np.diff(words.first))
                docs_, starts, wins = [], [], []
                for k, known, at, n, of, place in by_size:
                    pos, which = _find(words.shingles(k), known)
                    many = n[which]
                    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    entry = np.repeat(at[which], many) + inner
                    start, win = np.repeat(pos, many) - place[entry], of[entry]
                    doc = np.searchsorted(words.first, np.repeat(pos, many), "right") - 1
                    fits = (start >= words.first[doc]) & (start + block.length[win] <= words.first[doc + 1])
                    doc, start, win = doc[fits], start[fits], win[fits]
                    for c in range(block.hash.shape[1]):
                        same = block.length[win] <= c
                        same |= words.hash[np.minimum(start + c, len(words.hash) - 1)] == block.hash[win, c]
                        doc, start, win = doc[same], start[same], win[same]
                    docs_.append(doc), starts.append(start), wins.append(win)
                doc, start, win = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs_, starts, wins))
                exact = [words.text(s, s + block.length[w]) == block.text[w] for s, w in zip(start, win)]
                doc, start, win = doc[exact], start[exact], win[exact]
                cover = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + block.length[win], -1)
                hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                in_doc = np.searchsorted(hit, words.first)
                found: dict[int, set] = {}
                for d, w in set(zip(doc.tolist(), win.tolist())):
                    found.setdefault(d, set()).update(block.ids[w])
                for d in range(b - a):
                    hits.append(hit[in_doc[d] : in_doc[d + 1]] - words.first[d])
                    ids.append(sorted(found.get(d, ())))
            lengths = np.cumsum([0, *map(len, hits)]).astype(np.int32)
            flat = np.concatenate(hits) if hits else np.zeros(0, np.int64)
            return {
                "n_words": pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)),
                "hit_words": pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat.astype(np.int64))),
                "item_ids": pa.array(ids, pa.list_(pa.string())),
            }

        return f

    return extend(docs.select(*dict.fromkeys([*keep, text])), compute, fields, keep)


def contamination(
    docs: DataFrame, items: DataFrame, keep: list[str] | None = None, text: str = "text", item_text: str = "text",
    item_id: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns ``keep`` (default: all) of every document with ``n_words``, ``hit_words``
    (ascending positions of the words that a window covers) and ``item_ids`` (as sorted
    strings, of the items with a window in it). Old columns of these names give way."""
    made = ("n_words", "hit_words", "item_ids")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    windows = Stored(docs.sparkSession).table(item_windows(items, item_text, item_id, window))
    out = docs.select(*dict.fromkeys([*keep, text]))
    hits, ids = [], []
    for i, rows in enumerate(_blocks(windows, block_bytes)):
        block = Windows(rows, shingle)
        out = _hits(out, [c for c in out.columns if c != "n_words"], text, block, _count(docs, text, block))
        out = out.withColumnsRenamed({"hit_words": f"_hits{i}", "item_ids": f"_ids{i}"})
        hits.append(f"_hits{i}"), ids.append(f"_ids{i}")
    if not hits:
        none = Windows([], shingle)
        return _hits(out, keep, text, none, {})
    merged = lambda cs: F.array_sort(F.array_distinct(F.flatten(F.array(*cs)))) if len(cs) > 1 else F.col(cs[0])
    return out.select(*keep, "n_words", merged(hits).alias("hit_words"), merged(ids).alias("item_ids"))


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no window of any item, unchanged."""
    named = Numbered(docs)
    return named.back(contamination(named.df, items, text=named[text]).where(F.size("hit_words") == 0))
