"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length code.

Texts are encoded by a given tokenizer, in ascending order of id. A first table holds plain
ids in blocks; their frequencies over the whole corpus rank the vocabulary, and the files
hold ranks, so that frequent tokens take one byte. A block codes each number in one to four
bytes; the lengths stand apart, two bits each, in control bytes. Decoding looks up the four
lengths of each control byte in a table and gathers all numbers of a block at once.

A token file is a folder of two Parquet tables, so that Spark's committer and any store that
Spark reads hold it: ``dictionary`` (one row: the token id of each rank) and ``blocks``, whose
rows (part, seq, doc_ids, n_tokens, length codes, token codes) follow the ids in ascending
order. Only the dictionary, bounded by the vocabulary, is sent to all tasks.

Words are encoded once and kept in a bounded table of each worker: the tokenizer splits texts
into words by a fixed pattern before it merges bytes, so the bytes of many texts are split by
that pattern as one array, words of up to ``WORD_BYTES`` are looked up by their bytes in an open
hash table, and only new words are given to the tokenizer. Texts with characters on which two
Unicode tables may differ, with bytes that are not UTF-8 or with the string of an added token,
and whatever a tokenizer of another kind reads, go to it whole.

Defined results: null and empty texts have the end id only; rows without an id come first;
rows with equal ids follow each other by text; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledger_analytics.llm.arrow import slices, utf8
from ledger_analytics.llm.storage import Stored
from ledger_analytics.sources.materialize import checkpoint_root

#: Tokens of a block.
BLOCK_TOKENS = 1 << 18
#: Words whose ids a worker keeps.
KEPT_WORDS = 400_000
#: Bytes of words that are found by hash; longer ones are looked up one by one.
WORD_BYTES = 16
#: Bytes of text that are split into words at a time; a longer text is taken alone.
SPLIT_BYTES = 1 << 19

# The words by which byte-level tokenizers of this family split texts,
#   '(s|t|m|d|re|ve|ll) | ?letters | ?numbers | ?others | blanks, without the last one if a word follows
# for the characters on which all Unicode tables agree. Texts with others go to the tokenizer whole.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_USUAL = "\t\n\x20-\x7e\xa1-ɏ‐-‧‰-⁞"


# --- coding --------------------------------------------------------------------

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_numbers(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of numbers below 2 ** 32."""
    values = np.ascontiguousarray(values, "<u4")
    length = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = length - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4) < length[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``encode_numbers``."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(length) - length
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    view = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    return view[start] & _MASKS[length]


# --- words ---------------------------------------------------------------------

#: Kinds of bytes; a character's bytes are all of its kind.
_END, _LETTER, _NUMBER, _OTHER, _SPACE, _BLANK, _UNUSUAL = range(7)


def _kinds(last: int) -> np.ndarray:
    """Kind of each code point up to ``last``."""
    points = "".join(map(chr, range(last + 1)))
    out = np.full(last + 1, _UNUSUAL, np.uint8)
    for kind, pattern in ((_OTHER, _USUAL), (_LETTER, _LETTERS), (_NUMBER, _NUMBERS), (_BLANK, "\t\n"), (_SPACE, " ")):
        out[[m.start() for m in re.finditer(f"[{pattern}]", points)]] = kind
    return out


_KIND = _kinds(0x2060)
_BYTE_KIND = np.full(256, _UNUSUAL, np.uint8)
_BYTE_KIND[:128] = _KIND[:128]
_BYTE_KIND[255] = _END
_AFTER_ONE = np.isin(np.arange(256), list(b"smtd"))
_MASK8 = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def byte_kinds(buf: np.ndarray) -> np.ndarray:
    """Kinds of UTF-8 bytes; 255 parts texts."""
    kind = _BYTE_KIND[buf]
    high = np.flatnonzero((buf >= 0xC2) & (buf < 0xF0))
    if len(high):
        last = len(buf) - 1
        first, second, third = (buf[np.minimum(high + i, last)].astype(np.int64) for i in range(3))
        follows = second & 0xC0 == 0x80
        two = follows & (first < 0xE0)
        at = high[two]
        kind[at] = kind[at + 1] = _KIND[(first[two] & 0x1F) << 6 | second[two] & 0x3F]
        three = follows & (first >= 0xE0) & (third & 0xC0 == 0x80)
        code = (first & 0x0F) << 12 | (second & 0x3F) << 6 | third & 0x3F
        three &= (code >= 0x800) & (code < len(_KIND))
        at = high[three]
        kind[at] = kind[at + 1] = kind[at + 2] = _KIND[code[three]]
    return kind


def word_starts(buf: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where words begin, and all places of kind ``_END``. The first and last byte are such."""
    word, blank = (kind >= _LETTER) & (kind <= _OTHER), kind >= _SPACE
    start = kind == _END
    # a run of one kind, unless a space before it belongs to it
    start[1:] |= word[1:] & (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
    # blanks in one piece, but the last one before a word stands alone or goes with the word
    start[1:-1] |= blank[1:-1] & (~blank[:-2] | word[2:])
    quote = np.flatnonzero((buf == 0x27) & start)
    quote = quote[quote < len(buf) - 2]
    if len(quote):
        one, two = buf[quote + 1], buf[quote + 2]
        short = quote[_AFTER_ONE[one]]
        long = quote[((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)]
        start[short + 1] = start[long + 1] = False
        start[short + 2] = start[long + 3] = True
    return start


# --- tokenizer -----------------------------------------------------------------

_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """A tokenizer file and the words met so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self._tokenizer.get_added_tokens_decoder().values()} - {""}
        self._added = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(added))) if added else None
        self.size = self._tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        pre = str(self._tokenizer.pre_tokenizer)
        self._by_word = pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre and not self._tokenizer.normalizer
        # tokens that begin with a space, which byte-level vocabularies write as U+0120
        self._spaced = np.zeros(self.size, bool)
        self._spaced[[i for t, i in self._tokenizer.get_vocab().items() if t[:1] == "\u0120"]] = True
        self._clear()

    @classmethod
    def load(cls, path: str) -> "Encoder":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind) for e in found]

    # The table: slots hold numbers of words; word w has the bytes low[w], high[w] and the
    # ids pool[first[w] : first[w] + count[w]]. Longer words are numbered in a dictionary.

    def _clear(self) -> None:
        self._slots = np.full(16, -1, np.int32)
        self._low, self._high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self._first, self._count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._used = np.zeros(0, bool)
        self._pool = np.zeros(0, self.kind)
        self._long: dict[bytes, int] = {}

    def _place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(20)).astype(np.int64) & (len(self._slots) - 1)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for new ones."""
        if not len(self._low):
            return np.full(len(low), -1, np.int64)
        at = self._place(low, high)
        found = self._slots[at].astype(np.int64)
        open_ = np.flatnonzero((found >= 0) & ((self._low[found] != low) | (self._high[found] != high)))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self._slots) - 1)
            number = self._slots[at[open_]].astype(np.int64)
            found[open_] = number
            open_ = open_[(number >= 0) & ((self._low[number] != low[open_]) | (self._high[number] != high[open_]))]
        return found

    def _add(self, words: list[bytes], low: np.ndarray, high: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """New distinct words, their first and next eight bytes, and their ids one after the other."""
        number = len(self._first) + np.arange(len(words))
        self._first = np.append(self._first, len(self._pool) + np.cumsum(count) - count)
        self._count, self._pool = np.append(self._count, count), np.append(self._pool, ids)
        self._low, self._high = np.append(self._low, low), np.append(self._high, high)
        self._used = np.append(self._used, np.zeros(len(words), bool))
        short = np.fromiter((len(w) <= WORD_BYTES for w in words), bool, len(words))
        self._long.update((words[i], int(number[i])) for i in np.flatnonzero(~short))
        if 2 * len(self._first) > len(self._slots):
            self._slots = np.full(2 << (2 * len(self._first)).bit_length(), -1, np.int32)
            every = np.ones(len(self._first), bool)
            every[list(self._long.values())] = False
            self._file(np.flatnonzero(every))
        else:
            self._file(number[short])

    def _file(self, number: np.ndarray) -> None:
        at = self._place(self._low[number], self._high[number])
        open_ = np.arange(len(number))
        while len(open_):
            free = open_[self._slots[at[open_]] < 0]
            self._slots[at[free]] = number[free]  # of several at one place the last stays
            open_ = open_[self._slots[at[open_]] != number[open_]]
            at[open_] = (at[open_] + 1) & (len(self._slots) - 1)

    def _forget(self) -> None:
        """Keep the words met again since the last time, if they are not too many."""
        keep = np.flatnonzero(self._used)
        if len(keep) > KEPT_WORDS // 2:
            return self._clear()
        new = np.full(len(self._used), -1, np.int64)
        new[keep] = np.arange(len(keep))
        long = {w: int(new[i]) for w, i in self._long.items() if new[i] >= 0}
        low, high, count = self._low[keep], self._high[keep], self._count[keep]
        pool = self._pool[_stretches(self._first[keep], count)]
        self._clear()
        words = [b""] * len(keep)
        for w, i in long.items():
            words[i] = w
        self._add(words, low, high, pool, count)

    def _new_ids(self, words: list[str], spaced: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has. The first ``spaced`` words begin with a
        space and end otherwise: a text of them is split before each space, as tokens tell."""
        ids, count = np.zeros(0, self.kind), np.zeros(0, np.int64)
        if spaced:
            ids = np.concatenate(self._whole(["".join(words[a : min(spaced, a + 500)]) for a in range(0, spaced, 500)]))
            count = np.diff(np.flatnonzero(self._spaced[ids]), append=len(ids))
        if len(words) > spaced:
            found = self._tokenizer.encode(words[spaced:], is_pretokenized=True, add_special_tokens=False)
            ids = np.append(ids, np.array(found.ids, self.kind))
            count = np.append(count, np.bincount(np.array(found.word_ids, np.int64), minlength=len(words) - spaced))
        return ids, count

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8 bytes and offsets), and how many each text has."""
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        if not self._by_word:
            ids = self._whole([t.decode("utf-8", "replace") for t in texts])
            return np.concatenate([np.zeros(0, self.kind), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))
        joined = b"\xff" + b"\xff".join(texts) + b"\xff" if texts else b"\xff"
        buf = np.frombuffer(joined + bytes(WORD_BYTES), np.uint8)
        body = buf[: len(joined)]
        begin = off[:-1] + 1 + np.arange(len(texts))  # of each text in buf
        kind = byte_kinds(body)
        odd = np.flatnonzero(kind == _UNUSUAL)
        # 255 inside of a text is not UTF-8 either
        if np.count_nonzero(body == 0xFF) > len(texts) + 1:
            inside = np.ones(len(body), bool)
            inside[0] = inside[begin - 1] = inside[-1] = False
            odd = np.append(odd, np.flatnonzero(inside & (body == 0xFF)))
        if self._added:
            odd = np.append(odd, [m.start() for m in self._added.finditer(joined)]).astype(np.int64)
        whole = np.unique(np.searchsorted(begin, odd, "right") - 1)
        for i in whole.tolist():
            kind[begin[i] : begin[i] + len(texts[i])] = _END
        at = np.flatnonzero(word_starts(body, kind))
        length = np.diff(at, append=len(body))
        is_word = kind[at] != _END
        at, length = at[is_word], length[is_word]
        number = self._numbers(buf, at, length)
        count = self._count[number]
        ids = self._pool[_stretches(self._first[number], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        upto = total[np.searchsorted(at, np.append(begin, len(body)))]
        n = np.diff(upto)
        if len(whole):
            made = iter(self._whole([texts[i].decode("utf-8", "replace") for i in whole.tolist()]))
            is_whole = np.zeros(len(texts), bool)
            is_whole[whole] = True
            parts = [next(made) if w else ids[a:b] for w, a, b in zip(is_whole, upto, upto[1:])]
            ids, n = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, n

    def _numbers(self, buf: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of the words, after new ones have been added."""
        if len(self._first) > KEPT_WORDS:
            self._forget()
        eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        low = eight[at] & _MASK8[np.minimum(length, 8)]
        high = eight[at + 8] & _MASK8[np.clip(length - 8, 0, 8)]
        number = self._find(low, high)
        long = np.flatnonzero(length > WORD_BYTES)
        raw = buf.tobytes()
        cut = lambda i: raw[at[i] : at[i] + length[i]]
        for i in long.tolist():
            number[i] = self._long.get(cut(i), -1)
        self._used[number[number >= 0]] = True
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new: dict[bytes, int] = {}
            for i in missing.tolist():
                new.setdefault(cut(i), i)
            words = sorted(new, key=lambda w: w[0] != 32 or w[-1] in b" \t\n")
            spaced = sum(w[0] == 32 and w[-1] not in b" \t\n" for w in words)
            first = np.fromiter((new[w] for w in words), np.int64, len(words))
            self._add(words, low[first], high[first], *self._new_ids([w.decode() for w in words], spaced))
            number[missing] = self._find(low[missing], high[missing])
            for i in long.tolist():
                number[i] = self._long[cut(i)]
        return number


def _stretches(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each stretch, one after the other."""
    end = np.cumsum(count)
    return np.repeat(first - end + count, count) + np.arange(end[-1] if len(end) else 0)


# --- writing -------------------------------------------------------------------

_PLAIN = "part int, seq int, doc_ids array<long>, lengths binary, ids binary"
_CODED = (
    "part int, seq int, doc_ids array<long>, n_tokens long, length_control binary, length_data binary, "
    "control binary, data binary"
)


def encoded_slices(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Stretches of rows, whose second column is the text, with all their ids, the end id after
    each text, and how many ids each has."""
    encoder = Encoder.load(path)
    for batch in batches:
        data, off = utf8(batch.column(1))
        for a, b in slices(off, SPLIT_BYTES):
            ids, n = encoder.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
            yield batch.slice(a, b - a), np.insert(ids, np.cumsum(n), end_id), n + 1


def _plain_blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    docs: list = []
    lengths = np.zeros(0, np.int64)
    ids = np.zeros(0, Encoder.load(path).kind)

    def close(n: int) -> pa.RecordBatch:
        """A block of the first ``n`` documents at hand."""
        nonlocal seq, docs, lengths, ids
        size = int(lengths[:n].sum())
        row = [[part], [seq], [docs[:n]], [lengths[:n].astype("<u4").tobytes()], [ids[:size].tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        seq, docs, lengths, ids = seq + 1, docs[n:], lengths[n:], ids[size:]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "seq", "doc_ids", "lengths", "ids"])

    for rows, more, n in encoded_slices(batches, path, end_id):
        docs = docs + rows.column(0).to_pylist()
        lengths, ids = np.append(lengths, n), np.append(ids, more)
        while len(ids) >= BLOCK_TOKENS:
            yield close(1 + int(np.searchsorted(np.cumsum(lengths), BLOCK_TOKENS)))
    if docs:
        yield close(len(docs))


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str | None = None, text: str = "text", doc_id: str = "doc_id", end_id: int = 2
) -> str:
    """Write the token file of ``docs`` and return its folder (default: a new one in the
    checkpoint folder). ``tokenizer`` is a file that executors can read; each document ends
    with ``end_id``."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_root(spark)}/llm/tokens-{uuid.uuid4().hex}"
    stored = Stored(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    plain = stored.table(ordered.mapInArrow(lambda it: _plain_blocks(it, tokenizer, end_id), _PLAIN))
    kind = Encoder.load(tokenizer).kind
    vocabulary = max(Encoder.load(tokenizer).size, end_id + 1)

    def count(batches):
        n = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                n += np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=vocabulary)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has])], names=["id", "n"])

    counts = plain.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]  # at most the vocabulary
    spark.createDataFrame([(ranked,)], "token_ids array<long>").coalesce(1).write.parquet(f"{path}/dictionary")
    rank = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank[ranked] = np.arange(len(ranked))
    shared = spark.sparkContext.broadcast(rank)

    def code(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, ids, lengths, raw = (batch.column(c)[i] for c in range(5))
                lengths = np.frombuffer(lengths.as_buffer(), "<u4")
                codes = [*encode_numbers(lengths), *encode_numbers(shared.value[np.frombuffer(raw.as_buffer(), kind)])]
                arrays = [pa.array([part.as_py()], pa.int32()), pa.array([seq.as_py()], pa.int32()), pa.array([ids.as_py()], pa.list_(pa.int64()))]
                arrays += [pa.array([int(lengths.sum())], pa.int64()), *[pa.array([c], pa.binary()) for c in codes]]
                names = ["part", "seq", "doc_ids", "n_tokens", "length_control", "length_data", "control", "data"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    plain.mapInArrow(code, _CODED).write.option("compression", "zstd").parquet(f"{path}/blocks")
    stored.keep()
    return path


# --- reading -------------------------------------------------------------------


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CODED).parquet(f"{path}/blocks")


def documents_of(batches: Iterator[pa.RecordBatch], dictionary: np.ndarray) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """Of each block: part, seq, document ids, their numbers of tokens, and all token ids."""
    for batch in batches:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            value = lambda c: at[c][i].as_py()
            ids = value("doc_ids")
            lengths = decode_numbers(value("length_control"), value("length_data"), len(ids))
            ranks = decode_numbers(value("control"), value("data"), value("n_tokens"))
            yield value("part"), value("seq"), ids, lengths.astype(np.int64), dictionary[ranks]


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, and with ``with_ids`` token_ids) of a token
    file; ``start`` is the number of ids of all documents before."""
    ranked = spark.read.parquet(f"{path}/dictionary").first()["token_ids"]
    shared = spark.sparkContext.broadcast(np.array(ranked, "<u4"))

    def read(batches):
        for part, seq, ids, lengths, tokens in documents_of(batches, shared.value):
            end = np.cumsum(lengths)
            start = end - lengths
            raw = tokens.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist())]
            n = len(ids)
            arrays = [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())]
            names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(start, end[-1:] if n else 0).astype(np.int32)), pa.array(tokens.astype(np.int64))))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * with_ids
    blocks = read_blocks(spark, path)
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "seq", "n_tokens")
    # one row for each range of ids that was written in one task
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier("part")), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(earlier("part", "seq")), F.lit(0))
    first = sizes.select("part", "seq", within.alias("within")).join(parts, "part")
    first = first.select("part", "seq", (F.col("before") + F.col("within")).alias("first"))
    rows = blocks.mapInArrow(read, schema).join(first, ["part", "seq"])
    return rows.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["token_ids"] * with_ids)
