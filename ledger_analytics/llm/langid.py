"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of lower-cased texts per language in the tasks and sums
them; the matrix of log probabilities (languages by ``2 ** HASH_BITS``) has a fixed size
per language and goes to the tasks with the closure. Scoring is sparse: the n-grams of a
batch of texts are hashed as one array and their log probabilities gathered and summed by
text, so nothing of the width of the matrix is made per text.

Training may read a bounded sample: at most ``TRAIN_ROWS`` rows per language, the first by
hash of their id. Scoring reads whole texts.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for all
texts if nothing could be learned; equal scores go to the first language by name; null
languages and null texts teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_analytics.llm.arrow import extend, mix, slices, utf8
from ledger_analytics.llm.columns import Numbered

ORDERS = (1, 2, 3)
HASH_BITS = 14
SMOOTHING = 0.5
TRAIN_ROWS = 4000
UNKNOWN = "und"
#: N-grams of a text that tell how probable texts of its language usually are.
LEAST_GRAMS = 100
#: Deviation of a language whose labelled texts are all alike.
LEAST_DEVIATION = 0.15
#: Deviations below the usual beyond which a text is of no known language.
MOST_UNUSUAL = 8.0

_BLANK = 32


_lower: list[np.ndarray] = []


def lowered(points: np.ndarray) -> np.ndarray:
    """Code points of lower-case letters, each for itself: what stands beside it does not count,
    and a letter that would become two stays."""
    if not _lower:
        low = (chr(c).lower() for c in range(0x20000))
        _lower.append(np.fromiter((ord(x) if len(x) == 1 else c for c, x in enumerate(low)), np.uint32, 0x20000))
    return np.where(points < 0x20000, _lower[0][np.minimum(points, 0x1FFFF)], points)


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, and the rows' offsets among them. Bytes that are
    not UTF-8 count as U+FFFD."""
    raw = data.tobytes()
    continues = (data & 0xC0) == 0x80
    try:
        if continues[off[:-1][off[:-1] < len(data)]].any():
            raise ValueError("a text begins inside of a character")
        text = raw.decode()
        # offsets in characters: bytes that do not continue a character
        at = np.concatenate([[0], np.cumsum(~continues)])[off]
    except ValueError:
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        text, at = "".join(parts), np.cumsum([0, *map(len, parts)])
    return lowered(np.frombuffer(text.encode("utf-32-le"), np.uint32)), at


_letters: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0][points]


def hashed_grams(data: np.ndarray, off: np.ndarray, orders=ORDERS, bits: int = HASH_BITS):
    """For each order the hashed n-grams of all texts and the rows' offsets among them, and
    for each row whether it has a letter. What is not a letter counts as one blank; runs of
    blanks give no n-grams of their own."""
    points, at = code_points(data, off)
    letter = is_letter(points)
    has_letter = np.diff(np.concatenate([[0], np.cumsum(letter)])[at]) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the blank after a word
    # each text begins with a blank, so that no n-gram joins two texts and words have starts
    rows = np.repeat(np.arange(len(off) - 1), np.diff(at))
    kept = np.flatnonzero(keep)
    n = np.bincount(rows[kept], minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(first[-1], _BLANK, np.uint64)
    out[np.arange(len(kept)) + rows[kept] + 1] = np.where(letter[kept], points[kept], _BLANK)
    grams = []
    shift = np.uint64(64 - bits)
    for k in orders:
        h = np.full(len(out), k, np.uint64)
        for i in range(k):
            h[: len(out) - i] = h[: len(out) - i] * np.uint64(0x100000001B3) + out[i:]
        h = (mix(h) >> shift).astype(np.int32)
        # the last k - 1 starts of a text would run into the next one
        inside = np.ones(len(out), bool)
        for i in range(1, k):
            inside[np.maximum(first[1:] - i, first[:-1])] = False
        offsets = np.concatenate([[0], np.cumsum(inside)])[first]
        grams.append((h[inside], offsets))
    return grams, has_letter


@dataclass
class LanguageModel:
    """Languages by name, their log priors, and per order the log probabilities
    (language by hashed n-gram)."""

    languages: list[str]
    prior: np.ndarray
    table: np.ndarray  # orders, languages, 2 ** bits
    #: By language, mean and deviation of texts' mean log probability per n-gram.
    usual: np.ndarray | None = None

    @property
    def bits(self) -> int:
        return int(self.table.shape[2]).bit_length() - 1

    def scores(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log joint probability by row and language; whether the row has a letter; its n-grams."""
        grams, has_letter = hashed_grams(data, off, ORDERS, self.bits)
        total = np.tile(self.prior, (len(off) - 1, 1))
        n = np.zeros(len(off) - 1, np.int64)
        for (h, at), by_language in zip(grams, self.table):
            n += np.diff(at)
            full = np.flatnonzero(np.diff(at))
            if not len(full):
                continue
            for i, logs in enumerate(by_language):
                total[full, i] += np.add.reduceat(logs[h], at[full])
        return total, has_letter, n

    def unusual(self, logs: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many deviations the texts' mean log probability is below what is usual in their
        language; in short texts the deviation is taken to be larger."""
        mean, deviation = self.usual[best].T
        found = (logs[np.arange(len(best)), best] - self.prior[best]) / np.maximum(n, 1)
        return (mean - found) / (deviation * np.sqrt(np.maximum(1, LEAST_GRAMS / np.maximum(n, 1))))


def _sample(docs: DataFrame, text: str, lang: str, doc_id: str, rows: int) -> tuple[list[str], DataFrame | None]:
    """The languages of ``docs`` and (lang, text) of at most ``rows`` labelled rows of each."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # narrow first: choose ids, then read their texts
    order = Window.partitionBy(lang).orderBy("_h")
    hashed = labelled.select(lang, F.xxhash64(doc_id, F.lit(7)).alias("_h"))
    counts = {r[lang]: r["n"] for r in hashed.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], None
    languages = sorted(counts)
    # a share of the hash range that holds somewhat more rows than wanted, then the exact cut
    bound = F.lit(1.0)
    share = {k: min(1.0, 2.0 * rows / n + 100.0 / n) for k, n in counts.items()}
    for k, s in share.items():
        bound = F.when(F.col(lang) == k, F.lit(s)).otherwise(bound)
    near = hashed.where(F.pmod(F.col("_h"), F.lit(1 << 30)) < bound * (1 << 30))
    limit = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows)
    limit = {r[lang]: r["m"] for r in limit.groupBy(lang).agg(F.max("_h").alias("m")).collect()}
    chosen = F.lit(False)
    for k, m in limit.items():
        chosen = F.when(F.col(lang) == k, F.xxhash64(doc_id, F.lit(7)) <= m).otherwise(chosen)
    dense = F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(1 << 30)) < bound * (1 << 30)
    return languages, labelled.where(chosen & dense).select(F.col(lang).alias("lang"), F.col(text).alias("text"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = TRAIN_ROWS,
          bits: int = HASH_BITS, smoothing: float = SMOOTHING) -> LanguageModel:
    """The model of the labelled rows of ``docs``, at most ``rows`` per language."""
    languages, sample = _sample(docs, text, lang, doc_id, rows)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((len(ORDERS), 0, 1 << bits)))

    def count(batches):
        sums = np.zeros((len(ORDERS), len(languages), 1 << bits), np.int64)
        docs_ = np.zeros(len(languages), np.int64)
        for batch in batches:
            of = np.array([languages.index(x) for x in batch.column(0).to_pylist()])
            data, off = utf8(batch.column(1))
            for a, b in slices(off):
                grams, has_letter = hashed_grams(data[off[a] : off[b]], off[a : b + 1] - off[a], ORDERS, bits)
                docs_ += np.bincount(of[a:b][has_letter], minlength=len(languages))
                for o, (h, at) in enumerate(grams):
                    row = np.repeat(of[a:b], np.diff(at)).astype(np.int64)
                    flat = np.bincount(row * (1 << bits) + h, minlength=len(languages) << bits)
                    sums[o] += flat.reshape(len(languages), -1)
        for i in range(len(languages)):
            if docs_[i]:
                vector = np.concatenate([[docs_[i]], *sums[:, i]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([vector.astype(np.int64).tobytes()], pa.binary())], names=["lang", "counts"]
                )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(raw, np.int64)
                sums[i] = sums[i] + v if i in sums else v
        for i, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["lang", "counts"])

    schema = "lang int, counts binary"
    made = sample.mapInArrow(count, schema).repartition(max(1, min(64, len(languages))), "lang").mapInArrow(add, schema).collect()
    counted = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in made}
    known = sorted(counted)
    if not known:
        return LanguageModel([], np.zeros(0), np.zeros((len(ORDERS), 0, 1 << bits)))
    docs_in = np.array([counted[i][0] for i in known], float)
    grams = np.stack([counted[i][1:].reshape(len(ORDERS), -1) for i in known], axis=1) + smoothing
    table = np.log(grams / grams.sum(axis=2, keepdims=True))
    return LanguageModel([languages[i] for i in known], np.log(docs_in / docs_in.sum()), table)


def fit_usual(model: LanguageModel, docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> None:
    """Learn from the labelled rows how probable texts of a language usually are."""
    languages, sample = _sample(docs, text, lang, doc_id, rows)
    if not model.languages:
        return

    def measure(batches):
        sums = np.zeros((len(model.languages), 3))
        for batch in batches:
            of = np.array([model.languages.index(x) if x in model.languages else -1 for x in batch.column(0).to_pylist()])
            data, off = utf8(batch.column(1))
            for a, b in slices(off):
                logs, _, n = model.scores(data[off[a] : off[b]], off[a : b + 1] - off[a])
                ok = np.flatnonzero((n >= LEAST_GRAMS) & (of[a:b] >= 0))
                k = of[a:b][ok]
                v = (logs[ok, k] - model.prior[k]) / n[ok]
                np.add.at(sums, k, np.stack([np.ones(len(v)), v, v * v], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), *[pa.array(c) for c in sums.T]], names=["lang", "n", "s", "q"])

    made = sample.mapInArrow(measure, "lang int, n double, s double, q double").groupBy("lang").agg(*[F.sum(c).alias(c) for c in "nsq"])
    model.usual = np.tile([0.0, np.inf], (len(model.languages), 1))  # too few texts: nothing is unusual
    for r in made.collect():
        if r["n"] >= 10:
            mean = r["s"] / r["n"]
            model.usual[r["lang"]] = mean, max(np.sqrt(max(r["q"] / r["n"] - mean**2, 0)), LEAST_DEVIATION)


def with_language(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (default: all) with ``lang_pred`` and ``score``, the probability
    of that language given the text, and ``unusual`` if the model knows what is usual (see
    ``fit_usual``). Old columns of these names give way."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    fields += [T.StructField("unusual", T.DoubleType())] * (model.usual is not None)
    keep = list(docs.columns) if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size fixed by languages and bits

    def compute():
        model = shared.value

        def f(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            data, off = utf8(batch.column(batch.schema.get_field_index(text)))
            names, scores, unusual = [], [], []
            for a, b in slices(off):
                if not model.languages:
                    names += [UNKNOWN] * (b - a)
                    scores.append(np.zeros(b - a))
                    continue
                logs, has_letter, n = model.scores(data[off[a] : off[b]], off[a : b + 1] - off[a])
                best = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                names += [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, has_letter)]
                scores.append(np.where(has_letter, share, 0.0))
                if model.usual is not None:
                    unusual.append(model.unusual(logs, best, n))
            out = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0))}
            return out | ({"unusual": pa.array(np.concatenate(unusual))} if unusual else {})

        return f

    return extend(docs.select(*dict.fromkeys([*keep, text])), compute, fields, keep)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified_documents(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: float = 0.5, most_unusual: float = MOST_UNUSUAL
) -> DataFrame:
    """The documents of a known language, unchanged: those whose likeliest language has the
    probability ``least``, and whose n-grams are not much less probable in it than those of its
    labelled texts, by ``most_unusual`` deviations. The second test finds texts of languages
    that the model does not know, since some known language is always the likeliest."""
    named = Numbered(docs)
    at = {"text": named[text], "lang": named[lang], "doc_id": named[doc_id]}
    model = train(named.df, **at)
    fit_usual(model, named.df, **at)
    if not model.languages:
        return docs.where("false")
    found = with_language(named.df, model, text=named[text])
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least) & (F.col("unusual") <= most_unusual)
    return named.back(found.where(known))
