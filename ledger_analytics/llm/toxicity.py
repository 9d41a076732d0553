"""Toxicity: a lexicon met by Levenshtein automata, scored by the words around a hit.

The lexicon is learned from labelled documents: words, and stems that many words begin
with, found in far more toxic documents than others. It is held in a trie. The Levenshtein
automata of its terms, intersected with the trie, are determinised into one table: a state
is the set of trie nodes, with edits spent, that a word read so far can be at. All words of
a batch walk the table together, one letter a step, and most leave it after a few letters.
A hit is exact or misspelled (one edit, in terms of ``FUZZY_LETTERS`` or more).

A hit counts by its context: words and signs of quotation nearby (marks before and after,
reporting words) make it less, address to a person nearby makes it more. How much, and how
hits add up to a score, is a logistic regression over a handful of counts per document,
fitted on at most ``TRAIN_ROWS`` labelled rows of each class, the first by hash of their id.
Rows of a class that was cut to that weigh more, so the score is a probability at the ratio
of all labels.

Defined results: null and empty texts have no hits and the score of a text without hits; a
label table without rows of both classes gives the score 0 to all; several labels of one
document are rows of their own, null labels teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_analytics.llm.arrow import extend, slices, utf8
from ledger_analytics.llm.langid import code_points, is_letter
from ledger_analytics.llm.storage import Stored

TRAIN_ROWS = 5_000
#: Documents that a term must be in, and how much more often in toxic ones (log odds).
MIN_DOCUMENTS = 4
MIN_LOG_ODDS = 2.5
#: Letters of stems that are tried.
STEM_LETTERS = (5, 6, 7)
FUZZY_LETTERS = 5
#: Words on either side of a hit that are its context.
CONTEXT = 6

# Cues of context by default, in the languages at hand; parameters of ``train``.
QUOTING = frozenset(
    "said says called calls wrote writes quote quoted quotes word words term reported reports sagte sagt schrieb "
    "wort zitat dit disait mot citation dijo dice palabra cita".split()
)
ADDRESSING = frozenset("you your youre u du dich dein ihr tu te toi vous votre tú eres usted".split())
QUOTE_SIGNS = np.array([ord(c) for c in "\"'«»“”„‘’"], np.uint32)
#: Between two letters they are no quotation.
APOSTROPHES = np.array([ord(c) for c in "'’"], np.uint32)


# --- trie and automaton --------------------------------------------------------


class Trie:
    """Terms by letter; ``term`` of a node is the term that ends there."""

    def __init__(self, terms: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[int | None] = [None]
        for i, word in enumerate(terms):
            at = 0
            for c in word:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                at = self.child[at][c]
            self.term[at] = i


@dataclass
class Automaton:
    """Deterministic table over letter classes (0: any other letter); state 0 is dead."""

    letters: np.ndarray  # sorted code points with a class of their own
    table: np.ndarray  # state, class -> state
    exact: np.ndarray  # state -> term met without edits, or -1
    near: np.ndarray  # state -> term met with one edit, or -1
    held: np.ndarray  # state -> stem met on the way, or -1

    def classes(self, points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.letters, points)
        at[at == len(self.letters)] = 0
        return np.where(self.letters[at] == points, at + 1, 0) if len(self.letters) else np.zeros(len(points), np.int64)

    def walk(self, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word [start, end): the term it meets, or -1, and whether by one edit."""
        term = np.full(len(start), -1)
        edited = np.zeros(len(start), bool)
        stem = np.full(len(start), -1)
        live = np.arange(len(start))
        state = np.ones(len(start), np.int64)
        step = 0
        while len(live):
            done = start[live] + step >= end[live]
            if done.any():
                last, s = live[done], state[done]
                hit = np.where(self.exact[s] >= 0, self.exact[s], self.near[s])
                term[last] = hit
                edited[last] = (self.exact[s] < 0) & (hit >= 0)
                live, state = live[~done], state[~done]
            state = self.table[state, classes[start[live] + step]]
            new = self.held[state]
            stem[live] = np.where(stem[live] >= 0, stem[live], new)
            alive = state > 0
            live, state = live[alive], state[alive]
            step += 1
        by_stem = (stem >= 0) & ((term < 0) | edited)
        return np.where(by_stem, stem, term), edited & ~by_stem


def automaton(terms: list[str], stems: list[bool], fuzzy: list[bool] | None = None) -> Automaton:
    """The union of the Levenshtein automata of ``terms`` over their trie, determinised.

    Terms of ``FUZZY_LETTERS`` letters or more allow one edit (insertion, deletion,
    substitution, but not of the first letter), if ``fuzzy`` (default: all) says so. A stem
    is met as soon as it is read, and exactly.
    """
    trie = Trie(terms)
    edits_in = [len(w) >= FUZZY_LETTERS and not s and (fuzzy is None or fuzzy[i]) for i, (w, s) in enumerate(zip(terms, stems))]
    letters = sorted({c for t in terms for c in t})
    fuzzy_below = [False] * len(trie.child)
    for i in range(len(trie.child) - 1, -1, -1):
        t = trie.term[i]
        fuzzy_below[i] = (t is not None and edits_in[t]) or any(fuzzy_below[j] for j in trie.child[i].values())

    def closed(states: set) -> frozenset:
        """With the terms' letters that can be left out."""
        out = set(states)
        for node, edits in states:
            if edits == 0 and node:
                out |= {(j, 1) for j in trie.child[node].values() if fuzzy_below[j]}
        return frozenset(out)

    def step(states: frozenset, letter: str | None) -> frozenset:
        out = set()
        for node, edits in states:
            if edits:
                if letter in trie.child[node]:
                    out.add((trie.child[node][letter], edits))
                continue
            for c, j in trie.child[node].items():
                if c == letter:
                    out.add((j, 0))
                elif node and fuzzy_below[j]:
                    out.add((j, 1))  # substitution
            if node and fuzzy_below[node]:
                out.add((node, 1))  # insertion
        return closed(out)

    start = frozenset({(0, 0)})
    number, todo = {frozenset(): 0, start: 1}, [start]
    rows = {0: np.zeros(len(letters) + 1, np.int32)}
    at = {c: i for i, c in enumerate(letters, 1)}

    def numbered(to: frozenset) -> int:
        if to not in number:
            number[to] = len(number)
            todo.append(to)
        return number[to]

    while todo:
        states = todo.pop()
        # letters that no term goes on with here all lead to one state
        row = np.full(len(letters) + 1, numbered(step(states, None)), np.int32)
        for letter in {c for node, _ in states for c in trie.child[node]}:
            row[at[letter]] = numbered(step(states, letter))
        rows[number[states]] = row
    n = len(number)
    exact, near, held = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    for states, i in number.items():
        for node, edits in sorted(states):
            t = trie.term[node]
            if t is None:
                continue
            if edits == 0:
                exact[i] = t
                if stems[t]:
                    held[i] = t
            elif edits_in[t] and near[i] < 0:
                near[i] = t
    table = np.stack([rows[i] for i in range(n)])
    return Automaton(np.array([ord(c) for c in letters], np.uint32), table, exact, near, held)


# --- features ------------------------------------------------------------------

FEATURES = ("exact", "misspelled", "stem", "quoted", "addressed", "share", "any")
HITS = ("exact", "misspelled", "stem", "share", "any")


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    stems: list[bool] = field(default_factory=list)
    fuzzy: list[bool] = field(default_factory=list)  # terms whose misspellings are hits
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    bias: float | None = None  # None: nothing was learned
    quoting: frozenset = QUOTING
    addressing: frozenset = ADDRESSING

    def machine(self) -> "Automaton":
        return automaton(self.terms, self.stems, self.fuzzy or None)

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.bias is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights) + self.bias, -30, 30)))


def words_of(data: np.ndarray, off: np.ndarray):
    """Lower-cased code points, words (runs of letters) and the rows' offsets among words."""
    points, at = code_points(data, off)
    letter = is_letter(points) if len(points) else np.zeros(0, bool)
    n = len(points)
    if not n:
        none = np.zeros(0, np.int64)
        return points, none, none, np.zeros(len(off), np.int64)
    before, after = np.append(False, letter[:-1]), np.append(letter[1:], False)
    before[at[:-1][at[:-1] < n]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    return points, start, end, np.searchsorted(start, at)


def features(
    data: np.ndarray, off: np.ndarray, machine: Automaton, stems: np.ndarray, quoting: frozenset = QUOTING, addressing: frozenset = ADDRESSING
) -> np.ndarray:
    """Counts per row as ``FEATURES`` names them; counts are taken as log(1 + n)."""
    points, start, end, first = words_of(data, off)
    rows = len(off) - 1
    term, edited = machine.walk(machine.classes(points), start, end)
    hit = np.flatnonzero(term >= 0)
    row = np.searchsorted(first, hit, "right") - 1
    low, high = np.maximum(hit - CONTEXT, first[row]), np.minimum(hit + CONTEXT + 1, first[row + 1])
    sign = np.isin(points, QUOTE_SIGNS)
    inside = (start[1:] - end[:-1] == 1) & ~np.isin(np.arange(1, len(start)), first)  # one sign between words of a text
    between = end[:-1][inside]
    sign[between[np.isin(points[between], APOSTROPHES)]] = False
    signs = np.concatenate([[0], np.cumsum(sign)])
    quoted, addressed = np.zeros(len(hit), bool), np.zeros(len(hit), bool)
    for i, (h, a, b) in enumerate(zip(hit.tolist(), low.tolist(), high.tolist())):
        words = [points[s:e].tobytes().decode("utf-32-le") for s, e in zip(start[a:b].tolist(), end[a:b].tolist())]
        marks = signs[start[h]] > signs[start[a]] and signs[end[b - 1]] > signs[end[h]]
        near_mark = signs[min(end[h] + 2, len(points))] > signs[end[h]] and signs[start[h]] > signs[max(start[h] - 2, 0)]
        quoted[i] = near_mark or (marks and not quoting.isdisjoint(words))
        addressed[i] = not addressing.isdisjoint(words)
    plain = ~quoted
    by = lambda which: np.bincount(row[which], minlength=rows)
    stem = stems[term[hit]] if len(hit) else np.zeros(0, bool)
    exact, miss, stem_n = by(plain & ~edited[hit] & ~stem), by(plain & edited[hit]), by(plain & stem)
    total = exact + miss + stem_n
    share = 100 * total / np.maximum(np.diff(first), 1)
    counts = [np.log1p(x) for x in (exact, miss, stem_n, by(quoted), by(plain & addressed), share)]
    return np.stack([*counts, (exact + stem_n > 0).astype(float)], axis=1)


# --- training ------------------------------------------------------------------


def _candidates(data: np.ndarray, off: np.ndarray) -> list[set]:
    """Words of each row, and their stems marked by a trailing star."""
    points, start, end, first = words_of(data, off)
    text = points.tobytes().decode("utf-32-le")
    out = []
    for i in range(len(off) - 1):
        s, e = start[first[i] : first[i + 1]].tolist(), end[first[i] : first[i + 1]].tolist()
        words = {text[a:b] for a, b in zip(s, e)}
        stems = {w[:k] + "*" for w in words for k in STEM_LETTERS if k <= len(w)}
        out.append({w for w in words if len(w) > 2} | stems)
    return out


def _sample(labelled: DataFrame, rows: int) -> tuple[DataFrame, dict[int, float]]:
    """The first rows of each class by hash: (_id, y); and how many labels of its class each
    stands for."""
    order = Window.partitionBy("y").orderBy("h")
    counts = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, 2.0 * rows / n + 100.0 / n) for y, n in counts.items()}
    bound = F.when(F.col("y") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0)))
    near = labelled.where(F.pmod("h", F.lit(1 << 30)) < bound * (1 << 30))
    chosen = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows).select("_id", "y")
    if all(n <= rows for n in counts.values()):
        return chosen, dict.fromkeys(counts, 1.0)
    return chosen, {r["y"]: counts[r["y"]] / r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic",
          rows: int = TRAIN_ROWS, quoting: frozenset = QUOTING, addressing: frozenset = ADDRESSING) -> ToxicityModel:
    """Lexicon and weights from the documents that ``labels`` (doc_id, toxic) covers. Words of
    ``quoting`` near a hit and its quotation signs make it a quotation, words of
    ``addressing`` near it address somebody."""
    ids = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.col(toxic).cast("int").alias("y"), F.xxhash64(doc_id, F.lit(11)).alias("h")
    )
    chosen, stands_for = _sample(ids, rows)
    # at most 2 * rows labels, and of rows with one id the first text
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen.select("_id").distinct()), "_id")
    sample = texts.groupBy("_id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "_id").select("y", "text", "_id")
    sample = Stored(docs.sparkSession).table(sample)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel()

    def count(batches):
        for batch in batches:
            y = batch.column(0).to_pylist()
            data, off = utf8(batch.column(1))
            sums: dict[str, list[int]] = {}
            for a, b in slices(off):
                for label, found in zip(y[a:b], _candidates(data[off[a] : off[b]], off[a : b + 1] - off[a])):
                    for t in found:
                        sums.setdefault(t, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v[1] for v in sums.values()], pa.int64()),
                 pa.array([v[0] for v in sums.values()], pa.int64())], names=["term", "n1", "n0"],
            )

    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    terms = (
        sample.select("y", "text").mapInArrow(count, "term string, n1 long, n0 long")
        .groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        .where(F.col("n1") >= MIN_DOCUMENTS).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
        .collect()  # words of the sample that are in several toxic documents of it
    )
    chosen_terms, is_stem = _lexicon([(r["term"], r["n1"], r["n0"]) for r in terms])
    if not chosen_terms:
        return ToxicityModel(bias=float(np.log(n1 * stands_for[1] / (n0 * stands_for[0]))))
    stems = np.array(is_stem)
    spark = docs.sparkSession
    plain = spark.sparkContext.broadcast(automaton(chosen_terms, is_stem))  # of a size bounded by the sample's terms

    def misspelled(batches):
        machine = plain.value
        for batch in batches:
            data, off = utf8(batch.column(1))
            for a, b in slices(off):
                points, start, end, first = words_of(data[off[a] : off[b]], off[a : b + 1] - off[a])
                term, edited = machine.walk(machine.classes(points), start, end)
                hit = np.flatnonzero(edited)
                row = np.searchsorted(first, hit, "right") - 1 + a
                pairs = np.unique(np.stack([row, term[hit]]), axis=1)
                y = batch.column(0).take(pa.array(pairs[0])).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].astype(np.int32)), y], names=["term", "y"])

    # a word next to ordinary words is met exactly only
    met = sample.select("y", "text").mapInArrow(misspelled, "term int, y int").groupBy("term").agg(
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")
    )
    noisy = {r["term"] for r in met.collect() if (r["n0"] + 0.5) / (n0 + 1) * np.exp(MIN_LOG_ODDS) > (r["n1"] + 0.5) / (n1 + 1) and r["n0"] > 1}
    is_fuzzy = [i not in noisy for i in range(len(chosen_terms))]

    final = spark.sparkContext.broadcast(automaton(chosen_terms, is_stem, is_fuzzy))

    def measure(batches):
        machine = final.value
        for batch in batches:
            data, off = utf8(batch.column(1))
            parts = [features(data[off[a] : off[b]], off[a : b + 1] - off[a], machine, stems, quoting, addressing) for a, b in slices(off)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["y", "x", "id"])

    # at most 2 * rows short rows
    measured = sample.select("y", "text", F.xxhash64("_id").alias("id")).mapInArrow(measure, "y int, x array<double>, id long").collect()
    measured.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    x, y = np.array([r["x"] for r in measured]), np.array([r["y"] for r in measured], float)
    weigh = np.where(y == 1, stands_for[1], stands_for[0])
    use = np.ones(len(FEATURES), bool)
    while True:  # more hits never make a text less toxic: a kind of hit that would is left out
        weights, bias = _fit(x * use, y, weigh)
        against = use & (weights < 0) & np.isin(FEATURES, HITS)
        if not against.any():
            break
        use &= ~against
    weights = weights * use
    exact, miss = FEATURES.index("exact"), FEATURES.index("misspelled")
    # few labelled texts misspell: such a hit counts at least half of an exact one
    weights[miss] = max(weights[miss], weights[exact] / 2)
    return ToxicityModel(chosen_terms, is_stem, is_fuzzy, weights.tolist(), bias, quoting, addressing)


def _lexicon(terms: list[tuple[str, int, int]]) -> tuple[list[str], list[bool]]:
    """The terms by support; a term is dropped if a chosen stem already meets it, and a stem
    must be met by clearly more documents than a shorter or longer form of it."""
    chosen: list[tuple[str, bool]] = []
    met: set[str] = set()  # stems
    support: dict[str, int] = {}  # by beginning, the most documents of a chosen term with it
    for term, n1, _ in sorted(terms, key=lambda t: (-t[1], t[0].endswith("*"), -len(t[0]), t[0])):
        stem = term.endswith("*")
        word = term.rstrip("*")
        covered = any(word[:k] in met for k in STEM_LETTERS if k <= len(word))
        if covered or (stem and 1.2 * support.get(word, 0) >= n1):
            continue
        chosen.append((word, stem))
        if stem:
            met.add(word)
        for k in STEM_LETTERS:
            if k <= len(word):
                support[word[:k]] = max(support.get(word[:k], 0), n1)
    last = dict(chosen)  # a word that is also a stem: the stem
    for w, s in chosen:
        last[w] = last[w] or s
    return list(last), list(last.values())


def _fit(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression of weighted rows by Newton steps; the number of features is fixed."""
    weigh = weigh / weigh.mean()
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weigh * (p - y)) / len(y) + ridge * w
        h = (a * (weigh * p * (1 - p))[:, None]).T @ a / len(y) + (ridge + 1e-6) * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def with_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (default: all) with ``toxicity``, the probability of the label 1."""
    keep = list(docs.columns) if keep is None else keep
    # the table is built once; terms are bounded by the labelled sample
    shared = docs.sparkSession.sparkContext.broadcast((model, model.machine()))

    def compute():
        m, machine = shared.value
        stems = np.array(m.stems, bool)

        def f(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            data, off = utf8(batch.column(batch.schema.get_field_index(text)))
            parts = [m.score(features(data[off[a] : off[b]], off[a : b + 1] - off[a], machine, stems, m.quoting, m.addressing)) for a, b in slices(off)]
            return {"toxicity": pa.array(np.concatenate(parts) if parts else np.zeros(0))}

        return f

    return extend(docs.select(*dict.fromkeys([*keep, text])), compute, [T.StructField("toxicity", T.DoubleType())], keep)
