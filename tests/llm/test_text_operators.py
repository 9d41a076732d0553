import hashlib
import functools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledger_analytics.llm import decontaminate, langid, repeats, tokens, toxicity
from ledger_analytics.llm.suffixes import MEMORY, same_prefix, suffix_order

public_tokenizers = pytest.importorskip("public_tokenizers")

# --- language ------------------------------------------------------------------

LANGS = {
    "en": "the cat sat on the mat and the dog was with them in the house of this town",
    "de": "der hund und die katze sind nicht mit dem kind in einem haus für das ist schön",
    "fr": "le chat est sur la table et les chiens sont avec nous dans une maison très belle",
}


def language_rows(rng, n, start=0):
    out = []
    for i in range(n):
        lang = rng.choice(sorted(LANGS))
        out.append((start + i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randrange(8, 40))), lang, "s"))
    return out


def test_language(docs_of, odd, empty):
    rng = random.Random(1)
    model = langid.train(docs_of(language_rows(rng, 90)))
    assert model.languages == sorted(LANGS)
    test = docs_of(language_rows(rng, 60, 1000))
    got = langid.with_language(test, model).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 58 and all(0 <= r.score <= 1 for r in got)
    seen = {r.doc_id: r for r in langid.with_language(odd, model, ["doc_id"]).collect()}
    for i in (0, 1, 2):
        assert (seen[i].lang_pred, seen[i].score) == ("und", 0)
    assert seen[7].lang_pred in LANGS
    assert langid.with_language(empty, model).collect() == []
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.with_language(odd, nothing, ["doc_id"]).collect()} == {"und"}


def test_language_counts_against_brute_force(docs_of):
    rows = [(1, "ab ba", "x", None), (2, "ba", "y", None), (3, None, "x", None), (4, "ab", None, None)]
    model = langid.train(docs_of(rows), bits=20)
    # letters and blanks of " ab ba"
    counts = np.exp(model.table[0])
    assert model.languages == ["x", "y"] and np.allclose(counts.sum(axis=1), 1)
    total = 6 + 0.5 * (1 << 20)
    assert np.allclose(np.sort(counts[0] * total)[-4:], [0.5, 2.5, 2.5, 2.5])


def test_language_stage_keeps_clean_documents(docs_of, odd):
    rng = random.Random(2)
    docs = docs_of(language_rows(rng, 60) + [(900, "12 34 !!", "en", "s"), (901, None, "en", "s")])
    kept = langid.identified_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(60))


# --- toxicity ------------------------------------------------------------------


def test_automaton_against_edit_distance():
    terms = ["idiot", "losers", "abc", "clown", "clows"]
    machine = toxicity.automaton(terms, [False] * 5)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(3)
    words = {rng.choice(terms) for _ in range(3)}
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.randrange(0, 3)):
                i = rng.randrange(len(w) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    w.insert(i, rng.choice("abclosx"))
                elif i < len(w) and kind == 1:
                    del w[i]
                elif i < len(w):
                    w[i] = rng.choice("abclosx")
            words.add("".join(w))
    for w in sorted(words - {""}):
        points = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        term, edited = machine.walk(machine.classes(points), np.array([0]), np.array([len(w)]))
        if w in terms:
            assert terms[term[0]] == w and not edited[0]
        elif term[0] >= 0:
            assert edited[0] and distance(w, terms[term[0]]) == 1
        else:  # the first letter is never changed or left out
            assert all(len(t) < 5 or distance(w, t) > 1 or w[0] != t[0] or distance(w[1:], t[1:]) > 1 for t in terms)


def toxic_rows(rng, n):
    plain = [f"w{rng.choice('abcdefgh')}{rng.choice('klmnop')}" for _ in range(60)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(["stupid", "moron", "trashy"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, docs_of, odd, empty):
    rows, labels = toxic_rows(random.Random(5), 120)
    labels = spark.createDataFrame([*labels, (None, 1), (3, None), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(rows), labels)
    assert {"stupid", "moron", "trashy"} <= set(model.terms)
    probe = docs_of([(0, "wak you stupid moron wbl"), (1, "wak wbl wcm"), (2, "wak you stupd morron wbl"),
                     (3, 'he wrote the word "stupid" here'), (4, None), (5, "")])
    got = {r.doc_id: r.toxicity for r in toxicity.with_toxicity(probe, model).collect()}
    assert got[0] >= 0.3 > got[1] and got[2] > got[1] and got[3] < got[0]
    assert got[4] == got[5] == toxicity.with_toxicity(docs_of([(1, "wak")]), model).first().toxicity
    assert toxicity.with_toxicity(odd, model).count() == odd.count()
    assert toxicity.with_toxicity(empty, model).collect() == []
    none = toxicity.train(docs_of(rows), labels.where("false"))
    assert {r.toxicity for r in toxicity.with_toxicity(odd, none).collect()} == {0.0}


# --- decontamination -----------------------------------------------------------


def brute_contamination(docs, items, window=10):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wins = {}
    for item, t in items:
        w = words(t)
        if item is None or not w:
            continue
        for i in range(max(1, len(w) - window + 1)):
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, of in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    ids |= of
        out.append((d, len(w), sorted(hit), sorted(ids)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [16 << 20, 1500])
def test_contamination(spark, docs_of, block_bytes):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(n))
    items = [(i, text(rng.randrange(1, 25))) for i in range(25)] + [(30, None), (31, ""), (None, "a b"), (32, "A-b, É"), (33, "A-b, É")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)]
    docs += [(50, "x " + items[3][1].upper() + " y"), (51, None), (52, ""), (53, "a b é"), (53, "a b é")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs_of(docs), table, ["doc_id"], block_bytes=block_bytes)
    rows = sorted([(r.doc_id, r.n_words, list(r.hit_words), list(r.item_ids)) for r in got.collect()], key=repr)
    assert rows == brute_contamination(docs, items)


def test_clean_documents(spark, odd, empty, docs_of):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = docs_of([(1, "so one two three four five six seven eight nine ten."), (2, "one two three")])
    kept = decontaminate.clean_documents(docs, items)
    assert [r.doc_id for r in kept.collect()] == [2] and kept.columns == docs.columns
    assert decontaminate.clean_documents(odd, items.where("false")).count() == odd.count()
    assert decontaminate.clean_documents(empty, items).count() == 0


# --- repeated substrings -------------------------------------------------------


@pytest.mark.parametrize("n, letters, memory", [(1, 2, MEMORY), (50, 2, 64), (700, 3, 256), (1500, 256, MEMORY), (300, 1, 100)])
def test_suffix_order(n, letters, memory):
    text = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
    raw = bytes(text)
    order = suffix_order(text, memory, depth=n + 8)
    assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
    full = order[order + 9 <= n]
    want = [raw[a : a + 9] == raw[b : b + 9] for a, b in zip(full, full[1:])]
    assert same_prefix(text, full, 9).tolist() == want


def brute_repeats(docs, length=50):
    first = {}
    order = lambda d: (d is None, d or 0)
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            first[k] = min(first.get(k, order(d)), order(d))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < order(d):
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [repeats.HOT, 4, 0])
def test_repeats(docs_of, monkeypatch, hot):
    monkeypatch.setattr(repeats, "PARCEL_BYTES", 900)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30)))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 30)
            parts.append(p[a : a + rng.randrange(45, 90)])
        docs.append((rng.randrange(40), " ".join(parts)))
    docs += [(70, "z" * 200), (71, "z" * 120), (72, None), (73, ""), (74, docs[0][1]), (None, docs[1][1]), (None, passages[0])]
    cut = repeats.without_repeats(docs_of(docs), parcel_bytes_per_shard=600, hot=hot)
    rows = cut.select("doc_id", "n_bytes", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h"), "spans", "kept").collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n, r.h) for r in rows], key=repr) == brute_repeats(docs)
    for r in rows:
        assert r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans)


def test_repeats_hot_anchor_is_dealt_out():
    """A line of 3000 documents with other words behind it: no shard gets more than ``hot``
    surroundings of one anchor, and the strings around it spread over all shards."""
    rng, n, hot = random.Random(8), 16, 100
    line = "all rights reserved by the owner of this very common line. "
    rows = []
    for parcel in range(10):
        texts = [(line + "".join(rng.choice("abcdefgh") for _ in range(60))).encode() for _ in range(300)]
        pack = lambda v, kind: repeats._pack(np.array(v, kind))
        rows.append(
            {
                "ids": pack(range(300 * parcel, 300 * parcel + 300), np.int64), "known": pack([True] * 300, bool),
                "lengths": pack([len(t) for t in texts], np.int64), "data": pack(list(b"".join(texts)), np.uint8),
            }
        )
    parcels = [repeats.Parcel(r, repeats.LENGTH, repeats.PIECE) for r in rows]

    def shards(made, names, kinds, step):
        made = sorted(made, key=lambda r: (r[1], r[0]))
        out = step(iter([repeats._batch(made, names, kinds)]))
        return [r for b in out for r in b.to_pylist()]

    kinds = [*repeats._REPLY[1], pa.binary()]
    anchors = [r for i, p in enumerate(parcels) for r in repeats._hash_rows(i, p, n)]
    shared = shards(anchors, ["parcel", "shard", "hashes", "repeats"], kinds, lambda it: repeats._shared(it, hot))
    sent = [
        r for i, p in enumerate(parcels) for r in repeats._surrounding_rows(i, p, [a for a in shared if a["parcel"] == i], n)
    ]
    plain, strings = [r for r in sent if r[5] is not None], [r for r in sent if r[5] is None]
    places = {}
    for r in plain:
        for h in repeats._unplanes(r[2], 6).tolist():
            places[h] = places.get(h, 0) + 1
    assert max(places.values(), default=0) <= hot
    loads = {}
    for r in strings:
        loads[r[1]] = loads.get(r[1], 0) + len(repeats._unpack(r[2], np.uint64))
    assert set(loads) == set(range(n, 2 * n)) and max(loads.values()) < 2 * sum(loads.values()) / n
    # every document but the first loses the line, and no byte that stands in one document only goes
    replies = shards(sent, ["parcel", "shard", "hashes", "around", "ids", "shape", "data"], [pa.int64(), pa.int32(), *[pa.binary()] * 5],
                     lambda it: repeats._removed(it, repeats.LENGTH, repeats.PIECE))
    for i, p in enumerate(parcels):
        mine = [[a for a in x if a["parcel"] == i] for x in (shared, replies)]
        for r in repeats._cut(p, n, *mine).to_pylist():
            removed = sum(s["end"] - s["start"] for s in r["spans"])
            assert (removed == 0) if r["doc_id"] == 0 else len(line) <= removed < len(line) + 20


def repeats_in_process(docs, n, hot, parcel_rows=12):
    """The steps of ``without_repeats`` without Spark: rows (doc_id, bytes, spans, sha256)."""
    pack = lambda v, kind: repeats._pack(np.array(v, kind))
    last = np.iinfo(np.int64).max
    parcels = []
    for i in range(0, len(docs), parcel_rows):
        ids, texts = zip(*[(d, (t or "").encode()) for d, t in docs[i : i + parcel_rows]])
        row = {
            "ids": pack([last if d is None else d for d in ids], np.int64), "known": pack([d is not None for d in ids], bool),
            "lengths": pack([len(t) for t in texts], np.int64), "data": pack(list(b"".join(texts)), np.uint8),
        }
        parcels.append(repeats.Parcel(row, repeats.LENGTH, repeats.PIECE))

    def at_shards(sent, names, kinds, step):
        sent = sorted(sent, key=lambda r: (r[1], r[0]))
        replies = [r for b in step(iter([repeats._batch(sent, names, kinds)])) for r in b.to_pylist()]
        return [[r for r in replies if r["parcel"] == i] for i in range(len(parcels))]

    sent = [r for i, p in enumerate(parcels) for r in repeats._hash_rows(i, p, n)]
    kinds = [*repeats._REPLY[1], pa.binary()]
    shared = at_shards(sent, ["parcel", "shard", "hashes", "repeats"], kinds, lambda it: repeats._shared(it, hot))
    sent = [r for i, p in enumerate(parcels) for r in repeats._surrounding_rows(i, p, shared[i], n)]
    names, kinds = ["parcel", "shard", "hashes", "around", "ids", "shape", "data"], [*repeats._REPLY[1], *[pa.binary()] * 4]
    strings = at_shards(sent, names, kinds, lambda it: repeats._removed(it, repeats.LENGTH, repeats.PIECE))
    rows = [r for i, p in enumerate(parcels) for r in repeats._cut(p, n, shared[i], strings[i]).to_pylist()]
    return [(r["doc_id"], r["n_bytes"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows]


def repeating_docs(rng, count):
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(4)]
    docs = []
    for _ in range(count):
        a = rng.randrange(0, 30)
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30))), rng.choice(passages)[a : a + rng.randrange(45, 90)]]
        docs.append((rng.choice([None, *range(count)]), " ".join(parts[: rng.randrange(1, 3)])))
    return [*docs, (count, "z" * 200), (count + 1, "z" * 120), (count + 2, None), (count + 3, ""), (count + 4, docs[0][1])]


@pytest.mark.parametrize("hot", [repeats.HOT, 4, 0])
def test_repeats_of_many_blocks_portions_and_shards(monkeypatch, hot):
    monkeypatch.setattr(repeats, "BLOCK", 70)
    monkeypatch.setattr(repeats, "HOT_PORTION", 3)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 400)
    docs = repeating_docs(random.Random(9), 70)
    for n in (8, 1000):
        assert sorted(repeats_in_process(docs, n, hot), key=repr) == brute_repeats(docs)


def test_repeats_work_of_a_parcel_does_not_grow_with_the_shards(monkeypatch):
    """Hashing and sorting is done for all shards of a parcel at once."""
    docs, calls = repeating_docs(random.Random(10), 70), []
    for name in ("mix", "stretch_hashes"):
        monkeypatch.setattr(repeats, name, lambda *a, f=getattr(repeats, name): calls.append(1) or f(*a))
    counts = []
    for n in (8, 1000):
        calls.clear()
        repeats_in_process(docs, n, repeats.HOT)
        counts.append(len(calls))
    assert counts[0] == counts[1]


def test_repeats_rows_between_parcels_and_shards():
    """10 GB of text, in parcels and shards of 3 and 2 MB, made 16 million rows."""
    n = 10_200_000_000
    assert n / repeats.PARCEL_BYTES * repeats._n_shards(n, repeats.TEXT_PER_SHARD) < 1_000_000
    assert [repeats._n_shards(x, 600) for x in (0, 6_000, 600 * 2048, 600 * 8000)] == [8, 10, 256, 1000]


@pytest.mark.parametrize("hot", [repeats.HOT, 0])
def test_repeats_odd(odd, empty, hot):
    got = repeats.without_repeats(odd, hot=hot).collect()
    assert len(got) == odd.count() and sum(r.n_bytes for r in got if r.doc_id == 7) == 100_000
    assert all(len(r.kept) == r.n_bytes for r in got)
    assert repeats.without_repeats(empty).collect() == []


# --- token files ---------------------------------------------------------------


def test_number_code():
    rng = np.random.default_rng(1)
    v = (rng.integers(0, 1 << 32, 1003, dtype=np.uint64) >> rng.integers(0, 32, 1003).astype(np.uint64)).astype(np.uint32)
    for part in (v, v[:0], v[:1], np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)):
        control, data = tokens.encode_numbers(part)
        assert len(control) == -(-len(part) // 4)
        assert (tokens.decode_numbers(control, data, len(part)) == part).all()


TEXTS = ["it's a test's 'll  x\n\n y\t z'd", "<|endoftext|> a", "Ünï　code \x1c x", "a\x00b", "it 'tis \n\n\n  x   ", "é è x 1²3 ½", "  ", " '", "'s 's''s"]


@functools.cache
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference_ids(texts):
    return [e.ids for e in reference().encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encoded(encoder, texts):
    raw = [x if isinstance(x, bytes) else x.encode() for x in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    ids, n = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), off)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


def test_encoder_equals_tokenizer(monkeypatch):
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for kept in (10_000, 3):
        monkeypatch.setattr(tokens, "KEPT_WORDS", kept)
        encoder._clear()
        for texts in (TEXTS, TEXTS[::-1], ["plain text only", "plain text again"], ["x"], [""], []):
            assert encoded(encoder, texts) == reference_ids(texts)


def test_encoder_on_random_texts(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 500)
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    pool = ["'", "'", "s", "t", "re", "ve", "ll", "d", " ", " ", "  ", "\n", "\t", "a", "Zß", "é", "ɏ", "ɐ", "1", "²", "½", "-", "…", "‰", "\xa0", "日", "🙂",
            "averyveryverylongwordindeed", "<|endoftext|>", "<|end", "\r", "¿", "ÿ"]
    usual = [p for p in pool if p not in ("ɐ", "\xa0", "日", "🙂", "<|endoftext|>", "\r")]
    for _ in range(60):
        texts = ["".join(rng.choice(rng.choice((pool, usual, usual, usual))) for _ in range(rng.randrange(0, 40))) for _ in range(20)]
        texts += ["".join(rng.choice(usual) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
        assert encoded(encoder, texts) == reference_ids(texts)


def test_encoder_reads_bytes_that_are_no_text():
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    raw = [b"good", b"\xff\xfe bad", b"", b"\xc3", b"x\xe2\x80", b"\xc0\x80 low", b"a \xff", b"end"]
    assert encoded(encoder, raw) == reference_ids([r.decode("utf-8", "replace") for r in raw])


def test_token_file(spark, docs_of, empty, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 40)
    rng = random.Random(9)
    rows = [(rng.randrange(500), rng.choice(TEXTS) * rng.randrange(0, 4)) for _ in range(60)] + [(7, None), (None, "first")]
    path = tokens.write_tokens(docs_of(rows), public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(tokens.read_documents(spark, path).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (doc, _), ids in zip(got, order, reference_ids([t for _, t in order]), strict=True):
        ids = [*ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.token_ids)) == (doc, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    path = tokens.write_tokens(empty, public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.read_documents(spark, path).collect() == []
