import random
import re

import numpy as np
import pytest
import xxhash

from ledger_analytics.llm import simhash
from ledger_analytics.llm.graph import components, spanning_pairs


def brute_fingerprint(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def roots(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("radius, words", [(0, 1), (4, 1), (9, 4), (44, 4)])
def test_bit_sliced_comparison(radius, words):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 1 << 63, (260, words), dtype=np.uint64)
    for i in range(130):
        fp[i + 130] = fp[i]
        for b in rng.choice(64 * words, rng.integers(0, 2 * radius + 2), replace=False):
            fp[i + 130, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    bucket = (np.arange(260) >= 250).astype(np.int64)
    got = {(int(i), int(j)) for a, b in simhash.close_pairs(fp, bucket, radius) for i, j in zip(a, b)}
    want = {
        (i, j) for i in range(260) for j in range(i + 1, 260)
        if bucket[i] == bucket[j] and np.bitwise_count(fp[i] ^ fp[j]).sum() <= radius
    }
    assert got == want and want


def test_block_keys_are_lossless():
    rng = random.Random(5)
    masks = [m % (1 << 64) for m in simhash.block_masks(4, 6)]
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_spanning_pairs():
    rng = np.random.default_rng(1)
    i, j = rng.integers(0, 200, (2, 150))
    a, b = spanning_pairs(200, i, j)
    assert len(a) < 200 and roots(200, zip(a.tolist(), b.tolist())) == roots(200, zip(i.tolist(), j.tolist()))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (500, 500)]
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(501, [e for e in edges if e[0] != e[1]])
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (want[a] == want[b])


def test_groups_against_brute_force(docs_of, monkeypatch):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(0, 120))) for _ in range(40)]
    texts = []
    for t in base:
        w = t.split()
        for k in (0, 1, 2):
            v = list(w)
            for _ in range(k):
                if v:
                    v[rng.randrange(len(v))] = "other"
            texts.append(" ".join(v))
    texts += ["", None, "X Y", "x y"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    groups = simhash.simhash_groups(docs_of(rows), ["doc_id"])
    got = {r.doc_id: (r.fp0 % (1 << 64), r.component_id) for r in groups.collect()}
    fps = [brute_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = roots(len(fps), pairs)
    assert got == {i * 3: (fps[i], root[i] * 3) for i in range(len(fps))}


def test_large_buckets_are_split(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 62)
    near = {int(centre) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (300, 2))}
    far = {int(x) for x in rng.integers(0, 1 << 62, 100)}
    fps = sorted(near | far)
    df = spark.createDataFrame([(f, f) for f in fps], "node long, fp0 long")
    masks = [[m] for m in simhash.block_masks(4, 6)]
    links = simhash.fingerprint_links(df, masks, 4, bucket=16).collect()
    at = {f: i for i, f in enumerate(fps)}
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert roots(len(fps), [(at[r.a], at[r.b]) for r in links]) == want


def test_one_per_group(docs_of, odd, empty):
    rng = random.Random(8)
    clean = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(clean[:5])]
    near = clean[6].split()
    near[50] = "changed"
    rows += [(200, " ".join(near)), (300, clean[7]), (300, clean[7])]
    kept = simhash.one_per_group(docs_of(rows))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
    # repeated ids: one row stays; a row without an id stays
    kept = simhash.one_per_group(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and None in ids and kept.columns == odd.columns
    assert simhash.one_per_group(empty).collect() == []
