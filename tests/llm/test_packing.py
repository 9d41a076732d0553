"""Packing: the plan against exact search, the placing against its definition."""

import os
import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledger_analytics.llm import packing, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def fewest(sizes, capacity):
    """The fewest sequences, by exact search."""

    @cache
    def solve(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        # all sets beside the longest piece
        seen = set()

        def choose(i, room, kept):
            nonlocal best
            if i == len(rest):
                if kept not in seen:
                    seen.add(kept)
                    best = min(best, 1 + solve(kept))
                return
            if rest[i] <= room:
                choose(i + 1, room - rest[i], kept)
            choose(i + 1, room, (*kept, rest[i]))

        choose(0, capacity - first, ())
        return best

    return solve(tuple(sorted(sizes, reverse=True)))


def contents(kinds):
    return [[s for s, each in held for _ in range(each)] for copies, held in kinds for _ in range(copies)]


@pytest.mark.parametrize("seed", range(8))
def test_reduction_loses_nothing(seed):
    rng = random.Random(seed)
    fixed_some = 0
    for _ in range(60):
        capacity = rng.choice((10, 17, 30))
        low = rng.choice((1, 3, 5))
        sizes = [rng.randrange(low, capacity + 1) for _ in range(rng.randrange(1, 9))]
        count = [0] * (capacity + 1)
        for s in sizes:
            count[s] += 1
        fixed = packing.reduced(count, capacity)
        rest = [s for s, n in enumerate(count) for _ in range(n)]
        assert sorted(rest + [s for x in contents(fixed) for s in x]) == sorted(sizes)
        assert all(sum(x) <= capacity for x in contents(fixed))
        assert fewest(sizes, capacity) == sum(n for n, _ in fixed) + fewest(rest, capacity)
        fixed_some += bool(fixed)
    assert fixed_some > 30


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in bins if sum(b) + s <= capacity]
        if fit:
            max(fit, key=sum).append(s)
        else:
            bins.append([s])
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_best_fit(seed):
    rng = random.Random(seed)
    for _ in range(40):
        capacity = rng.choice((10, 31, 64))
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 60))]
        count = [0] * (capacity + 1)
        for s in sizes:
            count[s] += 1
        got = contents(packing.best_fit(count, capacity))
        assert sorted(s for b in got for s in b) == sorted(sizes)
        # of equally full sequences any may be taken
        assert Counter(map(sum, got)) == Counter(map(sum, plain_best_fit(sizes, capacity)))


def test_plan_is_short_and_good():
    rng = random.Random(3)
    counts = Counter(min(1024, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(200_000))
    kinds = packing.plan(counts)
    total = sum(s * n for s, n in counts.items())
    assert sum(n for n, _ in kinds) <= -(-total // 1024) * 1.002
    assert len(packing.plan({s: n * 10**6 for s, n in counts.items()})) < 5000
    assert packing.plan({}) == []


def brute_pieces(rows, capacity=1024):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        out += [(doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out, key=repr)


def assert_packed(rows, capacity=1024):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pack(spark, docs_of):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 6)))
    rows = [(i, " ".join(word() for _ in range(int(rng.lognormvariate(4, 1.5))))) for i in range(150)]
    rows += [(500, None), (500, None), (501, ""), (None, "no id"), (502, "x " * 5000)] + [(600 + i, "same text of a group") for i in range(70)]
    pieces = packing.token_pieces(docs_of(rows).repartition(7), TOKENIZER)
    got = packing.pack(pieces.withColumn("crc", F.crc32("token_ids"))).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.crc) for r in got], key=repr) == brute_pieces(rows)
    counts = Counter(r.length for r in got)
    assert assert_packed(got) == sum(n for n, _ in packing.plan(counts))
    # real sequences
    made = packing.sequences(packing.pack(pieces)).collect()
    assert sum(len(r.token_ids) for r in made) == 4 * sum(r.length for r in got)
    by_piece = {(r.doc_id, r.piece): r.crc for r in got if r.doc_id not in (None, 500)}
    for r in made:
        for p in r.pieces:
            if (p.doc_id, p.piece) in by_piece:
                assert zlib.crc32(bytes(r.token_ids)[4 * p.offset : 4 * (p.offset + p.length)]) == by_piece[(p.doc_id, p.piece)]


def test_odd_lengths_and_names(spark, odd, empty):
    rows = spark.createDataFrame(
        [(5, 1, "a", 7), (None, 2, "b", 7), (0, 3, "c", 7), (-4, 4, "d", 7), (11, 5, "e", 7), (12, 6, "f", 7), (5, 7, None, 7)],
        "n int, offset int, size string, part int",
    )
    got = {r["size"]: r for r in packing.pack(rows, "n", 10).collect()}
    assert set(got["a"].asDict()) == {"n", "size", "part", "sequence_id", "offset"}
    assert got["a"].sequence_id == got[None].sequence_id and {got["a"].offset, got[None].offset} == {0, 5}
    assert [got[x].sequence_id for x in "bcd"] == [None] * 3
    assert len({got[x].sequence_id for x in "aef"}) == 3 and got["e"].offset == got["f"].offset == 0
    assert packing.pack(packing.token_pieces(empty, TOKENIZER)).collect() == []
    pieces = packing.pack(packing.token_pieces(odd, TOKENIZER)).collect()
    assert len({(r.doc_id, r.piece) for r in pieces if r.doc_id == 7}) == 20
    assert_packed(pieces)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_registered(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_packing(spark, SF).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == brute_pieces(rows)
    n = assert_packed(got)
    assert n <= 1.01 * -(-sum(r.length for r in got) // 1024) + 1
