"""The conversation trie against a dictionary of all prefixes."""

import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledger_analytics.llm import queries, trie


def brute_nodes(paths):
    """``paths``: conv -> tuple of (role, text)."""
    members, ends = {}, {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
        ends.setdefault(path, []).append(conv)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[c] for c in below) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[c] for c in below)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha256"]


def found_nodes(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made = trie.prefix_trie(trie.turn_paths(df))
    digests = trie.list_digests(made.ends, "node", "conv_id").withColumnRenamed("key", "node")
    nodes = made.nodes.join(digests, "node", "left")
    nodes = nodes.withColumn("sha256", F.coalesce("sha256", F.sha2(F.lit(b""), 256)))
    return sorted(tuple(r) for r in nodes.select(*COLUMNS).collect())


def paths_of(rows):
    paths = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, _, role, text in sorted((r for r in rows if r[0] is not None), key=key):
        paths.setdefault(conv, []).append((role or "", text or ""))
    return {c: tuple(p) for c, p in paths.items()}


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        base = rng.choice([0, 0, rng.randrange(-3, conv + 1)])
        copied = [r for r in rows if r[0] == base][: rng.randrange(0, 7)]
        turns = [(r[2], r[3]) for r in copied] + [(rng.choice(["user", "bot"]), rng.choice("abß") * rng.randrange(0, 3)) for _ in range(rng.randrange(0, 5))]
        rows += [(conv, i, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    assert found_nodes(spark, rows) == brute_nodes(paths_of(rows))


def test_long_nested_and_repeated(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BYTES", 40)
    long = [("u", f"turn {i}") for i in range(300)]
    rows = [(0, i, *t) for i, t in enumerate(long)]
    for conv in range(1, 40):  # a chain of branches off one conversation
        rows += [(conv, i, *t) for i, t in enumerate(long[: 7 * conv])] + [(conv, 9999, "x", str(conv % 3))]
    rows += [(c, i, "u", "same") for c in range(100, 190) for i in range(3)]
    rows += [(200, 0, "u", "same"), (200, 1, "u", "same")]  # ends inside of the others
    assert found_nodes(spark, rows) == brute_nodes(paths_of(rows))


def test_odd_rows(spark):
    rows = [
        (None, 0, "a", "no id"), (1, None, None, None), (1, 0, "a", "x"), (1, 0, "a", "x"), (1, 0, "A", "y"), (2, None, "", ""),
        (2, 0, "A", "y"), (-7, 5, "a:", "b"), (-6, 5, "a", ":b"), (3, 1, "u", "日本 🙂"),
    ]
    assert found_nodes(spark, rows) == brute_nodes(paths_of(rows))
    assert found_nodes(spark, [(None, 0, "a", "b")]) == []
    assert found_nodes(spark, [(5, 0, "a", "b")]) == brute_nodes({5: (("a", "b"),)})


def rebuilt(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = paths.get(c - c % 5, ())[:h] + own[h:]
    return out


def test_shared_starts(spark):
    rng = random.Random(2)
    rows = [(c, t, "u", str(rng.randrange(3))) for c in range(40) if c % 10 != 5 for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made = trie.prefix_trie(queries.shared_starts(trie.turn_paths(df)))
    want = rebuilt(paths_of(rows))
    assert any(not p for p in want.values())
    got = sorted(tuple(r) for r in made.nodes.select(*COLUMNS[:-1]).collect())
    assert got == [n[:-1] for n in brute_nodes(want)]


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_registered(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in queries.op11_prefix_trie(spark, SF).collect())
    assert got == brute_nodes(rebuilt(paths_of(rows)))
