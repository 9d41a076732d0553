import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledger_analytics.llm import mixing, neighbours, sharding, urls

# --- sharding ------------------------------------------------------------------


def test_sharding(spark, odd, empty):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("slot"))
    tree = sharding.unit_tree()
    rows = sharding.assign(keys, "doc_id", tree, chunks=16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(8))
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots))) and 350 < len(slots) < 650
    # one more shard takes rows only into itself
    moved = keys.select(sharding.shard_of(F.col("doc_id"), tree).alias("a"), sharding.shard_of(F.col("doc_id"), sharding.grow(tree)).alias("b"))
    assert moved.where("a <> b AND b <> 8").count() == 0 and 300 < moved.where("b = 8").count() < 600
    got = sharding.assign(odd, "doc_id", tree).collect()
    assert len(got) == odd.count() and len({(r.shard, r.slot) for r in got}) == len(got)
    assert sharding.assign(empty, "doc_id", tree).collect() == []


def test_changed_weight_moves_only_its_subtree(spark):
    tree = [sharding.Leaf("a", "a1", 0), sharding.Leaf("a", "a2", 1), sharding.Leaf("b", "b1", 2), sharding.Leaf("b", "b2", 3)]
    heavy = [*tree[:3], sharding.Leaf("b", "b2", 3, 3.0)]
    key = F.col("id")
    moved = spark.range(3000).select(sharding.shard_of(key, tree).alias("x"), sharding.shard_of(key, heavy).alias("y")).where("x <> y").collect()
    assert moved and all(r.y in (2, 3) for r in moved) and not any(r.x == 3 for r in moved)
    share = spark.range(3000).select(sharding.shard_of(key, heavy).alias("s")).groupBy("s").count().collect()
    assert 0.44 < {r.s: r["count"] for r in share}[3] / 3000 < 0.56
    with pytest.raises(ValueError):
        sharding.shard_of(key, [])


# --- mixing --------------------------------------------------------------------


def test_targets():
    sizes = {"b": 100, "a": 50, None: 10, "c": 1000}
    got = mixing.targets(sizes)
    assert np.isclose(sum(got.values()), 1.5 * 1160)
    assert all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert got["a"] == 100 and got["b"] == 200 and got[None] == 20 and np.isclose(got["c"], 1420)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_route_against_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        sources = ["x", "y", "z"][: rng.randrange(1, 4)]
        patterns = [(frozenset(rng.sample(sources, rng.randrange(1, len(sources) + 1))), rng.randrange(0, 4)) for _ in range(3)]
        quotas = {s: rng.randrange(0, 5) for s in sources}
        taken = mixing.route(patterns, quotas)
        best = None
        for t in np.ndindex(*[2 * n + 1 for _, n in patterns]):
            # feasible if, for every set of sources, what must go there fits
            ok = all(
                sum(x for x, (names, _) in zip(t, patterns) if names <= set(sub)) <= sum(quotas[s] for s in sub)
                for sub in [[s for i, s in enumerate(sources) if m >> i & 1] for m in range(1, 1 << len(sources))]
            )
            if ok:
                cost = sum(max(0, x - n) for x, (_, n) in zip(t, patterns))
                best = max(best or (-1, 0), (sum(t), -cost))
        assert (sum(taken), -sum(max(0, x - n) for x, (_, n) in zip(taken, patterns))) == best


def test_mix(spark, docs_of, odd, empty):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 60), None, rng.choice(["a", "b", "B", None])) for i in range(400)]
    docs = docs_of(rows)
    mix = mixing.with_mix(docs, F.array("source"))
    got = mix.collect()
    assert got == mixing.with_mix(docs.repartition(3), F.array("source")).orderBy("doc_id").collect() or sorted(got) == sorted(
        mixing.with_mix(docs.repartition(3), F.array("source")).collect()
    )
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len(r.text.split()) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.source_targets[0].target
    want = mixing.targets(dict(size))
    for s in size:
        assert np.isclose(target[s], want[s]) and abs(taken[s] - want[s]) <= 60
    out = mixing.mixed_documents(docs, F.array("source"))
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.with_mix(odd, F.array("source")).count() == odd.count()
    assert mixing.with_mix(empty, F.array("source")).collect() == []


def test_mix_of_overlapping_sources(docs_of):
    docs = docs_of([(i, "w " * 10, None, "a" if i % 3 else "b") for i in range(60)])
    member = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("b"))).otherwise(F.array("source"))
    got = mixing.with_mix(docs, member).collect()
    both = [r for r in got if r.doc_id % 5 == 0]
    assert all(len(r.source_targets) == 2 for r in both) and sum(r.taken for r in got) > 0
    with pytest.raises(ValueError):
        mixing.with_mix(docs, F.array("doc_id"), max_patterns=10)


# --- embeddings ----------------------------------------------------------------


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 8))
    x = np.concatenate([base, base[:60] + 0.12 * rng.normal(size=(60, 8)), np.repeat(base[:1], 40, 0), base[:1] + 0.02 * rng.normal(size=(60, 8))])
    x = x.astype(np.float32)
    label = [i % 2 if 60 <= i < 120 else 0 for i in range(len(x))]
    rows = [(i * 2, [float(v) for v in x[i]], label[i], "e") for i in range(len(x))]
    odd = [(1, None, 0, "e"), (3, [0.0] * 8, 0, "e"), (5, [float("nan")] * 8, 0, "e"), (7, rows[0][1], None, "e"), (9, [], 0, "e"),
           (11, [None, 1.0] * 4, 0, "e"), (13, [float("inf")] * 8, 0, "e"), (15, [1.0, 2.0], 0, "e"), (17, [1.0, 2.0], 0, "e"), (0, rows[0][1], 0, "e")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, n_links string")
    got = defaultdict(list)
    for r in neighbours.near_duplicates(df).collect():
        got[r.vec_id].append((r.n_links, r.component_id))
    ids = [r[0] for r in rows] + [0]
    y = np.concatenate([x, x[:1]]).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    lab = np.array([*label, 0])
    near = (y @ y.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(near, False)
    found = sum(got[i][0][0] for i in ids[1:-1])
    want = int(near[1:-1].sum())
    assert 0.95 * want <= found <= want
    comp = list(ids)
    for _ in range(len(ids)):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
    assert sum(got[i][0][1] != c for i, c in zip(ids, comp)) <= 3
    for i in (1, 3, 5, 7, 9, 11, 13):
        assert got[i] == [(0, i)]
    assert got[15] == [(1, 15)] and got[17] == [(1, 15)]
    assert neighbours.near_duplicates(df.where("false")).collect() == []


@pytest.mark.parametrize("most", [1 << 16, 64])
def test_rare_neighbours(spark, monkeypatch, most):
    """Few vectors have a partner, and none of the first block has."""
    monkeypatch.setattr(neighbours, "QUERIES", 16)
    monkeypatch.setattr(neighbours, "MOST_QUERIES", most, raising=False)
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rng.normal(size=(20, 16))
    turn -= (turn * x[:20]).sum(1)[:, None] * x[:20]
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    x = np.concatenate([x, 0.94 * x[:20] + np.sqrt(1 - 0.94**2) * turn])
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(df).collect()}
    assert near.sum() >= 40 and [got[i] for i in range(len(x))] == near.sum(1).tolist()


def test_one_large_label_among_many_small_ones(spark):
    """The grid fits the large label, and finds nearly all of its links."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(700, 24))
    x = np.repeat(centres, 5, 0) + 0.22 * rng.normal(size=(3500, 24))
    small = rng.normal(size=(1500, 24))
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(len(x) + i, [float(v) for v in r], i + 1) for i, r in enumerate(small)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(df).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and near.sum() > 5000
    assert found.sum() >= 0.99 * near.sum()
    assert all(got[i] == 0 for i in range(len(x), len(rows)))


def test_multi_sequence_order():
    rng = np.random.default_rng(4)
    index = neighbours.MultiIndex(rng.normal(size=(6, 3)), rng.normal(size=(5, 3)))
    x = rng.normal(size=(20, 6))
    d = neighbours._distances(x[:, :3], index.left)[:, :, None] + neighbours._distances(x[:, 3:], index.right)[:, None]
    want = np.argsort(d.reshape(20, -1), axis=1, kind="stable")
    for visits in (1, 4, 30):
        assert (index.order(x, visits) == want[:, :visits]).all()


# --- urls ----------------------------------------------------------------------

RULES = [urls.Rule("org", "/", "allow"), urls.Rule("example.org", "/es/", "block"), urls.Rule("com", "/de/", "block")]


def test_urls(spark):
    pages = spark.createDataFrame(
        [(None,), ("",), ("a/b",), ("http://A.Com",), ("x://Foo.org?x=/a",), ("http://h.example.org/es/1#a?b",), ("http://example.org/es",),
         ("http://xorg/a",), ("http://a://b/c",), ("http://www.casino-bets.example.com/en/1",), ("http://www.garden.example.com/en/1",),
         ("HTTP://X.COM/de/" + "y" * 50_000,)],
        "url string",
    ).withColumn("path", F.lit(1))
    model = urls.train(urls.labelled_table(pages))
    got = [(r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, model, RULES).collect()]
    assert [g[:3] for g in got[:9]] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.com", "", None), ("foo.org", "", None),
        ("h.example.org", "/es/1", "example.org/es/"), ("example.org", "/es", "org/"), ("xorg", "/a", None), ("a:", "//b/c", None),
    ]
    assert got[5][3] == "block" and got[6][3] == "allow" and got[9][3] == "block" and got[10][3] == "allow"
    assert got[11][2:] == ("com/de/", "block")
    assert urls.judge(pages.where("false"), model, RULES).collect() == []
    plan = urls.judge(pages, model, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_model_separates_hosts_not_seen(spark):
    names = ["poker-casino", "pills-shop", "free-slots", "spam-pages"], ["river-walks", "chemistry", "bakery", "train-times"]
    rows = [(f"https://{p}{n}.example.{t}/en/{i}", y) for y, ns in ((1, names[0]), (0, names[1])) for i, n in enumerate(ns) for p in ("", "www.") for t in ("com", "net")]
    pages = spark.createDataFrame(rows, "url string, y int")
    got = urls.judge(pages, urls.train(urls.labelled_table(pages)), []).collect()
    assert np.mean([(r.verdict == "block") == bool(r.y) for r in got]) >= 0.8
    assert urls.train(urls.labelled_table(pages).where("false")).bias == 0
