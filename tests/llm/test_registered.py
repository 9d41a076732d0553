"""The registered corpus queries on the smallest tables."""

import math
import os
import re
import struct
import zlib
from collections import defaultdict

import pytest
import xxhash

import corpus_pipeline
from ledger_analytics.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")

COLUMNS = {
    "op1_language": ("documents", {"doc_id", "held_out", "lang_pred", "score"}),
    "op2_tokens": ("documents", {"doc_id", "start", "n_tokens", "ids_crc32"}),
    "op3_sharding": ("documents", {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}),
    "op4_decontamination": ("documents", {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}),
    "op5_toxicity": ("documents", {"doc_id", "held_out", "score", "predicted"}),
    "op6_embeddings": ("embeddings", {"vec_id", "n_links", "component_id", "kept"}),
    "op7_url_filter": ("pages", {"page_id", "host", "path", "rule", "verdict"}),
    "op8_mixing": ("documents", {"doc_id", "size", "source_size", "target", "taken"}),
    "op9_simhash": ("documents", {"doc_id", "fingerprint", "component_id"}),
    "op10_repeats": ("documents", {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}),
}
#: Their rows are compared with brute force in test_trie, test_packing and test_negatives.
OF_OWN_ROWS = {"op11_prefix_trie", "op12_packing", "op13_negatives"}


def test_all_are_listed():
    assert set(COLUMNS) | OF_OWN_ROWS == set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    table, columns = COLUMNS[name]
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert columns <= set(df.columns)
    key = {"embeddings": "vec_id", "pages": "page_id"}.get(table, "doc_id")
    want = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
    assert sorted(r[key] for r in rows) == sorted(want)
    if name in ORACLE:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        result = con.execute(ORACLE[name])
        at = [c[0] for c in result.description]
        assert sorted(tuple(r[c] for c in at) for r in rows) == sorted(result.fetchall())


def _draw(key: int, name: str) -> float:
    h = xxhash.xxh64(name.encode(), seed=xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()).intdigest()
    return -math.log((h % (1 << 52) + 0.5) / (1 << 52))


def test_sharding_rows(spark):
    """Sizes, checksums, slots, and the descent of region, rack and shard draw by draw."""
    rows = QUERIES["op3_sharding"](spark, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in rows:
        assert (r.law, r.size, r.text_crc32) == ("key", len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        slots[r.shard].append(r.slot)
        region = min((_draw(r.doc_id, f"region region{i}") / 4, i) for i in range(2))[1]
        rack = min((_draw(r.doc_id, f"rack region{region} rack{region}.{i}") / 2, i) for i in range(2))[1]
        first = 4 * region + 2 * rack
        assert r.shard == min((_draw(r.doc_id, f"shard {i}"), i) for i in (first, first + 1))[1]
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    new = sum(r.grown_shard == 8 for r in rows) / len(rows)
    assert 0.03 < new < 0.25


def _cut(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda c: c[0].lower(), host), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def test_url_rows(spark):
    """Host, path and rule of every page, and the verdict where a rule fits."""
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    used = set()
    for r in QUERIES["op7_url_filter"](spark, SF).collect():
        host, path = _cut(urls[r.page_id])
        fit = [t for t in rules if f".{host}".endswith("." + t.split("/", 1)[0]) and path.startswith("/" + t.split("/", 1)[1])]
        rule = max(fit, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == rules[rule] if rule else r.verdict in ("allow", "block")
        used.add(rule)
    assert len(used) > 1


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in before.collect()} and rows
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
