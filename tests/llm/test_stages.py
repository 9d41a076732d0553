"""What the stages of the pipeline promise for any table."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledger_analytics.llm import decontaminate, langid, mixing, simhash

NAMES = ["n_words", "hit_words", "item_ids", "size", "taken", "copies", "_h", "_1", "_kept", "_n", "_hits0", "_copy", "in_0", "IN_1", "node", "memberships",
         "unusual", "score", "nth", "source_sizes", "_pattern", "fp0"]
LANGS = {
    "en": "the cat sat on the mat and the dog was with them in the house of this town",
    "de": "der hund und die katze sind nicht mit dem kind in einem haus für das ist schön",
}


def rows_of(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice(sorted(LANGS))
        out.append((i, " ".join(rng.choice(LANGS[lang].split()) + str(rng.randrange(9)) * (k % 5 == 0) for k in range(rng.randrange(30, 90))), lang, rng.choice("ab")))
    return out


def test_columns_come_through_unchanged(spark, docs_of, tmp_path):
    rng = random.Random(1)
    docs = docs_of(rows_of(rng, 60)).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}/"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    items = spark.createDataFrame([(1, "zzz")], "item_id int, text string")
    kept = {
        "language": langid.identified_documents(docs),
        "near_duplicates": simhash.one_per_group(docs),
        "decontamination": decontaminate.clean_documents(docs, items),
        "mixing": mixing.mixed_documents(docs, F.array("source")),
    }
    for stage, out in kept.items():
        assert out.columns == docs.columns, stage
        rows = out.collect()
        assert rows and all(r[n] == f"{n}/{r.doc_id}" for r in rows for n in NAMES), stage
    repeated = docs.unionByName(docs)
    assert sorted(r.doc_id for r in simhash.one_per_group(repeated).collect()) == sorted(r.doc_id for r in kept["near_duplicates"].collect())


def test_unknown_languages_go(docs_of):
    rng = random.Random(2)
    rows = rows_of(rng, 80)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(900))
    odd = [(900, "これは日本語の文章です。" * 70, None, "s"), (901, noise, None, "s"), (902, "Это русский текст о погоде и о доме. " * 25, None, "s")]
    mixed = [(910, rows[0][1] + " http://x.example/a?b=1 " + rows[1][1], None, "s"), (911, "the cat", None, "s"), (912, LANGS["en"].upper() * 3, None, "s")]
    kept = {r.doc_id for r in langid.identified_documents(docs_of(rows + odd + mixed)).collect()}
    assert kept == set(range(80)) | {910, 911, 912}


def test_lower_case_is_each_text_alone():
    texts = ["ΟΔΟΣ", "α", "İstanbul ΣΑΣ", "x"]

    def points(some):
        raw = [t if isinstance(t, bytes) else t.encode() for t in some]
        off = np.cumsum([0, *map(len, raw)])
        data, at = langid.code_points(np.frombuffer(b"".join(raw), np.uint8), off)
        return [data[a:b].tolist() for a, b in zip(at, at[1:])]

    alone = [points([t])[0] for t in texts]
    assert points(texts) == alone and points(texts[::-1]) == alone[::-1]
    bad = [b"a\xff\xfeb", b"", b"\xc3", b"\xa9 after half a letter", b"good", "é".encode()]
    assert points(bad) == [points([b])[0] for b in bad] and points(bad)[4] == list(b"good")


def test_invalid_text_in_all_stages(spark, docs_of):
    rng = random.Random(3)
    docs = docs_of(rows_of(rng, 40))
    broken = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.unhex(F.lit("C3FFFE41")), F.encode("text", "UTF-8")).cast("string")).otherwise(F.col("text")))
    assert langid.identified_documents(broken).count() >= 36
    assert simhash.one_per_group(broken).count() == 40


def test_mix_fills_past_documents_that_do_not_fit(docs_of, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([1, 2, 3, 5, 8, 300, 2700]), None, rng.choice("abcdef")) for i in range(300)]
    rows += [(1000, "w " * 30, None, "g")] * 30 + [(1001 + i, "w " * 7, None, "g") for i in range(9)]
    for levels in ((13, 50_000), (3, 4)):
        monkeypatch.setattr(mixing, "BUCKET_BITS", levels[0])
        monkeypatch.setattr(mixing, "BUCKET_ROWS", levels[1])
        got = mixing.with_mix(docs_of(rows), F.array("source")).collect()
        taken, target = Counter(), {}
        for r in got:
            taken[r.source] += r.taken
            target[r.source] = r.source_targets[0].target
            assert r.taken in (0, r.size, 2 * r.size)
        for s, t in target.items():
            # one word is the smallest document; copies of one id go together
            assert abs(taken[s] - t) <= (0.002 * t + 2 if s != "g" else 450), (s, taken[s], t)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables absent")
def test_mix_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text")
    taken, target = Counter(), {}
    for r in mixing.with_mix(docs, F.array("source")).collect():
        taken[r.source] += r.taken
        target[r.source] = r.source_targets[0].target
    assert all(abs(taken[s] - t) <= 0.01 * t + 2 for s, t in target.items())


def test_stages_are_listed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "tokens"]
