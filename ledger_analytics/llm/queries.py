"""Queries of the subpackage that ``__spark_entry__`` registers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_analytics.llm import (
    decontaminate,
    langid,
    mixing,
    negatives,
    neighbours,
    packing,
    repeats,
    sharding,
    simhash,
    tokens,
    toxicity,
    trie,
    urls,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.with_language(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(_table(spark, sf_dir, "documents"))


def token_rows(docs: DataFrame) -> DataFrame:
    """Write the token file of ``docs`` and read it back."""
    path = tokens.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_documents(docs.sparkSession, path, with_ids=False)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    tree = sharding.unit_tree()
    placed = sharding.assign(rows, "doc_id", tree)
    return placed.withColumn("law", F.lit("key")).withColumn("grown_shard", sharding.shard_of(F.col("doc_id"), sharding.grow(tree)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~langid.held_out())
    scored = toxicity.with_toxicity(docs, toxicity.train(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id",
        langid.held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
    )


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


URL_RULES = [
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.train(urls.labelled_table(pages))
    return urls.judge(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.with_mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.array("source"))
    return mix.select(
        "doc_id", "size", F.col("source_sizes")[0]["size"].alias("source_size"),
        F.col("source_targets")[0]["target"].alias("target"), "taken",
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"), ["doc_id"])
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = trie.prefix_trie(shared_starts(trie.turn_paths(_table(spark, sf_dir, "conversations"))))
    # 0 turns end in the root
    digests = trie.list_digests(made.ends, "node", "conv_id").withColumnRenamed("key", "node")
    nodes = made.nodes.join(digests, "node", "left")
    counts = [F.col(c).cast("long") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return nodes.select(*counts, F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def shared_starts(paths: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the first one of its five."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    first = paths.where("conv_id % 5 = 0").select(F.col("conv_id").alias("start"), F.slice("turns", 1, 8).alias("start_turns"))
    rows = paths.withColumn("h", h).withColumn("start", F.col("conv_id") - F.col("conv_id") % 5).join(first, "start", "left")
    head = F.slice(F.coalesce("start_turns", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(head, rest).alias("turns"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    digests = pieces.withColumn("ids_crc32", F.crc32("token_ids")).drop("token_ids")
    return packing.pack(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Query] = {
    "op1_language": op1_language,
    "op2_tokens": op2_tokens,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_embeddings": op6_embeddings,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_repeats": op10_repeats,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_packing": op12_packing,
    "op13_negatives": op13_negatives,
}

ORACLE: dict[str, str] = {
    "op4_decontamination": r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT cast(item_id AS varchar) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, pos, pos + 9), ' ') AS t
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT r, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT r, place.n, pos, item FROM place JOIN win ON place.t = win.t AND place.n = win.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
""",
}
