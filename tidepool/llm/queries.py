"""The registered queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automata, exact_dedup, forest, language, lexical, licences, packing, pieces, prefix_trie, run_index, secrets, shingle_join, source_mix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit_by_remainder(docs))
    held_out = F.coalesce(language.remainder() == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_components(table(spark, sf_dir, "documents"))


def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_exact_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.scrub(table(spark, sf_dir, "documents"), with_text=False)


def op8_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.size("spans").cast("long").alias("n_matches"), F.array_join("licences", ",").alias("licences"), F.array_join("spans", ",").alias("spans"))


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op10_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.scrub(table(spark, sf_dir, "documents"), with_text=False)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_length_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op13_two_level_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_naive_bayes_language, op2_grouped_prefix_join, op3_projection_forest, op4_crf_secrets, op5_exact_recipes, op6_fair_queue_mix, op7_run_length_index, op8_sentence_rules, op9_sampled_pieces, op10_suffix_automata, op11_prefix_trie, op12_length_histogram_packing, op13_two_level_search)}

ORACLES = {
    "op5_exact_recipes": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)""",
    "op6_fair_queue_mix": source_mix.MIX_SQL,
    "op11_prefix_trie": prefix_trie.TRIE_SQL,
    "op13_two_level_search": lexical.SEARCH_SQL,
}
