"""The queries of the operators, one for each, over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.llm.shared import crc32_residue, table


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from penumbra.llm.records import read_records, write_records

    manifest, folder = write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_records(manifest, folder)


def op2_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.llm.jaccard import classes_and_links

    found = classes_and_links(table(spark, sf_dir, "documents"), size=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def op3_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.llm.languages import fit, predict
    from penumbra.llm.samples import fitted, labelled_sample

    docs = table(spark, sf_dir, "documents")
    held_out = crc32_residue("doc_id", 4) == 2
    model = fitted(labelled_sample(docs, docs, ~held_out, "lang", max_per_class=400), fit)
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.llm.suffixes import find_matches

    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.llm.lines import dedup_lines

    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_removed", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.length("text").cast("long").alias("n_chars"))


def op8_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.llm.ring import shard_rows

    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shard_rows(rows, [F.col("doc_id")], [F.col("text_crc32"), F.col("size")], n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def toxicity_network(docs: DataFrame, labels: DataFrame):
    """The network of operator 9, from labels whose crc32 residue mod 3 is not 1."""
    from penumbra.llm.samples import fitted, labelled_sample
    from penumbra.llm.toxicity import fit

    return fitted(labelled_sample(docs, labels, crc32_residue("doc_id", 3) != 1, "toxic", max_per_class=1500, most_classes=2), fit)


def op9_gated_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.llm.toxicity import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, toxicity_network(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (crc32_residue("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: Target weights of the tree of documents: domains, their languages, and their sources alike.
DOMAIN_WEIGHTS = {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}
LANGUAGE_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def domain_of(source_col: str = "source"):
    """Sources are dealt to four domains by the number in their name."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source_col, r"(\d+)$", 1).try_cast("int") % 4, F.lit(0)).cast("string"))


def mixing_weights() -> dict[tuple, float]:
    weights: dict[tuple, float] = {(d,): w for d, w in DOMAIN_WEIGHTS.items()}
    return weights | {(d, lang): w for d in DOMAIN_WEIGHTS for lang, w in LANGUAGE_WEIGHTS.items()}


def op5_hierarchical_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.llm.budgets import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", domain_of())
    chosen = mix(docs, ["domain", "lang", "source"], mixing_weights(), share=0.6, max_epochs=2, seed=11)
    return chosen.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.llm.quality import features, judge

    measured = features(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.llm.mixing_lm import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_residue("doc_id", 5) == 1
    scored = score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op11_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.llm.elkan import compress

    coded, codebooks = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for x in codebooks.ravel()).encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.llm.whitening import whiten

    rows = whiten(table(spark, sf_dir, "embeddings"), components=8)
    return rows.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error", "residual")


def op13_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.llm.minhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from penumbra.llm import oracles

    return {
        "op2_adaptive_prefix_join": oracles.linked_sets(4, 85, "class_id"),
        "op4_suffix_arrays": oracles.contamination(),
        "op11_elkan_codes": oracles.product_codes(),
        "op13_circulant_minhash": oracles.linked_sets(2, 80, "component_id = doc_id AS kept, class_id"),
    }
