"""The registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from debatelens.llm import (
    alignment,
    decontamination,
    embeddings,
    licenses,
    mixing,
    packing,
    preferences,
    quality,
    sharding,
    simhash,
    spelling,
    substring,
    warc,
)
from debatelens.scale import scratch_path

#: Folder of the vocabulary files that the alignment reads.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences without their texts."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), texts=False).drop("texts")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    left = substring.remove_repeats(docs, joined=True)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(_table(spark, sf_dir, "embeddings"))


def op5_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and licences as lists with commas."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.array_join("sentences", ",").alias("sentences"),
        F.array_join("licenses", ",").alias("licenses"),
        "n_unknown",
        "rest",
    )


def op7_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"))


def op8_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page to archives in the shared folder, and the records' headers read back."""
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.page_records(_table(spark, sf_dir, "pages")), path)
    columns = ["record_id", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    records = warc.read_warc(spark, path, columns).where(F.col("record_type").isin("response", "revisit"))
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "kept"
    )


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its neighbour's last reply; spans as text."""
    pairs = preferences.format_pairs(preferences.with_other_reply(_table(spark, sf_dir, "conversations")))
    for side in ("chosen", "rejected"):
        spans = F.transform(f"{side}_spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
        pairs = pairs.withColumn(f"{side}_spans", F.array_join(spans, ","))
    return pairs


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.counted_runs(_table(spark, sf_dir, "documents"), drop_every=97, least=5)
    return spelling.variant_groups(runs.where("n >= 3"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    a = alignment.byte_bpe(spark, f"{tokenizers}/byte_bpe_50k.json")
    b = alignment.pieces(spark, f"{tokenizers}/piece_bpe_32k.model")
    found = alignment.align_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), a, b)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_poisson_mix": op3_poisson_mix,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_vector_sharding": op5_vector_sharding,
    "op6_license_rules": op6_license_rules,
    "op7_quality_divergence": op7_quality_divergence,
    "op8_warc_source": op8_warc_source,
    "op9_simhash": op9_simhash,
    "op10_preference_format": op10_preference_format,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_decontamination": op12_decontamination,
    "op13_token_alignment": op13_token_alignment,
}
