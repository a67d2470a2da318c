"""The training-data operators bound to the test tables, one query each."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.llm import alignment, bpe, chat, jaccard, lm, media, mixing, quality, rank_bpe, shared, sort_means, suffixes, toxicity, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def span_digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(suffixes.deduplicate(_documents(spark, sf_dir).select("doc_id", "text")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_documents(spark, sf_dir))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def media_digests(docs: DataFrame, where: str) -> DataFrame:
    payload = F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload")
    media.write_archives(docs.select("doc_id", payload), where)
    read = media.features(media.read_archives(docs.sparkSession, where))
    size = F.octet_length("payload")
    return read.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substr(F.col("payload"), size - 15, F.lit(16))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(_documents(spark, sf_dir), shared.shared_dir(spark))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    read = chat.read_threads(chat.format_threads(chat.linear_messages(turns.unionByName(added))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode_documents(_documents(spark, sf_dir), tokenizer_path()))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = shared.shared_dir(spark)
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), where)
    read = warc.read_warc(spark, where)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_rows(toxicity.score_documents(docs, model, ["doc_id"]))


def toxicity_rows(scored: DataFrame) -> DataFrame:
    """A row without an id is never held out."""
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.summarize(_documents(spark, sf_dir), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def cluster_digests(found: sort_means.Clustering) -> DataFrame:
    """Rows of a clustering with the values of their clusters; the constants are as many as centroids."""
    whole = sum(found.inertias) if None not in found.inertias else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]

    def of_cluster(values: list, kind: str):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1) if values else F.lit(None).cast(kind)

    return found.rows.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        of_cluster(found.inertias, "long").alias("cluster_inertia"),
        F.lit(whole if whole is None or whole < 1 << 63 else None).cast("long").alias("inertia"),
        of_cluster(names, "string").alias("centroid_sha256"),
    )


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_digests(sort_means.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = rank_bpe.encode_documents(_documents(spark, sf_dir), path, pattern)
    return token_digests(rank_bpe.decode_documents(encoded, path, pattern))


QUERIES = {
    "op1_suffixes": op1_suffixes,
    "op2_quality": op2_quality,
    "op3_lm": op3_lm,
    "op4_jaccard": op4_jaccard,
    "op5_mixing": op5_mixing,
    "op6_media": op6_media,
    "op7_chat": op7_chat,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_sort_means": op12_sort_means,
    "op13_rank_bpe": op13_rank_bpe,
}

ORACLE = {
    "op5_mixing": mixing.ORACLE,
    "op7_chat": chat.ORACLE,
    "op9_warc": warc.ORACLE,
    "op12_sort_means": sort_means.oracle(),
}
