"""The queries of this subpackage: each applies one operator to its whole table.

``QUERIES`` maps names to functions of (spark, sf_dir); ``ORACLES`` maps names
to DuckDB SQL where SQL expresses the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hpyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hpyp import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_and_decode

    done = encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed_digests

    return packed_digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann_tree import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .webp import media_columns

    m = media_columns(table(spark, sf_dir, "documents"))
    return m.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import labelled

    return labelled(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import formatted_digests

    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{said}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{said}'")
    return formatted_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


QUERIES = {f.__name__: f for f in (op1_hpyp, op2_bpe, op3_jaccard_join, op4_packing, op5_ann_tree, op6_webp, op7_toxicity, op8_license_scan, op9_suffix_dedup, op10_chat_format)}


def _oracles() -> dict[str, str]:
    from . import chat_format, jaccard_join, suffix_dedup

    return {"op3_jaccard_join": jaccard_join.SQL, "op9_suffix_dedup": suffix_dedup.SQL, "op10_chat_format": chat_format.SQL}


ORACLES = _oracles()
