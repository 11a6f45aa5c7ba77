"""A corpus pipeline of four stages; each works on all that the stage before kept.

``STAGES`` lists (name, function) with functions of (spark, docs, sf_dir); each result is written
as Parquet in the shared folder and read again as the docs of the next.  All but the last return the
columns of documents.

Nulls and empties: a null text counts as empty, scores the bias of the toxicity model alone, is a near duplicate of
other empty texts (the least doc_id stays), loses nothing and packs as its end token.  A row with a null doc_id is nobody's
near duplicate, keeps its text and is packed.  Rows that repeat a doc_id are one document: all stay or go as near duplicates
together.  Very long texts are processed whole.  Without labels the model scores 0.5, which is over the threshold, so
all rows would be rejected as toxic: without a single label the stage keeps all rows.  An empty table gives no rows.
Columns beyond those of documents are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import jaccard_join, kernels, packing, suffix_dedup
from strandlake.llm import toxicity as tox
from strandlake.llm.queries import table, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model of the labelled rows marks as toxic (score of 0.3 or more)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    weights = tox.train(docs.where(~tox.held_out()), labels)
    if len(weights[0]) == 0 and weights[2] == 0.0:  # nothing to learn from
        return docs.select(*COLUMNS)
    return tox.score(docs.select(*COLUMNS), weights).where(F.col("score") < tox.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each class of linked texts; rows without a doc_id stay."""
    classes = jaccard_join.jaccard_classes(docs)
    keep = classes.where("doc_id = class_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that a document of a smaller doc_id holds; a character cut in two goes whole."""
    done = suffix_dedup.remove_repeats(docs.select(*COLUMNS), keep=COLUMNS, as_text=True)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("text"))
    return done.withColumn("text", text).withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into windows of 2048 tokens."""
    return packing.packed_digests(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", pack)]

#: Learned scores can't be written in SQL; tests hold run() against the stages one by one and against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kernels.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
