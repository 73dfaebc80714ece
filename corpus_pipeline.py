"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go, then low quality ones; of each group of near duplicates one document stays; passages that
repeat across the remaining texts are cut out; what is left is packed into training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellbeam.llm import jaccard_join, packing, quality, suffix_dedup, toxicity
from cellbeam.llm.common import drop_stash, shared_dir, small_batches, stash, table


def _whole(docs: DataFrame) -> DataFrame:
    """Each document as one struct beside its text, so that an operator carries all its columns along."""
    small_batches(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below 0.5; a null or empty text is not toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_whole(docs), model, id_col="row").where("predicted = 0").select("row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rule and the trees; null and empty texts fail the base rule."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(_whole(docs), model, id_col="row").where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group; rows of one id are one document; null ids stay."""
    small_batches(spark)
    groups = stash(jaccard_join.similar_groups(docs).groupBy("doc_id").agg(F.first("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("doc_id is not null and (n > 1 or doc_id <> component_id)"), shared_dir(spark))
    # few documents are copies: only their ids are looked up, so the texts need no shuffle while those are few
    ids = groups.select("doc_id")
    ids = F.broadcast(ids) if groups.count() <= jaccard_join.BROADCAST_IDS else ids
    firsts = groups.where("doc_id = component_id").select("doc_id")
    return docs.join(ids, "doc_id", "left_anti").select(docs.columns).unionByName(docs.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes and more that stand elsewhere as well; characters cut in half go, rows stay.

    A null text becomes empty; of repeated rows nothing is left if they are long enough.
    """

    @F.pandas_udf("string")
    def readable(kept):
        return kept.str.decode("utf-8", "ignore")

    out = suffix_dedup.remove_repeats(_whole(docs), id_col="row").select("row", readable("kept").alias("left"))
    new = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document that is left; a null or empty text is one piece of one token, repeated rows are packed again."""
    small_batches(spark)
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("near_duplicates", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("packing", pack)]
#: SQL cannot express the learned stages; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        at = shared_dir(spark)
        docs = stash(stage(spark, docs, sf_dir), at)
        if last:
            drop_stash(spark, last)
        last = at
    return STAGES[-1][1](spark, docs, sf_dir)
