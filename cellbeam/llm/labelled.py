"""Bounded samples of labelled rows, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id, __text, __label`` of about ``bound`` labelled documents at most, chosen by a hash of the id.

    Rows without an id or a label are left out; of several labels of one id the least counts. The ids sent to the executors number about ``bound``, whatever
    the size of the tables.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__id is not null and __label is not null")
    share = min(1.0, bound / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64(F.lit("sample"), "__id"), F.lit(1 << 24)) < int(share * (1 << 24)))
    one = picked.groupBy("__id").agg(F.min("__label").alias("__label"))
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(one), "__id")
