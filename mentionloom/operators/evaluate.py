"""Accuracy, precision, recall and F1 of linked mentions.

Results: doc_id, gold, predicted (null: NIL), one row a mention.  A mention counts
as found if it is linked, or if both sides are NIL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import MENTION


def join_gold(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold mentions (doc_id, mention_id, gold) with what was predicted (doc_id, mention_id, entity), NIL where nothing was."""
    return gold.join(predicted.select(*MENTION, F.col("entity").alias("predicted")), MENTION, "left")


def normalize_nil(rows: DataFrame, column: str, keep: bool = False) -> DataFrame:
    """"NIL" and blank become null; such rows go unless NIL is to be predicted."""
    rows = rows.withColumn(column, F.when(F.col(column).isin("NIL", ""), None).otherwise(F.col(column)))
    return rows if keep else rows.filter(F.col(column).isNotNull())


def per_document(results: DataFrame) -> DataFrame:
    """doc_id, n_query, n_found, n_correct, accuracy, precision, recall, f1."""
    correct = F.col("gold").eqNullSafe(F.col("predicted"))
    found = F.col("predicted").isNotNull() | correct
    counts = results.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_query"), F.sum(found.cast("long")).alias("n_found"), F.sum(correct.cast("long")).alias("n_correct"))
    precision = F.when(F.col("n_found") > 0, F.col("n_correct") / F.col("n_found")).otherwise(0.0)
    recall = F.col("n_correct") / F.col("n_query")
    rows = counts.withColumns({"accuracy": recall, "precision": precision, "recall": recall})
    return rows.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def _f1(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def summary(documents: DataFrame) -> DataFrame:
    """One row from per_document: accuracy, micro and macro precision, recall and F1.

    Macro figures are means over documents, and their F1 that of the means.
    """
    micro_p = F.when(F.sum("n_found") > 0, F.sum("n_correct") / F.sum("n_found")).otherwise(0.0)
    micro_r = F.sum("n_correct") / F.sum("n_query")
    rows = documents.agg(micro_r.alias("accuracy"), micro_p.alias("micro_precision"), micro_r.alias("micro_recall"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"))
    return rows.withColumns({"micro_f1": _f1(F.col("micro_precision"), F.col("micro_recall")), "macro_f1": _f1(F.col("macro_precision"), F.col("macro_recall"))})
