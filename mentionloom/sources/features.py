"""Feature rows as text, the form in which rankers are trained elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_lines(rows: DataFrame) -> DataFrame:
    """value: one line a candidate, [entity]name:prior, local, semantic, name, label, by tabs, in order of document and mention."""
    numbers = F.concat_ws("\t", *[F.col(x).cast("string") for x in ("prior", "local", "semantic", "name", "label")])
    return rows.orderBy("doc_id", "mention_id", "entity").select(F.concat(F.lit("[entity]"), F.col("entity").cast("string"), F.lit(":"), numbers).alias("value"))


def write_features(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
