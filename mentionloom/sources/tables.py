"""Parquet tables and tab-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import alias_key

ALIAS_RAW = "entity string, alias string, source string"
ALIAS_COUNTED = "entity string, alias string, source string, freq int"
REDIRECTS = "title string, target string"
NAME_IDS = "name string, page_id string"
EDGES_RAW = "src string, dst string"
EDGES = "src string, dst string, w float"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated lines without header; quotes mean nothing; lines of another width are dropped."""
    return spark.read.csv(path, schema=schema, sep="\t", quote="", mode="DROPMALFORMED", encoding="UTF-8")


def read_alias_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """alias_lc, entity, source, freq."""
    rows = read_tsv(spark, path, ALIAS_COUNTED)
    return rows.select(alias_key(F.col("alias")).alias("alias_lc"), "entity", "source", "freq")


def read_redirects(spark: SparkSession, path: str) -> DataFrame:
    """target and the titles that lead to it."""
    return read_tsv(spark, path, REDIRECTS).groupBy("target").agg(F.sort_array(F.collect_list("title")).alias("titles"))


def read_ascii_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a graph given as the number of nodes, then one line of neighbours for each node: src, dst, w = 1."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("i", "line"))
    rows = lines.filter("i > 0").select((F.col("i") - 1).alias("src"), F.explode(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")).alias("dst"))
    return rows.select("src", F.col("dst").cast("int").alias("dst"), F.lit(1).alias("w"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the file's name) and text of every file."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return spark.read.text(folder, wholetext=True).select(F.url_decode(name).alias("doc_id"), F.col("value").alias("text"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", quote="", escape="", emptyValue="", mode="overwrite")


def write_table(df: DataFrame, path: str, key: str | None = None) -> None:
    """Parquet, rows of a key together and in order, so readers that look a key up skip most of it."""
    (df if key is None else df.repartition(key).sortWithinPartitions(key)).write.mode("overwrite").parquet(path)
