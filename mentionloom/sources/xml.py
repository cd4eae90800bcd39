"""Wiki dumps and annotated benchmarks in XML, plain, gzip or bzip2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "title string, id string, redirect struct<_title: string>, revision struct<text: string>"
DOCUMENT = "_docName string, annotation array<struct<mention: string, wikiName: string, offset: string, entity: string>>"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Pages: title, id, text, redirect (null unless the page is one)."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    return rows.select(F.trim("title").alias("title"), "id", F.coalesce("revision.text", F.lit("")).alias("text"), F.col("redirect._title").alias("redirect"))


def read_benchmark(spark: SparkSession, path: str, nil: bool = False) -> DataFrame:
    """Gold mentions: doc_id, mention_id (place in the document), name, offset, gold.

    Annotations without a mention are skipped, those without an entity too unless
    ``nil`` is set; then gold is null.
    """
    rows = spark.read.format("xml").option("rowTag", "document").schema(DOCUMENT).load(path)
    one = rows.select(F.col("_docName").alias("doc_id"), F.posexplode("annotation").alias("mention_id", "a"))
    gold = F.when(~F.coalesce(F.trim("a.wikiName"), F.lit("")).isin("", "NIL"), F.trim("a.wikiName"))
    one = one.select("doc_id", "mention_id", F.trim("a.mention").alias("name"), F.col("a.offset").cast("int").alias("offset"), gold.alias("gold")).filter("name <> ''")
    return one if nil else one.filter("gold IS NOT NULL")


def write_linked(gold: DataFrame, predicted: DataFrame, path: str) -> None:
    """The benchmark with an entity for each annotation, NIL where nothing was linked."""
    rows = gold.join(predicted.select("doc_id", "mention_id", "entity"), ["doc_id", "mention_id"], "left")
    one = F.struct(F.col("name").alias("mention"), F.coalesce("gold", F.lit("NIL")).alias("wikiName"), "offset", F.coalesce(F.col("entity").cast("string"), F.lit("NIL")).alias("entity"))
    docs = rows.groupBy(F.col("doc_id").alias("_docName")).agg(F.sort_array(F.collect_list(F.struct("mention_id", one.alias("a")))).alias("__a"))
    docs = docs.select("_docName", F.transform("__a", lambda x: x["a"]).alias("annotation"))
    docs.write.format("xml").option("rowTag", "document").option("rootTag", "corpus").mode("overwrite").save(path)
