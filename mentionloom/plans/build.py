"""From a dump to the tables of the knowledge base, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.markup import index_text
from ..operators import graph, kb, vectors
from ..operators.linking import KnowledgeBase
from ..sources.tables import write_table


def knowledge_tables(pages: DataFrame, cfg: LinkConfig = LinkConfig()) -> dict[str, DataFrame]:
    """aliases, redirects, name_ids, link_edges, cooccurrence_edges, entity_terms, term_df from pages (see kb)."""
    known = kb.classify_pages(pages)
    pairs = kb.redirects(known)
    frequencies = kb.entity_terms(known.filter("kind = 'entity'"), "title", index_text(F.col("text"))).withColumnRenamed("title", "entity")
    return {
        "aliases": kb.alias_dictionary(kb.expand_redirects(kb.alias_rows(known), pairs)),
        "redirects": pairs,
        "name_ids": kb.name_ids(known),
        "link_edges": kb.count_edges(kb.link_edges(known)),
        "cooccurrence_edges": graph.undirected(kb.count_edges(kb.cooccurrence_edges(known, cfg.cooccurrence_window))),
        "entity_terms": frequencies,
        "term_df": vectors.document_frequencies(frequencies),
    }


_KEYS = {"aliases": "alias_lc", "link_edges": "src", "cooccurrence_edges": "src", "entity_terms": "entity", "term_df": "term"}


def write_knowledge(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", _KEYS.get(name))


def read_knowledge(spark: SparkSession, folder: str, cfg: LinkConfig = LinkConfig()) -> KnowledgeBase:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}")

    frequencies = read("entity_terms")
    n = frequencies.select("entity").distinct().count()
    edges = read("link_edges") if cfg.directed else read("cooccurrence_edges")
    return KnowledgeBase(kb.prior_probabilities(read("aliases")), edges, vectors.tfidf_vectors(frequencies, "entity", read("term_df"), n))
