"""Linking a benchmark, or texts with marked mentions, and measuring the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..operators import annotate, candidates, coref, evaluate, linking, vectors
from ..operators.linking import KnowledgeBase


def contexts(docs: DataFrame, term_df: DataFrame, n: int) -> DataFrame:
    """Term vectors of documents (doc_id, text): doc_id, term, weight."""
    return vectors.tfidf_vectors(vectors.term_frequencies(docs, "doc_id", "text"), "doc_id", term_df, n)


def prepare(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """Annotations aligned with recognised mentions, person names resolved inside the document."""
    words = annotate.capital_labels(annotate.tokens(docs))
    found = annotate.mentions_of(words, annotate.merge_runs(words))
    aligned = annotate.align(gold, found, words)
    resolved = coref.resolve_persons(aligned)
    return resolved.withColumn("name", F.coalesce("canonical_name", "name"))


def link_benchmark(gold: DataFrame, docs: DataFrame, kb: KnowledgeBase, cfg: LinkConfig = LinkConfig(), document_contexts: DataFrame | None = None) -> DataFrame:
    """doc_id, mention_id, entity for gold mentions (doc_id, mention_id, name, offset)."""
    return linking.link(prepare(gold, docs), kb, cfg, document_contexts)


def link_markings(markings: DataFrame, docs: DataFrame, kb: KnowledgeBase, cfg: LinkConfig = LinkConfig(), document_contexts: DataFrame | None = None) -> DataFrame:
    """doc_id, marking_id, entity for marked texts (doc_id, marking_id, text, offset, length).

    Blank markings get no entity; results keep the marking's own key.
    """
    gold = markings.filter(F.trim("text") != "").select("doc_id", F.col("marking_id").alias("mention_id"), F.col("text").alias("name"), "offset")
    linked = link_benchmark(gold, docs, kb, cfg, document_contexts).withColumnRenamed("mention_id", "marking_id")
    return markings.select("doc_id", "marking_id").join(linked, ["doc_id", "marking_id"], "left")


def link_by_prior_with_coref(mentions: DataFrame, priors: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The prior baseline on each chain's longest name."""
    resolved = coref.resolve_chains(mentions, pairs)
    return linking.link_by_prior(resolved.withColumn("name", F.col("canonical_name")).select(*candidates.MENTION, "name"), priors)


def measure(gold: DataFrame, predicted: DataFrame, nil: bool = False) -> DataFrame:
    """One row of metrics."""
    rows = evaluate.normalize_nil(evaluate.join_gold(gold, predicted), "gold", keep=nil)
    return evaluate.summary(evaluate.per_document(rows))
