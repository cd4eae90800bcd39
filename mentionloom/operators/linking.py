"""Linking mentions to entities over the graph of the knowledge base.

A document's candidates are seeds; the graph around them gives each candidate a
walk vector, and the unambiguous entities of the document a walk vector of its own.
A candidate is scored by its prior, the similarity of contexts, and the closeness of
both vectors.  Candidates and neighbours are joined by Spark; the walks of one
document run as a kernel on its own small graph, documents with very many candidates
(unless each decision changes the next) by joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import LinkConfig
from ..functions import names
from ..functions.scores import score, semantic_similarity, tfidf
from ..functions.strsim import jaro_winkler
from . import candidates as cand
from . import graph, models, vectors, walks
from .candidates import MENTION
from .settle import settle

#: Up to so many candidates of aliases are sent to every task, more are joined by shuffle.
FEW = 100_000
#: Neighbour lists of up to so many arcs (some 20 MB) are sent to every task, longer ones are dealt to the blocks that use them.
FEW_ARCS = 1 << 20


@dataclass(frozen=True)
class KnowledgeBase:
    """priors: alias_lc, entity, source, prior.  edges: src, dst, w, both directions if undirected.
    terms: entity, term, weight.  degree: node, in_degree.  ranker, nil: fitted by ``models`` on
    the features prior, local, semantic and name, for runs that ask for them.  settled: edges
    are read from where they were written, so using them again costs no more than reading."""

    priors: DataFrame
    edges: DataFrame
    terms: DataFrame | None = None
    degree: DataFrame | None = None
    ranker: PipelineModel | None = None
    nil: PipelineModel | None = None
    settled: bool = False

    def degrees(self) -> DataFrame:
        return graph.degrees(self.edges) if self.degree is None else self.degree


def local_similarity(found: DataFrame, contexts: DataFrame | None, entity_terms: DataFrame | None) -> DataFrame:
    """Add context: 1 for single candidates, else the cosine of the document's and the entity's terms.

    contexts: doc_id, term, weight; with mention_id too, each mention has a context of its own.
    """
    counts = found.groupBy(*MENTION).agg(F.count(F.lit(1)).alias("__n"))
    rows = found.join(counts, MENTION)
    if contexts is None or entity_terms is None:
        return rows.withColumn("context", F.when(F.col("__n") == 1, 1.0).otherwise(0.0)).drop("__n")
    key = MENTION if "mention_id" in contexts.columns else ["doc_id"]
    pairs = rows.filter("__n > 1").select(F.struct(*key).alias("__of"), "entity")
    near = vectors.cosine_pairs(pairs, contexts.select(F.struct(*key).alias("__of"), "term", "weight"), entity_terms, "__of", "entity")
    rows = rows.join(near.select("__of.*", "entity", "cosine"), [*key, "entity"], "left")
    return rows.withColumn("context", F.when(F.col("__n") == 1, 1.0).otherwise(F.coalesce("cosine", F.lit(0.0)))).drop("__n", "cosine")


def preference_weight(kind: str, prior: Column, context: Column, mention_weight: Column | None = None, seed: int = 42) -> Column:
    """Weight of an entity (or, with mention_weight, a mention) by strategy."""
    if kind == "UNIFORM":
        return F.lit(1.0)
    if kind == "RANDOM":
        return F.rand(seed)
    if kind == "PRIOR_PROB":
        return prior
    if kind == "CTX_SIM":
        return context
    if kind == "TFIDF" and mention_weight is not None:
        return mention_weight
    raise ValueError(f"unknown preference {kind}")


def mention_weights(mentions: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Mentions with weight, the tf-idf of their name: occurrences in their document, documents with such a mention."""
    n = docs.select("doc_id").distinct().count()
    spread = mentions.groupBy(F.lower("name").alias("__lc")).agg(F.countDistinct("doc_id").alias("__df"))
    met = mentions.join(docs.select("doc_id", F.col(text).alias("__text")), "doc_id").withColumn("__tf", vectors.overlapping_count(F.col("__text"), F.col("name"))).withColumn("__lc", F.lower("name"))
    return met.join(spread, "__lc").withColumn("weight", tfidf(F.col("__tf"), F.col("__df"), F.lit(n))).select(*mentions.columns, "weight")


def select_candidates(mentions: DataFrame, kb: KnowledgeBase, cfg: LinkConfig, contexts: DataFrame | None = None) -> DataFrame:
    """Candidates of all mentions, pruned: doc_id, mention_id, entity, source, prior, context, name, mention_weight.

    name is the similarity of the mention's and the entity's names where a model
    asks for it; mention_weight follows mention_preference (TFIDF: the mentions'
    column weight, see ``mention_weights``).
    """
    if cfg.mention_preference == "TFIDF" and "weight" not in mentions.columns:
        raise ValueError("TFIDF needs mentions with a weight")
    if cfg.context == "sentence" and contexts is not None and "mention_id" not in contexts.columns:
        raise ValueError("sentence contexts need a mention_id")
    weight = {"UNIFORM": F.lit(1.0), "RANDOM": F.rand(42)}.get(cfg.mention_preference)
    weighed = mentions.select(*MENTION, "name", (F.col("weight") if weight is None else weight).alias("mention_weight"))
    if cfg.mention_preference == "RANDOM":
        weighed = settle(weighed)
    lookup = cand.lookup_normalized if cfg.selection == "normalized" else cand.lookup
    found = lookup(weighed, kb.priors)
    if cfg.selection == "source":
        found = cand.top_by(cand.above_source_threshold(found, cfg.link_threshold, cfg.other_threshold), "prior", cfg.top_by_source)
    found = local_similarity(found, contexts, kb.terms)
    pruned = found if cfg.selection == "source" else cand.top_union(found, cfg.top_by_context, cfg.top_by_prior, least=cfg.min_prior)
    kept = cand.clean(pruned, graph.nodes(kb.edges).withColumnRenamed("node", "entity"))
    similar = jaro_winkler(F.col("name"), F.col("entity").cast("string")) if cfg.supervised or cfg.nil_prediction else F.lit(0.0)
    return kept.withColumn("name", similar).select(*MENTION, "entity", "source", "prior", "context", "name", "mention_weight")


def unambiguous(found: DataFrame) -> DataFrame:
    """Mentions with one candidate, or whose best by prior and by context agree: doc_id, mention_id, entity."""
    return cand.agreeing(found)


def document_preference(found: DataFrame, sure: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Preference of each document's walk, for each mention: doc_id, mention_id, node, p.

    The unambiguous entities but the mention's own candidates; where none is left,
    all candidates of the other mentions; where there are none either, its own.
    """
    mentions = found.select(*MENTION).distinct()
    own = found.select(*MENTION, F.col("entity").alias("node")).distinct()
    # The approximate set: an entity's share of its mention's weights, times the mention's weight; the largest counts.
    weight = preference_weight(cfg.entity_preference, F.col("prior"), F.col("context"))
    by_mention = Window.partitionBy(*MENTION)
    shared = found.withColumn("__w", weight).withColumn("__s", F.sum("__w").over(by_mention))
    share = F.when(F.col("__s") > 0, F.col("__w") / F.col("__s")).otherwise(0.0)
    if "mention_weight" in found.columns:
        share = share * F.col("mention_weight")
    pool = shared.groupBy("doc_id", F.col("entity").alias("node")).agg(F.max(share).alias("weight"))
    known = sure.select("doc_id", F.col("entity").alias("node")).distinct().withColumn("weight", F.lit(1.0)) if cfg.use_unambiguous else pool.limit(0)
    who = mentions.select(*MENTION)

    def others(rows: DataFrame, rank: int) -> DataFrame:
        return who.join(rows, "doc_id").join(own, [*MENTION, "node"], "left_anti").select(*MENTION, "node", "weight", F.lit(rank).alias("__rank"))

    last = own.join(pool, ["doc_id", "node"]).select(*MENTION, "node", "weight", F.lit(2).alias("__rank"))
    all_ = others(known, 0).unionByName(others(pool, 1)).unionByName(last)
    best = all_.groupBy(*MENTION).agg(F.min("__rank").alias("__best"))
    return walks.weighted_preference(all_.join(best, MENTION).filter("__rank = __best"), MENTION)


def document_graph(found: DataFrame, kb: KnowledgeBase, cfg: LinkConfig) -> DataFrame:
    """Arcs around each document's candidates: doc_id, src, dst, w; weights are 1 in unweighted graphs."""
    seeds = found.select("doc_id", F.col("entity").alias("node")).distinct()
    reached = graph.expand(kb.edges, seeds, cfg.expand_level, cfg.min_in_degree, cfg.directed, ["doc_id"], kb.degrees())
    arcs = graph.subgraph(kb.edges, seeds, reached, cfg.directed, ["doc_id"])
    return arcs if cfg.weighted else arcs.withColumn("w", F.lit(1))


def features(found: DataFrame, kb: KnowledgeBase, cfg: LinkConfig, kernel_rows: int = 1000) -> DataFrame:
    """Raw features of every candidate: doc_id, mention_id, entity, prior, local, semantic.

    Documents of at most ``kernel_rows`` candidates are walked in memory, one at a
    time; larger ones by joins that any number of tasks share.  Both give the same
    numbers, up to rounding.
    """
    extra = ["name"] if "name" in found.columns else []
    count = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"))
    large = settle(count.filter(F.col("__n") > kernel_rows).select("doc_id"))
    some = not large.isEmpty()
    small = found.join(large, "doc_id", "left_anti") if some else found
    weights = ["mention_weight"] if "mention_weight" in found.columns else []
    close = by_document(small.select(*MENTION, "entity", "prior", "context", *weights), kb, cfg, lambda group, arcs: document_semantics(group, arcs, cfg), _result_schema(found, "semantic double"))
    out = small.join(close, [*MENTION, "entity"], "left").select(*MENTION, "entity", "prior", F.col("context").alias("local"), "semantic", *extra)
    return out.unionByName(features_by_joins(settle(found.join(large, "doc_id", "left_semi")), kb, cfg)) if some else out


def features_by_joins(found: DataFrame, kb: KnowledgeBase, cfg: LinkConfig) -> DataFrame:
    """``features`` with every walk as joins and aggregations."""
    arcs = settle(document_graph(found, kb, cfg))
    seeds = found.select("doc_id", F.col("entity").alias("node")).distinct().withColumn("seed", F.col("node"))
    own = walks.walk(arcs, walks.uniform_preference(seeds, ["doc_id"], ["seed"]), cfg.alpha, cfg.steps, ["doc_id"], ["seed"])
    preference = settle(document_preference(found, unambiguous(found), cfg))
    whole = walks.walk(arcs, preference, cfg.alpha, cfg.steps, ["doc_id"], ["mention_id"])
    pairs = found.select(*MENTION, F.col("entity").alias("seed"))
    left = pairs.join(own, ["doc_id", "seed"]).select(*MENTION, "seed", "node", "p")
    apart = vectors.divergence(left, whole, MENTION, ["seed"]).withColumnRenamed("seed", "entity")
    rows = found.join(apart, [*MENTION, "entity"], "left")
    return rows.select(*MENTION, "entity", "prior", F.col("context").alias("local"), semantic_similarity(F.col("divergence"), cfg.least_divergence).alias("semantic"), *(["name"] if "name" in found.columns else []))


def normalized(rows: DataFrame, names: tuple[str, ...] = ("prior", "local", "semantic")) -> DataFrame:
    """Features over their sum for the mention, where that is above 0."""
    by = Window.partitionBy(*MENTION)
    return rows.withColumns({x: F.when(F.sum(x).over(by) > 0, F.col(x) / F.sum(x).over(by)).otherwise(F.col(x)) for x in names})


def rank(rows: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Add the score of normalised features."""
    return rows.withColumn("score", score(cfg.rank_scheme, F.col("prior"), F.col("local"), F.col("semantic"), cfg.prior_weight, cfg.local_weight))


def winners(rows: DataFrame) -> DataFrame:
    """The best candidate of each mention: doc_id, mention_id, entity, score; ties: the least entity."""
    best = rows.groupBy(*MENTION).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("entity"))).alias("__b"))
    return best.select(*MENTION, "__b.entity", (-F.col("__b.s")).alias("score"))


def _need_models(kb: KnowledgeBase, cfg: LinkConfig) -> None:
    if cfg.supervised and kb.ranker is None:
        raise ValueError("supervised needs a ranker")
    if cfg.nil_prediction and kb.nil is None:
        raise ValueError("nil_prediction needs a classifier")


def link(mentions: DataFrame, kb: KnowledgeBase, cfg: LinkConfig = LinkConfig(), contexts: DataFrame | None = None) -> DataFrame:
    """doc_id, mention_id, entity (null: NIL) for every mention (doc_id, mention_id, name; weight for TFIDF).

    Mentions whose best candidates by prior and context agree are sure; the ranker
    and the classifier decide the others.
    """
    _need_models(kb, cfg)
    if (contexts is None or kb.terms is None) and not (cfg.supervised or cfg.nil_prediction) and cfg.selection != "normalized" and cfg.expand_level == 1 and "RANDOM" not in (cfg.mention_preference, cfg.entity_preference):
        mentions = settle(mentions)
        if mentions.groupBy(*MENTION).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return link_by_alias(mentions, kb, cfg)
    found = settle(select_candidates(mentions, kb, cfg, contexts))
    if cfg.use_iterative:
        best = link_iteratively(found, kb, cfg)
    else:
        sure = unambiguous(found)
        rows = normalized(features(settle(cand.keep_agreed(found, sure)), kb, cfg), ("prior", "local", "semantic", "name"))
        if not (cfg.supervised or cfg.nil_prediction):
            best = winners(rank(rows, cfg))
        else:
            rows = settle(rows)
            top = models.rank_supervised(kb.ranker, rows) if cfg.supervised else winners(rank(rows, cfg))
            best = rows.join(top.select(*MENTION, "entity"), [*MENTION, "entity"])
            if cfg.nil_prediction:
                open_ = models.predict_nil(kb.nil, best.join(sure, MENTION, "left_anti"))
                best = best.join(sure, MENTION, "left_semi").unionByName(open_)
    return mentions.select(*MENTION).distinct().join(best.select(*MENTION, "entity"), MENTION, "left")


def link_by_alias(mentions: DataFrame, kb: KnowledgeBase, cfg: LinkConfig, kernel_rows: int = 1000, docs: int = 4000, arcs: int = 1 << 24, sent: int = FEW_ARCS, few_options: int = FEW) -> DataFrame:
    """``link`` where candidates hang on a mention's alias alone: no contexts, no models, one name a mention (doc_id, mention_id).

    Candidates are selected once an alias; few of them go to every task, and mentions
    meet them a document at a time.  Mentions move without them, once, in blocks of
    some ``docs`` documents, and a document is decided whole where its graph is made.
    Neighbour lists of at most ``sent`` arcs go to every task; else blocks get theirs,
    and have fewer documents if their lists would hold more than ``arcs`` arcs.
    """
    if cfg.mention_preference == "TFIDF" and "weight" not in mentions.columns:
        raise ValueError("TFIDF needs mentions with a weight")
    weight = F.col("weight") if cfg.mention_preference == "TFIDF" else F.lit(1.0)
    base = kb.edges if kb.settled else settle(kb.edges)
    kb = replace(kb, edges=base, degree=settle(kb.degrees() if kb.degree is not None else graph.degrees(base)))
    # An alias stands for its mentions.
    found = kb.priors.select(F.lit(0).alias("doc_id"), F.col("alias_lc").alias("mention_id"), "entity", "source", "prior")
    if cfg.selection == "source":
        found = local_similarity(cand.top_by(cand.above_source_threshold(found, cfg.link_threshold, cfg.other_threshold), "prior", cfg.top_by_source), None, None)
    else:
        found = cand.top_union(local_similarity(found, None, None), cfg.top_by_context, cfg.top_by_prior, least=cfg.min_prior)
    found = settle(cand.clean(found, graph.nodes(kb.edges).withColumnRenamed("node", "entity")))
    if not cfg.use_iterative:
        found = settle(cand.keep_agreed(found, unambiguous(found)))
    options = found.select(F.col("mention_id").alias("alias_lc"), "entity", "prior", "context")
    sent_options = options.toArrow() if options.count() <= few_options else None
    if sent_options is not None:
        options = F.broadcast(options)
    seeds = settle(found.select(F.col("entity").alias("node")).distinct())
    lists = settle(graph.neighbour_lists(kb.edges, kb.degrees(), cfg.min_in_degree, of=F.broadcast(seeds) if seeds.count() <= FEW else seeds))
    keyed = mentions.select(*MENTION, names.alias_key(F.col("name")).alias("alias_lc"), weight.alias("mention_weight"))
    of_alias = options.join(lists.groupBy(F.col("node").alias("entity")).agg(F.sum(F.size("far")).alias("arcs")), "entity", "left").groupBy("alias_lc").agg(F.sum("arcs").alias("arcs"), F.count(F.lit(1)).alias("n"))
    all_arcs = lists.agg(F.sum(F.size("far")).alias("arcs")).first()["arcs"] or 0
    # Documents of a block share its lists: it never has more than all arcs.
    measured = 0 if all_arcs <= max(sent, arcs) else keyed.groupBy("alias_lc").agg(F.count(F.lit(1)).alias("times")).join(of_alias, "alias_lc").agg(F.sum(F.col("arcs") * F.col("times")).alias("arcs")).first()["arcs"] or 0
    # Enough blocks to keep all tasks busy, too.
    n = keyed.agg(F.approx_count_distinct("doc_id").alias("n")).first()["n"]
    tasks = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // docs), -(-measured // arcs), min(n, 4 * tasks))
    if cfg.use_iterative:
        large = None
    else:
        few = F.broadcast(of_alias) if found.count() <= FEW else of_alias
        large = settle(keyed.join(few, "alias_lc").groupBy("doc_id").agg(F.sum("n").alias("n")).filter(F.col("n") > kernel_rows).select("doc_id"))
        large = None if large.isEmpty() else large
    small = keyed if large is None else keyed.join(large, "doc_id", "left_anti")
    # Mentions move before they meet their candidates; those without any go along, so that nothing is joined to the results.
    dealt = small.withColumn("__block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    schema = _result_schema(dealt.join(options, "alias_lc"))
    if cfg.mention_preference != "TFIDF":
        dealt = dealt.drop("mention_weight")
    if sent_options is not None:
        # An alias is a number then (null: no candidates), its place among the sent ones.
        aliases = pc.unique(sent_options.column("alias_lc"))
        coded = mentions.sparkSession.createDataFrame(list(zip(aliases.to_pylist(), range(len(aliases)), strict=True)), "alias_lc string, __alias int")
        dealt = dealt.join(F.broadcast(coded), "alias_lc", "left").drop("alias_lc")
    whole = all_arcs <= sent
    moved = dealt.repartition(min(blocks, 2000), "__block") if whole else dealt.repartition("__block")
    if sent_options is None:
        moved = moved.join(options, "alias_lc", "left").drop("alias_lc")
    decided = (lambda group, arcs: decide(group, arcs, cfg)) if cfg.use_iterative else (lambda group, arcs: choose(group, arcs, cfg))
    best = by_document(moved, kb, cfg, decided, schema, blocks, lists, whole, sent_options)
    if large is not None:
        some = keyed.join(large, "doc_id", "left_semi")
        rest = some.join(options, "alias_lc").drop("alias_lc")
        known = winners(rank(normalized(features_by_joins(settle(rest), kb, cfg)), cfg)).select(*MENTION, "entity")
        best = best.unionByName(some.select(*MENTION).join(known, MENTION, "left"))
    return best


def link_by_prior(mentions: DataFrame, priors: DataFrame) -> DataFrame:
    """doc_id, mention_id, entity of the largest prior; mentions without a candidate are left out.

    The best of each alias is found first, so a mention meets one candidate for each of its names.
    """
    top = priors.groupBy("alias_lc").agg(F.min(F.struct((-F.col("prior")).alias("p"), F.col("entity"), F.col("source"))).alias("__b"))
    best = top.select("alias_lc", "__b.entity", "__b.source", (-F.col("__b.p")).alias("prior"))
    return cand.best_prior(cand.lookup(mentions, best)).select(*MENTION, "entity")


class Signatures:
    """Walk vectors of one document: candidates (mention_id, entity, prior, context) and arcs (src, dst, w).

    ``seeds``: the entities whose closeness will be asked for.
    """

    def __init__(self, group: pd.DataFrame, arcs: pd.DataFrame, cfg: LinkConfig, threshold: float, seeds: set) -> None:
        ends = pd.concat([group["entity"], arcs["src"], arcs["dst"]], ignore_index=True) if len(arcs) else group["entity"]
        codes, names = pd.factorize(ends, sort=True)
        self.place, self.n = {x: i for i, x in enumerate(names)}, len(names)
        k, m = len(group), len(arcs)
        self.arcs = (codes[k : k + m], codes[k + m :], arcs["w"].to_numpy(float)) if m else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        self.cfg, self.threshold = cfg, threshold
        self.row = {x: i for i, x in enumerate(sorted(seeds))}
        unit = np.zeros((len(seeds), self.n))
        unit[np.arange(len(seeds)), [self.place[x] for x in self.row]] = 1
        self.own = self._walk(unit)
        self.entropy = self.own * np.log2(np.where(self.own == 0, 1, self.own))

    def _walk(self, preference: np.ndarray) -> np.ndarray:
        return walks.walk_kernel(self.n, *self.arcs, preference, self.cfg.alpha, self.cfg.steps, self.threshold)

    def of_sets(self, wanted: list[dict]) -> np.ndarray:
        """A vector for each set of weighed entities."""
        preference = np.zeros((len(wanted), self.n))
        for i, one in enumerate(wanted):
            preference[i, [self.place[x] for x in one]] = list(one.values())
        total = preference.sum(axis=1, keepdims=True)
        return self._walk(preference / np.where(total == 0, 1, total))

    def closeness(self, entities: list, whole: np.ndarray) -> np.ndarray:
        """Semantic similarity of entities to one vector: the inverse of the divergence, with its floor."""
        at = [self.row[x] for x in entities]
        far = whole <= 1e-6
        own = self.own[at]
        apart = self.entropy[at][:, ~far].sum(axis=1) - own[:, ~far] @ np.log2(whole[~far]) + 10.0 * own[:, far].sum(axis=1)
        return 1 / np.maximum(apart, self.cfg.least_divergence)


def _document_sets(group: pd.DataFrame, cfg: LinkConfig) -> tuple[dict, list[tuple], dict, dict]:
    """Agreed mentions, the others with their rows, the sure entities, and the approximate set of all entities with weights."""
    decided: dict = {}
    open_: list[tuple] = []
    for mention, rows in group.sort_values("entity").groupby("mention_id", sort=True):
        by_prior = rows["entity"].iloc[int(rows["prior"].to_numpy().argmax())]
        by_context = rows["entity"].iloc[int(rows["context"].to_numpy().argmax())]
        if by_prior == by_context:
            decided[mention] = by_prior
        else:
            open_.append((mention, rows))
    sure = {x: 1.0 for x in decided.values()} if cfg.use_unambiguous else {}
    kind = cfg.entity_preference
    if kind == "UNIFORM":
        weight = np.ones(len(group))
    elif kind == "RANDOM":
        weight = np.random.default_rng(42).random(len(group))
    elif kind in ("PRIOR_PROB", "CTX_SIM"):
        weight = group["prior" if kind == "PRIOR_PROB" else "context"].to_numpy(float)
    else:
        raise ValueError(f"unknown preference {kind}")
    # The approximate set: an entity's share of its mention's weights, times the mention's weight; the largest counts.
    weighed = pd.DataFrame({"mention": group["mention_id"].to_numpy(), "entity": group["entity"].to_numpy(), "w": weight})
    total = weighed.groupby("mention")["w"].transform("sum").to_numpy()
    weighed["w"] = np.divide(weight, total, out=np.zeros(len(weight)), where=total > 0)
    if "mention_weight" in group:
        weighed["w"] *= group["mention_weight"].to_numpy(float)
    return decided, open_, sure, weighed.groupby("entity")["w"].max().to_dict()


def _wanted(avoid: set, sure: dict, pool: dict) -> dict:
    return {k: v for k, v in sure.items() if k not in avoid} or {k: v for k, v in pool.items() if k not in avoid} or {k: pool[k] for k in avoid}


def document_semantics(group: pd.DataFrame, arcs: pd.DataFrame, cfg: LinkConfig) -> pd.DataFrame:
    """The semantic feature of every candidate of one document, no decision changing the next: mention_id, entity, semantic."""
    _, _, sure, pool = _document_sets(group, cfg)
    signatures = Signatures(group, arcs, cfg, 0.0, set(group["entity"]))
    mentions = [(m, rows["entity"].tolist()) for m, rows in group.groupby("mention_id", sort=True)]
    whole = signatures.of_sets([_wanted(set(x), sure, pool) for _, x in mentions])
    parts = [pd.DataFrame({"mention_id": m, "entity": x, "semantic": signatures.closeness(x, q)}) for (m, x), q in zip(mentions, whole, strict=True)]
    return pd.concat(parts, ignore_index=True)


def _scores(a: np.ndarray, b: np.ndarray, s: np.ndarray, cfg: LinkConfig) -> np.ndarray:
    """``score`` of one mention's normalised features."""
    return {
        "LINEAR": cfg.prior_weight * a + cfg.local_weight * b + (1 - cfg.prior_weight - cfg.local_weight) * s,
        "MULTIPLY": cfg.prior_weight * a * s + (1 - cfg.prior_weight) * b * s,
        "NOR": 1 - (1 - a) * (1 - b) * (1 - s),
        "PRIOR_SEM": a * s,
        "LOCAL_SEM": b * s,
        "SEMANTIC": s,
    }[cfg.rank_scheme]


def _share(x) -> np.ndarray:
    x = np.asarray(x, float)
    return x / x.sum() if x.sum() > 0 else x


def choose(group: pd.DataFrame, arcs: pd.DataFrame, cfg: LinkConfig) -> pd.DataFrame:
    """The winner of every mention of one document, no decision changing the next: mention_id, entity; ties: the least entity."""
    group = group.sort_values(["mention_id", "entity"], ignore_index=True)
    close = document_semantics(group, arcs, cfg)["semantic"].to_numpy()
    starts = np.flatnonzero(np.r_[True, group["mention_id"].to_numpy()[1:] != group["mention_id"].to_numpy()[:-1]])
    prior, local, entity = (group[x].to_numpy() for x in ("prior", "context", "entity"))
    best = [i + int(np.argmax(_scores(_share(prior[i:j]), _share(local[i:j]), _share(close[i:j]), cfg))) for i, j in zip(starts, [*starts[1:], len(group)], strict=True)]
    return pd.DataFrame({"mention_id": group["mention_id"].to_numpy()[starts], "entity": entity[best]})


def decide(group: pd.DataFrame, arcs: pd.DataFrame, cfg: LinkConfig, ranker: tuple | None = None, nil: tuple | None = None) -> pd.DataFrame:
    """Iterative linking of one document: candidates (mention_id, entity, prior, context) and arcs (src, dst, w).

    ranker, nil: linear parts of the models (over prior, local, semantic, name).

    Unambiguous mentions come first; the others follow by number of candidates, and
    each winner joins the document's set before the next is decided.
    """
    decided, open_, sure, pool = _document_sets(group, cfg)
    open_.sort(key=lambda x: (-len(x[1]) if cfg.order == "desc" else len(x[1]), x[0]))
    signatures = Signatures(group, arcs, cfg, cfg.walk_threshold, {x for _, rows in open_ for x in rows["entity"]}) if open_ else None
    for mention, rows in open_:
        whole = signatures.of_sets([_wanted(set(rows["entity"]), sure, pool)])[0]
        semantic = signatures.closeness(rows["entity"].tolist(), whole)

        a, b, s = _share(rows["prior"]), _share(rows["context"]), _share(semantic)
        scores = _scores(a, b, s, cfg)
        table = np.stack([a, b, s, _share(rows["name"]) if "name" in rows else np.zeros(len(rows))], axis=1)
        if ranker is not None:
            scores = table @ ranker[0] + ranker[1]
        at = int(np.argmax(scores))
        if nil is not None and table[at] @ nil[0] + nil[1] <= 0:
            decided[mention] = None
            continue
        best = rows["entity"].iloc[at]
        decided[mention] = best
        sure[best] = 1.0
    return pd.DataFrame({"doc_id": group["doc_id"].iloc[0], "mention_id": list(decided), "entity": list(decided.values())})


def arcs_of_lists(near: pd.DataFrame, directed: bool) -> pd.DataFrame:
    """One document's arcs (src, dst, w) from its seeds' neighbours: node, far, w, kind (1: far is large, 2: the arc leads to node).

    Gives what ``graph.expand`` over one hop and ``graph.subgraph`` give.
    """
    if near.empty:
        return pd.DataFrame({"src": [], "dst": [], "w": []})
    codes, names = pd.factorize(pd.concat([near["node"], near["far"]], ignore_index=True))
    node, far, n = codes[: len(near)], codes[len(near) :], len(names)
    kind, w = near["kind"].to_numpy(int), near["w"].to_numpy(float)
    inward, large = (kind & 2) > 0, (kind & 1) > 0
    served = np.zeros(2 * n, bool)
    served[(2 * node + inward)[large]] = True
    chosen = (large | ~served[2 * node + inward]) & (inward | directed)
    reached = np.zeros(n, bool)
    reached[node] = reached[far[chosen]] = True
    kept = np.flatnonzero(reached[far] & (far != node))
    # An arc between two seeds stands in both lists; its largest weight counts.
    arc = np.where(inward, far * n + node, node * n + far)[kept]
    order = np.argsort(arc, kind="stable")
    arc, w = arc[order], w[kept][order]
    starts = np.flatnonzero(np.r_[True, arc[1:] != arc[:-1]]) if len(arc) else np.zeros(0, int)
    best = np.maximum.reduceat(w, starts) if len(arc) else w
    return pd.DataFrame({"src": names[arc[starts] // n], "dst": names[arc[starts] % n], "w": best})


def by_document(found: DataFrame, kb: KnowledgeBase, cfg: LinkConfig, one: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, blocks: int = 0, lists: DataFrame | None = None, whole: bool = False, options: pa.Table | None = None) -> DataFrame:
    """``one`` on the candidates and arcs of each document.

    Over one hop the seeds' packed neighbour lists travel instead of the document's
    arcs, and the document's graph is made where it is used.  Documents of a block
    (column __block, if there are ``blocks``) share the lists; without, and over
    more hops, a task holds one document at a time.  whole: all lists go to every
    task.  Mentions without a candidate (entity null) come out as they are.
    options: alias_lc, entity, prior, context of aliases, to be sent to every task;
    mentions have the place of their alias (column __alias) instead of candidates.
    """
    of = "__block" if blocks and cfg.expand_level == 1 else "doc_id"
    if cfg.expand_level == 1:
        lists = settle(graph.neighbour_lists(kb.edges, kb.degrees(), cfg.min_in_degree)) if lists is None else lists
        with_entity = found
        if options is not None and not whole:
            place = options.column("alias_lc").combine_chunks().dictionary_encode().indices
            entities = found.sparkSession.createDataFrame(pa.table({"__alias": place, "entity": options.column("entity")}))
            with_entity = found.select(of, "__alias").distinct().join(F.broadcast(entities), "__alias")
        right = None if whole else with_entity.select(F.col(of).alias("__doc"), F.col("entity").alias("node")).distinct().join(lists, "node")
    else:
        right = settle(document_graph(found, kb, cfg)).withColumnRenamed("doc_id", "__doc")
    names = [x.split(" ")[0] for x in schema.split(", ")]
    target = to_arrow_schema(found.sparkSession.createDataFrame([], schema).schema)

    def run(left: pa.Table, right: pa.Table, options: pa.Table | None) -> pa.Table:
        if left.num_rows == 0:
            return target.empty_table()
        open_ = pc.is_null(left.column("entity" if options is None else "__alias"))
        for x in MENTION:
            open_ = pc.or_(open_, pc.is_null(left.column(x)))
        out = []
        if pc.any(open_).as_py():
            alone = left.filter(open_).select(MENTION).group_by(MENTION).aggregate([])
            out.append(pa.table([alone.column(x).cast(target.field(x).type) if x in MENTION else pa.nulls(len(alone), target.field(x).type) for x in names], schema=target))
            left = left.filter(pc.invert(open_))
        rows = left.to_pandas()
        if options is not None:
            place = options.column("alias_lc").combine_chunks().dictionary_encode().indices.to_numpy()
            known = options.select(["entity", "prior", "context"]).to_pandas()
            by_alias = np.argsort(place, kind="stable")
            many = np.bincount(place)
            begins = np.cumsum(many) - many
        if cfg.expand_level == 1:
            parts = {x: right.column(x).combine_chunks() for x in ("far", "w", "kind")}
            flat = {x: v.flatten().to_pandas().to_numpy() for x, v in parts.items()}
            node = right.column("node").to_pandas()
            size = pc.list_value_length(parts["far"]).to_numpy()
            first, held = np.cumsum(size) - size, node.groupby(node).indices
        else:
            arcs = right.select(["src", "dst", "w"]).to_pandas()
        for at in rows.groupby("doc_id", sort=False).indices.values():
            group = rows.iloc[at].reset_index(drop=True)
            if options is not None:
                alias = group.pop("__alias").to_numpy()
                n = many[alias]
                own = by_alias[np.arange(n.sum()) + np.repeat(begins[alias] - (np.cumsum(n) - n), n)]
                group = pd.concat([group.iloc[np.repeat(np.arange(len(group)), n)].reset_index(drop=True), known.iloc[own].reset_index(drop=True)], axis=1)
            if cfg.expand_level == 1:
                own = np.concatenate([held[x] for x in group["entity"].unique() if x in held] or [np.zeros(0, int)])
                long = size[own]
                place = np.repeat(first[own] - (np.cumsum(long) - long), long) + np.arange(long.sum())
                near = pd.DataFrame({"node": np.repeat(node.to_numpy()[own], long), **{x: v[place] for x, v in flat.items()}})
                arcs = arcs_of_lists(near, cfg.directed)
            if not cfg.weighted and len(arcs):
                arcs["w"] = 1.0
            done = one(group, arcs).assign(doc_id=group["doc_id"].iloc[0])[names]
            out.append(pa.Table.from_pandas(done, schema=target, preserve_index=False))
        return pa.concat_tables(out)

    sc = found.sparkSession.sparkContext
    chosen = None if options is None else sc.broadcast(options)
    if whole:
        near = sc.broadcast(lists.select("node", "far", "w", "kind").toArrow())
        return found.groupBy(of).applyInArrow(lambda left: run(left, near.value, chosen and chosen.value), schema)
    return found.groupBy(of).cogroup(right.groupBy("__doc")).applyInArrow(lambda left, right: run(left, right, chosen and chosen.value), schema)


def _result_schema(found: DataFrame, *more: str) -> str:
    return ", ".join([f"{x} {found.schema[x].dataType.simpleString()}" for x in (*MENTION, "entity")] + list(more))


def link_iteratively(found: DataFrame, kb: KnowledgeBase, cfg: LinkConfig) -> DataFrame:
    """Decide each document in order of ambiguity; one kernel call a document, which holds that document alone."""
    ranker = models.linear_part(kb.ranker) if cfg.supervised else None
    nil = models.linear_part(kb.nil) if cfg.nil_prediction else None
    more = [x for x in ("name", "mention_weight") if x in found.columns]
    rows = found.select(*MENTION, "entity", "prior", "context", *more)
    return by_document(rows, kb, cfg, lambda group, arcs: decide(group, arcs, cfg, ranker, nil), _result_schema(found))


def training_rows(raw: DataFrame, gold: DataFrame, mentions: DataFrame) -> DataFrame:
    """Features with the similarity of names and whether the entity is the gold one: ..., name, label."""
    rows = raw.join(mentions.select(*MENTION, F.col("name").alias("__mention")), MENTION).join(gold.select(*MENTION, F.col("gold").alias("__gold")), MENTION)
    return rows.select(*MENTION, "entity", "prior", "local", "semantic", jaro_winkler(F.col("__mention"), F.col("entity").cast("string")).alias("name"), F.col("entity").eqNullSafe(F.col("__gold")).cast("int").alias("label"))
