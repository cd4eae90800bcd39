"""Candidate entities of mentions.

Mentions: doc_id, mention_id, name.  Candidates: doc_id, mention_id, entity,
source, prior.  Ties are broken by entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import alias_key, ends_with_name, normalize_name
from ..functions.strsim import dice_bigrams, edit_similarity, grams, jaro_winkler, ngram_similarity

MENTION = ["doc_id", "mention_id"]


def lookup(mentions: DataFrame, priors: DataFrame) -> DataFrame:
    """Join mentions with the alias dictionary by key."""
    keyed = mentions.withColumn("alias_lc", alias_key(F.col("name")))
    return keyed.join(priors, "alias_lc").select(*mentions.columns, "entity", "source", "prior")


def lookup_normalized(mentions: DataFrame, priors: DataFrame) -> DataFrame:
    """As lookup; mentions that the dictionary lacks are tried again by their normalised name."""
    keys = priors.select("alias_lc").distinct()
    keyed = mentions.withColumn("__k1", alias_key(F.col("name"))).withColumn("__k2", alias_key(normalize_name(F.col("name"))))
    known = keyed.join(keys, F.col("__k1") == F.col("alias_lc"), "left")
    key = F.coalesce("alias_lc", "__k2")
    rows = known.withColumn("__key", key).drop("alias_lc")
    return rows.join(priors, F.col("__key") == F.col("alias_lc")).select(*mentions.columns, "entity", "source", "prior")


def merge_names(candidates: DataFrame) -> DataFrame:
    """Candidates of several names of one mention: priors of the same entity add up."""
    return candidates.groupBy(*MENTION, "entity").agg(F.sum("prior").alias("prior"))


def above_prior(candidates: DataFrame, least: float = 2e-5) -> DataFrame:
    return candidates.filter(F.col("prior") >= least)


def above_source_threshold(candidates: DataFrame, link: float = 0.005, other: float = 0.001) -> DataFrame:
    return candidates.filter(F.col("prior") > F.when(F.col("source") == "link", link).otherwise(other))


def _rank(by: str, key: list[str] = MENTION):
    return F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(by), "entity"))


def top_by(candidates: DataFrame, by: str, k: int, key: list[str] = MENTION) -> DataFrame:
    """The k best candidates of each mention."""
    return candidates.withColumn("__rank", _rank(by, key)).filter(F.col("__rank") <= k).drop("__rank")


def top_union(candidates: DataFrame, by_context: int = 3, by_prior: int = 3, context: str = "context", least: float = 2e-5) -> DataFrame:
    """Candidates among the best by context or by prior, with the least prior; one pass, no union."""
    ranked = candidates.withColumns({"__c": _rank(context), "__p": _rank("prior")})
    return above_prior(ranked.filter((F.col("__c") <= by_context) | (F.col("__p") <= by_prior)), least).drop("__c", "__p")


def best_prior(candidates: DataFrame) -> DataFrame:
    """The candidate of the largest prior of each mention: doc_id, mention_id, entity, prior."""
    top = candidates.groupBy(*MENTION).agg(F.min(F.struct((-F.col("prior")).alias("p"), F.col("entity"))).alias("__b"))
    return top.select(*MENTION, "__b.entity", (-F.col("__b.p")).alias("prior"))


def agreeing(candidates: DataFrame, context: str = "context") -> DataFrame:
    """Mentions whose best candidates by prior and by context are the same: doc_id, mention_id, entity."""
    top = candidates.groupBy(*MENTION).agg(F.min(F.struct((-F.col("prior")).alias("p"), F.col("entity"))).alias("__p"), F.min(F.struct((-F.col(context)).alias("c"), F.col("entity"))).alias("__c"))
    return top.filter("__p.entity = __c.entity").select(*MENTION, "__p.entity")


def keep_agreed(candidates: DataFrame, agreed: DataFrame) -> DataFrame:
    """Only the agreed candidate of mentions that have one."""
    sure = agreed.select(*MENTION, F.col("entity").alias("__sure"))
    return candidates.join(sure, MENTION, "left").filter(F.col("__sure").isNull() | (F.col("__sure") == F.col("entity"))).drop("__sure")


def ambiguity_order(candidates: DataFrame, descending: bool = True) -> DataFrame:
    """doc_id, mention_id, n_candidates, place: mentions of each document, the most ambiguous first."""
    counts = candidates.groupBy(*MENTION).agg(F.count(F.lit(1)).alias("n_candidates"))
    order = F.desc("n_candidates") if descending else F.asc("n_candidates")
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(order, "mention_id")))


def clean(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Of mentions with several candidates, drop those that ``known`` (entity) lacks; single ones stay."""
    counts = candidates.groupBy(*MENTION).agg(F.count(F.lit(1)).alias("__n"))
    rows = candidates.join(counts, MENTION).join(known.select("entity").distinct().withColumn("__known", F.lit(True)), "entity", "left")
    return rows.filter((F.col("__n") <= 1) | F.col("__known")).select(*candidates.columns)


def select_by_name(candidates: DataFrame, k: int = 3) -> DataFrame:
    """Candidates whose name ends with the mention's, or among the k best by edit similarity or by prior."""
    scored = candidates.withColumn("__edit", edit_similarity(F.lower("name"), F.lower("entity")))
    ranked = scored.withColumns({"__e": _rank("__edit"), "__p": _rank("prior")})
    return ranked.filter(ends_with_name(F.col("entity"), F.col("name")) | (F.col("__e") <= k) | (F.col("__p") <= k)).drop("__edit", "__e", "__p")


def fuzzy_aliases(names: DataFrame, aliases: DataFrame, top: int = 200, fused: int = 3) -> DataFrame:
    """Aliases close to each name: name, alias_lc, dice, ngram, jaro_winkler.

    Names and aliases meet over shared 2-grams; the ``top`` aliases by shared grams
    are compared, and those among the ``fused`` best by one of three measures stay.
    Common grams pair many aliases, so shared grams are counted by partial
    aggregation on (name, alias) before anything else.
    """
    keyed = names.select("name").distinct().withColumn("__key", alias_key(F.col("name")))
    left = keyed.withColumn("__gram", F.explode(F.array_distinct(grams(F.col("__key")))))
    right = aliases.select("alias_lc").distinct().withColumn("__gram", F.explode(F.array_distinct(grams(F.col("alias_lc")))))
    shared = left.join(right, "__gram").groupBy("name", "__key", "alias_lc").agg(F.count(F.lit(1)).alias("__shared"))
    first = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("__shared"), "alias_lc"))
    near = shared.withColumn("__rank", first).filter(F.col("__rank") <= top)
    scored = near.select("name", "alias_lc", dice_bigrams(F.col("__key"), F.col("alias_lc")).alias("dice"), ngram_similarity("__key", "alias_lc").alias("ngram"), jaro_winkler("__key", "alias_lc").alias("jaro_winkler"))

    def place(by: str):
        return F.row_number().over(Window.partitionBy("name").orderBy(F.desc(by), "alias_lc"))

    ranked = scored.withColumns({"__a": place("dice"), "__b": place("ngram"), "__c": place("jaro_winkler")})
    return ranked.filter((F.col("__a") <= fused) | (F.col("__b") <= fused) | (F.col("__c") <= fused)).drop("__a", "__b", "__c")


def fuzzy_lookup(mentions: DataFrame, priors: DataFrame, least: float = 0.8, **how) -> DataFrame:
    """Candidates through the closest other alias, if its Jaro-Winkler similarity is at least ``least``.

    Priors are those of that alias alone.
    """
    near = fuzzy_aliases(mentions, priors, **how).filter(F.col("alias_lc") != alias_key(F.col("name")))
    best = near.groupBy("name").agg(F.min(F.struct((-F.col("jaro_winkler")).alias("s"), F.col("alias_lc"))).alias("__b")).filter(-F.col("__b.s") >= least)
    return mentions.join(best.select("name", "__b.alias_lc"), "name").join(priors, "alias_lc").select(*mentions.columns, "entity", "source", "prior")


def lookup_or_fuzzy(mentions: DataFrame, priors: DataFrame, least: float = 0.8, **how) -> DataFrame:
    """Exact candidates, then by normalised name, then fuzzy ones for mentions without any."""
    exact = lookup_normalized(mentions, priors)
    rest = mentions.join(exact.select(*MENTION).distinct(), MENTION, "left_anti")
    return exact.unionByName(fuzzy_lookup(rest, priors, least, **how))


def prefer(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two candidate sets; where both have a candidate, the second's row counts."""
    left = first.join(second.select(*MENTION, "entity").distinct(), [*MENTION, "entity"], "left_anti")
    return left.unionByName(second)
