"""Expanding short names: abbreviations from their definitions, names from longer ones.

Definitions are sought in the text of a document by a small kernel that streams
over Arrow batches; choosing among them, and comparing names, is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import STOP_WORDS, ends_with_name, is_abbreviation
from ..functions.strsim import abbreviation_similarity, matches_longer_name, ngram_similarity
from .candidates import MENTION, lookup, prefer, select_by_name, top_by

_WORD = re.compile(r"[^\W_]+(?:['&.-][^\W_]+)*|[^\w\s]|_")


@dataclass(frozen=True)
class ExpansionRules:
    least_similarity: float = 0.5
    sure_similarity: float = 0.95
    backward_stop_words: int = 3
    forward_stop_words: int = 1


def _is_sign(word: str) -> bool:
    return word != "&" and not any(c.isalnum() or c == "'" for c in word)


def _may_begin(word: str) -> bool:
    return not _is_sign(word) and word.lower() not in STOP_WORDS and any(c.isupper() for c in word)


def _span(text: str, tokens: list[re.Match], first: int, last: int) -> str:
    return re.sub(r"\s+", " ", text[tokens[first].start() : tokens[last].end()]).strip()


def _reach(name: str) -> int:
    """How many words a definition may have."""
    return min(len(name) + 5, 2 * len(name))


def _before(name: str, text: str, at: int, rules: ExpansionRules) -> list[str]:
    """Definitions that end right before a place: stretches back over few function words, no sign, one sentence."""
    begin = max(text.rfind(x, 0, at) for x in (". ", "! ", "? ", "\n")) + 1
    tokens = list(_WORD.finditer(text, begin, at))
    first, stops = len(tokens), 0
    while first and len(tokens) - first < _reach(name):
        word = tokens[first - 1][0]
        stops += word.lower() in STOP_WORDS
        if _is_sign(word) or stops > rules.backward_stop_words:
            break
        first -= 1
    found = [_span(text, tokens, i, len(tokens) - 1) for i in range(first, len(tokens) - 1) if _may_begin(tokens[i][0])]
    return [x for x in found if name not in x]


def _forward(name: str, text: str, rules: ExpansionRules) -> list[str]:
    """Definitions anywhere: from a word with the abbreviation's first letter on."""
    found = []
    for sentence in re.split(r"(?<=[.!?])\s|\n", text):
        tokens = list(_WORD.finditer(sentence))
        for i, first in enumerate(tokens):
            if first[0][0].lower() != name[0].lower() or not _may_begin(first[0]):
                continue
            stops = 0
            for j in range(i, min(len(tokens), i + _reach(name))):
                word = tokens[j][0]
                stops += word.lower() in STOP_WORDS
                if _is_sign(word) or stops > rules.forward_stop_words:
                    break
                if j > i and _may_begin(word):
                    found.append(_span(sentence, tokens, i, j))
    return [x for x in dict.fromkeys(found) if name not in x]


def find_definitions(name: str, text: str, rules: ExpansionRules = ExpansionRules()) -> list[tuple[str, str]]:
    """Definitions of an abbreviation as (way, text): "after" for A (full), "before" for full (A), else "forward"."""
    if not name or not text:
        return []
    quoted = re.escape(name)
    found = [("after", m[1].strip()) for m in re.finditer(rf"{quoted}\s*\(([^()\n]*)\)", text)]
    for m in re.finditer(rf"\(\s*{quoted}\s*\)", text):
        found += [("before", x) for x in _before(name, text, m.start(), rules)]
    found += [("forward", x) for x in _forward(name, text, rules)]
    return list(dict.fromkeys(found))


def abbreviation_definitions(mentions: DataFrame, docs: DataFrame, rules: ExpansionRules = ExpansionRules(), text: str = "text") -> DataFrame:
    """Definitions of the abbreviations among mentions: doc_id, mention_id, name, way, definition, similarity.

    mentions: doc_id, mention_id, name, ner_type.
    """
    short = mentions.filter(is_abbreviation(F.col("name"), F.col("ner_type"))).select(*MENTION, "name")
    rows = short.join(docs.select("doc_id", F.col(text).alias("__text")), "doc_id").select(*MENTION, "name", "__text")
    names = [*MENTION, "name", "way", "definition"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, m, n, way, x) for d, m, n, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True) for way, x in find_definitions(n, t, rules)]
            types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)

    kinds = [rows.schema[x].dataType.simpleString() for x in MENTION]
    found = rows.mapInArrow(run, f"doc_id {kinds[0]}, mention_id {kinds[1]}, name string, way string, definition string")
    return found.withColumn("similarity", abbreviation_similarity(F.col("name"), F.col("definition"))).filter(F.col("similarity") > rules.least_similarity)


def best_by_similarity(definitions: DataFrame, least: float | None = None) -> DataFrame:
    """The likest definition of each mention; with ``least``, only above it.  Ties: the least text."""
    best = definitions.groupBy(*MENTION).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("definition"))).alias("__b"))
    rows = best.select(*MENTION, "__b.definition", (-F.col("__b.s")).alias("similarity"))
    return rows if least is None else rows.filter(F.col("similarity") > least)


def best_by_known_name(definitions: DataFrame, known: DataFrame, least: float = 0.95) -> DataFrame:
    """The definition closest to a name of the knowledge base (name): those above ``least`` by n-gram similarity.

    Names meet over their first three letters and a length within a fifth.
    """
    key = F.lower(F.substring("definition", 1, 3))
    left = definitions.select(*MENTION, "definition").withColumn("__k", key)
    right = known.select(F.col("name").alias("__name")).distinct().withColumn("__k", F.lower(F.substring("__name", 1, 3)))
    near = left.join(right, "__k").filter(F.abs(F.length("definition") - F.length("__name")) <= F.greatest(F.length("definition"), F.length("__name")) / 5)
    scored = near.withColumn("similarity", ngram_similarity(F.lower("definition"), F.lower("__name"))).filter(F.col("similarity") > least)
    return best_by_similarity(scored)


def longest_first(definitions: DataFrame) -> DataFrame:
    order = Window.partitionBy(*MENTION).orderBy(F.desc(F.length("definition")), "definition")
    return definitions.withColumn("place", F.row_number().over(order))


def choose_definition(definitions: DataFrame, known: DataFrame, rules: ExpansionRules = ExpansionRules()) -> DataFrame:
    """One definition a mention: doc_id, mention_id, definition, confidence.

    One in brackets after the abbreviation is sure; then those before it and those
    found anywhere, each first by known names, then by similarity.
    """

    def ranked(way: str, order: int, least: float | None) -> DataFrame:
        own = definitions.filter(F.col("way") == way)
        by_name = best_by_known_name(own, known, rules.sure_similarity).withColumn("__o", F.lit(2 * order))
        by_likeness = best_by_similarity(own, least).withColumn("__o", F.lit(2 * order + 1))
        sure = F.lit(1.0) if order == 1 else F.col("similarity")
        return by_name.unionByName(by_likeness).select(*MENTION, "definition", sure.alias("confidence"), "__o")

    first = best_by_similarity(definitions.filter("way = 'after'")).select(*MENTION, "definition", F.lit(1.0).alias("confidence"), F.lit(0).alias("__o"))
    all_ = first.unionByName(ranked("before", 1, None)).unionByName(ranked("forward", 2, rules.sure_similarity))
    best = all_.groupBy(*MENTION).agg(F.min(F.struct("__o", "definition", "confidence")).alias("__b"))
    return best.select(*MENTION, "__b.definition", "__b.confidence")


def abbreviation_candidates(chosen: DataFrame, mentions: DataFrame, priors: DataFrame, sure: float = 0.99) -> DataFrame:
    """Candidates through definitions; those of the abbreviation itself too, pruned, where the definition is not sure."""
    named = mentions.select(*MENTION, "name").join(chosen, MENTION)
    by_definition = lookup(named.select(*MENTION, F.col("definition").alias("name")), priors)
    own = mentions.select(*MENTION, "name").join(chosen.filter(F.col("confidence") >= sure).select(*MENTION), MENTION, "left_anti")
    return prefer(select_by_name(lookup(own, priors)), by_definition)


def longer_names(mentions: DataFrame) -> DataFrame:
    """For one-word names, longer names of the same type in the document that they fit: doc_id, mention_id, name, longer.

    mentions: doc_id, mention_id, name, ner_type.  Compared are distinct names of a document.
    """
    names = mentions.select("doc_id", "ner_type", "name").distinct()
    long = names.filter(F.contains("name", F.lit(" "))).withColumnRenamed("name", "longer")
    short = names.filter(~F.contains("name", F.lit(" ")))
    fit = short.join(long, ["doc_id", "ner_type"]).filter(F.length("longer") > F.length("name")).filter(matches_longer_name("name", "longer"))
    return mentions.select(*MENTION, "ner_type", "name").join(fit, ["doc_id", "ner_type", "name"]).select(*MENTION, "name", "longer")


def name_alternatives(mentions: DataFrame) -> DataFrame:
    """Names of the document that end with the mention's: doc_id, mention_id, alternatives."""
    names = mentions.select("doc_id", F.col("name").alias("__long")).distinct()
    met = mentions.select(*MENTION, "name").join(names, "doc_id").filter((F.length("__long") > F.length("name")) & ends_with_name(F.col("__long"), F.col("name")))
    return met.groupBy(*MENTION).agg(F.sort_array(F.collect_set("__long")).alias("alternatives"))


def compose_with_next_location(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose name ends with the location that follows the mention closely, else all.

    mentions: doc_id, mention_id, start_tok, end_tok, sent_no, name, ner_type.
    """
    order = Window.partitionBy("doc_id", "sent_no").orderBy("start_tok")
    following = mentions.select(*MENTION, F.lead(F.struct("name", "ner_type", "start_tok")).over(order).alias("__n"), "end_tok")
    place = following.filter((F.col("__n.ner_type") == "LOC") & (F.col("__n.start_tok") - F.col("end_tok") <= 2)).select(*MENTION, F.col("__n.name").alias("__loc"))
    return _matching_or_all(candidates, place)


def prune_by_locations(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose name ends with any location of the document, else all."""
    places = mentions.filter("ner_type = 'LOC'").select("doc_id", F.col("name").alias("__loc")).distinct()
    return _matching_or_all(candidates, mentions.select(*MENTION).join(places, "doc_id"))


def _matching_or_all(candidates: DataFrame, places: DataFrame) -> DataFrame:
    hit = candidates.select(*MENTION, "entity").distinct().join(places, MENTION).filter(ends_with_name(F.col("entity"), F.col("__loc")))
    hit = hit.select(*MENTION, "entity").distinct()
    some = hit.select(*MENTION).distinct()
    kept = candidates.join(hit, [*MENTION, "entity"], "left_semi")
    return kept.unionByName(candidates.join(some, MENTION, "left_anti").select(*kept.columns))


def adjacent(mentions: DataFrame, most: int = 2) -> DataFrame:
    """Whether a mention follows the one before within ``most`` tokens: adds adjacent."""
    order = Window.partitionBy("doc_id", "sent_no").orderBy("start_tok")
    return mentions.withColumn("adjacent", F.coalesce(F.col("start_tok") - F.lag("end_tok").over(order) <= most, F.lit(False)))


def name_candidates(mentions: DataFrame, priors: DataFrame, k: int = 3) -> DataFrame:
    """Candidates of names: composed with the next location, through longer names first, else pruned by locations."""
    longer = longer_names(mentions).select(*MENTION, F.col("longer").alias("name"))
    through = lookup(longer, priors)
    own = compose_with_next_location(mentions, lookup(mentions.select(*MENTION, "name"), priors))
    rest = own.join(through.select(*MENTION).distinct(), MENTION, "left_anti")
    pruned = prune_by_locations(mentions, top_by(rest, "prior", k))
    return through.unionByName(pruned.select(*through.columns))


def best_alias(names: DataFrame, least: float = 0.93) -> DataFrame:
    """The closest other alias (alias_lc) of each name, by Jaro-Winkler, from fuzzy_aliases."""
    best = names.filter(F.col("alias_lc") != F.lower("name")).groupBy("name").agg(F.min(F.struct((-F.col("jaro_winkler")).alias("s"), F.col("alias_lc"))).alias("__b"))
    return best.filter(-F.col("__b.s") >= least).select("name", "__b.alias_lc", (-F.col("__b.s")).alias("jaro_winkler"))
