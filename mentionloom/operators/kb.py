"""Building the knowledge base from wiki pages.

Pages: title, id, text, redirect (null unless the page is one).  Every step is a
projection of the page scan or an equi-join; counting replaces sorting lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import is_disambiguation, is_stub, links
from ..functions.names import alias_key, alter_name, format_name, is_disambiguation_name, is_special_title


def classify_pages(pages: DataFrame) -> DataFrame:
    """Add kind: special, redirect, disambiguation, stub or entity; titles are trimmed."""
    title = F.trim("title")
    kind = F.when(is_special_title(title), "special").when(F.col("redirect").isNotNull(), "redirect")
    kind = kind.when(is_disambiguation(title, F.col("text")), "disambiguation").when(is_stub(F.col("text")), "stub").otherwise("entity")
    return pages.withColumn("title", title).withColumn("kind", kind)


def page_links(pages: DataFrame) -> DataFrame:
    """One row a link of every page: title, kind, target, anchor, position."""
    exploded = pages.select("title", "kind", F.explode(links(F.col("text"))).alias("link"))
    return exploded.select("title", "kind", "link.target", "link.anchor", "link.position")


def alias_rows(pages: DataFrame) -> DataFrame:
    """Raw alias rows of classified pages: entity, alias, source in redirect, disambig, link, name.

    Stubs count as entities here.  Redirect targets are formatted like link targets.
    """
    found = page_links(pages.filter("kind IN ('entity', 'stub', 'disambiguation')"))
    redirect = pages.filter("kind = 'redirect'").select(format_name(F.col("redirect")).alias("entity"), F.col("title").alias("alias"), F.lit("redirect").alias("source"))
    short = alter_name(F.col("title"))
    disambig = found.filter(F.col("kind") == "disambiguation").filter((short != "") & is_disambiguation_name(short, F.col("target")))
    disambig = disambig.select(F.col("target").alias("entity"), short.alias("alias"), F.lit("disambig").alias("source"))
    anchored = found.filter("kind <> 'disambiguation' AND anchor IS NOT NULL").filter(~F.contains("anchor", F.lit("more...")))
    link = anchored.select(F.col("target").alias("entity"), F.trim("anchor").alias("alias"), F.lit("link").alias("source"))
    name = pages.filter("kind IN ('entity', 'stub')").select(F.col("title").alias("entity"), F.col("title").alias("alias"), F.lit("name").alias("source"))
    return redirect.unionByName(disambig).unionByName(link).unionByName(name)


def redirects(pages: DataFrame) -> DataFrame:
    return pages.filter("kind = 'redirect'").select("title", format_name(F.col("redirect")).alias("target"))


def name_ids(pages: DataFrame) -> DataFrame:
    return pages.filter("kind IN ('entity', 'stub')").select(F.col("title").alias("name"), F.col("id").alias("page_id"))


def expand_redirects(aliases: DataFrame, redirect_pairs: DataFrame) -> DataFrame:
    """Add for each disambig row whose alias others redirect to, a row for each of their titles."""
    to = redirect_pairs.select(F.col("title").alias("__title"), F.col("target").alias("__target"))
    more = aliases.filter("source = 'disambig'").join(to, F.col("alias") == F.col("__target"))
    return aliases.unionByName(more.select("entity", F.col("__title").alias("alias"), "source"))


def alias_dictionary(aliases: DataFrame) -> DataFrame:
    """Counted aliases: alias_lc, entity, source, freq."""
    return aliases.groupBy(alias_key(F.col("alias")).alias("alias_lc"), "entity", "source").agg(F.count(F.lit(1)).alias("freq"))


def grouped_aliases(aliases: DataFrame) -> DataFrame:
    """alias_lc and its raw rows, as an index holds them."""
    rows = F.sort_array(F.collect_list(F.struct("entity", "alias", "source")))
    return aliases.groupBy(alias_key(F.col("alias")).alias("alias_lc")).agg(rows.alias("rows"))


def prior_probabilities(dictionary: DataFrame, strict: bool = False, order: str | None = None) -> DataFrame:
    """alias_lc, entity, source, prior: the entity's share of the alias's frequency.

    Frequencies of several sources add up, and the most frequent one is named
    (ties: the least name).  strict keeps the last row of each entity by ``order``.
    """
    if strict:
        merged = dictionary.groupBy("alias_lc", "entity").agg(F.max_by(F.struct("freq", "source"), F.col(order)).alias("last")).select("alias_lc", "entity", "last.source", "last.freq")
    else:
        by_source = dictionary.groupBy("alias_lc", "entity", "source").agg(F.sum("freq").alias("freq"))
        merged = by_source.groupBy("alias_lc", "entity").agg(F.sum("freq").alias("freq"), F.min_by("source", F.struct(-F.col("freq"), "source")).alias("source"))
    totals = merged.groupBy("alias_lc").agg(F.sum("freq").alias("total"))
    return merged.join(totals, "alias_lc").select("alias_lc", "entity", "source", (F.col("freq") / F.col("total")).alias("prior"))


def link_edges(pages: DataFrame) -> DataFrame:
    """Page-link rows of entity pages: src, dst."""
    return page_links(pages.filter("kind = 'entity'")).select(F.col("title").alias("src"), F.col("target").alias("dst"))


def window_pairs(rows: DataFrame, group: str, name: str, position: str, window: int) -> DataFrame:
    """Pairs a < b of names of the same group at most ``window`` positions apart: group, a, b.

    Positions fall into cells of the window's width; a row meets its own cell and
    the next, so a long group costs its close pairs, not its square.
    """
    cell = F.floor(F.col(position) / max(1, window))
    left = rows.select(F.col(group), F.col(name).alias("__n1"), F.col(position).alias("__p1"), cell.alias("__cell"))
    right = rows.select(F.col(group), F.col(name).alias("__n2"), F.col(position).alias("__p2"), cell.alias("__c2"))
    same = right.withColumn("__cell", F.col("__c2"))
    after = right.withColumn("__cell", F.col("__c2") - 1)  # rows of the next cell meet this one
    met = left.join(same.unionByName(after), [group, "__cell"])
    near = F.abs(F.col("__p1") - F.col("__p2")) <= window
    # Within a cell each pair comes in both orders; across cells just once, so it is turned round.
    inside = F.col("__c2") == F.col("__cell")
    kept = met.filter(near & F.when(inside, F.col("__n1") < F.col("__n2")).otherwise(F.col("__n1") != F.col("__n2")))
    return kept.select(group, F.least("__n1", "__n2").alias("a"), F.greatest("__n1", "__n2").alias("b"))


def cooccurrence_edges(pages: DataFrame, window: int = 1000) -> DataFrame:
    """Co-occurrence rows of entity pages: pairs of links close to each other, and the page with each of its links."""
    found = page_links(pages.filter("kind = 'entity'"))
    pairs = window_pairs(found.select("title", "target", "position"), "title", "target", "position", window)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(found.select(F.col("title").alias("src"), F.col("target").alias("dst")))


def count_edges(edges: DataFrame) -> DataFrame:
    """src, dst, w: how often each edge occurs."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def entity_terms(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """Terms of texts: key, term, tf (see vectors.tokenize)."""
    from .vectors import term_frequencies

    return term_frequencies(docs.select(key, text.alias("__text")), key, "__text")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key, as an index that is updated in place holds it."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
