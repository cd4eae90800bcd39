"""Registered queries of the library, each with SQL that gives the same rows.

The driver's tables stand in for a knowledge base: parts are entities, their names
ambiguous aliases, line items mentions with a gold entity, orders documents; pages
give links, documents terms.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import LinkConfig
from .functions import markup, names, scores, strsim
from .operators import annotate, candidates, coref, evaluate, expansion, graph, kb, linking, models, relatedness, vectors, walks
from .operators.settle import settle
from .sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(column: Column | str, digits: int = DIGITS) -> Column:
    """Rounded, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


# The stand-in knowledge base.


def part_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """alias_lc, entity, source, freq: a part under its name, by line items."""
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("freq"))
    parts = table(spark, sf, "part")
    source = F.when(F.col("p_partkey") % 5 == 0, "redirect").otherwise("link")
    return parts.join(lines, F.col("p_partkey") == F.col("l_partkey")).select(names.alias_key(F.col("p_name")).alias("alias_lc"), F.col("p_partkey").alias("entity"), source.alias("source"), "freq")


SQL_DICTIONARY = """
dictionary AS (
    SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS alias_lc, p_partkey AS entity,
           CASE WHEN p_partkey % 5 = 0 THEN 'redirect' ELSE 'link' END AS source, count(*) AS freq
    FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL
), priors AS (
    SELECT alias_lc, entity, source, freq / sum(freq) OVER (PARTITION BY alias_lc) AS prior FROM dictionary
)"""


def order_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, mention_id, name, gold: the distinct parts of an order; mention_id is the part, so that it is a key."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return lines.join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("mention_id"), F.col("p_name").alias("name"), F.col("l_partkey").alias("gold"))


SQL_MENTIONS = """
mentions AS (
    SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS mention_id, p_name AS name, l_partkey AS gold,
           lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS alias_lc
    FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def part_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"))


def supply_lines(spark: SparkSession, sf: str) -> DataFrame:
    """src (supplier), dst (part, after all suppliers) of every line item."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"))


def supply_edges(spark: SparkSession, sf: str) -> DataFrame:
    """src (supplier), dst (part, after all suppliers), w: line items of both."""
    return kb.count_edges(supply_lines(spark, sf))


SQL_EDGES = "edges AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst, count(*) AS w FROM lineitem GROUP BY ALL)"
SQL_BOTH = SQL_EDGES + ", arcs AS (SELECT * FROM edges UNION ALL SELECT dst, src, w FROM edges)"


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """nation, node: the suppliers of a nation are the seeds of one neighbourhood."""
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("node"))


SQL_SEEDS = "seeds AS (SELECT s_nationkey AS nation, s_suppkey AS node FROM supplier)"


# Priors and candidates.


@query(f"WITH {SQL_DICTIONARY} SELECT alias_lc, entity, source, round(prior, 6) AS prior FROM priors")
def prior_probability(spark, sf):
    return kb.prior_probabilities(part_dictionary(spark, sf)).withColumn("prior", rounded("prior"))


SQL_BEST = "best AS (SELECT alias_lc, entity FROM (SELECT *, row_number() OVER (PARTITION BY alias_lc ORDER BY prior DESC, entity) AS rn FROM priors) WHERE rn = 1)"
SQL_LINKED = f"{SQL_DICTIONARY}, {SQL_MENTIONS}, {SQL_BEST}, linked AS (SELECT m.doc_id, m.mention_id, m.gold, b.entity FROM mentions m JOIN best b USING (alias_lc))"


@query(f"WITH {SQL_LINKED} SELECT doc_id, mention_id, entity FROM linked")
def prior_linker_predictions(spark, sf):
    return linking.link_by_prior(order_mentions(spark, sf).select("doc_id", "mention_id", "name"), kb.prior_probabilities(part_dictionary(spark, sf)))


SQL_DOCS = """
d AS (SELECT doc_id, count(*) AS n_query, count(entity) AS n_found, count(*) FILTER (gold = entity) AS n_correct FROM linked GROUP BY doc_id),
e AS (SELECT *, n_correct / n_query AS recall, CASE WHEN n_found > 0 THEN n_correct / n_found ELSE 0 END AS p FROM d)"""


@query(f"""WITH {SQL_LINKED}, {SQL_DOCS},
s AS (SELECT sum(n_correct)::DOUBLE / sum(n_query)::DOUBLE AS r, sum(n_correct)::DOUBLE / sum(n_found)::DOUBLE AS p, avg(p) AS mp, avg(recall) AS mr FROM e)
SELECT round(r, 6) AS accuracy, round(p, 6) AS micro_precision, round(r, 6) AS micro_recall, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall,
       round(2 * p * r / (p + r), 6) AS micro_f1, round(2 * mp * mr / (mp + mr), 6) AS macro_f1 FROM s""")
def eval_micro_macro(spark, sf):
    gold = order_mentions(spark, sf)
    predicted = linking.link_by_prior(gold.select("doc_id", "mention_id", "name"), kb.prior_probabilities(part_dictionary(spark, sf)))
    out = evaluate.summary(evaluate.per_document(evaluate.join_gold(gold, predicted)))
    return out.select(*[rounded(x).alias(x) for x in out.columns])


@query(f"WITH {SQL_LINKED}, {SQL_DOCS} SELECT doc_id, n_query, n_found, n_correct, round(recall, 6) AS accuracy, round(p, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN p + recall > 0 THEN 2 * p * recall / (p + recall) ELSE 0 END, 6) AS f1 FROM e")
def eval_per_document(spark, sf):
    gold = order_mentions(spark, sf)
    predicted = linking.link_by_prior(gold.select("doc_id", "mention_id", "name"), kb.prior_probabilities(part_dictionary(spark, sf)))
    out = evaluate.per_document(evaluate.join_gold(gold, predicted))
    return out.select("doc_id", "n_query", "n_found", "n_correct", *[rounded(x).alias(x) for x in ("accuracy", "precision", "recall", "f1")])


@query(f"WITH {SQL_LINKED}, n AS (SELECT CASE WHEN gold % 7 = 0 THEN 'NIL' ELSE gold::VARCHAR END AS gold, entity FROM linked) SELECT gold, count(*) AS n FROM (SELECT nullif(gold, 'NIL') AS gold FROM n) WHERE gold IS NOT NULL GROUP BY gold")
def gold_nil_normalisation(spark, sf):
    rows = order_mentions(spark, sf).withColumn("gold", F.when(F.col("gold") % 7 == 0, "NIL").otherwise(F.col("gold").cast("string")))
    return evaluate.normalize_nil(rows, "gold").groupBy("gold").agg(F.count(F.lit(1)).alias("n"))


def part_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of every distinct name as a document of its own, with the price's share of the dearest as context."""
    prices = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), (F.col("p_retailprice") / 10_000).alias("context"))
    mentions = part_names(spark, sf).groupBy("name").agg(F.min("p_partkey").alias("doc_id")).select("doc_id", F.col("doc_id").alias("mention_id"), "name")
    return candidates.lookup(mentions, kb.prior_probabilities(part_dictionary(spark, sf))).join(prices, "entity")


SQL_CANDIDATES = f"""{SQL_DICTIONARY},
named AS (SELECT p_name AS name, min(p_partkey) AS doc_id, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS alias_lc FROM part GROUP BY ALL),
cand AS (SELECT n.doc_id, n.doc_id AS mention_id, n.name, p.entity, p.source, p.prior, p_retailprice / 10000 AS context
         FROM named n JOIN priors p USING (alias_lc) JOIN part ON p_partkey = p.entity),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY context DESC, entity) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY prior DESC, entity) AS p FROM cand),
top AS (SELECT * FROM ranked WHERE (c <= 3 OR p <= 3) AND prior >= 2e-5)"""


@query(f"WITH {SQL_CANDIDATES} SELECT doc_id, mention_id, entity, source, round(prior, 6) AS prior FROM top")
def candidates_top3_union(spark, sf):
    return candidates.top_union(part_candidates(spark, sf)).select("doc_id", "mention_id", "entity", "source", rounded("prior").alias("prior"))


@query(f"WITH {SQL_CANDIDATES} SELECT doc_id, entity, source, round(prior, 6) AS prior FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prior DESC, entity) AS r FROM cand WHERE prior > CASE WHEN source = 'link' THEN 0.005 ELSE 0.001 END) WHERE r <= 20")
def candidates_top20_threshold(spark, sf):
    found = candidates.above_source_threshold(part_candidates(spark, sf))
    return candidates.top_by(found, "prior", 20).select("doc_id", "entity", "source", rounded("prior").alias("prior"))


@query(f"WITH {SQL_CANDIDATES}, two AS (SELECT doc_id // 2 AS doc_id, mention_id // 2 AS mention_id, entity, prior FROM cand) SELECT doc_id, mention_id, entity % 10 AS entity, round(sum(prior), 6) AS prior FROM two GROUP BY ALL")
def multi_name_merge(spark, sf):
    rows = part_candidates(spark, sf).select(F.floor(F.col("doc_id") / 2).alias("doc_id"), F.floor(F.col("mention_id") / 2).alias("mention_id"), (F.col("entity") % 10).alias("entity"), "prior")
    return candidates.merge_names(rows).withColumn("prior", rounded("prior"))


@query(f"""WITH {SQL_CANDIDATES}, a AS (SELECT doc_id, entity FROM ranked WHERE c = 1), b AS (SELECT doc_id, entity FROM ranked WHERE p = 1)
SELECT a.doc_id, a.doc_id AS mention_id, a.entity FROM a JOIN b USING (doc_id, entity)""")
def unambiguous_agreement(spark, sf):
    return candidates.agreeing(part_candidates(spark, sf))


@query(f"""WITH {SQL_CANDIDATES}, a AS (SELECT doc_id, entity FROM ranked WHERE c = 1), b AS (SELECT doc_id, entity FROM ranked WHERE p = 1), s AS (SELECT a.doc_id, a.entity FROM a JOIN b USING (doc_id, entity))
SELECT t.doc_id, t.entity FROM top t LEFT JOIN s USING (doc_id) WHERE s.entity IS NULL OR s.entity = t.entity""")
def keep_agreed_candidates(spark, sf):
    found = part_candidates(spark, sf)
    return candidates.keep_agreed(candidates.top_union(found), candidates.agreeing(found)).select("doc_id", "entity")


@query(f"WITH {SQL_LINKED}, c AS (SELECT m.doc_id, m.mention_id, count(*) AS n_candidates FROM mentions m JOIN priors USING (alias_lc) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_candidates DESC, mention_id) AS place FROM c")
def ambiguity_order(spark, sf):
    mentions = order_mentions(spark, sf).select("doc_id", "mention_id", "name")
    sizes = kb.prior_probabilities(part_dictionary(spark, sf)).groupBy("alias_lc").agg(F.count(F.lit(1)).alias("n_candidates"))
    counts = mentions.withColumn("alias_lc", names.alias_key(F.col("name"))).join(sizes, "alias_lc").select("doc_id", "mention_id", "n_candidates")
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n_candidates"), "mention_id")).cast("long"))


@query(f"WITH {SQL_CANDIDATES}, k AS (SELECT entity FROM cand WHERE entity % 3 <> 0), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM top) SELECT doc_id, entity FROM n WHERE n <= 1 OR entity IN (SELECT entity FROM k)")
def candidate_cleanup(spark, sf):
    found = part_candidates(spark, sf)
    known = found.filter("entity % 3 <> 0").select("entity")
    return candidates.clean(candidates.top_union(found), known).select("doc_id", "entity")


@query(f"WITH {SQL_CANDIDATES}, f AS (SELECT doc_id, entity, round(prior, 6) AS prior FROM cand WHERE entity % 2 = 0), s AS (SELECT doc_id, entity, round(prior * 2, 6) AS prior FROM cand WHERE entity % 3 = 0) SELECT * FROM s UNION ALL SELECT * FROM f WHERE entity % 3 <> 0")
def candidate_union_prefer(spark, sf):
    found = part_candidates(spark, sf).select("doc_id", "mention_id", "entity", "prior")
    out = candidates.prefer(found.filter("entity % 2 = 0"), found.filter("entity % 3 = 0").withColumn("prior", F.col("prior") * 2))
    return out.select("doc_id", "entity", rounded("prior").alias("prior"))


@query(f"WITH {SQL_DICTIONARY}, {SQL_MENTIONS} SELECT DISTINCT name FROM mentions WHERE alias_lc IN (SELECT alias_lc FROM dictionary)")
def alias_membership(spark, sf):
    keys = part_dictionary(spark, sf).select("alias_lc")
    return order_mentions(spark, sf).select("name").distinct().withColumn("alias_lc", names.alias_key(F.col("name"))).join(keys, "alias_lc", "left_semi").select("name")


# Knowledge-base building.


@query("""WITH a AS (SELECT n_name AS entity, r_name AS alias, CASE WHEN n_nationkey % 2 = 0 THEN 'disambig' ELSE 'link' END AS source FROM nation JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT upper(substr(r_name, 1, 3)) || c AS title, r_name AS target FROM region, (VALUES ('.'), ('!')) v(c))
SELECT entity, alias, source, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT entity, title, 'disambig' FROM a JOIN r ON alias = target WHERE source = 'disambig') GROUP BY ALL""")
def redirect_expansion(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    source = F.when(F.col("n_nationkey") % 2 == 0, "disambig").otherwise("link")
    aliases = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.col("r_name").alias("alias"), source.alias("source"))
    pairs = region.select("r_name", F.explode(F.array(F.lit("."), F.lit("!"))).alias("c")).select(F.concat(F.upper(F.substring("r_name", 1, 3)), "c").alias("title"), F.col("r_name").alias("target"))
    return kb.expand_redirects(aliases, pairs).groupBy("entity", "alias", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(trim(p_brand)) AS alias_lc, count(*) AS n_rows, min(p_partkey) AS first_entity FROM part GROUP BY ALL")
def grouped_alias_rows(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("alias"), F.lit("link").alias("source"))
    out = kb.grouped_aliases(rows)
    return out.select("alias_lc", F.size("rows").cast("long").alias("n_rows"), F.element_at("rows", 1)["entity"].alias("first_entity"))


_SPECIAL_SQL = " OR ".join(f"starts_with(lower(url), '{x}')" for x in names.SPECIAL_PREFIXES)


@query(f"SELECT page_id, coalesce(url, '') = '' OR {_SPECIAL_SQL} OR contains(url, '#') AS special FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'List of ' || url WHEN page_id % 4 = 1 THEN 'FILE:' || url WHEN page_id % 4 = 2 THEN url || '#top' ELSE url END AS url FROM pages)")
def special_title_filter(spark, sf):
    k, url = F.col("page_id") % 4, F.col("url")
    title = F.when(k == 0, F.concat(F.lit("List of "), url)).when(k == 1, F.concat(F.lit("FILE:"), url)).when(k == 2, F.concat(url, F.lit("#top"))).otherwise(url)
    return table(spark, sf, "pages").select("page_id", names.is_special_title(title).alias("special"))


@query("SELECT a.n_name AS short, b.n_name AS long, len(list_filter(string_split(lower(a.n_name), ''), lambda c: NOT contains(lower(b.n_name), c))) = 0 AS inside FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def disambig_char_test(spark, sf):
    nation = table(spark, sf, "nation")
    a, b = nation.select("n_regionkey", F.col("n_name").alias("short")), nation.select("n_regionkey", F.col("n_name").alias("long"))
    return a.join(b, "n_regionkey").select("short", "long", names.is_disambiguation_name(F.col("short"), F.col("long")).alias("inside"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"[^>]*>', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL""")
def page_links(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.explode(markup.html_links(F.col("html"))).alias("l"))
    return rows.groupBy("page_id", F.col("l.href").alias("href")).agg(F.count(F.lit(1)).alias("n"))


def _wiki_text() -> Column:
    """Markup made of a part: two links, one special, one with three parts."""
    name = F.col("p_name")
    return F.concat(F.lit("Intro [["), name, F.lit("|the "), name, F.lit("]] and [[file:x.png]] then [["), F.col("p_type"), F.lit("]] or [[ "), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.lit("|a|b]] end"))


@query("""WITH t AS (SELECT p_partkey, 6 AS p1, length('Intro [[') + length(p_name) + length('|the ') + length(p_name) + length(']] and [[file:x.png]] then ') AS p2, p_name, p_type, p_brand FROM part),
l AS (SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS target, 'The ' || p_name AS anchor, p1 AS position FROM t
UNION ALL SELECT p_partkey, upper(p_type[1]) || p_type[2:], upper(p_type[1]) || p_type[2:], p2 FROM t
UNION ALL SELECT p_partkey, replace(p_brand, '#', ' '), replace(p_brand, '#', ' '), p2 + length(p_type) + length('[[]] or ') FROM t)
SELECT p_partkey, target, anchor, position::BIGINT AS position FROM l""")
def link_positions(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.explode(markup.links(_wiki_text())).alias("l"))
    return rows.select("p_partkey", "l.target", "l.anchor", "l.position")


@query(f"WITH {SQL_EDGES} SELECT * FROM edges")
def edge_counts(spark, sf):
    return supply_edges(spark, sf)


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"[^>]*>', 1)) AS dst FROM pages) SELECT url AS src, dst, count(*) AS w FROM l JOIN pages USING (page_id) GROUP BY ALL""")
def page_edge_counts(spark, sf):
    rows = table(spark, sf, "pages").select(F.col("url").alias("src"), F.explode(markup.html_links(F.col("html"))).alias("l"))
    return kb.count_edges(rows.select("src", F.col("l.href").alias("dst")))


@query("""SELECT x.l_orderkey AS doc, x.l_partkey AS a, y.l_partkey AS b, count(*) AS n FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey AND abs(x.l_linenumber - y.l_linenumber) <= 2 GROUP BY ALL""")
def cooccurrence_window(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_partkey", "l_linenumber")
    return kb.window_pairs(rows, "doc", "l_partkey", "l_linenumber", 2).groupBy("doc", "a", "b").agg(F.count(F.lit(1)).alias("n"))


# Names and strings.


@query(r"SELECT c_custkey, upper(x[1]) || x[2:] AS name FROM (SELECT c_custkey, trim(replace(regexp_replace('  ' || lower(c_name) || '_ of  the_' || lower(c_mktsegment), '\s+', ' ', 'g'), '_', ' ')) AS x FROM customer)")
def format_name(spark, sf):
    raw = F.concat(F.lit("  "), F.lower("c_name"), F.lit("_ of  the_"), F.lower("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", names.format_name(raw).alias("name"))


_TITLE_SQL = "CASE WHEN p_partkey % 4 = 0 THEN p_name || ' (' || p_type || ')' WHEN p_partkey % 4 = 1 THEN p_name || ', ' || p_brand WHEN p_partkey % 4 = 2 THEN p_name || ' - ' || p_brand ELSE p_name END"


def _title() -> Column:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    x = F.when(k == 0, F.concat(name, F.lit(" ("), F.col("p_type"), F.lit(")"))).when(k == 1, F.concat(name, F.lit(", "), F.col("p_brand")))
    return x.when(k == 2, F.concat(name, F.lit(" - "), F.col("p_brand"))).otherwise(name)


@query(f"SELECT p_partkey, trim(CASE WHEN contains(t, '(') THEN split_part(t, '(', 1) WHEN contains(t, ',') THEN split_part(t, ',', 1) WHEN contains(t, ' - ') THEN split_part(t, ' - ', 1) ELSE t END) AS name FROM (SELECT p_partkey, {_TITLE_SQL} AS t FROM part)")
def alter_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.alter_name(_title()).alias("name"))


@query("SELECT c_custkey, c_name AS name FROM customer")
def normalize_name(spark, sf):
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    dressed = F.when(k == 0, F.concat(F.lit("Dr. "), name, F.lit(" Jr."))).when(k == 1, F.concat(name, F.lit(" Corp."))).when(k == 2, F.concat(F.lit("Capt "), name, F.lit(" Inc"))).otherwise(F.concat(name, F.lit(".")))
    return table(spark, sf, "customer").select("c_custkey", names.normalize_name(dressed).alias("name"))


@query(r"SELECT s_suppkey, regexp_replace('J.R.' || s_name, '\.([^ ])', '. \1', 'g') AS person, replace('U.S. ' || s_name, '.', '') AS location, regexp_replace(upper(s_name || '!'), '[^\w ]', '', 'g') || '#ORG' AS id FROM supplier")
def person_and_location_names(spark, sf):
    name = F.col("s_name")
    return table(spark, sf, "supplier").select(
        "s_suppkey",
        names.normalize_person_name(F.concat(F.lit("J.R."), name)).alias("person"),
        names.normalize_location_name(F.concat(F.lit("U.S. "), name)).alias("location"),
        names.entity_id(F.concat(name, F.lit("!")), F.lit("ORG")).alias("id"),
    )


PAIRS_SQL = "pairs AS (SELECT DISTINCT a.p_name AS x, b.p_name AS y FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON left(a.p_name, 1) = left(b.p_name, 1) AND a.p_name < b.p_name)"


def name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct part names with the same first letter, x before y."""
    one = table(spark, sf, "part").select("p_name").distinct()
    a, b = one.select(F.col("p_name").alias("x"), F.substring("p_name", 1, 1).alias("k")), one.select(F.col("p_name").alias("y"), F.substring("p_name", 1, 1).alias("k"))
    return a.join(b, "k").filter("x < y").select("x", "y")


@query(f"WITH {PAIRS_SQL} SELECT x, y, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS similarity FROM pairs")
def edit_similarity(spark, sf, pairs=name_pairs):
    return pairs(spark, sf).withColumn("similarity", rounded(strsim.edit_similarity(F.col("x"), F.col("y"))))


@query(f"WITH {PAIRS_SQL} SELECT x, y, round(jaro_winkler_similarity(x, y), 6) AS similarity FROM pairs")
def jaro_winkler(spark, sf, pairs=name_pairs):
    return pairs(spark, sf).withColumn("similarity", rounded(strsim.jaro_winkler("x", "y")))


_GRAM_SQL = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i::INT, 2)))"


@query(f"WITH {PAIRS_SQL}, g AS (SELECT x, y, {_GRAM_SQL.format('x')} AS a, {_GRAM_SQL.format('y')} AS b FROM pairs) SELECT x, y, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS similarity FROM g")
def dice_bigrams(spark, sf, pairs=name_pairs):
    return pairs(spark, sf).withColumn("similarity", rounded(strsim.dice_bigrams(F.col("x"), F.col("y"))))


@query(f"""WITH {PAIRS_SQL}, s AS (SELECT x, y, unnest(range(1, length(x) + 1)) AS i FROM pairs), t AS (SELECT x, y, i, unnest(range(1, (length(x) - i + 2)::BIGINT)) AS n FROM s)
SELECT x, y, coalesce(max(n) FILTER (contains(y, substr(x, i::INT, n::INT))), 0) AS length FROM t GROUP BY x, y""")
def lcs_length(spark, sf, pairs=name_pairs):
    return pairs(spark, sf).withColumn("length", strsim.common_substring("x", "y"))


def _edit_sql(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) = 0 THEN length({b}) WHEN length({b}) = 0 THEN length({a}) ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END)"


@query(f"""WITH t AS (SELECT DISTINCT p_type AS name, upper(left(split_part(p_type, ' ', 1), 1) || left(split_part(p_type, ' ', 2), 1)) AS short FROM part),
k AS (SELECT *, array_to_string(list_sort(string_split(lower(short), '')), '') AS s,
 array_to_string(list_sort(string_split(lower(regexp_replace(name, '[^A-Z]', '', 'g')), '')), '') AS c,
 array_to_string(list_sort(string_split(lower(array_to_string(list_transform(string_split(name, ' '), lambda w: CASE WHEN regexp_replace(w, '[^A-Z]', '', 'g') = '' THEN left(w, 1) ELSE regexp_replace(w, '[^A-Z]', '', 'g') END), '')), '')), '') AS f FROM t)
SELECT name, short, round(greatest({_edit_sql('s', 'c')} * greatest(length(s), length(c)) / (length(s) + abs(length(s) - length(c))), {_edit_sql('s', 'f')} * greatest(length(s), length(f)) / (length(s) + abs(length(s) - length(f)))), 6) AS similarity FROM k""")
def abbrev_similarity(spark, sf):
    kind = F.col("name")
    rows = table(spark, sf, "part").select(F.col("p_type").alias("name")).distinct()
    rows = rows.withColumn("short", F.upper(F.concat(F.substring(F.split_part(kind, F.lit(" "), F.lit(1)), 1, 1), F.substring(F.split_part(kind, F.lit(" "), F.lit(2)), 1, 1))))
    return rows.withColumn("similarity", rounded(strsim.abbreviation_similarity(F.col("short"), kind)))


@query()
def ngram_similarity(spark, sf, pairs=name_pairs):
    return pairs(spark, sf).withColumn("similarity", rounded(strsim.ngram_similarity("x", "y")))


@query()
def monge_elkan(spark, sf, pairs=name_pairs):
    return pairs(spark, sf).withColumn("similarity", rounded(strsim.monge_elkan("x", "y")))


@query()
def soft_tfidf(spark, sf, pairs=name_pairs):
    return pairs(spark, sf).withColumn("similarity", rounded(strsim.soft_tfidf("x", "y")))


@query(f"WITH {PAIRS_SQL}, t AS (SELECT DISTINCT split_part(x, ' ', 1) AS short, y AS long FROM pairs) SELECT short, long, length(long) > length(short) AND NOT contains(short, ' ') AND len(list_filter(string_split(long, ' '), lambda w: jaro_winkler_similarity(short, w) > 0.9)) > 0 AS matches FROM t")
def match_longer_name(spark, sf, pairs=name_pairs):
    rows = pairs(spark, sf).select(F.split_part("x", F.lit(" "), F.lit(1)).alias("short"), F.col("y").alias("long")).distinct()
    return rows.withColumn("matches", strsim.matches_longer_name(F.col("short"), F.col("long")))


@query(f"WITH {PAIRS_SQL} SELECT y AS long, last AS short, regexp_matches(lower(y), '\\b' || last || '$') AS ends FROM (SELECT y, lower(right(x, 4)) AS last FROM pairs WHERE regexp_matches(x, '[a-z]{{4}}$')) GROUP BY ALL")
def ends_with_name(spark, sf, pairs=name_pairs):
    rows = pairs(spark, sf).filter(F.col("x").rlike("[a-z]{4}$")).select(F.col("y").alias("long"), F.lower(F.right("x", F.lit(4))).alias("short")).distinct()
    return rows.withColumn("ends", names.ends_with_name(F.col("long"), F.col("short")))


# The same nine measures on every pair of names that share two letters in a row.

SHARED_PAIRS_SQL = """grams AS (SELECT DISTINCT p_name, substr(p_name, i::INT, 2) AS g FROM (SELECT p_name, unnest(range(1, length(p_name))) AS i FROM (SELECT DISTINCT p_name FROM part))),
pairs AS (SELECT DISTINCT a.p_name AS x, b.p_name AS y FROM grams a JOIN grams b ON a.g = b.g AND a.p_name < b.p_name)"""


def shared_gram_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct part names with a 2-gram in common, x before y."""
    one = table(spark, sf, "part").filter(F.length("p_name") > 1).select("p_name").distinct()
    at = F.sequence(F.lit(1), F.length("p_name") - 1)
    grams = one.select("p_name", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("p_name"), i, F.lit(2))))).alias("g"))
    return grams.select("g", F.col("p_name").alias("x")).join(grams.select("g", F.col("p_name").alias("y")), "g").filter("x < y").select("x", "y").distinct()


def _again(suffix: str, of: tuple[Query, ...], sql: tuple[str, str], **change) -> None:
    """Register queries a second time, on other rows and with SQL on those."""
    for one in of:
        QUERIES[one.__name__ + suffix] = partial(one, **change)
        if one.__name__ in ORACLES:
            ORACLES[one.__name__ + suffix] = ORACLES[one.__name__].replace(*sql)


_again("_shared_grams", (edit_similarity, jaro_winkler, dice_bigrams, lcs_length, ngram_similarity, monge_elkan, soft_tfidf, match_longer_name, ends_with_name), (PAIRS_SQL, SHARED_PAIRS_SQL), pairs=shared_gram_pairs)


@query("SELECT name, kind, kind <> 'LOC' AND regexp_matches(name, '^[A-Za-z0-9][^ ]{1,9}$') AND length(regexp_replace(name, '[^A-Z]', '', 'g')) >= 2 AS abbreviation FROM (SELECT DISTINCT upper(left(p_name, 1 + p_partkey % 12)) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'LOC' ELSE 'ORG' END AS kind FROM part)")
def abbreviation_test(spark, sf):
    kind = F.when(F.col("p_partkey") % 3 == 0, "LOC").otherwise("ORG")
    rows = table(spark, sf, "part").select(F.upper(F.substr("p_name", F.lit(1), (1 + F.col("p_partkey") % 12).cast("int"))).alias("name"), kind.alias("kind")).distinct()
    return rows.withColumn("abbreviation", names.is_abbreviation(F.col("name"), F.col("kind")))


@query()
def fuzzy_rank_fusion(spark, sf):
    some = part_names(spark, sf).groupBy("name").agg(F.min("p_partkey")).select(F.concat(F.col("name"), F.lit("s")).alias("name"))
    out = candidates.fuzzy_aliases(some, part_dictionary(spark, sf))
    return out.select("name", "alias_lc", *[rounded(x).alias(x) for x in ("dice", "ngram", "jaro_winkler")])


@query()
def candidates_by_name(spark, sf):
    rows = part_candidates(spark, sf)
    titles = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.concat_ws(" ", "p_type", "p_name").alias("title"))
    return candidates.select_by_name(rows.join(titles, "entity").select("doc_id", "mention_id", "name", F.col("title").alias("entity"), "prior")).select("doc_id", "entity", rounded("prior").alias("prior"))


# Graphs.


@query(f"WITH {SQL_EDGES}, n AS (SELECT dst AS node, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM n GROUP BY node")
def degrees(spark, sf):
    return graph.degrees(supply_edges(spark, sf))


SQL_NATIONS = "e AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS w FROM (SELECT c_nationkey, c_custkey % 100 AS k FROM customer) JOIN supplier ON s_suppkey = k GROUP BY ALL)"


def nation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' nations to suppliers' nations, with loops and pairs in both orders."""
    buyers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 100).alias("k"))
    sellers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("dst"))
    return kb.count_edges(buyers.join(sellers, "k").select("src", "dst"))


@query(f"WITH {SQL_NATIONS}, o AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(w) AS w FROM e GROUP BY ALL) SELECT a AS src, b AS dst, w FROM o UNION ALL SELECT b, a, w FROM o WHERE a <> b")
def undirected_max_merge(spark, sf, edges=nation_edges):
    return graph.undirected_max(edges(spark, sf))


@query(f"WITH {SQL_NATIONS}, o AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(w)::BIGINT AS w FROM e GROUP BY ALL) SELECT a AS src, b AS dst, w FROM o UNION ALL SELECT b, a, w FROM o WHERE a <> b")
def undirected_sum_merge(spark, sf, edges=nation_edges):
    return graph.undirected(edges(spark, sf))


@query(f"WITH {SQL_NATIONS} SELECT * FROM e WHERE src <> dst AND w <> 0")
def self_loop_filter(spark, sf, edges=nation_edges):
    return graph.without_zero(graph.without_loops(edges(spark, sf)))


@query(f"WITH {SQL_NATIONS} SELECT src AS node, list_sort(list(DISTINCT dst))::VARCHAR AS neighbours FROM e GROUP BY src")
def adjacency_sets(spark, sf, edges=nation_edges):
    out = graph.adjacency_sets(edges(spark, sf))
    return out.select("node", F.concat(F.lit("["), F.array_join("neighbours", ", "), F.lit("]")).alias("neighbours"))


# The same four on the trade of all customers and suppliers.

SQL_TRADE = "e AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' nations to the nations of the suppliers they bought from, by line items; rows combine before each join."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("w"))
    for other, key, left in (("orders", "o_orderkey", "l_orderkey"), ("customer", "c_custkey", "o_custkey")):
        kept = {"orders": "o_custkey", "customer": "c_nationkey"}[other]
        met = rows.join(table(spark, sf, other).select(key, kept), F.col(left) == F.col(key))
        rows = met.groupBy(kept, "l_suppkey").agg(F.sum("w").alias("w"))
    met = rows.join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return met.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("w").alias("w"))


_again("_trade", (undirected_max_merge, undirected_sum_merge, self_loop_filter, adjacency_sets), (SQL_NATIONS, SQL_TRADE), edges=trade_edges)


@query(f"WITH {SQL_EDGES} SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS num_nodes, (SELECT count(*) FROM edges) AS num_arcs")
def graph_size(spark, sf):
    return graph.graph_size(supply_edges(spark, sf))


@query(f"WITH {SQL_EDGES}, {SQL_SEEDS} SELECT src AS node, dst AS neighbour, w FROM edges WHERE src IN (SELECT node FROM seeds)")
def weighted_neighbours(spark, sf):
    return graph.neighbours(supply_edges(spark, sf), suppliers(spark, sf))


LEAST_DEGREE = 40
_HOP_SQL = f"""{SQL_BOTH}, {SQL_SEEDS}, deg AS (SELECT dst AS node, count(*) AS n FROM arcs GROUP BY dst),
step AS (SELECT DISTINCT nation, s.node, a.src AS next FROM seeds s JOIN arcs a ON a.dst = s.node),
kept AS (SELECT s.* FROM step s JOIN deg ON deg.node = s.next WHERE n >= {LEAST_DEGREE}),
found AS (SELECT nation, next FROM kept UNION SELECT nation, next FROM step WHERE (nation, node) NOT IN (SELECT (nation, node) FROM kept)),
reached AS (SELECT nation, node FROM seeds UNION SELECT nation, next FROM found)"""


def supply_arcs(spark: SparkSession, sf: str) -> DataFrame:
    edges = supply_edges(spark, sf)
    return edges.unionByName(graph.reverse(edges))


@query(f"WITH {_HOP_SQL} SELECT nation, node FROM reached")
def expand_one_hop(spark, sf):
    return graph.expand(supply_arcs(spark, sf), suppliers(spark, sf), 1, LEAST_DEGREE, keys=["nation"])


@query(f"WITH {_HOP_SQL.replace(f'n >= {LEAST_DEGREE}', 'n >= 1000000000')} SELECT nation, node FROM reached")
def expand_fallback(spark, sf):
    return graph.expand(supply_arcs(spark, sf), suppliers(spark, sf), 1, 1_000_000_000, keys=["nation"])


@query(f"""WITH {SQL_EDGES}, {SQL_SEEDS}, n AS (SELECT nation, src AS next FROM seeds JOIN edges ON dst = node UNION SELECT nation, dst FROM seeds JOIN edges ON src = node) SELECT DISTINCT nation, next AS node FROM n UNION SELECT nation, node FROM seeds""")
def expand_directed(spark, sf):
    return graph.expand(supply_edges(spark, sf), suppliers(spark, sf), 1, 0, directed=True, keys=["nation"])


@query(f"""WITH {_HOP_SQL} SELECT s.nation, src, dst, w FROM arcs JOIN seeds s ON src = s.node JOIN reached r ON r.nation = s.nation AND r.node = dst WHERE src <> dst
UNION SELECT s.nation, src, dst, w FROM arcs JOIN seeds s ON dst = s.node JOIN reached r ON r.nation = s.nation AND r.node = src WHERE src <> dst""")
def subgraph_edges(spark, sf):
    arcs, seeds = supply_arcs(spark, sf), suppliers(spark, sf)
    return graph.subgraph(arcs, seeds, graph.expand(arcs, seeds, 1, LEAST_DEGREE, keys=["nation"]), keys=["nation"])


@query("SELECT p_partkey AS entity FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def graph_containment(spark, sf):
    known = graph.nodes(supply_edges(spark, sf)).select((F.col("node") - 1_000_000).alias("node"))
    return graph.connected_entities(table(spark, sf, "part").select(F.col("p_partkey").alias("entity")), known)


# Relatedness.

SQL_PAIRS = "p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)"


def _related_sql(near: str, size: str, common: str, total: str) -> str:
    return f"""WITH {SQL_EDGES}, near AS ({near}), {SQL_PAIRS},
s AS (SELECT node, {size}::DOUBLE AS s FROM near GROUP BY node), t AS (SELECT {total}::DOUBLE AS n),
c AS (SELECT p.a, p.b, {common}::DOUBLE AS c FROM p JOIN near x ON x.node = p.a JOIN near y ON y.node = p.b AND y.neighbour = x.neighbour GROUP BY p.a, p.b),
d AS (SELECT p.a, p.b, c, round((ln(greatest(s1.s, s2.s)) - ln(c)) / (ln(n) - ln(least(s1.s, s2.s))), 12) AS d
      FROM p LEFT JOIN c USING (a, b) LEFT JOIN s s1 ON s1.node = p.a LEFT JOIN s s2 ON s2.node = p.b, t)
SELECT a, b, round(CASE WHEN c IS NULL OR d IS NULL OR d < 0 OR d >= 1 THEN 0 ELSE 1 - d END, 6) AS relatedness FROM d"""


def _related(spark: SparkSession, sf: str, mode: str, weighted: bool, total: int) -> DataFrame:
    lines = supply_lines(spark, sf).withColumn("w", F.lit(1))
    some = suppliers(spark, sf).withColumnRenamed("nation", "group")
    out = relatedness.score_groups(some, lines, total, mode, weighted)
    return out.withColumn("relatedness", rounded("relatedness"))


_OUT = "SELECT src AS node, dst AS neighbour, w FROM edges"
_BOTH = "SELECT node, neighbour, sum(w) AS w FROM (SELECT src AS node, dst AS neighbour, w FROM edges UNION ALL SELECT dst, src, w FROM edges) GROUP BY ALL"


@query(_related_sql(_OUT, "count(*)", "count(*)", "1000000"))
def relatedness_unweighted(spark, sf):
    return _related(spark, sf, "out", False, 1_000_000)


@query(_related_sql(_OUT, "sum(w)", "sum(least(x.w, y.w))", "1000000"))
def relatedness_weighted(spark, sf):
    return _related(spark, sf, "out", True, 1_000_000)


@query(_related_sql(_BOTH, "count(*)", "count(*)", "1000000"))
def relatedness_union(spark, sf):
    return _related(spark, sf, "both", False, 1_000_000)


@query(_related_sql(_BOTH, "sum(w)", "sum(least(x.w, y.w))", "1000000"))
def relatedness_union_weighted(spark, sf):
    return _related(spark, sf, "both", True, 1_000_000)


# Terms and vectors.

_STOP_SQL = ", ".join(f"'{x}'" for x in names.STOP_WORDS)
SQL_TERMS = f"""tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE length(term) >= 2 AND term NOT IN ({_STOP_SQL}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
vec AS (SELECT doc_id, term, sqrt(tf) * (1 + ln(n / (df + 1))) AS weight FROM tf JOIN df USING (term), n)"""


def doc_terms(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.term_frequencies(table(spark, sf, "documents"), "doc_id", "text")


def doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    frequencies = settle(doc_terms(spark, sf))
    return vectors.tfidf_vectors(frequencies, "doc_id", vectors.document_frequencies(frequencies), table(spark, sf, "documents").count())


@query(f"WITH {SQL_TERMS} SELECT * FROM tf")
def term_frequency(spark, sf):
    return doc_terms(spark, sf)


@query(f"WITH {SQL_TERMS} SELECT * FROM df")
def document_frequency(spark, sf):
    return vectors.document_frequencies(doc_terms(spark, sf))


@query(f"WITH {SQL_TERMS} SELECT doc_id, term, round(weight, 6) AS weight FROM vec")
def tfidf_vector(spark, sf):
    return doc_vectors(spark, sf).withColumn("weight", rounded("weight"))


@query(f"WITH {SQL_TERMS} SELECT doc_id, term, round(weight, 6) AS weight FROM vec WHERE term IN (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) FROM benchmark)")
def tfidf_projected(spark, sf):
    onto = vectors.terms(table(spark, sf, "benchmark"), "item_id", "text")
    return vectors.projected(doc_vectors(spark, sf), onto, ["term"]).withColumn("weight", rounded("weight"))


@query(f"""WITH {SQL_TERMS}, norm AS (SELECT doc_id, sqrt(sum(weight * weight)) AS n FROM vec GROUP BY doc_id),
p AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)),
d AS (SELECT p.a, p.b, sum(x.weight * y.weight) AS dot FROM p JOIN vec x ON x.doc_id = p.a JOIN vec y ON y.doc_id = p.b AND y.term = x.term GROUP BY ALL)
SELECT p.a, p.b, round(coalesce(dot / (m.n * o.n), 0), 6) AS cosine FROM p LEFT JOIN d USING (a, b) LEFT JOIN norm m ON m.doc_id = p.a LEFT JOIN norm o ON o.doc_id = p.b""")
def cosine_sparse(spark, sf):
    vec, ids = settle(doc_vectors(spark, sf)), table(spark, sf, "documents").select("doc_id")
    pairs = ids.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).join(ids.select(F.col("doc_id").alias("b")), "b", "left_semi")
    out = vectors.cosine_pairs(pairs, vec.withColumnRenamed("doc_id", "a"), vec.withColumnRenamed("doc_id", "b"), "a", "b")
    return out.withColumn("cosine", rounded("cosine"))


def vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    right = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.select("vec_id", "embedding").join(right, "vec_id")


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_dense(spark, sf):
    return vector_pairs(spark, sf).select("vec_id", rounded(scores.cosine_dense(F.col("embedding"), F.col("other"))).alias("cosine"))


_KL = "CASE WHEN p = 0 THEN 0 WHEN q <= 1e-6 THEN p * 10 ELSE p * log2(p / q) END"


@query(f"""WITH l AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings), m AS (SELECT vec_id, i, CASE WHEN abs(v) < 0.02 THEN 0 ELSE abs(v) END AS v FROM l),
s AS (SELECT vec_id, i, v / sum(v) OVER (PARTITION BY vec_id) AS p FROM m), j AS (SELECT a.vec_id, a.p, b.p AS q FROM s a JOIN s b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)
SELECT vec_id, round(sum({_KL}), 6) AS divergence FROM j GROUP BY vec_id""")
def kl_divergence(spark, sf):
    def dist(x: str) -> Column:
        positive = F.transform(x, lambda v: F.when(F.abs(v.cast("double")) < 0.02, 0.0).otherwise(F.abs(v.cast("double"))))
        total = F.aggregate(positive, F.lit(0.0), lambda a, v: a + v)
        return F.transform(positive, lambda v: v / total)

    rows = vector_pairs(spark, sf).select("vec_id", dist("embedding").alias("p"), dist("other").alias("q"))
    return rows.select("vec_id", rounded(scores.divergence_dense(F.col("p"), F.col("q"))).alias("divergence"))


@query(f"""WITH {SQL_TERMS}, q AS (SELECT DISTINCT item_id AS query, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark),
h AS (SELECT query, doc_id, round(sum(weight), 6) AS score, sum(weight) AS s FROM q JOIN vec USING (term) WHERE length(term) >= 2 AND term NOT IN ({_STOP_SQL}) GROUP BY ALL)
SELECT query, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS r FROM h) WHERE r <= 5""")
def full_text_search(spark, sf):
    frequencies = settle(doc_terms(spark, sf))
    wanted = vectors.terms(table(spark, sf, "benchmark").withColumnRenamed("item_id", "query"), "query", "text")
    found = vectors.search(frequencies, "doc_id", wanted, vectors.document_frequencies(frequencies), table(spark, sf, "documents").count(), top=5, digits=DIGITS)
    return found.withColumn("score", rounded("score"))


@query("SELECT doc_id, coalesce(len(list_filter(range(1, length(text)), lambda i: lower(substr(text, i::INT, 2)) = 'ee')), 0)::BIGINT AS n FROM (SELECT doc_id, text || 'eEe' AS text FROM documents)")
def mention_count_overlapping(spark, sf):
    return table(spark, sf, "documents").select("doc_id", vectors.overlapping_count(F.concat("text", F.lit("eEe")), F.lit("ee")).alias("n"))


def _plain_sql(steps) -> str:
    sql = "html"
    for pattern, by in steps:
        shown, to = pattern.replace("'", "''"), by.replace("$", "\\")
        sql = f"regexp_replace({sql}, '{shown}', '{to}', 'g')"
    return sql


@query(f"SELECT page_id, {_plain_sql(markup.INDEX_TEXT_STEPS)} AS index_text, {_plain_sql(markup.PAGE_TEXT_STEPS)} AS page_text FROM pages")
def plain_text(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", markup.index_text(html).alias("index_text"), markup.page_text(html).alias("page_text"))


# Random walks.

_SHARES_SQL = f"{SQL_BOTH}, t AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM arcs)"


def _walk_sql(preference: str, who: str) -> str:
    steps = "".join(
        f""", r{i} AS (SELECT {who}, node, sum(p) AS p FROM (SELECT r.{who}, t.dst AS node, 0.85 * sum(r.p * t.share) AS p FROM r{i - 1} r JOIN t ON t.src = r.node GROUP BY ALL UNION ALL SELECT {who}, node, 0.15 * p FROM r0) GROUP BY {who}, node)"""
        for i in (1, 2, 3)
    )
    return f"WITH {_SHARES_SQL}, {SQL_SEEDS}, r0 AS ({preference}){steps} SELECT {who}, node, round(p, 6) AS p FROM r3"


@query(_walk_sql("SELECT node AS seed, node, 1.0::DOUBLE AS p FROM seeds", "seed"))
def ppr_per_seed(spark, sf):
    seeds = suppliers(spark, sf).select("node", F.col("node").alias("seed"))
    out = walks.walk_in_blocks(supply_arcs(spark, sf), walks.uniform_preference(seeds, walker=["seed"]), walker=["seed"])
    return out.select("seed", "node", rounded("p").alias("p"))


@query(_walk_sql("SELECT 0 AS g, node, 1.0::DOUBLE / count(*) OVER () AS p FROM seeds", "g").replace("SELECT g, node, round", "SELECT node, round"))
def ppr_three_steps(spark, sf):
    out = walks.walk(supply_arcs(spark, sf), walks.uniform_preference(suppliers(spark, sf).select("node")))
    return out.select("node", rounded("p").alias("p"))


@query(_walk_sql("SELECT nation, node, (node + 1) / sum(node + 1) OVER (PARTITION BY nation) AS p FROM seeds", "nation"))
def ppr_document(spark, sf):
    seeds = suppliers(spark, sf).withColumn("weight", (F.col("node") + 1).cast("double"))
    out = walks.walk(supply_arcs(spark, sf), walks.weighted_preference(seeds, ["nation"]), walker=["nation"])
    return out.select("nation", "node", rounded("p").alias("p"))


# Scores of features that stand in for the walk's.

SQL_FEATURES = f"""{SQL_CANDIDATES}, raw AS (SELECT doc_id, mention_id, entity, prior, context AS local, 1 / (1 + entity % 13)::DOUBLE AS semantic FROM top),
f AS (SELECT doc_id, mention_id, entity, prior / sum(prior) OVER m AS prior, local / sum(local) OVER m AS local, semantic / sum(semantic) OVER m AS semantic FROM raw WINDOW m AS (PARTITION BY doc_id, mention_id))"""


def part_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates.top_union(part_candidates(spark, sf))
    rows = rows.select("doc_id", "mention_id", "entity", "prior", F.col("context").alias("local"), (F.lit(1.0) / (1 + F.col("entity") % 13)).alias("semantic"))
    return linking.normalized(rows)


@query(f"WITH {SQL_FEATURES} SELECT doc_id, entity, round(prior, 6) AS prior, round(local, 6) AS local, round(semantic, 6) AS semantic FROM f")
def feature_normalisation(spark, sf):
    return part_features(spark, sf).select("doc_id", "entity", *[rounded(x).alias(x) for x in ("prior", "local", "semantic")])


SCORE_SQL = {
    "LINEAR": "0.08 * prior + 0.1 * local + 0.82 * semantic",
    "MULTIPLY": "0.08 * prior * semantic + 0.92 * local * semantic",
    "NOR": "1 - (1 - prior) * (1 - local) * (1 - semantic)",
    "PRIOR_SEM": "prior * semantic",
    "LOCAL_SEM": "local * semantic",
    "SEMANTIC": "semantic",
}


def _score_query(scheme: str) -> None:
    name = f"score_{scheme.lower()}"

    def run(spark, sf):
        ranked = linking.rank(part_features(spark, sf), LinkConfig(rank_scheme=scheme)).withColumn("score", rounded("score"))
        return linking.winners(ranked)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"""WITH {SQL_FEATURES}, s AS (SELECT doc_id, mention_id, entity, round({SCORE_SQL[scheme]}, 6) AS score FROM f)
SELECT doc_id, mention_id, entity, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, mention_id ORDER BY score DESC, entity) AS r FROM s) WHERE r = 1"""


for _scheme in SCORE_SQL:
    _score_query(_scheme)


# Annotation.


@query("""WITH t AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(1, len(string_split(text, ' ')) + 1)) - 1 AS pos FROM conversations),
l AS (SELECT *, CASE WHEN regexp_matches(word, '^[A-Z]') THEN 'MISC' ELSE 'O' END AS label FROM t),
g AS (SELECT *, sum(CASE WHEN label IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM (SELECT *, lag(label) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS prev FROM l))
SELECT conv_id, turn, label, min(pos)::BIGINT AS start_tok, max(pos)::BIGINT AS end_tok FROM g WHERE label <> 'O' GROUP BY conv_id, turn, label, run""")
def ner_run_merge(spark, sf):
    words = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    labelled = words.withColumn("label", F.when(F.col("word").rlike("^[A-Z]"), "MISC").otherwise("O"))
    out = annotate.merge_runs(labelled, ["conv_id", "turn"])
    return out.select("conv_id", "turn", "label", F.col("start_tok").cast("long").alias("start_tok"), F.col("end_tok").cast("long").alias("end_tok"))


@query("""WITH c AS (SELECT conv_id, turn, text, len(string_split(text, ' ')) AS n, turn * 7 % len(string_split(text, ' ')) AS tok FROM conversations)
SELECT conv_id AS doc_id, turn AS sent_no, concat_ws(' ', CASE WHEN tok < 25 THEN lag(text) OVER w END, text, CASE WHEN n - tok <= 25 THEN lead(text) OVER w END) AS context FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbour_context(spark, sf):
    n = F.size(F.split("text", " "))
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_no"), "text", n.alias("n_tokens"), (F.col("turn") * 7 % n).alias("start_tok"), (F.col("turn") * 7 % n).alias("end_tok"))
    return annotate.sentence_context(rows).select("doc_id", "sent_no", "context")


@query("SELECT conv_id AS doc_id, lower(left(text, 2)) AS name_lc, arg_max(role, turn) AS ner_type FROM conversations WHERE role <> 'system' GROUP BY ALL")
def type_vote(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.substring("text", 1, 2).alias("name"), F.when(F.col("role") == "system", "MISC").otherwise(F.col("role")).alias("ner_type"))
    return annotate.type_vote(rows, "turn")


def page_mentions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs, annotate.capital_mentions(docs)


@query()
def annotated_mentions(spark, sf):
    return page_mentions(spark, sf)[1]


@query()
def aligned_annotations(spark, sf):
    docs, found = page_mentions(spark, sf)
    found = settle(found)
    gold = found.select("doc_id", F.col("b").cast("long").alias("mention_id"), F.element_at(F.split("name", " "), 1).alias("name"), F.col("b").alias("offset")).dropDuplicates(["doc_id", "mention_id"])
    return annotate.align(gold, found, settle(annotate.tokens_at(docs, gold))).select("doc_id", "mention_id", "sent_no", "start_tok", "end_tok")


@query()
def coreference_chains(spark, sf):
    found = page_mentions(spark, sf)[1]
    named = found.select("doc_id", F.col("b").cast("long").alias("mention_id"), "name", "ner_type")
    return coref.resolve_chains(named).select("doc_id", "mention_id", "name", "canonical_name")


@query()
def resolved_persons(spark, sf):
    found = page_mentions(spark, sf)[1]
    named = found.select("doc_id", F.col("b").cast("long").alias("mention_id"), "name", F.lit("PER").alias("ner_type"))
    return coref.resolve_persons(named).select("doc_id", "mention_id", "name", "canonical_name")


@query()
def name_alternatives(spark, sf):
    found = page_mentions(spark, sf)[1]
    named = found.select("doc_id", F.col("b").cast("long").alias("mention_id"), "name", "ner_type")
    return expansion.name_alternatives(named).select("doc_id", "mention_id", F.array_join("alternatives", "|").alias("alternatives"))


@query()
def abbreviation_definitions(spark, sf):
    parts = table(spark, sf, "part")
    kind = F.col("p_type")
    words = F.split(F.initcap(kind), " ")
    short = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    docs = parts.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("We sell the "), F.initcap(kind), F.lit(" Works ("), short, F.lit("W) here. "), short, F.lit("W is well known.")).alias("text"), F.concat(short, F.lit("W")).alias("name"))
    mentions = docs.select("doc_id", F.lit(0).alias("mention_id"), "name", F.lit("ORG").alias("ner_type"))
    found = expansion.abbreviation_definitions(mentions, docs)
    known = parts.select(F.concat(F.initcap(kind), F.lit(" Works")).alias("name"))
    return expansion.choose_definition(found, known).select("doc_id", "definition", rounded("confidence").alias("confidence"))


# Linking end to end.


def linking_setup(spark: SparkSession, sf: str) -> tuple[DataFrame, linking.KnowledgeBase]:
    """Mentions of all orders, and parts linked that meet in an order."""
    # An order's distinct parts are packed, so its pairs are made where they are counted.
    orders = settle(table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set("l_partkey").alias("parts")))
    known = table(spark, sf, "part").select(F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("name"))
    mentions = orders.select("doc_id", F.explode("parts").alias("mention_id")).join(known, "mention_id").select("doc_id", "mention_id", "name", F.col("mention_id").alias("gold"))
    pairs = orders.filter("doc_id IS NOT NULL").select(F.explode("parts").alias("src"), "parts").select("src", F.explode("parts").alias("dst")).filter("src < dst")
    # They move packed, too, and are written in one direction.
    lists = pairs.groupBy("src").agg(F.collect_list("dst").alias("dst"))
    edges = settle(lists.select("src", F.explode("dst").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    return mentions, linking.KnowledgeBase(kb.prior_probabilities(part_dictionary(spark, sf)), graph.both_ways(edges), settled=True)


def _linked(spark: SparkSession, sf: str, iterative: bool) -> DataFrame:
    mentions, base = linking_setup(spark, sf)
    cfg = LinkConfig(use_iterative=iterative, min_in_degree_undirected=3, rank_scheme="LINEAR")
    return linking.link(mentions.select("doc_id", "mention_id", "name"), base, cfg)


@query()
def iterative_linking(spark, sf):
    return _linked(spark, sf, True)


@query()
def non_iterative_linking(spark, sf):
    return _linked(spark, sf, False)


# Trained parts.


def labelled_features(spark: SparkSession, sf: str) -> DataFrame:
    """Simple features of labelled documents; labels say good or not."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    words = F.size(F.split("text", " "))
    distinct = F.size(F.array_distinct(F.split("text", " ")))
    return docs.join(labels, "doc_id").select("doc_id", F.lit(0).alias("mention_id"), F.col("doc_id").alias("entity"), (distinct / words).alias("prior"), (1 / (1 + words)).alias("local"), (F.length(F.regexp_replace("text", "[^.]", "")) / words).alias("semantic"), F.least(F.lit(1.0), words / 1000).alias("name"), F.col("quality").alias("label"))


def learns() -> Column:
    """Models learn from four of five documents and are applied to the others."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


@query()
def supervised_ranking(spark, sf):
    rows = labelled_features(spark, sf).withColumn("doc_id", F.floor(F.col("doc_id") / 4))
    return models.rank_supervised(models.fit_ranker(rows.filter(learns())), rows.filter(~learns())).select("doc_id", "entity", rounded("score", 4).alias("score"))


@query()
def nil_prediction(spark, sf):
    rows = labelled_features(spark, sf)
    return models.predict_nil(models.fit_nil(rows.filter(learns())), rows.filter(~learns())).select("doc_id", "entity")
