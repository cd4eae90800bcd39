"""Candidates, annotation, expansion, coreference, linking, models and evaluation on small cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mentionloom import queries
from mentionloom.config import LinkConfig
from mentionloom.operators import annotate, candidates, coref, evaluate, expansion, graph, linking, models
from mentionloom.plans import link as plans
from mentionloom.sources import features, xml


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


PRIORS = [("paris", "Paris", "link", 0.6), ("paris", "Paris Hilton", "link", 0.3), ("paris", "Paris (Texas)", "name", 0.1), ("smith", "John Smith", "link", 1.0), ("new york", "New York City", "link", 0.7), ("new york", "New York State", "name", 0.3)]


@pytest.fixture(scope="module")
def priors(spark):
    return spark.createDataFrame(PRIORS, "alias_lc string, entity string, source string, prior double").cache()


@pytest.fixture(scope="module")
def mentions(spark):
    data = [(1, 1, " Paris"), (1, 2, "Dr. Smith"), (1, 3, "New  York"), (1, 4, "Parys"), (1, 5, "zzz")]
    return spark.createDataFrame(data, "doc_id long, mention_id long, name string").cache()


def test_lookup_normalised_and_fuzzy(mentions, priors):
    assert {x.mention_id for x in candidates.lookup(mentions, priors).collect()} == {1, 3}
    assert {x.mention_id for x in candidates.lookup_normalized(mentions, priors).collect()} == {1, 2, 3}
    found = candidates.lookup_or_fuzzy(mentions, priors)
    assert {x.mention_id for x in found.collect()} == {1, 2, 3, 4}
    fuzzy = [x for x in found.collect() if x.mention_id == 4]
    assert {x.entity: x.prior for x in fuzzy} == {"Paris": 0.6, "Paris Hilton": 0.3, "Paris (Texas)": 0.1}


def test_pruning_and_agreement(spark):
    table = spark.createDataFrame([(1, 1, c, 0.1 * i, 1.0 - 0.1 * i) for i, c in enumerate("abcdefgh")] + [(1, 2, "a", 0.9, 0.9), (1, 2, "b", 0.1, 0.2), (1, 3, "q", 1e-6, 1.0)], "doc_id long, mention_id long, entity string, prior double, context double")
    top = candidates.top_union(table)
    assert {(x.mention_id, x.entity) for x in top.collect()} == {(1, "f"), (1, "g"), (1, "h"), (1, "b"), (1, "c"), (2, "a"), (2, "b")}
    agreed = candidates.agreeing(top)
    assert rows(agreed) == [(1, 2, "a")]
    assert {(x.mention_id, x.entity) for x in candidates.keep_agreed(top, agreed).collect() if x.mention_id == 2} == {(2, "a")}
    assert [(x.mention_id, x.place) for x in sorted(candidates.ambiguity_order(top).collect(), key=lambda x: x.place)] == [(1, 1), (2, 2)]
    known = spark.createDataFrame([("a",)], "entity string")
    assert {(x.mention_id, x.entity) for x in candidates.clean(table, known).collect()} == {(1, "a"), (2, "a"), (3, "q")}
    assert rows(candidates.best_prior(table.filter("mention_id = 2"))) == [(1, 2, "a", 0.9)]
    ties = spark.createDataFrame([(1, 1, "z", 0.5), (1, 1, "b", 0.5)], "doc_id long, mention_id long, entity string, prior double")
    assert rows(candidates.best_prior(ties)) == [(1, 1, "b", 0.5)]


def test_label_runs(spark):
    data = [(1, 0, i, x) for i, x in enumerate(["PERSON", "PERSON", "O", "LOCATION", "ORGANIZATION"])]
    runs = annotate.merge_runs(spark.createDataFrame(data, "doc_id long, sent_no int, pos int, label string"))
    assert {(x.label, x.start_tok, x.end_tok) for x in runs.collect()} == {("PERSON", 0, 1), ("LOCATION", 3, 3), ("ORGANIZATION", 4, 4)}


def test_tokens_and_alignment(spark):
    text = "We saw John Smith there. He met Mary-Ann O'Neil\nin old Rome."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    words = annotate.tokens(docs)
    got = sorted(words.collect(), key=lambda x: x.b)
    assert all(text[x.b : x.e + 1] == x.text for x in got)
    assert [x.text for x in got if x.sent_no == got[-1].sent_no] == ["in", "old", "Rome", "."]
    found = annotate.mentions_of(words, annotate.merge_runs(annotate.capital_labels(words)))
    assert {x.name for x in found.collect()} == {"John Smith", "Mary-Ann O'Neil", "Rome"}
    gold = spark.createDataFrame([(1, 0, "Smith", text.index("Smith")), (1, 1, "old", text.index("old")), (1, 2, "met M", text.index("met"))], "doc_id long, mention_id long, name string, offset int")
    aligned = {x.mention_id: (x.start_tok, x.end_tok, x.ner_type) for x in annotate.align(gold, found, words).collect()}
    assert aligned == {0: (2, 3, "MISC"), 1: (1, 1, None), 2: (2, 3, "MISC")}
    located = annotate.align_or_locate(gold.select("doc_id", "mention_id", "name"), docs)
    assert {x.mention_id: x.offset for x in located.collect()} == {0: text.index("Smith"), 1: text.index("old"), 2: text.index("met M")}
    absent = annotate.align_or_locate(spark.createDataFrame([(1, 5, "nowhere")], "doc_id long, mention_id long, name string"), docs)
    assert [x.offset for x in absent.collect()] == [None]


TEXTS = ["We saw John Smith there. He met Mary-Ann O'Neil\nin old Rome.", "", None, " \t\n", "A b. C D! \x0b E F? G\u00a0H I\u2028J K.\n\nL \u00c9a \U0001d538b \U0001f600 Mo No", "x Ab Cd. . Ef Gh", "the End", "...  \n. Z'a Z'b", "a \u01c5e \u0130i A' B- C1 D"]


def test_capital_mentions_equal_token_rows(spark):
    """The kernel over a document's parts gives what windows and joins over token rows give, and so do its tokens in an alignment."""
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("aB\u00e9\u00c9 \n.!'-1\u3000\U0001d538"), 60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(TEXTS + made)), "doc_id long, text string").repartition(3)
    words = annotate.tokens(docs)
    slow = annotate.mentions_of(words, annotate.merge_runs(annotate.capital_labels(words)))
    fast = annotate.capital_mentions(docs)
    assert fast.dtypes == slow.dtypes and rows(fast) == rows(slow) and fast.count() > 40
    gold = spark.createDataFrame([(d, i, str(x[i : i + n]), i) for d, x in enumerate(TEXTS + made) if x for i in range(0, len(x), 2) for n in (1, 4)], "doc_id long, mention_id long, name string, offset int").dropDuplicates(["doc_id", "mention_id"])
    assert rows(annotate.align(gold, fast, annotate.tokens_at(docs, gold))) == rows(annotate.align(gold, slow, words))


def test_aligned_annotations_make_no_row_of_every_token(spark, sf_dir):
    plan = queries.QUERIES["aligned_annotations"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Window" not in plan


def test_abbreviation_definitions(spark):
    text = "The World Health Organization (WHO) met. EU (European Union) said no. Later the Big Old Company spoke; BOC agreed."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    mentions = spark.createDataFrame([(1, 1, "WHO", "ORG"), (1, 2, "EU", "ORG"), (1, 3, "BOC", "ORG"), (1, 4, "Later", "ORG"), (1, 5, "USA", "LOC")], "doc_id long, mention_id long, name string, ner_type string")
    found = expansion.abbreviation_definitions(mentions, docs)
    known = spark.createDataFrame([("World Health Organization",)], "name string")
    chosen = {x.mention_id: (x.definition, x.confidence) for x in expansion.choose_definition(found, known).collect()}
    assert chosen[1] == ("World Health Organization", 1.0)
    assert chosen[2] == ("European Union", 1.0)
    assert chosen[3][0] == "Big Old Company"
    assert set(chosen) == {1, 2, 3}


def test_names_in_a_document(spark):
    data = [(1, 1, "Smith", "PER", 0, 0, 0), (1, 2, "John Smith", "PER", 0, 5, 6), (1, 3, "Springfield", "LOC", 1, 0, 0), (1, 4, "Ohio", "LOC", 1, 2, 2)]
    mentions = spark.createDataFrame(data, "doc_id long, mention_id long, name string, ner_type string, sent_no int, start_tok int, end_tok int")
    assert rows(expansion.longer_names(mentions)) == [(1, 1, "Smith", "John Smith")]
    assert rows(expansion.name_alternatives(mentions)) == [(1, 1, ["John Smith"])]
    cand = spark.createDataFrame([(1, 3, "Springfield Ohio", "link", 0.2), (1, 3, "Springfield Illinois", "link", 0.8), (1, 4, "Ohio", "link", 1.0)], "doc_id long, mention_id long, entity string, source string, prior double")
    composed = expansion.compose_with_next_location(mentions, cand)
    assert {(x.mention_id, x.entity) for x in composed.collect()} == {(3, "Springfield Ohio"), (4, "Ohio")}
    assert {(x.mention_id, x.entity) for x in expansion.prune_by_locations(mentions, cand).collect()} == {(3, "Springfield Ohio"), (4, "Ohio")}
    assert {x.mention_id: x.adjacent for x in expansion.adjacent(mentions).collect()} == {1: False, 2: False, 3: False, 4: True}
    chains = coref.resolve_chains(mentions.select("doc_id", "mention_id", "name", "ner_type"))
    assert {x.mention_id: x.canonical_name for x in chains.collect()} == {1: "John Smith", 2: "John Smith", 3: "Springfield", 4: "Ohio"}
    persons = coref.resolve_persons(mentions)
    assert {x.mention_id: x.canonical_name for x in persons.collect()} == {1: "John Smith", 2: "John Smith", 3: "Springfield", 4: "Ohio"}
    assert coref.names_match("IBM", "International Business Machines")
    assert coref.names_match("bill", "William", frozenset({("bill", "william")}))
    assert not coref.names_match("Smith", "Smithson")


def test_evaluation(spark):
    results = spark.createDataFrame([(1, "X", "X"), (1, "Y", "W"), (1, "Z", None), (2, None, None), (2, "A", "A")], "doc_id long, gold string, predicted string")
    docs = {x.doc_id: x for x in evaluate.per_document(results).collect()}
    one = docs[1]
    assert (one.n_query, one.n_found, one.n_correct) == (3, 2, 1)
    assert (one.precision, one.recall, one.f1) == pytest.approx((0.5, 1 / 3, 0.4))
    assert docs[2].f1 == 1.0
    total = evaluate.summary(evaluate.per_document(results)).first()
    assert (total.micro_precision, total.micro_recall, total.macro_precision) == pytest.approx((3 / 4, 3 / 5, 0.75))


@pytest.fixture(scope="module")
def base(spark, priors):
    edges = spark.createDataFrame([("John Smith", "Paris Hilton", 5), ("John Smith", "New York State", 1), ("Paris", "New York City", 1), ("Paris (Texas)", "New York City", 1)], "src string, dst string, w long")
    return linking.KnowledgeBase(priors, graph.undirected(edges))


@pytest.mark.parametrize("iterative", [True, False])
def test_linking_follows_the_graph(spark, base, iterative):
    """John Smith is sure; the graph draws his document's Paris to the entity next to him."""
    table = spark.createDataFrame([(1, 1, "Paris"), (1, 2, "Smith"), (2, 1, "Nowhere")], "doc_id long, mention_id long, name string")
    terms = spark.createDataFrame([("Paris Hilton", "star", 1.0), ("John Smith", "star", 1.0), ("Paris", "city", 1.0)], "entity string, term string, weight double")
    known = linking.KnowledgeBase(base.priors, base.edges, terms)
    contexts = spark.createDataFrame([(1, "star", 1.0)], "doc_id long, term string, weight double")
    cfg = LinkConfig(use_iterative=iterative, rank_scheme="SEMANTIC", min_in_degree_undirected=1)
    got = {(x.doc_id, x.mention_id): x.entity for x in linking.link(table, known, cfg, contexts).collect()}
    assert got == {(1, 1): "Paris Hilton", (1, 2): "John Smith", (2, 1): None}


def test_prior_baseline_with_coref(spark, priors):
    table = spark.createDataFrame([(1, 1, "York", "LOC"), (1, 2, "New York", "LOC")], "doc_id long, mention_id long, name string, ner_type string")
    assert rows(plans.link_by_prior_with_coref(table, priors)) == [(1, 1, "New York City"), (1, 2, "New York City")]


def test_benchmark_roundtrip(spark, base, tmp_path):
    (tmp_path / "b.xml").write_text(
        '<corpus><document docName="d1"><annotation><mention>Paris</mention><wikiName>Paris Hilton</wikiName><offset>8</offset></annotation>'
        "<annotation><mention>Smith</mention><wikiName>NIL</wikiName><offset>18</offset></annotation><annotation><mention/><wikiName>x</wikiName><offset>0</offset></annotation></document>"
        '<document docName="d2"></document></corpus>'
    )
    gold = xml.read_benchmark(spark, str(tmp_path / "b.xml"), nil=True)
    assert rows(gold) == [("d1", 0, "Paris", 8, "Paris Hilton"), ("d1", 1, "Smith", 18, None)]
    assert xml.read_benchmark(spark, str(tmp_path / "b.xml")).count() == 1
    docs = spark.createDataFrame([("d1", "They saw Paris and Smith.")], "doc_id string, text string")
    linked = plans.link_benchmark(gold, docs, base, LinkConfig(min_in_degree_undirected=1))
    assert linked.count() == 2
    xml.write_linked(gold, linked, str(tmp_path / "out"))
    again = spark.read.format("xml").option("rowTag", "document").schema(xml.DOCUMENT).load(str(tmp_path / "out")).first()
    assert again["_docName"] == "d1"
    assert [x.wikiName for x in again.annotation] == ["Paris Hilton", "NIL"]
    assert plans.measure(gold, linked).first().accuracy in (0.0, 1.0)
    markings = gold.select("doc_id", F.col("mention_id").alias("marking_id"), F.col("name").alias("text"), "offset", F.length("name").alias("length"))
    blank = spark.createDataFrame([("d1", 9, " ", 0, 1)], markings.schema)
    assert plans.link_markings(markings.unionByName(blank), docs, base, LinkConfig(min_in_degree_undirected=1)).filter("marking_id = 9").first().entity is None


def test_ranker_and_nil(spark):
    data = [(d, 0, e, 0.9 if e == "r" else 0.1, 0.8 if e == "r" else 0.2, 0.7, 0.5, int(e == "r")) for d in range(20) for e in ("r", "w")]
    table = spark.createDataFrame(data, "doc_id long, mention_id long, entity string, prior double, local double, semantic double, name double, label int")
    best = models.rank_supervised(models.fit_ranker(table), table)
    assert {x.entity for x in best.collect()} == {"r"}
    kept = models.predict_nil(models.fit_nil(table), table)
    assert {(x.entity, x.label) for x in kept.collect()} == {("r", 1), (None, 0)}
    assert models.predict_nil(None, table).count() == 40
    lines = [x.value for x in features.feature_lines(table.limit(2)).collect()]
    assert all(x.startswith("[entity]") and x.count("\t") == 4 for x in lines)


def test_knowledge_base_of_the_queries_has_all_counted_edges(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().toPandas()
    want = {}
    for own in lines.groupby("l_orderkey")["l_partkey"]:
        for a in own[1]:
            for b in own[1]:
                if a != b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert 1 in want.values()
    assert {(x.src, x.dst): x.w for x in queries.linking_setup(spark, sf_dir)[1].edges.collect()} == want


@pytest.fixture(scope="module")
def fitted(spark):
    """Models that follow the prior alone: a large share ranks first, a small one means no entity."""
    data = [(d, 0, e, p, 0.5, 0.5, 0.5, int(p > 0.65)) for d in range(20) for e, p in (("r", 0.7 + d / 100), ("w", 0.3 - d / 100), ("v", 0.6))]
    table = spark.createDataFrame(data, "doc_id long, mention_id long, entity string, prior double, local double, semantic double, name double, label int")
    return models.fit_ranker(table), models.fit_nil(table)


def test_models_are_saved_and_loaded(spark, fitted, tmp_path):
    for i, model in enumerate(fitted):
        models.save_model(model, f"{tmp_path}/{i}")
        again = models.load_model(f"{tmp_path}/{i}")
        assert models.linear_part(again)[0].tolist() == models.linear_part(model)[0].tolist()


@pytest.mark.parametrize("iterative", [True, False])
def test_every_option_of_linking_tells(spark, fitted, iterative):
    priors = spark.createDataFrame([("paris", "A", "link", 0.6), ("paris", "B", "link", 0.39), ("paris", "C", "redirect", 0.01), ("acme", "B", "link", 1.0)], "alias_lc string, entity string, source string, prior double")
    edges = graph.undirected(spark.createDataFrame([("A", "X", 1), ("B", "Y", 1), ("C", "X", 1)], "src string, dst string, w long"))
    terms = spark.createDataFrame([("A", "river", 1.0), ("B", "film", 1.0), ("C", "town", 1.0)], "entity string, term string, weight double")
    known = linking.KnowledgeBase(priors, edges, terms, ranker=fitted[0], nil=fitted[1])
    table = spark.createDataFrame([(1, 1, "Paris")], "doc_id long, mention_id long, name string")
    film = spark.createDataFrame([(1, "film", 1.0)], "doc_id long, term string, weight double")

    def best(mentions=table, contexts=film, **options):
        cfg = LinkConfig(use_iterative=iterative, min_in_degree_undirected=1, rank_scheme="LOCAL_SEM", **options)
        return [x.entity for x in linking.link(mentions, known, cfg, contexts).orderBy("mention_id").collect()]

    assert best(supervised=True) == ["A"]
    assert best(nil_prediction=True) == [None]
    if not iterative:  # candidates and contexts are the same in both orders
        return

    def chosen(mentions=table, contexts=film, **options):
        rows = linking.select_candidates(mentions, known, LinkConfig(**options), contexts).collect()
        return {x.entity: x.context for x in rows}

    assert chosen() == {"A": 0.0, "B": 1.0, "C": 0.0}
    own = spark.createDataFrame([(1, 1, "town", 1.0)], "doc_id long, mention_id long, term string, weight double")
    assert chosen(context="sentence", contexts=own) == {"A": 0.0, "B": 0.0, "C": 1.0}
    assert set(chosen(selection="source")) == {"A", "B", "C"}
    assert set(chosen(selection="source", other_threshold=0.05)) == {"A", "B"}
    assert set(chosen(selection="source", link_threshold=0.5)) == {"A", "C"}
    assert set(chosen(selection="source", top_by_source=1)) == {"A"}
    inc = table.withColumn("name", F.lit("Acme Inc"))
    assert (chosen(inc), set(chosen(inc, selection="normalized"))) == ({}, {"B"})
    with pytest.raises(ValueError, match="weight"):
        best(mention_preference="TFIDF")
    with pytest.raises(ValueError, match="mention_id"):
        best(context="sentence")
    with pytest.raises(ValueError, match="ranker"):
        linking.link(table, linking.KnowledgeBase(priors, edges), LinkConfig(supervised=True))
    for bad in ({"selection": "x"}, {"context": "x"}, {"mention_preference": "x"}):
        with pytest.raises(ValueError, match="x: one of"):
            LinkConfig(**bad)


@pytest.mark.parametrize("iterative", [True, False])
def test_mention_weights_draw_the_walk(spark, iterative):
    """Mention 1 follows the entities of mention 2 or 3, whichever name weighs more."""
    priors = spark.createDataFrame([("m", "x", "link", 0.5), ("m", "y", "link", 0.4), ("n", "p", "link", 0.6), ("n", "p2", "link", 0.4), ("o", "q", "link", 0.6), ("o", "q2", "link", 0.4)], "alias_lc string, entity string, source string, prior double")
    edges = graph.undirected(spark.createDataFrame([("x", "p", 1), ("y", "q", 1), ("x", "p2", 1), ("y", "q2", 1)], "src string, dst string, w long"))
    terms = spark.createDataFrame([(e, "t", 1.0) for e in ("y", "p2", "q2")], "entity string, term string, weight double")
    contexts = spark.createDataFrame([("d", "t", 1.0)], "doc_id string, term string, weight double")
    kb = linking.KnowledgeBase(priors, edges, terms)
    got = {}
    for heavy in (2, 3):
        rows = [("d", 1, "m", 1.0), ("d", 2, "n", 9.0 if heavy == 2 else 0.1), ("d", 3, "o", 9.0 if heavy == 3 else 0.1)]
        table = spark.createDataFrame(rows, "doc_id string, mention_id long, name string, weight double")
        cfg = LinkConfig(use_iterative=iterative, mention_preference="TFIDF", rank_scheme="SEMANTIC", min_in_degree_undirected=1)
        got[heavy] = {x.mention_id: x.entity for x in linking.link(table, kb, cfg, contexts).collect()}[1]
    assert got == {2: "x", 3: "y"}
    docs = spark.createDataFrame([("d", "m n n o")], "doc_id string, text string")
    weighed = {x.name: x.weight for x in linking.mention_weights(table.drop("weight"), docs).collect()}
    assert weighed["n"] > weighed["m"] == weighed["o"]


def test_iterative_linking_weighs_entities():
    """Mention 1 follows the likelier entity of mention 2, by the weight that the strategy gives."""
    data = [("d", 1, "x", 0.5, 0.4), ("d", 1, "y", 0.4, 0.5), ("d", 2, "p", 0.9, 0.1), ("d", 2, "q", 0.1, 0.9)]
    group = pd.DataFrame(data, columns=["doc_id", "mention_id", "entity", "prior", "context"])
    arcs = pd.DataFrame([("x", "p", 1), ("p", "x", 1), ("y", "q", 1), ("q", "y", 1)], columns=["src", "dst", "w"])
    got = {}
    for kind in ("PRIOR_PROB", "CTX_SIM"):
        out = linking.decide(group, arcs, LinkConfig(rank_scheme="SEMANTIC", entity_preference=kind))
        got[kind] = dict(zip(out["mention_id"], out["entity"], strict=True))[1]
    assert got == {"PRIOR_PROB": "x", "CTX_SIM": "y"}


def test_documents_in_memory_equal_joins(spark):
    """Walks of one document in memory give what the joins give, with loops, lonely seeds, weightless arcs and entities the graph lacks."""
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 20, 70), rng.integers(0, 20, 70), rng.integers(0, 4, 70), strict=True)]
    edges = spark.createDataFrame(pairs, "src long, dst long, w long").groupBy("src", "dst").agg(F.sum("w").alias("w")).coalesce(1).cache()
    rows = [(d, m, int(e), float(rng.random()), float(rng.random())) for d in range(2) for m in range(3) for e in rng.choice(22, 3, replace=False)]
    found = spark.createDataFrame(rows, "doc_id long, mention_id int, entity long, prior double, context double").coalesce(1)
    cfg = LinkConfig(directed=True, min_in_degree_directed=4)
    base = linking.KnowledgeBase(found.select("entity"), edges)
    lists = graph.neighbour_lists(edges, graph.degrees(edges), 4, chunk=5).toPandas()
    unpacked = lists.explode(["far", "w", "kind"]).astype({"far": int, "w": float, "kind": int})
    arcs = linking.document_graph(found, base, cfg).collect()
    for doc in (0, 1):
        got = linking.arcs_of_lists(unpacked[unpacked["node"].isin({x[2] for x in rows if x[0] == doc})].reset_index(drop=True), True)
        assert {(x.src, x.dst, x.w) for x in arcs if x.doc_id == doc} == set(got.itertuples(index=False, name=None))
    want = {x[:3]: x.semantic for x in linking.features_by_joins(found, base, cfg).collect()}
    got = {x[:3]: x.semantic for x in linking.features(found, base, cfg).collect()}
    assert got.keys() == want.keys() and len(got) == len(rows)
    assert all(abs(got[k] - want[k]) <= 1e-9 * max(1.0, abs(want[k])) for k in want)


@pytest.mark.parametrize("iterative", [True, False])
def test_linking_by_alias_equals_linking_by_mention(spark, iterative):
    """Ambiguous, unknown, sure and unconnected names over few large blocks, some documents by joins, against candidates selected for each mention."""
    rng = np.random.default_rng(11)
    known = spark.createDataFrame([(f"n{i % 7}", i, "link" if i % 3 else "name", 0.001 * (1 + i * 7 % 13)) for i in range(60)] + [("one", 99, "link", 1.0)], "alias_lc string, entity long, source string, prior double")
    arcs = spark.createDataFrame([(int(a), int(b), 1 + int(a) % 3) for a, b in rng.integers(0, 55, (150, 2))], "src long, dst long, w int")
    base = linking.KnowledgeBase(known, graph.undirected(arcs))
    table = spark.createDataFrame([(d, m, ["one", "unknown"][m % 2] if rng.random() < 0.2 else f" N{rng.integers(0, 7)}") for d in range(12) for m in range(1 + d)], "doc_id long, mention_id long, name string")
    for options in ({"rank_scheme": "LINEAR"}, {"rank_scheme": "SEMANTIC", "selection": "source", "use_unambiguous": False, "weighted": False}):
        cfg = LinkConfig(use_iterative=iterative, min_in_degree_undirected=3, **options)
        got = rows(linking.link_by_alias(table, base, cfg, kernel_rows=30, docs=5))
        found = linking.settle(linking.select_candidates(table, base, cfg))
        if iterative:
            best = linking.link_iteratively(found, base, cfg)
        else:
            best = linking.winners(linking.rank(linking.normalized(linking.features(linking.settle(candidates.keep_agreed(found, linking.unambiguous(found))), base, cfg)), cfg))
        want = rows(table.select("doc_id", "mention_id").join(best.select("doc_id", "mention_id", "entity"), ["doc_id", "mention_id"], "left"))
        assert got == want and len(got) == 78 and any(x[2] is None for x in got)


@pytest.mark.parametrize("name", ["non_iterative_linking", "iterative_linking"])
def test_linking_does_not_write_candidates_of_every_mention(spark, sf_dir, monkeypatch, name):
    """What is written to the checkpoint folder has at most a row a mention or arc; candidates were some five a mention."""
    written = []
    monkeypatch.setattr(linking, "settle", lambda df, f=linking.settle: written.append(f(df)) or written[-1])
    mentions, base = queries.linking_setup(spark, sf_dir)
    linking.link(mentions.select("doc_id", "mention_id", "name"), base, LinkConfig(use_iterative=name == "iterative_linking", min_in_degree_undirected=3, rank_scheme="LINEAR"))
    n = mentions.count()
    assert written and all(x.count() <= n for x in written if {"doc_id", "entity"} <= set(x.columns))


@pytest.mark.parametrize("name", ["non_iterative_linking", "iterative_linking"])
def test_linking_writes_an_edge_once_and_moves_mentions_once(spark, sf_dir, monkeypatch, name):
    """Edges were written in both directions; mentions, candidates, lists and results were all shuffled."""
    written, settle = [], linking.settle
    for module in (linking, queries):
        monkeypatch.setattr(module, "settle", lambda df: written.append(settle(df)) or written[-1])
    out = queries.QUERIES[name](spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().toPandas()
    pairs = {(a, b) for _, own in lines.groupby("l_orderkey")["l_partkey"] for a in own for b in own if a < b}
    assert sum(x.count() for x in written if {"src", "dst"} <= set(x.columns)) == len(pairs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "CoGroups" not in plan


@pytest.mark.parametrize("iterative", [True, False])
def test_neighbour_lists_sent_to_all_or_dealt_to_blocks_link_alike(spark, iterative):
    """Every mention comes out once, also without a candidate, in a block without any, and without a document."""
    rng = np.random.default_rng(5)
    known = spark.createDataFrame([(f"n{i % 5}", i, "link" if i % 3 else "name", 0.01 * (1 + i * 7 % 13)) for i in range(40)], "alias_lc string, entity long, source string, prior double")
    arcs = spark.createDataFrame([(int(a), int(b), 1 + int(a) % 3) for a, b in rng.integers(0, 38, (120, 2))], "src long, dst long, w int")
    base = linking.KnowledgeBase(known, graph.undirected(arcs))
    data = [(d, m, "unknown" if d > 8 or m == 3 else f"n{rng.integers(0, 5)}") for d in range(12) for m in range(5)] + [(None, 1, "n1"), (20, None, "n2"), (20, 1, "n2")]
    table = spark.createDataFrame(data, "doc_id long, mention_id long, name string")
    cfg = LinkConfig(use_iterative=iterative, min_in_degree_undirected=3, rank_scheme="LINEAR")
    sent = rows(linking.link_by_alias(table, base, cfg, docs=1))
    for more in ({"sent": 0}, {"sent": 0, "arcs": 40}):
        assert rows(linking.link_by_alias(table, base, cfg, docs=1, **more)) == sent
    assert {x[:2] for x in sent} == {x[:2] for x in data} and len(sent) == len(data)
    unlinked = {x[:2] for x in data if x[2] == "unknown" or None in x[:2]}
    assert {x[:2] for x in sent if x[2] is None} == unlinked


@pytest.mark.parametrize("name", ["non_iterative_linking", "iterative_linking"])
def test_linking_sorts_mentions_without_candidates(spark, sf_dir, name):
    """Each mention was joined to all of its candidates before blocks were sorted."""
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "__alias#" in plan and "prior#" not in plan


@pytest.mark.parametrize("iterative", [True, False])
def test_candidates_sent_or_joined_link_alike(spark, iterative):
    """Over few and many candidates, lists sent and dealt, weighed mentions and entities with names."""
    rng = np.random.default_rng(9)
    known = spark.createDataFrame([(f"n{i % 5}", f"e{i}", "link" if i % 3 else "name", 0.01 * (1 + i * 7 % 13)) for i in range(40)], "alias_lc string, entity string, source string, prior double")
    arcs = spark.createDataFrame([(f"e{a}", f"e{b}", 1 + int(a) % 3) for a, b in rng.integers(0, 38, (120, 2))], "src string, dst string, w int")
    base = linking.KnowledgeBase(known, graph.undirected(arcs))
    data = [(d, m, "unknown" if d > 6 or m == 3 else f"n{rng.integers(0, 5)}", float(1 + m)) for d in range(9) for m in range(5)]
    table = spark.createDataFrame(data, "doc_id long, mention_id long, name string, weight double")
    cfg = LinkConfig(use_iterative=iterative, min_in_degree_undirected=3, rank_scheme="LINEAR", mention_preference="TFIDF")
    want = rows(linking.link_by_alias(table, base, cfg, docs=3, few_options=0))
    for more in ({}, {"sent": 0}):
        assert rows(linking.link_by_alias(table, base, cfg, docs=3, **more)) == want
    assert len(want) == len(data) and any(x[2] for x in want)
