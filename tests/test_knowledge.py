"""Dump to tables, graphs, walks and relatedness on small cases."""

from __future__ import annotations

import bz2
import gzip
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionloom import queries
from mentionloom.operators import graph, kb, relatedness, vectors, walks
from mentionloom.plans import build
from mentionloom.sources import tables, xml
from mentionloom.streaming import edges as streaming

DUMP = """<mediawiki>
<page><title>Paris</title><id>1</id><revision><id>9</id><text>[[France|the Republic]] and [[Seine]] {{x}} capital city</text></revision></page>
<page><title>City of Light</title><id>2</id><redirect title="Paris" /><revision><text>#R</text></revision></page>
<page><title>P (disambiguation)</title><id>3</id><revision><text>* [[Paris]]
* [[London]]</text></revision></page>
<page><title>Pee</title><id>4</id><redirect title="P" /><revision><text>#R</text></revision></page>
<page><title>List of rivers</title><id>5</id><revision><text>[[Seine]]</text></revision></page>
<page><title>Seine</title><id>6</id><revision><text>[[Paris]] river [[Paris|see more...]] [[France]] {{geo-stub}}</text></revision></page>
<page><title>France</title><id>7</id><revision><text>[[Paris]] land [[Paris]]</text></revision></page>
</mediawiki>
"""


@pytest.fixture(scope="module", params=["plain", "gz", "bz2"])
def pages(spark, tmp_path_factory, request):
    folder = tmp_path_factory.mktemp("dump")
    if request.param == "plain":
        path = folder / "dump.xml"
        path.write_text(DUMP)
    elif request.param == "gz":
        path = folder / "dump.xml.gz"
        path.write_bytes(gzip.compress(DUMP.encode()))
    else:
        path = folder / "dump.xml.bz2"
        path.write_bytes(bz2.compress(DUMP.encode()))
    return xml.read_dump(spark, str(path)).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_pages_and_kinds(pages):
    kinds = {x.title: x.kind for x in kb.classify_pages(pages).collect()}
    assert kinds == {"Paris": "entity", "City of Light": "redirect", "P (disambiguation)": "disambiguation", "Pee": "redirect", "List of rivers": "special", "Seine": "stub", "France": "entity"}


def test_knowledge_tables(spark, pages, tmp_path):
    made = build.knowledge_tables(pages)
    aliases = {(x.alias_lc, x.entity, x.source): x.freq for x in made["aliases"].collect()}
    assert aliases["city of light", "Paris", "redirect"] == 1
    assert aliases["the republic", "France", "link"] == 1
    assert aliases["p", "Paris", "disambig"] == aliases["pee", "Paris", "disambig"] == 1
    assert ("p", "London", "disambig") not in aliases
    assert aliases["paris", "Paris", "link"] == 3
    assert aliases["paris", "Paris", "name"] == 1
    assert not any("more" in k[0] for k in aliases)
    assert rows(made["redirects"]) == [("City of Light", "Paris"), ("Pee", "P")]
    assert rows(made["link_edges"]) == [("France", "Paris", 2), ("Paris", "France", 1), ("Paris", "Seine", 1)]
    assert rows(made["cooccurrence_edges"]) == [("France", "Paris", 3), ("France", "Seine", 1), ("Paris", "France", 3), ("Paris", "Seine", 1), ("Seine", "France", 1), ("Seine", "Paris", 1)]
    build.write_knowledge(made, str(tmp_path))
    base = build.read_knowledge(spark, str(tmp_path))
    prior = {(x.alias_lc, x.entity): x.prior for x in base.priors.collect()}
    assert prior["paris", "Paris"] == 1.0
    assert rows(kb.name_ids(kb.classify_pages(pages))) == [("France", "7"), ("Paris", "1"), ("Seine", "6")]


def test_priors(spark):
    table = spark.createDataFrame([("a", "x", "link", 6, 1), ("a", "y", "link", 2, 2), ("a", "y", "name", 1, 3), ("a", "z", "name", 1, 4)], "alias_lc string, entity string, source string, freq long, at long")
    assert rows(kb.prior_probabilities(table.drop("at"))) == [("a", "x", "link", 0.6), ("a", "y", "link", 0.3), ("a", "z", "name", 0.1)]
    assert rows(kb.prior_probabilities(table, strict=True, order="at")) == [("a", "x", "link", 0.75), ("a", "y", "name", 0.125), ("a", "z", "name", 0.125)]


def test_window_pairs_match_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(int(g), f"n{rng.integers(0, 9)}", int(p)) for g in range(3) for p in rng.integers(0, 60, 25)]
    got = kb.window_pairs(spark.createDataFrame(data, "g long, n string, p long"), "g", "n", "p", 7)
    want = [(g, n, m) for g, n, p in data for h, m, q in data if g == h and n < m and abs(p - q) <= 7]
    assert rows(got) == sorted(want, key=repr)


def test_undirected_and_degrees(spark):
    edges = spark.createDataFrame([(1, 2, 3.0), (2, 1, 5.0), (4, 4, 1.0)], "src long, dst long, w double")
    assert rows(graph.undirected_max(edges)) == [(1, 2, 5.0), (2, 1, 5.0), (4, 4, 1.0)]
    assert rows(graph.undirected(edges)) == [(1, 2, 8.0), (2, 1, 8.0), (4, 4, 1.0)]
    assert rows(graph.degrees(edges)) == [(1, 1, 1), (2, 1, 1), (4, 1, 1)]
    assert rows(graph.graph_size(edges)) == [(3, 3)]


def test_expansion_two_hops_and_fallback(spark):
    arcs = graph.undirected(spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("b", "e", 1), ("b", "f", 1)], "src string, dst string, w long"))
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {x.node for x in graph.expand(arcs, seeds, 1, 4).collect()} == {"a", "b"}
    assert {x.node for x in graph.expand(arcs, seeds, 1, 100).collect()} == {"a", "b"}
    assert {x.node for x in graph.expand(arcs, seeds, 2, 2).collect()} == {"a", "b", "c"}
    assert rows(graph.subgraph(arcs, seeds, graph.expand(arcs, seeds, 1, 4))) == [("a", "b", 1), ("b", "a", 1)]


PATH = [("a", "b", 1), ("b", "c", 3)]


def test_walk_steps(spark):
    arcs = graph.undirected(spark.createDataFrame(PATH, "src string, dst string, w long"))
    seed = spark.createDataFrame([("a", 1.0)], "node string, p double")
    for steps, want in ((1, {"a": 0.15, "b": 0.85}), (2, {"a": 0.330625, "b": 0.1275, "c": 0.541875}), (3, {"a": 0.177094, "b": 0.741625, "c": 0.081281})):
        got = {x.node: x.p for x in walks.walk(arcs, seed, steps=steps).collect()}
        assert {k: v for k, v in got.items() if v} == pytest.approx(want, abs=1e-6)
    both = spark.createDataFrame([("a", 0.5), ("c", 0.5)], "node string, p double")
    assert {x.node: x.p for x in walks.walk(arcs, both).collect()} == pytest.approx({"a": 0.102094, "b": 0.741625, "c": 0.156281}, abs=1e-6)


def test_walk_equals_kernel_with_dangling_nodes(spark):
    rng = np.random.default_rng(8)
    n = 12
    edges = {(int(a), int(b)): int(w) for a, b, w in zip(rng.integers(0, 9, 30), rng.integers(0, n, 30), rng.integers(0, 5, 30), strict=True)}
    table = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, w long")
    seeds = spark.createDataFrame([(i,) for i in range(n)], "node long").withColumn("seed", F.col("node"))
    vectors_ = walks.walk(table, walks.uniform_preference(seeds, walker=["seed"]), walker=["seed"])
    assert all(x.stochastic for x in walks.is_stochastic(vectors_, ["seed"]).collect())
    got = np.zeros((n, n))
    for x in vectors_.collect():
        got[x.seed, x.node] = x.p
    src, dst, w = (np.array(x) for x in zip(*[(a, b, w) for (a, b), w in edges.items()], strict=True))
    want = walks.walk_kernel(n, src, dst, w, np.eye(n), threshold=0)
    assert np.abs(got - want).max() < 1e-9
    assert np.allclose(want.sum(axis=1), 1)


def test_relatedness_by_shared_neighbours(spark):
    edges = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 3)] + [(i, 2, 1) for i in (2, 3, 4, 5)], "src long, dst long, w long")
    pairs = spark.createDataFrame([(1, 2), (1, 1), (1, 7)], "a long, b long")
    got = {(x.a, x.b): x.relatedness for x in relatedness.score_pairs(pairs, relatedness.neighbourhood(edges), 100).collect()}
    assert got == {(1, 2): pytest.approx(0.802328, abs=1e-6), (1, 1): 1.0, (1, 7): 0.0}


def test_matrix_edges_and_sparse_cosine(spark):
    table = spark.createDataFrame([([[0.0, 2.0], [1.0, 0.0]],)], "matrix array<array<double>>")
    assert rows(walks.matrix_edges(table)) == [(0, 1, 2.0), (1, 0, 1.0)]
    vec = spark.createDataFrame([("x", "t", 1.0), ("x", "u", 1.0), ("y", "t", 2.0)], "a string, term string, weight double")
    pairs = spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string")
    got = {(x.a, x.b): x.cosine for x in vectors.cosine_pairs(pairs, vec, vec.withColumnRenamed("a", "b"), "a", "b").collect()}
    assert got == {("x", "y"): pytest.approx(2**-0.5), ("x", "z"): 0.0}
    assert rows(vectors.l1_normalized(spark.createDataFrame([(1, 2.0), (1, 6.0), (2, 0.0)], "k long, v double"), ["k"], "v")) == [(1, 0.25), (1, 0.75), (2, 0.0)]


def test_files(spark, tmp_path):
    (tmp_path / "g.txt").write_text("3\n1 2\n\n0\n")
    assert rows(tables.read_ascii_graph(spark, str(tmp_path / "g.txt"))) == [(0, 1, 1), (0, 2, 1), (2, 0, 1)]
    (tmp_path / "r.tsv").write_text("S.D.\tSD\nEs dee\tSD\n")
    assert rows(tables.read_redirects(spark, str(tmp_path / "r.tsv"))) == [("SD", ["Es dee", "S.D."])]
    (tmp_path / "a.tsv").write_text('Paris\tCity  "of"\tlink\t3\nbroken\tline\n')
    assert rows(tables.read_alias_dictionary(spark, str(tmp_path / "a.tsv"))) == [('city "of"', "Paris", "link", 3)]
    edges = spark.createDataFrame([("a", "b", 1)], "src string, dst string, w long")
    tables.write_tsv(edges, str(tmp_path / "out"))
    assert rows(tables.read_tsv(spark, str(tmp_path / "out"), tables.EDGES)) == [("a", "b", 1.0)]


def test_streamed_edges_equal_batch(spark, tmp_path):
    spark.createDataFrame([("A", "1", "[[B]] [[B]] [[C]]", None), ("B", "2", "[[A]]", None)], "title string, id string, text string, redirect string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("title string, id string, text string, redirect string").parquet(f"{tmp_path}/in")
    query = streaming.write_edges(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out").select("src", "dst", "w")
    assert rows(got) == [("A", "B", 2), ("A", "C", 1), ("B", "A", 1)]


@pytest.mark.parametrize("mode", ["in", "out", "both"])
@pytest.mark.parametrize("weighted", [False, True])
def test_relatedness_of_groups_equals_pairs(spark, mode, weighted):
    """Over cells of one and of many members, with arcs in several rows, members without arcs and a group of one."""
    rng = random.Random(7)
    arcs = spark.createDataFrame([(rng.randrange(30), rng.randrange(30), rng.randrange(1, 4)) for _ in range(150)], "src long, dst long, w long")
    some = spark.createDataFrame([(i % 3, i) for i in range(34)] + [(9, 99)], "group int, node long")
    near = relatedness.neighbourhood(arcs, mode)
    want = {(x.a, x.b): x.relatedness for x in relatedness.score_pairs(relatedness.pairwise(some), near, 100, weighted).collect()}
    for cells in (1, 40, 1 << 20):
        got = relatedness.score_groups(some, arcs, 100, mode, weighted, cells).collect()
        assert len(got) == len(want) and {(x.a, x.b): x.relatedness for x in got} == pytest.approx(want)


@pytest.mark.parametrize("name", ["relatedness_union", "relatedness_unweighted", "relatedness_union_weighted", "relatedness_weighted"])
def test_no_pair_of_relatedness_is_shuffled_that_shares_nothing(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(a#\d+L?, b#", plan)


@pytest.mark.parametrize("mode", ["out", "both"])
@pytest.mark.parametrize("weighted", [False, True])
def test_relatedness_of_groups_in_runs(spark, mode, weighted):
    """Runs of few members or neighbours, names as keys, an entity of two groups, arcs to nowhere and one neighbour of all."""
    rng = random.Random(5)
    arcs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(20)}", rng.randrange(1, 4)) for _ in range(150)] + [(f"n{i}", "hub", 1) for i in range(30)]
    arcs = spark.createDataFrame([*arcs, ("n1", None, 2), ("n1", None, 1), ("n4", None, 1)], "src string, dst string, w long")
    some = spark.createDataFrame([(i % 3, f"n{i}") for i in range(34)] + [(1, "n0"), (1, "n33"), (None, "n5")], "group int, node string")
    members = some.dropna()
    pairs = members.toDF("group", "a").join(members.toDF("group", "b"), "group").filter("a < b")
    scores = {(x.a, x.b): x.relatedness for x in relatedness.score_pairs(pairs, relatedness.neighbourhood(arcs, mode), 100, weighted).collect()}
    want = sorted((x.a, x.b, pytest.approx(scores[x.a, x.b])) for x in pairs.collect())
    for cells, side, most in ((3, 4, 1 << 20), (1 << 18, 4096, 10), (1 << 18, 1, 1)):
        got = relatedness.score_groups(some, arcs, 100, mode, weighted, cells, side, most).collect()
        assert sorted((x.a, x.b, x.relatedness) for x in got) == want


@pytest.mark.parametrize("name", ["relatedness_union", "relatedness_unweighted", "relatedness_union_weighted", "relatedness_weighted"])
def test_relatedness_shuffles_packed_neighbours(spark, sf_dir, name):
    """Fewer rows are shuffled than there are line items, and none after the pairs are made."""
    store, every = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(every(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), every())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    assert written() - before < tables.table(spark, sf_dir, "lineitem").count() / 4


def test_packed_neighbours_come_back():
    """Negative, far apart and no neighbours, names, whole, fractional and large weights; arcs in several rows add up."""
    import numpy as np
    import pyarrow as pa

    member = np.array([0, 2, 2, 0, 2, 3, 3, 4])
    far = np.array([5, 2**63 - 1, -(2**63), -3, 7, 1, 1, 9])
    for w in ([1, 1, 1, 1, 1, 1, 1, 1], [1, 3, 4, 1, 255, 1, 1, 0], [0.5, 3, -4, 1, 256, 0.25, 1, 1], None):
        for values in (far, pa.array([f"n{x}" for x in far])):
            packed = relatedness._pack(pa.array(list("abcde")), member, values, None if w is None else np.array(w, float), np.arange(5.0))
            got, n, weights = relatedness._unpack(packed.slice(1))
            of = np.repeat(np.arange(1, 5), n)
            want = {}
            for m, x, y in zip(member, values.tolist() if isinstance(values, np.ndarray) else values.to_pylist(), w or [1] * 8, strict=True):
                want[m, x] = want.get((m, x), 0) + y
            found = dict(zip(zip(of, got.tolist() if isinstance(got, np.ndarray) else got.to_pylist(), strict=True), [1] * len(of) if w is None else weights, strict=True))
            want = {k: 1 if w is None else v for k, v in want.items() if k[0] > 0}
            assert found == want and packed.column("n").to_pylist() == [2, 0, 3, 1, 1]


@pytest.mark.parametrize("weighted", [False, True])
def test_relatedness_shuffles_few_bytes_an_arc(spark, weighted):
    """Neighbours are packed before they move and move twice, not again for each run of a group that fits two."""
    store, every = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(every(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), every())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    arcs = spark.range(200_000).selectExpr("id % 50 AS src", "xxhash64(id) % 1000000 AS dst", "1 AS w")
    some = spark.range(50).selectExpr("1 AS group", "id AS node")
    before = written()
    relatedness.score_groups(some, arcs, 10**7, "out", weighted, most=120_000).write.format("noop").mode("overwrite").save()
    assert written() - before < 6 * 200_000


def test_relatedness_of_many_runs_moves_neighbours_few_times(spark):
    """A run's neighbours go to half of the strips of its group, not to every run."""
    store, every = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(every(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), every())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    arcs = spark.range(200_000).selectExpr("id % 200 AS src", "xxhash64(id) % 1000000 AS dst", "1 AS w")
    some = spark.range(200).selectExpr("1 AS group", "id AS node")
    before = written()
    relatedness.score_groups(some, arcs, 10**7, "out", True, most=12_500).write.format("noop").mode("overwrite").save()
    assert written() - before < 16 * 200_000


@pytest.mark.parametrize("strip", [1, 2, 3, 100])
def test_relatedness_of_strips_equals_pairs(spark, strip):
    """Of one and of many runs, with a member of more neighbours than a run, an entity of two groups and read a few rows at a time."""
    rng = random.Random(9)
    arcs = [(rng.randrange(40), rng.randrange(25), rng.randrange(1, 4)) for _ in range(300)] + [(17, i, 1) for i in range(25)]
    arcs = spark.createDataFrame(arcs, "src long, dst long, w long")
    some = spark.createDataFrame([(str(i % 2), i) for i in range(45)] + [("1", 0), ("2", 3)], "group string, node long")
    pairs = some.toDF("group", "a").join(some.toDF("group", "b"), "group").filter("a < b")
    scores = {(x.a, x.b): x.relatedness for x in relatedness.score_pairs(pairs, relatedness.neighbourhood(arcs, "out"), 100, True).collect()}
    want = sorted((x.a, x.b, pytest.approx(scores[x.a, x.b])) for x in pairs.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = relatedness.score_groups(some, arcs, 100, "out", True, side=3, most=20, strip=strip).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((x.a, x.b, x.relatedness) for x in got) == want


@pytest.mark.parametrize("block, most", [(2, 1 << 23), (256, 1 << 23), (5, 60)])
def test_walks_in_blocks_equal_walks_by_joins(spark, block, most):
    """With sinks, zero weights, a seed off the graph, weighed seeds, and blocks of which some are too large."""
    rng = random.Random(3)
    arcs = spark.createDataFrame([(f"n{rng.randrange(25)}", f"n{rng.randrange(30)}", rng.randrange(0, 4)) for _ in range(60)], "src string, dst string, w long")
    seeds = spark.createDataFrame([(i % 11, f"n{i}", float(i % 3)) for i in range(33)] + [(50, "off", 1.0)], "seed int, node string, weight double")
    start = walks.weighted_preference(seeds, ["seed"])
    want = {(x.seed, x.node): x.p for x in walks.walk(arcs, start, walker=["seed"]).collect()}
    got = walks.walk_in_blocks(arcs, start, walker=["seed"], block=block, most=most).collect()
    assert len(got) == len(want) and {(x.seed, x.node): x.p for x in got} == pytest.approx(want)


def test_walks_of_seeds_shuffle_no_vectors(spark, sf_dir):
    """The rows of the walk are the last thing made, from blocks of seeds and arcs."""
    plan = queries.QUERIES["ppr_per_seed"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Aggregate" not in plan
