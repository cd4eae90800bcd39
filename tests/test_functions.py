"""Names, markup, string similarity and scores on hand-computed cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mentionloom.config import LinkConfig
from mentionloom.functions import markup, names, scores, strsim


@pytest.fixture(scope="module")
def value(spark):
    """Evaluate an expression over literal strings a, b, c."""

    def run(expression, **columns):
        row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'long'}" for k, v in columns.items()))
        return row.select(expression.alias("x")).first()["x"]

    return run


@pytest.mark.parametrize(("raw", "want"), [(" new_york  city", "New york city"), ("Rome", "Rome"), (" _ ", None), ("", None), ("éa", "Éa")])
def test_format_name(value, raw, want):
    assert value(names.format_name(F.col("a")), a=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("Mercury (planet)", "Mercury"), ("Paris, Texas", "Paris"), ("A - B", "A"), ("Rome", "Rome"), ("A, B (c)", "A, B")])
def test_alter_name(value, raw, want):
    assert value(names.alter_name(F.col("a")), a=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("Dr. Smith", "Smith"), ("Acme Corp.", "Acme"), ("Mr. Dr. J. Smith Jr.", "J. Smith"), ("U.S.", "U.S"), ("plain", "plain")])
def test_normalize_name(value, raw, want):
    assert value(names.normalize_name(F.col("a")), a=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("List of x", True), ("File:a", True), ("A#b", True), ("Rome", False), ("", True), (None, True)])
def test_special_title(value, raw, want):
    assert value(names.is_special_title(F.col("a")), a=raw) is want


@pytest.mark.parametrize(("short", "long", "want"), [("abc", "cab", True), ("abd", "cab", False), ("S.D.", "San Diego", False), ("SD", "San Diego", True)])
def test_disambiguation_name(value, short, long, want):
    assert value(names.is_disambiguation_name(F.col("a"), F.col("b")), a=short, b=long) is want


@pytest.mark.parametrize(("long", "short", "want"), [("Washington US", "US", True), ("School Bus", "us", False), ("a+b (c)", "(c)", False), ("Paris", "Paris", True), ("x c++", "c++", True)])
def test_ends_with_name_is_literal(value, long, short, want):
    assert value(names.ends_with_name(F.col("a"), F.col("b")), a=long, b=short) is want


@pytest.mark.parametrize(("name", "kind", "want"), [("NATO", "ORG", True), ("NATO", "LOC", False), ("Nato", "ORG", False), ("A B", "ORG", False), ("X", "ORG", False), ("ABCDEFGHIJK", "ORG", False), (".AB", "ORG", False)])
def test_abbreviation(value, name, kind, want):
    assert value(names.is_abbreviation(F.col("a"), F.col("b")), a=name, b=kind) is want


def test_tokens_and_letters(value):
    assert value(names.is_punctuation(F.col("a"), F.col("b"), F.col("c")), a="-LRB-", b=3, c=3) is True
    assert value(names.is_punctuation(F.col("a"), F.col("b"), F.col("c")), a="&", b=3, c=3) is False
    assert value(names.is_punctuation(F.col("a"), F.col("b"), F.col("c")), a="it's", b=0, c=3) is False
    assert value(names.is_stop_token(F.col("a"), F.col("b")), a="of", b="IN") is True
    assert value(names.is_stop_token(F.col("a"), F.col("b")), a="x<y", b="NN") is True
    assert value(names.is_stop_word(F.col("a")), a="The") is True
    assert value(names.is_stop_word(F.col("a")), a=None) is True
    assert value(names.sort_characters(F.col("a")), a="cab") == "abc"
    assert value(names.extract_abbreviation(F.col("a"), True), a="United nations Org") == "UnO"
    assert value(names.extract_abbreviation(F.col("a"), False), a="United nations Org") == "UO"
    assert value(names.normalize_person_name(F.col("a")), a="F.M. Last") == "F. M. Last"
    assert value(names.entity_id(F.col("a"), F.col("b")), a="Smith & Co.", b="ORG") == "SMITH  CO#ORG"


def test_string_similarities(value):
    assert strsim.jaro_winkler_score("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert strsim.common_substring_length("abcdef", "zcdem") == 3
    assert strsim.common_substring_length("", "x") == 0
    assert strsim.ngram_score("abc", "abc") == 1.0
    assert strsim.ngram_score("", "abc") == 0.0
    assert 0 < strsim.ngram_score("night", "nacht") < 1
    assert strsim.monge_elkan_score("paul johnson", "johnson paul") == pytest.approx(1.0)
    assert strsim.soft_tfidf_score("apple inc", "apple inc") == pytest.approx(1.0)
    assert value(strsim.edit_similarity(F.col("a"), F.col("b")), a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    assert value(strsim.edit_similarity(F.col("a"), F.col("b")), a="", b="abc") == 3.0
    assert value(strsim.dice_bigrams(F.col("a"), F.col("b")), a="night", b="nacht") == pytest.approx(0.25)
    assert value(strsim.abbreviation_similarity(F.col("a"), F.col("b")), a="UN", b="United Nations") == pytest.approx(1.0)
    assert value(strsim.jaro_winkler("a", "b"), a=None, b="x") is None


def test_links_and_places(value):
    text = "See [[ paris|City of light]], [[File:x.png|thumb]], [[Rome]] and [[a|b|c]] [[x| ]]."
    got = [(x.target, x.anchor, x.position) for x in value(markup.links(F.col("a")), a=text)]
    assert got == [("Paris", "City of light", 4), ("Rome", "Rome", text.index("[[Rome")), ("A", "A", text.index("[[a|")), ("X", None, text.index("[[x|"))]
    assert value(markup.links(F.col("a")), a="none") == []


def test_page_kinds_and_fields(value):
    assert value(markup.is_stub(F.col("a")), a="x {{geo-stub}}") is True
    assert value(markup.is_disambiguation(F.col("a"), F.col("b")), a="Mercury (disambiguation)", b="") is True
    assert value(markup.is_disambiguation(F.col("a"), F.col("b")), a="SD", b="text\n  {{Disambig|x}}") is True
    assert value(markup.is_disambiguation(F.col("a"), F.col("b")), a="SD", b="see {{disambig}}") is False
    assert value(markup.is_disambiguation(F.col("a"), F.col("b")), a="SD", b="{{disambig}} {{x-stub}}") is False
    assert value(markup.categories(F.col("a")), a="[[Category:Cities|x]] [[Category:Towns]]") == ["Cities", "Towns"]
    assert value(markup.translated_title(F.col("a"), "de"), a="x\n[[de:Köln]]\n[[fr:Cologne]]") == "Köln"
    assert value(markup.translated_title(F.col("a"), "it"), a="x\n[[de:Köln]]") is None
    assert markup.infobox_text("a {{Infobox city|n={{x}} {{cite web|u}} <ref a>z</ref><b>p</b>}} tail") == "{{Infobox city|n={{x}}    p }}"
    assert markup.infobox_text("{{Infobox city|n={{x}") is None
    assert value(markup.index_text(F.col("a")), a="'''Rome''' &lt;b&gt; {{x}} [[a:b]] [[city]] <!-- n --> [u v] a|b").split() == ["Rome", "city", "a", "b"]


def test_scores(value):
    rows = {"LINEAR": 0.484, "MULTIPLY": 0.242, "NOR": 0.825}
    for scheme, want in rows.items():
        got = value(scores.score(scheme, F.lit(0.3), F.lit(0.5), F.lit(0.5)), a="x")
        assert got == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError, match="unknown"):
        scores.score("VOTE", F.lit(1), F.lit(1), F.lit(1))
    for tf, df, want in ((1, 1, 1.693147), (4, 2, 2.575364), (9, 4, 2.330569)):
        assert value(scores.tfidf(F.lit(tf), F.lit(df), F.lit(4)), a="x") == pytest.approx(want, abs=1e-6)

    def array(*x):
        return F.array(*[F.lit(float(v)) for v in x])

    assert value(scores.divergence_dense(array(0.5, 0.5, 0), array(0.25, 0.75, 0)), a="x") == pytest.approx(0.207519, abs=1e-6)
    assert value(scores.divergence_dense(array(0.5, 0.5), array(1, 0)), a="x") == pytest.approx(4.5)
    assert value(scores.divergence_dense(array(1), array(0.5, 0.5)), a="x") == 0.0
    assert value(scores.cosine_dense(array(1, 0), array(0, 0)), a="x") == 0.0
    assert value(scores.relatedness(F.lit(4), F.lit(3), F.lit(2), F.lit(100)), a="x") == pytest.approx(0.802328, abs=1e-6)
    assert value(scores.relatedness(F.lit(4), F.lit(3), F.lit(2), F.lit(6)), a="x") == 0.0


def test_config(tmp_path):
    path = tmp_path / "el.config"
    path.write_text("# c\nrankScheme = MULTIPLY\npriorWeight=0.2\nuseIterative = 0\nother=1\n")
    cfg = LinkConfig.from_properties(path)
    assert (cfg.rank_scheme, cfg.prior_weight, cfg.use_iterative) == ("MULTIPLY", 0.2, False)
    assert LinkConfig.from_properties(path, strict=True).rank_scheme == "LINEAR"
    assert LinkConfig(rank_scheme="MULTIPLE").rank_scheme == "MULTIPLY"
    assert LinkConfig(rank_scheme="VOTE", strict=True).rank_scheme == "SEMANTIC"
    with pytest.raises(ValueError, match="VOTE"):
        LinkConfig(rank_scheme="VOTE")
