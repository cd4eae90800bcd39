"""Every stage of the pipeline on its own input, against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from mentionloom.llm.tokens import PieceEncoder, vocabulary

from .test_corpus_ops import WORDS, brute_components, brute_targets, lower


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, out = docs.columns, {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, sf_dir)
        assert name == "packing" or result.columns == columns
        result.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
    return out


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_language_stage_keeps_all_with_letters(stages):
    want = [x for x in stages["documents"] if any(c.isalpha() for c in x.text or "")]
    assert Counter(stages["language_id"]) == Counter(want)


def test_exact_stage(stages):
    groups = defaultdict(list)
    for x in stages["language_id"]:
        groups[lower(x.text)].append(x)
    assert Counter(stages["exact_dedup"]) == Counter(max(g, key=lambda x: x.doc_id) for g in groups.values())


def test_near_stage(stages):
    rows = stages["exact_dedup"]
    kept = {doc for doc, _, _, stays in brute_components([(x.doc_id, x.text) for x in rows], 5, 80) if stays}
    assert Counter(stages["near_dedup"]) == Counter(x for x in rows if x.doc_id in kept)


def test_mixing_stage(stages):
    size = {x.doc_id: len(WORDS.findall(x.text)) for x in stages["near_dedup"]}
    by_source = defaultdict(list)
    for x in stages["near_dedup"]:
        by_source[x.source].append(x)
    targets = brute_targets({s: sum(size[x.doc_id] for x in v) for s, v in by_source.items()})
    want = Counter()
    for source, rows in by_source.items():
        rows.sort(key=lambda x: hashlib.md5(str(x.doc_id).encode()).hexdigest())
        total = sum(size[x.doc_id] for x in rows)
        copies, left = divmod(round(targets[source]), total)
        for x in rows:
            cut = min(left, size[x.doc_id])
            left -= cut
            want[x.doc_id] += copies * size[x.doc_id] + cut
    got = Counter()
    for x in stages["mixing"]:
        got[x.doc_id] += len(WORDS.findall(x.text))
    assert got == +want


def test_packing_stage(stages):
    encoder = PieceEncoder(vocabulary("byte_bpe_50k.json"), True)
    want = Counter()
    for x in stages["mixing"]:
        want += Counter([(x.doc_id, len(encoder.encode(pa.array([x.text]))[0]) + 1)])
    tokens = Counter()
    for x in stages["packing"]:
        tokens[x.doc_id] += x.length
    total = Counter()
    for (doc, n), times in want.items():
        total[doc] += n * times
    assert tokens == total
    by_sequence = defaultdict(list)
    for x in stages["packing"]:
        by_sequence[x.sequence_id].append((x.offset, x.length))
    for pieces in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]]
        assert ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    def tokens(rows):
        out = Counter()
        for x in rows:
            out[x.doc_id] += x.length
        return out

    assert tokens(corpus_pipeline.run(spark, sf_dir).collect()) == tokens(stages["packing"])
