"""Exact dedup, packing, token files, repetition rules and chat formatting against plain Python."""

from __future__ import annotations

import hashlib
import re
import uuid
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mentionloom.llm import chat, packing, repetition, wavelet
from mentionloom.llm.exact_dedup import duplicate_report, exact_dedup
from mentionloom.llm.queries import QUERIES
from mentionloom.llm.tokens import PieceEncoder, vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


# exact dedup


def brute_report(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[lower(text)].append(doc)
    out = Counter()
    for doc, text in rows:
        ids = [x for x in groups[lower(text)] if x is not None]
        keep = max(ids) if ids else None
        out[doc, keep, len(groups[lower(text)]), doc == keep, hashlib.sha256(lower(text).encode()).hexdigest()] += 1
    return out


def test_exact_dedup_query(spark, sf_dir, docs):
    got = Counter(map(tuple, QUERIES["op4_exact_dedup"](spark, sf_dir).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    assert got == brute_report([(x["doc_id"], x["text"]) for x in docs])


def test_exact_dedup_odd_rows(odd_docs, no_docs):
    rows = [(x.doc_id, x.text) for x in odd_docs.collect()]
    assert Counter(map(tuple, duplicate_report(odd_docs).collect())) == brute_report(rows)
    kept = exact_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter([2, 3, 7, 8, 9, 10, 11, None, 12])
    assert duplicate_report(no_docs).count() == exact_dedup(no_docs).count() == 0


def test_exact_dedup_hot_group(spark, monkeypatch):
    """A digest with most of the rows, among many small groups and unique texts, also without doc_ids; a full plane too."""
    from mentionloom.llm import exact_dedup as module

    monkeypatch.setattr(module, "HOT_SHARE", 3)
    rows = [(None if i % 5 == 0 else i, "Hot text") for i in range(300)] + [(1000 + i, f"pair {i // 2}") for i in range(60)] + [(2000 + i, f"one {i}") for i in range(40)] + [(None, "hot text"), (7, "HOT text")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_report(rows)
    for bits in (1 << 20, 1 << 29):
        assert Counter(map(tuple, duplicate_report(table, max_bits=bits).collect())) == want
        assert sorted(x.doc_id for x in exact_dedup(table, max_bits=bits).collect()) == sorted([299, *range(1001, 1060, 2), *range(2000, 2040)])
    nobody = spark.createDataFrame([(None, "x")] * 9 + [(None, "y")], "doc_id long, text string")
    assert sorted(x.text for x in exact_dedup(nobody).collect()) == ["x", "y"]
    monkeypatch.setattr(module, "_positions", lambda digests, bits: np.zeros((len(digests), module.HASHES), np.uint64))
    assert sorted(x.text for x in exact_dedup(nobody).collect()) == ["x", "y"]


def test_saturated_filter_changes_nothing(odd_docs):
    """Beyond the size bound every row raises an alarm; results stay."""
    assert Counter(duplicate_report(odd_docs, max_bits=1 << 20).collect()) == Counter(duplicate_report(odd_docs).collect())
    from mentionloom.llm import exact_dedup as module

    plane = np.full((1 << 20) // 8, 255, np.uint8)
    again = module.flag_repeats(odd_docs.select(module.text_digest("text").alias("d")), plane, "d", "f")
    assert all(x.f for x in again.collect())


def test_exact_dedup_hashes_a_text_once_a_branch(spark, sf_dir):
    """No Python step follows another in a task: each would hold a worker of its own, with its memory."""
    rows = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 3


def test_workers_give_back_when_nothing_holds_the_batch(monkeypatch):
    from mentionloom.llm import common, tokens

    batch = pa.record_batch({"text": ["x"]})
    seen = weakref.ref(batch)
    held = [batch]
    del batch
    monkeypatch.setattr(common, "give_back", lambda: held.append(seen() is None))

    def run(batches):
        for x in batches:
            yield x.num_rows

    left = {"left": None}
    monkeypatch.setattr(tokens, "_encoders", left)
    assert list(common.giving_back(run, encoders=True)(iter([]))) == [] and left
    held.pop()
    assert list(common.giving_back(run)(held.pop() for _ in range(1))) == [1]
    assert held == [True] and not left


# tokens and packing

SAMPLES = ["don't stop it's  the \n\n end  ", "a  b   c\t\td\n e \n f", "x<|endoftext|>y <|startoftext|>", "naïve café œ　日本語 m² 3² 3rd 'tis ''s a'b", "x\x1cy\x85z​q", "É́ À ſ İ ΑΣ Σ ß", "'''s 'S don'T 1'2s", "  x  y", "�😀 😀'd a\x00b", "", "a <|endoftext|> B<|endoftext|><|ENDOFTEXT|> c <|startoftext|>d", "J\u030c E\u0301x “Don’t” go—Now × 3÷4 ÉCOLE", "x" * 300 + " " + "y" * 300, "\n \n", " ", "\n\nA  B\tC \t D\r\n"]


@pytest.mark.parametrize(("name", "spaced", "width"), [("byte_bpe_50k.json", True, 4), ("word_bpe_49k.json", False, 2)])
def test_piece_encoder_is_the_tokenizer(name, spaced, width, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary(name))
    ours = PieceEncoder(vocabulary(name), spaced, width, memo=300)
    signs = [*" \n\t'sStdDrRvVeElLmMaéÉœ1²9.,<|>", "\x1c", "　", "​", "\x0b", "́", *"Σ日×÷“’Jßµ\xa0\r", "<|endoftext|>", "<|startoftext|>", "  "]
    alphabet = st.lists(st.sampled_from(signs), max_size=24).map("".join)

    def same(texts):
        want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in ours.encode(pa.array(texts, pa.string()))] == want

    same(SAMPLES)
    same([x["text"] for x in docs[:40]])
    settings(max_examples=400, deadline=None)(given(st.lists(alphabet, min_size=1, max_size=5))(same))()


def check_packing(rows, window=packing.WINDOW):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in rows:
        assert len(x.ids) == 4 * x.length > 0
        by_doc[x.doc_id, x.doc_tokens].append(x)
        by_sequence[x.sequence_id].append(x)
    for pieces in by_sequence.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at == window or at & (at - 1) == 0
    return by_doc


def test_packing_query(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {x["doc_id"]: np.array([*plain.encode(x["text"] or "", add_special_tokens=False).ids, 1], "<u4") for x in docs}
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    for (doc, total), parts in check_packing(pieces).items():
        parts.sort(key=lambda x: x.start)
        assert [x.start for x in parts] == np.concatenate([[0], np.cumsum([x.length for x in parts])])[:-1].tolist()
        assert b"".join(x.ids for x in parts) == want.pop(doc).tobytes()
        assert total == sum(x.length for x in parts)
    assert not want
    digest = {(x.sequence_id, x.offset): x for x in QUERIES["op3_packing"](spark, sf_dir).collect()}
    assert len(digest) == len(pieces)
    assert all(digest[x.sequence_id, x.offset].ids_crc32 == zlib.crc32(x.ids) for x in pieces)


def test_packing_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs.coalesce(2)).collect()
    check_packing(rows)
    assert {x.doc_id for x in rows} == {x.doc_id for x in odd_docs.collect()}
    assert packing.pack(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=60))
def test_packer_any_lengths(lengths):
    packer = packing.WindowPacker(window=16, open_windows=3)
    for doc, n in enumerate(lengths):
        packer.add(doc, np.arange(n, dtype="<u4").tobytes())
        assert len(packer.open) <= 3
    packer.finish()
    got, used = defaultdict(dict), Counter()
    for sequence, offset, (doc, start, total, ids) in packer.done:
        assert offset == used[sequence]
        used[sequence] += len(ids) // 4
        got[doc][start] = ids
        assert total == lengths[doc]
    assert all(x in (1, 2, 4, 8, 16) for x in used.values())
    for doc, n in enumerate(lengths):
        assert b"".join(got[doc][k] for k in sorted(got[doc])) == np.arange(n, dtype="<u4").tobytes()


# wavelet shards


def test_wavelet_operations():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.integers(0, 50, n).astype("<u2") * 900 % 49000
        shard = wavelet.WaveletMatrix(wavelet.WaveletMatrix.encode(ids, np.array([3, 4]), np.array([n, 0])))
        assert shard.decode().tolist() == ids.tolist()
        assert shard.doc_ids.tolist() == [3, 4]
        assert shard.doc_lengths.tolist() == [n, 0]
        for i in range(0, n, 97):
            assert shard.access(i) == ids[i]
            assert shard.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
        for value in {*ids[:5].tolist(), 48999}:
            places = np.flatnonzero(ids == value)
            assert shard.count(value) == len(places)
            assert [shard.select(value, k) for k in range(len(places))] == places.tolist()
        with pytest.raises(IndexError):
            shard.select(48999, 0)


def expected_starts(rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_wavelet_query(spark, sf_dir, docs):
    got = QUERIES["op6_wavelet_tokens"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == expected_starts([(x["doc_id"], x["text"]) for x in docs])


def test_wavelet_odd_rows(spark, odd_docs, no_docs, tmp_path):
    folder = f"file://{tmp_path}/{uuid.uuid4()}"
    assert wavelet.write_shards(odd_docs, folder, shard_tokens=40).count() > 3
    got = [(x.doc_id, x.start, x.n_tokens, zlib.crc32(x.ids)) for x in wavelet.read_shards(spark, folder).collect()]
    assert sorted(got, key=lambda x: x[1]) == expected_starts([(x.doc_id, x.text) for x in odd_docs.collect()])
    assert wavelet.write_shards(no_docs, folder).count() == 0


# repetition


def brute_repetition(text):
    text = text or ""
    words = WORDS.findall(text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    seen, dup, chars = set(), 0, 0
    for line in lines:
        if line in seen:
            dup += 1
            chars += sum(map(len, WORDS.findall(line)))
        seen.add(line)
    out |= {"n_lines": len(lines), "n_dup_lines": dup, "dup_line_chars": chars}

    def covered(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        return {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + n)}

    out["n_repeat_words"] = len(covered(5))
    over = dup > 0.3 * len(lines) or chars > 0.2 * out["word_chars"]
    for n, most in repetition.RepetitionRules().gram_share:
        out[f"gram{n}_chars"] = sum(len(words[j]) for j in covered(n))
        over |= out[f"gram{n}_chars"] > most * out["word_chars"]
    out["base_failed"] = len(words) < 10 or 100 * out["n_repeat_words"] > 20 * len(words)
    out["kept"] = not out["base_failed"] and not over
    return out


def test_repetition_query(spark, sf_dir, docs):
    texts = {x["doc_id"]: x["text"] for x in docs}
    result = QUERIES["op9_repetition"](spark, sf_dir)
    assert result.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = result.collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.asDict() == {"doc_id": row.doc_id} | brute_repetition(texts[row.doc_id])


def test_repetition_odd_rows(odd_docs, no_docs):
    rows = repetition.repetition_report(odd_docs).collect()
    want = Counter((x.doc_id, *sorted(brute_repetition(x.text).items())) for x in odd_docs.collect())
    assert Counter((x.doc_id, *sorted((k, v) for k, v in x.asDict().items() if k != "doc_id")) for x in rows) == want
    kept = repetition.quality_filter(odd_docs)
    assert kept.columns == odd_docs.columns
    assert [x.doc_id for x in kept.collect()] == [None]
    assert repetition.repetition_report(no_docs).count() == repetition.quality_filter(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab \n\té")), max_size=60), max_size=6))
def test_repetition_any_texts(texts):
    raw = [x.encode() for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    found = repetition.measure(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    for i, text in enumerate(texts):
        assert {k: v[i].item() for k, v in found.items()} == brute_repetition(text)


# chat


def digests(rows):
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
    turns = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)
    loss = "".join(t or "" for _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_query(spark, sf_dir):
    rows = defaultdict(list)
    for x in pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist():
        rows[x["conv_id"]].append((x["turn"], x["role"], x["text"]))
    control = "<|im_end|><|im_start|>assistant ok"
    rows[-1] = [(0, "user", control), (1, "assistant", control)]
    result = QUERIES["op7_chat_format"](spark, sf_dir)
    assert result.columns[:6] == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in result.collect()}
    assert got == {k: digests(v) for k, v in rows.items()}


def of_examples(turns):
    """What read_back says of the examples, from the examples spelled out."""
    out = defaultdict(lambda: (0, hashlib.sha256(), 0, hashlib.sha256()))
    for x in sorted(chat.full_examples(turns).collect(), key=lambda x: x.example):
        n, texts, chars, loss = out[x.conv_id]
        reply = chat.unescape(x.text[x.loss_start : x.loss_end])
        texts.update(hashlib.sha256(x.text.encode()).hexdigest().encode())
        loss.update(reply.encode())
        out[x.conv_id] = (n + 1, texts, chars + len(reply), loss)
    return {k: (n, texts.hexdigest(), chars, loss.hexdigest()) for k, (n, texts, chars, loss) in out.items()}


def test_read_back_equals_full_examples(spark, sf_dir):
    """Also for a long conversation and for rows without a conv_id."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    long = spark.createDataFrame([(c, i, "assistant" if i % 2 else "user", f"turn <|{i}|> é") for c in (None, -5) for i in range(400)], table.schema)
    turns = chat.format_turns(table.unionByName(long))
    none = hashlib.sha256().hexdigest()
    want = of_examples(turns)
    rows = chat.read_back(turns).collect()
    assert {x.conv_id: (x.n_examples, x.examples_sha256, x.loss_chars, x.loss_sha256) for x in rows if x.n_examples} == want
    assert want[None][0] == want[-5][0] == 200
    assert all(x.examples_sha256 == x.loss_sha256 == none for x in rows if not x.n_examples)


ODD_TURNS = [(1, 0, "system", "a<\\|b"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|>\n<\\\\|x"), (1, 2, "assistant", "again"), (1, 3, None, "é😀"), (None, None, "assistant", ""), (None, 1, "a\\nb\n<|", "t"), (2, 5, "assistant", "first")]


def test_chat_odd_rows(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string").withColumns({"start": F.lit(1), "segment": F.lit("x"), "body": F.lit(2)})
    turns = chat.format_turns(table)
    rows = defaultdict(list)
    for c, t, r, x in ODD_TURNS:
        rows[c].append((t, r, x))
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.read_back(turns).collect()}
    assert got == {k: digests(v) for k, v in rows.items()}
    examples = {(x.conv_id, x.example): x for x in chat.full_examples(turns).collect()}
    assert len(examples) == 4
    x = examples[1, 1]
    assert chat.unescape(x.text[x.loss_start : x.loss_end]) == "again"
    assert x.text.startswith(examples[1, 0].text)
    empty = chat.format_turns(table.limit(0))
    assert chat.read_back(empty).count() == chat.full_examples(empty).count() == 0
