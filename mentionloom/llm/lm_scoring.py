"""Stupid-backoff scores over n-gram count tables partitioned by hash.

``count_table`` gives the counts of all n-grams of a corpus as rows (gram, count),
and ``score_texts`` joins any texts' exploded n-grams with them.

``backoff_scores`` scores a corpus by itself, where every n-gram is both counted
and asked for.  Row by row that would move each occurrence twice; so the rows of
its tables hold runs of n-grams of one partition and one block, in sorted and
compressed columns.  Documents are dealt into blocks of a few MB.  Each block explodes its words into
n-grams of every order up to the model's and sends their distinct hashes, with
counts, to the partitions of the count table that own them.  A partition sums the
counts of its n-grams over all blocks and answers every block with the totals of
the n-grams it asked for.  A block joins the answers to its own n-grams, scores
every word and sums per document.

Whatever repeats inside a block is sent once, so a frequent n-gram costs each
partition one entry a block; n-grams are spread by hash, so no word makes a
partition large.  Nothing is kept on the driver but one size, and the numbers of blocks,
partitions and tasks follow it.

A document is scored by what the others hold: its own counts are taken off.  The
score of a word is the share of its longest known context that it follows; each
shorter context than the place allows costs a factor ``backoff``.  A word that no
other document holds counts as one in all their words and one more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, give_back, slices, total_text_bytes, utf8_buffer
from .wordblock import Words, mix, words_of


@dataclass(frozen=True)
class BackoffRules:
    order: int = 3
    backoff: float = 0.4
    #: Text of one block, and n-grams of one partition of the count table, about.
    block_bytes: int = 5 << 20
    partition_grams: int = 2_000_000


#: Blocks that one task works on, one after the other, about.
BLOCKS_A_TASK = 2
#: Bits of an n-gram's key.  Two of n distinct n-grams share a key with a chance of n / 2**56 for each.
KEY_BITS = 56
_CUT = np.uint64(64 - KEY_BITS)
#: Key of the empty n-gram, whose count is the number of all words.
_EMPTY = np.uint64(0x5851F42D4C957F2D) >> _CUT


def _pack(values: np.ndarray) -> bytes:
    """Little-endian integers, byte planes apart, deflated."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _grams(words: Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1: the first words of the n-grams, and their keys."""
    out, grams = [], words.words
    for n in range(1, order + 1):
        grams = words.extend(grams, n) if n > 1 else grams
        at = words.windows(n)
        out.append((at, mix(grams[at] + np.uint64(n)) >> _CUT))
    return out


def _block_of(table: pa.Table) -> Words:
    column = table.column("text").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return words_of(*utf8_buffer(column), lower=True)


def _distinct(words: Words, grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(np.concatenate([k for _, k in grams]), return_counts=True)
    at = int(np.searchsorted(keys, _EMPTY))
    return np.insert(keys, at, _EMPTY), np.insert(counts, at, len(words.words))


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each partition's keys end; a key's partition is its first bits."""
    if not bits:
        return np.array([len(keys)])
    return np.append(np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(KEY_BITS - bits)), len(keys))


def _longest_run(words: Words, known: np.ndarray, order: int) -> np.ndarray:
    """The most words of each text in a row that known n-grams, by their first words, cover."""
    out = np.zeros(len(words.counts), np.int64)
    at = np.flatnonzero(known)
    if len(at):
        cut = np.append(True, (np.diff(at) > 1) | (np.diff(words.doc[at]) > 0))
        first = np.flatnonzero(cut)
        np.maximum.at(out, words.doc[at[first]], np.diff(np.append(first, len(at))) + order - 1)
    return out


def _score(words: Words, grams, totals: np.ndarray, everything: int, rules: BackoffRules) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log scores of each text, and its longest run of words in n-grams of full order that others hold.

    totals: of the block's distinct keys in order; everything: number of all words.
    """
    n_words, docs = len(words.words), len(words.counts)
    if not n_words:
        return np.zeros(docs), np.zeros(docs, np.int64)
    keys = np.concatenate([k for _, k in grams])
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.append(True, ordered[1:] != ordered[:-1])
    run = np.cumsum(first) - 1
    total, own = np.empty(len(keys), np.int64), np.ones(len(keys), np.int64)
    total[order] = totals[run]
    # What a document itself holds: only n-grams that the block repeats need counting.
    length = np.diff(np.append(np.flatnonzero(first), len(keys)))
    repeated = length[run] > 1
    at, doc = order[repeated], np.concatenate([words.doc[x] for x, _ in grams])
    pair = run[repeated] * docs + doc[at]
    inner = np.argsort(pair)
    ordered = pair[inner]
    if len(ordered):
        first = np.append(True, ordered[1:] != ordered[:-1])
        own[at[inner]] = np.diff(np.append(np.flatnonzero(first), len(ordered)))[np.cumsum(first) - 1]
    others, low = [], 0
    for at, _ in grams:
        spread = np.full(n_words, -1, np.int64)
        spread[at] = (total - own)[low : low + len(at)]
        low += len(at)
        others.append(spread)
    outside = everything - words.counts[words.doc]
    result = np.log(np.where(others[0] > 0, others[0], 1) / np.where(others[0] > 0, outside, outside + 1))
    for n in range(2, rules.order + 1):
        if n_words < n:
            break
        gram, context = others[n - 1][: n_words - n + 1], others[n - 2][: n_words - n + 1]
        known, possible = gram > 0, gram >= 0
        longer = np.log(np.where(known, gram, 1) / np.where(known, context, 1))
        tail = result[n - 1 :]
        result[n - 1 :] = np.where(known, longer, np.where(possible, tail + np.log(rules.backoff), tail))
    return np.bincount(words.doc, weights=result, minlength=docs), _longest_run(words, others[-1] > 0, rules.order)


def count_table(docs: DataFrame, rules: BackoffRules = BackoffRules()) -> DataFrame:
    """The counts of all n-grams up to the model's order: gram (key), count; the empty n-gram's is the number of words.

    Each run of about a MB of text is counted before it shuffles, and rows are
    spread by the hash of the n-gram.  Null and empty texts add nothing but the
    empty n-gram; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                words = words_of(*utf8_buffer(rows.column("text")), lower=True)
                keys, counts = _distinct(words, _grams(words, rules.order))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["gram", "count"])
        give_back()

    return docs.select("text").mapInArrow(run, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count"))


def score_texts(docs: DataFrame, counts: DataFrame, rules: BackoffRules = BackoffRules()) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, log_score, mean_log_score, by the n-grams of a ``count_table``.

    For texts outside the counted corpus (nothing is taken off).  Every word's
    n-grams and their contexts are exploded and joined with the counts; the
    longest one known scores the word.  Nulls, repeats and empty tables as in
    backoff_scores.  A word that the corpus lacks counts as one in all its words and one more.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows in slices(batch):
                words = words_of(*utf8_buffer(rows.column("text")), lower=True)
                grams = _grams(words, rules.order)
                contexts = [np.full(len(words.words), _EMPTY, np.uint64)]
                for at, keys in grams[:-1]:
                    spread = np.zeros(len(words.words), np.uint64)
                    spread[at] = keys
                    contexts.append(spread)
                # The word that an n-gram scores is its last.
                place = np.concatenate([at + n for n, (at, _) in enumerate(grams)])
                own = np.concatenate([k for _, k in grams])
                before = np.concatenate([contexts[n][at] for n, (at, _) in enumerate(grams)])
                order = np.concatenate([np.full(len(at), n + 1) for n, (at, _) in enumerate(grams)])
                blank = np.flatnonzero(words.counts == 0)
                doc = np.concatenate([words.doc[place], blank])
                index = pa.array(doc)
                none = np.arange(len(doc)) >= len(place)

                def column(values, padding=0, none=none):
                    return pa.array(np.concatenate([values, np.full(none.sum(), padding, values.dtype)]).astype(np.int64), mask=none)

                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(index), pa.array(row + doc), pa.array(words.counts[doc].astype(np.int64)), column(place - words.word_offsets[words.doc[place]]), column(order), column(own), column(before)],
                    ["doc_id", "row", "n_words", "place", "n", "gram", "context"],
                )
                row += rows.num_rows
        give_back()

    grams = docs.select("doc_id", "text").mapInArrow(explode, f"doc_id {kind}, row long, n_words long, place long, n long, gram long, context long")
    counts = durable(counts)
    everything = counts.filter(F.col("gram") == int(_EMPTY)).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    known = grams.join(counts, "gram", "left").join(counts.select(F.col("gram").alias("context"), F.col("count").alias("whole")), "context", "left")
    least = F.lit(1.0 / (everything + 1))
    share = F.when(F.col("n") == 1, F.coalesce(F.col("count") / F.lit(max(everything, 1)), least)).otherwise(F.col("count") / F.col("whole"))
    # The longest known n-gram; the order-1 one always counts, with its floor.
    best = F.max_by(F.struct("n", share.alias("share")), F.when(F.col("count").isNotNull() | (F.col("n") == 1), F.col("n")))
    longest = F.least(F.col("place") + 1, F.lit(rules.order))
    words = known.groupBy("row", "doc_id", "n_words", "place").agg(best.alias("best"))
    log = F.log("best.share") + (longest - F.col("best.n")) * float(np.log(rules.backoff))
    sums = words.groupBy("row", "doc_id", "n_words").agg(F.sum(log).alias("log_score"))
    return sums.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("log_score")).alias("log_score"), F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))


def backoff_scores(docs: DataFrame, rules: BackoffRules = BackoffRules()) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, log_score (sum), mean_log_score, longest_known.

    longest_known is the most words in a row that n-grams of full order cover that
    other documents hold: long passages that repeat across documents show in it.  Words are split at white space, A to Z lowered.  A null, empty or blank text
    has no words and null scores; it adds nothing to the counts.  Repeated rows
    count as documents of their own, and so support each other.  Other columns are
    ignored; an empty table gives no rows.
    """
    size = total_text_bytes(docs)
    blocks = max(1, -(-size // rules.block_bytes))
    bits = max(0, int(np.ceil(np.log2(max(1.0, size / 6 * rules.order / rules.partition_grams)))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Equal rows of different places go to different blocks, however many they are.
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks))
    tasks = -(-blocks // BLOCKS_A_TASK)
    rows = docs.select("doc_id", "text", block.alias("block")).repartition(tasks, "block")

    def ask(table: pa.Table) -> pa.Table:
        words = _block_of(table)
        keys, counts = _distinct(words, _grams(words, rules.order))
        low, out = 0, []
        for part, high in enumerate(_cuts(keys, bits)):
            if high > low:
                own = keys[low:high].copy()
                own[1:] -= keys[low : high - 1]
                out.append((part, high - low, _pack(own), _pack(counts[low:high].astype("<u4"))))
            low = high
        block = table.column("block")[0].as_py()
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([block] * len(out), pa.int64()), *(pa.array([x[i] for x in out], t) for i, t in ((1, pa.int64()), (2, pa.binary()), (3, pa.binary())))], ["part", "block", "n", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(_unpack(x.as_buffer(), n, "<u8"), dtype=np.uint64) for x, n in zip(table.column("keys"), sizes, strict=True)])
        counts = np.concatenate([_unpack(x.as_buffer(), n, "<u4") for x, n in zip(table.column("counts"), sizes, strict=True)])
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.append(True, ordered[1:] != ordered[:-1])
        sums = np.add.reduceat(counts[order].astype(np.uint64), np.flatnonzero(first))
        totals = np.empty(len(keys), np.uint64)
        totals[order] = sums[np.cumsum(first) - 1]
        cut = np.cumsum(sizes)[:-1]
        return pa.table([table.column("block"), table.column("part"), table.column("n"), pa.array([_pack(x) for x in np.split(totals, cut)], pa.binary())], ["block", "part", "n", "totals"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "log_score", "mean_log_score", "longest_known"]
        words = _block_of(left)
        grams = _grams(words, rules.order)
        found = sorted(zip(right.column("part").to_pylist(), right.column("n").to_pylist(), right.column("totals"), strict=True), key=lambda x: x[0])
        totals = np.concatenate([_unpack(x.as_buffer(), n, "<u8") for _, n, x in found]).astype(np.int64)
        # The answers come in the order of the keys, so the empty n-gram's place is known from those below it.
        keys = np.unique(np.concatenate([k for _, k in grams]))
        empty = int(np.searchsorted(keys, _EMPTY))
        if len(totals) != len(keys) + 1:
            raise ValueError("answers don't match the block")
        everything = int(totals[empty])
        sums, longest = _score(words, grams, np.delete(totals, empty), everything, rules)
        none = words.counts == 0
        give_back()
        mean = sums / np.maximum(words.counts, 1)
        return pa.table([left.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(sums, mask=none), pa.array(mean, mask=none), pa.array(longest)], names)

    asked = rows.groupBy("block").applyInArrow(ask, "part long, block long, n long, keys binary, counts binary")
    answers = asked.repartition(1 << bits, "part").groupBy("part").applyInArrow(answer, "block long, part long, n long, totals binary")
    return rows.groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_words long, log_score double, mean_log_score double, longest_known long")
