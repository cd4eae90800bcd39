"""Quality rules from repetition coverage.

For every text, rolling hashes of word n-grams of several lengths are compared
inside the text; the share of its characters that lie in n-grams or lines found
more than once decides.  All of it is numpy over the UTF-8 bytes of a few MB of
texts at a time: no shuffle, and memory bounded by the slice or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, utf8_buffer
from .wordblock import WordBlock, mix

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Limits; a text fails that is above one of them."""

    min_words: int = 10
    #: Share, in percent, of words in repeated windows of base_window words.
    base_window: int = 5
    base_percent: int = 20
    #: Share of word characters inside repeated n-grams, by n.
    gram_share: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    #: Share of lines equal to an earlier one, and of the word characters in them.
    line_share: float = 0.30
    line_char_share: float = 0.20


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Positions of the values that occur more than once."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    shift = np.uint64(64 - min(24, max(8, int(len(keys)).bit_length() + 1)))
    marked = np.zeros(1 << int(64 - shift), bool)
    marked[twice >> shift] = True
    at = np.flatnonzero(marked[keys >> shift])
    near = np.minimum(np.searchsorted(twice, keys[at]), len(twice) - 1)
    return at[twice[near] == keys[at]]


def measure(data: np.ndarray, offsets: np.ndarray, rules: RepetitionRules = RepetitionRules()) -> dict[str, np.ndarray]:
    """Counts and shares of each text, as arrays."""
    block = WordBlock(data, offsets)
    docs = len(offsets) - 1
    chars = block.characters()
    length = chars[block.ends] - chars[block.starts]
    word_chars = block.per_doc(length)
    symbols = np.flatnonzero(_SYMBOL[data])
    out = {"n_words": block.counts.astype(np.int64), "word_chars": word_chars, "n_symbols": np.diff(np.searchsorted(symbols, offsets)).astype(np.int64)}
    salt = mix(np.arange(1, docs + 1, dtype=np.uint64))
    words_to = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=words_to[1:])

    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    newline = np.append(np.flatnonzero(data == 10), len(data))
    of = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(newline[np.searchsorted(newline, starts)], offsets[of + 1])
    first, last = np.searchsorted(block.starts, starts), np.searchsorted(block.starts, ends)
    with_word = last > first
    starts, ends, of, first, last = (x[with_word] for x in (starts, ends, of, first, last))
    _, once = np.unique(mix(block.span_hash(starts, ends) ^ salt[of]), return_index=True)
    copy = np.ones(len(starts), bool)
    copy[once] = False
    lines = np.bincount(of, minlength=docs)
    out["n_lines"] = lines.astype(np.int64)
    out["n_dup_lines"] = np.bincount(of[copy], minlength=docs).astype(np.int64)
    out["dup_line_chars"] = np.bincount(of[copy], weights=(words_to[last] - words_to[first])[copy], minlength=docs).astype(np.int64)

    longest = max([rules.base_window, *(n for n, _ in rules.gram_share)])
    wanted = {n for n, _ in rules.gram_share}
    grams = block.words
    over = np.zeros(docs, bool)
    total = np.maximum(word_chars, 1)
    for n in range(1, longest + 1):
        grams = block.extend(grams, n) if n > 1 else grams
        if n != rules.base_window and n not in wanted:
            continue
        at = block.windows(n)
        again = at[_repeated(mix(grams[at] ^ salt[block.doc[at]]))]
        step = np.bincount(again, minlength=len(length) + 1) - np.bincount(again + n, minlength=len(length) + 1)[: len(length) + 1]
        covered = np.cumsum(step)[: len(length)] > 0
        if n == rules.base_window:
            out["n_repeat_words"] = block.per_doc(covered)
        if n in wanted:
            out[f"gram{n}_chars"] = block.per_doc(length * covered)
            over |= out[f"gram{n}_chars"] / total > dict(rules.gram_share)[n]
    over |= out["n_dup_lines"] > rules.line_share * lines
    over |= out["dup_line_chars"] > rules.line_char_share * word_chars
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.base_percent * out["n_words"])
    out["kept"] = ~(out["base_failed"] | over)
    return out


def repetition_report(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row a row of ``docs``: doc_id, base counts, base_failed, kept, then the other counts of ``measure``.

    A null or empty text has no words and fails for that.  Repeated rows are
    judged one by one; other columns are ignored; an empty table gives no rows.
    """
    grams = [f"gram{n}_chars" for n, _ in rules.gram_share]
    base, verdicts, rest = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], ["base_failed", "kept"], ["n_lines", "dup_line_chars", *grams]
    names = [*base, *verdicts, *rest]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                found = measure(*utf8_buffer(rows.column("text")), rules)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(found[x]) for x in names)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, {', '.join(f'{x} {"boolean" if x in verdicts else "long"}' for x in names)}")


def quality_filter(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns; no shuffle.

    Null, empty and short texts fail; repeated rows are judged one by one; an
    empty table gives no rows.
    """
    columns = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, columns.index("text")):
                yield rows.filter(pa.array(measure(*utf8_buffer(rows.column(columns.index("text"))), rules)["kept"]))

    return docs.mapInArrow(keep, docs.schema)
