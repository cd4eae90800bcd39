"""Language identification by rank-order profiles.

A language's profile lists its most frequent character n-grams in order; a
document's own list is compared with each by out-of-place distance: how far every
n-gram lies from its place in the profile, with a fixed penalty for those that the
profile lacks.  The nearest profile wins.

Learning counts the n-grams of all labelled training documents: partial counts in
numpy, summed by Spark; only the profiles (languages times their length) reach the
driver.  Prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, slices

UNDETERMINED = "und"
#: Values of lang that can be learnt at most: this bounds what is gathered and broadcast (length entries each).
MAX_LANGUAGES = 256
_SHIFT = np.uint64(21)
_letters: np.ndarray | None = None


@dataclass(frozen=True)
class ProfileRules:
    #: Entries of a profile.
    length: int = 400
    longest_gram: int = 3


@dataclass(frozen=True)
class Profiles:
    """languages in order; grams sorted; places[i, k] is the place of gram k in profile i, or the penalty."""

    languages: tuple[str, ...]
    grams: np.ndarray
    places: np.ndarray
    rules: ProfileRules


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _letters_of(text: str) -> np.ndarray:
    """Lower-cased code points, with each run of others as one blank, and blanks at both ends; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.concatenate([[32], np.where(_letter_table()[points], points, 32), [32]]).astype(np.uint64)
    blank = points == 32
    if blank.all():
        return np.zeros(0, np.uint64)
    return points[~(blank & np.concatenate([[False], blank[:-1]]))]


def _grams(points: np.ndarray, longest: int) -> np.ndarray:
    """Keys of all n-grams; a lone blank is none."""
    keys = [points[points != 32]]
    gram = points
    for n in range(2, longest + 1):
        gram = (gram[: len(points) - n + 1] << _SHIFT) | points[n - 1 :]
        keys.append(gram)
    return np.concatenate(keys)


def learn_profiles(labelled: DataFrame, rules: ProfileRules = ProfileRules()) -> Profiles:
    """Profiles of the values of ``lang`` from all rows of (text, lang) with both; raises on more than MAX_LANGUAGES."""
    longest = rules.longest_gram
    if labelled.filter("lang IS NOT NULL").select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, limit=1 << 19):
                by_lang: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(_grams(_letters_of(text), longest))
                for lang, keys in by_lang.items():
                    gram, times = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(times.astype(np.int64))], ["lang", "gram", "times"])

    partial = labelled.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(giving_back(count), "lang string, gram long, times long")
    counts = partial.groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    order = Window.partitionBy("lang").orderBy(F.desc("times"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rules.length).select("lang", "gram", "place").collect()
    languages = tuple(sorted({x.lang for x in top}))
    grams = np.array(sorted({x.gram for x in top}), np.uint64)
    places = np.full((len(languages), len(grams)), -1, np.int32)
    for x in top:
        places[languages.index(x.lang), np.searchsorted(grams, np.uint64(x.gram))] = x.place - 1
    return Profiles(languages, grams, places, rules)


def classify(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """Language and score: 1 for a document whose list equals the profile, 0 for one with nothing in common."""
    points = _letters_of(text) if text else np.zeros(0, np.uint64)
    if not len(points) or not profiles.languages:
        return UNDETERMINED, 0.0
    length = profiles.rules.length
    gram, times = np.unique(_grams(points, profiles.rules.longest_gram), return_counts=True)
    own = gram[np.lexsort((gram, -times))[:length]] if len(gram) > 1 else gram
    at = np.minimum(np.searchsorted(profiles.grams, own), len(profiles.grams) - 1)
    known = profiles.grams[at] == own
    places = profiles.places[:, at]
    far = np.where(known & (places >= 0), np.abs(places - np.arange(len(own))), length)
    total = far.sum(axis=1)
    best = int(total.argmin())
    return profiles.languages[best], float(1 - total[best] / (length * len(own)))


def predict_language(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Add lang_pred and score to all rows and columns of ``docs``, from text alone.

    A null text, or one without a letter, gives ``und`` and score 0; so does every
    text when nothing was learnt.  Ties go to the first language in order.  Columns
    that already have these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages times profile length at most
    rows = docs.drop("lang_pred", "score")
    column = rows.columns.index("text")
    names = [*rows.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(x.as_py(), shared.value) for x in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names)

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame, rules: ProfileRules = ProfileRules()) -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, lang_pred, score.  Learns from the rows not held out."""
    profiles = learn_profiles(docs.filter(~held_out(F.col("doc_id"))), rules)
    return predict_language(docs.select("doc_id", "text"), profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_filter(docs: DataFrame, rules: ProfileRules = ProfileRules(), least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` in a learnt language, and with a score of least_score at least; all their columns.

    Learns from all rows with a lang: nothing is measured here, so none is held
    out, and a language that few rows name is learnt too.  A null text, or one
    without a letter, has no language and goes; so does one that shares no n-gram
    with any profile (its score is 0), which no learnt language accounts for.
    Where nothing could be learnt (no row has a lang) every text with a letter
    stays: an unlabelled table is no reason to reject.  Ties between languages
    change nothing here; repeated rows are judged one by one; an empty table gives
    no rows.
    """
    own = docs.columns
    profiles = learn_profiles(docs, rules)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    column = own.index("text")

    def stays(text: str | None) -> bool:
        if not shared.value.languages:
            return bool(text) and len(_letters_of(text)) > 0
        _, score = classify(text, shared.value)
        return score > 0 and score >= least_score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, own[column]):
                yield rows.filter(pa.array([stays(x.as_py()) for x in rows.column(column)], pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)
