"""Exact deduplication by two passes over a Bloom filter of text digests.

Pass one sends a few bytes a row: every partition turns the digests of its texts
into positions of two bit planes, "seen" and "seen again", and the planes are
merged segment by segment.  Pass two probes the "seen again" plane.  A text that
occurs twice always has all its positions set, so rows that miss are certainly
unique: they pass straight through, without a shuffle.  Only the rest, the true
repeats and a few false alarms, meet by digest.

The plane that is broadcast has a size bound (``max_bits``).  Under the bound it
has about ``bits_per_row`` bits a row; beyond, more rows raise false alarms and
their digests (40 bytes a row, no text) shuffle, until in the limit all do:
results are the same at any size.  ``exact_dedup``, which moves texts, makes a
second plane of the digests that did repeat, whose size follows their number
alone, so unique texts pass straight through however full the first plane is.

A digest that many rows share is hot.  At most ``HOT_SHARE`` digests can each
hold more than one in ``HOT_SHARE`` of the repeats; those are broadcast, and their
rows need no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, fresh, giving_back

BITS_PER_ROW = 16
#: 64 MB of bits at most are broadcast.
MAX_BITS = 1 << 29
#: Bits that one merge task holds.
SEGMENT = 1 << 20
HASHES = 2
#: Texts that are lowered at once, beside a batch that is held anyway.
ROWS_AT_ONCE = 64
#: A digest is hot with more than one in so many of all repeats, so no more digests than this are.
HOT_SHARE = 1000


def _digests(column: pa.Array) -> pa.Array:
    found: list[bytes] = []
    for start in range(0, len(column), ROWS_AT_ONCE):
        lowered = pc.ascii_lower(pc.fill_null(column.slice(start, ROWS_AT_ONCE), "")).cast(pa.binary())
        found += [hashlib.sha256(x.as_buffer()).digest() for x in lowered]
    return pa.array(found, pa.binary())


@F.arrow_udf(T.BinaryType())
def text_digest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """SHA-256 of a text after lower-casing A to Z only; null counts as empty."""
    yield from giving_back(lambda batches: map(_digests, batches))(texts)


def _positions(digests: pa.Array, bits: int) -> np.ndarray:
    """Bit positions of each digest; every hash has its own part of the plane."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(-1, 4)[:, :HASHES]
    part = np.uint64(bits // HASHES)
    return (raw & (part - np.uint64(1))) + part * np.arange(HASHES, dtype=np.uint64)


def plane_bits(rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, max(SEGMENT, 1 << max(1, rows * bits_per_row - 1).bit_length()))


def repeat_plane(digests: DataFrame, rows: int, max_bits: int = MAX_BITS, least: int = 2) -> np.ndarray:
    """Packed bits of the plane "seen again" over the only column of ``digests``; with least=1, of the plane "seen".

    At most ``max_bits`` bits reach the driver.
    """
    bits = plane_bits(rows, max_bits=max_bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0, np.uint64)]
        held = 0

        def flush():
            at, times = np.unique(np.concatenate(seen), return_counts=True)
            segment = (at // np.uint64(SEGMENT)).astype(np.int64)
            place = (at % np.uint64(SEGMENT)).astype("<u4")
            cuts = np.flatnonzero(np.diff(segment)) + 1
            heads = np.concatenate([[0], cuts]) if len(at) else np.zeros(0, np.int64)
            parts = list(zip(np.split(place, cuts), np.split(times >= least, cuts), strict=True)) if len(at) else []
            columns = [pa.array(segment[heads]), pa.array([x.tobytes() for x, _ in parts], pa.binary()), pa.array([x[t].tobytes() for x, t in parts], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["segment", "once", "twice"])

        for batch in batches:
            if batch.num_rows:
                seen.append(_positions(batch.column(0), bits).ravel())
                held += batch.num_rows
            if held >= 1 << 20:
                yield flush()
                seen, held = [np.zeros(0, np.uint64)], 0
        yield flush()

    def merge(parts: pa.Table) -> pa.Table:
        once, twice = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
        for a, b in zip(parts.column("once"), parts.column("twice"), strict=True):
            at = np.frombuffer(a.as_buffer(), "<u4")
            twice[at[once[at]]] = True
            once[at] = True
            twice[np.frombuffer(b.as_buffer(), "<u4")] = True
        return pa.table({"segment": parts.column("segment").slice(0, 1), "plane": pa.array([np.packbits(twice).tobytes()], pa.binary())})

    merged = digests.mapInArrow(giving_back(mark), "segment long, once binary, twice binary").groupBy("segment").applyInArrow(merge, "segment long, plane binary")
    plane = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        at = row["segment"] * SEGMENT // 8
        plane[at : at + SEGMENT // 8] = np.frombuffer(row["plane"], np.uint8)
    return plane


def _probe(df: DataFrame, plane: np.ndarray) -> Callable[[pa.Array], pa.Array]:
    """Whether the plane has all positions of each digest."""
    shared = df.sparkSession.sparkContext.broadcast(plane)

    def maybe(digests: pa.Array) -> pa.Array:
        bits = shared.value
        if not len(digests):
            return pa.array([], pa.bool_())
        at = _positions(digests, len(bits) * 8)
        hit = (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1
        return pa.array(hit.all(axis=1))

    return maybe


def flag_repeats(df: DataFrame, plane: np.ndarray, digest: str, flag: str) -> DataFrame:
    """Add a boolean: false for rows whose digest certainly occurs once."""
    return df.withColumn(flag, F.arrow_udf(_probe(df, plane), T.BooleanType())(F.col(digest)))


def _digest_in_plane(docs: DataFrame, plane: np.ndarray, digest: str) -> DataFrame:
    """Add the digest of the text, null where the plane certainly lacks it: one pass through Python, not two in a row."""
    maybe = _probe(docs, plane)

    def found(text: pa.Array) -> pa.Array:
        digests = _digests(text)
        return pc.if_else(maybe(digests), digests, None)

    @F.arrow_udf(T.BinaryType())
    def in_plane(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from giving_back(lambda batches: map(found, batches))(texts)

    # Said to be nondeterministic, as a filter on its result would otherwise move below it and hash every text again.
    return docs.withColumn(digest, in_plane.asNondeterministic()(F.col("text")))


def _hot(groups: DataFrame) -> DataFrame:
    """The groups that hold more than one in HOT_SHARE of the repeats: fewer than HOT_SHARE rows."""
    every = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first()["n"]
    return groups.filter(F.col("group_size") * HOT_SHARE > every)


def _meet(rows: DataFrame, groups: DataFrame, digest: str) -> DataFrame:
    """Join rows with the group of their digest: the hot ones by broadcast, the rest by shuffle."""
    hot = durable(_hot(groups))
    cold = groups.join(F.broadcast(hot), digest, "left_anti")
    rest = rows.join(F.broadcast(hot.select(digest)), digest, "left_anti").join(cold, digest)
    return rows.join(F.broadcast(hot), digest).unionByName(rest)


def _groups(thin: DataFrame, doc: str, digest: str) -> DataFrame:
    return durable(thin.groupBy(digest).agg(F.max(doc).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))


def duplicate_report(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row a row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (after lower-casing A to Z) the row with the largest doc_id
    stays.  A null text is the empty text; a null doc_id ranks below all others;
    rows that share both doc_id and text are all reported alike.  Other columns
    of the input are ignored.  An empty table gives no rows.
    """
    thin = durable(docs.select("doc_id", text_digest("text").alias("sha")))
    thin = flag_repeats(thin, repeat_plane(thin.select("sha"), thin.count(), max_bits), "sha", "again")
    again = durable(thin.filter("again").select("doc_id", "sha"))
    groups = _groups(again, "doc_id", "sha")
    one = [F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")]
    alone = thin.filter(~F.col("again")).select("doc_id", *one, "sha")
    false_alarms = again.join(groups, "sha", "left_anti").select("doc_id", *one, "sha")
    met = _meet(again, groups, "sha").select("doc_id", "keep_id", "group_size", "sha")
    rows = alone.unionByName(false_alarms).unionByName(met)
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see duplicate_report.

    Of rows that share both doc_id and text, one stays.  Losers of hot digests are
    dropped where they are read; texts that do not repeat never shuffle.
    """
    own = docs.columns
    sha, again = fresh(own, "sha"), fresh(own, "again")
    keep = fresh(own, "keep")
    digest = text_digest(F.col("text")).alias(sha)
    thin = durable(docs.select("doc_id", digest))
    alarms = flag_repeats(thin, repeat_plane(thin.select(sha), thin.count(), max_bits), sha, again).filter(again)
    groups = _groups(alarms, "doc_id", sha)
    plane = repeat_plane(groups.select(sha), groups.count(), max_bits, least=1)
    rows = _digest_in_plane(docs, plane, sha)
    alone = rows.filter(F.col(sha).isNull()).select(*own)
    hot = durable(_hot(groups).select(sha, F.col("keep_id").alias(keep)))
    cold = groups.select(sha, F.col("keep_id").alias(keep)).join(F.broadcast(hot.select(sha)), sha, "left_anti")
    stays = F.col("doc_id").eqNullSafe(F.col(keep))
    again_rows = rows.filter(F.col(sha).isNotNull())
    hot_rows = again_rows.join(F.broadcast(hot), sha).filter(stays).dropDuplicates([sha])
    # A row that only raised a false alarm has no group: it stays, and no other row has its digest.
    met = fresh(own, "met")
    rest = again_rows.join(F.broadcast(hot.select(sha)), sha, "left_anti").join(cold.withColumn(met, F.lit(True)), sha, "left")
    rest = rest.filter(F.col(met).isNull() | stays).dropDuplicates([sha])
    return alone.unionByName(hot_rows.select(*own)).unionByName(rest.select(*own))
