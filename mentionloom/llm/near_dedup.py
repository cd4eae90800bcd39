"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct word shingles.  Its sketch has one register
per hash function: the least exponential hash of the set, truncated to the scale
1, 1/b, 1/b^2, ...  Sketches merge by the larger register, and two registers are
equal about as often as the sets overlap.

1. Documents with equal sets fall together into classes, by a digest of the set.
2. Bands of registers deal the classes into buckets.
3. Inside a bucket, two classes are compared only in the first band they share.
   The similarity is estimated by maximum likelihood from how many registers are
   larger, smaller and equal, given both set sizes; pairs clearly below the
   threshold go.  A bucket too large for one task is cut into chunks, first
   compared each in itself (and dealt anew in every bucket); where a bucket still
   holds several large components, one class of each meets those of the others; what is still unconnected after that meets in blocks of two chunks,
   where components that fill a chunk or more keep chunks of their own and skip
   themselves: no cap, no pair lost, and no square of a group that holds together.
4. For blocks with a likely pair, the full sets are fetched and every pair is
   verified, the likeliest first, skipping those that are connected already.
5. Verified links are joined to components.

With 32 bands of 8 registers a pair at similarity 0.85 meets with a chance above
0.9999, and the estimate's margin of four standard deviations keeps it as surely.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, fresh, giving_back, slices, utf8_buffer
from .components import connected_components
from .wordblock import WordBlock, mix


@dataclass(frozen=True)
class NearRules:
    shingle: int = 5
    #: Similarity in percent, at least.
    percent: int = 80
    bands: int = 32
    rows: int = 8
    base: float = 1.1
    #: Classes of a bucket that one task compares at once, about, and the bytes of their sets; twice as many meet in a block.
    chunk: int = 512
    chunk_bytes: int = 16 << 20

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def floor(self) -> float:
        """Least estimate that is worth a verification."""
        j = self.percent / 100
        return j - 4 * float(np.sqrt(j * (1 - j) / self.registers))


_SEED = np.random.Generator(np.random.PCG64(7))
_A = _SEED.integers(0, 2**31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _SEED.integers(0, 2**32, 4096, dtype=np.uint32)
#: Rate of the exponential hashes; the larger, the longer small sets stay above register 0.
RATE = 20.0


def shingle_sets(block: WordBlock, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words has its whole sequence as one."""
    grams = block.words
    levels = [grams]
    for n in range(2, size + 1):
        grams = block.extend(grams, n)
        levels.append(grams)
    for first, count in zip(block.word_offsets[:-1], block.counts, strict=True):
        if count == 0:
            yield np.zeros(0, np.uint64)
        elif count < size:
            yield mix(levels[count - 1][first : first + 1] + np.uint64(count))
        else:
            yield np.unique(mix(grams[first : first + count - size + 1] + np.uint64(size)))


def sketch(hashes: np.ndarray, registers: int, base: float = 1.1) -> np.ndarray:
    """One byte a register."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(registers, 2**32 - 1, np.uint32)
    a, b = _A[:registers], _B[:registers]
    for i in range(0, len(x), 512):
        part = x[i : i + 512, None] * a
        part += b
        np.minimum(least, part.min(axis=0), out=least)
    value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(base)), 0, 255).astype(np.uint8)


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimate(larger: np.ndarray, smaller: np.ndarray, registers: int, n_a: np.ndarray, n_b: np.ndarray, base: float = 1.1) -> np.ndarray:
    """Likeliest similarity of pairs, from the registers larger in a, those larger in b, and both set sizes."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    equal = registers - larger - smaller

    def chance(x):
        return -np.log1p(-np.maximum(x, 1e-9) * (base - 1) / base) / np.log(base)

    best, at = np.full(len(u), -np.inf), np.zeros(len(u), np.int64)

    def look(step):
        nonlocal best, at
        j = step / 100 * most
        p, q = chance(u - v * j), chance(v - u * j)
        score = larger * np.log(p) + smaller * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))
        at = np.where(score > best, step, at)
        best = np.maximum(best, score)

    # The likelihood has one peak: every tenth of a grid of 101, then the grid around the best of them.
    for step in range(0, 101, 10):
        look(np.full(len(u), step))
    middle = at
    for step in range(-9, 10):
        look(np.clip(middle + step, 0, 100))
    return at / 100 * most


def _sketched(docs: DataFrame, rules: NearRules) -> DataFrame:
    """doc_id, n_shingles, set digest and registers (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                block = WordBlock(*utf8_buffer(rows.column("text")), lower=True)
                sizes, digests, registers = [], [], []
                for own in shingle_sets(block, rules.shingle):
                    sizes.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    registers.append(sketch(own, rules.registers, rules.base).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())], ["doc_id", "n", "set", "registers"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, n long, set binary, registers binary")


def _sets(docs: DataFrame, rules: NearRules) -> DataFrame:
    """set digest and the whole set, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                block = WordBlock(*utf8_buffer(rows.column("text")), lower=True)
                found = [x for x in shingle_sets(block, rules.shingle) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["set", "members"])

    return docs.select("text").mapInArrow(giving_back(run), "set binary, members binary")


def _parts(batches: Iterator[pa.RecordBatch], rows_at_once: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to so many rows and about 8 MB of sets."""
    for batch in batches:
        column = "members" if "members" in batch.schema.names else "registers"
        for rows in slices(batch, column, 1 << 23):
            for start in range(0, rows.num_rows, rows_at_once):
                yield rows.slice(start, rows_at_once)


def _whole_blocks(batches: Iterator[pa.RecordBatch], rows_at_once: int = 2048) -> Iterator[pa.Table]:
    """Runs of whole blocks from batches that are sorted by block."""
    key = ["bucket", "low", "high"]
    held: list[pa.RecordBatch] = []
    for part in _parts(batches, rows_at_once):
        columns = [part.column(x).to_numpy() for x in key]
        new = np.zeros(part.num_rows, bool)
        for x in columns:
            new[1:] |= x[1:] != x[:-1]
        if held and any(held[-1].column(x)[-1].as_py() != c[0] for x, c in zip(key, columns, strict=True)):
            new[0] = True
        cuts = np.flatnonzero(new)
        if len(cuts):
            if held or cuts[-1]:
                yield pa.Table.from_batches([*held, part.slice(0, cuts[-1])])
            held = [part.slice(cuts[-1])]
        else:
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _likely_pairs(rows: pa.Table, rules: NearRules, first_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) of the same block and different roots whose estimate is worth a verification, with it.

    first_only: leave pairs that share an earlier band to that band's bucket.
    """
    n = rows.num_rows
    registers = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint8).reshape(n, rules.registers)
    bands = registers.view(np.uint64) if rules.rows == 8 else None
    band, sizes = rows.column("band").to_numpy(), rows.column("n").to_numpy()
    chunk, low, high = (rows.column(x).to_numpy() for x in ("chunk", "low", "high"))
    bucket = rows.column("bucket").to_numpy()
    root = rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.ones(n, bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    start = np.flatnonzero(first)
    ends = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    near = rules.floor - 0.02
    for step in range(1, int((ends - np.arange(n)).max(initial=1))):
        i = np.flatnonzero(np.arange(n) + step < ends)
        j = i + step
        keep = ((low[i] == high[i]) | (chunk[i] != chunk[j])) & (root[i] != root[j])
        keep &= np.minimum(sizes[i], sizes[j]) * 100 >= rules.percent * np.maximum(sizes[i], sizes[j])
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 4096):
            a, b = i[k : k + 4096], j[k : k + 4096]
            ra, rb = registers[a], registers[b]
            equal = (ra == rb).sum(axis=1)
            ok = equal >= near * rules.registers
            if not ok.any():
                continue
            a, b, ra, rb = a[ok], b[ok], ra[ok], rb[ok]
            if first_only:
                if bands is not None:
                    shared = bands[a] == bands[b]
                else:
                    shared = (ra == rb).reshape(len(a), rules.bands, rules.rows).all(axis=2)
                ok = shared.argmax(axis=1) == band[a]
                a, b, ra, rb = a[ok], b[ok], ra[ok], rb[ok]
            likely = estimate((ra > rb).sum(axis=1), (ra < rb).sum(axis=1), rules.registers, sizes[a], sizes[b], rules.base)
            ok = likely >= rules.floor
            found.append((a[ok], b[ok], likely[ok]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")


def _flagged(blocks: DataFrame, rules: NearRules, first_only: bool) -> DataFrame:
    """The rows of blocks that take part in a likely pair: bucket, low, high, chunk, band, root, set."""
    names = ["bucket", "low", "high", "chunk", "band", "root", "set"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            i, j, _ = _likely_pairs(rows, rules, first_only)
            if len(i):
                yield from rows.take(pa.array(np.unique(np.concatenate([i, j])))).select(names).to_batches()

    return _in_blocks(blocks).mapInArrow(giving_back(run), "bucket long, low int, high int, chunk int, band int, root binary, set binary")


def _links(blocks: DataFrame, rules: NearRules, first_only: bool) -> DataFrame:
    """Verified links (u, v) that connect what is connected inside each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            i, j, likely = _likely_pairs(rows, rules, first_only)
            order = np.argsort(-likely, kind="stable")
            digests = rows.column("set").to_pylist()
            members = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("members")]
            parent = list(range(len(digests)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            out: tuple[list[bytes], list[bytes]] = ([], [])
            pairs = (x for k in range(0, len(order), 1 << 14) for x in zip(i[order[k : k + (1 << 14)]].tolist(), j[order[k : k + (1 << 14)]].tolist(), strict=True))
            for a, b in pairs:
                ra, rb = root(a), root(b)
                if ra == rb:
                    continue
                x, y = members[a], members[b]
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                if 100 * both >= rules.percent * (len(x) + len(y) - both):
                    parent[ra] = rb
                    out[0].append(digests[a])
                    out[1].append(digests[b])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], ["u", "v"])

    return _in_blocks(blocks).mapInArrow(giving_back(run), "u binary, v binary")


def _verified(blocks: DataFrame, classes: DataFrame, docs: DataFrame, rules: NearRules, first_only: bool = True) -> DataFrame:
    """Links (u, v) that connect, with ``root``s given, what is connected inside each block, settled.

    blocks: bucket, low, high, chunk, band, root, set.
    """
    own = classes.select("set", "n", "registers")
    flagged = durable(_flagged(blocks.join(own, "set"), rules, first_only))
    needed = flagged.select("set").distinct()
    sources = classes.join(needed, "set", "left_semi").select("rep").distinct()
    texts = docs.select("doc_id", "text").join(sources, docs["doc_id"].eqNullSafe(sources["rep"]), "left_semi")
    sets = durable(_sets(texts, rules).groupBy("set").agg(F.any_value("members").alias("members")))
    return durable(_links(flagged.join(own, "set").join(sets, "set"), rules, first_only))


def _chunks(rules: NearRules, rows: str, members: str):
    return F.greatest(F.ceil(F.col(rows) / rules.chunk), F.ceil(F.col(members) * 8 / rules.chunk_bytes)).cast("int")


def _rooted(wide: DataFrame, links: DataFrame) -> DataFrame:
    return durable(wide.join(connected_components(links), F.col("set") == F.col("node"), "left").select("bucket", "band", "set", "n", F.coalesce("root", "set").alias("root")))


def _across_chunks(wide: DataFrame, links: DataFrame, classes: DataFrame, docs: DataFrame, rules: NearRules) -> DataFrame:
    """The links that buckets of several chunks (wide: bucket, band, set, n) need beside those inside chunks; with the latter."""
    sizes = F.count(F.lit(1)).alias("held"), F.sum("n").alias("members")
    is_large = (F.col("held") * 2 >= rules.chunk) | (F.col("members") * 16 >= rules.chunk_bytes)

    def parted(rooted: DataFrame) -> DataFrame:
        return durable(rooted.groupBy("bucket", "root").agg(*sizes).withColumn("large", is_large))

    rooted = _rooted(wide, links)
    parts = parted(rooted)
    several = parts.filter("large").groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("bucket")
    if several.limit(1).count():
        # One class of each component and bucket meets those of the others, so that a group that holds together becomes one component.
        heads = rooted.join(several, "bucket", "left_semi").groupBy("bucket", "band", "root").agg(F.min_by(F.struct("set", "n"), "set").alias("head"))
        heads = durable(heads.select("bucket", "band", "root", "head.*"))
        many = heads.groupBy("bucket").agg(*sizes).filter("held > 1")
        heads = heads.join(many, "bucket").withColumn("chunk", F.pmod(F.xxhash64("set"), _chunks(rules, "held", "members")).cast("int"))
        links = links.unionByName(_verified(heads.select("bucket", F.col("chunk").alias("low"), F.col("chunk").alias("high"), "chunk", "band", "root", "set"), classes, docs, rules, first_only=False))
        rooted = _rooted(wide, links)
        parts = parted(rooted)
    # What stays apart meets pairwise; a component that fills a chunk has chunks of its own, which never meet each other.
    small = F.when(~F.col("large"), F.col("held")), F.when(~F.col("large"), F.col("members"))
    apart = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("roots"), F.sum(small[0]).alias("held"), F.sum(small[1]).alias("members")).filter("roots > 1")
    apart = apart.select("bucket", F.coalesce(_chunks(rules, "held", "members"), F.lit(0)).alias("mixed"))
    # Few components of a bucket are large: at most two for each chunk's worth of rows.
    order = Window.partitionBy("bucket").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    large = parts.filter("large").withColumn("own", _chunks(rules, "held", "members"))
    large = large.select("bucket", "root", "own", F.coalesce(F.sum("own").over(order), F.lit(0)).cast("int").alias("from"))
    total = large.groupBy("bucket").agg(F.sum("own").alias("more"))
    apart = durable(apart.join(total, "bucket", "left").select("bucket", "mixed", (F.col("mixed") + F.coalesce("more", F.lit(0))).cast("int").alias("total")))
    rows = rooted.join(apart, "bucket").join(durable(large), ["bucket", "root"], "left").withColumn("from", F.col("from") + F.col("mixed"))
    mine = F.col("from") + F.pmod(F.xxhash64("set"), F.col("own"))
    rows = rows.withColumn("chunk", F.coalesce(mine, F.pmod(F.xxhash64("root"), F.col("mixed"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda x: F.col("from").isNull() | (x < F.col("from")) | (x >= F.col("from") + F.col("own")))
    rows = rows.withColumn("other", F.explode(others))
    blocks = rows.select("bucket", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "band", "root", "set")
    return links.unionByName(_verified(blocks, classes, docs, rules))


def _labelled(docs: DataFrame, rules: NearRules) -> DataFrame:
    """As near_duplicates, with the set digest (null for empty sets)."""
    thin = durable(_sketched(docs, rules))
    classes = durable(thin.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.any_value("registers").alias("registers")))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(rules.bands - 1)), lambda k: F.substring("registers", k * rules.rows + 1, F.lit(rules.rows)))
    bands = classes.select("set", "n", F.posexplode(pieces).alias("band", "piece")).select("set", "n", "band", F.xxhash64("band", "piece").alias("bucket"))
    # Durable, so that the join below has a shuffle of its own on both sides and a hot bucket can be split.
    many = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("members")).filter("held > 1")
    many = durable(many.select("bucket", _chunks(rules, "held", "members").alias("chunks")))
    # Every bucket deals its chunks anew, so the bands unite a group across its chunks.
    rows = bands.join(many, "bucket").withColumn("chunk", F.pmod(F.xxhash64("set", "bucket"), F.col("chunks")).cast("int"))
    links = _verified(rows.select("bucket", F.col("chunk").alias("low"), F.col("chunk").alias("high"), "chunk", "band", F.col("set").alias("root"), "set"), classes, docs, rules)
    if many.filter("chunks > 1").limit(1).count():
        wide = durable(bands.join(many.filter("chunks > 1"), "bucket").select("bucket", "band", "set", "n"))
        links = _across_chunks(wide, links, classes, docs, rules)
    roots = connected_components(links)
    labelled = durable(classes.select("set", "rep").join(roots, F.col("set") == F.col("node"), "left").select("set", "rep", F.coalesce("root", "set").alias("root")))
    least = durable(labelled.groupBy("root").agg(F.min("rep").alias("component_id")))
    labels = labelled.join(least, "root").select("set", "component_id")
    out = thin.join(labels, "set", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "set", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id reached over links, kept whether it is the
    row's own.  Words are split at white space, A to Z lowered.  A null, empty or
    blank text has an empty set, links with nothing and stays.  Rows with equal
    sets are one class whatever their number; rows that share a doc_id are
    reported alike if their sets are equal; null doc_ids rank after all others.
    Other columns are ignored; an empty table gives no rows.
    """
    return _labelled(docs, rules).drop("set")


def _with_digests(docs: DataFrame, rules: NearRules, digest: str) -> DataFrame:
    """The rows of ``docs`` with their set digest, as _sketched computes it."""
    own = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                block = WordBlock(*utf8_buffer(rows.column("text")), lower=True)
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in shingle_sets(block, rules.shingle)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(digests, pa.binary())], [*own, digest])

    return docs.mapInArrow(giving_back(run), T.StructType([*docs.schema.fields, T.StructField(digest, T.BinaryType())]))


def near_dedup(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns.

    Rows are told apart by doc_id and set digest, so one that is dropped takes no
    other row of its doc_id, or without one, along.  Near copies that share a
    doc_id with the one that stays, or lack one all, stay as well.
    """
    own = docs.columns
    digest = fresh(own, "set")
    lost, gone = fresh([*own, digest], "dropped"), fresh([*own, digest], "gone")
    dropped = durable(_labelled(docs, rules).filter("NOT kept").select(F.col("doc_id").alias(lost), F.col("set").alias(gone)).distinct())
    ids = dropped.select(lost).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(lost))
    # Only rows whose doc_id is among those dropped need their digest.
    doubtful = _with_digests(docs.join(ids, same, "left_semi"), rules, digest)
    copy = doubtful["doc_id"].eqNullSafe(F.col(lost)) & (doubtful[digest] == F.col(gone))
    return docs.join(ids, same, "left_anti").unionByName(doubtful.join(dropped, copy, "left_anti").drop(digest))
