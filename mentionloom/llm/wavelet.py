"""Token ids as wavelet matrices, one compressed file a shard.

A wavelet matrix keeps n ids as bit planes, the highest first; before each next
plane the ids are stably parted into those with a 0 and those with a 1.  With the
ones counted before every block of bits (rank), single ids, the count of an id in
any range and the place of its k-th occurrence (select) come from a walk over the
planes, without decoding the rest.

File: the magic, a header of little-endian numbers, then sections, each compressed
for itself, after its length: document ids, document lengths, and per plane its bits and block
counts.  A section is opened when it is first needed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, give_back, slices
from .tokens import encoder, vocabulary

MAGIC = b"WMX1"
#: Compresses every section.
CODEC = "zstd"
#: Bits between two counts of ones.
BLOCK = 512
#: Ids of one shard, about: a document is never split.
SHARD_TOKENS = 4_000_000
END = 2
#: Token pieces that a worker remembers.
MEMO = 1_000_000
#: Stands for a null doc_id inside a shard.
NO_ID = -(2**63)
#: Shards whose start positions are broadcast at most; beyond, they are joined by shuffle.
MAX_BROADCAST_SHARDS = 100_000
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """Build with ``encode``, open with ``WaveletMatrix(data)``."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.n, self.docs, self.planes = struct.unpack_from("<QQI", data, 4)
        sections = 2 + 2 * self.planes
        lengths = struct.unpack_from(f"<{sections}Q", data, 24)
        at = 24 + 8 * sections
        self._raw: list[bytes] = []
        for length in lengths:
            self._raw.append(data[at : at + length])
            at += length
        self._open: dict[int, np.ndarray] = {}

    @staticmethod
    def encode(ids: np.ndarray, doc_ids: np.ndarray, doc_lengths: np.ndarray) -> bytes:
        ids = np.array(ids)  # a copy, for the partings go to and fro between two arrays
        spare = np.empty_like(ids)
        planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        sections = [np.asarray(doc_ids, "<i8").tobytes(), np.asarray(doc_lengths, "<u8").tobytes()]
        for shift in range(planes - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << shift)) != 0
            packed = np.zeros(-(-len(ones) // BLOCK) * BLOCK // 8, np.uint8)
            packed[: -(-len(ones) // 8)] = np.packbits(ones)
            counts = _POPCOUNT[packed].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
            sections += [packed.tobytes(), np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes()]
            zeros = len(ids) - np.count_nonzero(ones)
            np.compress(~ones, ids, out=spare[:zeros])
            np.compress(ones, ids, out=spare[zeros:])
            ids, spare = spare, ids
        deflated = [struct.pack("<Q", len(x)) + pa.compress(x, codec=CODEC, asbytes=True) for x in sections]
        return MAGIC + struct.pack("<QQI", len(ids), len(doc_ids), planes) + struct.pack(f"<{len(deflated)}Q", *map(len, deflated)) + b"".join(deflated)

    def _section(self, i: int, kind: str) -> np.ndarray:
        if i not in self._open:
            raw = self._raw[i]
            self._open[i] = np.frombuffer(pa.decompress(raw[8:], decompressed_size=struct.unpack_from("<Q", raw)[0], codec=CODEC, asbytes=True), kind)
        return self._open[i]

    @property
    def doc_ids(self) -> np.ndarray:
        return self._section(0, "<i8")

    @property
    def doc_lengths(self) -> np.ndarray:
        return self._section(1, "<u8").astype(np.int64)

    def _bits(self, plane: int) -> np.ndarray:
        return self._section(2 + 2 * plane, np.uint8)

    def _counts(self, plane: int) -> np.ndarray:
        return self._section(3 + 2 * plane, "<u8")

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        bits, block = self._bits(plane), i // BLOCK
        ones = int(self._counts(plane)[block])
        whole, left = i // 8, i % 8
        ones += int(_POPCOUNT[bits[block * BLOCK // 8 : whole]].sum())
        return ones + (int(_POPCOUNT[bits[whole] >> (8 - left)]) if left else 0)

    def _zeros(self, plane: int) -> int:
        return self.n - self._rank1(plane, self.n)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.planes):
            one = (self._bits(plane)[i // 8] >> (7 - i % 8)) & 1
            ones = self._rank1(plane, i)
            i = self._zeros(plane) + ones if one else i - ones
            value = value << 1 | int(one)
        return value

    def rank(self, value: int, i: int) -> int:
        """How often an id occurs among the first i."""
        low, high = self._range(value, 0, i)
        return high - low

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        low, high = self._range(value, start, self.n if stop is None else stop)
        return high - low

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        if value >> self.planes or value < 0:
            return 0, 0
        for plane in range(self.planes):
            a, b = self._rank1(plane, low), self._rank1(plane, high)
            if value >> (self.planes - 1 - plane) & 1:
                zeros = self._zeros(plane)
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def _select(self, plane: int, one: int, k: int) -> int:
        """Place of the k-th (from 0) bit of a kind."""
        counts = self._counts(plane).astype(np.int64)
        if not one:
            counts = np.minimum(np.arange(len(counts)) * BLOCK, self.n) - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self._bits(plane)[block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - counts[block]])

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        low, high = self._range(value, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for plane in range(self.planes - 1, -1, -1):
            one = value >> (self.planes - 1 - plane) & 1
            at = self._select(plane, one, at - self._zeros(plane) if one else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        # Undo the partings from the last plane to the first.
        for plane in range(self.planes - 1, -1, -1):
            ones = np.unpackbits(self._bits(plane), count=self.n).view(bool)
            high = np.flatnonzero(ones)
            zeros = self.n - len(high)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~ones)] = values[:zeros]
            out[high] = values[zeros:] | kind(1 << (self.planes - 1 - plane))
            values = out
        return values


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode the documents and write shards in ascending doc_id order; returns what was written.

    folder: a URI that driver and executors share.  Rows are dealt out by ranges
    of doc_id; a shard's name has its range, number and tokens, so names sort like the
    documents, and a task that runs again writes the same files (by rename).  A
    null text is empty; every document ends with ``end``.  Rows that share a
    doc_id follow each other, by text; null doc_ids come first.  The result
    has one row a shard: file, docs, tokens, bytes.  An empty table gives none.
    """
    path = path or vocabulary("word_bpe_49k.json")
    close = end.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, part = encoder(path, spaced=False, width=2, memo=MEMO), TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        ids: list[bytes] = []
        names: list[int] = []
        held, number = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            file = f"{base}/shard-{part:08d}-{number:06d}-{held}.wmx"
            data = WaveletMatrix.encode(np.frombuffer(b"".join(ids), "<u2"), np.array(names, np.int64), np.array([len(x) // 2 for x in ids]))
            with store.open_output_stream(f"{file}.{attempt}.part") as out:
                out.write(data)
            store.move(f"{file}.{attempt}.part", file)
            row = pa.RecordBatch.from_arrays([pa.array([file]), *(pa.array([x], pa.int64()) for x in (len(names), held, len(data)))], ["file", "docs", "tokens", "bytes"])
            ids.clear()
            names.clear()
            held, number = 0, number + 1
            return row

        for batch in batches:
            for rows in slices(batch):
                for doc, own in zip(rows.column(0).to_pylist(), texts.encode(rows.column("text")), strict=True):
                    ids.append(own.tobytes() + close)
                    names.append(doc)
                    held += len(own) + 1
                    if held >= shard_tokens:
                        yield flush()
        if ids:
            yield flush()
        give_back()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, "file string, docs long, tokens long, bytes long")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents decoded from the shards: doc_id, start (ids of all documents before it), n_tokens, ids.

    ids are little-endian 32-bit integers and include the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = WaveletMatrix(data.as_buffer().to_pybytes())
                if f"-{shard.n}.wmx" not in name:
                    raise ValueError(f"{name} doesn't hold what its name says")
                lengths = shard.doc_lengths
                ends = np.cumsum(lengths)
                words = shard.decode().astype("<u4")
                step = 2000
                for i in range(0, len(lengths), step):
                    low, high = int(ends[i] - lengths[i]), int(ends[min(i + step, len(lengths)) - 1])
                    offsets = np.concatenate([[0], ends[i : i + step] - low]) * 4
                    blob = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(words[low:high].tobytes())])
                    n = len(blob)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(shard.doc_ids[i : i + step]), pa.array((ends - lengths)[i : i + step]), pa.array(lengths[i : i + step]), blob], ["file", "doc_id", "inside", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wmx").load(folder)
    named = files.select(F.substring_index("path", "/", -1).alias("file"), "content")
    # A shard's name tells its range, number and tokens; only names are read for the start positions.
    tokens = F.regexp_extract("file", r"-([0-9]+)\.wmx$", 1).cast("long")
    totals = durable(named.select("file", tokens.alias("tokens"), F.substring("file", 7, 8).alias("part")))
    parts = totals.groupBy("part").agg(F.sum("tokens").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("own", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(parts, "part").select("file", (F.col("base") + F.col("own")).alias("before"))
    rows = named.mapInArrow(run, "file string, doc_id long, inside long, n_tokens long, ids binary")
    if totals.count() <= MAX_BROADCAST_SHARDS:
        starts = F.broadcast(starts)
    return rows.join(starts, "file").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("before") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids")
