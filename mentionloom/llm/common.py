"""Helpers that several training-data operators share."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a character class body for Java and Python patterns.
SPACES = r"\x20\x09-\x0D"
#: A word.
WORD = rf"[^{SPACES}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that the session names; make one only for local sessions that name none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(named)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder, as Parquet, and go on from the files.

    Cuts the lineage without relying on any executor's local disk, so a lost
    executor costs a reread and no recomputation.  The planner knows the size of
    what it reads again, so loops don't multiply guesses, and only the columns
    asked for are read.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], name: str) -> str:
    """A column name that none of ``taken`` clashes with, whatever its case."""
    low = {x.lower() for x in taken}
    name = f"__{name}"
    while name.lower() in low:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def total_text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 size of all texts: one row reaches the driver."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("n")).first()["n"]


def slices(batch, column: str = "text", limit: int = 1 << 20):
    """Cut an Arrow batch into runs of rows whose texts hold about ``limit`` bytes (a longer text stands alone)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Return a worker's freed memory to the system: workers live on, and one executor's share it."""
    import ctypes

    import pyarrow as pa

    from .wordblock import forget_tables

    forget_tables()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


def giving_back(run, encoders: bool = False):
    """``run`` over a task's batches, and then give_back: only when it has ended does nothing hold its last batch.

    encoders: tokenizers and their memos stay in the worker for the next task;
    other tasks first let go what such a task has left.
    """

    def whole(batches):
        tokens = sys.modules.get("mentionloom.llm.tokens")
        if tokens and not encoders:
            tokens.forget_encoders()
        yield from run(batches)
        give_back()

    return whole


def utf8_buffer(column):
    """The bytes of a string column laid end to end and where each row begins (nulls are empty)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
