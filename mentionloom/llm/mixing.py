"""Mixing sources to target weights on a low-discrepancy schedule.

The slots of the mix lie at van der Corput points: slot t sits at the bit-reversed
fraction of t, and each source owns an interval of the cumulative weights.  With
2**k slots the points are a permutation of the multiples of 2**-k, so a source
finds its slots by reversing the numbers of its own interval: no slot searches the
weights, and any stretch of the mix holds the sources in proportion.  A source's
slots are ranked by t and joined with its blocks of equally many words, cut from
its documents in a shuffled order; when the blocks run out, they come again.

Only DataFrame operations are used.  The per-source table is small (one row a
source); positions in a source's line of words and ranks of its slots are prefix
sums in two levels, so no task holds all of a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, word_count

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 1024
#: Rows of one prefix-sum bucket, about.
BUCKET_ROWS = 4096
#: Slots that are written together, in order, as a power of two.
RANGE_BITS = 10


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source: source, source_size, target, want (words, whole).

    Targets share the sum of all sizes by weight.  A target above max_repeats
    times its source's size stops there, and the excess goes to the others by
    weight, until none is above: sources stop in the order of size over weight,
    so running sums in that order find the level at which the rest stands.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight.cast("long"))
    cap = F.col("source_size") * max_repeats
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    rows = rows.withColumn("free", F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
    rows = rows.withColumn("level", F.col("free") / F.sum("weight").over(rest)).withColumn("rank", F.row_number().over(order))
    # The first source in this order whose cap is not below the level ends the stopping.
    open_ = cap >= F.col("level") * F.col("weight")
    rows = rows.withColumn("level", F.min(F.when(open_, F.struct("rank", F.col("level").alias("at")))).over(Window.partitionBy())["at"])
    target = F.when(F.col("level").isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"), F.least(cap, F.round(target).cast("long")).alias("want"))


def _digits(rows: int) -> int:
    """Hexadecimal digits that deal rows to buckets of about BUCKET_ROWS."""
    digits = 1
    while 16**digits * BUCKET_ROWS < rows and digits < 7:
        digits += 1
    return digits


def _before(df: DataFrame, key: list[Column], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before, by bucket and then by order, for each key."""
    names = [f"__key{i}" for i in range(len(key))]
    df = df.withColumns(dict(zip(names, key, strict=True)) | {"__value": value})
    sums = df.groupBy(*names, bucket).agg(F.sum("__value").alias("__sum"))
    level = Window.partitionBy(*names).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, bucket, F.coalesce(F.sum("__sum").over(level), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*names, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    # What comes out of explode has no size that the planner knows, so joins below say that both sides may be large.
    return df.join(sums.hint("merge"), [*names, bucket]).withColumn(out, F.col("__base") + F.col("__inside")).drop(*names, "__value", "__inside", "__base")


def _mix_tables(docs: DataFrame, weights, max_repeats, uid: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Thin rows (uid, doc_id, source key, size), the targets, and the thin rows with their place in the line."""
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    thin = durable(docs.select(uid.alias("uid"), "doc_id", "source", key.alias("skey"), word_count(F.col("text")).alias("size")))
    targets = durable(source_targets(thin, weights, max_repeats).withColumn("skey", key))
    digits = _digits(thin.count())
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    line = thin.filter("size > 0").withColumn("shuffled", shuffled).withColumn("bucket", F.substring("shuffled", 1, digits))
    line = _before(line, [F.col("skey")], "bucket", [F.col("shuffled"), F.col("size"), F.col("uid")], F.col("size"), "line_start")
    return thin, targets, line.select("uid", "doc_id", "skey", "size", "line_start")


def _slots(targets: DataFrame, block_words: int) -> DataFrame:
    """The schedule: skey, block, epoch, slot (the place in the mix), limit (words of the line that the epoch takes)."""
    size, want = F.col("source_size"), F.col("want")
    blocks = F.ceil(size / block_words)
    rows = targets.filter("want > 0").withColumn("blocks", blocks).withColumn("full", F.floor(want / size))
    rows = rows.withColumn("slots", F.col("full") * F.col("blocks") + F.ceil((want - F.col("full") * size) / block_words))
    upto = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("high", F.sum("slots").over(upto)).withColumn("low", F.col("high") - F.col("slots"))
    count = rows.agg(F.coalesce(F.max("high"), F.lit(1)).alias("n")).first()["n"]
    bits = max(1, (max(1, count) - 1).bit_length())
    stride = 1 << 14
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), ((F.col("slots") - 1) / stride).cast("int"))))
    chunks = chunks.repartition("skey", "chunk")
    first = F.col("low") + F.col("chunk").cast("long") * stride
    points = chunks.withColumn("point", F.explode(F.sequence(first, F.least(first + stride, F.col("high")) - 1)))
    slot = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")
    points = points.select("skey", "blocks", "full", "source_size", "want", slot.alias("slot"))
    width = max(0, bits - (max(0, count // BUCKET_ROWS).bit_length()))
    points = points.withColumn("bucket", F.shiftright("slot", width))
    ranked = _before(points, [F.col("skey")], "bucket", [F.col("slot")], F.lit(1), "rank")
    epoch = F.floor(F.col("rank") / F.col("blocks"))
    return ranked.select("skey", "slot", epoch.alias("epoch"), (F.col("rank") - epoch * F.col("blocks")).alias("block"), F.when(epoch < F.col("full"), F.col("source_size")).otherwise(F.col("want") - F.col("full") * F.col("source_size")).alias("limit"))


def _pieces(line: DataFrame, targets: DataFrame, block_words: int) -> DataFrame:
    end = F.col("line_start") + F.col("size")
    cut = line.withColumn("block", F.explode(F.sequence(F.floor(F.col("line_start") / block_words), F.floor((end - 1) / block_words))))
    slots = _slots(targets, block_words)
    met = cut.join(slots.hint("merge"), ["skey", "block"])
    begin = F.greatest("line_start", F.col("block") * block_words)
    length = F.least(end, (F.col("block") + 1) * block_words, "limit") - begin
    return met.select("uid", "doc_id", "slot", "epoch", (begin - F.col("line_start")).alias("first_word"), length.alias("words")).filter("words > 0")


def mix_schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix, piece by piece: doc_id, slot, epoch, first_word, words.

    Reading by slot, then first_word inside the shuffled line, gives the mix.  A
    piece is a run of a document's words; epoch counts how often its block came
    before.  Every source takes its target to the word, and no word is taken more
    often than max_repeats.  A null source is a source of its own, the last; a
    null or empty text has no words and no piece.  Rows that share a doc_id are
    documents of their own.  Reruns over the same rows agree, for rows with
    distinct doc_ids whatever their order.
    """
    _, targets, line = _mix_tables(docs, weights, max_repeats, F.monotonically_increasing_id())
    return _pieces(line, targets, block_words).drop("uid")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted), source.

    Nulls, ties, repeated rows and empty tables as in mix_schedule.
    """
    thin, targets, line = _mix_tables(docs, weights, max_repeats, F.monotonically_increasing_id())
    taken = _pieces(line, targets, block_words).groupBy("uid").agg(F.sum("words").alias("taken"))
    rows = thin.join(targets.select("skey", "source_size", "target"), "skey").join(taken.hint("merge"), "uid", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents with the columns of ``docs``, a row for every time one is taken.

    Rows come in the order of the schedule: ranges of 2**RANGE_BITS slots lie
    together, and inside a range rows stand by the first slot that takes them, so
    whatever reads the result in order meets the sources in proportion.  A
    document at the end of its source's share is cut after its last word taken
    (with the white space that follows); the others are whole.  n_chars, if there
    is such a column, follows the cut.  Null and empty texts have no words and are
    not taken; a null source is a source of its own.  Rows equal in doc_id, source
    and text stand in for each other; rows that share only a doc_id do not.  An
    empty table gives no rows.
    """
    own, taken = docs.columns, list(docs.columns)

    def name(x: str) -> str:
        taken.append(fresh(taken, x))
        return taken[-1]

    uid, doc, words, slot, epoch = map(name, ("uid", "id", "words", "slot", "epoch"))
    # Rows are recognised again by content, for ids of rows change when a plan changes.
    finger = F.xxhash64(*[F.col(x) for x in own if x in ("doc_id", "source", "text")])
    thin, targets, line = _mix_tables(docs, weights, max_repeats, finger)
    epochs = _pieces(line, targets, block_words).groupBy("uid", "doc_id", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    sizes = thin.groupBy("uid", "doc_id").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    if sizes.filter("copies > 1").limit(1).count():  # equal rows stand in for each other: one of them is taken more often
        docs = docs.withColumn(uid, finger).dropDuplicates([uid, "doc_id"]).drop(uid)
        epochs = epochs.join(sizes.drop("copies"), (epochs["uid"] == sizes["uid"]) & epochs["doc_id"].eqNullSafe(sizes["doc_id"])).select(epochs["uid"], epochs["doc_id"], "epoch", "slot", "words", "size")
        epochs = epochs.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("size")))))
        epochs = epochs.withColumn("words", F.least("size", F.col("words") - F.col("n") * F.col("size")))
    epochs = epochs.select(F.col("uid").alias(uid), F.col("doc_id").alias(doc), F.col("words").cast("long").alias(words), F.col("slot").alias(slot), F.col("epoch").alias(epoch))
    rows = docs.withColumn(uid, finger).join(epochs.hint("merge"), uid).filter(F.col("doc_id").eqNullSafe(F.col(doc)))
    parts = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    led = F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int")
    cut = F.array_join(F.slice(parts, F.lit(1), (F.col(words) + led).cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col(words) < word_count(F.col("text")), cut).otherwise(F.col("text")))
    if "n_chars" in own:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    # Slots hold equally many words, so ranges of slots are of one size and need no sampling.
    return rows.repartition(F.shiftright(slot, RANGE_BITS)).sortWithinPartitions(slot, uid, epoch).select(*own)
