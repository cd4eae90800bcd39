"""Annotated text: tokens, mentions from label runs, and gold annotations aligned with them.

No model is shipped: labels come as an input column, or from ``capital_labels``, a
plain rule (runs of capitalised words that don't begin a sentence).

Tokens: doc_id, sent_no, pos, text, b, e (end inclusive), label ("O": none).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Labels of recognisers and the entity types they stand for.
LABEL_TYPES = {"PERSON": "PER", "ORGANIZATION": "ORG", "LOCATION": "LOC", "MISC": "MISC", "DATE": "DATE", "MONEY": "MNY", "PERCENT": "PRC", "TIME": "TIME", "NUMBER": "NUM", "GPE": "GPE", "PER": "PER", "ORG": "ORG", "LOC": "LOC", "NONE": "NONE"}
ALLOWED_TYPES = ("PER", "ORG", "LOC", "MISC")


def _parts(text: str) -> Column:
    """Words, runs of spaces and single signs of a text, in order."""
    return F.regexp_extract_all(F.col(text), F.lit(r"(?s)[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*|\s+|."), F.lit(0))


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """Words and single signs of each sentence with their places; a sentence ends with ". ", "! ", "? " or a line."""
    # One row a part; its place is what the parts before it measure.
    rows = docs.select("doc_id", F.posexplode(_parts(text)).alias("i", "text"))
    order = Window.partitionBy("doc_id").orderBy("i")
    before = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("b", F.coalesce(before, F.lit(0)).cast("int"))
    after_stop = F.coalesce(F.lag("text").over(order).isin(".", "!", "?"), F.lit(False)) & F.col("text").rlike(r"^\s")
    rows = rows.withColumn("sent_no", F.sum((after_stop | F.contains("text", F.lit("\n"))).cast("int")).over(order)).filter(~F.col("text").rlike(r"^\s"))
    place = F.row_number().over(Window.partitionBy("doc_id", "sent_no").orderBy("i")) - 1
    return rows.select("doc_id", "sent_no", place.alias("pos"), "text", "b", (F.col("b") + F.length("text") - 1).alias("e"))


def capital_labels(rows: DataFrame) -> DataFrame:
    """Label capitalised words inside a sentence MISC, others O."""
    return rows.withColumn("label", F.when(F.col("text").rlike(r"^\p{Lu}[\p{L}']") & (F.col("pos") > 0), "MISC").otherwise("O"))


def merge_runs(rows: DataFrame, key: list[str] | None = None, order: str = "pos", label: str = "label") -> DataFrame:
    """Runs of equal labels other than "O": key, label, start_tok, end_tok (inclusive).

    A run's number is how often the label changed up to it.
    """
    key = key or ["doc_id", "sent_no"]
    window = Window.partitionBy(*key).orderBy(order)
    changed = ~F.col(label).eqNullSafe(F.lag(label).over(window))
    numbered = rows.withColumn("__run", F.sum(changed.cast("int")).over(window)).filter(F.col(label) != "O")
    return numbered.groupBy(*key, "__run", label).agg(F.min(order).alias("start_tok"), F.max(order).alias("end_tok")).drop("__run")


def mentions_of(rows: DataFrame, runs: DataFrame, allowed: tuple[str, ...] = ALLOWED_TYPES) -> DataFrame:
    """Mentions of allowed types: doc_id, sent_no, start_tok, end_tok, b, e, name, ner_type."""
    kinds = F.create_map(*[F.lit(x) for pair in LABEL_TYPES.items() for x in pair])
    typed = runs.withColumn("ner_type", F.try_element_at(kinds, F.col("label"))).filter(F.col("ner_type").isin(*allowed))
    met = typed.join(rows, ["doc_id", "sent_no"]).filter("pos BETWEEN start_tok AND end_tok")
    words = F.sort_array(F.collect_list(F.struct("pos", "text")))
    out = met.groupBy("doc_id", "sent_no", "start_tok", "end_tok", "ner_type").agg(F.min("b").alias("b"), F.max("e").alias("e"), words.alias("__w"))
    return out.withColumn("name", F.array_join(F.transform("__w", lambda x: x["text"]), " ")).drop("__w")


def _places(parts: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``tokens`` gives, for the parts of some documents: all parts, the tokens' places among them, and each token's document, sent_no, pos and b."""
    flat = parts.flatten().cast(pa.string())
    n, doc = len(flat), pc.list_parent_indices(parts).to_numpy()
    if n == 0:
        return flat, *[np.zeros(0, int)] * 5
    ends = np.frombuffer(flat.buffers()[1], np.int32, n + 1, flat.offset * 4)
    raw = np.frombuffer(flat.buffers()[2], np.uint8)
    first = raw[ends[:-1]]
    space = (first == 32) | (first >= 9) & (first <= 13)
    stop = (np.diff(ends) == 1) & np.isin(first, np.frombuffer(b".!?", np.uint8))
    line = np.zeros(n, bool)
    line[np.searchsorted(ends, ends[0] + np.flatnonzero(raw[ends[0] : ends[-1]] == 10), "right") - 1] = True
    new = np.r_[True, doc[1:] != doc[:-1]]
    last = np.flatnonzero(new)[np.cumsum(new) - 1]  # where each part's document begins
    size = pc.utf8_length(flat).to_numpy().astype(np.int64)
    before = np.cumsum(size) - size
    broken = line | space & np.r_[False, stop[:-1]] & ~new
    sentence = np.cumsum(broken)
    sentence -= (sentence - broken)[last]
    at = np.flatnonzero(~space)
    doc, sentence, begin = doc[at], sentence[at], (before - before[last])[at]
    opens = np.r_[True, (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])][: len(at)]
    order = np.arange(len(at))
    return flat, at, doc, sentence, order - order[opens][np.cumsum(opens) - 1], begin


def _by_document(rows: DataFrame, one: Callable[[pa.RecordBatch], pa.Table], schema: str, limit: int = 1 << 20) -> DataFrame:
    """``one`` on runs of rows whose column parts holds about ``limit`` parts; nothing is shuffled."""
    target = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("parts")), 0).to_numpy(zero_copy_only=False))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + limit, "right")))
                yield from one(batch.slice(low, high - low)).cast(target).to_batches()
                low = high

    return rows.mapInArrow(run, schema)


def capital_mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Mentions by ``capital_labels``: what ``mentions_of`` gives for the runs of these labels, without a row for every token."""
    names = ["doc_id", "sent_no", "start_tok", "end_tok", "ner_type", "b", "e", "name"]

    def one(batch: pa.RecordBatch) -> pa.Table:
        flat, at, doc, sentence, pos, begin = _places(batch.column("parts"))
        # A run ends with its sentence, whose first token has no label.
        some = np.flatnonzero(pos > 0)
        some = some[pc.match_substring_regex(flat.take(pa.array(at[some])), r"^\p{Lu}[\p{L}']").to_numpy(zero_copy_only=False)]
        words = flat.take(pa.array(at[some]))
        apart = np.diff(some) != 1
        low, high = np.flatnonzero(np.r_[True, apart][: len(some)]), np.flatnonzero(np.r_[apart, True][: len(some)])
        start, end = some[low], some[high]
        spelled = words.to_pylist()
        stop = begin[end] + pc.utf8_length(words).to_numpy()[high] - 1
        kinds = pa.array(["MISC"] * len(low), pa.string())
        return pa.table([batch.column("doc_id").take(pa.array(doc[start])), sentence[start], pos[start], pos[end], kinds, begin[start], stop, pa.array([" ".join(spelled[i : j + 1]) for i, j in zip(low, high, strict=True)], pa.string())], names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sent_no long, start_tok int, end_tok int, ner_type string, b int, e int, name string"
    return _by_document(docs.select("doc_id", _parts(text).alias("parts")), one, schema)


def tokens_at(docs: DataFrame, annotations: DataFrame, text: str = "text") -> DataFrame:
    """The tokens that ``align`` looks up: those that begin or end where an annotation (doc_id, name, offset) of their document does.

    doc_id, sent_no, pos, b, e.  A document's annotations go to its text, so the text moves and not its tokens.
    """
    ends = annotations.select("doc_id", F.col("offset").cast("long").alias("__b"), (F.col("offset") + F.length("name") - 1).cast("long").alias("__e"))
    wanted = ends.groupBy("doc_id").agg(F.collect_set("__b").alias("begins"), F.collect_set("__e").alias("ends"))

    def one(batch: pa.RecordBatch) -> pa.Table:
        flat, at, doc, sentence, pos, begin = _places(batch.column("parts"))
        end = begin + pc.utf8_length(flat.take(pa.array(at))).to_numpy() - 1
        wide = int(end.max(initial=0)) + 1

        def hit(column: str, place: np.ndarray) -> np.ndarray:
            lists = batch.column(column)
            asked = lists.flatten().to_numpy(zero_copy_only=False)
            whose = pc.list_parent_indices(lists).to_numpy()
            inside = (asked >= 0) & (asked < wide)
            return np.isin(doc.astype(np.int64) * wide + place, whose[inside].astype(np.int64) * wide + asked[inside])

        keep = np.flatnonzero(hit("begins", begin) | hit("ends", end))
        return pa.table([batch.column("doc_id").take(pa.array(doc[keep])), sentence[keep], pos[keep], begin[keep], end[keep]], names=["doc_id", "sent_no", "pos", "b", "e"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sent_no long, pos int, b int, e int"
    met = docs.select("doc_id", text).join(wanted, "doc_id").select("doc_id", _parts(text).alias("parts"), "begins", "ends")
    return _by_document(met, one, schema)


def align(annotations: DataFrame, mentions: DataFrame, rows: DataFrame) -> DataFrame:
    """Gold annotations (doc_id, mention_id, name, offset) with the recognised mention that covers them, else with tokens.

    Adds sent_no, start_tok, end_tok, ner_type.  A mention that covers the first
    character counts before one that covers the last; tokens must begin and end
    where the annotation does.  An annotation that fits nothing keeps nulls.
    rows: all tokens, or those of ``tokens_at``, which spares their shuffles.
    Places inside a mention are met by equality: mentions are spread over cells of
    256 characters.
    """
    cell = 256
    ends = annotations.withColumns({"__first": F.col("offset"), "__last": F.col("offset") + F.length("name") - 1})
    spread = mentions.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("b") / cell), F.floor(F.col("e") / cell))))
    spread = spread.select("doc_id", "__cell", F.struct("sent_no", "start_tok", "end_tok", "ner_type").alias("__m"), F.col("b").alias("__b"), F.col("e").alias("__e"))

    def covering(at: str) -> DataFrame:
        met = ends.withColumn("__cell", F.floor(F.col(at) / cell)).join(spread, ["doc_id", "__cell"]).filter(F.col(at).between(F.col("__b"), F.col("__e")))
        return met.groupBy("doc_id", "mention_id").agg(F.min(F.struct("__b", "__m"))["__m"].alias("__m" + at))

    exact = rows.select("doc_id", "sent_no", "pos", "b", "e")
    begin = ends.join(exact.withColumnRenamed("b", "__first"), ["doc_id", "__first"]).groupBy("doc_id", "mention_id").agg(F.min("sent_no").alias("__s"), F.min("pos").alias("__p"))
    end = ends.join(exact.withColumnRenamed("e", "__last"), ["doc_id", "__last"]).groupBy("doc_id", "mention_id").agg(F.min("pos").alias("__q"))
    out = annotations
    for part in (covering("__first"), covering("__last"), begin, end):
        out = out.join(part, ["doc_id", "mention_id"], "left")
    made = F.when(F.col("__p").isNotNull() & F.col("__q").isNotNull(), F.struct(F.col("__s").alias("sent_no"), F.col("__p").alias("start_tok"), F.col("__q").alias("end_tok"), F.lit(None).cast("string").alias("ner_type")))
    return out.withColumn("__m", F.coalesce("__m__first", "__m__last", made)).select(*annotations.columns, "__m.*")


def align_or_locate(names: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Names (doc_id, mention_id, name) at their first place in the text: adds offset, null if they don't occur."""
    met = names.join(docs.select("doc_id", F.col(text).alias("__text")), "doc_id")
    at = F.call_function("locate", F.col("name"), F.col("__text")) - 1
    return met.withColumn("offset", F.when(at >= 0, at)).drop("__text")


def sentence_context(sentences: DataFrame, edge: int = 25) -> DataFrame:
    """Context of mentions in sentences (doc_id, sent_no, text, n_tokens, start_tok, end_tok): adds context.

    The sentence before joins in where the mention starts within ``edge`` tokens of
    the beginning, the one after where it ends as close to the end.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("sent_no")
    before, after = F.lag("text").over(by_doc), F.lead("text").over(by_doc)
    near_start, near_end = F.col("start_tok") < edge, F.col("n_tokens") - F.col("end_tok") <= edge
    return sentences.withColumn("context", F.concat_ws(" ", F.when(near_start, before), "text", F.when(near_end, after)))


def type_vote(mentions: DataFrame, order: str) -> DataFrame:
    """The last type other than MISC of each name in any case: doc_id, name_lc, ner_type."""
    return mentions.filter("ner_type <> 'MISC'").groupBy("doc_id", F.lower("name").alias("name_lc")).agg(F.max_by("ner_type", order).alias("ner_type"))


def spell_entities(tokens_column: str = "tokens") -> Column:
    """Text of a token array (text, type), typed tokens as [[[TYPE word]]]."""
    return F.array_join(F.transform(tokens_column, lambda t: F.when(t["type"].isNull(), t["text"]).otherwise(F.concat(F.lit("[[["), t["type"], F.lit(" "), t["text"], F.lit("]]]")))), " ")
