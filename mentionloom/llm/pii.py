"""Personal data by bootstrapped contextual extraction.

Four expressions find the base spans: e-mail addresses, IP addresses, card and
phone numbers.  They are the seeds.  The words before a seed make lexical
patterns; other identifier-like tokens that stand after the same words are
candidates.  Spark scores the graph of patterns and instances in rounds: a
pattern is as trustworthy as the share of its distinct instances that are known,
an instance as the patterns that vouch for it, and instances above a threshold
are known in the next round.  Tokens after trusted patterns become spans of the
pattern's kind, beside the base ones, which stay.

Secrets (access keys, long random strings) are a fifth kind: their shape gives
seeds too, so that "password=" or "token =" become patterns and show short or
wordlike secrets.  They are no base spans.

Each text is read once; what leaves it are spans and the few candidate tokens
with a digit or an at sign, so the graph is small beside the corpus.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, durable, fresh

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
ALL_KINDS = (*KINDS, SECRET)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't start inside a run of digits whose start did not match, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: An identifier-like token: has a digit or an at sign.
_TOKEN = re.compile(rf"(?<![^{SPACES}])[^{SPACES}0-9@]*+[0-9@][^{SPACES}]*")
#: Fields of a token (a URL's query, JSON or CSV without blanks), and the thousands that are none.
_FIELD = re.compile(r"[^&;,?|{}]+")
_THOUSANDS = re.compile(r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?")
#: Digit groups joined by blanks, dots, brackets and hyphens.
_GROUPS = re.compile(r"\+?[0-9]+(?:[\x20().-]+[0-9]+)*")
#: Fixed value: how the access key ids of a large cloud look.
_ACCESS_KEY = re.compile(r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])")
_RANDOM = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}(?![A-Za-z0-9_+/-])")
_TURN = re.compile("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
#: What ends a value or field inside a token, and the signs that may stand between a name and its value.
_CUT = re.compile("[=:&;,?|{}]")
_GLUE = frozenset("=:&;,?|{}\"'([<")
_BLANKS = frozenset(" \t\n\v\f\r")
_EDGE = ".,;:!?()[]{}<>\"'“”‘’«»"


@dataclass(frozen=True)
class BootstrapRules:
    #: Words before an identifier that make a pattern, from one to this many.
    context_words: int = 2
    rounds: int = 3
    #: A pattern counts with so many distinct known instances and such a share of known ones.
    least_support: int = 3
    least_confidence: float = 0.6
    #: An instance is known from here on.
    least_instance: float = 0.6
    #: A random string, and so a seed of secrets, changes so often between letters and digits.
    least_turns: int = 4


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the leftmost matches of local part, at sign and domain, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def secret_spans(text: str, rules: BootstrapRules) -> list[tuple[int, int]]:
    """Seeds of secrets: access keys and random strings with letters and digits in turn."""
    found = {m.span() for m in _ACCESS_KEY.finditer(text)}
    for m in _RANDOM.finditer(text):
        turns = 0
        for _ in _TURN.finditer(m[0]):
            turns += 1
            if turns >= rules.least_turns:
                found.add(m.span())
                break
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


#: Longer words stand in patterns by their digest.
_LONG_WORD = 64


def _shape(word: str) -> str:
    word = re.sub(r"[0-9]+", "0", word.lower())
    return word if len(word) <= _LONG_WORD else hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _values(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans in a token that can be identifiers: values of name=value or name:value, or whole fields."""
    if _THOUSANDS.fullmatch(text[start:end].strip(_EDGE)):
        yield start, end
        return
    for field in _FIELD.finditer(text, start, end):
        s, e = field.span()
        parts = [] if text.startswith("http", s) else [m.end() for m in re.finditer("[=:]", field[0])]
        if not parts:
            yield s, e
            continue
        for a, b in zip(parts, [*(x - 1 for x in parts[1:]), e - s], strict=True):
            yield s + a, s + b


def _run_end(text: str, start: int, stop: int) -> int:
    """Where the run of digit groups that starts here ends; only whole groups count, none of a word."""
    match = _GROUPS.match(text, start, stop)
    if not match:
        return start
    end = match.end()
    if end < len(text) and (text[end].isalnum() or text[end] in "@_=:%/+"):
        end = start + len(text[start : text.rfind(" ", start, end) + 1].rstrip(" ().-"))
    return end


class _Contexts:
    """Patterns of the identifiers of one text, asked for in ascending order of their places.

    A pattern is the last one, two, ... words before an identifier on its line.
    What is glued to the identifier inside its token (a name with "=", a quote)
    is the last of these words and marked; it reaches back to the start of the
    field, or to the value or identifier before (``floor``).  Every character is looked at a bounded number of times.
    """

    def __init__(self, text: str, words: int):
        self._text, self._words = text, words
        self._token = (-1, -1)
        self._before: list[str] = []
        self._cuts: list[int] = []

    def _words_before(self, start: int) -> list[str]:
        """Up to so many words with a letter or digit, each with up to two of signs alone after it."""
        text, out, lettered, signs, at = self._text, [], 0, 0, start
        while lettered < self._words and signs < 3:
            while at > 0 and text[at - 1] in " \t\v\f\r":
                at -= 1
            if at == 0 or text[at - 1] == "\n":
                break
            end = at
            while at > 0 and text[at - 1] not in _BLANKS:
                at -= 1
            if any(c.isalnum() for c in text[at:end]):
                lettered, signs = lettered + 1, 0
            else:
                signs += 1
            out.append(_shape(text[at:end]))
        return out[::-1]

    def at(self, token: tuple[int, int], start: int, floor: int) -> list[str]:
        text = self._text
        if token != self._token:
            self._token, self._before = token, self._words_before(token[0])
            self._cuts = [m.end() for m in _CUT.finditer(text, *token)]
        words, glued = self._before, ""
        if start > token[0]:
            # Back over signs that end the head, then to the separator or value before them.
            j = start
            floor = max(floor, token[0])
            while j > floor and text[j - 1] in _GLUE:
                j -= 1
            k = bisect.bisect_left(self._cuts, j) - 1
            low = max(floor, self._cuts[k]) if k >= 0 and j > floor else floor
            glued = text[low:start]
            if low > token[0]:
                words = []  # earlier fields of the token are no context
        if glued:
            words = [*words, _shape(glued) + "\x00"]  # no blank between: another pattern
        heads = [i for i, x in enumerate(words) if any(c.isalpha() for c in x)]
        return [" ".join(words[i:]) for i in heads[-self._words :]]


def _instance(value: str) -> bytes:
    return hashlib.blake2b(value.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest()


def extract(text: str | None, rules: BootstrapRules) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, str | None, bytes, list[str]]]]:
    """Base spans, and occurrences for the graph: start, end, kind (null: unknown), instance, patterns."""
    if not text:
        return {k: [] for k in KINDS}, []
    spans = base_spans(text)
    based = sorted((s, e, k) for k, own in spans.items() for s, e in own)
    # A secret seed that meets a base span is no seed.
    taken, at, reach = list(based), 0, 0
    for s, e in secret_spans(text, rules):
        while at < len(based) and based[at][0] < e:
            reach = max(reach, based[at][1])
            at += 1
        if reach <= s:
            taken.append((s, e, SECRET))
    taken.sort()
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    if not tokens and not taken:
        return spans, []
    contexts, seen, k, floor = _Contexts(text, rules.context_words), [], 0, 0
    for s, e, kind in taken:
        while k < len(tokens) and tokens[k][1] <= s:
            k += 1
        token = tokens[k] if k < len(tokens) and tokens[k][0] <= s else (s, e)
        seen.append((s, e, kind, _instance(text[s:e]), contexts.at(token, s, min(floor, s))))
        floor = max(floor, e)
    contexts = _Contexts(text, rules.context_words)
    at = done = reach = floor = 0
    for token in tokens:
        for s, e in _values(text, *token):
            if s < done:
                continue
            while at < len(taken) and taken[at][0] <= s:
                reach = max(reach, taken[at][1])
                at += 1
            stop = taken[at][0] if at < len(taken) else len(text)
            if reach > s or stop < e:
                continue
            value = text[s:e]
            core = value.strip(_EDGE)
            s += len(value) - len(value.lstrip(_EDGE)) if core else 0
            e = s + len(core)
            if not re.search("[0-9@]", core):
                continue
            end = _run_end(text, s, stop)
            if end > e:
                e = done = end
            seen.append((s, e, None, _instance(text[s:e]), contexts.at(token, s, min(max(floor, reach), s))))
            floor = e
    return spans, seen


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SEEN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("instance", T.BinaryType()), T.StructField("patterns", T.ArrayType(T.StringType()))])


def _extracted(docs: DataFrame, rules: BootstrapRules) -> DataFrame:
    schema = T.StructType([docs.schema["doc_id"], T.StructField("digest", T.BinaryType()), *(T.StructField(k, T.ArrayType(_SPAN)) for k in KINDS), T.StructField("seen", T.ArrayType(_SEEN))])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    seen = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("instance", pa.binary()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: dict[str, list] = {k: [] for k in KINDS}
            occurrences, digests = [], []
            for value in batch.column("text"):
                text = value.as_py()
                digests.append(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest())
                found, own = extract(text, rules)
                for k in KINDS:
                    spans[k].append([{"start": s, "end": e} for s, e in found[k]])
                occurrences.append([dict(zip(("start", "end", "kind", "instance", "patterns"), x, strict=True)) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), *(pa.array(spans[k], span) for k in KINDS), pa.array(occurrences, seen)], ["doc_id", "digest", *KINDS, "seen"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def score_patterns(occurrences: DataFrame, rules: BootstrapRules = BootstrapRules()) -> DataFrame:
    """Trusted patterns: pattern, kind, confidence.

    occurrences: instance, pattern, kind (null: unknown).  In each round every
    edge of the graph counts once.  A pattern's confidence for a kind is the sum
    of its instances' beliefs over the number of its instances; an instance's
    belief is 1 for seeds of the kind and 1 minus the product of the doubts of its
    trusted patterns for unknown ones.
    """
    edges = durable(occurrences.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")))
    held = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("held"))
    beliefs = edges.filter("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("belief", F.lit(1.0))
    trusted = None
    for step in range(rules.rounds):
        known = edges.select("pattern", "instance").join(beliefs, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"), F.count(F.lit(1)).alias("support"))
        scored = known.filter(F.col("support") >= rules.least_support).join(held, "pattern").withColumn("confidence", F.col("mass") / F.col("held"))
        best = scored.groupBy("pattern").agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", "kind")).alias("best"))
        trusted = durable(best.select("pattern", "best.kind", "best.confidence").filter(F.col("confidence") >= rules.least_confidence))
        if step == rules.rounds - 1:
            break
        doubt = F.log1p(-F.least(F.col("confidence"), F.lit(0.999999)))
        new = edges.filter("kind IS NULL").select("pattern", "instance").join(trusted, "pattern").groupBy("instance", F.col("kind")).agg((1 - F.exp(F.sum(doubt))).alias("belief"))
        beliefs = edges.filter("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("belief", F.lit(1.0)).unionByName(new.filter(F.col("belief") >= rules.least_instance))
        beliefs = durable(beliefs.groupBy("instance", "kind").agg(F.max("belief").alias("belief")))
    return trusted


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ALL_KINDS)), kind).cast("int")


def _found(docs: DataFrame, rules: BootstrapRules) -> DataFrame:
    """doc_id, digest of the text, base and found."""
    rows = durable(_extracted(docs, rules).withColumn("row", F.monotonically_increasing_id()))
    seen = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    edges = seen.select("instance", F.explode("patterns").alias("pattern"), "kind")
    trusted = score_patterns(edges, rules)
    hits = seen.filter("kind IS NULL").select("row", "start", "end", F.explode("patterns").alias("pattern")).join(trusted, "pattern").select("row", "start", "end", "kind", "confidence")
    seeds = seen.filter(F.col("kind") == SECRET).select("row", "start", "end", "kind", F.lit(1.0).alias("confidence"))
    hits = hits.unionByName(seeds).groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    found = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(_order(F.col("kind")).alias("order"), "start", "end", "kind"))).alias("found"))

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    base = F.concat(*map(tagged, KINDS))
    added = F.coalesce("found", F.array().cast("array<struct<order:int,start:bigint,end:bigint,kind:string>>"))
    added = F.transform(added, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.join(found, "row", "left").select("doc_id", "digest", base.alias("base"), added.alias("found"))


def find_personal_data(docs: DataFrame, rules: BootstrapRules = BootstrapRules()) -> DataFrame:
    """One row a row of ``docs``: doc_id, base and found.

    Both are arrays of (kind, start, end) in code points, by kind as in ALL_KINDS,
    then start; base has the spans of the four expressions, found those that only
    the method adds, and the seeds of secrets.  A null or empty text has none.  Rows that share a doc_id are
    handled one by one; repeated rows count once as evidence; of kinds equally
    trusted the last by name is taken.  Texts and words of any length are read
    whole.  Other columns are ignored; an empty table gives no rows.
    """
    return _found(docs, rules).drop("digest")


def spell(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def by_kind(spans: Column) -> Column:
    """Spans by kind as in ALL_KINDS, then start."""
    keyed = F.transform(spans, lambda x: F.struct(_order(x["kind"]).alias("order"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.sort_array(keyed)


def redact(docs: DataFrame, rules: BootstrapRules = BootstrapRules()) -> DataFrame:
    """The rows of ``docs`` with [KIND] in place of every span, overlapping spans as one of the first kind.

    Rows meet their spans by a digest of the text, so null and repeated doc_ids
    and repeated rows are redacted like any other.  A null text stays null, an
    empty one empty; all columns stay; an empty table gives no rows.
    """
    own = docs.columns
    key, at_key = fresh(own, "digest"), len(own)
    texts = own.index("text")
    spans = _found(docs, rules).select(F.col("digest").alias(key), F.concat("base", "found").alias("spans")).filter(F.size("spans") > 0)
    spans = durable(spans.dropDuplicates([key]).select(key, F.col("spans").alias(fresh([*own, key], "spans"))))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.blake2b((x or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in batch.column(texts).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*own, key])

    rows = docs.mapInArrow(digest, T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())])).join(spans, key, "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_texts = []
            for text, found in zip(batch.column(texts).to_pylist(), batch.column(at_key).to_pylist(), strict=True):
                out, done = [], 0
                for x in sorted(found or [], key=lambda x: (x["start"], -x["end"])):
                    if x["start"] >= done:
                        out += [text[done : x["start"]], f"[{x['kind'].upper()}]"]
                    done = max(done, x["end"])
                out_texts.append(text if text is None else "".join(out) + text[done:])
            yield pa.RecordBatch.from_arrays([pa.array(out_texts, batch.column(texts).type) if i == texts else batch.column(i) for i in range(len(own))], own)

    return rows.mapInArrow(run, docs.schema)
