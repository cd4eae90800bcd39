"""Names of one document that mean the same: a documented subset of orthographic matching.

Two names of compatible types match if they are equal in any case, if the shorter
stands at either end of the longer as whole words, if one is made of the capitals of
the other, or if a table of nicknames or aliases pairs them.  Every chain takes its
longest name (the first of them, by place).  Groups are documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _key(name: str) -> str:
    return " ".join(name.lower().replace(".", "").split())


def names_match(a: str, b: str, pairs: frozenset[tuple[str, str]] = frozenset()) -> bool:
    x, y = _key(a), _key(b)
    if x == y or (x, y) in pairs or (y, x) in pairs:
        return True
    short, long = sorted((x.split(), y.split()), key=len)
    if short and len(short) < len(long) and (long[: len(short)] == short or long[-len(short) :] == short):
        return True
    for one, other in ((a, b), (b, a)):
        capitals = "".join(w[0] for w in other.split() if w[:1].isupper())
        if len(capitals) > 1 and one.replace(".", "") == capitals:
            return True
    return False


def resolve_chains(mentions: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Add canonical_name and canonical_type.

    mentions: doc_id, mention_id, name, ner_type, in the order of mention_id.
    pairs: a, b: nicknames and aliases in lower case; a lookup table of bounded size.
    """
    known = frozenset((x["a"], x["b"]) for x in pairs.collect()) if pairs is not None else frozenset()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("mention_id")
        chains: list[list[int]] = []
        names, kinds = group["name"].tolist(), group["ner_type"].tolist()
        for i, name in enumerate(names):
            for chain in chains:
                if any((kinds[i] == kinds[j] or "MISC" in (kinds[i], kinds[j])) and names_match(name, names[j], known) for j in chain):
                    chain.append(i)
                    break
            else:
                chains.append([i])
        best = [""] * len(names)
        types = [""] * len(names)
        for chain in chains:
            top = max(chain, key=lambda i: (len(names[i]), -i))
            for i in chain:
                best[i], types[i] = names[top], kinds[top]
        return group.assign(canonical_name=best, canonical_type=types)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mentions.schema) + ", canonical_name string, canonical_type string"
    return mentions.groupBy("doc_id").applyInPandas(run, schema)


def resolve_persons(mentions: DataFrame) -> DataFrame:
    """Person names inside a longer person name of the document take the first such one; adds canonical_name.

    Names are compared once each: a name's first longer holder is an equi-join on
    the document and an aggregation.
    """
    people = mentions.filter("ner_type = 'PER'").groupBy("doc_id", "name").agg(F.min("mention_id").alias("__at"))
    long = people.select("doc_id", F.col("name").alias("__long"), F.col("__at").alias("__first"))
    met = people.join(long, "doc_id").filter((F.length("__long") > F.length("name")) & F.contains("__long", F.col("name")))
    holder = met.groupBy("doc_id", "name").agg(F.min(F.struct("__first", "__long"))["__long"].alias("__holder"))
    rows = mentions.join(holder, ["doc_id", "name"], "left")
    return rows.withColumn("canonical_name", F.when(F.col("ner_type") == "PER", F.coalesce("__holder", "name")).otherwise(F.col("name"))).drop("__holder")
