"""Wiki and HTML markup, as native expressions; only balanced braces need Python."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import format_name, is_special_title

# Templates that mark a disambiguation page.
DISAMBIGUATION_TEMPLATES = ("disambig", "airport disambiguation", "call sign disambiguation", "chinese title disambiguation", "geodis", "hdis", "hospital disambiguation", "letter disambiguation", "letter-numbercombdisambig", "mathematical disambiguation", "molecular formula disambiguation", "numberdis", "school disambiguation", "species latin name disambiguation", "wikipedia disambiguation")

# Pattern and replacement of the steps from markup to the text that is indexed, in order.
INDEX_TEXT_STEPS = (("&gt;", ">"), ("&lt;", "<"), (r"(?s)<ref.*?</ref>", " "), (r"</?.*?>", " "), (r"(?s)\{\{.*?\}\}", " "), (r"\[\[.*?:.*?\]\]", " "), (r"\[\[(.*?)\]\]", "$1"), (r"(?s)<!--(.*?)-->", " "), (r"\[.*?\]", " "), ("'+", ""), (r"\|", " "))
# The same for the page parser's text.
PAGE_TEXT_STEPS = (("&gt;", ">"), ("&lt;", "<"), (r"<ref>.*?</ref>", " "), (r"</?.*?>", " "), (r"\{\{.*?\}\}", " "), (r"\[\[.*?:.*?\]\]", " "), (r"\[\[(.*?)\]\]", "$1"), (r"\s(.*?)\|(\w+\s)", " $2"), (r"\[.*?\]", " "), ("'+", ""))


#: A step that looks for a bar from every blank of a line; texts without one skip it.
_BAR_STEP = r"\s(.*?)\|(\w+\s)"
_BAR_BY = " $2"


def _replaced(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, by in steps:
        if pattern == _BAR_STEP:
            # In a lambda the text so far is one variable, worked out once.
            guarded = F.transform(F.array(text), lambda x: F.when(F.contains(x, F.lit("|")), F.regexp_replace(x, _BAR_STEP, _BAR_BY)).otherwise(x))
            text = F.element_at(guarded, 1)
        else:
            text = F.regexp_replace(text, pattern, by)
    return text


def index_text(text: Column) -> Column:
    return _replaced(text, INDEX_TEXT_STEPS)


def page_text(text: Column) -> Column:
    return _replaced(text, PAGE_TEXT_STEPS)


def is_stub(text: Column) -> Column:
    return F.contains(text, F.lit("-stub}}"))


def is_disambiguation(title: Column, text: Column) -> Column:
    """By title, or by a template at the beginning of a line; the text of a stub doesn't count."""
    templates = "|".join(map(re.escape, DISAMBIGUATION_TEMPLATES)).replace("\\ ", " ")
    return F.contains(title, F.lit("(disambiguation)")) | (~is_stub(text) & text.rlike(rf"(?im)^\s*\{{\{{({templates})"))


def links(text: Column) -> Column:
    """Links in order: array of (target, anchor, position in code points from 0).

    The anchor is the formatted second part where there are just two, the target
    where there is one or more than two, null if it is blank.  Special and blank
    targets are left out.
    """
    inner = F.regexp_extract_all(text, F.lit(r"\[\[(.*?)\]\]"), F.lit(1))
    # Between the links lies what the same expression splits off; running lengths give the places.
    gaps = F.split(text, r"\[\[.*?\]\]")
    zipped = F.transform(inner, lambda x, i: F.struct(x.alias("link"), F.length(F.element_at(gaps, i + 1)).alias("gap")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    places = F.aggregate(
        zipped,
        start,
        lambda seen, x: F.struct((seen["at"] + x["gap"] + F.length(x["link"]) + 4).alias("at"), F.array_append(seen["out"], seen["at"] + x["gap"]).alias("out")),
        lambda seen: seen["out"],
    )
    placed = F.zip_with(inner, places, lambda x, at: F.struct(x.alias("link"), at.alias("position")))

    def parted(x: Column) -> Column:
        parts = F.split(F.regexp_replace(x["link"], r"\|+$", ""), r"\|")
        target = F.element_at(parts, 1)
        anchor = F.when(F.size(parts) == 2, format_name(F.try_element_at(parts, F.lit(2)))).otherwise(format_name(target))
        return F.struct(F.when(~is_special_title(target), format_name(target)).alias("target"), anchor.alias("anchor"), x["position"].alias("position"))

    return F.filter(F.transform(placed, parted), lambda x: x["target"].isNotNull())


def categories(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[Category:(.*?)\]\]"), F.lit(1)), lambda x: F.substring_index(x, "|", 1))


def translated_title(text: Column, language: str) -> Column:
    """Title in another language, null if there is none."""
    pattern = rf"(?m)^\[\[{re.escape(language)}:(.*?)\]\]$"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def html_links(html: Column) -> Column:
    """Anchors of raw HTML: array of (href, anchor)."""
    pattern = r'(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    hrefs, anchors = (F.regexp_extract_all(html, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(hrefs.alias("href"), anchors.alias("anchor"))


def _balanced(text: str, begin: str, at: int) -> int | None:
    """End of the braces that open at a place, or None."""
    depth = 2
    for i in range(at + len(begin), len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i + 1
    return None


def infobox_text(text: str | None) -> str | None:
    """The first infobox with its braces, without citations, references and tags; None if there is none that ends."""
    begin = "{{Infobox"
    at = -1 if text is None else text.find(begin)
    end = None if at < 0 else _balanced(text, begin, at)
    if end is None:
        return None
    box = text[at:end]
    while (cite := box.find("{{cite")) >= 0:
        close = _balanced(box, "{{cite", cite) or len(box)
        box = box[:cite] + box[close:]
    box = box.replace("&gt;", ">").replace("&lt;", "<")
    box = re.sub(r"<ref.*?>.*?</ref>", " ", box)
    return re.sub(r"</?.*?>", " ", box)


@F.pandas_udf(T.StringType())
def infobox(text: pd.Series) -> pd.Series:
    return text.map(infobox_text, na_action="ignore")
