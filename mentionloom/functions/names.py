"""Normalising and testing names, as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Person titles before a name, and company or rank words after it, in the order they are tried.
NAME_PREFIXES = ("mrs.", "mrs ", "mr.", "mr ", "ms.", "ms ", "prof.", "prof ", "dr.", "dr ", "gen.", "gen ", "rep.", "rep ", "sen.", "sen ", "st.", "st ", "sr.", "sr ", "jr.", "jr ", "capt.", "capt ")
NAME_SUFFIXES = (" jr.", " jr ", " ltd.", " ltd", " co.", " co", " corp.", " corp", " dept.", " dept", " div.", " div", " gen.", " gen", " gov.", " gov", " inc.", " inc")

# Titles of pages that are no entities.
SPECIAL_PREFIXES = ("list of", "table of", "file:", "wikipedia:", "category:", "template:", "help:", "portal:", "module:", "mos:")

# English stop words of the text index.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")

# Part-of-speech tags of function words.
STOP_TAGS = ("IN", "DT", "TO", "CD", "CC", "MD", "PDT", "PRP")


def format_name(name: Column) -> Column:
    """White space runs and underscores to one blank, trimmed, first letter up; null if nothing is left."""
    x = F.trim(F.translate(F.regexp_replace(name, r"\s+", " "), "_", " "))
    return F.when(x != "", F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))


def alter_name(title: Column) -> Column:
    """A title without its appositive: up to the first "(", else the first ",", else the first " - "."""
    x = F.when(F.contains(title, F.lit("(")), F.substring_index(title, "(", 1))
    x = x.when(F.contains(title, F.lit(",")), F.substring_index(title, ",", 1))
    x = x.when(F.contains(title, F.lit(" - ")), F.substring_index(title, " - ", 1))
    return F.trim(x.otherwise(title))


def alias_key(name: Column) -> Column:
    """Key of the alias dictionary: single blanks, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def normalize_name(name: Column) -> Column:
    """Without titles in front and company words behind, each tried once in order, nor a dot at the end."""

    def front(seen: Column, word: Column) -> Column:
        return F.when(F.startswith(F.lower(seen), word), F.trim(F.substr(seen, F.length(word) + 1))).otherwise(seen)

    def back(seen: Column, word: Column) -> Column:
        return F.when(F.endswith(F.lower(seen), word), F.trim(F.substr(seen, F.lit(1), F.length(seen) - F.length(word)))).otherwise(seen)

    # A fold over an array keeps the expression small; nested cases would double at each word.
    x = F.aggregate(F.array(*map(F.lit, NAME_PREFIXES)), name, front)
    x = F.aggregate(F.array(*map(F.lit, NAME_SUFFIXES)), x, back)
    return F.trim(F.regexp_replace(x, r"\.$", ""))


def normalize_person_name(name: Column) -> Column:
    """A blank after every dot that has none, but at the end."""
    return F.regexp_replace(name, r"\.(?=[^ ])", ". ")


def normalize_location_name(name: Column) -> Column:
    return F.replace(name, F.lit("."), F.lit(""))


def entity_id(name: Column, kind: Column) -> Column:
    """Upper-cased name without signs, "#", type."""
    return F.concat(F.regexp_replace(F.upper(name), r"[^\w ]", ""), F.lit("#"), kind)


def is_special_title(title: Column) -> Column:
    """Null or empty, a reserved prefix in any case, or a "#" anywhere."""
    low = F.lower(title)
    reserved = reduce(lambda a, b: a | b, (F.startswith(low, F.lit(x)) for x in SPECIAL_PREFIXES))
    return F.coalesce(title == "", F.lit(True)) | reserved | F.contains(title, F.lit("#"))


def is_disambiguation_name(short: Column, long: Column) -> Column:
    """Whether every character of the short name occurs somewhere in the long one."""
    return F.size(F.array_except(F.split(F.lower(short), ""), F.split(F.lower(long), ""))) == 0


def is_stop_word(term: Column) -> Column:
    return F.coalesce(F.lower(term).isin(*STOP_WORDS, ""), F.lit(True))


def is_useful(token: Column) -> Column:
    return (F.length(token) >= 2) & (token != "\\*")


def is_abbreviation(name: Column, kind: Column) -> Column:
    """One word of 2 to 10 signs that starts with a letter or digit and has two capitals; no location."""
    shape = name.rlike(r"^[\p{L}\p{Nd}][^ ]{1,9}$") & (F.regexp_count(name, F.lit(r"\p{Lu}")) >= 2)
    return F.coalesce(shape, F.lit(False)) & ~kind.eqNullSafe("LOC")


def is_punctuation(word: Column, begin: Column, end: Column) -> Column:
    """A token without letter, digit or apostrophe, or one spelt otherwise than in the text (end inclusive); not "&"."""
    odd = (F.length(word) != end + 1 - begin) | ~word.rlike(r"[\p{L}\p{Nd}']")
    return (word != "&") & odd


def is_stop_token(word: Column, tag: Column) -> Column:
    return F.coalesce(tag.isin(*STOP_TAGS), F.lit(False)) | word.rlike("[<>?]")


def contains_upper(word: Column) -> Column:
    return word.rlike(r"\p{Lu}")


def ends_with_name(long: Column, short: Column) -> Column:
    """Whether the long name ends with the short one, from a word boundary, in any case."""
    low = F.lower(short)
    before = F.substr(F.lower(long), F.lit(1), F.length(long) - F.length(short))
    # A boundary lies between a word sign and another; the ends count as others.
    return F.endswith(F.lower(long), low) & (before.rlike(r"\w$") != low.rlike(r"^\w"))


def sort_characters(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, "")), "")


def extract_abbreviation(name: Column, use_first: bool) -> Column:
    """Capitals of each word; with use_first, a word without one gives its first sign."""

    def letters(token: Column) -> Column:
        capitals = F.regexp_replace(token, r"[^\p{Lu}]", "")
        return F.when(capitals == "", F.substring(token, 1, 1)).otherwise(capitals) if use_first else capitals

    return F.array_join(F.transform(F.split(name, " "), letters), "")
