"""Search terms of questions and of code, as column expressions.

A null text gives no terms.  Terms keep the order in which they first occur.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms.
STOP_WORDS = (
    "self return def the a an of to in is are be and or for on by with from this that it its "
    "where what how which does do done when why who can should would there into as at"
).split()
#: An identifier of at least three signs.
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{2,}"


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({pattern})"), 1)


def identifier_parts(word: Column) -> Column:
    """Lower-case parts of an identifier in camel or snake case."""
    cut = F.regexp_replace(F.regexp_replace(word, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z])([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(cut), "_"), lambda p: p != "")


def _useful(terms: Column) -> Column:
    return F.array_distinct(F.filter(terms, lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS)))


def base_terms(text: Column) -> Column:
    """The parts of all words, without stop words."""
    return _useful(F.flatten(F.transform(_all(text, r"\w+"), identifier_parts)))


def expanded_terms(text: Column) -> Column:
    """The parts of all words and, of words with several, both joined forms; no stop words."""

    def forms(parts: Column) -> Column:
        joined = F.array(F.array_join(parts, ""), F.array_join(parts, "_"))
        return F.when(F.size(parts) > 1, F.concat(parts, joined)).otherwise(parts)

    return _useful(F.flatten(F.transform(_all(text, r"\w+"), lambda w: forms(identifier_parts(w)))))


def identifier_words(text: Column) -> Column:
    """Distinct parts of the identifiers of a text that have several."""
    parts = F.transform(F.array_distinct(_all(text, IDENTIFIER)), identifier_parts)
    return F.array_distinct(F.flatten(F.filter(parts, lambda p: F.size(p) > 1)))


def simple_tokens(text: Column) -> Column:
    """Runs of two or more word signs, with camel case divided."""
    return _all(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), r"\w{2,}")


def last_component(name: Column) -> Column:
    """What stands behind the last dot of a qualified name, up to a space."""
    return F.split(F.element_at(F.split(name, r"\."), -1), " ")[0]
