"""Text expressions: tokens, words, excerpts and the lexical score, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a word of a search is.
TOKEN = r"[A-Za-z_]+|\d+(?:\.\d+)*"
#: Words that a query is searched without.
STOPWORDS = (
    "a an and are as at be by for from has have in is it its of on or that the "
    "this to was were will with what which how why when do does did i you we"
).split()


#: Words that say nothing about what a claim is grounded in.
UNGROUNDED = (
    "a an and are as at be been but by can could do does for from had has have if in into is it its may might must not of on or should so than that "
    "the their there these they this those to was were will with would we you our your"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Lower-cased words and dotted numbers, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def char_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4.0)).cast("bigint")


def collapsed(text: Column) -> Column:
    return F.array_join(words(text), " ")


def fingerprint(kind: Column, content: Column) -> Column:
    """Identity of a state item: its type and its lower-cased content with single spaces."""
    return F.concat_ws("\x1f", kind, collapsed(F.lower(content)))


def first_words(text: Column, budget: int, marker: str = "") -> Column:
    """The text if it has at most ``budget`` words, else as many as leave room for the marker, and the marker."""
    own, extra = words(text), len(marker.split())
    cut = F.concat(F.array_join(F.slice(own, 1, max(0, budget - extra)), " "), F.lit(f" {marker}" if marker else ""))
    return F.when(F.size(own) <= budget, text).otherwise(cut)


def query_terms(query: str) -> list[str]:
    import re

    return [t for t in (x.lower() for x in re.findall(TOKEN, query)) if t not in STOPWORDS]


def score(own: Column, terms: list[str]) -> Column:
    """Damped, length-weighted term counts times half plus the share of the terms found; 0 without terms."""
    def times(term: str) -> Column:
        return F.size(F.filter(own, lambda x: x == term))

    total, found = F.lit(0.0), F.lit(0)
    for t in terms:
        n = times(t)
        weight = (1.0 + min(len(t), 12) / 6.0) * (2.0 if any(c.isdigit() for c in t) else 1.0)
        total = total + F.when(n > 0, F.lit(weight) * (F.lit(1.0) + F.log(n))).otherwise(F.lit(0.0))
        found = found + (n > 0).cast("int")
    return total * (F.lit(0.5) + found / F.lit(float(len(terms)))) if terms else F.lit(0.0)


def excerpt(text: Column, terms: list[str], before: int = 80, length: int = 240) -> Column:
    """``length`` characters from ``before`` the first place of any term, single-spaced, with an ellipsis where the start is cut."""
    places = F.filter(F.array(*[F.instr(F.lower(text), t) for t in terms]), lambda p: p > 0)
    first = F.coalesce(F.array_min(places), F.lit(1))
    start = F.greatest(F.lit(0), first - 1 - before)
    return F.concat(F.when(start > 0, F.lit("… ")).otherwise(F.lit("")), collapsed(F.substring(text, start + 1, F.lit(length))))


def overlap(claim: Column, source: Column) -> Column:
    """Share of the claim's distinctive words that stand somewhere in the source; 1 if it has none."""
    own = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(claim), F.lit(r"[a-z0-9][a-z0-9._-]*"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(UNGROUNDED)))
    hits = lambda ws, text: F.size(F.filter(ws, lambda w: F.contains(text, w)))
    return let(own, lambda ws: F.when(F.size(ws) == 0, F.lit(1.0)).otherwise(let(F.lower(source), lambda text: hits(ws, text)) / F.size(ws)))


def unit(value: Column) -> Column:
    """A number clamped to 0..1; 0.5 for what is not a number, a truth value too."""
    return F.when(F.typeof(value) == "boolean", F.lit(0.5)).otherwise(_clamped(value))


def _clamped(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value.try_cast("double"), F.lit(0.5))))
