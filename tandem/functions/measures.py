"""Buckets, similarities, arrays and text measures: column in, column out."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: The quantile of a two-sided 95 % interval of the normal distribution.
Z95 = 1.959963984540054


def score_bucket(score: Column) -> Column:
    """0 to 4 by edges i * 0.2 as floating point gives them, 1.0 in the last; null outside 0 to 1."""
    edges = [(i * 0.2, (i + 1) * 0.2) for i in range(5)]
    whens = reduce(lambda c, i: c.when((score >= F.lit(edges[i][0])) & (score < F.lit(edges[i][1])), i), range(1, 5), F.when((score >= F.lit(0.0)) & (score < F.lit(0.2)), 0))
    return whens.when(score == 1.0, 4)


def half_even_bucket(score: Column) -> Column:
    return F.coalesce((F.bround(score * 5, 0) / 5).cast("string"), F.lit("No score"))


#: Last chunk of each band and its label.
CHUNK_BANDS = [(0, "1"), (1, "2"), (2, "3"), (3, "4"), (4, "5"), (10, "6-10"), (20, "11-20"), (30, "21-30"), (40, "31-40"), (50, "41-50"), (75, "51-75"), (100, "76-100"), (125, "101-125"), (150, "126-150"), (175, "151-175"), (200, "176-200"), (250, "201-250"), (300, "251-300"), (350, "301-350"), (400, "351-400")]


def chunk_band(chunk: Column) -> Column:
    first, *rest = CHUNK_BANDS
    return reduce(lambda c, b: c.when(chunk <= b[0], b[1]), rest, F.when(chunk == first[0], first[1])).otherwise(">400")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def depth_histogram(levels: Column) -> Column:
    """map<int, int>: how often each level occurs."""
    return F.map_from_entries(F.transform(F.array_distinct(levels), lambda x: F.struct(x, F.size(F.filter(levels, lambda y: y == x)))))


def histogram_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps level -> count: 1 if both are empty, 0 if one is."""
    dot = F.aggregate(F.map_values(F.map_zip_with(a, b, lambda _, x, y: (F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0))).cast("double"))), F.lit(0.0), lambda s, x: s + x)
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


@F.pandas_udf(IntegerType())
def lcs_length(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest common subsequence, bit-parallel over Python integers: one pass over b with a word per element of a."""

    def length(a, b) -> int:
        if a is None or b is None or len(a) == 0 or len(b) == 0:
            return 0
        where: dict = {}
        for i, x in enumerate(a):
            where[x] = where.get(x, 0) | 1 << i
        row, full = 0, (1 << len(a)) - 1
        for x in b:
            hits = row | where.get(x, 0)
            row = hits & (hits ^ (hits - (row << 1 | 1))) & full
        return row.bit_count()

    for a, b in pairs:
        yield pd.Series([length(x, y) for x, y in zip(a, b)], dtype="int32")


def indent_clamped(levels: Column) -> Column:
    """Levels as a tree's: at least 1 and at most one deeper than the one before."""
    return F.aggregate(levels, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.greatest(F.lit(1), F.least(x, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(1)) + 1)).cast("int"))))


def tree_signature(clamped: Column) -> Column:
    """The first level, then the differences."""
    before = F.concat(F.array(F.lit(0)), clamped)
    return F.transform(clamped, lambda x, i: x - F.get(before, i))


def overlap_ratio(lcs: Column, a: Column, b: Column) -> Column:
    return lcs / F.greatest(F.size(a), F.size(b), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm))


def proportion(x: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(x.cast("double"), total.cast("double")), F.lit(0.0))


def level_of(tag: Column) -> Column:
    """'h3' is 3, anything else 2."""
    return F.when(tag.rlike(r"^h\d+$"), F.substring(tag, 2, 9).cast("int")).otherwise(2)


def whitespace_tokens(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def windows(tokens: Column, window: int = 250, stride: int = 150) -> Column:
    """array<array>: token windows until one reaches the end; none for no tokens."""
    n = F.size(tokens)
    count = F.least(F.greatest(F.ceil((n - window) / F.lit(stride)), F.lit(0)) + 1, F.ceil(n / F.lit(stride))).cast("int")
    return F.when(n == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(tokens, k * stride + 1, window)))


#: Patterns of book citations.
ISBN = r"(?i)(?:ISBN[-:]?\s*)?(?:(?:978|979)[- ]?\d{1,5}[- ]?\d{1,7}[- ]?\d{1,6}[- ]?\d|\d{1,5}[- ]?\d{1,7}[- ]?\d{1,6}[- ]?[\dX])"
ISBN_STRICT = r"(?i)ISBN[-:]?\s*[\dX][\dX -]{8,16}|(?:978|979)[- ]?(?:\d[- ]?){9}\d"
PAGE = r"(?i)\b(?:p\.?|pp\.?|page|pages)\s+\d+(?:[-–]\d+)?"


def contains_isbn(text: Column) -> Column:
    return F.coalesce(text.rlike(ISBN), F.lit(False))


def contains_isbn_strict(text: Column) -> Column:
    """Only what says ISBN or has thirteen digits from 978 or 979."""
    return F.coalesce(text.rlike(ISBN_STRICT), F.lit(False))


def contains_books_link(text: Column) -> Column:
    return F.coalesce(F.lower(text).contains("books.google.com"), F.lit(False))


def contains_year(text: Column) -> Column:
    return F.coalesce(F.exists(F.regexp_extract_all(text, F.lit(r"(\d{4})"), F.lit(1)), lambda y: y.cast("int").between(1000, 2999)), F.lit(False))


def contains_page(text: Column) -> Column:
    return F.coalesce(text.rlike(PAGE), F.lit(False))


def is_book(texts: Column, strict: bool = False) -> Column:
    """texts: array of a reference's fields, nulls allowed."""
    some = lambda test: F.exists(F.array_compact(texts), test)
    return some(contains_isbn_strict if strict else contains_isbn) | some(contains_books_link) | (some(contains_year) & some(contains_page))


#: Fixed values.
LICENCE = r"The content is adapted fromWikipedia, licensed under Creative Commons Attribution-ShareAlike 4.0 License"
STATUSES = {"Generally reliable": "reliable", "Generally unreliable": "unreliable", "Blacklisted": "blacklist", "No consensus": "no_consensus", "Deprecated": "deprecated"}
STATUS_CODES = {"gr": "generally_reliable", "d": "deprecated", "gu": "generally_unreliable", "nc": "no_consensus", "b": "blacklisted"}
CONTINENTS = ["Asia", "Europe", "Americas", "Africa", "Oceania"]


def has_phrase(paragraphs: Column, phrase: str = LICENCE) -> Column:
    return F.coalesce(F.exists(paragraphs, lambda p: F.coalesce(p.rlike(phrase), F.lit(False))), F.lit(False))


def status_name(status: Column) -> Column:
    """Short names of source statuses; others lower-case, null is 'other'."""
    known = F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, status), F.lower(status), F.lit("other"))


def topic_prefix(topic: Column) -> Column:
    return F.split_part(topic, F.lit("."), F.lit(1))


def topic_second(topic: Column) -> Column:
    return F.substring_index(topic, ".", 2)


def region_topic(topic: Column) -> Column:
    return F.when(topic.contains("Region"), topic)


def topic_part(topic: Column, i: int) -> Column:
    return F.get(F.split(region_topic(topic), r"\."), F.lit(i))


def continent(topic: Column) -> Column:
    """The part after 'Regions', as one of CONTINENTS by its beginning."""
    parts = F.split(topic, r"\.")
    at = F.array_position(parts, "Regions")
    part = F.lower(F.when(at > 0, F.get(parts, at.cast("int"))))
    return reduce(lambda c, v: c.when(part.startswith(v.lower()), v), CONTINENTS[1:], F.when(part.startswith(CONTINENTS[0].lower()), CONTINENTS[0]))


def region_key(region: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.substring_index(region, ".", -1)), "[ -]", "_"))


def us_party(label: Column) -> Column:
    return F.when(label.isin("Democratic Party", "Republican Party"), label).otherwise("Other")


def uk_party(label: Column) -> Column:
    x = F.lower(label)
    return F.when(x.contains("labour"), "Labour Party").when(x.contains("conservative") & ~x.contains("unionist"), "Conservative Party").when(x.contains("reform uk"), "Reform UK").otherwise("Other")


def criticality(value: Column) -> Column:
    x = F.lower(value)
    return F.when(x.isin("critical", "non-critical"), x).otherwise("other")


def issue_types(value: Column) -> Column:
    """The types of an issue: split at '|', trimmed, empties dropped; ['other'] for null and blank."""
    bare = F.trim(value)
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array(F.lit("other"))).when(bare.contains("|"), F.filter(F.transform(F.split(bare, r"\|"), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array(bare))


def edit_count(button: Column) -> Column:
    return F.nullif(F.regexp_extract(button, r"\((\d+)\)", 1), F.lit("")).cast("int")
