"""Helpers that the training-data operators share: the shared folder, written intermediate tables, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.session import scratch, shared_dir, written as table  # noqa: F401

#: The six separators of a word, `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    r"""The words `[^\x20\x09-\x0D]+` of a text as an array; null and blank texts have none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def without(text: Column, chars: str) -> Column:
    """text without the given characters."""
    return F.translate(text, chars, "")
