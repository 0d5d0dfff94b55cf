r"""Line dedup by distinct-site spread (native: DataFrame functions only).

Lines are keyed by two 64-bit hashes of their trimmed text. One aggregation, combined before its shuffle, gives each key's HyperLogLog sketch of
the sites that have it, and the first place it stands in. A key whose estimate is clear of the threshold by the margin is decided by it; keys
near the threshold get an exact distinct count, from one row per key and site. A line that at least `min_sites` sites have is boilerplate and
is removed from every document, except from the first place, so that no content is lost altogether.

What goes is told to a text by its id and two hashes of the text itself, so rows that repeat an id, or have none, are judged by their own lines,
and no id that many rows share is a hot key.

Edge cases: lines are trimmed of `[\x20\x09-\x0D]` for comparison; every line that isn't blank counts, however short (`min_words` = 1; a line of a
script without spaces is one word), and a caller may ask for more words; blank lines stay; a null site counts as a site of its own; a null text
stays null and a text of which all lines go becomes empty; a line's first place is its smallest (doc_id, position), null ids last and together; the
first place is kept in every row of that id that has the line there; a text's lines are taken through in time proportional to its length; further
columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import SPACES, n_words, table

LAST = 2**63 - 1


def _keys(line: Column) -> list[Column]:
    bare = F.btrim(line, F.lit(SPACES))
    return [F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2")]


#: What tells rows apart: the id (null: LAST) and two hashes of the text.
ROW = ["doc_id", "t1", "t2"]


def _row() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def _lines(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """A row per line that can be boilerplate: h1, h2, site, ROW, at."""
    return (
        docs.select(*_row(), F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .where(n_words(F.col("line")) >= min_words)
        .select(*_keys(F.col("line")), "site", *ROW, "at")
    )


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = 5, min_words: int = 1, log2_k: int = 12) -> DataFrame:
    """The lines that at least min_sites sites have: h1, h2, sites (the estimate, or near the threshold the exact count), first (struct doc_id, at)."""
    lines = _lines(docs, site, min_words)
    margin = max(1, math.ceil(4 * 1.04 / math.sqrt(2**log2_k) * min_sites))
    # A line of fewer occurrences than min_sites can't have that many sites: known before any sketch is compared.
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(log2_k)).alias("sketch"), F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_sites)
    spread = table(spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - margin), "line-spread")
    near = spread.where(F.col("sites") < min_sites + margin)
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    known = spread.join(exact, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("exact", "sites").alias("sites"), "first").where(F.col("sites") >= min_sites)
    return table(known, "boilerplate")


def remove_lines(docs: DataFrame, site: str = "source", min_sites: int = 5, min_words: int = 1) -> DataFrame:
    """docs with the boilerplate lines taken out of text; every row and column stays. Adds nothing but replaces text."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], "doc_id", F.col(f"`{site}`").alias("site"), "text")
    marked = with_removed(own, "site", min_sites, min_words)
    return marked.select(*[F.col("clean" if c == "text" else n).alias(c) for c, n in names.items()])


def with_removed(docs: DataFrame, site: str, min_sites: int, min_words: int) -> DataFrame:
    """docs with clean (the text that stays) and gone (the number of lines that went); docs has no columns of the names used here."""
    found = boilerplate(docs.select("doc_id", site, "text"), site, min_sites, min_words)
    gone = (
        _lines(docs, site, min_words)
        .join(found.select("h1", "h2", "first"), ["h1", "h2"])
        .where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
        .select(*ROW, "at").distinct().groupBy(*ROW).agg(F.collect_list("at").alias("removed"))
    )
    gone = table(gone, "lines-gone")  # positions only: a few bytes a line, and no more than the text has lines
    rows = docs.select("*", *[c.alias(f"row_{n}") for c, n in zip(_row(), ROW)])
    # Always one exchange of the texts: whether the other side would fit a broadcast depends on the data.
    joined = rows.join(gone.select(*[F.col(n).alias(f"row_{n}") for n in ROW], "removed").hint("merge"), [f"row_{n}" for n in ROW], "left")
    # The lines are used twice, so the optimizer keeps this step apart and splits each text once.
    split = joined.select(*docs.columns, F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.split("text", "\n").alias("lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed"), lambda i: F.get("lines", i))
    return split.select(*docs.columns, F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean"), F.size("removed").cast("long").alias("gone"))


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = 5, min_words: int = 1) -> DataFrame:
    """The op5 result, a row per document: doc_id, n_lines, n_removed (long), clean_chars (long), clean_sha256 of the text that stays (null for a null text)."""
    rows = with_removed(docs.select("doc_id", site, "text"), site, min_sites, min_words)
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return rows.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.col("gone")).cast("long").alias("n_removed"), F.length("clean").cast("long").alias("clean_chars"), F.sha2(F.col("clean").cast("binary"), 256).alias("clean_sha256"))


def _sql(min_sites: int = 5, min_words: int = 1) -> str:
    return rf"""
WITH l AS (SELECT doc_id, coalesce('s' || source, '') AS site, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS x FROM documents)),
k AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l),
b AS (SELECT bare, min((doc_id, pos)) AS first FROM k WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {min_words} GROUP BY bare HAVING count(DISTINCT site) >= {min_sites}),
m AS (SELECT k.*, b.bare IS NOT NULL AND (k.doc_id, k.pos) <> b.first AS gone FROM k LEFT JOIN b USING (bare)),
c AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS clean FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, length(clean)::BIGINT AS clean_chars, sha256(clean) AS clean_sha256 FROM documents d LEFT JOIN c USING (doc_id)
"""


SQL = _sql()
