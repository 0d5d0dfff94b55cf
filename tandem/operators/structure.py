"""Outlines and articles: structural comparison, text building, section de-duplication, licence flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import measures as M
from tandem.functions import urls as U


def outline(sections: Column, level: str = "level", name: str = "title") -> Column:
    """array<struct<lvl, name>> of sections with 'h1'..'h3' levels; sections without a name don't count."""
    parts = F.transform(sections, lambda s: F.struct(M.level_of(s[level]).alias("lvl"), U.norm_space(s[name]).alias("name")))
    return F.filter(parts, lambda p: p["name"] != "")


def compare(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with outlines a and b (array<struct<lvl, name>>) -> E14 columns beside the others. Null outlines are empty."""
    empty = F.array().cast("array<struct<lvl:int,name:string>>")
    names = lambda c: F.col(f"_{c}")["name"]
    levels = lambda c: F.col(f"_{c}")["lvl"]
    own = [c for c in pairs.columns if c not in (a, b)]
    step = pairs.select(*own, F.coalesce(F.col(a), empty).alias("_a"), F.coalesce(F.col(b), empty).alias("_b"))
    step = step.select("*", M.lcs_length(names("a"), names("b")).alias("_lcs"), M.indent_clamped(levels("a")).alias("_ca"), M.indent_clamped(levels("b")).alias("_cb"))
    step = step.select("*", M.tree_signature(F.col("_ca")).alias("_ta"), M.tree_signature(F.col("_cb")).alias("_tb"))
    na, nb = F.size("_a").cast("long"), F.size("_b").cast("long")
    return step.select(
        *own,
        M.overlap_ratio(F.col("_lcs"), F.col("_a"), F.col("_b")).alias("lcs_ratio"),
        M.jaccard(names("a"), names("b")).alias("jaccard"),
        M.histogram_cosine(M.depth_histogram(levels("a")), M.depth_histogram(levels("b"))).alias("depth_cosine"),
        M.overlap_ratio(M.lcs_length("_ta", "_tb"), F.col("_ta"), F.col("_tb")).alias("shape_similarity"),
        na.alias("a_outline_length"),
        nb.alias("b_outline_length"),
        (nb - na).alias("outline_length_diff"),
        F.try_divide(nb.cast("double"), na.cast("double")).alias("outline_length_ratio"),
    )


def text_a(sections: Column) -> Column:
    """Corpus A: '# ' before the abstract, '## ' before other sections, their parts' value or text, blank lines between."""
    head = lambda s: F.concat(F.when(F.lower(s["name"]) == "abstract", "# ").otherwise("## "), s["name"])
    body = lambda s: F.filter(F.transform(s["has_parts"], lambda p: F.coalesce(p["value"], p["text"])), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.trim(F.array_join(F.flatten(F.transform(sections, lambda s: F.concat(F.array(head(s)), F.coalesce(body(s), F.array().cast("array<string>"))))), "\n\n"))


def text_b(sections: Column) -> Column:
    """Corpus B: '#' to '###' by level, then the texts of the section's content."""
    head = lambda s: F.concat(F.repeat(F.lit("#"), M.level_of(s["level"])), F.lit(" "), s["title"])
    body = lambda s: F.filter(F.transform(s["content"], lambda p: p["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.trim(F.array_join(F.flatten(F.transform(sections, lambda s: F.concat(F.array(head(s)), F.coalesce(body(s), F.array().cast("array<string>"))))), "\n\n"))


def dedup_sections(sections: Column) -> Column:
    """h1 sections lose the content that any other section has by (type, text), one after another; so content of two h1s stays in the later one,
    and all lists of a type share one key, as their text is null. A section needs level and content: array<struct<type, text, ...>>."""
    same = lambda x, y: x["type"].eqNullSafe(y["type"]) & x["text"].eqNullSafe(y["text"])

    def step(acc: Column, i: Column) -> Column:
        others = F.flatten(F.filter(F.transform(acc, lambda s, j: F.when(j != i, F.coalesce(s["content"], F.slice(s["content"], 1, 0)))), lambda c: c.isNotNull()))
        return F.transform(acc, lambda s, j: F.when((j == i) & (s["level"] == "h1"), s.withField("content", F.filter(s["content"], lambda c: ~F.exists(others, lambda o: same(o, c))))).otherwise(s))

    return F.when(F.size(sections) > 0, F.aggregate(F.sequence(F.lit(0), F.size(sections) - 1), sections, step)).otherwise(sections)


def licence_split(articles: DataFrame, paragraphs: str = "paragraphs", phrase: str = M.LICENCE) -> DataFrame:
    """articles with licensed: one column instead of two title lists."""
    return articles.withColumn("licensed", M.has_phrase(F.col(paragraphs), phrase))
