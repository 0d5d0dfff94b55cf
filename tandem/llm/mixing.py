r"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the corpus's words by weight; a source's target stops at MOST times
its own words and the excess is shared again by weight: with sources in the order of their stop over their weight, the first k are stopped, and
all others get a level times their weight. Each document of a source is due target / source words copies: the whole ones are certain, and the
fraction gives its inclusion probability p, which is unequal: the fraction times the document's merit over the source's mean merit, within 0 and 1.
The merit is the number of binary digits of its size, so longer documents are likelier to be taken once more. For it, documents are ranked by
Q = (U / (1 - U)) / (p / (1 - p)), U being uniform from a hash of the doc_id, and the first in rank are taken until the words still due are reached:
a sample of fixed size, in words, with unequal probabilities.

The cut in rank is found without sorting: Q is mapped to 24 bits, and three rounds of sums over 256 bins, combined before their shuffle, narrow
the cut to one bin in 2^24 per source, which is taken if that brings the source nearer to its target. What is kept per source is one row.

Edge cases: null and blank texts have size 0 and are never taken, a text of any length is counted whole; a null source is one source, last in
order; rows that repeat a doc_id share its U and are ranked by it (with equal texts they are taken together); a null doc_id is told apart by its text;
ties in rank are taken together or not at all; if all texts are blank nothing is taken; reruns agree, on any partitioning; extra columns pass through
mixed_documents, whatever their names. A row per source is sorted in one task: sources are names of collections, some thousands at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import n_words, table

MOST = 3
SEED = "mix"
BITS = 24


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return n_words(F.col(text))


def merit(size: Column) -> Column:
    """The number of binary digits of a size."""
    return F.length(F.bin(size)).cast("long")


def key() -> Column:
    """What a document's U is drawn from."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sized: source, size. A row per source: source, source_size, target, rate (copies due of each document)."""
    by_source = table(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    # Windows over a row per source, not per document.
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    w = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("most", (MOST * F.col("source_size")).cast("double")).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    by_stop = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = w.withColumn("full", F.sum("most").over(by_stop) - F.col("most")).withColumn("open_w", F.sum("w").over(everything) - (F.sum("w").over(by_stop) - F.col("w")))
    # The level if this source and those after it are open; the first source that its level doesn't fill ends the stopped ones.
    w = w.withColumn("level", (F.col("total") - F.col("full")) / F.col("open_w"))
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), "level"))).over(everything)["level"]
    w = w.select("source", "source_size", F.least(F.col("most"), level * F.col("w")).alias("target"))
    return table(w.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(0.0)), "targets")


def _rank(p: Column) -> Column:
    """Q on 24 bits: floor(2^24 * Q / (1 + Q))."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.col("key"))), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48
    q = (u / (1 - u)) / (p / (1 - p))
    return F.floor(2.0**BITS * (q / (1 + q)))


def _with_rate(rows: DataFrame, due: DataFrame) -> DataFrame:
    """rows joined with due by source, null matching null. due has a row per source: small, so Spark broadcasts it, or else splits a hot source."""
    key = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit(""))
    return rows.withColumn("_key", key("source")).join(due.withColumn("_key", key("source")).drop("source"), "_key").drop("_key")


def _chance() -> Column:
    """The inclusion probability of the fraction that whole copies leave."""
    p = (F.col("rate") - F.floor("rate")) * merit(F.col("size")) / F.col("mean_merit")
    return F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))


def cuts(sized: DataFrame, due: DataFrame) -> DataFrame:
    """due with mean_merit and cut: documents of rank below it are taken once more. sized: key, source, size."""
    mean = sized.groupBy("source").agg(F.greatest(F.sum(merit(F.col("size")) * F.col("size")) / F.greatest(F.sum("size"), F.lit(1)), F.lit(1.0)).alias("mean_merit"))
    due = table(due.join(mean, due["source"].eqNullSafe(mean["source"])).drop(mean["source"]), "merits")
    ranked = _with_rate(sized, due).where((F.col("rate") > F.floor("rate")) & (F.col("size") > 0)).select("source", "size", _rank(_chance()).alias("rank"))
    open_ = due.select("source", F.lit(0).cast("long").alias("start"), ((F.col("rate") - F.floor("rate")) * F.col("source_size")).alias("left"))
    for level in (16, 8, 0):
        within = _with_rate(ranked, open_).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + (1 << (level + 8))))
        bins = within.groupBy("source", F.expr(f"shiftright(rank, {level})").alias("bin")).agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        bins = table(bins, "mix-bins")  # at most 256 rows a source
        run = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("before", F.sum("size").over(run) - F.col("size"))
        full = F.col("before") + F.col("size") <= F.col("left")
        # The first bin that the words still due don't fill; with every bin filled, the end of the last.
        found = bins.groupBy("source").agg(F.min(F.when(~full, F.struct("bin", "before", "size", "left"))).alias("b"), F.max("bin").alias("end"))
        if level:
            found = found.select("source", F.shiftleft(F.coalesce("b.bin", F.col("end") + 1), level).alias("start"), F.coalesce(F.col("b.left") - F.col("b.before"), F.lit(0.0)).alias("left"))
        else:
            nearer = F.col("b.size") / 2 < F.col("b.left") - F.col("b.before")
            found = found.select("source", F.when(F.col("b").isNull(), F.col("end") + 1).otherwise(F.col("b.bin") + nearer.cast("int")).alias("start"), F.lit(0.0).alias("left"))
        # A source without rows left in its bin keeps its start.
        kept = open_.alias("o").join(found.alias("f"), F.col("o.source").eqNullSafe(F.col("f.source")), "left")
        open_ = table(kept.select("o.source", F.coalesce("f.start", "o.start").alias("start"), F.coalesce("f.left", "o.left").alias("left")), "mix-cut")
    return table(due.alias("d").join(open_.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source"))).select("d.*", F.col("o.start").alias("cut")), "mix-cuts")


def copies() -> Column:
    """Copies of a document that the mix takes, from key, size, rate, mean_merit and cut."""
    extra = (F.col("rate") > F.floor("rate")) & (_rank(_chance()) < F.col("cut"))
    return F.when(F.col("size") > 0, F.least(F.lit(MOST), F.floor("rate") + extra.cast("int"))).otherwise(0).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken."""
    sized = table(docs.select("doc_id", "source", key().alias("key"), sizes(docs).alias("size")), "mix-sizes")
    due = cuts(sized, targets(sized, weights))
    return _with_rate(sized, due).select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: docs with each row as often as it is taken. The cut per source is enough to tell, so no text is shuffled."""
    sized = table(docs.select("source", key().alias("key"), sizes(docs).alias("size")), "mix-sizes")
    due = cuts(sized, targets(sized, weights))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], "source", key().alias("key"), sizes(docs).alias("size"))
    taken = _with_rate(rows, due).select(*names, copies().cast("int").alias("_n")).where("_n > 0")
    return taken.select(*names, F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_again")).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


#: What the mix takes, over a relation `documents_in` of doc_id, source, text.
_MIX = rf"""
d AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents_in),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, (3 * source_size)::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
l AS (SELECT *, (total - (sum(most) OVER o - most)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level FROM w WINDOW o AS (ORDER BY most / w, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least(most, (SELECT arg_min(level, most / w) FROM l WHERE level * w <= most) * w) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0, target / source_size) ELSE 0.0 END AS rate FROM t),
g AS (SELECT source, greatest(sum(length(bin(size)) * size) / greatest(sum(size), 1), 1) AS mean_merit FROM d GROUP BY source),
x AS (SELECT d.*, r.source_size, r.target, r.rate, least(greatest((r.rate - floor(r.rate)) * length(bin(size)) / mean_merit, 1e-9), 1 - 1e-9) AS p,
  (('0x' || substr(md5('{SEED}' || key), 1, 12))::BIGINT::DOUBLE + 0.5) / 2.0**48 AS u FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM x),
k AS (SELECT *, floor(16777216 * (q / (1 + q))) AS rank, rate > floor(rate) AND size > 0 AS part FROM q),
b AS (SELECT source, rank, sum(size) AS words, any_value((rate - floor(rate)) * source_size) AS due FROM k WHERE part GROUP BY source, rank),
c AS (SELECT *, due - (sum(words) OVER (PARTITION BY source ORDER BY rank) - words) AS left_ FROM b),
m AS (SELECT k.*, CASE WHEN size > 0 THEN least(3, floor(rate) + CASE WHEN part AND (words <= left_ OR words / 2 < left_) THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS copies
  FROM k LEFT JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.rank = c.rank)
"""
SQL = "WITH documents_in AS (SELECT doc_id, source, text FROM documents)," + _MIX + "SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM m"
