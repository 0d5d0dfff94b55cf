"""Crawl reconciliation: set operations, first- and last-wins de-duplication, shards, dead letters, slug probing, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import urls as U
from tandem.session import written


def missing(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Distinct wanted keys that weren't found; null keys never match and stay out."""
    return wanted.where(F.col(key).isNotNull()).select(key).distinct().join(found.select(key), key, "left_anti")


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key by order: an aggregation, so a hot key is combined before its exchange."""
    return _dedup(df, key, order, F.min_by)


def dedup_last(df: DataFrame, key: str, order: str) -> DataFrame:
    return _dedup(df, key, order, F.max_by)


def _dedup(df: DataFrame, key: str, order: str, pick) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(key).alias("_key")).agg(pick(row, F.col(order)).alias("_row")).select("_row.*")


def union_align(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns by name, missing ones null."""
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first


def shard_modulo(df: DataFrame, index: Column, shards: int) -> DataFrame:
    """shard = index % shards and the position within it; index is a dense ordinal."""
    return df.withColumn("shard", F.pmod(index, F.lit(shards)).cast("int")).withColumn("within", F.floor(index / shards).cast("long"))


def shard_range(df: DataFrame, index: Column, total: int, shards: int) -> DataFrame:
    """Contiguous even ranges, the remainder to the first shards; index counts from 0."""
    size, more = divmod(total, shards)
    cut = more * (size + 1)
    return df.withColumn("shard", F.when(index < cut, F.floor(index / (size + 1))).otherwise(more + F.floor((index - cut) / max(size, 1))).cast("int"))


def shard_fixed(df: DataFrame, index: Column, size: int) -> DataFrame:
    return df.withColumn("shard", F.floor(index / size).cast("int"))


def shard_stats(rows: DataFrame, file: str, items: str) -> DataFrame:
    """Per shard of a file name: rows, those with items, all items."""
    s = U.shard_of(F.col(file))
    return rows.select(s.getField("of").alias("of"), s.getField("shard").alias("shard"), F.greatest(F.size(items), F.lit(0)).alias("n")).groupBy("of", "shard").agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 0).alias("with_items"), F.sum("n").cast("long").alias("items"))


def split_dead_letters(fetched: DataFrame, status: str = "status_code") -> tuple[DataFrame, DataFrame]:
    """(good, dead): rows with status 200, and the others with their class as error."""
    ok = F.coalesce(F.col(status) == 200, F.lit(False))
    return fetched.where(ok), fetched.where(~ok).withColumn("error", F.coalesce(U.http_status(F.col(status)), F.lit("error_unknown")))


def tallies(fetched: DataFrame, *by: str, status: str = "status_code") -> DataFrame:
    ok = F.coalesce(F.col(status) == 200, F.lit(False))
    out = fetched.groupBy(*by).agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))
    return out.withColumn("success_rate", F.try_divide(F.col("success"), F.col("success") + F.col("failed")))


def probe_slugs(slugs: DataFrame, known: DataFrame) -> DataFrame:
    """slugs: slug; known: slug -> the first spelling of each slug that is known."""
    tried = slugs.select("slug", F.posexplode(U.slug_variants(F.col("slug"))).alias("at", "variant"))
    return tried.join(known.select(F.col("slug").alias("variant")), "variant").groupBy("slug").agg(F.min_by("variant", "at").alias("variant"))


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, uniformly and repeatably: those with the smallest md5 of seed and key. A top-k step, no full sort."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def coalesced(df: DataFrame, index: Column) -> DataFrame:
    """url from url or data.url; title from title, data.title or a numbered default."""
    return df.select(F.coalesce("url", "data.url").alias("url"), F.coalesce(F.nullif("title", F.lit("")), F.nullif("data.title", F.lit("")), F.concat(F.lit("(no_title_"), index.cast("string"), F.lit(")"))).alias("title"))


def ordinal(df: DataFrame, *order: str) -> DataFrame:
    """df with index, a dense ordinal by order from 0, without a single-task window: range partitions are counted, and each partition's rows are
    numbered from the sum of the counts before it."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ordinal")
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("_part", part).withColumn("_row", row)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    return placed.join(F.broadcast(before), "_part").withColumn("index", F.col("_before") + F.col("_row")).drop("_id", "_part", "_row", "_before")


def lookup(wanted: DataFrame, index: DataFrame, key: str = "title") -> DataFrame:
    """wanted joined with index (key and values, a row per key) by the key as it stands, else by its lower-case form with spaces; columns of wanted, then
    the values, null where neither is known. Two left joins that Spark broadcasts or sorts by the index's size."""
    values = [c for c in index.columns if c != key]
    side = lambda n: index.select(F.col(key).alias(f"_k{n}"), F.struct(*values).alias(f"_v{n}"))
    other = F.lower(F.replace(F.col(key), F.lit("_"), F.lit(" ")))
    both = wanted.join(side(1), F.col(key) == F.col("_k1"), "left").join(side(2), other == F.col("_k2"), "left")
    return both.select(*wanted.columns, F.coalesce("_v1", "_v2").alias("_v")).select(*wanted.columns, "_v.*")


def outer_by(a: DataFrame, b: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Full outer join by keys of different names; both keys stay, and other columns that both have get the endings _a and _b."""
    names = set(a.columns) & set(b.columns)
    end = lambda df, s: df.select(*[F.col(c).alias(c + s if c in names else c) for c in df.columns])
    left, right = end(a, "_a"), end(b, "_b")
    return left.join(right, left[left_on + "_a" if left_on in names else left_on] == right[right_on + "_b" if right_on in names else right_on], "full")
