"""Commands over the operators: python -m tandem COMMAND --help. Paths are any that Spark opens; --fetch and --model name a Python callable as module:function."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterator
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import reconcile as R
from tandem.operators import vectors as V
from tandem.session import get_session, written
from tandem.sources import fetch, readers


def callable_of(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def build_corpus(spark: SparkSession, a: str, b: str, out: str, window: int = 250, stride: int = 150) -> None:
    """Chunks of both corpora's articles, of titles that both have, with emb_ix, a dense ordinal by (title, source, chunk_id)."""
    left, right = written(readers.articles_a(spark, a), "articles-a"), written(readers.articles_b(spark, b), "articles-b")
    both = R.common(left, right, "title")
    articles = left.withColumn("source", F.lit("a")).unionByName(right.withColumn("source", F.lit("b"))).join(both, "title", "left_semi")
    chunks = R.ordinal(V.chunks(articles, window, stride), "title", "source", "chunk_id")
    chunks.select("title", "source", "chunk_id", "text", F.col("index").alias("emb_ix")).write.mode("overwrite").parquet(out)


def embed(spark: SparkSession, chunks: str, out: str, model: Callable[[list[str]], list[list[float]]], batch: int = 512) -> None:
    """chunks with the unit vector of each text. model maps a list of texts to vectors; a task calls it for a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for start in range(0, part.num_rows, batch):
                rows = part.slice(start, batch)
                vectors = model(rows.column(rows.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], names=[*rows.schema.names, "embedding"])

    rows = spark.read.parquet(chunks)
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    V.normalised(rows.mapInArrow(run, kinds + ", embedding array<float>")).write.mode("overwrite").parquet(out)


def similarities(spark: SparkSession, embedded: str, stats: str, top1: str) -> None:
    """Per title: statistics of all pairs of an a and a b chunk, and each a chunk's most similar b chunk with both texts."""
    rows = spark.read.parquet(embedded)
    a, b = rows.where("source = 'a'"), rows.where("source = 'b'")
    sims = V.pair_similarities(a, b)
    V.pair_stats(sims).write.mode("overwrite").parquet(stats)
    text = lambda side, s: side.select("title", F.col("chunk_id").alias(f"{s}_chunk_id"), F.col("text").alias(f"{s}_text"))
    best = V.top1(sims).join(text(a, "a"), ["title", "a_chunk_id"]).join(text(b, "b"), ["title", "b_chunk_id"])
    best.select("title", "a_chunk_id", "b_chunk_id", "similarity", "a_text", "b_text").write.mode("overwrite").parquet(top1)


def make_shards(spark: SparkSession, urls: str, out: str, shards: int) -> list[str]:
    """Splits a list into even contiguous shards; the commands that run them."""
    rows = readers.url_list(spark, urls).select("url").distinct()
    numbered = written(R.ordinal(rows, "url"), "numbered")
    readers.write_shards(R.shard_range(numbered, F.col("index"), numbered.count(), shards).select("url", "shard"), out)
    return [f"python -m tandem run-shard --shards {out} --shard {k} --out {out}/done/shard={k}" for k in range(shards)]


def run_shard(spark: SparkSession, shards: str, shard: int, out: str, get: Callable[[str], tuple[int, str | None]], per_minute: float | None = None) -> DataFrame:
    """Fetches a shard's URLs; pages and failures are written apart. Those that an earlier run wrote aren't fetched again."""
    rows = spark.read.schema("url string").json(f"{shards}/shard={shard}")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/pages")
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        rows = R.missing(rows, spark.read.schema("url string").json(f"{out}/pages"), "url")
    done = written(fetch.fetched(rows, "url", get, per_minute=per_minute), "fetched")
    good, dead = R.split_dead_letters(done)
    good.select("url", "body").write.mode("append").json(f"{out}/pages")
    dead.select("url", "status_code", "error", "attempts").write.mode("append").json(f"{out}/failed")
    return R.tallies(done)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser("tandem", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, **options) -> None:
        own = commands.add_parser(name, help=help)
        for option, kind in options.items():
            needed = isinstance(kind, type)
            own.add_argument(f"--{option.replace('_', '-')}", type=kind if needed else type(kind), required=needed, default=None if needed else kind)

    command("build-corpus", "articles of both corpora to chunks", a=str, b=str, out=str, window=250, stride=150)
    command("embed", "a vector per chunk", chunks=str, out=str, model=str, batch=512)
    command("similarities", "statistics and best matches per title", embedded=str, stats=str, top1=str)
    command("shards", "split a list of URLs", urls=str, out=str, shards=10)
    command("run-shard", "fetch a shard", shards=str, shard=int, out=str, fetch=str, per_minute=0.0)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or get_session()
    if args.command == "build-corpus":
        build_corpus(spark, args.a, args.b, args.out, args.window, args.stride)
    elif args.command == "embed":
        embed(spark, args.chunks, args.out, callable_of(args.model), args.batch)
    elif args.command == "similarities":
        similarities(spark, args.embedded, args.stats, args.top1)
    elif args.command == "shards":
        print("\n".join(make_shards(spark, args.urls, args.out, args.shards)))
    else:
        for row in run_shard(spark, args.shards, args.shard, args.out, callable_of(args.fetch), args.per_minute or None).collect():
            print(row.asDict())


if __name__ == "__main__":
    main()
