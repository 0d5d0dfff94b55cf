"""Chunks and their vectors: token windows, per-title similarity statistics, top-1 alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import measures as M


def chunks(articles: DataFrame, window: int = 250, stride: int = 150, tokens: Column | None = None) -> DataFrame:
    """articles: title, source, text -> title, source, chunk_id, text. tokens: another tokenizer's array of tokens, over the columns of articles."""
    tokens = articles.select("title", "source", (M.whitespace_tokens(F.col("text")) if tokens is None else tokens).alias("tokens"))
    return tokens.select("title", "source", F.posexplode(M.windows(F.col("tokens"), window, stride)).alias("chunk_id", "words")).select("title", "source", "chunk_id", F.array_join("words", " ").alias("text"))


def pair_similarities(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: title, chunk_id, embedding (unit vectors) -> title, a_chunk_id, b_chunk_id, similarity: an equi-join on title, so pairs exist within titles
    only, and a title with many chunks is split by Spark's skew join."""
    left = a.select("title", F.col("chunk_id").alias("a_chunk_id"), F.col("embedding").alias("va"))
    right = b.select("title", F.col("chunk_id").alias("b_chunk_id"), F.col("embedding").alias("vb"))
    return left.join(right, "title").select("title", "a_chunk_id", "b_chunk_id", M.dot(F.col("va"), F.col("vb")).alias("similarity"))


def pair_stats(sims: DataFrame) -> DataFrame:
    """Per title: the numbers of chunks, mean, median, maximum and 90th percentile (linear interpolation)."""
    out = sims.groupBy("title").agg(F.count_distinct("a_chunk_id").alias("n_a"), F.count_distinct("b_chunk_id").alias("n_b"), F.avg("similarity").alias("sim_mean"), F.expr("percentile(similarity, array(0.5, 0.9))").alias("p"), F.max("similarity").alias("sim_max"))
    return out.select("title", "n_a", "n_b", "sim_mean", F.col("p")[0].alias("sim_median"), "sim_max", F.col("p")[1].alias("sim_p90"))


def top1(sims: DataFrame) -> DataFrame:
    """Per title and A chunk the most similar B chunk, the lowest id on ties. An aggregation, so no group is gathered."""
    best = sims.groupBy("title", "a_chunk_id").agg(F.max(F.struct("similarity", (-F.col("b_chunk_id")).alias("minus"))).alias("best"))
    return best.select("title", "a_chunk_id", (-F.col("best.minus")).alias("b_chunk_id"), F.col("best.similarity").alias("similarity"))


BLOCK = 512


def top1_blocked(a: DataFrame, b: DataFrame) -> DataFrame:
    """top1 for titles with many chunks, by matrix products: both sides are cut into blocks of chunks, block pairs meet in cogroups of bounded size, and
    the blocks' winners are combined by an aggregation."""
    blocks = b.select("title", F.expr(f"chunk_id div {BLOCK}").alias("bb")).distinct()
    left = a.withColumn("ab", F.expr(f"chunk_id div {BLOCK}")).join(blocks, "title").select("title", "ab", "bb", "chunk_id", "embedding")
    right = b.withColumn("bb", F.expr(f"chunk_id div {BLOCK}")).join(a.select("title", F.expr(f"chunk_id div {BLOCK}").alias("ab")).distinct(), "title").select("title", "ab", "bb", "chunk_id", "embedding")

    # New names for the right side's columns: both sides may come from one frame.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"title": pa.array([], x.schema.field("title").type), "a_chunk_id": pa.array([], pa.int64()), "b_chunk_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        order = np.argsort(y.column("chunk_id").to_numpy(), kind="stable")
        va, vb = (t.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(t.num_rows, -1) for t in (x, y))
        sims = va @ vb[order].T
        at = sims.argmax(axis=1)
        return pa.table({"title": x.column("title"), "a_chunk_id": x.column("chunk_id").cast(pa.int64()), "b_chunk_id": pa.array(y.column("chunk_id").to_numpy()[order][at], pa.int64()), "similarity": pa.array(sims[np.arange(len(at)), at])})

    kind = a.schema["title"].dataType.simpleString()
    won = left.groupBy("title", "ab", "bb").cogroup(right.groupBy("title", "ab", "bb")).applyInArrow(run, f"title {kind}, a_chunk_id long, b_chunk_id long, similarity double")
    return top1(won)


def normalised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn(vector, M.l2_normalised(F.col(vector)))


def from_npy(spark, path: str, rows_per_batch: int = 4096) -> DataFrame:
    """(file, emb_ix, embedding) of .npy matrices under a path: each file is read by one task, in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, where = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name.removeprefix("file:"))
                with system.open_input_stream(where) as f:
                    version = np.lib.format.read_magic(f)
                    shape, fortran, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                    if fortran or len(shape) != 2:
                        raise ValueError(f"{name}: a row-major matrix is expected")
                    for start in range(0, shape[0], rows_per_batch):
                        n = min(rows_per_batch, shape[0] - start)
                        block = np.frombuffer(f.read(n * shape[1] * kind.itemsize), kind).astype(np.float32)
                        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(block) + 1, shape[1], dtype=np.int32)), pa.array(block))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(start, start + n, dtype=np.int64)), vectors], names=["file", "emb_ix", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "file string, emb_ix long, embedding array<float>")
