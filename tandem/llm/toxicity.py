r"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams (with borders) and of itself, so misspellings never seen share
most of it. An n-gram's embedding is discounted by its frequency in the training sample, DISCOUNT / (DISCOUNT + share of documents), so that the
syllables of every text don't drown the rest. A document is the mean of its words, and a linear softmax over it gives the score. Embeddings
start at zero, so what training never met adds nothing, and are trained together with the softmax by Adagrad. A trained model gives every
word one number (its share of the logit), which workers remember for a bounded number of words; whole texts are scored, in memory of one text.

The training rows are a bounded sample: of the labelled documents outside the held-out third (crc32 of the doc_id as text modulo 3 is 1) whose
texts have at most MAX_CHARS characters, the MAX_TOXIC toxic and MAX_CLEAN other ones with the smallest hash of their doc_id. Their features,
not their texts, come to the driver. Held-out labels, lang, source and doc_id are never inputs.

Edge cases: null, empty and wordless texts score the softmax of the bias alone; null labels don't count; without labels of both kinds every score
is 0; a null doc_id is hashed as an empty text, so it is not held out; rows are scored one by one, repeated rows alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.pieces import Memo

MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1200, 3000, 10_000
BUCKETS, DIMENSIONS, RATE = 1 << 17, 8, 200.0
#: A small sample is gone through more often: about so many steps, within so many epochs.
STEPS, LEAST_EPOCHS, MOST_EPOCHS = 50_000, 5, 40
DISCOUNT = 0.02
GRAMS = (3, 4, 5)
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 300_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def grams(word: str) -> list[int]:
    """The buckets of a word: itself and its n-grams, with borders."""
    w = f"<{word}>"
    found = [w] + [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1) if n < len(w)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in found]


def bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their weights, whose weighted sum of embeddings is the mean of the words' vectors."""
    total: dict[int, float] = {}
    for w in words:
        own = grams(w)
        for g in own:
            total[g] = total.get(g, 0.0) + 1 / len(own) / len(words)
    return np.fromiter(total, np.int32, len(total)), np.fromiter(total.values(), np.float32, len(total))


class Model:
    """Embeddings and softmax; after training only each bucket's share of the logit is needed."""

    def __init__(self, shares: np.ndarray, bias: float):
        self.shares, self.bias = shares, bias

    def word(self, word: str) -> float:
        return float(self.shares[grams(word)].mean())

    def score(self, text: str | None, memo: Memo) -> float:
        words = WORD.findall((text or "").lower())
        logit = self.bias + (sum(map(memo.__getitem__, words)) / len(words) if words else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """examples: a label and a bag each. The two-class softmax is one logistic unit on the difference of the class vectors."""
    if len({y for y, _, _ in examples}) < 2:
        return None
    rng = np.random.default_rng(seed)
    documents = np.zeros(BUCKETS)
    for _, buckets, _ in examples:
        documents[buckets] += 1
    discount = (DISCOUNT / (DISCOUNT + documents / len(examples))).astype(np.float32)
    table = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    softmax = rng.normal(0, 1, DIMENSIONS).astype(np.float32)
    softmax /= np.linalg.norm(softmax)
    bias, seen, seen_softmax, seen_bias = -1.0, np.full(BUCKETS, 1e-6, np.float32), 1.0, 1e-2
    for _ in range(min(MOST_EPOCHS, max(LEAST_EPOCHS, -(-STEPS // len(examples))))):
        for k in rng.permutation(len(examples)):
            label, buckets, weights = examples[k]
            weights = weights * discount[buckets]
            vector = weights @ table[buckets]
            error = np.float32(1 / (1 + np.exp(-np.clip(vector @ softmax + bias, -50, 50))) - label)
            if abs(error) < 1e-3:
                continue
            seen[buckets] += weights * weights * error * error
            table[buckets] -= np.float32(RATE) * (weights / np.sqrt(seen[buckets]))[:, None] * (error * softmax)
            step = error * vector
            seen_softmax += float(step @ step)
            softmax -= np.float32(0.02 / seen_softmax**0.5) * step
            seen_bias += float(error * error)
            bias -= 0.2 * float(error) / seen_bias**0.5
    return Model((table @ softmax * discount).astype(np.float64), float(bias))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [(label, *bag(words)) for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (words := WORD.findall(text.lower()))]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in bags], pa.int32()), pa.array([x[1].tobytes() for x in bags], pa.binary()), pa.array([x[2].tobytes() for x in bags], pa.binary())], names=["label", "buckets", "weights"])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Trains on the bounded sample described above. docs: doc_id, text; labels: doc_id, toxic."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("label"))
    short = docs.select("doc_id", F.length("text").alias("size")).where(F.col("size").between(1, MAX_CHARS)).select("doc_id")
    known = known.join(short, "doc_id", "left_semi").select("doc_id", "label", F.xxhash64("doc_id").alias("order"))
    # Two top-k reports of at most MAX_TOXIC and MAX_CLEAN ids: a proven bound, so they may be broadcast.
    chosen = known.where("label = 1").orderBy("order").limit(MAX_TOXIC).unionByName(known.where("label = 0").orderBy("order").limit(MAX_CLEAN)).select("doc_id", "label")
    ids = chosen.collect()
    if len({r.label for r in ids}) < 2:
        return None
    spark = docs.sparkSession
    rows = docs.where(F.length("text") <= MAX_CHARS).join(F.broadcast(spark.createDataFrame(ids, chosen.schema)), "doc_id").select("label", "text").mapInArrow(_examples, "label int, buckets binary, weights binary").toArrow()
    examples = [(label, np.frombuffer(b, np.int32), np.frombuffer(w, np.float32)) for label, b, w in zip(*(rows.column(i).to_pylist() for i in range(3)))]
    examples.sort(key=lambda e: (e[0], e[1].tobytes()))  # the order of the partitions doesn't matter
    return train(examples)


_MEMOS: dict[bytes, Memo] = {}


def _memo(model: Model) -> Memo:
    """What this worker process remembers of the model's words, kept across tasks."""
    key = model.shares[:4096].tobytes() + np.float64(model.bias).tobytes()
    if key not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[key] = Memo(model.word, REMEMBERED)
    return _MEMOS[key]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted (1 if score >= 0.7)."""
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo = _memo(model) if model else None
        for batch in batches:
            scores = np.array([model.score(t.as_py(), memo) if model else 0.0 for t in batch.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.7).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
