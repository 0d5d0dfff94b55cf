r"""Document fingerprints from prefix polynomial hashes.

`PrefixHash` holds, for a text of n code points c, the arrays S[k] = sum of c[j] * b**j for j < k modulo 2^31 - 1, for two bases. The hash of any
span is a difference of two entries taken back to position 0 by an inverse power, so spans of any texts compare in constant time, and the
longest common extension of two positions is found by binary search. A fingerprint is the hash of the whole text and, for each of SLOTS
classes of mixed window hashes, the smallest in its class: its likeness to another is the share of slots that agree, which estimates the Jaccard
similarity of the two window sets (one-permutation hashing: slots empty on both sides don't count).

Edge cases: a null text is empty; texts shorter than a window count as one window; two empty texts are alike (1), an empty and another are not
(0). The order "descending doc_id" puts null ids last; rows of one id follow each other by a hash of their text, then the
text, and that hash takes part in the ranges, so an id that many rows share is many partitions. The one document of a table is its own
next. Every row is returned; further columns don't take part. Documents that change between the reads raise an error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

P = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 1_779_033_703)
WINDOW, SLOTS = 12, 64
_SHIFT = np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^63."""
    x = (x & P) + (x >> _SHIFT)
    x = (x & P) + (x >> _SHIFT)
    return np.where(x >= P, x - P, x)


class _Powers:
    """Powers of a base and of its inverse, grown by doubling as longer texts come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, int(P) - 2, int(P))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, _mod(self.up * np.uint64(pow(self.base, k, int(P))))])
            self.down = np.concatenate([self.down, _mod(self.down * np.uint64(pow(self.inverse, k, int(P))))])
        return self.up, self.down


_POWERS = [_Powers(b) for b in BASES]


class PrefixHash:
    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for powers in _POWERS:
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_mod(points * powers.upto(self.n + 1)[0][: self.n]), out=s[1:])
            self.sums.append(_mod(s))

    def windows(self, length: int) -> np.ndarray:
        """The 62-bit hashes of all spans of the given length."""
        out = np.zeros(max(0, self.n - length + 1), np.uint64)
        for powers, s in zip(_POWERS, self.sums):
            span = _mod(s[length:] + P - s[: len(s) - length])
            out = (out << _SHIFT) | _mod(span * powers.upto(self.n + 1)[1][: len(span)])
        return out

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The hash of the code points from start to before end."""
        return tuple((int(s[end]) - int(s[start])) % int(P) * int(powers.upto(self.n + 1)[1][start]) % int(P) for powers, s in zip(_POWERS, self.sums))

    def extension(self, start: int, other: "PrefixHash", at: int) -> int:
        """The longest common extension: how many code points from start equal those of other from at."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(start, start + mid) == other.span(at, at + mid):
                low = mid
            else:
                high = mid - 1
        return low


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_EMPTY = np.uint64(2**64 - 1)


def fingerprint(hashed: PrefixHash) -> str:
    """16 hex digits for the whole text, a colon, then 3 hex digits a slot; "---" is an empty slot."""
    whole = hashed.span(0, hashed.n)
    least = np.full(SLOTS, _EMPTY, np.uint64)
    if hashed.n:
        mixed = _mixed(hashed.windows(min(WINDOW, hashed.n)))
        np.minimum.at(least, (mixed >> np.uint64(58)).astype(np.int64), mixed)
    return f"{whole[0] << 31 | whole[1]:016x}:" + "".join("---" if x == 2**64 - 1 else f"{_fold(x):03x}" for x in least.tolist())


def _fold(x: int) -> int:
    """12 bits of a slot's least hash, which is itself too small to carry its own high bits."""
    return (x * 0x9E3779B97F4A7C15 >> 40) & 0xFFF


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of the slots used by either that agree; 1 for equal texts."""
    if a == b:
        return 1.0
    one, two = ([x[i : i + 3] for i in range(17, len(x), 3)] for x in (a, b))
    used = sum(x != "---" or y != "---" for x, y in zip(one, two))
    return sum(x == y != "---" for x, y in zip(one, two)) / used if used else 0.0


FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kept_prefix", pa.int64()),
]
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_prefix long"
#: Keys that are sampled for each range, and rows that a range has at least on average.
SAMPLED, ROWS = 64, 200


def _pair(doc_id: int | None, text: str, hashed: PrefixHash, own: str, following: str, other: str) -> tuple:
    """The finished row of a document, given the next one's text and fingerprint."""
    cut = len(text) // 3
    edited = text[: len(text) - cut] + following[:cut]
    again = PrefixHash(edited)
    new = fingerprint(again)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, likeness(own, new), likeness(own, other), hashed.extension(0, again, 0))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(FIELDS)], names=[n for n, _ in FIELDS])


def _closed(held: tuple | None) -> None:
    if held is not None:
        raise ValueError("a range has no border: the documents changed while they were read")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (part, border, doc_id, text) in their order: each document is finished when its next comes, the last of a range when its border comes."""
    now, held, rows = None, None, []
    for batch in batches:
        for part, border, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now:
                _closed(held)
                now = part
            elif held is None:  # rows of the same key as the border
                continue
            hashed = PrefixHash(text)
            own = fingerprint(hashed)
            if held is not None:
                rows.append(_pair(*held, text, own))
            held = None if border else (doc_id, text, hashed, own)
            if len(rows) == 500:
                yield _batch(rows)
                rows = []
    _closed(held)
    if rows:
        yield _batch(rows)


def starts(keys: DataFrame, ranges: int) -> list[tuple]:
    """The first keys, in order, of at most so many ranges of about equal numbers of rows: the smallest key, and keys of a sample by hash. keys: doc_id, key."""
    n, top = keys.agg(F.count("*"), F.max("doc_id")).first()  # without the texts
    if not n:
        return []
    ranges = min(ranges, -(-n // ROWS))
    first = keys.where(F.col("doc_id").isNull() if top is None else F.col("doc_id") == top).agg(F.min("key")).first()[0]
    thinned = keys.where(F.pmod(F.xxhash64("key.none", "key.down", "key.tie"), F.lit(max(1, n // (SAMPLED * ranges)))) == 0)
    sample = sorted((tuple(r.key), r.n) for r in thinned.groupBy("key").agg(F.count("*").alias("n")).collect())
    out, share, seen = [tuple(first)], sum(m for _, m in sample) / ranges, 0
    for key, m in sample:
        if seen >= share * len(out) and key > out[-1]:
            out.append(key)
        seen += m
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document. One exchange puts the documents in order, in at most as many ranges as the session has shuffle partitions. A range starts at a
    document's key, so that document is known to be the next of the range before, and goes there too, as its border. Nothing is written on the way; docs
    is read several times, its texts twice."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Null ids last, larger ids first, then a hash of the text: a text never travels in the keys that the driver holds.
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("down"), F.xxhash64("text").alias("tie"))
    rows = rows.select("doc_id", "text", key.alias("key"))
    first = starts(rows.select("doc_id", "key"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not first:
        return spark.createDataFrame([], DDL)
    n = len(first)
    known = F.from_json(F.lit(json.dumps([{"none": x, "down": y, "tie": z} for x, y, z in first])), "array<struct<none:boolean,down:bigint,tie:bigint>>")
    # Binary search: the last range that starts at the key or before it.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((n - 1).bit_length()))] or [F.lit(0)])
    rows = rows.withColumn("part", F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step) <= F.col("key"), at + step).otherwise(at)))
    own, before = (F.struct(part.cast("int").alias("part"), F.lit(border).alias("border")) for part, border in ((F.col("part"), False), ((F.col("part") + (n - 1)) % n, True)))
    rows = rows.select("text", "key", F.explode(F.when(F.get(known, F.col("part")) == F.col("key"), F.array(own, before)).otherwise(F.array(own))).alias("at"))
    rows = rows.select("at.part", "at.border", "key", "text").repartitionById(n, "part").sortWithinPartitions("part", "border", "key", "text")
    return rows.select("part", "border", F.when(~F.col("key.none"), F.bitwise_not("key.down")).alias("doc_id"), "text").mapInArrow(_walk, DDL)
