r"""Near-duplicate detection with SetSketch registers.

1. Every whole text becomes the set of its distinct 5-word shingles (64-bit hashes) and a SetSketch of REGISTERS registers. A register is the
   minimum over the set of an exponential variable, kept on the scale floor(1 - log_b(minimum)) and truncated to 16 bits: mergeable (by maximum) and
   locality-sensitive. Each element's points come in ascending order and stop where they can no longer be a minimum, so a text costs time in
   proportion to its shingles, not to shingles times registers.
2. Texts with equal word sequences are one class, represented by their smallest doc_id; only representatives go on.
3. ROWS registers make a band; representatives that agree on a band share a bucket. A pair at the threshold shares none of the BANDS
   buckets with a probability of 2e-4, one of similarity 0.8 of 1e-6.
4. In each bucket the smallest doc_id is linked with the others: candidates in proportion to the rows. The similarity of a candidate pair is estimated
   from its registers by maximum likelihood (the set sizes are known), pairs far below the threshold go, and each document's best pair is
   verified on the full shingle sets. Connected components of the verified links follow.
5. Buckets that still hold several components are settled exactly: every pair of members of different components is compared on the full shingle
   sets, whatever its estimate. A bucket of more than MEMBERS members or SHINGLES shingles is dealt into blocks, its largest component into blocks of
   its own, and each two blocks of which a pair is still open meet in one task; it counts the common shingles of all its pairs at once and returns a
   tree of the components that links join, never pairs. An eighth of the buckets goes first, so the others find fewer components. The work in a bucket
   grows with its members times those outside its largest component, the rows dealt with a MEMBERS-th of that; nothing in a bucket is left out. What
   can be missed is a link whose ends share no bucket (see 3).

Every exchange is an aggregation combined before it or a plain equi-join that Spark splits where it is skewed; components are found by rounds of
large-star and small-star joins on written tables; nothing but a count and a checksum per round comes to the driver.

Edge cases: null texts and texts without words have the empty set and are linked with nothing; texts of fewer than five words are one shingle, the
whole sequence; a text of any length is taken whole; a component's smallest doc_id stands for it, and of equally likely partners the one picked
doesn't change the components that full sets confirm; a null doc_id is linked with nothing and kept (its component is null); rows that repeat a doc_id are one node; extra columns
don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import table
from tandem.llm.pieces import Memo

WORDS = 5
THRESHOLD = 75  # percent
ROWS, BANDS = 6, 44
#: The first ROWS * BANDS registers make the bands; estimates use all.
REGISTERS = 512
#: A block of a bucket has about so many members and shingles at most.
MEMBERS, SHINGLES = 400, 400_000
#: Shingles of up to so many texts of a task are counted pair by pair, others by matrix products of so many columns.
FEW, COLUMNS = 16, 4096
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Estimates below this go: four standard deviations of the estimate under the threshold.
LEAST = THRESHOLD / 100 - 4 * math.sqrt(0.75 * 0.25 / REGISTERS)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_HASHES = Memo(xxhash.xxh3_64_intdigest, 200_000)


def shingles(text: str | None) -> tuple[np.ndarray, bytes]:
    """The distinct shingle hashes of a text, sorted, and a 128-bit digest of its word sequence."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    if not words:
        return np.zeros(0, _U), digest
    hashes = np.fromiter(map(_HASHES.__getitem__, words), _U, len(words))
    size = min(WORDS, len(words))
    out = np.full(len(words) - size + 1, size, _U)
    for k in range(size):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + hashes[k : len(words) - size + 1 + k])
    return np.unique(out), digest


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16, one row per set); the rows of empty sets are 0."""
    sizes = np.array([len(s) for s in sets])
    least = np.full((len(sets), REGISTERS), np.inf)
    flat = least.reshape(-1)
    todo = np.flatnonzero(sizes)
    factor = math.log(REGISTERS) + 5
    while len(todo):  # again for the few sets of which a register wasn't reached within the limit
        element = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(todo, sizes[todo])
        limit = factor / np.maximum(sizes, 1)
        at, step = np.zeros(len(element)), 0
        while len(element):
            step += 1
            r = _mix(element + _U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            at = at - np.log(((r >> _U(24)).astype(np.float64) + 0.5) * 2.0**-40) / REGISTERS
            near = at <= limit[owner]
            element, owner, at, r = element[near], owner[near], at[near], r[near]
            register = ((r & _U(0xFFFFFF)) * _U(REGISTERS)) >> _U(24)
            np.minimum.at(flat, owner * REGISTERS + register.astype(np.int64), at)
        todo = todo[np.isinf(least[todo]).any(axis=1)]
        factor *= 2
    with np.errstate(divide="ignore"):
        values = np.clip(np.floor(1 - np.log(least / RATE) / math.log(BASE)), 0, TOP)
    values[sizes == 0] = 0
    return values.astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, which holds the band's number."""
    r = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(_U)
    key = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=_U)), r.shape[:2])
    for k in range(ROWS):
        key = _mix(key ^ (r[:, :, k] + _U(k << 20)))
    return key


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs of sketches with known set sizes, on a grid of 1/200."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = REGISTERS - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    p, q = chance(u - v * j), chance(v - u * j)
    tiny = 1e-12
    likely = above * np.log(np.maximum(p, tiny)) + below * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))
    return np.take_along_axis(j, likely.argmax(axis=1)[:, None], axis=1)[:, 0]


HELD = 400_000


def sketches(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, words (digest of the sequence), n_shingles, registers, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list) -> pa.RecordBatch:
            found = sketch([r[2] for r in rows])
            keys = pa.array(bands(found).astype(np.int64).reshape(-1), pa.int64())
            offsets = pa.array(np.arange(0, BANDS * len(rows) + 1, BANDS, dtype=np.int32))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.ListArray.from_arrays(offsets, keys)],
                names=["doc_id", "words", "n_shingles", "registers", "keys"],
            )

        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, digest = shingles(text.as_py())
                rows.append((doc_id, digest, found))
                held += len(found)
                if held >= HELD or len(rows) >= 2000:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, words binary, n_shingles long, registers binary, keys array<long>")


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs (a, b) whose estimated similarity is not far below the threshold, with the estimate."""
    side = lambda s: reps.select(F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("registers").alias(f"r{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                a, b, na, nb, ra, rb = (part.column(part.schema.get_field_index(n)) for n in ("a", "b", "na", "nb", "ra", "rb"))
                read = lambda x: np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, REGISTERS)
                found = estimate(read(ra), read(rb), np.asarray(na, np.float64), np.asarray(nb, np.float64))
                keep = pa.array(found >= LEAST)
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), pa.array(found).filter(keep)], names=["a", "b", "likeness"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, likeness double")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those rows of pairs (a, b and further numbers) that are linked, by their full shingle sets."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, one = None, np.zeros(0, _U)
        for batch in batches:
            linked = []
            for a, ta, tb in zip(batch.column(batch.schema.get_field_index("a")).to_pylist(), batch.column(len(names)), batch.column(len(names) + 1)):
                if a != known:
                    known, one = a, shingles(ta.as_py())[0]
                two = shingles(tb.as_py())[0]
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(both > 0 and 100 * both >= THRESHOLD * (len(one) + len(two) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(len(names))], names=names)

    side = lambda s: texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"t{s}"))
    # A text each for both ends; the a side, which many pairs may share, is joined last.
    return pairs.join(side("b"), "b").join(side("a"), "a").select(*names, "ta", "tb").mapInArrow(run, pairs.schema)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs i < j of sets, as the upper triangle of a matrix."""
    n, sizes = len(sets), [len(x) for x in sets]
    element, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(element, kind="stable")  # so the owners of an element ascend
    element, owner = element[order], owner[order]
    column = np.cumsum(np.concatenate([np.zeros(1, np.int64), (element[1:] != element[:-1]).astype(np.int64)]))[: len(element)]
    owners = np.bincount(column)[column]
    few = (owners > 1) & (owners <= FEW)
    c, o = column[few], owner[few]
    both = np.zeros(n * n, np.int64)
    for d in range(1, FEW):
        same = c[d:] == c[:-d]
        if not same.any():
            break
        both += np.bincount(o[:-d][same] * n + o[d:][same], minlength=n * n)
    both = both.reshape(n, n)
    many = owners > FEW
    c, o = np.unique(column[many], return_inverse=True)[1], owner[many]
    cuts = np.searchsorted(c, np.arange(0, (c[-1] if len(c) else -1) + COLUMNS + 1, COLUMNS))
    for k, (start, end) in enumerate(zip(cuts[:-1], cuts[1:])):
        x = np.zeros((n, COLUMNS), np.float32)  # counts of up to COLUMNS are exact
        x[o[start:end], c[start:end] - k * COLUMNS] = 1
        both += (x @ x.T).astype(np.int64)
    return np.triu(both, 1)


def joined(sets: list[np.ndarray], of: list[int]) -> list[tuple[int, int]]:
    """Pairs (smallest, other) of the components of the sets that links between the sets join: a tree of each group of components."""
    names, c = np.unique(np.array(of, np.int64), return_inverse=True)
    if len(names) < 2:
        return []
    both, n = overlaps(sets), np.array([len(x) for x in sets])
    i, j = np.nonzero((both > 0) & (100 * both >= THRESHOLD * (n[:, None] + n[None, :] - both)))
    near = np.zeros((len(names), len(names)), bool)
    near[c[i], c[j]] = near[c[j], c[i]] = True
    out, left = [], np.ones(len(names), bool)
    for first in np.flatnonzero(near.any(axis=1)):
        reached = np.array([first]) if left[first] else np.zeros(0, np.int64)
        left[reached] = False
        while len(reached):
            reached = np.flatnonzero(near[reached].any(axis=0) & left)
            left[reached] = False
            out += [(int(names[first]), int(names[k])) for k in reached]
    return out


def mixed(members: DataFrame) -> DataFrame:
    """members (key, doc_id, n, c) of buckets that hold several components; of buckets of the same documents, one."""
    hashed = F.xxhash64("doc_id")
    marks = [F.count("*").alias("m"), F.sum(F.hash("doc_id").cast("long")).alias("x"), F.sum(F.shiftright(hashed, 32)).alias("y"), F.bit_xor(hashed).alias("z")]
    keys = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), *marks).where("low < high").groupBy("m", "x", "y", "z").agg(F.min("key").alias("key"))
    return members.join(table(keys.select("key"), "mixed-buckets").hint("merge"), "key").groupBy("key", "doc_id", "c").agg(F.sum("n").alias("n"))


def candidates(members: DataFrame) -> DataFrame:
    """members (key, doc_id, n, c) of mixed buckets dealt to tasks (key, x, y): key, x, y, doc_id, c. Any two members of different components in a bucket meet in a task."""
    parts = members.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    sizes = parts.groupBy("key").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.max(F.struct("m", "n", "c")).alias("top"))
    blocks = lambda m, n: F.ceil(F.greatest(m / MEMBERS, n / SHINGLES)).cast("int")
    large = (F.col("m") > MEMBERS) | (F.col("n") > SHINGLES)
    sizes = sizes.select(
        "key",
        F.when(large, F.col("top.c")).alias("main"),
        F.when(large, blocks(F.col("top.m"), F.col("top.n"))).otherwise(0).alias("own"),
        F.when(large, blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n"))).otherwise(1).alias("rest"),
    )
    rows = members.select("key", "doc_id", "c").join(table(sizes, "bucket-sizes").hint("merge"), "key")
    rows = rows.withColumn("main", F.coalesce(F.col("c") == F.col("main"), F.lit(False))).withColumn("h", F.xxhash64("doc_id"))
    # Blocks 0 .. rest - 1 hold the smaller components, those after them the largest one, whose blocks needn't meet each other.
    rows = rows.withColumn("x", F.expr("cast(if(main, rest + pmod(h, greatest(own, 1)), pmod(h, rest)) as int)"))
    rows = rows.withColumn("y", F.explode(F.expr("if(main, sequence(0, rest - 1), if(own + rest = 1, array(0), array_remove(sequence(0, own + rest - 1), x)))")))
    return rows.select("key", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "doc_id", "c")


def links(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: components that links between the members of a task of dealt join, as trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        now, sets, of = None, [], []
        for batch in batches:
            out = []
            for *task, c, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                if task != now:
                    out += joined(sets, of)
                    now, sets, of = task, [], []
                sets.append(shingles(text.as_py())[0])
                of.append(c)
            yield batch_of(out)
        yield batch_of(joined(sets, of))

    rows = dealt.join(texts, "doc_id").select("key", "x", "y", "c", "text")
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of the nodes of edges (a, b), by alternating large-star and small-star rounds. Hubs are joined with
    their minimum, never gathered."""
    now = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = table(large, "large-edges")
        least = table(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        moved = large.join(least, "u")
        small = moved.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = table(small, "small-edges")
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen:
            break
        seen = mark
    # At rest every node hangs on its component's smallest.
    return table(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")


def contract(members: DataFrame, texts: DataFrame) -> DataFrame:
    """node, component of the components c of members (key, doc_id, n, c) that links in their buckets join."""
    members = table(mixed(members), "mixed-members")
    ids = members.select("doc_id").distinct()
    texts = table(texts.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").distinct(), "mixed-texts")
    first = F.pmod(F.col("key"), F.lit(8)) == 0
    edges = table(links(candidates(members.where(first)), texts).distinct(), "first-links")
    merged = components(edges)
    now = members.where(~first).join(merged, F.col("c") == F.col("node"), "left").select("key", "doc_id", "n", F.coalesce("component", "c").alias("c"))
    now = table(mixed(table(now, "merged-members")), "open-members")
    return components(edges.unionByName(table(links(candidates(now), texts).distinct(), "other-links")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The op2 result, a row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = table(sketches(docs), "sketches")
    able = every.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = table(able.groupBy("words").agg(F.min("doc_id").alias("rep")), "classes")
    # hint: the exchange is the same whatever would fit a broadcast.
    reps = table(able.join(classes.select("words", F.col("rep").alias("doc_id")).hint("shuffle_hash"), ["doc_id", "words"], "left_semi").dropDuplicates(["doc_id", "words"]), "representatives")
    members = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = table(members.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").select("key", "head"), "buckets")
    members = table(members.join(shared.hint("merge"), "key"), "members")
    involved = members.groupBy("doc_id").agg(F.lit(1).alias("one")).select("doc_id")
    texts = table(docs.join(involved.hint("shuffle_hash"), "doc_id", "left_semi"), "texts")
    pairs = members.where("doc_id > head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    likely = _likely(pairs, reps).groupBy("b").agg(F.max(F.struct("likeness", (-F.col("a")).alias("minus"))).alias("best"))
    pairs = table(likely.select((-F.col("best.minus")).alias("a"), "b"), "best-pairs")
    found = components(table(_verified(pairs, texts), "links"))
    placed = table(members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("c")), "placed")
    merged = contract(placed, texts)
    classes = classes.join(found, F.col("rep") == F.col("node"), "left").select("words", F.coalesce("component", "rep").alias("c"))
    classes = table(classes.join(merged, F.col("c") == F.col("node"), "left").select("words", F.coalesce("component", "c").alias("component_id")), "class-components")
    alone = every.select("doc_id", "words", "n_shingles")
    linked = alone.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).join(classes, "words").select("doc_id", "n_shingles", "component_id")
    rest = alone.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(rest).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the near duplicates of a kept document: of each group the smallest doc_id stays."""
    gone = table(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "duplicates")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, sym.b FROM r JOIN sym ON r.b = sym.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
