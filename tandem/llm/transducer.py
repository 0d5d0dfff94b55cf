r"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Pieces, byte fallback and the normaliser's space rule are compiled once into one machine: a trie of states whose arcs read a character of the text, a
space as well as the symbol that stands for it, and whose final states emit a piece's id with its weight; where a character is no piece, an arc
reads it and emits its bytes with the fallback's weight. What else a normaliser does (a character map, collapsed spaces, a space before the text)
is a transducer ahead of it. Composing the machine with an input gives a lattice over the text's positions, and the encoding is its shortest path
in the tropical semiring (weights add along a path, the least path wins), found by relaxing each arc once, positions from left to right. One
routine serves both kinds of models, which differ in the weights only:

- Unigram model: a piece's arc weighs minus its score, a fallback arc ten more than the worst piece. Of equal paths the one whose last arc is
  longest wins at every position, as in the tokenizer.
- BPE model: merges are not a sum of scores, so the machine is composed once more with an acceptor of adjacent pieces: the arc from piece a to
  piece b weighs 0 if merging a + b by the model's rules gives back exactly (a, b), else infinity. A text's BPE encoding is the one sequence of
  which all adjacent pairs hold (merges inside two neighbours run in the same order alone as within a text, until one crosses their border), so
  the path of weight 0 is the tokenizer's own result, and as each prefix of a text has one such path, a position's state is its last piece.
  Pairs are judged when first met and remembered.

Texts are cut where no piece can span the cut, and each worker remembers the paths of a bounded number of segments; what is forgotten is computed
again, so memory is bounded whatever the texts. Decoding maps ids to bytes, joins, reads UTF-8 (bad bytes become U+FFFD), and undoes the space rules.

Edge cases: null and empty texts have no pieces and decode to ""; a text that has SPACE itself decodes to spaces there; without byte pieces an
unknown character gives the unknown id. Rows are independent: null ids and repeated rows pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.pieces import BPE, BYTE, CONTROL, SPACE, Memo, Vocabulary, load

#: Segments whose paths a worker remembers, and pairs of pieces.
REMEMBERED, PAIRS = 250_000, 500_000
INFINITY = float("inf")


class Transducer:
    """Encodes and decodes texts; self.memo maps a segment of a text to its ids as bytes of self.dtype."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.dtype = np.uint16 if len(vocabulary.pieces) < 65536 else np.uint32
        self.trie: dict = {}
        for piece, i in vocabulary.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        if vocabulary.escape_spaces:  # the normaliser's rule " " -> SPACE, composed with the trie
            ahead = [self.trie]
            while ahead:
                node = ahead.pop()
                ahead += [v for k, v in node.items() if k not in ("", " ")]
                if SPACE in node:
                    node[" "] = node[SPACE]
        known = [vocabulary.scores[i] for i in vocabulary.ids.values()]
        bpe = vocabulary.model == BPE
        self.fallback_weight = 0.0 if bpe else 10 - min(known, default=0.0)
        #: The weight of each piece's arc by itself, and the least of all.
        self.weights = [0.0 if bpe else -x for x in vocabulary.scores]
        self.least = 0.0 if bpe else -max(known, default=0.0)
        #: What follows a piece (-1: the start or a fallback arc): piece -> whether the pair holds. None: any pair does.
        self.pairs: dict[int, dict[int, bool]] | None = {} if bpe else None
        self.judged = 0
        self.memo = Memo(self._solve, REMEMBERED)
        self.spelled = [self._spell(i) for i in range(len(vocabulary.pieces))]

    def _spell(self, i: int) -> bytes:
        kind, piece = self.v.kinds[i], self.v.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if i == self.v.unknown else piece.encode()

    # -- the acceptor of adjacent pieces

    def merged(self, text: str) -> list[str]:
        """The symbols that the model's merges leave of a short text: the best-scored adjacent pair first, the leftmost on ties."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = -INFINITY, -1
            for k in range(len(symbols) - 1):
                i = self.v.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and self.v.scores[i] > best:
                    best, at = self.v.scores[i], k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the arc to piece b weighs 0 after piece a, or, for a = -1, after the start or a fallback arc."""
        if self.judged >= PAIRS:
            for known in self.pairs.values():
                known.clear()
            self.judged = 0
        own = [self.v.pieces[b]] if a < 0 else [self.v.pieces[a], self.v.pieces[b]]
        found = self.pairs[a][b] = self.merged("".join(own)) == own
        self.judged += 1
        return found

    # -- composition and shortest path

    def arcs(self, text: str, start: int) -> list[tuple[int, int]]:
        """The arcs of the composition from start, shortest piece first: (end, id), or a fallback arc (start + 1, -1)."""
        node, out = self.trie, []
        for end in range(start, len(text)):
            node = node.get(text[end])
            if node is None:
                break
            if "" in node:
                out.append((end + 1, node[""]))
        if not out or out[0][0] > start + 1:
            out.insert(0, (start + 1, -1))
        return out

    def path(self, text: str) -> list[tuple[int, int]]:
        """The arcs (end, id) of the shortest path through the composition with text: every arc is relaxed once, and only a strictly lesser weight
        replaces an arc."""
        n, pairs, weights, least = len(text), self.pairs, self.weights, self.least
        total, back, last = [0.0] + [INFINITY] * n, [0] * (n + 1), [-1] * (n + 1)
        for start in range(n):
            base, before = total[start], last[start]
            if base == INFINITY:
                continue
            if pairs is not None:
                after = pairs.get(before)
                if after is None:
                    after = pairs[before] = {}
            node, end, single = self.trie, start, False
            while end < n:
                node = node.get(text[end])
                if node is None:
                    break
                end += 1
                if "" not in node:
                    continue
                if end == start + 1:
                    single = True
                if total[end] <= base + least:  # no arc from here can be less
                    continue
                i = node[""]
                w = base + weights[i]
                if w < total[end]:
                    if pairs is not None:
                        holds = after.get(i)
                        if not (self.adjacent(before, i) if holds is None else holds):
                            continue
                    total[end], back[end], last[end] = w, start, i
            if not single and base + self.fallback_weight < total[start + 1]:
                total[start + 1], back[start + 1], last[start + 1] = base + self.fallback_weight, start, -1
        out, at = [], n
        while at:
            out.append((at, last[at]))
            at = back[at]
        return out[::-1]

    def _solve(self, segment: str) -> bytes:
        out = []
        for end, i in self.path(segment):
            if i >= 0:
                out.append(i)
            elif self.v.byte_ids is None:
                if not out or out[-1] != self.v.unknown:
                    out.append(self.v.unknown)
            else:
                c = segment[end - 1]
                out += [self.v.byte_ids[b] for b in (SPACE if c == " " and self.v.escape_spaces else c).encode()]
        return np.array(out, self.dtype).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.v.raw_segment.findall(self.v.prepare(text or "")))), self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")
        text = text.replace(SPACE, " ") if self.v.escape_spaces else text
        return text[1:] if self.v.dummy_prefix and text[:1] == " " else text


_COMPILED: dict[str, Transducer] = {}


def compiled(vocabulary: Vocabulary) -> Transducer:
    """One transducer per worker process and vocabulary, kept across tasks with what it remembers."""
    key = hashlib.sha256(repr((vocabulary.pieces, vocabulary.scores, vocabulary.kinds, vocabulary.model)).encode()).hexdigest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(vocabulary)
    return _COMPILED[key]


#: Ids that a worker holds before it hands them on.
HELD = 2_000_000


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """A row per document: doc_id, n_pieces, piece_ids, decoded_sha256, round_trip (the decoded text is the text). model: a .model file, read on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))  # a vocabulary: its size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(shared.value)

        def flush(rows: list) -> pa.RecordBatch:
            ids = [r[1] for r in rows]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = pa.array(np.concatenate(ids).astype(np.int32), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.bool_())],
                names=["doc_id", "n_pieces", "piece_ids", "decoded_sha256", "round_trip"],
            )

        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids = t.encode(text)
                back = t.decode(ids)
                rows.append((doc_id, ids, hashlib.sha256(back.encode()).hexdigest(), back == text))
                held += len(ids)
                if held >= HELD or len(rows) >= 2000:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, piece_ids array<int>, decoded_sha256 string, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str, ids: str = "piece_ids") -> DataFrame:
    """encoded with the column decoded last: the text of each row's ids; null ids decode to null. Other columns stay, but one of that name is replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = [None if x is None else t.decode(np.array(x, np.int64)) for x in chain(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    clean = encoded.drop("decoded")
    return clean.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in clean.dtypes) + ", decoded string")
