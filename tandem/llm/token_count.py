r"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton of the vocabulary reports every piece that ends at each position in one pass over the text. The search keeps, for each
position, the best score of a segmentation up to it and that segmentation's number of pieces; nothing is traced back. Ties follow the
tokenizer: it goes through starts from left to right and replaces a position's best only by a strictly better score, so of equal candidates the
one that starts first, with the longest last piece, holds. A character without a piece of its own is unknown: it scores ten less than the worst
piece and counts as its bytes (or, without byte pieces, a run of unknown characters counts as one).

The texts are cut where no piece can span the cut; scores of the segments add up to the text's, so each is searched on its own, and each worker
remembers the counts of a bounded number of segments.

Edge cases: null and empty texts have 0 tokens; rows are independent, so null ids and repeated rows pass through; extra columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.pieces import Memo, Vocabulary, load

REMEMBERED = 300_000
INFINITY = float("inf")


class Counter:
    """Counts a text's tokens; self.memo maps a segment of normalised text to its number of tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, i in vocabulary.ids.items():
            self.automaton.add_word(piece, (len(piece), float(vocabulary.scores[i])))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary.ids if len(p) == 1}
        self.unknown_score = min((vocabulary.scores[i] for i in vocabulary.ids.values()), default=0.0) - 10
        self.runs = vocabulary.byte_ids is None
        self.memo = Memo(self.search, REMEMBERED)

    def search(self, text: str) -> int:
        """The number of tokens of a segment. Matches come by their end, so all that a match builds on is settled when it comes."""
        n = len(text)
        best, width, count = [0.0] + [-INFINITY] * n, [0] * (n + 1), [0] * (n + 1)
        strange = [k for k, c in enumerate(text, 1) if c not in self.single]
        unknown, at = set(), 0
        for end, (size, score) in self.automaton.iter(text):
            end += 1
            while at < len(strange) and strange[at] < end:
                self._unknown(text, strange[at], best, count, unknown)
                at += 1
            s = best[end - size] + score
            if s > best[end] or s == best[end] and size > width[end]:
                best[end], width[end], count[end] = s, size, count[end - size] + 1
        for end in strange[at:]:
            self._unknown(text, end, best, count, unknown)
        return count[n]

    def _unknown(self, text: str, end: int, best: list, count: list, unknown: set) -> None:
        """The arc of the unknown character that ends at end; its start is the last one to reach there."""
        s = best[end - 1] + self.unknown_score
        if s > best[end]:
            best[end] = s
            count[end] = count[end - 1] + (len(text[end - 1].encode()) if not self.runs else end - 1 not in unknown)
            unknown.add(end)

    def count(self, text: str | None) -> int:
        normal = self.v.normalise(text or "")
        if self.runs:  # a run of unknown characters can go on over a cut
            return self.search(normal)
        return sum(map(self.memo.__getitem__, self.v.segment.findall(normal)))


_COMPILED: dict[str, Counter] = {}


def compiled(vocabulary: Vocabulary) -> Counter:
    key = hashlib.sha256(repr((vocabulary.pieces, vocabulary.scores, vocabulary.kinds)).encode()).hexdigest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Counter(vocabulary)
    return _COMPILED[key]


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """A row per document: doc_id, n_tokens (long). model: a .model file whose pieces and scores are taken as a unigram vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))  # a vocabulary: its size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([counter.count(t.as_py()) for t in batch.column(1)], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
