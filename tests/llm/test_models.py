"""Transducer and token counts against the libraries; toxicity on held-out words."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tandem.llm import pieces, queries, token_count, toxicity, transducer

MODEL = queries.PIECE_MODEL
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the vocabulary file")


def strings(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "the", "▁", " ", "  ", "\n", "\t", "é", "☃", "ｆ", "\x00", "ing", "한", "梦", "tion", "\U0001f600", "é", "ÄÖ", "1999"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(MODEL)


def test_encoding_equals_the_library(vocabulary):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    t = transducer.Transducer(vocabulary)
    for text in [*strings(3000, 1), "x" * 5000, "", " "]:
        ids = t.encode(text)
        assert ids.tolist() == sp.encode(text)
        assert t.decode(ids) == sp.decode(sp.encode(text))


def brute_force(t, text):
    """The least path by trying all, for a unigram model."""
    best = {0: (0.0, [])}
    for end in range(1, len(text) + 1):
        for start in range(end):
            if start not in best:
                continue
            for e, i in t.arcs(text, start):
                if e == end:
                    w = best[start][0] + (t.fallback_weight if i < 0 else -t.v.scores[i])
                    if end not in best or w < best[end][0]:
                        best[end] = (w, best[start][1] + [(e, i)])
    return best[len(text)][1]


def test_unigram_shortest_path():
    v = pieces.Vocabulary(["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "aba"], [0, -2, -2, -2, -3, -3, -3, -6], [2, 1, 1, 1, 1, 1, 1, 1], pieces.UNIGRAM, True, False, True)
    t = transducer.Transducer(v)
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("ab▁z") for _ in range(rng.randrange(10)))
        assert t.path(text) == brute_force(t, text)


def test_counts_equal_the_library(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.models.Unigram(list(zip(vocabulary.pieces, vocabulary.scores)), vocabulary.unknown, True)
    u = tokenizers.Tokenizer(model)
    u.normalizer = tokenizers.normalizers.Sequence([tokenizers.normalizers.Prepend("▁"), tokenizers.normalizers.Replace(" ", "▁")])
    c = token_count.Counter(vocabulary)
    for text in filter(None, strings(3000, 3)):
        assert c.count(text) == len(u.encode(text, add_special_tokens=False).ids), repr(text)
    assert c.count("") == c.count(None) == 0


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
def test_character_maps_equal_the_library(rule, tmp_path):
    """The compiled maps of the library's own normalisers."""
    spm = pytest.importorskip("sentencepiece")
    if not hasattr(spm, "SentencePieceNormalizer"):
        pytest.skip("no normaliser in this library")
    library = spm.SentencePieceNormalizer(rule_name=rule)
    proto = dict(pieces._fields(dict(pieces._fields(library.serialized_model_proto()))[3]))
    v = pieces.Vocabulary([], [], [], pieces.UNIGRAM, bool(proto.get(3, 1)), bool(proto.get(4, 1)), bool(proto.get(5, 1)), proto[2])
    for text in [*strings(2000, 5), "ﬁ Ⅷ ｶﾞ e\u0301 \u3000 ½ İSTANBUL ß", "", "ﾊﾟ\u200b\ufeff"]:
        assert v.normalise(text) == library.normalize(text), repr(text)


def test_a_model_with_a_character_map_and_spaces():
    v = pieces.Vocabulary(["<unk>", "▁", "a", "b", "▁ab"], [0, -1, -1, -1, -1], [2, 1, 1, 1, 1], pieces.UNIGRAM, True, True, True)
    t = transducer.Transducer(v)
    assert [v.pieces[i] for i in t.encode("  ab   a ")] == ["▁ab", "▁", "a"] and t.encode("").tolist() == t.encode("  ").tolist() == []
    assert t.decode(t.encode("ab a")) == "ab a"


def test_models_with_other_kinds_of_pieces_are_refused(tmp_path):
    field = lambda number, value: bytes([number << 3 | 2, len(value)]) + value
    piece = lambda text, kind: field(1, field(1, text.encode()) + bytes([3 << 3, kind]))
    for kind in (pieces.USER_DEFINED, pieces.UNUSED):
        (tmp_path / "m.model").write_bytes(piece("<unk>", 2) + piece("a", 1) + piece("b", kind))
        with pytest.raises(ValueError):
            pieces.load(str(tmp_path / "m.model"))


def test_queries_equal_the_libraries(spark, odd_documents, tmp_path):
    """The registered queries, over a written table, against the libraries row by row."""
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    tokenizers = pytest.importorskip("tokenizers")
    v = pieces.load(MODEL)
    unigram = tokenizers.Tokenizer(tokenizers.models.Unigram(list(zip(v.pieces, v.scores)), v.unknown, True))
    unigram.normalizer = tokenizers.normalizers.Sequence([tokenizers.normalizers.Prepend("▁"), tokenizers.normalizers.Replace(" ", "▁")])
    own = odd_documents.union(spark.createDataFrame([(1000 + i, t, "en", "s", "x") for i, t in enumerate(strings(300, 9))], odd_documents.schema))
    own.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text or "") for r in own.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    got = [(r.doc_id, r.n_pieces, list(r.piece_ids), r.round_trip) for r in queries.op4_sentencepiece(spark, str(tmp_path)).collect()]
    want = [(i, len(ids), ids, sp.decode(ids) == t) for i, t in rows for ids in [sp.encode(t)]]
    assert sorted(got, key=key) == sorted(want, key=key)
    counts = [tuple(r) for r in queries.op10_token_counts(spark, str(tmp_path)).collect()]
    assert sorted(counts, key=key) == sorted([(i, len(unigram.encode(t, add_special_tokens=False).ids) if t else 0) for i, t in rows], key=key)


def test_toxicity_scores_of_the_query_by_brute_force(spark, tmp_path):
    """Every score from the trained numbers, n-gram by n-gram in plain loops, and floors for held-out rows."""
    rng = random.Random(23)
    clean = ["river", "stone", "lamp", "quiet", "winter", "letter", "shore", "candle", "wheel", "under"]
    rows = [(i, " ".join([rng.choice(clean) + rng.choice(["", "s", "ly"]) for _ in range(30)] + (["scumbag", "wretched"] if i % 4 == 0 else []))) for i in range(500)] + [(501, None), (502, "12 !"), (503, "RIVER " * 50_000), (None, "stone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)], "doc_id long, toxic int, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit(docs, labels)

    def brute(text):
        words = ["<" + w + ">" for w in __import__("re").findall(r"[^\W\d_]+", (text or "").lower())]
        total = 0.0
        for w in words:
            parts = [w] + [w[i : i + n] for n in (3, 4, 5) if n < len(w) for i in range(len(w) - n + 1)]
            total += sum(model.shares[__import__("zlib").crc32(p.encode()) % toxicity.BUCKETS] for p in parts) / len(parts)
        return 1 / (1 + __import__("math").exp(-(model.bias + (total / len(words) if words else 0.0))))

    out = queries.op3_toxicity(spark, str(tmp_path)).collect()
    texts = {i: t for i, t in rows}
    assert len(out) == len(rows) and all(r.score == pytest.approx(brute(texts[r.doc_id]), abs=1e-9) and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    toxic = [r for r in held if r.doc_id % 4 == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in held) - sum(r.predicted for r in toxic) <= 0.02 * len(held)


def test_memo_keeps_what_it_solves():
    calls = []
    memo = pieces.Memo(lambda k: calls.append(k) or len(k), 4)
    for k in "abcdefgabcdefg":
        assert memo[k] == 1
    assert len(memo) <= 4 and memo["x" * 100] == 100 and "x" * 100 not in memo


def test_documents(odd_documents, no_documents):
    n = odd_documents.count()
    encoded = transducer.encode_documents(odd_documents, MODEL)
    assert encoded.count() == n
    assert encoded.where(~F.col("round_trip")).count() == 0
    back = transducer.decode_documents(encoded, MODEL)
    texts = sorted(r.text or "" for r in odd_documents.collect())
    assert sorted(r.decoded for r in back.collect()) == texts
    counts = token_count.count_tokens(odd_documents, MODEL)
    assert counts.count() == n and counts.where("n_tokens = 0").count() == 2
    assert transducer.encode_documents(no_documents, MODEL).count() == token_count.count_tokens(no_documents, MODEL).count() == 0


def test_toxicity_learns_and_shares_subwords(spark, odd_documents, no_documents):
    rng = random.Random(8)
    clean = ["river", "stone", "lamp", "quiet", "winter", "letter", "shore", "candle", "wheel", "under"]
    bad = ["idiotic", "scumbag", "wretched"]
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        words = [rng.choice(clean) + rng.choice(["", "s", "ly", "ed"]) for _ in range(40)]
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    rows += [(9000, " ".join(["river stone lamp"] * 12 + ["idiottic scumbagg wretchedd"]), None), (9001, "river stone lamp " * 12, None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(got[i].score, y) for i, _, y in rows if y is not None and got[i].held_out]
    assert len(held) > 100 and min(s for s, y in held if y) > max(s for s, y in held if not y)
    # Misspellings that training never met lie above every clean text.
    assert got[9000].score > 0.5 and got[9000].score > 10 * max([got[9001].score, *(s for s, y in held if not y)])
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(7), labels.repartition(3)).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)
    odd = toxicity.toxicity(odd_documents, labels).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.toxicity(odd_documents, labels.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0} and toxicity.toxicity(no_documents, labels).count() == 0


def test_held_out_labels_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} other words here") for i in range(90)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, flipped))
    assert one == two
