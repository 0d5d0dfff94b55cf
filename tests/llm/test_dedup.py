"""Near-dedup and line dedup against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tandem.llm import line_dedup, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t))
    ids = sorted(k for k in sets if k is not None)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


def check_near(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = near_dedup.near_duplicates(docs).collect()
    want = brute_components(rows)
    assert sorted((r.doc_id is None, r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted((False, i, len(shingle_set(t))) for i, t in rows if i is not None)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None) and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_odd_rows(odd_documents, no_documents):
    check_near(odd_documents)
    assert near_dedup.near_duplicates(no_documents).count() == 0


def test_near_duplicates_around_the_threshold(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 200, 600]))]
        for _ in range(8):
            edited = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append(" ".join(edited))
    passage = [rng.choice(vocabulary) for _ in range(70)]
    for _ in range(40):  # a passage that many texts share makes buckets of texts that aren't alike
        rows.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(60)]))
    rng.shuffle(rows)
    check_near(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5))


def test_a_chain_through_a_large_group(spark):
    """Texts in one bucket that hang on its head only through others."""
    words = [f"v{i}" for i in range(160)]
    rows = [(k, " ".join(words[k * 6 : k * 6 + 60])) for k in range(16)] + [(100 + k, " ".join(words[:60] + [f"t{k}"])) for k in range(60)]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    one, two = np.unique(a[:2400]), np.unique(a[600:])
    both = near_dedup.sketch([one, two, np.union1d(one, two)])
    assert (near_dedup.merge(both[0], both[1]) == both[2]).all()
    j = near_dedup.estimate(both[:1], both[1:2], np.array([len(one)]), np.array([len(two)]))[0]
    assert abs(j - 1800 / 3000) < 0.12
    single = near_dedup.sketch([np.array([5], np.uint64), np.zeros(0, np.uint64)])
    assert single[0].all() and not single[1].any()


def test_deduplicate_keeps_one(odd_documents):
    kept = near_dedup.deduplicate(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 7 in ids and 8 not in ids and None in ids


def brute_lines(rows, min_sites, min_words):
    places, sites = {}, {}
    for i, t, s in rows:
        for at, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(WORD.findall(line)) >= min_words:
                key = line.strip(" \t\n\x0b\x0c\r")
                place = (i if i is not None else 2**63 - 1, at)
                places[key] = min(places.get(key, place), place)
                sites.setdefault(key, set()).add(s)
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None))
            continue
        keep = []
        for at, line in enumerate(t.split("\n")):
            key = line.strip(" \t\n\x0b\x0c\r")
            if len(sites.get(key, ())) >= min_sites and len(WORD.findall(line)) >= min_words and places[key] != (i if i is not None else 2**63 - 1, at):
                continue
            keep.append(line)
        out.append((i, "\n".join(keep)))
    return out


@pytest.mark.parametrize("min_sites", [2, 5, 9, 10])
def test_line_dedup(odd_documents, min_sites):
    rows = [(r.doc_id, r.text, r.source) for r in odd_documents.collect()]
    got = line_dedup.remove_lines(odd_documents, min_sites=min_sites, min_words=3)
    assert got.columns == odd_documents.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    have = sorted(((r.doc_id, r.text) for r in got.collect()), key=key)
    assert have == sorted(brute_lines(rows, min_sites, 3), key=key)


def test_line_dedup_of_nothing(no_documents):
    assert line_dedup.line_dedup(no_documents).count() == 0


def test_short_lines_of_many_sites_go(spark):
    """Lines of one or two words, and of a script without spaces, as the operator runs by default; blank lines stay."""
    rows = [(i, f"own text number {i} here\nLes.\n\nAnd ornd.\n全著作権所有\nfew{i % 4}", f"s{i % 8}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.remove_lines(docs).collect()}
    assert got == dict(brute_lines(rows, 5, 1))
    assert got[0] == rows[0][1] and got[5] == "own text number 5 here\n\nfew1"
    assert {r.doc_id: r.n_removed for r in line_dedup.line_dedup(docs).collect()} == {i: 3 * (i > 0) for i in range(24)}


def test_rows_of_one_id_lose_only_their_own_boilerplate(spark):
    """Repeated and null ids, boilerplate at different places of them, columns of clashing names, and a text of many lines."""
    rows = [(i % 40 if i % 4 else None, f"own {i} text\n{'pad' + str(i)}\nshared line here" if i % 3 else f"shared line here\nown {i} text\nBye.", f"s{i % 8}") for i in range(160)]
    rows += [rows[5], rows[8], (None, "shared line here\nprecious", "s1"), (None, "precious too\nshared line here\nBye.", "s1"), (50, None, "s1"), (50, "Bye.", "s2"), (None, None, None)]
    rows.append((60, "\n".join(f"l{k}" if k % 2 else "Bye." for k in range(20_000)), "s3"))
    clash = ["_id", "_at", "_clean", "_gone", "removed", "lines", "at", "h1", "t1", "site", "clean", "row_doc_id", "a.b"]
    docs = spark.createDataFrame([(*r, *map(str, range(len(clash)))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in clash)).repartition(4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    out = line_dedup.remove_lines(docs)
    got = out.collect()
    assert out.columns == docs.columns and all([r[c] for c in clash] == list(map(str, range(len(clash)))) for r in got)
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(brute_lines(rows, 5, 1), key=key)
    assert any("precious" == r.text for r in got) and len(line_dedup.line_dedup(docs).collect()) == len(rows)


def test_near_threshold_lines_are_counted_exactly(spark):
    """With a coarse sketch the estimates are off; the decisions are not."""
    rows = [(s * 10 + k, f"line number {k} of them", f"site{s}") for k in range(6) for s in range(60 + k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = line_dedup.boilerplate(docs, min_sites=63, min_words=3, log2_k=4)
    assert sorted(r.first.doc_id % 10 for r in found.select(F.col("first")).collect()) == [3, 4, 5]


def texts_at(rng, similarity, n, length=300):
    """n lists of words of which any two have about the given similarity: one base, of which each keeps a share of the shingles, at places of its own."""
    base = [f"b{k}" for k in range(length)]
    share = (2 * similarity / (1 + similarity)) ** 0.5
    rows = []
    for _ in range(n):
        words = list(base)
        while sum(words[i : i + 5] == base[i : i + 5] for i in range(length - 4)) > share * (length - 4):
            words[rng.randrange(length)] = f"p{rng.randrange(10**9)}"
        rows.append(words)
    return rows


def test_a_large_group_of_near_copies(spark):
    """Near copies of which many are linked with nothing."""
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for _ in range(110):
        edited = list(base)
        for _ in range(rng.randrange(0, 14)):
            edited[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append(" ".join(edited))
    check_near(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3))


def test_links_hidden_in_a_group_of_unlinked_texts(spark):
    """Recall where it is hardest: pairs of similarity 0.75 to 0.80, each in a group of hundreds of texts that are linked with nothing else and share its buckets."""
    rng = random.Random(17)
    rows = [" ".join(x) for x in texts_at(rng, 0.55, 300)]
    for words in texts_at(rng, 0.55, 60):
        twin = list(words)
        for at in range(20, 300, 300 // rng.choice([7, 8])):
            twin[at] = f"t{rng.randrange(10**9)}"
        rows += [" ".join(words), " ".join(twin)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    sets = [shingle_set(rows[i]) for i in order]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    near = {p for p in want if 100 * len(sets[p[0]] & sets[p[1]]) < 80 * len(sets[p[0]] | sets[p[1]])}
    assert len(near) >= 40
    docs = spark.createDataFrame([(k, rows[i]) for k, i in enumerate(order)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    linked = {(a, b) for a in got for b in got if a < b and got[a] == got[b]}
    recall = sum(p in linked for p in near) / len(near)
    print("recall at 0.75 to 0.80:", recall)
    assert recall >= 0.9
    brute = brute_components([(k, rows[i]) for k, i in enumerate(order)])
    assert all(brute[a] == brute[b] for a, b in linked)


def test_candidates_grow_with_the_group(spark, monkeypatch):
    """Twice as many near copies that are linked with nothing: at most twice as many pairs to verify."""
    counts = []
    real = near_dedup.candidates

    def counted(*args):
        pairs = real(*args)
        counts[-1] += pairs.count()
        return pairs

    monkeypatch.setattr(near_dedup, "candidates", counted)
    texts = [" ".join(x) for x in texts_at(random.Random(19), 0.70, 600)]
    for n in (300, 600):
        counts.append(0)
        got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string").repartition(3))
        assert got.where("kept").count() > 0.9 * n
    print("pairs:", counts)
    assert 0 < counts[0] and counts[1] <= 2.2 * counts[0]


def nearly_linked(rng):
    """Links of about 0.76 in a group of texts that fall just short of one, many of which a sketch takes for likelier."""
    rows = [" ".join(x) for x in texts_at(rng, 0.715, 200)]
    for words in texts_at(rng, 0.715, 20):
        twin = list(words)
        for at in range(20, 300, 40):
            twin[at] = f"t{rng.randrange(10**9)}"
        rows += [" ".join(words), " ".join(twin)]
    rng.shuffle(rows)
    return rows


def test_links_behind_likelier_pairs(spark):
    check_near(spark.createDataFrame(list(enumerate(nearly_linked(random.Random(23)))), "doc_id long, text string").repartition(3))


def test_pipeline_drops_copies_behind_likelier_pairs(spark):
    rows = list(enumerate(nearly_linked(random.Random(37))))
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert {r.doc_id for r in kept} == set(brute_components(rows).values())


def test_every_open_pair_of_a_bucket_meets(spark, monkeypatch):
    """Blocks of a few members: any two members of different components meet in a task, whatever the bucket's size."""
    monkeypatch.setattr(near_dedup, "MEMBERS", 7)
    rng = random.Random(29)
    rows = [(key, key * 1000 + k, 100, 0 if rng.random() < share else k + 1) for key, (n, share) in enumerate([(2, 0), (7, 0.5), (8, 0.5), (60, 0.8), (60, 0), (90, 0.4)]) for k in range(n)]
    tasks = {}
    for r in near_dedup.candidates(spark.createDataFrame(rows, "key long, doc_id long, n long, c long")).collect():
        tasks.setdefault((r.key, r.x, r.y), set()).add(r.doc_id)
    assert max(map(len, tasks.values())) <= 40
    for key, a, _, ca in rows:
        for other, b, _, cb in rows:
            assert key != other or ca == cb or any(t[0] == key and a in ids and b in ids for t, ids in tasks.items())


def test_overlaps_are_exact():
    rng = np.random.default_rng(31)
    sets = [np.unique(rng.choice(rng.integers(0, 2**63, 9000).astype(np.uint64), size=n)) for n in (1, 0, 40)]
    common = rng.integers(0, 2**63, 9000).astype(np.uint64)
    sets += [np.unique(common[rng.random(9000) < share]) for share in [0.9] * 25 + [0.02] * 15]
    got = near_dedup.overlaps(sets)
    assert all(got[i, j] == (len(np.intersect1d(sets[i], sets[j])) if i < j else 0) for i in range(len(sets)) for j in range(len(sets)))
    assert not near_dedup.overlaps([np.zeros(0, np.uint64)] * 2).any()
    assert near_dedup.joined(sets[3:] + [sets[3]], [*range(40), 50]) and near_dedup.joined(sets[:3], [1, 1, 1]) == []
