"""Scalar functions against values reasoned from their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from tandem.functions import measures as M
from tandem.functions import urls as U


def apply(spark, kind, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_stem_and_netloc(spark):
    assert apply(spark, "string", ["www.m.bbc.co.uk", "m.en.x.com", "WWW.Foo.com", "en.wiki.org", None], U.stem_domain) == ["bbc.co.uk", "en.x.com", "www.foo.com", "wiki.org", None]
    assert apply(spark, "string", ["http://a.b:80/x", "//U@h/y", "no", "https://Ex.com?q"], U.netloc) == ["a.b:80", "U@h", "", "Ex.com"]
    assert apply(spark, "string", ["edition.cnn.com", "other.org"], U.combine_domains) == ["cnn.com", "other.org"]


def test_titles(spark):
    assert apply(spark, "string", ["https://s/page/A%20b_c+d", "https://s/x", "https://s/page/bad%zz"], U.page_title) == ["A b c+d", None, "bad%zz"]
    assert apply(spark, "string", ["A (b)", "A(b)", "ΦX174"], U.title_to_slug) == ["A_(b)", "A_(b)", "PhiX174"]
    assert apply(spark, "string", ["x.gov.uk", "a.mil", "government.org", None], U.is_government) == [True, True, False, False]
    assert apply(spark, "string", ["  A  b\n", None], U.norm_space) == ["a b", ""]
    assert apply(spark, "string", ["Talk:Foo/Archive 1", "User talk:x"], U.controversial_title) == ["foo/", None]
    assert apply(spark, "string", ["x_shard3of10.npy", "plain.npy"], U.shard_of) == [(10, 3), (1, 0)]


def test_slug_variants(spark):
    (out,) = apply(spark, "string", ["Gómez's"], U.slug_variants)
    assert out[0] == "Gómez's" and {"Gmez's", "Gómezs", "Gomez's", "Gómez_s"} <= set(out) and len(out) == len(set(out))


def test_handles(spark):
    urls = ["https://www.facebook.com/some.body", "https://www.facebook.com/groups/x12345", "https://facebook.com/12345", "https://x.com/i/x", "https://www.instagram.com/p/abc", None]
    got = apply(spark, "string", urls, U.social_handles)
    assert got[0] == [("facebook.com", "some.body")] and not any(got[1:5])


def test_buckets(spark):
    assert apply(spark, "double", [0.6, 0.2, 1.0, 1.2, None, 0.6000000000000001], M.score_bucket) == [2, 1, 4, None, None, 3]
    assert apply(spark, "double", [0.5, 0.3, None], M.half_even_bucket) == ["0.4", "0.4", "No score"]
    assert apply(spark, "int", [0, 4, 5, 10, 11, 400, 401], M.chunk_band) == ["1", "5", "6-10", "6-10", "11-20", "351-400", ">400"]


def test_sets_and_cosine(spark):
    rows = spark.createDataFrame([([], []), (["a"], []), (["a", "a", "b"], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(M.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5]
    levels = spark.createDataFrame([([], []), ([1], []), ([1, 2, 2], [1, 2, 2])], "a array<int>, b array<int>")
    got = [r[0] for r in levels.select(M.histogram_cosine(M.depth_histogram(F.col("a")), M.depth_histogram(F.col("b")))).collect()]
    assert got[:2] == [1.0, 0.0] and got[2] == pytest.approx(1.0)


def test_tree(spark):
    assert apply(spark, "array<int>", [[3, 1, 3, 2]], M.indent_clamped) == [[2, 1, 2, 2]]
    assert apply(spark, "array<int>", [[2, 1, 2, 2], []], M.tree_signature) == [[2, -1, 1, 0], []]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_lcs_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(90))], [rng.choice("abcd") for _ in range(rng.randrange(90))]) for _ in range(150)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = [r[0] for r in rows.select("i", M.lcs_length("a", "b").alias("n")).orderBy("i").select("n").collect()]
    assert got == [lcs(a, b) for a, b in pairs]


def test_windows(spark):
    lengths = [0, 1, 250, 251, 400, 401, 1000]
    got = apply(spark, "string", [" ".join("w" * 1 for _ in range(n)) for n in lengths], lambda c: M.windows(M.whitespace_tokens(c)))
    assert [len(g) for g in got] == [0, 1, 1, 2, 2, 3, 6]
    assert all(sum(map(len, g[:1])) == min(n, 250) for g, n in zip(got, lengths) if n)


def test_books_and_issues(spark):
    refs = [["see 1999"], ["p. 3, 1850", None], ["no digits"], []]
    assert apply(spark, "array<string>", refs, M.is_book) == [True, True, False, False]
    assert apply(spark, "array<string>", refs, lambda c: M.is_book(c, strict=True)) == [False, True, False, False]
    assert apply(spark, "string", ["a | b", "", None, "x"], M.issue_types) == [["a", "b"], ["other"], ["other"], ["x"]]
    assert apply(spark, "string", ["Geography.Regions.Americas.North_America", "Culture.X", None], M.continent) == ["Americas", None, None]
