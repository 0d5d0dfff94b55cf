"""Operators on hand-made rows: edge cases that the SQL comparison on synthetic tables doesn't reach."""

import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import citations, cohorts, reconcile, stats, structure, vectors
from tandem.sources import article_html, readers, schemas
from tandem.streaming import ingest


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_delta_universe_counts_titles_without_citations(spark):
    cites = spark.createDataFrame([("A", "t", "d", 2), ("B", "t", "d", 5), ("A", "only", "d", 9)], "corpus string, title string, domain string, cnt long")
    titles = spark.createDataFrame([("t",), ("empty",)], "title string")
    got = citations.domain_delta(cites, titles).first()
    assert (got.delta_sum, got.added_pages, got.total_titles_compared, got.added_prop) == (3, 1, 2, 0.5)


def test_maximal_and_missing_sides(spark):
    cites = spark.createDataFrame([("A", "t", "r", 5), ("A", "t", "u", 1), ("B", "t", "r", 2), ("B", "t", "u", 3), ("B", "t", "zzz", 4)], "corpus string, title string, domain string, cnt long")
    dim = spark.createDataFrame([("r", "Generally reliable"), ("u", "Generally unreliable")], "domain string, status string")
    got = citations.status_shift(cites, dim).first()
    assert (got.maximal, got.b_other, got.a_other, got.b_total) == (3, 4, 0, 9)


def test_last_entry_of_a_dimension_wins(spark):
    dim = spark.createDataFrame([("d", "old", 1), ("d", "new", 2)], "domain string, status string, pos int")
    assert rows(citations.last_of(dim, "domain", "pos")) == [("d", "new")]


def test_histogram_edges(spark):
    v = spark.createDataFrame([(0.29,), (1.0,), (-0.1,), (None,)], "v double")
    got = {r.bin: (r["count"], round(r.percent, 6)) for r in stats.histogram(v, "v", stats.linear_edges(0.0, 1.0, 100)).collect()}
    want = int(np.searchsorted(np.linspace(0, 1, 101), 0.29, side="right"))
    assert got == {want: (1, 33.333333), 100: (1, 33.333333)}


def test_pair_stats_and_ties(spark):
    sims = spark.createDataFrame([("t", 0, i, float(i)) for i in range(5)] + [("t", 1, 7, 1.0), ("t", 1, 3, 1.0)], "title string, a_chunk_id long, b_chunk_id long, similarity double")
    got = vectors.pair_stats(sims.where("a_chunk_id = 0")).first()
    assert got.sim_median == 2 and got.sim_p90 == pytest.approx(3.6)
    assert rows(vectors.top1(sims), "a_chunk_id") == [("t", 0, 4, 4.0), ("t", 1, 3, 1.0)]


def test_section_dedup_is_sequential(spark):
    kind = "array<struct<level:string,content:array<struct<type:string,text:string>>>>"
    one = [("h1", [("p", "x"), ("p", "y")]), ("h2", [("p", "y")])]
    two = [("h1", [("p", "x"), ("list", None)]), ("h1", [("p", "x")]), ("h2", [("list", None)])]
    df = spark.createDataFrame([(0, one), (1, two), (2, []), (3, None)], f"i int, s {kind}")
    got = [r.s for r in df.select("i", structure.dedup_sections(F.col("s")).alias("s")).orderBy("i").collect()]
    flat = [[[tuple(c) for c in s.content] for s in x] if x else x for x in got]
    assert flat == [[[("p", "x")], [("p", "y")]], [[], [("p", "x")], [("list", None)]], [], None]


def test_compare_empty_outlines(spark):
    kind = "array<struct<lvl:int,name:string>>"
    got = structure.compare(spark.createDataFrame([(1, [], [(1, "a")]), (2, None, [])], f"id int, a {kind}, b {kind}")).orderBy("id").collect()
    assert (got[0].jaccard, got[0].depth_cosine, got[0].outline_length_ratio) == (0.0, 0.0, None)
    assert (got[1].jaccard, got[1].depth_cosine, got[1].lcs_ratio) == (1.0, 1.0, 0.0)


PAGE = """<html><body><div class="mx-auto max-w-[850px]"><h1 id="a">Ti<b>tle</b></h1><span class="mb-4"> One  two </span>
<h2 id="b">B</h2><ul><li>i<li>j</ul><span class="x mb-4">One two</span><h3 id="c">C</h3><ol><li>k</li></ol>
<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table><span class="mb-4">Ref a b tail</span></div>
<div id="references"><ul><li>Ref a b c <a href="/u">link</a></li></ul></div><button>See Edits (12)</button></body></html>"""


def test_article_parser(spark):
    got = article_html.parse(PAGE, "https://s/page/T_x")
    assert got["title"] == "T_x" and got["main_title"] == "Title" and got["metadata"] == {"has_edits": True, "fact_check_timestamp": None, "edits_count": 12}
    assert [s["level"] for s in got["sections"]] == ["h1", "h2", "h3"]
    assert [c["type"] for c in got["sections"][0]["content"]] == ["paragraph", "list", "paragraph", "ordered_list", "paragraph"]
    assert got["paragraphs"] == ["One two"] and got["tables"] == [{"headers": ["h"], "rows": [["1", "2"]]}]
    assert got["references"] == [{"text": "Ref a b clink", "link": {"href": "/u", "text": "link"}}]
    df = spark.createDataFrame([("https://s/page/T", PAGE), ("u", None)], "url string, html string")
    assert [r.n for r in article_html.parse_pages(df).select("url", F.size("data.sections").alias("n")).orderBy("url").collect()] == [3, 0]


def test_dedup_and_ordinal(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 3, "z")], "k string, o int, v string")
    assert rows(reconcile.dedup_first(df, "k", "o"), "k") == [("a", 1, None), ("b", 3, "z")]
    assert rows(reconcile.dedup_last(df, "k", "o"), "k") == [("a", 2, "x"), ("b", 3, "z")]
    got = rows(reconcile.ordinal(spark.range(0, 500, 1, 7).repartition(5), "id").select("id", "index"), "id")
    assert got == [(i, i) for i in range(500)]
    assert sorted(r.shard for r in reconcile.shard_range(spark.range(10), F.col("id"), 10, 4).collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]


def test_probe_and_sample(spark):
    slugs = spark.createDataFrame([("Gómez(x)",), ("nope",)], "slug string")
    known = spark.createDataFrame([("Gómez_(x)",), ("Gomez(x)",)], "slug string")
    assert rows(reconcile.probe_slugs(slugs, known)) == [("Gómez(x)", "Gómez_(x)")]
    assert rows(reconcile.sample_exact(spark.range(100), "id", 7), "id") == rows(reconcile.sample_exact(spark.range(100).repartition(9), "id", 7), "id")


def test_pageview_lines(spark):
    lines = ["en.wikipedia Foo_Bar 1 desktop 5 A5", "en.wikipedia - 2 9", "de.wikipedia X 3 4", "en.wikipedia X 3 x", "en.wikipedia Y null 7", "en.wikipedia"]
    got = cohorts.pageview_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(got, "title") == [("foo bar", "1", 5), ("y", "null", 7)]


WIKI = """{| class="wikitable"
|- class="s-gr" id="Foo"
| [[Foo (paper)|Foo]]
| {{WP:RSPSTATUS|gu}}
| x
| {{WP:RSPLAST|2021}}
| text
|more
| {{WP:RSPUSES|https://www.Foo.com/a|bar.org}}
|- class="s-d" id="Short"
| a
| b
|}
"""


def test_sources(spark, tmp_path):
    (tmp_path / "t.wiki").write_text(WIKI)
    got = rows(readers.reliability_table(spark, str(tmp_path / "t.wiki")), "domain")
    assert got == [("bar.org", "Foo (paper)", "Foo", "generally_unreliable", 2021), ("foo.com", "Foo (paper)", "Foo", "generally_unreliable", 2021)]
    (tmp_path / "a.jsonl").write_text('{"slug": "a", "fixedIssuesCount": 1}\n\nnot json\n{"slug": "b"}\n')
    assert [r.slug for r in readers.ndjson(spark, str(tmp_path / "a.jsonl"), schemas.FIXED_ISSUES).orderBy("ingest").collect()] == ["a", "b"]
    assert readers.failures(spark, str(tmp_path / "a.jsonl"), schemas.FIXED_ISSUES).count() == 1
    (tmp_path / "u.json").write_text('{"urls": ["x", "y"]}')
    (tmp_path / "v.json").write_text('["x"]')
    (tmp_path / "w.txt").write_text("x\n\n y \n")
    assert [readers.url_list(spark, str(tmp_path / n)).count() for n in ("u.json", "v.json", "w.txt")] == [2, 1, 2]
    with tarfile.open(tmp_path / "d.tar.gz", "w:gz") as tar:
        data = b"\n".join(json.dumps({"name": n}).encode() for n in "abc")
        info = tarfile.TarInfo("m.ndjson")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    wanted = spark.createDataFrame([("a",), ("c",)], "title string")
    assert [r.title for r in readers.extract_titles(spark, str(tmp_path / "d.tar.gz"), wanted).orderBy("title").collect()] == ["a", "c"]
    np.save(tmp_path / "e.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    assert rows(vectors.from_npy(spark, str(tmp_path / "e.npy"), 3).select("emb_ix", "embedding"), "emb_ix")[3] == (3, [9.0, 10.0, 11.0])


def test_stream_ingest_with_dead_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"slug": "a", "status_code": 200}\n{"slug": "b", "status_code": 404}\n')
    for turn in range(2):
        stream = ingest.crawl_stream(spark, str(tmp_path / "in"), "slug string, status_code int")
        ingest.ingest(stream, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination()
        if turn == 0:
            (tmp_path / "in/2.json").write_text('{"slug": "c", "status_code": 429}\n')
    assert [r.slug for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["a"]
    assert sorted((r.slug, r.error) for r in spark.read.parquet(str(tmp_path / "dead")).collect()) == [("b", "not_found"), ("c", "rate_limited")]


def test_geo_and_topics(spark):
    articles = spark.createDataFrame([("a", ["Geography.Regions.Europe.North"]), ("b", []), ("c", None)], "title string, topics array<string>")
    got = rows(cohorts.topics(articles).select("title", "topic_prefix", "continent", "subcontinent"), "title")
    assert got == [("a", "Geography", "Europe", "North"), ("b", None, None, None), ("c", None, None, None)]
