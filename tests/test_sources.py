"""Sources, the fetch stage and the commands on small files."""

import json

import pytest

from tandem import cli
from tandem.functions import urls as U
from tandem.sources import fetch, readers


def test_greek_names_are_letters():
    assert len(U.GREEK) == 50 and "".join(U.GREEK.values()).isalpha() and "".join(U.GREEK.values()).isascii()


def test_domain_map_as_a_list(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps([{"A": {"x.org": 2, "y.org": 1}}, {"B": {}}]))
    got = sorted(map(tuple, readers.domain_map(spark, str(path)).collect()), key=str)
    assert got == [("A", "x.org", 2), ("A", "y.org", 1), ("B", None, 0)]


def test_csv_by_declared_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text('source,pc1\n"a ""b"", c",0.5\nd,x\n')
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path), "source string, pc1 double").collect()] == [('a "b", c', 0.5), ("d", None)]
    with pytest.raises(Exception):
        readers.csv_table(spark, str(tmp_path), "other string, pc1 double").collect()


def test_wikitext_of_any_length(spark, tmp_path):
    """More than a million characters in a cell, and many rows."""
    row = lambda k, name: f'|- class="s-gr" id="i{k}"\n| [[{name}]]\n| {{{{WP:RSPSTATUS|gr}}}}\n| d\n| {{{{WP:RSPLAST|2021}}}}\n| {"long " * (300_000 if k == 1 else 1)}\n| {{{{WP:RSPUSES|s{k}.com}}}}\n'
    (tmp_path / "t.txt").write_text("{|\n" + "".join(row(k, f"N{k}") for k in range(40)) + "|}")
    got = readers.reliability_table(spark, str(tmp_path)).collect()
    assert {(r.domain, r.source_name, r.last_updated) for r in got} == {(f"s{k}.com", f"N{k}", 2021) for k in range(40)}


def test_pageview_bytes_are_made_valid(spark, tmp_path):
    (tmp_path / "v.txt").write_bytes(b"en.wikipedia A\xff 1 5\n")
    assert [r.value for r in readers.pageviews(spark, str(tmp_path)).collect()] == ["en.wikipedia A� 1 5"]


def test_fetch_retries_and_pauses(spark, tmp_path):
    log = tmp_path / "log"

    def get(key):
        with open(log, "a") as f:
            f.write(key + "\n")
        n = log.read_text().split("\n").count(key)
        return (503, None) if key == "slow" and n < 3 else (404, None) if key == "no" else (200, key.upper())

    rows = spark.createDataFrame([("slow",), ("no",), ("yes",), (None,)], "k string").coalesce(1)
    got = {r.k: (r.status_code, r.body, r.attempts) for r in fetch.fetched(rows, "k", get, attempts=4, per_minute=60_000, pause=lambda f, t: 0.0).collect()}
    assert got == {"slow": (200, "SLOW", 3), "no": (404, None, 1), "yes": (200, "YES", 1)}
    assert fetch.fetched(rows.limit(0), "k", get).count() == 0
    assert [fetch.page_pause(f, 10) for f in (3, 4)] == [0.0, 1.0] and [fetch.issue_pause(f, 100) for f in (10, 11, 15, 50)] == [0.0, 1.1, 1.5, 2.0] and fetch.page_pause(0, 0) == fetch.issue_pause(0, 0) == 0


def vectors(texts):
    return [[len(t) % 7 + 1.0, t.count("a") + 1.0, 1.0] for t in texts]


def answer(url):
    return (404, None) if url.endswith("3") else (200, f"page of {url}")


def test_commands(spark, tmp_path, capsys):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    (a / "x.json").write_text("\n".join(json.dumps({"name": f"T{k}", "sections": [{"name": "Abstract", "has_parts": [{"value": "a word " * 190}]}]}) for k in range(4)) + "\nbroken\n")
    (b / "x.json").write_text("\n".join(json.dumps({"title": f"T{k}", "data": {"sections": [{"level": "h1", "title": f"T{k}", "content": [{"type": "paragraph", "text": "some aa words " * 150}]}]}}) for k in range(1, 6)))
    at = lambda n: str(tmp_path / n)
    cli.main(["build-corpus", "--a", str(a), "--b", str(b), "--out", at("chunks")], spark)
    chunks = spark.read.parquet(at("chunks")).orderBy("emb_ix").collect()
    assert {r.title for r in chunks} == {"T1", "T2", "T3"} and [r.emb_ix for r in chunks] == list(range(len(chunks))) and len(chunks) == 3 * (2 + 3)
    cli.main(["embed", "--chunks", at("chunks"), "--out", at("vectors"), "--model", "tests.test_sources:vectors"], spark)
    cli.main(["similarities", "--embedded", at("vectors"), "--stats", at("stats"), "--top1", at("top1")], spark)
    stats = {r.title: (r.n_a, r.n_b) for r in spark.read.parquet(at("stats")).collect()}
    assert stats == {f"T{k}": (2, 3) for k in (1, 2, 3)} and spark.read.parquet(at("top1")).count() == 6
    (tmp_path / "urls.txt").write_text("\n".join(f"u{k}" for k in range(23)))
    cli.main(["shards", "--urls", at("urls.txt"), "--out", at("shards"), "--shards", "3"], spark)
    assert capsys.readouterr().out.count("run-shard") == 3
    for again in range(2):
        cli.main(["run-shard", "--shards", at("shards"), "--shard", "2", "--out", at("done"), "--fetch", "tests.test_sources:answer"], spark)
    pages = [r.url for r in spark.read.json(at("done/pages")).collect()]
    assert len(pages) == len(set(pages)) and all(not u.endswith("3") for u in pages)
    assert len(pages) + spark.read.json(at("done/failed")).select("url").distinct().count() == 7
