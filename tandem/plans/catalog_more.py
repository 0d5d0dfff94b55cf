"""More of the query catalogue: round trips through sinks and sources, keys of titles and URLs, lookups, the fetch stage. The files that a query reads are
written by it first, from the synthetic tables, into the shared folder."""

from __future__ import annotations

import io
import tarfile

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from tandem.functions import measures as M
from tandem.functions import urls as U
from tandem.operators import citations as C
from tandem.operators import cohorts as H
from tandem.operators import reconcile as R
from tandem.operators import stats as S
from tandem.operators import vectors as V
from tandem.plans.catalog import _CITES, _LINES, _PAGES, _STATUS_SHIFT, _TOPICS, _URLS, _articles, _composition_sql, _query, _r, _rounded, _t, _urls, _values, cites, page_refs, pageview_text, statuses
from tandem.sources import fetch, readers
from tandem.session import scratch, written

# -- sources and sinks


@_query("SELECT p_brand AS source, (p_size / 50.0)::DOUBLE AS pc1, p_name AS note FROM part")
def q_csv_scan(spark, sf):
    path = scratch(spark, "csv")
    readers.write_csv(_t(spark, sf, "part").select(F.col("p_brand").alias("source"), (F.col("p_size") / 50.0).alias("pc1"), F.col("p_name").alias("note")), path)
    return readers.csv_table(spark, path, "source string, pc1 double, note string")


@_query("SELECT o_orderkey AS k, o_orderpriority AS p, (o_orderkey % 5)::INT AS shard FROM orders WHERE o_orderkey % 7 <> 0")
def q_ndjson_shards(spark, sf):
    path = scratch(spark, "ndjson")
    k = F.col("o_orderkey")
    rows = _t(spark, sf, "orders").select(k.alias("k"), F.col("o_orderpriority").alias("p"), (k % 5).alias("shard"))
    readers.write_shards(rows.where("k % 7 <> 0"), path)
    readers.write_lines(rows.where("k % 7 = 0").select(F.concat(F.lit('{"k": '), "k", F.lit(', "p": broken')).alias("line")), "line", f"{path}/bad")
    return readers.ndjson(spark, [f"{path}/shard={i}" for i in range(5)] + [f"{path}/bad"], "k bigint, p string").select("k", "p", (F.col("k") % 5).cast("int").alias("shard"))


@_query("SELECT 'https://example.org/page/Person_' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '?x=1' ELSE '#%41' END AS title, 'Person_' || c_custkey AS slug FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'Φ Person(' || c_custkey || ')', 'Phi_Person_(' || c_custkey || ')' FROM customer WHERE c_custkey % 2 = 1")
def q_slug_list(spark, sf):
    path, k = scratch(spark, "slugs"), F.col("c_custkey")
    url = F.concat(F.lit("https://example.org/page/Person_"), k, F.when(k % 3 == 0, "?x=1").otherwise("#%41"))
    readers.write_lines(_t(spark, sf, "customer").select(F.when(k % 2 == 0, url).otherwise(F.concat(F.lit("Φ Person("), k, F.lit(")"))).alias("t")), "t", path)
    return readers.slugs(spark, path)


_UNIVERSE = "u AS (SELECT c_custkey::VARCHAR AS title FROM customer)"


@_query(f"WITH {_CITES}, {_UNIVERSE}, a AS (SELECT title, domain, cnt FROM cites WHERE corpus = 'A') SELECT title, domain, coalesce(cnt, 0)::BIGINT AS cnt FROM u LEFT JOIN a USING (title)")
def q_domain_map(spark, sf):
    path = scratch(spark, "domain-map")
    readers.write_domain_map(cites(spark, sf).where("corpus = 'A'"), path, _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("title")))
    return readers.domain_map(spark, path)


@_query(f"WITH {_PAGES}, u AS (SELECT DISTINCT (c_custkey % 60)::VARCHAR AS title FROM customer), r AS (SELECT title, count(*) AS refs, count(DISTINCT domain) AS domains FROM page_refs WHERE corpus = 'A' AND domain <> '' GROUP BY title) SELECT title, coalesce(refs, 0)::BIGINT AS refs, coalesce(domains, 0)::BIGINT AS domains FROM u LEFT JOIN r USING (title)")
def q_reference_counts(spark, sf):
    return C.reference_counts(page_refs(spark, sf).where("corpus = 'A'"), _t(spark, sf, "customer").select((F.col("c_custkey") % 60).cast("string").alias("title")))


_TALKS = "t AS (SELECT conv_id::VARCHAR AS slug, turn, role, text FROM conversations)"


@_query(f"WITH {_TALKS} SELECT slug, CASE WHEN conv_slug % 3 = 0 THEN NULL ELSE role END AS criticality, CASE WHEN conv_slug % 3 = 0 THEN NULL ELSE text END AS \"issueType\", CASE WHEN conv_slug % 3 = 0 THEN 0 ELSE n END::BIGINT AS \"fixedIssuesCount\", 'now' AS fetched_at FROM (SELECT *, slug::BIGINT AS conv_slug, count(*) OVER (PARTITION BY slug) AS n, row_number() OVER (PARTITION BY slug ORDER BY turn) AS pos FROM t) WHERE conv_slug % 3 <> 0 OR pos = 1")
def q_issue_columns(spark, sf):
    path = scratch(spark, "issues")
    issues = F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("criticality"), F.col("text").alias("issueType"))))
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(issues.alias("x")).withColumn("x", F.when(F.col("conv_id") % 3 == 0, F.slice("x", 1, 0)).otherwise(F.col("x")))
    rows = rows.select(F.col("conv_id").cast("string").alias("slug"), F.transform("x", lambda i: F.struct(i["criticality"].alias("criticality"), i["issueType"].alias("issueType"))).alias("fixedIssues"), F.size("x").alias("fixedIssuesCount"), F.lit("now").alias("fetched_at"))
    rows.write.json(path)
    return readers.fixed_issues(spark, path)


_BODY = "CASE WHEN coalesce(text, '') = '' THEN '' ELSE chr(10) || chr(10) || text END, chr(10) || chr(10) ORDER BY turn)"


@_query(f"WITH {_TALKS} SELECT 'a' || slug AS title, trim(string_agg(CASE WHEN turn = 1 THEN '# Abstract' ELSE '## ' || role END || {_BODY}) AS text FROM t GROUP BY slug")
def q_articles_a(spark, sf):
    path = scratch(spark, "articles-a")
    part = F.struct(F.when(F.col("turn") % 2 == 0, F.col("text")).alias("value"), F.when(F.col("turn") % 2 == 1, F.col("text")).alias("text"))
    section = F.struct("turn", F.struct(F.when(F.col("turn") == 1, "Abstract").otherwise(F.col("role")).alias("name"), F.array(part).alias("has_parts")).alias("s"))
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(section)).alias("x"))
    rows.select(F.concat(F.lit("a"), "conv_id").alias("name"), F.col("x.s").alias("sections")).write.json(path)
    return readers.articles_a(spark, path)


@_query(f"WITH {_TALKS} SELECT 'b' || slug AS title, trim(string_agg(CASE WHEN turn = 1 THEN '# ' WHEN turn = 2 THEN '### ' ELSE '## ' END || role || {_BODY}) AS text FROM t GROUP BY slug")
def q_articles_b(spark, sf):
    path, turn = scratch(spark, "articles-b"), F.col("turn")
    section = F.struct("turn", F.struct(F.when(turn == 1, "h1").when(turn == 2, "h3").otherwise("h2").alias("level"), F.col("role").alias("title"), F.array(F.struct(F.lit("paragraph").alias("type"), "text")).alias("content")).alias("s"))
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(section)).alias("x"))
    rows.select(F.concat(F.lit("b"), "conv_id").alias("title"), F.struct(F.col("x.s").alias("sections")).alias("data")).write.json(path)
    return readers.articles_b(spark, path)


@_query("SELECT lower(n_name) || '.com' AS domain, n_name AS source_name, 'N' || n_nationkey AS source_id, CASE n_nationkey % 3 WHEN 0 THEN 'generally_reliable' WHEN 1 THEN 'deprecated' ELSE 'blacklisted' END AS reliability_status, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 2000 + n_nationkey END::INT AS last_updated FROM nation UNION ALL SELECT 'news.' || lower(n_name) || '.org', n_name, 'N' || n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'generally_reliable' WHEN 1 THEN 'deprecated' ELSE 'blacklisted' END, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 2000 + n_nationkey END FROM nation")
def q_wikitext_table(spark, sf):
    path, k, name = scratch(spark, "wikitext"), F.col("n_nationkey"), F.col("n_name")
    code = F.when(k % 3 == 0, "gr").when(k % 3 == 1, "d").otherwise("b")
    last = F.when(k % 4 == 0, "none").otherwise(F.concat(F.lit("{{WP:RSPLAST|"), 2000 + k, F.lit("}}")))
    cell = lambda *x: F.concat(F.lit("| "), *x)
    row = F.concat_ws("\n", F.concat(F.lit('|- class="s-'), code, F.lit('" id="N'), k, F.lit('"')), cell(F.lit("[["), name, F.lit("|shown]] {{x}}")), cell(F.lit("{{WP:RSPSTATUS|"), code, F.lit("}}")), cell(F.lit("list")), cell(last), cell(F.lit("text")), F.lit("|and more"), cell(F.lit("{{WP:RSPUSES|"), F.lower(name), F.lit(".com|https://www.news."), F.lower(name), F.lit(".org/path}}")))
    readers.write_lines(_t(spark, sf, "nation").coalesce(1).select(row.alias("row")), "row", path)
    return readers.reliability_table(spark, path)


@_query(f"WITH l AS ({_LINES}), p AS (SELECT string_split(value, ' ') AS p FROM l), v AS (SELECT lower(replace(p[2], '_', ' ')) AS title, try_cast(CASE WHEN p[4] = 'desktop' THEN p[5] ELSE p[4] END AS BIGINT) AS views FROM p WHERE p[1] = 'en.wikipedia' AND p[2] <> '-') SELECT title, sum(views)::BIGINT AS views FROM v WHERE views IS NOT NULL GROUP BY title")
def q_pageview_file(spark, sf):
    path = scratch(spark, "pageviews")
    pageview_text(spark, sf).write.option("compression", "bzip2").text(path)
    return H.pageview_lines(readers.pageviews(spark, path)).groupBy("title").agg(F.sum("views").alias("views"))


@_query("SELECT 'ISO' || n_nationkey AS iso, n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def q_geojson(spark, sf):
    path = scratch(spark, "geojson")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.concat(F.lit("ISO"), "n_nationkey").alias("iso"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.5), F.lit(2.5)).alias("coordinates")).alias("geometry"))
    whole = _t(spark, sf, "nation").agg(F.collect_list(feature).alias("features"))
    readers.write_lines(whole.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("json")), "json", path)
    return readers.geojson_attributes(spark, path, "iso string, name string, region bigint")


@_query("SELECT p_name AS name, p_brand AS venue FROM part")
def q_paged_json(spark, sf):
    path = scratch(spark, "paged")
    page = _t(spark, sf, "part").groupBy((F.col("p_partkey") % 8).alias("page")).agg(F.collect_list(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("venue"))).alias("results"))
    page = page.select("page", F.struct(F.concat(F.lit("c"), "page").alias("next_cursor")).alias("meta"), "results")
    page.repartition("page").write.partitionBy("page").json(path)  # a file per page
    return readers.paged_json(spark, f"{path}/*", "results", "name string, venue string")


@_query("SELECT 'T' || (o_custkey % 700) AS title, 'u' || (o_custkey % 700) AS url FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL")
def q_discovered(spark, sf):
    path, k, t = scratch(spark, "discovered"), F.col("o_orderkey"), F.col("o_custkey") % 700
    rows = _t(spark, sf, "orders").select(F.concat(F.lit("T"), t).alias("title"), F.concat(F.lit("u"), t).alias("url"), U.http_status(F.when(k % 3 == 0, 200).when(k % 3 == 1, 404).otherwise(429)).alias("status"))
    rows.write.json(path)
    return readers.discovered(spark, path)


@_query("SELECT DISTINCT 'https://h.org/p/a b(' || (o_custkey % 90) || ')%2Fé' AS url, 'https://h.org/p/a%20b(' || (o_custkey % 90) || ')%252f%C3%A9' AS retry FROM orders")
def q_retry_urls(spark, sf):
    path = scratch(spark, "failed")
    url = F.concat(F.lit("https://h.org/p/a b("), F.col("o_custkey") % 90, F.lit(")%2Fé"))
    _t(spark, sf, "orders").select(url.alias("url"), F.lit("error_503").alias("error")).write.json(path)
    return readers.retry_urls(spark, path)


@_query("SELECT o_custkey AS k, max(o_orderkey)::BIGINT AS v FROM orders GROUP BY 1")
def q_rewrite(spark, sf):
    path = scratch(spark, "rewrite")
    _t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")).write.json(path)
    schema = "k bigint, v bigint"
    readers.rewrite_ndjson(R.dedup_last(readers.ndjson(spark, path, schema).select("k", "v"), "k", "v"), path)
    return readers.ndjson(spark, path, schema).select("k", "v")


@_query("SELECT (p_partkey % 4)::BIGINT AS shard, count(*)::BIGINT AS files FROM part WHERE p_partkey BETWEEN 1 AND 4 GROUP BY 1")
def q_files(spark, sf):
    """Listing, and copying between folders: four files of one row each."""
    path = scratch(spark, "files")
    four = spark.range(1, 5).select(F.col("id"), (F.col("id") % 4).alias("shard"))
    four.repartition("shard").write.partitionBy("shard").json(f"{path}/a")
    readers.copy_file(spark, f"{path}/a", f"{path}/b")
    at = readers.files(spark, f"{path}/b", ".json").where("size > 0")
    return at.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard")).groupBy("shard").agg(F.count("*").alias("files"))


def _files(rows, path: str, name: str, content) -> None:
    """A file per partition of rows: content makes its bytes of the partition's batches. A retried task writes the same file again."""

    def run(batches):
        system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        part = list(batches)
        if part:
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/{TaskContext.get().partitionId()}{name}", compression=None) as f:
                f.write(content(part))
        yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in part)], pa.int64())], names=["n"])

    written(rows.mapInArrow(run, "n long"), "files")


def _archive(batches: list[pa.RecordBatch]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, lines in (("a.ndjson", [x for b in batches for x in b.column(0).to_pylist()]), ("b.txt", ["not read"])):
            data = "\n".join(lines).encode() + b"\n\n"
            member = tarfile.TarInfo(name)
            member.size = len(data)
            tar.addfile(member, io.BytesIO(data))
    return out.getvalue()


@_query("SELECT 'Person ' || c_custkey AS title, c_acctbal AS balance FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)")
def q_tar_titles(spark, sf):
    path, title = scratch(spark, "tar"), F.concat(F.lit("Person "), "c_custkey")
    _files(_t(spark, sf, "customer").repartition(3, "c_custkey").select(F.to_json(F.struct(title.alias("name"), "c_acctbal")).alias("line")), path, ".tar.gz", _archive)
    wanted = _t(spark, sf, "orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("Person "), "o_custkey").alias("title"))
    return readers.extract_titles(spark, path, wanted).select("title", F.get_json_object("value", "$.c_acctbal").cast("double").alias("balance"))


def _matrix(batches: list[pa.RecordBatch]) -> bytes:
    out = io.BytesIO()
    np.save(out, np.concatenate([b.column(0).flatten().to_numpy().reshape(b.num_rows, -1) for b in batches]).astype(np.float32))
    return out.getvalue()


@_query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS emb_ix, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, len(embedding)::INT AS size FROM embeddings")
def q_npy(spark, sf):
    path = scratch(spark, "npy")
    _files(_t(spark, sf, "embeddings").coalesce(1).sortWithinPartitions("vec_id").select("embedding"), path, ".npy", _matrix)
    return V.from_npy(spark, path, 300).select("emb_ix", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.size("embedding").alias("size"))


@_query("SELECT 'P' || c_custkey AS title, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'C' END AS quality_class, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS quality, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a|b' ELSE 'b|a' END AS topics, c_custkey % 5 = 0 AS failed FROM customer")
def q_article_metadata(spark, sf):
    path, k = scratch(spark, "metadata"), F.col("c_custkey")
    topic = lambda name, score: F.struct(F.lit(name).alias("topic"), score.cast("double").alias("score"))
    results = F.struct(F.array(topic("a", F.lit(0.5)), topic("b", F.when(k % 4 == 1, 0.25).otherwise(0.75))).alias("results"))
    rows = _t(spark, sf, "customer").select(
        F.concat(F.lit("P"), k).alias("title"), F.when(k % 3 != 0, F.struct(F.lit("C").alias("class"), F.col("c_acctbal").alias("quality"))).alias("quality_data"),
        F.when(k % 4 != 0, F.struct(results.alias("prediction"))).alias("topic_data"), F.when(k % 5 == 0, F.array(F.lit("timeout"))).alias("errors"),
    )
    rows.write.json(path)
    return readers.article_metadata(spark, path).withColumn("topics", F.array_join("topics", "|"))


def _fake(key: str) -> tuple[int, str | None]:
    """Every third key exists, every third is unknown, every third raises."""
    n = int(key[1:]) % 3
    if n == 2:
        raise TimeoutError(key)
    return (200, f"page {key}") if n == 0 else (404, None)


@_query("SELECT 's' || c_custkey AS slug, CASE c_custkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 0 END::INT AS status_code, CASE c_custkey % 3 WHEN 0 THEN 'page s' || c_custkey WHEN 2 THEN 'TimeoutError: s' || c_custkey END AS body, CASE c_custkey % 3 WHEN 2 THEN 2 ELSE 1 END::INT AS attempts FROM customer")
def q_fetch(spark, sf):
    slugs = _t(spark, sf, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("slug"))
    return fetch.fetched(slugs, "slug", _fake, attempts=2, pause=lambda failed, total: 0.0)


# -- keys and links


@_query(f"SELECT url, lower(nullif(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1), '')) AS domain, CASE regexp_extract(url, '//([^/]*)', 1) WHEN 'twitter.com' THEN 'x/twitter.com' WHEN 'x.com' THEN 'x/twitter.com' ELSE regexp_extract(url, '//([^/]*)', 1) END AS combined, string_split(trim(url), '/')[-1] AS last, CASE WHEN length(l) > 20 THEN l[1:17] || '...' ELSE l END AS label FROM (SELECT url, replace(replace(replace(regexp_extract(url, '//([^/]*)', 1), '.com', ''), '.co.uk', ''), '.org', '') AS l FROM (SELECT url FROM (VALUES {_URLS}) u(title, url) UNION ALL SELECT url FROM pages UNION ALL SELECT 'https://a-very-long-name.of-some.host.example.com/x'))")
def q_url_parts(spark, sf):
    urls = _urls(spark).select("url").unionByName(_t(spark, sf, "pages").select("url")).unionByName(_values(spark, "('https://a-very-long-name.of-some.host.example.com/x')", "url"))
    domain = U.netloc(F.col("url"))
    return urls.select("url", U.extract_domain(F.col("url")).alias("domain"), U.combine_domains(domain).alias("combined"), U.last_segment(F.col("url")).alias("last"), U.chart_label(domain).alias("label"))


@_query("WITH t AS (SELECT '  ' || replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '  ' ELSE ' ' END) || ' X_' || p_partkey AS title FROM part) SELECT title, replace(title, ' ', '_') AS simple, replace(title, ' ', '_') AS underscore, trim(lower(replace(title, '_', ' '))) AS lower_space, lower(replace(title, ' ', '_')) AS lower_underscore, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS norm, replace(replace(title, '%', ''), '_', ' ') AS page FROM t")
def q_title_keys(spark, sf):
    k = F.col("p_partkey")
    t = _t(spark, sf, "part").select(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.when(k % 3 == 0, "_").when(k % 3 == 1, "  ").otherwise(" ")), F.lit(" X_"), k).alias("title"))
    c = F.col("title")
    page = U.page_title(F.concat(F.lit("https://h.org/page/"), F.replace(c, F.lit(" "), F.lit("%20"))))
    return t.select("title", U.slug_simple(c).alias("simple"), U.key_underscore(c).alias("underscore"), U.key_lower_space(c).alias("lower_space"), U.key_lower_underscore(c).alias("lower_underscore"), U.norm_space(c).alias("norm"), page.alias("page"))


@_query(f"WITH {_PAGES} SELECT DISTINCT title FROM page_refs WHERE contains(domain, 'blog') OR contains(domain, '.org')")
def q_relevant(spark, sf):
    return C.relevant(C.cites_from_references(page_refs(spark, sf)), ["blog", ".org"])


_LINKS = "links AS (SELECT 'T' || (c_custkey % 40) AS title, 'https://x.com/i/' || CASE c_custkey % 3 WHEN 0 THEN 'grok/share/' WHEN 1 THEN 'communitynotes/share/' ELSE 'status/' END || CASE WHEN c_custkey % 2 = 0 THEN 'a/' ELSE '' END || (c_custkey % 7) AS url FROM customer)"


@_query(f"WITH {_LINKS} SELECT title, min(url) AS url FROM links WHERE contains(url, 'i/grok/share') GROUP BY title, string_split(url, '/')[-1]")
def q_share_links(spark, sf):
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://x.com/i/"), F.when(k % 3 == 0, "grok/share/").when(k % 3 == 1, "communitynotes/share/").otherwise("status/"), F.when(k % 2 == 0, "a/").otherwise(""), k % 7)
    return C.links_with(_t(spark, sf, "customer").select(F.concat(F.lit("T"), k % 40).alias("title"), url.alias("url")), "i/grok/share")


_JOURNALS = "j AS (SELECT DISTINCT lower(trim(p_brand)) AS domain FROM part WHERE p_size > 48 UNION SELECT unnest([" + ", ".join(f"'{d}'" for d in U.JOURNALS) + "]))"


@_query(f"WITH {_CITES}, {_JOURNALS}, x AS (SELECT corpus, title, CASE WHEN domain = 'Brand#3' THEN 'arxiv.org' ELSE lower(domain) END AS domain, cnt FROM cites) SELECT corpus, title, domain, cnt FROM x WHERE domain IN (SELECT domain FROM j)")
def q_journals(spark, sf):
    rows = cites(spark, sf).withColumn("domain", F.when(F.col("domain") == "Brand#3", "arxiv.org").otherwise(F.lower("domain")))
    return C.journals(rows, _t(spark, sf, "part").where("p_size > 48").select(F.concat(F.lit(" "), "p_brand").alias("Domain"))).select("corpus", "title", "domain", "cnt")


# -- lookups, outer joins, extents


_WANTED = "w AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Person_' || o_custkey WHEN 1 THEN 'person ' || o_custkey ELSE 'nobody' END AS title FROM orders), i AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Person_' || c_custkey ELSE 'person ' || c_custkey END AS title, c_acctbal AS balance FROM customer)"


@_query(f"WITH {_WANTED} SELECT w.o_orderkey, w.title, coalesce(a.balance, b.balance) AS balance FROM w LEFT JOIN i a ON w.title = a.title LEFT JOIN i b ON lower(replace(w.title, '_', ' ')) = b.title")
def q_lookup(spark, sf):
    k, c = F.col("o_orderkey") % 3, F.col("c_custkey")
    wanted = _t(spark, sf, "orders").select("o_orderkey", F.when(k == 0, F.concat(F.lit("Person_"), "o_custkey")).when(k == 1, F.concat(F.lit("person "), "o_custkey")).otherwise("nobody").alias("title"))
    index = _t(spark, sf, "customer").select(F.concat(F.when(c % 2 == 0, "Person_").otherwise("person "), c).alias("title"), F.col("c_acctbal").alias("balance"))
    return R.lookup(wanted, index)


@_query("SELECT n_nationkey, n_name AS name_a, r_regionkey, r_name AS name_b FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 2) FULL JOIN region ON n_nationkey = r_regionkey")
def q_outer_by(spark, sf):
    a = _t(spark, sf, "nation").where("n_nationkey > 2").select("n_nationkey", F.col("n_name").alias("name"))
    return R.outer_by(a, _t(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("name")), "n_nationkey", "r_regionkey")


@_query("SELECT c_mktsegment, min(c_acctbal) AS min, max(c_acctbal) AS max, round(quantile_cont(c_acctbal, 0.5), 6) AS median, count(DISTINCT c_acctbal)::BIGINT AS nunique, round(avg((c_acctbal > 0)::INT), 6) AS positive FROM customer GROUP BY 1")
def q_extent(spark, sf):
    return _rounded(S.extent(_t(spark, sf, "customer"), "c_acctbal", "c_mktsegment"))


@_query("SELECT 's' || c_custkey AS url, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'T' || c_custkey END, ''), CASE WHEN c_custkey % 2 = 0 THEN 'D' || c_custkey END, '(no_title_' || c_custkey || ')') AS title FROM customer")
def q_coalesced(spark, sf):
    k = F.col("c_custkey")
    url = F.concat(F.lit("s"), k)
    data = F.struct(url.alias("url"), F.when(k % 2 == 0, F.concat(F.lit("D"), k)).alias("title"))
    rows = _t(spark, sf, "customer").select(F.when(k % 5 != 0, url).alias("url"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("T"), k)).alias("title"), data.alias("data"), k.alias("at"))
    return R.coalesced(rows, F.col("at"))


@_query("SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) // 400)::INT AS shard FROM customer")
def q_shard_fixed(spark, sf):
    return R.shard_fixed(R.ordinal(_t(spark, sf, "customer").select("c_custkey"), "c_custkey"), F.col("index"), 400).select("c_custkey", "shard")


@_query("SELECT 'Φ Person(' || c_custkey || ')' AS slug, 'Phi_Person_(' || c_custkey || ')' AS variant FROM customer WHERE c_custkey % 3 <> 0")
def q_probe_slugs(spark, sf):
    k = F.col("c_custkey")
    rows = _t(spark, sf, "customer")
    known = rows.where(k % 3 != 0).select(F.concat(F.lit("Phi_Person_("), k, F.lit(")")).alias("slug"))
    return R.probe_slugs(rows.select(F.concat(F.lit("Φ Person("), k, F.lit(")")).alias("slug")), known)


@_query("SELECT n_name AS label, CASE WHEN r_name = 'AMERICA' THEN NULL WHEN r_name = 'MIDDLE EAST' THEN NULL WHEN r_name = 'ASIA' THEN 'Asia' WHEN r_name = 'EUROPE' THEN 'Europe' WHEN r_name = 'AFRICA' THEN 'Africa' END AS continent, CASE n_nationkey % 3 WHEN 0 THEN 'Democratic Party' WHEN 1 THEN 'Republican Party' ELSE 'Other' END AS party, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END::INT AS edits FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_continent_party(spark, sf):
    n, r = _t(spark, sf, "nation"), _t(spark, sf, "region")
    rows, k = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_nationkey")
    topic = F.concat(F.lit("Geography.Regions."), F.col("r_name"), F.lit("."), F.col("n_name"))
    party = F.when(k % 3 == 0, "Democratic Party").when(k % 3 == 1, "Republican Party").otherwise("Green")
    button = F.when(k % 2 == 0, F.concat(F.lit("Edits ("), k, F.lit(")"))).otherwise("Edits")
    return rows.select(F.col("n_name").alias("label"), M.continent(topic).alias("continent"), M.us_party(party).alias("party"), M.edit_count(button).alias("edits"))


@_query(f"WITH {_CITES} SELECT domain, round(sum(cnt) FILTER (corpus = 'B') / sum(cnt)::DOUBLE, 6) AS b_part FROM cites GROUP BY domain")
def q_b_part(spark, sf):
    totals = C.domain_totals(cites(spark, sf))
    return totals.select("domain", _r(M.proportion(F.col("b_count"), F.col("a_count") + F.col("b_count")), "b_part"))


@_query(f"WITH {_CITES}, s AS (SELECT DISTINCT replace(p_brand, 'Brand', '') AS site FROM part WHERE p_size > 48) SELECT title, site, sum(cnt)::BIGINT AS citations FROM cites JOIN s ON contains(domain, site) GROUP BY ALL")
def q_sublist_table(spark, sf):
    sites = _t(spark, sf, "part").where("p_size > 48").select(F.replace("p_brand", F.lit("Brand"), F.lit("")).alias("site"))
    return C.sublist_of(cites(spark, sf), sites, exact=False)


@_query(f"WITH {_STATUS_SHIFT}, long AS ({_composition_sql(C.CLASSES)}) SELECT corpus, " + ", ".join(f"sum(cites) FILTER (label = '{x}')::BIGINT AS {x}" for x in C.CLASSES) + " FROM long GROUP BY corpus")
def q_composition_wide(spark, sf):
    return C.composition_wide(C.composition(C.status_shift(cites(spark, sf), statuses(spark, sf))))


def _region_sql(group: str, part: int) -> str:
    rows = f"SELECT DISTINCT title, nullif(split_part(topic, '.', {part}), '') AS {group} FROM topics WHERE contains(topic, 'Region')"
    return f"WITH {_STATUS_SHIFT.replace('shift AS', 'base AS')}, {_TOPICS}, shift AS (SELECT base.*, {group} FROM base JOIN ({rows}) USING (title) WHERE {group} IS NOT NULL) {_composition_sql(C.CLASSES, group)}"


@_query(_region_sql("continent", 3))
def q_continent_composition(spark, sf):
    return _rounded(C.composition(H.by_topic(C.status_shift(cites(spark, sf), statuses(spark, sf)), H.topics(_articles(spark, sf)), "continent"), by=["continent"]))


@_query(_region_sql("subcontinent", 4))
def q_subcontinent_composition(spark, sf):
    return _rounded(C.composition(H.by_topic(C.status_shift(cites(spark, sf), statuses(spark, sf)), H.topics(_articles(spark, sf)), "subcontinent"), by=["subcontinent"]))


@_query("WITH t AS (SELECT doc_id::VARCHAR AS title, 'x' AS source, string_split(text, chr(10)) AS w FROM documents), n AS (SELECT *, len(w) AS n FROM t), k AS (SELECT *, unnest(range(least(greatest(ceil((n - 3) / 2.0), 0) + 1, ceil(n / 2.0))::BIGINT)) AS chunk_id FROM n) SELECT title, source, chunk_id::INT AS chunk_id, array_to_string(w[chunk_id * 2 + 1 : chunk_id * 2 + 3], ' ') AS text FROM k")
def q_chunks_of_lines(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("title"), F.lit("x").alias("source"), "text")
    return V.chunks(docs, 3, 2, F.split("text", "\n"))
