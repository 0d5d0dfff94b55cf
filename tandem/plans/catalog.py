"""The query catalogue: every operator bound to the synthetic tables, with the SQL that gives the same rows.

Corpus A and B are lineitem by l_linestatus; a title is the order's customer, a domain the part's brand. Floating-point results are rounded to six
places on both sides, as engines add in different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import measures as M
from tandem.functions import urls as U
from tandem.operators import citations as C
from tandem.operators import cohorts as H
from tandem.operators import reconcile as R
from tandem.operators import stats as S
from tandem.operators import structure as T
from tandem.operators import vectors as V
from tandem.sources import article_html
from tandem.streaming import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tandem.plans import catalog_more  # noqa: F401  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tandem.plans import catalog_more  # noqa: F401  adds its own

    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_r(c, c) if k == "double" else F.col(c) for c, k in df.dtypes])


# -- proxies

_CITES = "cites AS (SELECT CASE l_linestatus WHEN 'F' THEN 'A' ELSE 'B' END AS corpus, o_custkey::VARCHAR AS title, p_brand AS domain, count(*)::BIGINT AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
_BRAND = "brand AS (SELECT DISTINCT p_brand AS domain, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS n FROM part)"
_STATUS = _BRAND + ", dim AS (SELECT domain, CASE n % 7 WHEN 1 THEN 'Generally reliable' WHEN 2 THEN 'Generally unreliable' WHEN 3 THEN 'Deprecated' WHEN 4 THEN 'No consensus' WHEN 5 THEN 'Blacklisted' ELSE 'other' END AS status FROM brand WHERE n % 7 <> 0)"
_SCORE = _BRAND + ", dim AS (SELECT domain, n / 25.0::DOUBLE AS pc1 FROM brand WHERE n <> 7)"
_NAME = "CASE status WHEN 'Generally reliable' THEN 'reliable' WHEN 'Generally unreliable' THEN 'unreliable' WHEN 'Blacklisted' THEN 'blacklist' WHEN 'No consensus' THEN 'no_consensus' WHEN 'Deprecated' THEN 'deprecated' ELSE 'other' END"
_BUCKET = "CASE WHEN pc1 >= 0 AND pc1 < 0.2 THEN 0 WHEN pc1 >= 0.2 AND pc1 < 0.4 THEN 1 WHEN pc1 >= 0.4 AND pc1 < 0.6000000000000001::DOUBLE THEN 2 WHEN pc1 >= 0.6000000000000001::DOUBLE AND pc1 < 0.8 THEN 3 WHEN pc1 >= 0.8 AND pc1 <= 1.0 THEN 4 END"


def cites(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus")
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    part = _t(spark, sf, "part").select("p_partkey", "p_brand")
    rows = line.join(part, line["l_partkey"] == part["p_partkey"]).join(orders, line["l_orderkey"] == orders["o_orderkey"])
    corpus = F.when(F.col("l_linestatus") == "F", "A").otherwise("B")
    return rows.groupBy(corpus.alias("corpus"), F.col("o_custkey").cast("string").alias("title"), F.col("p_brand").alias("domain")).agg(F.count("*").alias("cnt"))


def _brands(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_brand").alias("domain")).distinct().withColumn("n", F.regexp_extract("domain", r"(\d+)", 1).cast("int"))


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n") % 7
    name = F.when(n == 1, "Generally reliable").when(n == 2, "Generally unreliable").when(n == 3, "Deprecated").when(n == 4, "No consensus").when(n == 5, "Blacklisted").otherwise("other")
    return _brands(spark, sf).where(n != 0).select("domain", name.alias("status"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return _brands(spark, sf).where("n <> 7").select("domain", (F.col("n") / 25.0).alias("pc1"))


_PAGES = r"page_refs AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'A' ELSE 'B' END AS corpus, (page_id % 50)::VARCHAR AS title, lower(regexp_replace(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '^www\.', ''), '^(m|amp|en|web|mobile)\.', '')) AS domain FROM pages)"


def page_refs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select(F.when(F.col("page_id") % 2 == 0, "A").otherwise("B").alias("corpus"), (F.col("page_id") % 50).cast("string").alias("title"), "url")


_URLS = """
('t1', 'https://twitter.com/alice/status/1'), ('t1', 'https://x.com/bob'), ('t1', 'https://x.com/i/grok/share/0123456789abcdef'), ('t2', 'https://www.youtube.com/user/carol'),
('t2', 'https://www.youtube.com/channel/UCabcdefghijklmnopqrstuv'), ('t2', 'https://www.youtube.com/watch?v=abc'), ('t3', 'https://www.reddit.com/user/dave-1/'), ('t3', 'https://www.instagram.com/erin/'),
('t3', 'https://www.instagram.com/p/xyz/'), ('t3', 'https://www.instagram.com/reel/'), ('t4', 'https://www.tiktok.com/@frank?lang=en'), ('t4', 'https://truthsocial.com/@grace'), ('t4', 'https://bsky.app/profile/heidi.bsky.social'),
('t5', 'https://chatgpt.com/share/0123456789-abcdef'), ('t5', 'https://claude.ai/share/abcdef0123456789'), ('t5', 'https://x.com/grok'), ('t5', 'https://twitter.com/Grok/status/9'), ('t6', 'https://example.com/a'),
('t6', 'https://youtu.be/abcdef1'), ('t6', 'https://www.pinterest.com/ivan/'), ('t6', 'https://twitter.com/search?q=x'), ('t1', 'https://x.com/bob/status/2'), ('t6', 'https://www.perplexity.ai/search/aaaaaaaaaa-1'), ('t2', 'https://www.facebook.com/judy.smith/posts/1'), ('t2', 'https://facebook.com/groups/abc'), ('t2', 'https://facebook.com/1234567'), ('t3', 'https://www.facebook.com/story.php?id=1'), ('t3', 'https://facebook.com/pages'), ('t4', 'https://facebook.com/abcd')
"""


def _values(spark: SparkSession, values: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def _urls(spark: SparkSession) -> DataFrame:
    return _values(spark, _URLS, "title, url")


# -- citations


@_query(f"WITH {_PAGES} SELECT corpus, title, domain, count(*)::BIGINT AS cnt FROM page_refs WHERE domain <> '' GROUP BY ALL")
def q_domain_counts(spark, sf):
    return C.cites_from_references(page_refs(spark, sf))


_TOTALS = "d AS (SELECT domain, coalesce(sum(cnt) FILTER (corpus = 'A'), 0)::BIGINT AS a_count, coalesce(sum(cnt) FILTER (corpus = 'B'), 0)::BIGINT AS b_count FROM {src} GROUP BY domain), g AS (SELECT *, (sum(a_count) OVER ())::BIGINT AS a_total, (sum(b_count) OVER ())::BIGINT AS b_total FROM d), totals AS (SELECT domain, a_count, a_total, round(coalesce(a_count / nullif(a_total, 0)::DOUBLE, 0), 6) AS a_share, b_count, b_total, round(coalesce(b_count / nullif(b_total, 0)::DOUBLE, 0), 6) AS b_share, b_count - a_count AS count_diff, round(coalesce(b_count / nullif(b_total, 0)::DOUBLE, 0) - coalesce(a_count / nullif(a_total, 0)::DOUBLE, 0), 6) AS share_diff, domain AS combined_domain FROM g)"


@_query(f"WITH {_CITES}, {_TOTALS.format(src='cites')} SELECT * FROM totals")
def q_domain_share(spark, sf):
    return _rounded(C.domain_totals(cites(spark, sf)))


@_query(f"WITH {_CITES}, {_TOTALS.format(src='cites')} SELECT combined_domain, a_count, b_count FROM totals ORDER BY a_count + b_count DESC, combined_domain LIMIT 10")
def q_domain_topk(spark, sf):
    return C.combined_top(C.domain_totals(cites(spark, sf)), 10)


@_query(f"WITH {_CITES}, {_TOTALS.format(src='cites')} SELECT combined_domain, a_count, b_count FROM totals ORDER BY a_count + b_count DESC, combined_domain LIMIT 4 OFFSET 10")
def q_domain_offset(spark, sf):
    return C.combined_top(C.domain_totals(cites(spark, sf)), 4, 10)


_DELTA = "common AS (SELECT title FROM {src} GROUP BY title HAVING bool_or(corpus = 'A') AND bool_or(corpus = 'B')), p AS (SELECT title, domain, sum(CASE corpus WHEN 'B' THEN cnt ELSE -cnt END) AS delta FROM {src} WHERE title IN (SELECT title FROM common) GROUP BY ALL), delta AS (SELECT domain, sum(delta)::BIGINT AS delta_sum, (count(*) FILTER (delta > 0))::BIGINT AS added_pages, (count(*) FILTER (delta < 0))::BIGINT AS removed_pages, (SELECT count(*) FROM common)::BIGINT AS total_titles_compared FROM p GROUP BY domain)"
_DELTA_OUT = "SELECT *, round(added_pages / total_titles_compared::DOUBLE, 6) AS added_prop, round(removed_pages / total_titles_compared::DOUBLE, 6) AS removed_prop FROM delta"


@_query(f"WITH {_CITES}, {_DELTA.format(src='cites')} {_DELTA_OUT}")
def q_domain_delta(spark, sf):
    return _rounded(C.domain_delta(cites(spark, sf)))


_SPARSE = "sparse AS (SELECT CASE l_linestatus WHEN 'F' THEN 'A' ELSE 'B' END AS corpus, l_orderkey AS title, l_suppkey AS domain, count(*)::BIGINT AS cnt FROM lineitem GROUP BY ALL)"


@_query(f"WITH {_SPARSE}, {_DELTA.format(src='sparse')} {_DELTA_OUT}")
def q_domain_delta_sparse(spark, sf):
    line = _t(spark, sf, "lineitem").groupBy(F.when(F.col("l_linestatus") == "F", "A").otherwise("B").alias("corpus"), F.col("l_orderkey").alias("title"), F.col("l_suppkey").alias("domain")).agg(F.count("*").alias("cnt"))
    return _rounded(C.domain_delta(line))


@_query(f"WITH {_CITES}, {_STATUS}, {_DELTA.format(src='cites')} SELECT status, sum(delta_sum)::BIGINT AS delta_sum, sum(added_pages)::BIGINT AS added_pages FROM delta JOIN dim USING (domain) GROUP BY status")
def q_status_delta(spark, sf):
    return C.domain_delta(cites(spark, sf)).join(statuses(spark, sf), "domain").groupBy("status").agg(F.sum("delta_sum").alias("delta_sum"), F.sum("added_pages").alias("added_pages"))


def _wide_sql(labels: list[str]) -> str:
    return ", ".join(f"coalesce(sum(cnt) FILTER (corpus = '{c}' AND label = '{x}'), 0)::BIGINT AS {c.lower()}_{x}" for c in "AB" for x in labels) + ", " + ", ".join(f"coalesce(sum(cnt) FILTER (corpus = '{c}'), 0)::BIGINT AS {c.lower()}_total" for c in "AB")


_STATUS_SHIFT = f"{_CITES}, {_STATUS}, l AS (SELECT cites.*, {_NAME} AS label FROM cites LEFT JOIN dim USING (domain)), shift AS (SELECT title, {_wide_sql(C.CLASSES)} FROM l GROUP BY title)"


@_query(f"WITH {_STATUS_SHIFT} SELECT *, (a_reliable - a_unreliable) - (b_unreliable - b_reliable) AS maximal FROM shift")
def q_status_shift(spark, sf):
    return C.status_shift(cites(spark, sf), statuses(spark, sf))


_BUCKET_SHIFT = f"{_CITES}, {_SCORE}, l AS (SELECT cites.*, coalesce('bucket_' || ({_BUCKET}), 'other') AS label FROM cites LEFT JOIN dim USING (domain)), shift AS (SELECT title, {_wide_sql([*C.BUCKETS, 'other'])} FROM l GROUP BY title)"


@_query(f"WITH {_BUCKET_SHIFT} SELECT *, " + ", ".join(f"b_{x} - a_{x} AS shift_{x}" for x in C.BUCKETS) + ", (" + " + ".join(f"(b_{x} - a_{x}) * {i + 1}" for i, x in enumerate(C.BUCKETS)) + ")::BIGINT AS weighted_shift FROM shift")
def q_bucket_shift(spark, sf):
    return C.bucket_shift(cites(spark, sf), scores(spark, sf))


@_query(f"WITH {_CITES}, {_SCORE} SELECT coalesce((round_even(pc1 * 5, 0) / 5)::DOUBLE::VARCHAR, 'No score') AS bucket, sum(cnt)::BIGINT AS cites FROM cites LEFT JOIN dim USING (domain) GROUP BY 1")
def q_bucket_halfeven(spark, sf):
    return cites(spark, sf).join(scores(spark, sf), "domain", "left").groupBy(M.half_even_bucket(F.col("pc1")).alias("bucket")).agg(F.sum("cnt").alias("cites"))


def _composition_sql(labels: list[str], by: str = "") -> str:
    total = {c: " + ".join(f"sum({c}_{x})" for x in labels) for c in "ab"}
    cells = " UNION ALL ".join(f"SELECT {by + ', ' if by else ''}'{c.upper()}' AS corpus, '{x}' AS label, sum({c}_{x})::BIGINT AS cites, round(coalesce(sum({c}_{x}) / nullif({total[c]}, 0)::DOUBLE, 0), 6) AS prop, round((count(*) FILTER ({c}_{x} > 0)) * 100.0 / count(*), 6)::DOUBLE AS coverage_pct FROM shift{' GROUP BY ' + by if by else ''}" for c in "ab" for x in labels)
    return cells


@_query(f"WITH {_STATUS_SHIFT} {_composition_sql(C.CLASSES)}")
def q_composition(spark, sf):
    return _rounded(C.composition(C.status_shift(cites(spark, sf), statuses(spark, sf))))


@_query(f"WITH {_BUCKET_SHIFT} {_composition_sql([*C.BUCKETS, 'other'])}")
def q_coverage_pct(spark, sf):
    return _rounded(C.composition(C.bucket_shift(cites(spark, sf), scores(spark, sf)), [*C.BUCKETS, "other"]))


@_query(
    f"WITH {_CITES}, {_STATUS}, l AS (SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'Other' END AS party, {_NAME} AS label, cnt FROM cites JOIN customer ON title = c_custkey::VARCHAR LEFT JOIN dim USING (domain)) "
    + "SELECT party, " + ", ".join(f"round(coalesce(coalesce(sum(cnt) FILTER (label = '{x}'), 0) / nullif(sum(cnt), 0)::DOUBLE, 0), 6) AS {x}" for x in C.CLASSES) + " FROM l GROUP BY party"
)
def q_group_status_pivot(spark, sf):
    people = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("title"), F.col("c_mktsegment").alias("party"))
    rows = cites(spark, sf).join(people, "title").join(statuses(spark, sf), "domain", "left").select("party", M.status_name(F.col("status")).alias("label"), "cnt")
    return _rounded(C.group_status_pivot(rows, "party", "label", C.CLASSES, keep=["BUILDING", "MACHINERY"]))


_TYPED = "typed AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'a' || p_partkey || '.gov' WHEN 1 THEN 'b' || p_partkey || '.mil.uk' ELSE 'c' || p_partkey || '.com' END AS domain, p_size::BIGINT AS net FROM part)"


@_query(f"WITH {_TYPED}, top AS (SELECT net FROM typed WHERE regexp_matches(domain, '\\.gov(\\.|$)|\\.mil(\\.|$)') ORDER BY net DESC, domain LIMIT 100) SELECT (SELECT coalesce(sum(net), 0) FROM top)::BIGINT AS top_sum, (SELECT sum(net) FROM typed)::BIGINT AS total, round(coalesce((SELECT sum(net) FROM top) / nullif((SELECT sum(net) FROM typed), 0)::DOUBLE, 0), 6) AS share")
def q_govmil_share(spark, sf):
    k = F.col("p_partkey")
    rows = _t(spark, sf, "part").select(F.when(k % 3 == 0, F.concat(F.lit("a"), k, F.lit(".gov"))).when(k % 3 == 1, F.concat(F.lit("b"), k, F.lit(".mil.uk"))).otherwise(F.concat(F.lit("c"), k, F.lit(".com"))).alias("domain"), F.col("p_size").cast("long").alias("net"))
    return _rounded(C.top_share(rows, U.is_government(F.col("domain")), "net", "domain"))


@_query(f"WITH {_CITES} SELECT title, sum(cnt)::BIGINT AS cites FROM cites WHERE domain IN (SELECT p_brand FROM part WHERE p_size > 48) GROUP BY title")
def q_journal_semijoin(spark, sf):
    journals = _t(spark, sf, "part").where("p_size > 48").select(F.col("p_brand").alias("domain"))
    return cites(spark, sf).join(journals, "domain", "left_semi").groupBy("title").agg(F.sum("cnt").alias("cites"))


@_query(f"WITH {_CITES} SELECT title, domain AS site, sum(cnt)::BIGINT AS citations FROM cites WHERE domain IN ('Brand#1', 'Brand#22') GROUP BY ALL")
def q_exact_sublist(spark, sf):
    return C.sublist(cites(spark, sf), ["Brand#1", "Brand#22"])


@_query(f"WITH {_CITES} SELECT title, site, sum(cnt)::BIGINT AS citations FROM cites JOIN (VALUES ('#1'), ('d#2')) s(site) ON contains(domain, site) GROUP BY ALL")
def q_substr_sublist(spark, sf):
    return C.sublist(cites(spark, sf), ["#1", "d#2"], exact=False)


def _handles_sql() -> str:
    parts = []
    for site, pattern, group in U.HANDLES:
        if site == "facebook.com":  # its pattern looks ahead, which this dialect can't: the same in two steps
            pattern, group = r"https?://(?:www\.)?facebook\.com/([A-Za-z0-9_.]{5,})(?:[/?#]|$)", 1
        name = f"regexp_extract(url, '{pattern}', {group})"
        extra = f" AND name NOT IN ({', '.join(repr(n) for n in U.NO_HANDLES[site])})" if site in U.NO_HANDLES else ""
        if site == "facebook.com":
            extra += r" AND NOT regexp_matches(url, 'facebook\.com/(pages|groups|events|marketplace|watch|gaming|live|photo\.php)(?:/|$)') AND NOT regexp_matches(name, '^\d+$')"
        if site == "youtube.com":
            extra += " AND NOT regexp_matches(name, '^UC[a-zA-Z0-9_-]{22}$') AND NOT (contains(url, 'watch') AND NOT contains(url, '/user/') AND NOT contains(url, '/c/') AND NOT contains(url, '/channel/'))"
        if site == "instagram.com":
            extra += " AND NOT regexp_matches(url, '/p/[^/?#]+')"
        parts.append(f"SELECT title, '{site}' AS site, name AS username FROM (SELECT title, url, {name} AS name FROM urls) WHERE contains(url, '{site}') AND name <> ''{extra}")
    return " UNION ALL ".join(parts)


_HANDLES = f"urls(title, url) AS (VALUES {_URLS}), h AS ({_handles_sql()}), handles AS (SELECT title, site, username, count(*)::BIGINT AS count FROM h GROUP BY ALL)"


@_query(f"WITH {_HANDLES} SELECT * FROM handles")
def q_social_handles(spark, sf):
    return C.handles(_urls(spark))


@_query(f"WITH {_HANDLES}, a AS (SELECT * FROM handles WHERE title < 't4'), b AS (SELECT CASE title WHEN 't6' THEN 't1' ELSE title END AS title, site, username, count FROM handles WHERE title >= 't3') SELECT title, site, username, coalesce(a.count, 0) AS count_a, coalesce(b.count, 0) AS count_b, coalesce(b.count, 0) - coalesce(a.count, 0) AS diff FROM a FULL JOIN b USING (title, site, username)")
def q_handle_diff(spark, sf):
    h = C.handles(_urls(spark))
    return C.handle_diff(h.where("title < 't4'"), h.where("title >= 't3'").withColumn("title", F.when(F.col("title") == "t6", "t1").otherwise(F.col("title"))))


def _ai_sql() -> str:
    tries = " ".join(f"WHEN contains(url, '{s}') AND regexp_extract(url, '{p}', 1) <> '' THEN '{s}|' || regexp_extract(url, '{p}', 1)" for s, p in U.SHARES)
    name = f"regexp_extract(url, '{U.HANDLES[0][1]}', 1)"
    return f"SELECT title, split_part(hit, '|', 1) AS ai_site, split_part(hit, '|', 2) AS share_id, url FROM (SELECT *, CASE {tries} WHEN lower({name}) = 'grok' AND NOT contains(url, '/i/grok/share/') AND NOT contains(url, '/i/share/') THEN CASE WHEN contains(url, 'twitter.com') THEN 'twitter.com/grok|' ELSE 'x.com/grok|' END || {name} END AS hit FROM urls) WHERE hit IS NOT NULL"


@_query(f"WITH urls(title, url) AS (VALUES {_URLS}) {_ai_sql()}")
def q_ai_share(spark, sf):
    return C.ai_shares(_urls(spark))


# -- sets, windows, shards


@_query("SELECT o_custkey AS title FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def q_titles_common(spark, sf):
    return R.common(_t(spark, sf, "orders").withColumnRenamed("o_custkey", "title"), _t(spark, sf, "customer").where("c_nationkey < 10").withColumnRenamed("c_custkey", "title"), "title")


@_query("SELECT c_custkey AS title FROM customer EXCEPT SELECT o_custkey FROM orders")
def q_titles_missing(spark, sf):
    return R.missing(_t(spark, sf, "customer").withColumnRenamed("c_custkey", "title"), _t(spark, sf, "orders").withColumnRenamed("o_custkey", "title"), "title")


@_query("SELECT n_name AS name, n_regionkey::DOUBLE AS region, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def q_union_align(spark, sf):
    return R.union_align(_t(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("region")), _t(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


def _dedup_sql(way: str) -> str:
    return f"SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey {way}) = 1"


@_query(_dedup_sql("ASC"))
def q_dedup_first(spark, sf):
    return R.dedup_first(_t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")


@_query(_dedup_sql("DESC"))
def q_dedup_last(spark, sf):
    return R.dedup_last(_t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")


_RANK = "a AS (SELECT domain, row_number() OVER (ORDER BY a_count DESC, domain) AS p FROM d QUALIFY p <= 20), b AS (SELECT domain, row_number() OVER (ORDER BY b_count DESC, domain) AS p FROM d QUALIFY p <= 20)"


@_query(f"WITH {_CITES}, {_TOTALS.format(src='cites')}, {_RANK} SELECT domain, a.p::INT AS a_position, b.p::INT AS b_position, (b.p - a.p)::INT AS change, round(least(0.5 + abs(b.p - a.p) * 0.02, 3.0)::DOUBLE, 6) AS width, round((0.3 + least(abs(b.p - a.p) / 50.0, 0.4))::DOUBLE, 6) AS alpha FROM a JOIN b USING (domain)")
def q_rank_change(spark, sf):
    totals = C.domain_totals(cites(spark, sf))
    return _rounded(S.rank_change(S.ranked(totals, "a_count", "domain", 20), S.ranked(totals, "b_count", "domain", 20), "domain"))


@_query("SELECT c_custkey, c_mktsegment, c_acctbal, nullif(coalesce(list_position(['MACHINERY', 'BUILDING', 'AUTOMOBILE'], c_mktsegment), 0), 0)::DOUBLE AS category_position FROM customer")
def q_category_sort(spark, sf):
    return S.category_order(_t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", ["MACHINERY", "BUILDING", "AUTOMOBILE"], "c_acctbal").withColumn("category_position", F.col("category_position").cast("double"))


@_query("SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) % 7)::INT AS shard, ((row_number() OVER (ORDER BY c_custkey) - 1) // 7)::BIGINT AS within FROM customer")
def q_shard_modulo(spark, sf):
    return R.shard_modulo(R.ordinal(_t(spark, sf, "customer").select("c_custkey"), "c_custkey"), F.col("index"), 7).select("c_custkey", "shard", "within")


@_query("SELECT c_custkey, (ntile(7) OVER (ORDER BY c_custkey) - 1)::INT AS shard FROM customer")
def q_shard_range(spark, sf):
    people = _t(spark, sf, "customer").select("c_custkey")
    return R.shard_range(R.ordinal(people, "c_custkey"), F.col("index"), people.count(), 7).select("c_custkey", "shard")


@_query("WITH f AS (SELECT 'requests_shard' || (o_custkey % 5) || 'of5.jsonl' AS file, o_orderkey % 3 AS n FROM orders) SELECT 5 AS of, (regexp_extract(file, '_shard([0-9]+)of', 1))::INT AS shard, count(*)::BIGINT AS rows, (count(*) FILTER (n > 0))::BIGINT AS with_items, sum(n)::BIGINT AS items FROM f GROUP BY ALL")
def q_shard_stats(spark, sf):
    rows = _t(spark, sf, "orders").select(F.concat(F.lit("requests_shard"), F.col("o_custkey") % 5, F.lit("of5.jsonl")).alias("file"), F.array_repeat(F.lit(1), (F.col("o_orderkey") % 3).cast("int")).alias("items"))
    return R.shard_stats(rows, "file", "items")


_TITLES = "('Fullback (rugby league)'), ('The Silent Sea(TV series)'), ('ΦX174'), ('α-Ketoglutarate'), ('A((b'), ('plain')"


@_query(f"WITH t(title) AS (VALUES {_TITLES}) SELECT title, regexp_replace(replace(replace(replace(title, ' ', '_'), 'Φ', 'Phi'), 'α', 'alpha'), '([^_])\\(', '\\1_(', 'g') AS slug FROM t")
def q_slug(spark, sf):
    return _values(spark, _TITLES, "title").select("title", U.title_to_slug(F.col("title")).alias("slug"))


@_query("SELECT * FROM (VALUES ('Sofía_Gómez', 'Sofía_Gómez | Sofa_Gmez | Sofia_Gomez'), ('O''Neil', 'O''Neil | ONeil | O_Neil'), ('ΦX174', 'ΦX174 | PhiX174 | X174'), ('plain', 'plain')) t(slug, variants)")
def q_slug_variants(spark, sf):
    slugs = _values(spark, "('Sofía_Gómez'), (\"O'Neil\"), ('ΦX174'), ('plain')", "slug")
    return slugs.select("slug", F.array_join(U.slug_variants(F.col("slug")), " | ").alias("variants"))


@_query("SELECT doc_id FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 50")
def q_sample(spark, sf):
    return R.sample_exact(_t(spark, sf, "documents").select("doc_id"), "doc_id", 50)


@_query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'not_found' WHEN 2 THEN 'rate_limited' ELSE 'error_503' END AS error FROM orders WHERE o_orderkey % 4 <> 0")
def q_flush_deadletter(spark, sf):
    k = F.col("o_orderkey") % 4
    fetched = _t(spark, sf, "orders").select("o_orderkey", F.when(k == 0, 200).when(k == 1, 404).when(k == 2, 429).otherwise(503).alias("status_code"))
    return R.split_dead_letters(fetched)[1].select("o_orderkey", "error")


@_query("SELECT o_orderpriority, (count(*) FILTER (o_orderkey % 4 = 0))::BIGINT AS success, (count(*) FILTER (o_orderkey % 4 <> 0))::BIGINT AS failed, round((count(*) FILTER (o_orderkey % 4 = 0)) / count(*)::DOUBLE, 6) AS success_rate FROM orders GROUP BY 1")
def q_fetch_tallies(spark, sf):
    return _rounded(R.tallies(_t(spark, sf, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 4 == 0, 200).otherwise(503).alias("status_code")), "o_orderpriority"))


# -- vectors

_SIMS = "sims AS (SELECT a.label AS title, a.vec_id AS a_chunk_id, b.vec_id AS b_chunk_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf, "embeddings").select(F.col("label").alias("title"), F.col("vec_id").alias("chunk_id"), "embedding")
    return rows.where("chunk_id % 2 = 0"), rows.where("chunk_id % 2 = 1")


def _sims(spark: SparkSession, sf: str) -> DataFrame:
    return V.pair_similarities(*_sides(spark, sf))


@_query(f"WITH {_SIMS} SELECT title, count(DISTINCT a_chunk_id)::BIGINT AS n_a, count(DISTINCT b_chunk_id)::BIGINT AS n_b, round(avg(similarity), 6) AS sim_mean, round(quantile_cont(similarity, 0.5), 6) AS sim_median, round(max(similarity), 6) AS sim_max, round(quantile_cont(similarity, 0.9), 6) AS sim_p90 FROM sims GROUP BY title")
def q_pair_stats(spark, sf):
    return _rounded(V.pair_stats(_sims(spark, sf)))


_TOP1 = f"WITH {_SIMS} SELECT title, a_chunk_id, b_chunk_id, round(similarity, 6) AS similarity FROM sims QUALIFY row_number() OVER (PARTITION BY title, a_chunk_id ORDER BY similarity DESC, b_chunk_id) = 1"


@_query(_TOP1)
def q_top1_align(spark, sf):
    return _rounded(V.top1(_sims(spark, sf)))


@_query(_TOP1)
def q_top1_blocked(spark, sf):
    return _rounded(V.top1_blocked(*_sides(spark, sf)))


@_query(f"WITH {_SIMS}, m AS (SELECT title, avg(similarity) AS s FROM sims GROUP BY title) SELECT count(*)::BIGINT AS count, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, round(min(s), 6) AS min, round(quantile_cont(s, 0.25), 6) AS p25, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.75), 6) AS p75, round(max(s), 6) AS max FROM m")
def q_sim_describe(spark, sf):
    return _rounded(S.describe(_sims(spark, sf).groupBy("title").agg(F.avg("similarity").alias("s")), "s"))


_BAND = "CASE " + " ".join(f"WHEN a_chunk_id {'=' if k == 0 else '<='} {k} THEN '{x}'" for k, x in M.CHUNK_BANDS) + " ELSE '>400' END"


@_query(f"WITH {_SIMS} SELECT {_BAND} AS band, count(*)::BIGINT AS count, round(avg(similarity), 6) AS mean, round(stddev_samp(similarity), 6) AS std, round(avg(similarity) - {M.Z95} * stddev_samp(similarity) / sqrt(count(*)), 6) AS ci_low, round(avg(similarity) + {M.Z95} * stddev_samp(similarity) / sqrt(count(*)), 6) AS ci_high FROM sims GROUP BY 1")
def q_sim_bucket_ci(spark, sf):
    return _rounded(S.mean_ci(_sims(spark, sf).withColumn("band", M.chunk_band(F.col("a_chunk_id"))), "similarity", "band"))


@_query("SELECT vec_id, round(list_sum(list_transform(list_transform(embedding, lambda x: x::DOUBLE * 3), lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: (y::DOUBLE * 3) ** 2))))), 5) AS total FROM embeddings")
def q_l2_normalise(spark, sf):
    v = V.normalised(_t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("embedding")))
    return v.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def _hist_sql(source: str, value: str, edges: list[float]) -> str:
    inside = f"v >= {edges[0]!r}::DOUBLE AND v <= {edges[-1]!r}::DOUBLE"
    listed = "[" + ", ".join(f"{e!r}::DOUBLE" for e in edges) + "]"
    return f"WITH x AS (SELECT {value}::DOUBLE AS v FROM {source}), n AS (SELECT count(v) AS n FROM x) SELECT least(len(list_filter({listed}, lambda e: e <= v)), {len(edges) - 1})::INT AS bin, count(*)::BIGINT AS count, round(100.0 * count(*) / (SELECT n FROM n)::DOUBLE, 6)::DOUBLE AS percent FROM x WHERE {inside} GROUP BY 1"


@_query(_hist_sql("lineitem", "l_discount", S.linear_edges(0.0, 0.1, 50)))
def q_hist_linear(spark, sf):
    return _rounded(S.histogram(_t(spark, sf, "lineitem"), "l_discount", S.linear_edges(0.0, 0.1, 50)))


@_query(_hist_sql("lineitem", "l_extendedprice", S.log_edges(1000.0, 100000.0, 100)))
def q_hist_log(spark, sf):
    return _rounded(S.histogram(_t(spark, sf, "lineitem"), "l_extendedprice", S.log_edges(1000.0, 100000.0, 100)))


@_query(_hist_sql("orders", "o_totalprice / 500000", S.linear_edges(0.0, 1.0, 100)))
def q_hist_pct(spark, sf):
    return _rounded(S.histogram(_t(spark, sf, "orders").select((F.col("o_totalprice") / 500000).alias("v")), "v", S.linear_edges(0.0, 1.0, 100)))


# -- text and structure


@_query(r"WITH t AS (SELECT doc_id::VARCHAR AS title, 'wiki' AS source, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT *, len(w) AS n FROM t WHERE len(w) > 0), k AS (SELECT *, unnest(range(least(greatest(ceil((n - 250) / 150.0), 0) + 1, ceil(n / 150.0))::BIGINT)) AS chunk_id FROM n) SELECT title, source, chunk_id::INT AS chunk_id, array_to_string(w[chunk_id * 150 + 1 : chunk_id * 150 + 250], ' ') AS text FROM k")
def q_chunks(spark, sf):
    return V.chunks(_t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("title"), F.lit("wiki").alias("source"), "text"))


def _outlines(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    o = F.transform(lines, lambda x: F.struct((F.length(x) % 3 + 1).alias("lvl"), F.lower(x).alias("name")))
    d = _t(spark, sf, "documents").select("doc_id", o.alias("o"))
    return d.where("doc_id % 2 = 0").select("doc_id", F.col("o").alias("a")).join(d.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.col("o").alias("b")), "doc_id")


_OUTLINES = "o AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), p AS (SELECT a.doc_id, list_transform(a.l, lambda x: lower(x)) AS an, list_transform(b.l, lambda x: lower(x)) AS bn, list_transform(a.l, lambda x: length(x) % 3 + 1) AS al, list_transform(b.l, lambda x: length(x) % 3 + 1) AS bl FROM o a JOIN o b ON b.doc_id = a.doc_id + 1 AND a.doc_id % 2 = 0)"


_JACCARD = "round(CASE WHEN len(list_distinct(an || bn)) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(an), list_distinct(bn))) / len(list_distinct(an || bn))::DOUBLE END, 6)::DOUBLE AS jaccard"


@_query(f"WITH {_OUTLINES} SELECT doc_id, {_JACCARD} FROM p")
def q_outline_jaccard(spark, sf):
    return _rounded(_outlines(spark, sf).select("doc_id", M.jaccard(F.col("a.name"), F.col("b.name")).alias("jaccard")))


def _lcs_sql(name: str, a: str, b: str) -> str:
    """Tables {name}_w and {name} (doc_id, n): the rows of the dynamic program for the lists a and b of p, one after another."""
    return f"""{name}_w AS (SELECT doc_id, {a} AS x, {b} AS y, 0 AS i, list_transform(range(len({b}) + 1), lambda z: 0::BIGINT) AS row FROM p UNION ALL
SELECT doc_id, x, y, i + 1, list_transform(range(1, len(y) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(row[k], CASE WHEN k > 1 AND y[k - 1] = x[i + 1] THEN row[k - 1] + 1 ELSE 0 END)))) FROM {name}_w WHERE i < len(x)),
{name} AS (SELECT doc_id, row[-1] AS n FROM {name}_w WHERE i = len(x))"""


#: An outline's clamped levels and their steps: each at most one above the one before.
_TREES = """t_w AS (SELECT doc_id, al, bl, 0 AS i, []::BIGINT[] AS ac, []::BIGINT[] AS bc FROM p UNION ALL
SELECT doc_id, al, bl, i + 1, CASE WHEN i < len(al) THEN list_append(ac, greatest(1, least(al[i + 1], coalesce(ac[-1], 1) + 1))) ELSE ac END, CASE WHEN i < len(bl) THEN list_append(bc, greatest(1, least(bl[i + 1], coalesce(bc[-1], 1) + 1))) ELSE bc END FROM t_w WHERE i < greatest(len(al), len(bl))),
tree AS (SELECT doc_id, list_transform(range(1, len(ac) + 1), lambda k: ac[k] - CASE WHEN k > 1 THEN ac[k - 1] ELSE 0 END) AS an, list_transform(range(1, len(bc) + 1), lambda k: bc[k] - CASE WHEN k > 1 THEN bc[k - 1] ELSE 0 END) AS bn FROM t_w WHERE i = greatest(len(al), len(bl)))"""
_SHAPE = _TREES + ", " + _lcs_sql("shape", "an", "bn").replace("FROM p UNION", "FROM tree UNION")
_RATIO = "round(coalesce({0}.n / nullif(greatest(len(an), len(bn)), 0)::DOUBLE, 0), 6)::DOUBLE"


@_query(f"WITH RECURSIVE {_OUTLINES}, {_lcs_sql('l', 'an', 'bn')} SELECT doc_id, n::INT AS lcs FROM l")
def q_outline_lcs(spark, sf):
    return _outlines(spark, sf).select("doc_id", M.lcs_length(F.col("a.name"), F.col("b.name")).alias("lcs"))


_COUNT = "len(list_filter({0}, lambda x: x = {1}))"


_COSINE = "c AS (SELECT doc_id, " + ", ".join(f"{_COUNT.format(s + 'l', i)} AS {s}{i}" for s in "ab" for i in (1, 2, 3)) + " FROM p), cosine AS (SELECT doc_id, round(CASE WHEN a1 + a2 + a3 = 0 AND b1 + b2 + b3 = 0 THEN 1.0 WHEN a1 + a2 + a3 = 0 OR b1 + b2 + b3 = 0 THEN 0.0 ELSE (a1 * b1 + a2 * b2 + a3 * b3) / (sqrt(a1 * a1 + a2 * a2 + a3 * a3) * sqrt(b1 * b1 + b2 * b2 + b3 * b3)) END, 6)::DOUBLE AS depth_cosine FROM c)"


@_query(f"WITH {_OUTLINES}, {_COSINE} SELECT * FROM cosine")
def q_depth_cosine(spark, sf):
    return _rounded(_outlines(spark, sf).select("doc_id", M.histogram_cosine(M.depth_histogram(F.col("a.lvl")), M.depth_histogram(F.col("b.lvl"))).alias("depth_cosine")))


@_query(f"WITH RECURSIVE {_OUTLINES}, {_SHAPE} SELECT doc_id, {_RATIO.format('shape')} AS shape_similarity FROM p JOIN shape USING (doc_id)")
def q_shape_similarity(spark, sf):
    return _rounded(T.compare(_outlines(spark, sf)).select("doc_id", "shape_similarity"))


@_query(
    f"WITH RECURSIVE {_OUTLINES}, {_COSINE}, {_lcs_sql('l', 'an', 'bn')}, {_SHAPE} SELECT doc_id, {_RATIO.format('l')} AS lcs_ratio, {_JACCARD}, depth_cosine, {_RATIO.format('shape')} AS shape_similarity, len(an)::BIGINT AS a_outline_length, "
    + "len(bn)::BIGINT AS b_outline_length, (len(bn) - len(an))::BIGINT AS outline_length_diff, round(len(bn) / nullif(len(an), 0)::DOUBLE, 6)::DOUBLE AS outline_length_ratio FROM p JOIN l USING (doc_id) JOIN shape USING (doc_id) JOIN cosine USING (doc_id)"
)
def q_structure_compare(spark, sf):
    return _rounded(T.compare(_outlines(spark, sf)))


@_query("SELECT doc_id, regexp_matches(text, 'Licen[cs]e') AS licensed FROM documents")
def q_license_split(spark, sf):
    return T.licence_split(_t(spark, sf, "documents").select("doc_id", F.array("text").alias("paragraphs")), phrase="Licen[cs]e").select("doc_id", "licensed")


@_query("SELECT conv_id, trim(string_agg(CASE WHEN turn = 1 THEN '# ' ELSE '## ' END || role || CASE WHEN coalesce(text, '') = '' THEN '' ELSE chr(10) || chr(10) || text END, chr(10) || chr(10) ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def q_text_build(spark, sf):
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    sections = F.transform("s", lambda s: F.struct(F.when(s["turn"] == 1, "h1").otherwise("h2").alias("level"), s["role"].alias("title"), F.array(F.struct(s["text"].alias("text"))).alias("content")))
    return c.select("conv_id", T.text_b(sections).alias("text"))


@_query("WITH c AS (SELECT conv_id, turn, role, text AS t FROM conversations), h AS (SELECT conv_id, min(turn) AS first FROM c GROUP BY conv_id), k AS (SELECT c.conv_id, c.turn, NOT (c.turn = h.first AND EXISTS (SELECT 1 FROM c o WHERE o.conv_id = c.conv_id AND o.turn <> c.turn AND o.t IS NOT DISTINCT FROM c.t)) AS stays FROM c JOIN h USING (conv_id)) SELECT conv_id, (count(*) FILTER (stays))::BIGINT AS items FROM k GROUP BY conv_id")
def q_section_dedup(spark, sf):
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("t")))).alias("s"))
    sections = F.transform("s", lambda s, i: F.struct(F.when(i == 0, "h1").otherwise("h2").alias("level"), F.array(F.struct(F.lit("paragraph").alias("type"), s["t"].alias("text"))).alias("content")))
    c = c.select("conv_id", sections.alias("s"))
    return c.select("conv_id", F.size(F.flatten(T.dedup_sections(F.col("s"))["content"])).cast("long").alias("items"))


def _article_layout(html: Column) -> Column:
    """A whole page in the layout of the parser's: headings get an id, paragraphs become spans (a paragraph or heading ends an open one), navigation the references."""
    for pattern, to in (
        (r"(?i)<p(?=[\s>])([^>]*)>", f'</span><span$1 class="{article_html.PARAGRAPH}">'), (r"(?i)</p\s*>", "</span>"), (r"(?i)<h([1-3])(?=[\s>])", '</span><h$1 id="t"'),
        (r"(?i)<nav(?=[\s>])([^>]*)>", f'<div$1 id="{article_html.REFERENCES}">'), (r"(?i)</nav\s*>", "</div>"),
    ):
        html = F.regexp_replace(html, pattern, to)
    return html


@_query()
def q_html_parse(spark, sf):
    box = F.concat(F.lit(f'<div class="{article_html.CONTAINER}">'), _article_layout(F.col("html")), F.lit("</div>"))
    parsed = article_html.parse_pages(_t(spark, sf, "pages").select("page_id", "url", box.alias("html")))
    return parsed.select("url", F.col("data.main_title").alias("main_title"), F.size("data.sections").alias("sections"), F.size("data.paragraphs").alias("paragraphs"), F.size("data.references").alias("refs"))


@_query("WITH r AS (SELECT (doc_id % 20)::VARCHAR AS title, text || CASE doc_id % 3 WHEN 0 THEN ' ISBN 9780306406157' WHEN 1 THEN ' pp. 12-14, (1999' ELSE '' END AS x FROM documents) SELECT title, count(*)::BIGINT AS n_refs, (count(*) FILTER (regexp_matches(x, '(?i)(?:ISBN[-:]?\\s*)?(?:(?:978|979)[- ]?\\d{1,5}[- ]?\\d{1,7}[- ]?\\d{1,6}[- ]?\\d|\\d{1,5}[- ]?\\d{1,7}[- ]?\\d{1,6}[- ]?[\\dX])') OR contains(lower(x), 'books.google.com') OR (regexp_matches(x, '[12][0-9]{3}') AND regexp_matches(x, '(?i)\\b(?:p\\.?|pp\\.?|page|pages)\\s+\\d+(?:[-–]\\d+)?'))))::BIGINT AS n_books FROM r GROUP BY title")
def q_book_cites(spark, sf):
    k = F.col("doc_id") % 3
    texts = F.concat("text", F.when(k == 0, " ISBN 9780306406157").when(k == 1, " pp. 12-14, (1999").otherwise(""))
    return C.book_citations(_t(spark, sf, "documents").select((F.col("doc_id") % 20).cast("string").alias("title"), F.array(texts, F.lit(None).cast("string")).alias("texts")))


# -- cohorts

_LINES = "SELECT (CASE WHEN event_type = 'click' THEN 'de.wikipedia' ELSE 'en.wikipedia' END) || ' ' || (CASE WHEN user_id % 11 = 0 THEN '-' ELSE 'Page_' || user_id END) || ' ' || user_id || (CASE WHEN event_id % 2 = 0 THEN ' desktop ' ELSE ' ' END) || (CASE WHEN event_id % 13 = 0 THEN 'x' ELSE (event_id % 97)::VARCHAR END) AS value FROM events"


@_query(f"WITH l AS ({_LINES}), p AS (SELECT string_split(value, ' ') AS p FROM l), v AS (SELECT lower(replace(p[2], '_', ' ')) AS title, p[3] AS page_id, try_cast(CASE WHEN p[4] = 'desktop' THEN p[5] ELSE p[4] END AS BIGINT) AS views FROM p WHERE p[1] = 'en.wikipedia' AND p[2] <> '-') SELECT sum(views)::BIGINT AS views, count(DISTINCT page_id)::BIGINT AS pages, round(sum(views) / 7153203240::DOUBLE, 6) AS capture_share FROM v WHERE views IS NOT NULL AND title IN (SELECT 'page ' || c_custkey FROM customer)")
def q_pageview_capture(spark, sf):
    titles = _t(spark, sf, "customer").select(F.concat(F.lit("page "), F.col("c_custkey")).alias("title"))
    return _rounded(H.pageview_capture(H.pageview_lines(pageview_text(spark, sf)), titles, 7_153_203_240))


def pageview_text(spark: SparkSession, sf: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    line = F.concat(F.when(F.col("event_type") == "click", "de.wikipedia").otherwise("en.wikipedia"), F.lit(" "), F.when(u % 11 == 0, "-").otherwise(F.concat(F.lit("Page_"), u)), F.lit(" "), u, F.when(e % 2 == 0, " desktop ").otherwise(" "), F.when(e % 13 == 0, "x").otherwise((e % 97).cast("string")))
    return _t(spark, sf, "events").select(line.alias("value"))


@_query("WITH v AS (SELECT json_extract_string(props, '$.k') AS country_code, sum(value) AS views FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1) SELECT country_code, n_name AS iso3, round(views, 4) AS views FROM v LEFT JOIN nation ON country_code = n_nationkey::VARCHAR")
def q_geo_views(spark, sf):
    views = _t(spark, sf, "events").select(F.get_json_object("props", "$.k").alias("country_code"), F.col("value").alias("noisy_views"))
    countries = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("iso2"), F.col("n_name").alias("iso3"))
    return H.geo_views(views, countries).select("country_code", "iso3", F.round("views", 4).alias("views"))


_TOPICS = "topics AS (SELECT c_custkey::VARCHAR AS title, 'Geography.Regions.' || r_name || '.' || n_name AS topic FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey::VARCHAR, 'Culture.' || c_mktsegment FROM customer WHERE c_custkey % 5 = 1)"


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    n, r = _t(spark, sf, "nation"), _t(spark, sf, "region")
    c = _t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    geo, other = F.concat(F.lit("Geography.Regions."), F.col("r_name"), F.lit("."), F.col("n_name")), F.concat(F.lit("Culture."), F.col("c_mktsegment"))
    k = F.col("c_custkey") % 5
    return c.select(F.col("c_custkey").cast("string").alias("title"), F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(geo, other)).otherwise(F.array(geo)).alias("topics"))


@_query(f"WITH {_TOPICS}, a AS (SELECT * FROM topics UNION ALL SELECT c_custkey::VARCHAR, NULL FROM customer WHERE c_custkey % 5 = 0) SELECT split_part(topic, '.', 1) AS topic_prefix, CASE WHEN contains(topic, 'Region') THEN split_part(topic, '.', 3) END AS continent, count(*)::BIGINT AS n FROM a GROUP BY ALL")
def q_topic_explode(spark, sf):
    return H.topics(_articles(spark, sf)).groupBy("topic_prefix", "continent").agg(F.count("*").alias("n"))


def _topic_composition(dedupe: bool) -> str:
    rows = "SELECT DISTINCT title, split_part(topic, '.', 1) AS topic_prefix FROM topics" if dedupe else "SELECT title, split_part(topic, '.', 1) AS topic_prefix FROM topics UNION ALL SELECT title, split_part(topic, '.', 1) FROM topics"
    return f"WITH {_STATUS_SHIFT.replace('shift AS', 'base AS')}, {_TOPICS}, shift AS (SELECT base.*, topic_prefix FROM base JOIN ({rows}) USING (title)) {_composition_sql(C.CLASSES, 'topic_prefix')}"


@_query(_topic_composition(True))
def q_topic_composition(spark, sf):
    t = H.topics(_articles(spark, sf))
    return _rounded(C.composition(H.by_topic(C.status_shift(cites(spark, sf), statuses(spark, sf)), t, "topic_prefix"), by=["topic_prefix"]))


@_query(_topic_composition(False))
def q_topic_composition_fanout(spark, sf):
    t = H.topics(_articles(spark, sf))
    return _rounded(C.composition(H.by_topic(C.status_shift(cites(spark, sf), statuses(spark, sf)), t.unionByName(t), "topic_prefix", dedupe=False), by=["topic_prefix"]))


_LABELS = "('Northern-Europe'), ('asia'), ('Oceania'), ('nowhere')"
_REGIONS = "('Geography.Regions.Europe.Northern Europe'), ('Geography.Regions.Asia.Asia*'), ('Geography.Regions.Asia.East Asia'), ('Geography.Regions.Oceania')"


@_query(f"WITH l(label) AS (VALUES {_LABELS}), r(region) AS (VALUES {_REGIONS}), k AS (SELECT label, lower(replace(label, '-', '_')) AS key FROM l), s AS (SELECT region, lower(replace(replace(trim(string_split(region, '.')[-1]), ' ', '_'), '-', '_')) AS rkey FROM r) SELECT label, coalesce((SELECT min(region) FROM s WHERE rkey = key), (SELECT min(region) FROM s WHERE contains(rkey, key))) AS region FROM k")
def q_region_map(spark, sf):
    return H.map_regions(_values(spark, _LABELS, "label"), _values(spark, _REGIONS, "region"))


_PARTIES = "('p1', 'Labour Party'), ('p1', 'Co-operative Party'), ('p2', 'Conservative and Unionist Party'), ('p3', 'Conservative Party'), ('p4', 'Reform UK'), ('p5', 'Green Party'), ('p6', 'Labour and Co-operative')"


@_query(f"WITH p(title, party) AS (VALUES {_PARTIES}), f AS (SELECT title, min(party) AS party FROM p GROUP BY title), s AS (SELECT 'p' || c_custkey AS title, c_acctbal AS similarity FROM customer) SELECT title, party, similarity, CASE WHEN contains(lower(party), 'labour') THEN 'Labour Party' WHEN contains(lower(party), 'conservative') AND NOT contains(lower(party), 'unionist') THEN 'Conservative Party' WHEN contains(lower(party), 'reform uk') THEN 'Reform UK' ELSE 'Other' END AS party_category FROM f JOIN s USING (title)")
def q_party(spark, sf):
    similarity = _t(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey")).alias("title"), F.col("c_acctbal").alias("similarity"))
    return H.party_similarity(_values(spark, _PARTIES, "title, party"), similarity, "uk")


_ISSUES = "issues AS (SELECT event_id, CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN event_type || ' | t' || (user_id % 17) ELSE 't' || (user_id % 17) END AS issue_type FROM events)"


@_query(f"WITH {_ISSUES}, t AS (SELECT event_id, CASE WHEN trim(coalesce(issue_type, '')) = '' THEN ['other'] WHEN contains(issue_type, '|') THEN list_filter(list_transform(string_split(issue_type, '|'), lambda x: trim(x)), lambda x: x <> '') ELSE [trim(issue_type)] END AS l FROM issues), x AS (SELECT event_id, unnest(range(len(l))) AS pos, unnest(l) AS type FROM t), top AS (SELECT type FROM x GROUP BY type ORDER BY count(*) DESC, min((event_id, pos)) LIMIT 8) SELECT CASE WHEN type IN (SELECT type FROM top) THEN type ELSE 'other' END AS type, count(*)::BIGINT AS count FROM x GROUP BY 1")
def q_issue_types(spark, sf):
    k = F.col("event_id") % 13
    t = F.concat(F.lit("t"), F.col("user_id") % 17)
    issues = _t(spark, sf, "events").select("event_id", F.when(k == 0, F.lit(None)).when(k == 1, " ").when(k == 2, F.concat(F.col("event_type"), F.lit(" | "), t)).otherwise(t).alias("issue_type"))
    return H.issue_counts(issues, "event_id")


@_query("SELECT CASE role WHEN 'user' THEN 'critical' WHEN 'assistant' THEN 'non-critical' ELSE 'other' END AS criticality, count(*)::BIGINT AS count FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1 UNION ALL SELECT 'other', count(*)::BIGINT FROM conversations WHERE coalesce(role NOT IN ('user', 'assistant'), true)")
def q_criticality(spark, sf):
    r = F.col("role")
    rows = _t(spark, sf, "conversations").select(M.criticality(F.when(r == "user", "Critical").when(r == "assistant", "non-critical").otherwise(r)).alias("criticality"))
    return S.reindex(rows.groupBy("criticality").agg(F.count("*").alias("count")), "criticality", ["critical", "non-critical", "other"]).select("criticality", "count")


_TALK = "('Talk:Foo/Archive 1'), ('Talk:Bar'), ('User talk:Baz'), ('Template:X'), ('Wikipedia:Y'), (' Plain '), ('Talk:bar')"


@_query(f"WITH t(title) AS (VALUES {_TALK}) SELECT DISTINCT lower(trim(regexp_replace(replace(title, 'Talk:', ''), 'Archive [0-9]+', '', 'g'))) AS title FROM t WHERE NOT regexp_matches(title, 'File talk:|User talk:|Template:|Template talk:|Wikipedia:|Wikipedia talk:')")
def q_controversial_clean(spark, sf):
    return H.controversial(_values(spark, _TALK, "title"))


_TRIPLES = "triples AS (SELECT 's' || c_custkey AS subject, 'position' AS predicate, CASE WHEN c_custkey % 3 = 0 THEN 'Q1' WHEN c_custkey % 3 = 1 THEN 'Q2' ELSE 'Q3' END AS object FROM customer UNION ALL SELECT 'p' || (c_custkey % 100), 'held', 's' || c_custkey FROM customer UNION ALL SELECT 's' || c_custkey, 'end', '2020' FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 's' || c_custkey, 'group', c_mktsegment FROM customer WHERE c_custkey % 2 = 0)"


@_query(f"WITH {_TRIPLES}, h AS (SELECT subject AS person, object AS s FROM triples WHERE predicate = 'held'), q AS (SELECT subject AS s, object AS position FROM triples WHERE predicate = 'position') SELECT DISTINCT person, position, g.object AS party FROM h JOIN q USING (s) LEFT JOIN (SELECT * FROM triples WHERE predicate = 'group') g ON g.subject = s WHERE position IN ('Q1', 'Q2') AND NOT EXISTS (SELECT 1 FROM triples e WHERE e.predicate = 'end' AND e.subject = s)")
def q_sparql_members(spark, sf):
    c = _t(spark, sf, "customer")
    k = F.col("c_custkey")
    s = F.concat(F.lit("s"), k)
    triple = lambda rows, a, p, o: rows.select(a.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    triples = R.union_align(
        triple(c, s, "position", F.when(k % 3 == 0, "Q1").when(k % 3 == 1, "Q2").otherwise("Q3")), triple(c, F.concat(F.lit("p"), k % 100), "held", s),
        triple(c.where(k % 4 == 0), s, "end", F.lit("2020")), triple(c.where(k % 2 == 0), s, "group", F.col("c_mktsegment")),
    )
    return H.members(triples, "held", "position", "end", "group", ["Q1", "Q2"])


@_query("SELECT l_returnflag AS value, count(*)::BIGINT AS count FROM lineitem GROUP BY 1")
def q_value_counts(spark, sf):
    return S.value_counts(_t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("value")), "value")


@_query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def x_stream_counts(spark, sf):
    return ingest.windowed_counts(_t(spark, sf, "events"), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
