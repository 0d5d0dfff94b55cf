"""Citation analytics over the long table cites(corpus, title, domain, cnt); corpus 'A' is the baseline, 'B' the other.

Every operator is one lazy plan of equi-joins and aggregations that Spark combines before their exchange. Dimension tables are joined plainly, so Spark
broadcasts them where their size allows and splits skewed keys where not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import measures as M
from tandem.functions import urls as U

CLASSES = ["reliable", "unreliable", "blacklist", "no_consensus", "deprecated", "other"]
BUCKETS = [f"bucket_{i}" for i in range(5)]


def cites_from_references(refs: DataFrame) -> DataFrame:
    """refs: corpus, title, url -> cites. References without an authority don't count."""
    return refs.select("corpus", "title", U.stem_domain(U.netloc(F.col("url"))).alias("domain")).where("domain <> ''").groupBy("corpus", "title", "domain").agg(F.count("*").alias("cnt"))


def domain_totals(cites: DataFrame) -> DataFrame:
    """Per domain: counts and shares of both corpora, their differences, and the combined domain."""
    side = lambda c: F.coalesce(F.sum(F.when(F.col("corpus") == c, F.col("cnt"))), F.lit(0)).cast("long")
    by_domain = cites.groupBy("domain").agg(side("A").alias("a_count"), side("B").alias("b_count"))
    # One row; from the aggregated table, not from the facts.
    total = by_domain.agg(F.sum("a_count").alias("a_total"), F.sum("b_count").alias("b_total"))
    out = by_domain.join(F.broadcast(total))
    share = lambda c: M.proportion(F.col(f"{c}_count"), F.col(f"{c}_total"))
    return out.select("domain", "a_count", "a_total", share("a").alias("a_share"), "b_count", "b_total", share("b").alias("b_share"), (F.col("b_count") - F.col("a_count")).alias("count_diff"), (share("b") - share("a")).alias("share_diff"), U.combine_domains(F.col("domain")).alias("combined_domain"))


def combined_top(totals: DataFrame, k: int = 100, offset: int = 0) -> DataFrame:
    """The combined domains with the largest sums; ties by name."""
    sums = totals.groupBy("combined_domain").agg(F.sum("a_count").alias("a_count"), F.sum("b_count").alias("b_count"))
    ordered = sums.orderBy(F.desc(F.col("a_count") + F.col("b_count")), "combined_domain")
    return (ordered.offset(offset) if offset else ordered).limit(k)


def common_titles(cites: DataFrame) -> DataFrame:
    """Titles of both corpora."""
    return cites.groupBy("title").agg(F.bool_or(F.col("corpus") == "A").alias("a"), F.bool_or(F.col("corpus") == "B").alias("b")).where("a AND b").select("title")


def domain_delta(cites: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Per domain over titles of both corpora: the sum of B - A, in how many titles it grew or shrank, and both as shares of all such titles.
    titles: the common titles where some have no citation at all; else those that cites shows."""
    common = titles if titles is not None else common_titles(cites)
    by_pair = cites.join(common, "title", "left_semi").groupBy("title", "domain").agg(F.sum(F.when(F.col("corpus") == "B", F.col("cnt")).otherwise(-F.col("cnt"))).alias("delta"))
    stats = by_pair.groupBy("domain").agg(F.sum("delta").cast("long").alias("delta_sum"), F.count_if(F.col("delta") > 0).alias("added_pages"), F.count_if(F.col("delta") < 0).alias("removed_pages"))
    out = stats.join(F.broadcast(common.agg(F.count("*").alias("total_titles_compared"))))
    return out.select("*", (F.col("added_pages") / F.col("total_titles_compared")).alias("added_prop"), (F.col("removed_pages") / F.col("total_titles_compared")).alias("removed_prop"))


def last_of(dim: DataFrame, key: str, order: str) -> DataFrame:
    """A dimension with one row per key: the last by order, as a later entry overwrites an earlier."""
    value = [c for c in dim.columns if c not in (key, order)]
    return dim.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in value])


def _wide(rows: DataFrame, label: Column, labels: list[str]) -> DataFrame:
    """Per title: a_ and b_ sums of cnt for each label, and their totals; titles missing on a side get zeros."""
    cells = [F.sum(F.when((F.col("corpus") == c) & (F.col("_label") == x), F.col("cnt")).otherwise(0)).cast("long").alias(f"{c.lower()}_{x}") for c in "AB" for x in labels]
    totals = [F.sum(F.when(F.col("corpus") == c, F.col("cnt")).otherwise(0)).cast("long").alias(f"{c.lower()}_total") for c in "AB"]
    return rows.withColumn("_label", label).groupBy("title").agg(*cells, *totals)


def status_shift(cites: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per title the citations by source status (statuses: domain, status), and maximal = (A reliable - A unreliable) - (B unreliable - B reliable)."""
    wide = _wide(cites.join(statuses, "domain", "left"), M.status_name(F.col("status")), CLASSES)
    return wide.withColumn("maximal", (F.col("a_reliable") - F.col("a_unreliable")) - (F.col("b_unreliable") - F.col("b_reliable")))


def bucket_shift(cites: DataFrame, scores: DataFrame) -> DataFrame:
    """Per title the citations by score bucket (scores: domain, pc1), the shifts B - A, and their weighted sum."""
    b = M.score_bucket(F.col("pc1"))
    wide = _wide(cites.join(scores, "domain", "left"), F.when(b.isNull(), "other").otherwise(F.concat(F.lit("bucket_"), b.cast("string"))), [*BUCKETS, "other"])
    shifts = [(F.col(f"b_{x}") - F.col(f"a_{x}")).alias(f"shift_{x}") for x in BUCKETS]
    weighted = sum((F.col(f"b_{x}") - F.col(f"a_{x}")) * (i + 1) for i, x in enumerate(BUCKETS))
    return wide.select("*", *shifts, weighted.alias("weighted_shift"))


def composition(shift: DataFrame, labels: list[str] = CLASSES, by: list[str] | None = None) -> DataFrame:
    """Per corpus and label (and group): the sum, its share of the corpus, and the percentage of rows with at least one."""
    by = by or []
    sums = shift.groupBy(*by).agg(*[F.sum(f"{c}_{x}").alias(f"s_{c}_{x}") for c in "ab" for x in labels], *[(F.count_if(F.col(f"{c}_{x}") > 0) * 100.0 / F.count("*")).alias(f"p_{c}_{x}") for c in "ab" for x in labels])
    total = {c: sum(F.col(f"s_{c}_{x}") for x in labels) for c in "ab"}
    cells = [F.struct(F.lit(c.upper()).alias("corpus"), F.lit(x).alias("label"), F.col(f"s_{c}_{x}").alias("cites"), M.proportion(F.col(f"s_{c}_{x}"), total[c]).alias("prop"), F.col(f"p_{c}_{x}").alias("coverage_pct")) for c in "ab" for x in labels]
    return sums.select(*by, F.inline(F.array(*cells)))


def group_status_pivot(rows: DataFrame, group: str, label: str, labels: list[str], value: str = "cnt", keep: list[str] | None = None) -> DataFrame:
    """Group x label sums, wide, as shares of the group; groups outside keep are rolled into 'Other'."""
    g = F.when(F.col(group).isin(keep), F.col(group)).otherwise("Other") if keep else F.col(group)
    wide = rows.select(g.alias(group), label, value).groupBy(group).pivot(label, labels).agg(F.sum(value)).na.fill(0)
    total = sum(F.col(x) for x in labels)
    return wide.select(group, *[M.proportion(F.col(x), total).alias(x) for x in labels])


def top_share(rows: DataFrame, keep: Column, value: str, key: str, k: int = 100) -> DataFrame:
    """What the top k of the rows that pass keep add up to, and its share of all rows."""
    top = rows.where(keep).orderBy(F.desc(value), key).limit(k).agg(F.sum(value).alias("top_sum"))
    return top.join(F.broadcast(rows.agg(F.sum(value).alias("total")))).select(F.coalesce("top_sum", F.lit(0)).alias("top_sum"), "total", M.proportion(F.col("top_sum"), F.col("total")).alias("share"))


def sublist(cites: DataFrame, sites: list[str], exact: bool = True) -> DataFrame:
    """Citations per title of the given sites: domains equal to a site, or that contain it. sites is a short literal list."""
    if exact:
        hits = cites.where(F.col("domain").isin(sites)).withColumn("site", F.col("domain"))
    else:
        hits = cites.select("*", F.explode(F.filter(F.array(*map(F.lit, sites)), lambda s: F.contains(F.col("domain"), s))).alias("site"))
    return hits.groupBy("title", "site").agg(F.sum("cnt").cast("long").alias("citations"))


#: A list of sites has at most so many names.
MOST_SITES = 10_000


def sublist_of(cites: DataFrame, sites: DataFrame, exact: bool = True) -> DataFrame:
    """sublist for a table of sites (a column site) of at most MOST_SITES names, which become literals of the plan; a longer one is an error."""
    names = [r.site for r in sites.where("site <> ''").select("site").distinct().orderBy("site").limit(MOST_SITES + 1).collect()]
    if len(names) > MOST_SITES:
        raise ValueError(f"more than {MOST_SITES} sites")
    return sublist(cites, names, exact)


def composition_wide(long: DataFrame, labels: list[str] = CLASSES, value: str = "cites") -> DataFrame:
    """composition's rows as a table: a row per corpus, a column per label."""
    return long.groupBy("corpus").pivot("label", labels).agg(F.sum(value)).na.fill(0)


def handles(urls: DataFrame) -> DataFrame:
    """urls: title, url -> title, site, username, count."""
    return urls.select("title", F.inline(U.social_handles(F.col("url")))).groupBy("title", "site", "username").agg(F.count("*").alias("count"))


def handle_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two handle tables on (title, site, username), missing counts 0, with the difference."""
    keys = ["title", "site", "username"]
    both = a.withColumnRenamed("count", "count_a").join(b.withColumnRenamed("count", "count_b"), keys, "full").na.fill(0, ["count_a", "count_b"])
    return both.withColumn("diff", F.col("count_b") - F.col("count_a"))


def relevant(cites: DataFrame, names: list[str]) -> DataFrame:
    """The titles with a domain that contains one of the names (a short literal list): what is worth a look at its links."""
    hit = F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(F.col("domain"), n))
    return cites.where(hit).select("title").distinct()


def links_with(shares: DataFrame, part: str) -> DataFrame:
    """title, url of the links that contain part, of a title's links with the same last segment the first by spelling."""
    hit = shares.where(F.col("url").contains(part)).groupBy("title", U.last_segment(F.col("url")).alias("_last")).agg(F.min("url").alias("url"))
    return hit.select("title", "url")


def journals(cites: DataFrame, listed: DataFrame) -> DataFrame:
    """cites of journals: domains of the list (a column Domain) or of the fixed ones beside it."""
    known = listed.select(F.lower(F.trim("Domain")).alias("domain")).where("domain <> ''").distinct()
    known = known.unionByName(cites.sparkSession.createDataFrame([(d,) for d in U.JOURNALS], "domain string")).distinct()
    return cites.join(known, "domain", "left_semi")


def reference_counts(refs: DataFrame, titles: DataFrame) -> DataFrame:
    """title, refs, domains over all titles, 0 for those without any reference with an authority."""
    own = cites_from_references(refs).groupBy("title").agg(F.sum("cnt").alias("refs"), F.count_distinct("domain").alias("domains"))
    return titles.select("title").distinct().join(own, "title", "left").select("title", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("domains", F.lit(0)).alias("domains"))


def ai_shares(urls: DataFrame) -> DataFrame:
    """urls: title, url -> title, ai_site, share_id, url of links to shared assistant conversations; one per link."""
    hit = urls.select("title", "url", U.ai_share(F.col("url")).alias("hit")).where(F.col("hit").isNotNull())
    return hit.select("title", "hit.*", "url")


def book_citations(refs: DataFrame, strict: bool = False) -> DataFrame:
    """refs: title, texts (array of a reference's fields) -> title, n_refs, n_books."""
    return refs.groupBy("title").agg(F.count("*").alias("n_refs"), F.count_if(M.is_book(F.col("texts"), strict)).alias("n_books"))
