"""Cohorts: topics, regions, parties, issues, pageviews, reading members from triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import measures as M
from tandem.functions import urls as U
from tandem.operators.stats import most_common


def topics(articles: DataFrame) -> DataFrame:
    """articles: title, topics (array<string>) -> a row per topic (one with nulls for none) with its hierarchy."""
    t = articles.select("title", F.explode_outer("topics").alias("topic"))
    return t.select("title", "topic", M.topic_prefix(F.col("topic")).alias("topic_prefix"), M.topic_second(F.col("topic")).alias("topic_second"), M.region_topic(F.col("topic")).alias("region_topic"), M.topic_part(F.col("topic"), 2).alias("continent"), M.topic_part(F.col("topic"), 3).alias("subcontinent"))


def by_topic(shift: DataFrame, topic_rows: DataFrame, group: str, dedupe: bool = True) -> DataFrame:
    """shift joined with its titles' groups; dedupe=False keeps a title as often in a group as topic_rows has it, so its citations count again."""
    rows = topic_rows.where(F.col(group).isNotNull()).select("title", group)
    return shift.join(rows.distinct() if dedupe else rows, "title")


def map_regions(labels: DataFrame, regions: DataFrame) -> DataFrame:
    """labels: label; regions: region. The region whose key equals the label's, else the first by name whose key contains it, else null."""
    keyed = labels.select("label", F.lower(F.replace("label", F.lit("-"), F.lit("_"))).alias("key"))
    known = regions.select("region", M.region_key(F.col("region")).alias("rkey"))
    exact = keyed.join(known, F.col("key") == F.col("rkey"), "left").groupBy("label", "key").agg(F.min("region").alias("exact"))
    # A theta join against a dimension of regions (hundreds of rows), only for the labels still open.
    loose = exact.where("exact IS NULL").join(known, F.contains(F.col("rkey"), F.col("key"))).groupBy("label").agg(F.min("region").alias("loose"))
    return exact.join(loose, "label", "left").select("label", F.coalesce("exact", "loose").alias("region"))


def issue_counts(issues: DataFrame, order: str, k: int = 8) -> DataFrame:
    """issues: issue_type, order -> counts of the k most common types, the others as 'other'."""
    types = issues.select(order, F.posexplode(M.issue_types(F.col("issue_type"))).alias("at", "type"))
    types = types.withColumn("_seen", F.struct(order, "at"))
    top = most_common(types, "type", "_seen", k).select(F.col("type").alias("top"))
    # top has k rows at most.
    return types.join(F.broadcast(top), F.col("type") == F.col("top"), "left").groupBy(F.coalesce("top", F.lit("other")).alias("type")).agg(F.count("*").alias("count"))


#: Access types that may stand in the fourth field of a pageview line.
ACCESS = ["desktop", "mobile-web", "mobile-app", "all-sites"]


def pageview_lines(lines: DataFrame, project: str = "en.wikipedia", value: str = "value") -> DataFrame:
    """Lines 'project title page_id [access] daily_total …' -> title (lower case, spaces), page_id, views. '-', 'null' and empty titles and lines without a
    whole number are skipped."""
    p = F.split(F.col(value), " ")
    total = F.when(F.get(p, F.lit(3)).isin(ACCESS), F.coalesce(F.get(p, F.lit(4)), F.lit("0"))).otherwise(F.coalesce(F.get(p, F.lit(3)), F.lit("0")))
    rows = lines.where(F.get(p, F.lit(0)) == project).select(F.get(p, F.lit(1)).alias("raw"), F.get(p, F.lit(2)).alias("page_id"), total.try_cast("bigint").alias("views"))
    return rows.where(F.col("raw").isNotNull() & ~F.col("raw").isin("-", "null", "") & F.col("views").isNotNull()).select(F.lower(F.replace("raw", F.lit("_"), F.lit(" "))).alias("title"), "page_id", "views")


def pageview_capture(views: DataFrame, titles: DataFrame, denominator: int) -> DataFrame:
    """What the titles' views add up to, from how many pages, and their share of all views."""
    hit = views.join(titles, "title", "left_semi").agg(F.sum("views").cast("long").alias("views"), F.count_distinct("page_id").alias("pages"))
    return hit.select("views", "pages", (F.col("views") / F.lit(denominator)).alias("capture_share"))


def geo_views(views: DataFrame, countries: DataFrame) -> DataFrame:
    """views: country_code, noisy_views; countries: iso2, iso3 -> views per country, with the three-letter code where known."""
    sums = views.where(F.col("country_code").isNotNull()).groupBy("country_code").agg(F.sum("noisy_views").alias("views"))
    return sums.join(countries, F.col("country_code") == F.col("iso2"), "left").select("country_code", "iso3", "views")


def match(triples: DataFrame, predicate: str, subject: str, object_: str) -> DataFrame:
    """One triple pattern: the subjects and objects of a predicate, by the names of its variables."""
    return triples.where(F.col("predicate") == predicate).select(F.col("subject").alias(subject), F.col("object").alias(object_))


def members(triples: DataFrame, held: str, position: str, ended: str, group: str, positions: list[str]) -> DataFrame:
    """Current holders of positions with their group: basic graph patterns as joins, OPTIONAL as a left join, FILTER NOT EXISTS as an anti-join."""
    statements = match(triples, held, "person", "statement").join(match(triples, position, "statement", "position"), "statement")
    current = statements.where(F.col("position").isin(positions)).join(match(triples, ended, "statement", "end"), "statement", "left_anti")
    return current.join(match(triples, group, "statement", "party"), "statement", "left").select("person", "position", "party").distinct().orderBy("position", "person", "party")


def party_similarity(people: DataFrame, similarity: DataFrame, country: str) -> DataFrame:
    """people: title, party -> party category and similarity of the people that have one; the first party of a person counts, by name."""
    category = {"us": M.us_party, "uk": M.uk_party}[country]
    row = F.struct(*[F.col(f"`{c}`") for c in people.columns])
    # An aggregation, as in reconcile.dedup_first: null parties last.
    first = people.groupBy(F.col("title").alias("_title")).agg(F.min_by(row, F.struct(F.col("party").isNull(), "party")).alias("_row")).select("_row.*")
    return first.join(similarity, "title", "left").na.drop().withColumn("party_category", category(F.col("party")))


def controversial(titles: DataFrame) -> DataFrame:
    """titles: title (of talk and other pages) -> the distinct article titles behind them."""
    return titles.select(U.controversial_title(F.col("title")).alias("title")).where("title IS NOT NULL").distinct()
