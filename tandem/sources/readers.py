"""Sources and sinks: NDJSON with bad lines skipped, URL and slug lists, wikitext source tables, tar archives of NDJSON, pageview dumps; text, CSV, JSON
and dead-letter sinks. Paths are any that Spark's file systems open."""

from __future__ import annotations

import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import measures as M
from tandem.functions import urls as U
from tandem.operators import structure as T
from tandem.sources.schemas import ARTICLES_A, ARTICLES_B, FIXED_ISSUES, METADATA


#: Patterns of the wikitext tables.
ROW_START = r"(?m)^\s*\|-"
CLASS = r'class="s-([^"]+)"'
ID = r'id="([^"]+)"'
LINK = r"\[\[([^|\[\]]+)(?:\|[^\]]+)?\]\]"
SORT_VALUE = r'data-sort-value="([^"]+)"'
STATUS = r"\{\{WP:RSPSTATUS\|([^}|]+)"
USES = r"\{\{WP:RSPUSES\|([^}]+)\}\}"
LAST = r"\{\{WP:RSPLAST\|(\d{4})"


def ndjson(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object per line; blank and malformed lines are skipped. With the file name and, as rows of a file come in order, an ingest order."""
    rows = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ingest"))
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def failures(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The malformed lines, for a dead-letter sink."""
    rows = spark.read.text(path)
    return rows.where((F.trim("value") != "") & F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull())


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """url: from JSON lines with url, a JSON list or {"urls": [...]}, or plain text, by the file's suffix."""
    if path.endswith((".jsonl", ".ndjson")):
        out = spark.read.schema("url string").json(path)
    elif path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        out = whole.select(F.explode(F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "urls array<string>")["urls"])).alias("url"))
    else:
        out = spark.read.text(path).select(F.trim("value").alias("url"))
    return out.where(F.coalesce("url", F.lit("")) != "")


def slugs(spark: SparkSession, path: str) -> DataFrame:
    """title and slug of a text list of titles; of a URL list the slug is its page's."""
    rows = url_list(spark, path).withColumnRenamed("url", "title")
    return rows.select("title", F.coalesce(U.page_slug(F.col("title")), U.title_to_slug(F.col("title"))).alias("slug"))


def titles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("title").orderBy("title")


def pageviews(spark: SparkSession, path: str) -> DataFrame:
    """Lines of pageview dumps, compressed or not; bytes that aren't UTF-8 are replaced."""
    return spark.read.text(path).select(F.make_valid_utf8("value").alias("value"))


def csv_table(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV files with a header, by a declared schema; a header of other names is an error. Cells that don't fit their type are null."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"').csv(path)


def discovered(spark: SparkSession, path: str | list[str], status: str = "exists") -> DataFrame:
    """title, url of the probed pages of a status, a URL once."""
    return ndjson(spark, path, "title string, url string, status string").where((F.col("status") == status) & F.col("url").isNotNull()).groupBy("url").agg(F.min("title").alias("title")).select("title", "url")


def retry_urls(spark: SparkSession, failed: str | list[str]) -> DataFrame:
    """url, retry: the distinct URLs of failed fetches and how to spell them at the next attempt."""
    return ndjson(spark, failed, "url string, error string").where("url IS NOT NULL").select("url").distinct().select("url", U.retry_url(F.col("url")).alias("retry"))


def paged_json(spark: SparkSession, path: str | list[str], items: str, schema: str) -> DataFrame:
    """The items of pre-fetched pages of a cursor-paged API: a JSON object per file, whose list `items` holds rows of the schema. A page without it has none."""
    page = spark.read.text(path, wholetext=True).select(F.from_json("value", f"`{items}` array<struct<{schema}>>")[items].alias("rows"))
    return page.select(F.inline("rows"))


def geojson_attributes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The properties of a feature collection's features, by a declared schema; geometries aren't read."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.inline(F.transform(F.from_json("value", f"features array<struct<properties:struct<{schema}>>>")["features"], lambda f: f["properties"])))


def domain_map(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """title, domain, cnt of domain maps: JSON lines {title, domains: {domain: count}}, or a JSON list of {title: {domain: count}} by the suffix .json
    of a single file. A title without domains is a row with null domain and count 0."""
    if isinstance(path, str) and path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<map<string,map<string,bigint>>>")).alias("m"))
        rows = whole.select(F.explode("m").alias("title", "domains"))
    else:
        rows = spark.read.schema("title string, domains map<string,bigint>").json(path)
    return rows.select("title", F.explode_outer("domains").alias("domain", "cnt")).select("title", "domain", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def articles_a(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """title, text of corpus A's article dumps; articles without a name or text don't count."""
    rows = ndjson(spark, path, ARTICLES_A).select(F.col("name").alias("title"), T.text_a(F.col("sections")).alias("text"))
    return rows.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))


def articles_b(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """title, text of corpus B's scraped articles; articles without a title or text don't count."""
    rows = ndjson(spark, path, ARTICLES_B).select("title", T.text_b(F.col("data.sections")).alias("text"))
    return rows.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))


def fixed_issues(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row per issue, its fields as columns: slug, criticality, issueType, fixedIssuesCount, fetched_at; a slug without issues is one row of nulls."""
    rows = ndjson(spark, path, FIXED_ISSUES).select("slug", F.explode_outer("fixedIssues").alias("issue"), "fixedIssuesCount", "fetched_at")
    return rows.select("slug", "issue.*", "fixedIssuesCount", "fetched_at")


def article_metadata(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """title, quality_class, quality, topics (names by falling score), failed (an error was recorded); what a line lacks is null."""
    rows = ndjson(spark, path, METADATA)
    ranked = F.sort_array(F.transform("topic_data.prediction.results", lambda t: F.struct((-t["score"]).alias("minus"), t["topic"].alias("topic"))))
    topics = F.coalesce(F.transform(ranked, lambda t: t["topic"]), F.array().cast("array<string>"))
    return rows.select("title", F.col("quality_data.class").alias("quality_class"), F.col("quality_data.quality").alias("quality"), topics.alias("topics"), (F.coalesce(F.size("errors"), F.lit(0)) > 0).alias("failed"))


def files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, size, modified of the files under a path of any store, by name's end; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.where(F.col("path").endswith(suffix))


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """Gets or puts one file or folder between any two stores, replacing the target."""
    conf, jpath = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    a, b = jpath(source), jpath(target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def reliability_table(spark: SparkSession, path: str) -> DataFrame:
    """domain, source_name, source_id, reliability_status, last_updated of wikitext source tables, one file at a time as a whole."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value"))
    row = whole.select(F.split("value", ROW_START).alias("rows")).select(F.explode(F.slice("rows", 2, F.size("rows"))).alias("row"))
    head = F.substring_index("row", "\n", 1)
    row = row.select("row", F.regexp_extract(head, r'class="s-([^"]+)"', 1).alias("code"), F.regexp_extract(head, r'id="([^"]+)"', 1).alias("source_id"))
    row = row.where("code <> '' AND source_id <> ''")
    # A line '| …' or '|{…' starts a cell, another line with '|' goes on with the one before.
    lines = F.filter(F.transform(F.split(F.regexp_replace("row", r"^[^\n]*\n?", ""), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.startswith("|+"))
    rest = lambda x: x.substr(F.lit(2), F.length(x))
    cells = F.aggregate(
        lines, F.array().cast("array<string>"),
        lambda acc, x: F.when(F.trim(rest(x)) == "", F.when((F.size(acc) > 0) & x.startswith("| "), F.concat(acc, F.array(F.lit("")))).otherwise(acc))
        .when((F.size(acc) == 0) | x.startswith("| ") | x.startswith("|{"), F.concat(acc, F.array(F.trim(rest(x)))))
        .otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), F.trim(rest(x)))))),
    )
    row = row.select("code", "source_id", cells.alias("c")).where(F.size("c") >= 6)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("c")[0], r"\{\{[^}]+\}\}", ""), r"\[\[[^\]]+\]\]", ""), "''([^']+)''", "$1"))
    first_of = lambda text, *patterns: F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])
    name = F.coalesce(first_of(F.col("c")[0], LINK, SORT_VALUE), plain)
    code = F.coalesce(first_of(F.col("c")[1], STATUS), F.col("code"))
    names = F.create_map(*[F.lit(x) for kv in M.STATUS_CODES.items() for x in kv])
    uses = F.filter(F.transform(F.split(F.regexp_extract(F.col("c")[5], USES, 1), r"\|"), lambda x: F.trim(x)), lambda d: (d != "") & ~d.startswith("["))
    out = row.select(F.explode(uses).alias("d"), name.alias("source_name"), "source_id", F.coalesce(F.try_element_at(names, code), code).alias("reliability_status"), first_of(F.col("c")[3], LAST).cast("int").alias("last_updated"))
    domain = F.trim(F.lower(F.substring_index(F.regexp_replace(F.regexp_replace(F.split_part(F.split_part("d", F.lit("}}"), F.lit(1)), F.lit(" "), F.lit(1)), "^https?://", ""), r"^www\.", ""), "/", 1)))
    return out.select(domain.alias("domain"), "source_name", "source_id", "reliability_status", "last_updated").where("domain <> '' AND source_name <> ''")


def tar_lines(spark: SparkSession, path: str) -> DataFrame:
    """member, value: the lines of .ndjson members of tar archives, compressed or not. An archive is read by one task, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, where = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name.removeprefix("file:"))
                with system.open_input_stream(where, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                    for member in tar:
                        if not member.isfile() or not member.name.endswith(".ndjson"):
                            continue
                        names, lines = [], []
                        for line in tar.extractfile(member):
                            if line.strip():
                                names.append(member.name)
                                lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                            if len(lines) >= 1000:
                                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(lines)], names=["member", "value"])
                                names, lines = [], []
                        if lines:
                            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(lines)], names=["member", "value"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "member string, value string")


def extract_titles(spark: SparkSession, path: str, wanted: DataFrame, title: str = "$.name") -> DataFrame:
    """Lines of tar archives whose title is wanted (a column title)."""
    lines = tar_lines(spark, path).withColumn("title", F.get_json_object("value", title))
    return lines.join(wanted.select("title"), "title", "left_semi")


def write_domain_map(cites: DataFrame, path: str, titles: DataFrame | None = None) -> None:
    """JSON lines {title, domains: {domain: count}}; a title's domains are one document by the format. titles: all titles, so those without any reference
    have an empty map."""
    maps = cites.groupBy("title").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "cnt")))).alias("domains"))
    if titles is not None:
        maps = titles.select("title").distinct().join(maps, "title", "left").select("title", F.coalesce("domains", F.create_map().cast("map<string,bigint>")).alias("domains"))
    maps.write.mode("overwrite").json(path)


def rewrite_ndjson(df: DataFrame, path: str) -> None:
    """Replaces the JSON lines at a path by df, which may be read from it: written beside it, then renamed. Readers see the old rows or the new ones."""
    spark = df.sparkSession
    path = path.rstrip("/")
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.json(fresh)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    system = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = system.exists(jpath(path))
    if had and not system.rename(jpath(path), jpath(old)) or not system.rename(jpath(fresh), jpath(path)):
        raise OSError(f"{path}: can't rename; the new rows are at {fresh}")
    if had:
        system.delete(jpath(old), True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A text list; nulls are dropped."""
    df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    df.write.mode("overwrite").partitionBy(shard).json(path)
