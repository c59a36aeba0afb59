"""Readers of landed data: Parquet, JDBC, JSON arrays, RSS, sitemaps, aggregator feeds, HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import html as pages
from pressmill.functions.dates import rfc2822
from pressmill.functions.urls import canonical_url, redirect_target

RSS_ITEM = "title string, link string, description string, pubDate string, category string, `content:encoded` string"


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def jdbc(spark: SparkSession, url: str, query: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table or query of a database, read in parallel by ranges of a column where one is named."""
    r = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column and bounds:
        r = r.option("dbtable", f"({query}) q").option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    else:
        r = r.option("query", query)
    return r.load()


def json_array(spark: SparkSession, path: str, schema: str | None = None, per_line: bool = False) -> DataFrame:
    """The records of files that hold one JSON array each, or, which can be split, one a line."""
    r = spark.read.option("multiLine", not per_line)
    return (r.schema(schema) if schema else r).json(path)


def rss(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, description, content, category, published) of the items of RSS files; dates that can't be read are NULL."""
    x = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    return x.select("title", F.trim("link").alias("url"), "description", F.col("`content:encoded`").alias("content"), "category", rfc2822(F.trim("pubDate")).alias("published"))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url, modified) of sitemap files."""
    x = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return x.select(F.trim("loc").alias("url"), F.col("lastmod").alias("modified"))


def aggregator(spark: SparkSession, path: str) -> DataFrame:
    """RSS items whose link leads through an aggregator: the real URL, canonical."""
    return rss(spark, path).withColumn("url", canonical_url(redirect_target(F.col("url"))))


def discovered_links(landed: DataFrame, id_col: str, html_col: str, base_col: str | None = None) -> DataFrame:
    """(id, pos, url, text): the links of each page in order, each URL once, with the place of its first occurrence."""
    base = F.col(base_col) if base_col else F.lit(None).cast("string")
    p = landed.select(F.col(id_col).alias("id"), pages.parsed(F.col(html_col), base).alias("p"))
    links = p.select("id", F.posexplode("p.links").alias("pos", "l")).select("id", "pos", F.col("l.url").alias("url"), F.col("l.text").alias("text"))
    return links.groupBy("id", "url").agg(F.min(F.struct("pos", "text")).alias("f")).select("id", "f.pos", "url", "f.text")


def stubs(links: DataFrame, least_title: int = 10, most: int = 20) -> DataFrame:
    """Links as articles without content: the first `most` of each page whose text is longer than `least_title`."""
    kept = links.where(F.length("text") > least_title)
    from pressmill.operators.relational import top_k_per_key

    return top_k_per_key(kept, ["id"], [F.col("pos"), F.col("url")], most).select("id", "url", F.col("text").alias("title"), F.lit(None).cast("string").alias("content"))
