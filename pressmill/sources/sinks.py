"""Writers: append with ids, merge, conditional append, batched rewrite, JSON export, run log, cached results."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.operators.relational import append_absent, merge_latest
from pressmill.session import hadoop_path, staged


def with_ids(df: DataFrame, key: str, into: str = "id") -> DataFrame:
    """A stable id from the key, so that a retried write gives the same ids; positive."""
    return df.withColumn(into, F.abs(F.xxhash64(key)))


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def _replace(spark: SparkSession, new: str, old: str) -> None:
    """Puts folder `new` in the place of `old`, which stays beside it until that is done; an interrupted call is undone by `_recover`."""
    fs, source = hadoop_path(spark, new)
    target, aside = hadoop_path(spark, old)[1], hadoop_path(spark, _aside(old))[1]
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"can't move {old} aside")
    if not fs.rename(source, target):
        fs.rename(aside, target)
        raise OSError(f"can't move {new} to {old}")
    fs.delete(aside, True)


def _aside(path: str) -> str:
    """A hidden name beside a folder."""
    head, _, name = path.rstrip("/").rpartition("/")
    return f"{head}/.{name}.old"


def _recover(spark: SparkSession, folder: str) -> None:
    """Ends what an interrupted `_replace` left: a folder set aside comes back where its place is empty, else it goes."""
    fs, p = hadoop_path(spark, folder)
    if not fs.exists(p):
        return
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if name.startswith(".") and name.endswith(".old"):
            place = hadoop_path(spark, f"{folder.rstrip('/')}/{name[1:-4]}")[1]
            if not fs.exists(place):
                fs.rename(f.getPath(), place)
            else:
                fs.delete(f.getPath(), True)


#: Parts of a merged table, by a hash of its key.
BUCKETS = 64


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The table that `upsert` keeps."""
    return spark.read.parquet(path).drop("bucket")


def upsert(changes: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Merges changes into a Parquet folder by key, latest wins; running it twice changes nothing. One writer at a time.

    The table lies in buckets by key. Only those that the changes touch are read and written anew, beside the old ones,
    and then take their places one by one.
    """
    spark = changes.sparkSession
    ch = staged(changes.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "changes")
    touched = sorted(r[0] for r in ch.select("bucket").distinct().collect())  # at most `buckets`
    if not touched:
        if not _exists(spark, path):  # an empty table, with its columns
            ch.drop("bucket").limit(0).coalesce(1).write.parquet(f"{path.rstrip('/')}/bucket=0")
        return
    _recover(spark, path)
    if _exists(spark, path):
        target = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(*ch.columns)
    else:
        target = ch.limit(0)
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    merge_latest(target, ch, ["bucket", *keys], order).repartition("bucket").write.partitionBy("bucket").parquet(fresh)
    fs, folder = hadoop_path(spark, path)
    fs.mkdirs(folder)
    for b in touched:
        _replace(spark, f"{fresh}/bucket={b}", f"{path.rstrip('/')}/bucket={b}")
    fs.delete(hadoop_path(spark, fresh)[1], True)


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key isn't there yet, and gives them back as they were written."""
    spark = rows.sparkSession
    target = spark.read.parquet(path) if _exists(spark, path) else rows.limit(0)
    batch = f"{path.rstrip('/')}.in-{uuid.uuid4().hex}"
    append_absent(target, rows, key).write.parquet(batch)
    fresh = spark.read.parquet(batch)
    fresh.write.mode("append").parquet(path)
    return fresh


def rewrite(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """UPDATE ... SET ... WHERE: the columns given take a new value where the condition holds."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


RUN = "run_id string, source string, status string, articles_scraped int, error_message string, started_at timestamp, completed_at timestamp, execution_time_ms long"


def start_run(spark: SparkSession, path: str, run_id: str, source: str, at) -> None:
    """Opens a run in the log: one row, status "partial" until it is closed."""
    upsert(spark.createDataFrame([(run_id, source, "partial", None, None, at, None, None)], RUN), path, ["run_id"], ["started_at"])


def finish_run(spark: SparkSession, path: str, run_id: str, status: str, articles: int, at, error: str | None = None) -> None:
    """Closes a run: status, rows, time taken. An unknown run is an error."""
    if status not in ("success", "error", "partial"):
        raise ValueError(f"no such status: {status}")
    open_row = merged(spark, path).where(F.col("run_id") == run_id)
    if open_row.isEmpty():
        raise ValueError(f"no such run: {run_id}")
    took = ((F.unix_micros(F.lit(at).cast("timestamp")) - F.unix_micros("started_at")) / 1000).cast("long")
    values = {"status": F.lit(status), "articles_scraped": F.lit(articles).cast("int"), "error_message": F.lit(error).cast("string"), "completed_at": F.lit(at).cast("timestamp"), "execution_time_ms": took}
    upsert(open_row.withColumns(values), path, ["run_id"], ["started_at"])


def dashboard_documents(daily: DataFrame, by_source: DataFrame) -> DataFrame:
    """(name, json): the dashboard as the export writes it: its days in order, its sources, and a summary derived from both."""
    days = daily.agg(F.to_json(F.sort_array(F.collect_list(F.struct("day", *[c for c in daily.columns if c != "day"])))).alias("json"))
    sources = by_source.agg(F.to_json(F.sort_array(F.collect_list(F.struct("source", *[c for c in by_source.columns if c != "source"])))).alias("json"))
    total = daily.agg(F.sum("analyses").alias("analyses"), F.sum("positive").alias("positive"), F.sum("negative").alias("negative"), F.sum("neutral").alias("neutral"), F.count("*").alias("days"))
    n = by_source.agg(F.sum("articles").alias("articles"), F.count("*").alias("sources"))
    one = total.withColumn("_k", F.lit(1)).join(n.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each
    share = lambda c: F.round(F.try_divide(F.col(c) * 100.0, F.col("positive") + F.col("negative") + F.col("neutral")), 1).alias(f"{c}_pct")
    summary = one.select(F.to_json(F.struct("articles", "sources", "analyses", "days", *[share(c) for c in ("positive", "negative", "neutral")])).alias("json"))
    named = lambda df, name: df.select(F.lit(name).alias("name"), "json")
    return named(days, "days").unionByName(named(sources, "sources")).unionByName(named(summary, "summary"))


def cache_key(name: str, **params) -> str:
    """A digest of the sorted parameters."""
    return name + "-" + hashlib.md5(":".join(f"{k}={v}" for k, v in sorted(params.items())).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, name: str, make, **params) -> DataFrame:
    """A result kept as Parquet under its parameters; made on the first call."""
    path = f"{folder.rstrip('/')}/{cache_key(name, **params)}"
    if not _exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clear_cached(spark: SparkSession, folder: str, name: str | None = None) -> int:
    """Drops the kept results of a name, or all; gives their number."""
    fs, p = hadoop_path(spark, folder)
    gone = [f.getPath() for f in (fs.listStatus(p) if fs.exists(p) else []) if name is None or re.fullmatch(re.escape(name) + "-[0-9a-f]{32}", f.getPath().getName())]
    return sum(bool(fs.delete(x, True)) for x in gone)
