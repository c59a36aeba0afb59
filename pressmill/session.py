"""Session defaults and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "pressmill", **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", "12g")
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.showConsoleProgress", "false")
    for k, v in {**DEFAULTS, **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once an application, so that Arrow functions find it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pressmill-"), "pressmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. TIMESTAMP_NTZ columns come out as UTC TIMESTAMP."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = {f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    if not ntz:
        return df
    return df.select(*[F.to_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone()).alias(c) if c in ntz and spark.conf.get("spark.sql.session.timeZone") != "UTC"
                       else F.col(c).cast("timestamp").alias(c) if c in ntz else F.col(c) for c in df.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named in spark.checkpoint.dir. Unset, it becomes a new local one where all executors are on this machine (as in tests); elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pressmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a name, in the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def staged(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage, survives lost executors. The copy goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(partition) if partition else w).parquet(path)
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def version_of(spark: SparkSession, path: str) -> tuple:
    """What changes when a file or folder is written anew: names, sizes and times of its files."""
    fs, p = hadoop_path(spark, path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)))


def spread(df: DataFrame, key: str, least_rows: int = 2_000) -> DataFrame:
    """df itself if its rows lie in as many partitions as there are cores, else spread over them by key.

    For a file of few row groups before work that is heavy per row; tables of many files are never shuffled here.
    The rows of each partition are counted from the footers, no column is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores:
        return df
    held = [r[0] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).select("n").collect()]
    return df if len(held) >= cores or sum(held) < least_rows else df.repartition(2 * cores, key)
