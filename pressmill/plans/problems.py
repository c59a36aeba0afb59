"""Queries of the general data-quality problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.operators import instants
from pressmill.plans.common import SQL_UTC
from pressmill.session import staged, table

#: Fixed value: the one form that needs no conversion.
EXACT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, utc_us) of the articles whose published_at denotes an instant and isn't in its final form already."""
    r = instants.utc_instants(table(spark, sf_dir, "articles"), table(spark, sf_dir, "outlets"))
    return r.where(F.col("utc_us").isNotNull() & ~F.col("published_at").rlike(EXACT)).select("article_id", "utc_us")


def p2_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone of each outlet, as declared and as estimated from its timestamps, with the costs."""
    o = table(spark, sf_dir, "outlets")
    local = staged(instants.read_local(table(spark, sf_dir, "articles"), o), "local")
    z = instants.estimate_zones(local, o.select(F.col("site_zone").alias("zone")))
    return z.withColumns({"cost": F.round("cost", 6), "declared_cost": F.round("declared_cost", 6)})


QUERIES = {"p2_found": p2_found, "p2_zones": p2_zones}
SQL = {"p2_found": " ".join(f"WITH {SQL_UTC} SELECT utc.id AS article_id, utc_us FROM utc JOIN articles ON articles.id = utc.id WHERE utc_us IS NOT NULL AND NOT regexp_full_match(published_at, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z')".split())}
