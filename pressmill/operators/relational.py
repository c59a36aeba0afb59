"""Relational operators that recur: latest per key, top-k, merge, deduplication, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.session import staged


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, that with the greatest order columns (NULLs least). An aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, that with the least order columns."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; the window's limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def merge_latest(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: rows of both, one per key; on a conflict the change wins, of several changes the latest. Idempotent."""
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, ["_new", *order]).drop("_new")


def append_absent(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key target doesn't have, one per key; rows without a key are left out."""
    fresh = rows.where(F.col(key).isNotNull()).join(target.select(key), key, "left_anti")
    return fresh.dropDuplicates([key])


#: Rows up to whose place a page is a plain top-k.
NEAR = 10_000


def page(df: DataFrame, order: list[Column], offset: int, limit: int, near: int = NEAR) -> DataFrame:
    """Rows offset .. offset + limit - 1 of a total order (the caller adds a unique last column), in no order of their own.

    Pages near the front are a top-k. For a deep one the rows are sorted by range and numbered within each range; only the
    numbers of rows of the ranges reach the driver. `page_after` needs neither.
    """
    if offset + limit <= near:
        return df.orderBy(*order).offset(offset).limit(limit)
    s = staged(df.orderBy(*order).withColumn("_n", F.monotonically_increasing_id()), "page")
    part, at = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, {}
    for r in s.groupBy(part.alias("p")).agg(F.count("*").alias("k")).orderBy("p").collect():
        if before < offset + limit and before + r.k > offset:
            starts[r.p] = before
        before += r.k
    if not starts:
        return s.limit(0).drop("_n")
    base = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    place = F.try_element_at(base, part) + at
    return s.where(part.isin(*starts) & (place >= offset) & (place < offset + limit)).drop("_n")


def page_after(df: DataFrame, keys: list[tuple[str, bool]], last: tuple | None, limit: int) -> DataFrame:
    """The `limit` rows that follow the row with the key values `last` (None: the first rows). keys: (column, descending), together unique and never NULL.

    The condition reaches the scan, and what is merged is one page, however deep.
    """
    if last is not None:
        after = F.lit(False)
        for k in range(len(keys) - 1, -1, -1):
            (c, down), v = keys[k], F.lit(last[k])
            after = ((F.col(c) < v) if down else (F.col(c) > v)) | ((F.col(c) == v) & after)
        df = df.where(after)
    return df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in keys]).limit(limit)


def optional_filters(df: DataFrame, **equals) -> DataFrame:
    """Equality filters for the values that are given."""
    for c, v in equals.items():
        if v is not None:
            df = df.where(F.col(c).isin(v) if isinstance(v, (list, tuple)) else F.col(c) == v)
    return df


def union_in_priority(parts: list[DataFrame], key: str, enough: int, order: str) -> DataFrame:
    """Rows of the first source, of the next only while those before it hold fewer than `enough`; one row per key, the earliest source's; in order.

    The running number of each source is a window over one row a source, not over the rows.
    """
    from functools import reduce

    tagged = reduce(DataFrame.unionByName, [p.withColumn("_source", F.lit(k)) for k, p in enumerate(parts)])
    each = tagged.groupBy("_source").agg(F.count("*").alias("n"))
    before = each.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = tagged.join(before.where(F.col("before") < enough).select("_source"), "_source", "left_semi")
    return first_per_key(kept, [key], ["_source", order]).orderBy("_source", order).drop("_source")
