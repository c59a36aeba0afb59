"""Lines repeated across one source's documents (problem 4).

Two lines are the same if equal once case and all but letters are dropped. Within
each source the lines are nodes, weighted by the documents they stand in; two
lines that follow each other (lines without letters skipped) are an edge,
weighted by how often they do. Nodes and edges of high support are kept; the connected
components of what remains are the source's boilerplate blocks, and every
occurrence of a block's line is deleted from the documents.

One document counts once for a line however often it has it, so its lines are
made distinct before they are counted: support is a plain count with a map-side
sum, and a source with a third of all rows is no hot key. A source has at most
1 / min_share times its mean number of lines as nodes, so the graph of one source
is bounded, whatever the number of its documents.

Lines are compared by 64-bit hashes of their letters. Defined results: NULL or
empty content has no lines; documents without a source belong to the source "".
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions.keys import letters_only
from pressmill.llm.page_lines import HEAD
from pressmill.session import spread, staged

#: Rows of a node table that is broadcast at most (about 40 bytes each).
BROADCAST_ROWS = 200_000


def _keys(content: Column) -> Column:
    """The letters of each line split at "\\n". Hashes are made of them by a transform of their own, so that a line is read once however often its letters are named."""
    return F.transform(F.split(content, "\n", -1), letters_only)


def line_hashes(content: Column) -> Column:
    """ARRAY<BIGINT>, one per line split at "\\n", NULL for a line without letters."""
    return F.transform(_keys(content), lambda k: F.when(k != "", F.xxhash64(k)))


def line_ids(content: Column) -> Column:
    """The same, the low 16 bits of each being those of the hash of its first HEAD letters: most lines that don't recur are told by these alone."""
    head = lambda k: F.xxhash64(F.substring(k, 1, HEAD)).bitwiseAND(F.lit(0xFFFF))
    return F.transform(_keys(content), lambda k: F.when(k != "", F.xxhash64(k).bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(head(k))))


def hashed(documents: DataFrame, doc_id: str, source: str, content: str, ids=line_hashes) -> DataFrame:
    """(doc_id, source_key, lines ARRAY<BIGINT>)."""
    d = spread(documents.select(doc_id, source, content), doc_id)
    return d.select(F.col(doc_id).alias("doc_id"), F.coalesce(letters_only(F.col(source)), F.lit("")).alias("source_key"), ids(F.col(content)).alias("lines"))


def frequent_nodes(h: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """(source_key, line, support, docs)."""
    docs = h.groupBy("source_key").agg(F.count("*").alias("docs"))
    lines = F.explode(F.array_distinct(F.filter("lines", lambda x: x.isNotNull())))
    support = h.select("source_key", lines.alias("line")).groupBy("source_key", "line").agg(F.count("*").alias("support")).where(F.col("support") >= min_docs)
    return support.join(docs, "source_key").where(F.col("support") >= F.col("docs") * F.lit(min_share)).select("source_key", "line", "support", "docs")


def occurrences(h: DataFrame, nodes: DataFrame, small: bool) -> DataFrame:
    """(doc_id, source_key, line_no, line, next): each occurrence of a node; next is the line that follows it."""
    def step(x: Column, i: Column) -> Column:
        return F.when(x.isNotNull(), F.struct((i + 1).alias("line_no"), x.alias("line")))

    kept = F.filter(F.transform("lines", step), lambda x: x.isNotNull())
    rows = h.select("doc_id", "source_key", kept.alias("k")).select(
        "doc_id", "source_key", F.explode(F.transform("k", lambda x, i: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), F.get("k", i + 1)["line"].alias("next")))).alias("o"))
    rows = rows.select("doc_id", "source_key", "o.*")
    key = nodes.select("source_key", "line")
    return rows.join(F.broadcast(key) if small else key, ["source_key", "line"], "left_semi")


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one source: its nodes and kept edges, a graph of bounded size."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(pdf["line"], pdf["next"]):
        ra = root(int(a))
        if not pd.isna(b):
            rb = root(int(b))
            parent[max(ra, rb)] = min(ra, rb)
    return pd.DataFrame({"source_key": pdf["source_key"].iloc[0], "line": list(parent), "block": [root(x) for x in parent]})


def blocks(documents: DataFrame, doc_id: str = "id", source: str = "source", content: str = "content", min_docs: int = 6, min_share: float = 0.02, edge_share: float = 0.5) -> tuple[DataFrame, DataFrame, bool]:
    """(blocks, hashed documents, whether blocks may be broadcast); blocks: (source_key, line, block, support).

    An edge is kept where it occurs at least min_docs times and it is at least edge_share of the rarer of its lines.
    """
    h = staged(hashed(documents, doc_id, source, content), "lines")  # three passes read it
    nodes = staged(frequent_nodes(h, min_docs, min_share), "nodes")
    small = nodes.count() <= BROADCAST_ROWS
    pairs = occurrences(h, nodes, small).where(F.col("next").isNotNull()).groupBy("source_key", "line", "next").agg(F.count("*").alias("w")).where(F.col("w") >= min_docs)
    other = nodes.select("source_key", F.col("line").alias("next"), F.col("support").alias("next_support"))
    edges = pairs.join(nodes, ["source_key", "line"]).join(other, ["source_key", "next"]).where(F.col("w") >= edge_share * F.least("support", "next_support"))
    graph = nodes.select("source_key", "line", F.lit(None).cast("bigint").alias("next")).unionByName(edges.select("source_key", "line", "next"))
    graph = graph.withColumn("next", F.col("next").cast("string"))  # a nullable BIGINT would reach pandas as an inexact double
    comp = graph.groupBy("source_key").applyInPandas(_components, "source_key string, line bigint, block bigint")
    return comp.join(nodes.select("source_key", "line", "support"), ["source_key", "line"]), h, small


def recurring_lines(documents: DataFrame, doc_id: str = "id", source: str = "source", content: str = "content", min_docs: int = 6, min_share: float = 0.003, strong_share: float = 0.02) -> DataFrame:
    """(source_key, line, strong): the lines, as their `line_ids`, that recur in a source; strong: in strong_share of its texts or more.

    Copies of a text count once, so that the lines of a story taken in many times aren't taken for the site's.
    """
    h = hashed(documents.where(F.col(content).isNotNull()), doc_id, source, content, line_ids)
    each = h.withColumn("whole", F.xxhash64("lines")).dropDuplicates(["source_key", "whole"])
    docs = F.struct(F.lit(None).cast("bigint").alias("line"))
    lines = F.transform(F.array_distinct(F.filter("lines", lambda x: x.isNotNull())), lambda x: F.struct(x.alias("line")))
    # the number of a source's texts is counted as the support of a line NULL: one pass
    n = each.select("source_key", F.explode(F.concat(F.array(docs), lines)).alias("l")).groupBy("source_key", "l.line").agg(F.count("*").alias("n"))
    n = staged(n.where(F.col("line").isNull() | (F.col("n") >= min_docs)), "recurring")
    total = n.where(F.col("line").isNull()).select("source_key", F.col("n").alias("docs"))
    return n.where(F.col("line").isNotNull()).join(total, "source_key").where(F.col("n") >= F.col("docs") * F.lit(min_share)).select("source_key", "line", (F.col("n") >= F.col("docs") * F.lit(strong_share)).alias("strong"))


def found(documents: DataFrame, **params) -> DataFrame:
    """p4_found: (article_id, line_no), each occurrence of a line of a block."""
    b, h, small = blocks(documents, **params)
    return occurrences(h, b, small).select(F.col("doc_id").alias("article_id"), F.col("line_no").cast("int").alias("line_no"))


def report(documents: DataFrame, **params) -> DataFrame:
    """(source_key, block, lines, support): the blocks found in each source."""
    b, _, _ = blocks(documents, **params)
    return b.groupBy("source_key", "block").agg(F.count("*").alias("lines"), F.max("support").alias("support"))


def without_blocks(documents: DataFrame, doc_id: str = "id", source: str = "source", content: str = "content", **params) -> DataFrame:
    """(doc_id, content): every document, its lines that belong to a block deleted. The lines of a source's blocks are a bounded list that rides along with its documents."""
    b, _, small = blocks(documents, doc_id, source, content, **params)
    per = b.groupBy("source_key").agg(F.collect_list("line").alias("gone"))
    d = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(letters_only(F.col(source)), F.lit("")).alias("source_key"), F.col(content).alias("content"))
    j = d.join(F.broadcast(per) if small else per, "source_key", "left")
    lines, hashes, gone = F.split("content", "\n", -1), line_hashes(F.col("content")), F.coalesce("gone", F.array().cast("array<bigint>"))
    kept = F.filter(F.arrays_zip(lines.alias("l"), hashes.alias("h")), lambda x: x["h"].isNull() | ~F.array_contains(gone, x["h"]))
    return j.select("doc_id", F.array_join(F.transform(kept, lambda x: x["l"]), "\n").alias("content"))
