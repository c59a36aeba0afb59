"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm import article_pass, canonical, languages, leaks, packing, repeated_lines, residue, spam, truncation
from pressmill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, category_id) of the typed sections that aren't names of the list as they stand."""
    return canonical.found(table(spark, sf_dir, "articles"), table(spark, sf_dir, "category_list"))


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(typed, n): the typed values that fit no entry, with their number."""
    s = canonical.article_sections(table(spark, sf_dir, "articles"), table(spark, sf_dir, "category_list"))
    return s.where(F.col("typed").isNotNull() & (F.col("category_id") == 0)).groupBy("typed").agg(F.count("*").alias("n"))


def p1_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, entry, distance): for each different typed section all entries within the distance."""
    s = canonical.typed_sections(table(spark, sf_dir, "articles"))
    return canonical.candidates(s, "typed", table(spark, sf_dir, "category_list"), "category_id", "category_name", "known_as")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, line_no) of the lines repeated throughout an outlet's stories."""
    return repeated_lines.found(table(spark, sf_dir, "articles"))


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_key, block, lines, support): the blocks of each outlet."""
    return repeated_lines.report(table(spark, sf_dir, "articles"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): every article without the repeated lines."""
    return repeated_lines.without_blocks(table(spark, sf_dir, "articles"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, lang) of the articles whose language label is missing, wrong, or one of several."""
    return languages.found(table(spark, sf_dir, "articles"), table(spark, sf_dir, "article_labels"))


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, lang, words, confidence) of every article."""
    return languages.languages(table(spark, sf_dir, "articles"))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, line_no, first_word, last_word, lang, confidence): the passages of every article by language; line 0 is the title."""
    return languages.segments_of(table(spark, sf_dir, "articles"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id) of the articles whose content breaks off."""
    return truncation.found(table(spark, sf_dir, "articles"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_key, articles, cut, share): how often each outlet truncates."""
    return truncation.shares(table(spark, sf_dir, "articles"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id) of the articles whose content is template residue, filler or a message."""
    a = table(spark, sf_dir, "articles")
    return article_pass.residue_found(a, residue.train(a))


def p6_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's figures on outlets it hasn't seen."""
    return residue.validation(table(spark, sf_dir, "articles"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, line_no) of the lines that aren't the report's own."""
    a = table(spark, sf_dir, "articles")
    return article_pass.lines_outside(a, residue.train(a))


def p7_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, report): the main body of every article."""
    return article_pass.report_text(table(spark, sf_dir, "articles"))


def p7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, body): the main body of every landed HTML page."""
    return article_pass.page_bodies(table(spark, sf_dir, "raw_articles"))


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_name, pack_id, doc_id, piece_no, tokens): the pack of every document, for each capacity."""
    return packing.packs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_name, packs, least, unused) for each capacity."""
    return packing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_name, documents, whole, missing, overfull, cut): all documents are placed, and nothing that must not be."""
    return packing.invariants(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of the documents that carry an item's wording."""
    return leaks.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, documents): the items that leaked."""
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the documents that are search spam."""
    return spam.found(table(spark, sf_dir, "documents"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, share) of every document: the share of its characters that is there for search."""
    return spam.shares(table(spark, sf_dir, "documents"))


_P4 = r"""WITH l AS (SELECT id, regexp_replace(lower(source), '[^\p{L}]', '', 'g') AS s, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM articles),
  k AS (SELECT id, s, line_no, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS w FROM l), d AS (SELECT regexp_replace(lower(source), '[^\p{L}]', '', 'g') AS s, COUNT(*) AS docs FROM articles GROUP BY 1),
  f AS (SELECT s, w, COUNT(DISTINCT id) AS n FROM k WHERE w <> '' GROUP BY s, w)
  SELECT k.id AS article_id, k.line_no::INTEGER AS line_no FROM k JOIN f ON f.s = k.s AND f.w = k.w JOIN d ON d.s = k.s WHERE f.n >= 6 AND f.n >= 0.02 * d.docs"""

_P4_CLEAN = f"""WITH x AS ({_P4}), l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM articles WHERE content IS NOT NULL),
  k AS (SELECT l.id, string_agg(line, chr(10) ORDER BY l.line_no) AS content FROM l WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.article_id = l.id AND x.line_no = l.line_no) GROUP BY l.id)
  SELECT a.id AS doc_id, CASE WHEN a.content IS NOT NULL THEN COALESCE(k.content, '') END AS content FROM articles a LEFT JOIN k ON k.id = a.id"""
_WORDS = r"""list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower(text), '[-\x{2010}\x{ad}]\s*\n\s*', '', 'g'), '[—–/…]', ' ', 'g'), '[^\p{L}\p{N}\s\x{a0}]', '', 'g'), '[\s\x{a0}]+'), lambda x: x <> '')"""
_P9 = rf"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
  ig AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12) q),
  own AS (SELECT g, MIN(item_id) AS item_id FROM ig GROUP BY g HAVING COUNT(DISTINCT item_id) = 1),
  dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12) q)
  SELECT DISTINCT doc_id, item_id FROM dg JOIN own ON own.g = dg.g"""

_ALL = (
    p1_found, p1_unmatched, p1_candidates, p3_found, p3_languages, p3_segments, p4_found, p4_blocks, p4_clean, p5_found, p5_shares, p6_found, p6_validation,
    p7_found, p7_reports, p7_pages, p8_packs, p8_report, p8_invariants, p9_found, p9_items, p10_found, p10_shares,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {
    "p4_found": " ".join(_P4.split()),
    "p4_clean": " ".join(_P4_CLEAN.split()),
    "p8_invariants": "SELECT DISTINCT pack_name, (SELECT COUNT(DISTINCT doc_id) FROM documents) AS documents, true AS whole, 0::BIGINT AS missing, 0::BIGINT AS overfull, 0::BIGINT AS cut FROM pack_sizes WHERE capacity_tokens >= 1",
    "p9_found": " ".join(_P9.split()),
    "p9_items": f"SELECT item_id, COUNT(*) AS documents FROM ({' '.join(_P9.split())}) q GROUP BY item_id",
}
