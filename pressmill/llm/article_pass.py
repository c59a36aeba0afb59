"""One pass over articles in Arrow batches: lines, their labels and the residue score, for the operators on article text.

No shuffle, no state between rows; a batch is as many rows as the session's
spark.sql.execution.arrow.maxRecordsPerBatch allows, cut further by `CHUNK`
characters, so that very long texts don't add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions.keys import letters_only
from pressmill.llm import page_lines as pages
from pressmill.llm import repeated_lines, residue
from pressmill.llm.tokens import Tokens, Vocabulary
from pressmill.session import spread, staged

CHUNK = 2_000_000


class Article:
    __slots__ = ("id", "source", "title", "lines", "kinds", "marks", "score")

    def __init__(self, id, source, title, content, recurring=None):
        self.id, self.source, self.title = id, source, title
        self.lines = content.split("\n") if content is not None else []
        self.kinds = [pages.kind(x) for x in self.lines]
        self.marks = pages.label(self.lines, title, kinds=self.kinds, recurring=recurring)
        self.score = 0.0

    @property
    def residue(self) -> bool:
        return self.score > 0.5


def source_key(source: str | None) -> str:
    return pages.letters(source or "")


class Chunk(list):
    """Articles, with the tokens of all their titles and lines (a title is line 0 of its article) where the pass needs them."""

    tokens: Tokens | None = None


def recurring(articles: DataFrame) -> dict[str, pages.Recurring] | DataFrame:
    """The recurring lines of each source: a dictionary if they are few (bounded by repeated_lines.BROADCAST_ROWS), else a table (source_key, lines)."""
    r = staged(repeated_lines.recurring_lines(articles), "recurring-lines")
    if r.count() <= repeated_lines.BROADCAST_ROWS:
        out: dict[str, dict[int, bool]] = {}
        for s, x, strong in r.collect():
            out.setdefault(s, {})[x] = strong
        return {s: pages.Recurring(x) for s, x in out.items()}
    return r.groupBy("source_key").agg(F.map_from_entries(F.collect_list(F.struct("line", "strong"))).alias("lines"))


def _read(batches: Iterator[pa.RecordBatch], model: residue.ResidueModel | None, lines: dict[str, pages.Recurring] | None, row) -> Iterator[Chunk]:
    vocabulary = Vocabulary(row)

    def scored(chunk: Chunk) -> Chunk:
        if model is not None:
            bodies = [residue.body(a.lines, a.title, a.kinds) for a in chunk]
            texts = []
            for a, b in zip(chunk, bodies):
                b.at = [n + 1 for n in b.at]
                # only lines that the model or `each` looks at; the others keep their numbers
                used = {*b.at, *(n for n, m in enumerate(a.marks, 1) if m == pages.REPORT)} if row else set(b.at)
                texts.append([(a.title or "").replace("\n", " "), *(x if n in used else "" for n, x in enumerate(a.lines, 1))])
            chunk.tokens = Tokens(texts, vocabulary)
            for a, s in zip(chunk, model.scores(bodies, [a.title for a in chunk], chunk.tokens)):
                if any(x.strip() for x in a.lines):
                    a.score = float(s)
        return chunk

    own: tuple = (None, None)
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        chunk, size = Chunk(), 0
        for r in zip(*columns):
            if lines is not None:
                known = lines.get(source_key(r[1]))
            elif len(r) > 4 and r[4]:
                if own[0] != r[4]:  # rows of a source mostly follow each other
                    own = r[4], pages.Recurring(dict(r[4]))
                known = own[1]
            else:
                known = None
            chunk.append(Article(*r[:4], known))
            size += len(r[3] or "")
            if size >= CHUNK:
                yield scored(chunk)
                chunk, size = Chunk(), 0
        if chunk:
            yield scored(chunk)


def mapped(articles: DataFrame, schema: str, arrow_schema: pa.Schema, each: Callable[[Chunk], list], model: residue.ResidueModel | None = None, lines: dict[str, pages.Recurring] | DataFrame | None = None, row: Callable[[str], int] | None = None) -> DataFrame:
    """each(chunk) gives the columns of the rows for a chunk of articles. lines: what `recurring` gives; row: numbers words for `each`, which then has the chunk's tokens."""
    held = lines if isinstance(lines, dict) else None

    def run(batches):
        for chunk in _read(batches, model, held, row):
            columns = each(chunk)
            if columns and len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow_schema.types)], schema=arrow_schema)

    a = spread(articles.select("id", "source", "title", "content"), "id")
    if isinstance(lines, DataFrame):  # too many sources to hold: each article brings its source's lines
        key = F.coalesce(letters_only(F.col("source")), F.lit(""))
        a = a.withColumn("source_key", key).join(lines, "source_key", "left").select("id", "source", "title", "content", "lines")
    return a.mapInArrow(run, schema)


def lines_outside(articles: DataFrame, model: residue.ResidueModel) -> DataFrame:
    """p7_found: (article_id, line_no) of the lines with letters that aren't the report's own; articles without a report of their own have none."""

    def each(chunk):
        ids, numbers = [], []
        for a in chunk:
            if not a.residue:
                for n, m in enumerate(a.marks, 1):
                    if m == pages.FURNITURE:
                        ids.append(a.id), numbers.append(n)
        return [ids, numbers]

    return mapped(articles, "article_id long, line_no int", pa.schema([("article_id", pa.int64()), ("line_no", pa.int32())]), each, model, recurring(articles))


def report_text(articles: DataFrame) -> DataFrame:
    """(article_id, report): the content's own lines; NULL content stays NULL."""

    def each(chunk):
        return [[a.id for a in chunk], ["\n".join(x for x, m in zip(a.lines, a.marks) if m != pages.FURNITURE) if a.lines else None for a in chunk]]

    return mapped(articles, "article_id long, report string", pa.schema([("article_id", pa.int64()), ("report", pa.string())]), each, None, recurring(articles))


def residue_found(articles: DataFrame, model: residue.ResidueModel) -> DataFrame:
    """p6_found: (article_id) of the articles whose content is no report."""

    def each(chunk):
        return [[a.id for a in chunk if a.residue]]

    return mapped(articles, "article_id long", pa.schema([("article_id", pa.int64())]), each, model)


def page_bodies(pages_df: DataFrame, id_col: str = "id", html_col: str = "raw_html") -> DataFrame:
    """(id, body): the report of each landed HTML page; "" for NULL and for pages without one."""

    def run(batches):
        for b in batches:
            ids, html = b.column(0), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([pages.html_body(h) for h in html], pa.string())], names=["id", "body"])

    return pages_df.select(F.col(id_col).cast("long"), F.col(html_col)).mapInArrow(run, "id long, body string")
