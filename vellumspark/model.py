"""Record schemas, ordered severities and limits that several operators share."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = "line_id bigint, book_id string, chapter_key string, page int, seq int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, italic boolean, raw string, zone string, box int, conf double"
PARA = "para_id bigint, block_id bigint, book_id string, chapter_key string, seq int, page int, text string, size double, bold boolean, n_lines int, kind string, marker string"
BLOCK = "block_id bigint, book_id string, chapter_key string, seq int, block_type string, section_id string, md string, raw string, clean string, pages array<int>, conf double, h_level int, heading_path array<string>, flags array<string>"
SPAN = "text string, bits int, mark int"
ISSUE = "book_id string, chapter_key string, severity string, code string, message string, page int, block_id bigint"

BOLD, ITALIC, SUP, SUB = 1, 2, 4, 8

# Order of severities, states in which a chapter is done, search types of block types, chunk budget.
SEVERITY = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
DONE_STATES = ["COMPLETED", "COMPLETED_WITH_WARNINGS", "REVIEW_REQUIRED"]
CONTENT_TYPE = {
    "paragraph": "text", "heading": "heading", "list": "list", "table": "table", "figure": "figure", "callout": "callout",
    "reference": "reference", "footnote": "text", "unreadable": "figure", "formula": "text", "caption": "figure",
}
CHUNK_CHARS = 2200


def literal_map(of: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(of.items())])


def severity_rank(severity: Column) -> Column:
    return literal_map(SEVERITY)[severity]


def once(df: DataFrame, key: str) -> DataFrame:
    """One row of each identifier: rows are delivered again with a later loaded_at and the same content."""
    return df.drop("loaded_at").dropDuplicates([key]) if "loaded_at" in df.columns else df.dropDuplicates([key])
