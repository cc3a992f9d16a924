"""What the queries share: deduplicated tables and the SQL that gives the same."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession

from vellumspark.model import once
from vellumspark.session import table


def lines(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "lines"), "line_id")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "blocks"), "block_id")


def paras(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "paras"), "para_id")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def chapters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chapters").drop("loaded_at").distinct()


# The same in SQL: rows delivered again differ in loaded_at only.
LINES = "l AS (SELECT DISTINCT line_id, book_id, chapter_key, page, seq, x0, y0, x1, y1, size, bold, italic, raw, zone, box, conf FROM lines)"
BLOCKS = "b AS (SELECT DISTINCT block_id, book_id, chapter_key, seq, block_type, section_id, md, raw, clean, pages, conf, h_level, heading_path, flags FROM blocks)"
PARAS = "p AS (SELECT DISTINCT para_id, block_id, book_id, chapter_key, seq, page, text, size, bold, n_lines, kind, marker FROM paras)"
CHAPTERS = "c AS (SELECT DISTINCT book_id, chapter_key, chapter_no, title, page_from, page_to, confidence, found_by FROM chapters)"


# What NFKC makes of a character, beyond NFC, by rule; for the SQL side, which has NFC only.
_COMPAT = [(chr(k), x) for k in range(0xA0, 0x3000) if (x := unicodedata.normalize("NFKC", chr(k))) != unicodedata.normalize("NFC", chr(k))]
_COMPAT += [(chr(k), unicodedata.normalize("NFKC", chr(k))) for k in [*range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


COMPAT = "kc AS (SELECT * FROM (VALUES " + ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in _COMPAT) + ") t(ch, to_ch))"
