"""Checkpointed work: what is still to do, replacing by key, invalidation after edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.model import DONE_STATES
from vellumspark.operators.chapters import latest_state


def remaining_pages(wanted: DataFrame, done: DataFrame, keys: list[str], parser_version: str, ocr: bool) -> DataFrame:
    """Wanted pages without a checkpoint of the same parser version and OCR setting."""
    valid = done.where((F.col("parser_version") == parser_version) & F.col("ocr").eqNullSafe(F.lit(ocr))).select(*keys)
    return wanted.join(valid.distinct(), keys, "left_anti")


def chapters_to_do(chapters: DataFrame, states: DataFrame, force: bool = False) -> DataFrame:
    """Chapters whose latest state is not done; all of them if forced."""
    if force:
        return chapters
    done = latest_state(states).where(F.col("status").isin(DONE_STATES)).select("book_id", "chapter_key")
    return chapters.join(done, ["book_id", "chapter_key"], "left_anti")


def replace_by_key(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows of all keys in ``fresh`` replaced."""
    return table.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def changed_chapters(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """book_id, chapter_key of chapters that are new, gone or differ in one of the fields."""
    keys = ["book_id", "chapter_key"]
    a = before.select(*keys, F.struct(*fields).alias("a"))
    b = after.select(*keys, F.struct(*fields).alias("b"))
    return a.join(b, keys, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def clip_lines(lines: DataFrame, bounds: DataFrame, slack: float = 2.0) -> DataFrame:
    """Lines inside their chapter's vertical bounds (book_id, chapter_key, page, lo, hi) on shared pages."""
    df = lines.join(bounds, ["book_id", "chapter_key", "page"], "left")
    return df.where((F.col("lo").isNull() | (F.col("y0") >= F.col("lo") - slack)) & (F.col("hi").isNull() | (F.col("y0") < F.col("hi") - slack))).drop("lo", "hi")
