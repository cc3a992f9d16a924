"""Chapters of a book: detection from several sources, ends, parts, keys, validation, states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import chapter_title
from vellumspark.model import DONE_STATES

# Titles that are no chapters.
MATTER = (
    r"(?i)^(contents?|table of contents|index|preface|foreword|acknowledg\w*|copyright|title page|cover|about the authors?|dedication|list of contributors|contributors|front matter|back matter)\b"
)
PART = r"(?i)^\s*part\s+[\dIVXLC]+\b[\s.:–—-]*(.*)$"
CONTENTS_LINE = r"(?i)^\s*(?:chapter\s+)?(\d{1,4})[.\s]+(.{3,90}?)\s*[.·…\s]{2,}\s*(\d{1,5})\s*$"


def outline_level(outline: DataFrame) -> DataFrame:
    """book_id, level: the level with most numbered titles if there are three, else the level up to 2 with most entries."""
    n = outline.withColumn("num", chapter_title(F.col("title"))["number"].isNotNull().cast("int"))
    per = n.groupBy("book_id", "level").agg(F.sum("num").alias("numbered"), F.count_if(~F.col("title").rlike(PART) & ~F.col("title").rlike(MATTER)).alias("others"), F.count("*").alias("n"))
    good = (F.col("numbered") >= 3) | ((F.col("numbered") >= 1) & (F.col("numbered") >= F.col("n") * 0.6))
    ok = per.where(good | ((F.col("level") <= 2) & (F.col("others") >= 2)))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc(good.cast("int")), F.desc(F.when(good, F.col("numbered")).otherwise(F.col("others"))), "level"))
    return ok.withColumn("_k", rank).where("_k = 1").select("book_id", "level")


def outline_chapters(outline: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, title, number, part, start, end, start_y, confidence of the entries of the chosen level.

    A chapter ends before the next entry of its level or above; if that entry starts below the head of the same page, the
    page is shared. The part is the title of the last entry above.
    """
    w = Window.partitionBy("book_id").orderBy("seq")
    level = outline_level(outline).withColumnRenamed("level", "chosen")
    df = outline.join(level, "book_id").where("level <= chosen")
    is_part = (F.col("level") < F.col("chosen")) | F.col("title").rlike(PART)
    name = F.coalesce(F.when(F.regexp_extract("title", PART, 1) != "", F.trim(F.regexp_extract("title", PART, 1))), F.col("title"))
    df = df.withColumn("part", F.last(F.when(is_part, name), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("next_page", F.lead("page").over(w)).withColumn("next_y", F.lead("y").over(w)).join(books.select("book_id", "n_pages"), "book_id")
    shared = F.col("next_y").isNotNull() & (F.col("next_y") > 90)
    end = F.when(F.col("next_page").isNull(), F.col("n_pages")).when(shared, F.col("next_page")).otherwise(F.greatest(F.col("next_page") - 1, F.col("page")))
    t = chapter_title(F.col("title"))
    kept = df.where(~is_part & ~F.col("title").rlike(MATTER))
    return kept.select("book_id", "seq", t["title"].alias("title"), t["number"].alias("number"), "part", F.col("page").alias("start"), end.cast("int").alias("end"), F.col("y").alias("start_y"), F.lit(0.95).alias("confidence"))


def contents_entries(lines: DataFrame, first_pages: int = 40) -> DataFrame:
    """book_id, page, number, title, printed_page of lines of a printed contents page: three matches on a page count."""
    hit = lines.where((F.col("page") <= first_pages) & F.col("raw").rlike(CONTENTS_LINE))
    n = F.count("*").over(Window.partitionBy("book_id", "page"))
    m = lambda k: F.regexp_extract("raw", CONTENTS_LINE, k)
    return hit.withColumn("_n", n).where("_n >= 3").select("book_id", "page", "seq", m(1).cast("int").alias("number"), F.trim(m(2)).alias("title"), m(3).cast("int").alias("printed_page"))


def layout_openers(lines: DataFrame, height: float = 842.0) -> DataFrame:
    """book_id, page, number, title of pages whose largest line, in the upper 40 %, names a chapter."""
    upper = lines.where((F.col("size") >= 16) & (F.col("y0") < height * 0.4))
    best = upper.groupBy("book_id", "page").agg(F.max_by("raw", F.struct("size", -F.col("seq"))).alias("raw"))
    t = chapter_title(F.col("raw"))
    return best.where(F.col("raw").rlike(r"(?i)^\s*(?:chapter|ch\.?)\s*\d")).select("book_id", "page", t["number"].alias("number"), t["title"].alias("title"))


def first_source(candidates: list[DataFrame]) -> DataFrame:
    """Of several chapter tables the rows of the first that has any for a book; the order of the list is the priority."""
    ranked = reduce(DataFrame.unionByName, [c.withColumn("priority", F.lit(i)) for i, c in enumerate(candidates)])
    return ranked.withColumn("_b", F.min("priority").over(Window.partitionBy("book_id"))).where("priority = _b").drop("_b")


def single_chapter(books: DataFrame) -> DataFrame:
    """Whole-book fallback."""
    return books.select("book_id", F.lit(1).alias("number"), "title", F.lit(1).alias("start"), F.col("n_pages").alias("end"), F.lit(0.3).alias("confidence"))


def chapter_keys(chapters: DataFrame) -> DataFrame:
    """Key of each chapter: ch_NNN by number, ch_xNNN by position; the second of equal keys gets an a, the third a b."""
    pos = F.row_number().over(Window.partitionBy("book_id").orderBy("start", "seq"))
    base = F.when(F.col("number").isNotNull(), F.concat(F.lit("ch_"), F.lpad(F.col("number").cast("string"), 3, "0"))).otherwise(F.concat(F.lit("ch_x"), F.lpad(pos.cast("string"), 3, "0")))
    df = chapters.withColumn("_k", base)
    n = F.row_number().over(Window.partitionBy("book_id", "_k").orderBy("start", "seq"))
    return df.withColumn("key", F.when(n == 1, F.col("_k")).otherwise(F.concat("_k", F.char(95 + n)))).drop("_k")


def validate(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Chapters with issues and lowered confidence: range outside the book, overlap with an earlier chapter, number given
    twice, jump in the numbers."""
    w = Window.partitionBy("book_id").orderBy("start", "seq")
    df = chapters.join(books.select("book_id", "n_pages"), "book_id", "left")
    df = df.withColumn("_e", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_p", F.last("number", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_d", F.count("number").over(Window.partitionBy("book_id", "number")))
    invalid = F.coalesce((F.col("start") < 1) | (F.col("end") < F.col("start")) | (F.col("end") > F.col("n_pages")), F.lit(False))
    overlap = F.coalesce((F.col("start") <= F.col("_e")) & ~((F.col("start") == F.col("_e")) & F.col("start_y").isNotNull()), F.lit(False))
    double = F.coalesce(F.col("number").isNotNull() & (F.col("_d") > 1), F.lit(False))
    jump = F.coalesce((F.col("number") != F.col("_p") + 1) & (F.col("number") != F.col("_p")), F.lit(False))
    rules = [(invalid, "INVALID_RANGE", 0.2), (overlap, "OVERLAP", 0.3), (double, "DUPLICATE_NUMBER", 0.4), (jump, "NUMBER_JUMP", 0.75)]
    conf = F.least(F.col("confidence"), *[F.when(c, limit).otherwise(1.0) for c, _, limit in rules])
    issues = F.filter(F.array(*[F.when(c, F.lit(code)) for c, code, _ in rules]), lambda x: x.isNotNull())
    return df.withColumn("checked", F.round(conf, 2)).withColumn("issues", issues).drop("_e", "_p", "_d", "n_pages")


def page_offset(titles: DataFrame, pages: DataFrame) -> DataFrame:
    """book_id, offset: how far printed page numbers lie behind pages, the mode over titles found on a page up to 59
    further on; of equals the smaller. ``titles``: book_id, title, printed_page; ``pages``: book_id, page, text."""
    a, b = titles.alias("a"), pages.alias("b")
    hit = (F.col("a.book_id") == F.col("b.book_id")) & F.col("b.page").between(F.col("a.printed_page"), F.col("a.printed_page") + 59) & F.contains(F.lower("b.text"), F.lower("a.title"))
    first = a.join(b, hit).groupBy(F.col("a.book_id").alias("book_id"), F.col("a.title").alias("title")).agg(F.min(F.col("b.page") - F.col("a.printed_page")).alias("offset"))
    n = first.groupBy("book_id", "offset").agg(F.count("*").alias("n"))
    return n.withColumn("_k", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("n"), "offset"))).where("_k = 1").select("book_id", "offset")


def latest_state(states: DataFrame) -> DataFrame:
    """Last state of each chapter by loaded_at; of equals the greatest status."""
    return states.groupBy("book_id", "chapter_key").agg(F.max(F.struct("loaded_at", "status", "page")).alias("s")).select("book_id", "chapter_key", "s.status", F.col("s.page").alias("pages_at"))


def progress(chapters: DataFrame, states: DataFrame) -> DataFrame:
    """book_id, n_chapters, n_done, percent (one decimal)."""
    df = chapters.select("book_id", "chapter_key").distinct().join(latest_state(states), ["book_id", "chapter_key"], "left")
    out = df.groupBy("book_id").agg(F.count("*").alias("n_chapters"), F.count_if(F.col("status").isin(DONE_STATES)).alias("n_done"))
    return out.withColumn("percent", F.round(F.col("n_done") * 100.0 / F.col("n_chapters"), 1))


