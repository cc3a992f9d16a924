"""Entry points: what a book holds, its conversion from lines to blocks and outputs, search, chapter payloads, status.

Conversion is two passes. The first builds what all chapters share (running lines, body size, vocabulary, heading styles),
the second converts all chapters at once, so the result does not depend on the order in which chapters are converted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import numeric, text
from vellumspark.operators import assemble, blocks, chapters, hyphen, layout, qa, rag, search, stream
from vellumspark.session import written

CHAPTER = ["book_id", "chapter_key"]


@dataclass
class Converted:
    blocks: DataFrame
    sections: DataFrame
    source_map: DataFrame
    markdown: DataFrame
    issues: DataFrame
    status: DataFrame
    chunks: DataFrame


def metadata(books: DataFrame, lines: DataFrame) -> DataFrame:
    """book_id, title, edition, short_id: the title given or else the largest lines of page 1; the edition named on the
    first six pages; an id of the title's first telling word and the edition."""
    big = F.max("size").over(Window.partitionBy("book_id"))
    first = lines.where("page = 1 and trim(raw) <> ''").withColumn("_m", big).where(F.col("size") >= F.col("_m") - 0.5)
    heads = first.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line_id", "raw"))), lambda x: x["raw"]), " ").alias("found"))
    named = F.regexp_extract("raw", r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\s+edition\b", 1)
    also = F.regexp_extract("raw", r"(?i)\bedition\s*[:\-]?\s*(\d{1,2})\b", 1)
    edition = lines.where("page <= 6").select("book_id", "page", "seq", "line_id", F.when(named != "", named).when(also != "", also).alias("n"), (named != "").alias("sure")).where("n is not null")
    edition = edition.groupBy("book_id").agg(F.min_by("n", F.struct(~F.col("sure"), "page", "seq", "line_id")).alias("edition"))
    df = books.groupBy("book_id").agg(F.min("title").alias("given")).join(heads, "book_id", "left").join(edition, "book_id", "left")
    title = F.coalesce(F.when(F.trim("given") != "", F.col("given")), "found", F.lit(""))
    parts = F.split(text.slugify(title), "-")
    word = F.when(F.element_at(parts, 1).isin("the", "a", "an") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(2))).otherwise(F.element_at(parts, 1))
    return df.select("book_id", title.alias("title"), F.coalesce("edition", F.lit("")).alias("edition"), F.concat(word, F.coalesce("edition", F.lit(""))).alias("short_id"))


def segmented(lines: DataFrame) -> DataFrame:
    """Lines with the number of their paragraph: running lines out, reading order, segmentation. Lines without a place come
    last on their page; a book without sizes has a body of 10 points."""
    kept = layout.without_running(lines).where("not removed").withColumn("zone", F.col("kept_zone"))
    at = written(layout.placed(written(kept.drop("removed", "kept_zone"))))
    gap = layout.line_gap(at.withColumn("seq", F.col("order_no")), CHAPTER)
    return blocks.segment(at.join(layout.body_size(at, ["book_id"]), "book_id", "left").join(gap, CHAPTER, "left").join(layout.column_edges(at), ["book_id", "page", "col"]))


def paragraphs(lines: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Paragraphs of all chapters; cut words are joined with the words of the book (and of ``vocab``: book_id, word, is_hyph)."""
    words = hyphen.inner_words(lines, ["book_id"], "raw")
    found = segmented(lines)
    paras = blocks.paragraphs_of(found, words if vocab is None else hyphen.merge_vocabulary(words, vocab)).join(layout.body_size(found, ["book_id"]), "book_id", "left").fillna(10.0, ["body"])
    return paras.withColumn("seq", F.col("para_no")).withColumn("para_id", F.xxhash64(*CHAPTER, "para_no"))


def with_sections(df: DataFrame) -> DataFrame:
    """Blocks with section_id and heading_path."""
    paths = assemble.heading_paths(df)
    ids = assemble.sections(df).select(*CHAPTER, "section_no", F.col("section_id").alias("sid"))
    out = paths.join(ids, [*CHAPTER, "section_no"], "left")
    return out.withColumn("section_id", F.coalesce("sid", F.lit("start"))).withColumn("heading_path", F.col("path")).drop("sid", "path", "section_no", "section_level")


def to_blocks(paras: DataFrame, threshold: float = 0.6, **given: DataFrame) -> DataFrame:
    """Blocks of paragraphs in the stream of their chapter, with section and path."""
    return with_sections(stream.block_stream(paras, threshold=threshold, **given)[0])


def convert(
    lines: DataFrame, chapter_table: DataFrame, items: DataFrame | None = None, vocab: DataFrame | None = None, resolved: DataFrame | None = None, memory: DataFrame | None = None, page_flags: DataFrame | None = None,
    failed: DataFrame | None = None, only: DataFrame | None = None,
) -> Converted:
    """All outputs of the chapters of the lines, or of those in ``only`` (book_id, chapter_key): what a book's chapters share
    is worked out from all lines all the same. ``items`` are figures and tables (stream.ITEM), ``page_flags`` what a reader
    said of pages, ``failed`` the chapters that could not be read: they get a status, and the others are converted."""
    paras = paragraphs(lines, vocab)
    if only is not None:
        wanted = only.select(*CHAPTER).distinct()
        paras, lines, chapter_table = (df.join(wanted, CHAPTER, "left_semi") for df in (paras, lines, chapter_table))
    raw_blocks, found = stream.block_stream(paras, chapter_table, items if items is None or only is None else items.join(wanted, CHAPTER, "left_semi"), resolved, memory)
    b = written(with_sections(raw_blocks))
    text_lines = layout.without_running(lines).where("not removed and raw is not null")
    shown = b.withColumn("shown", text.strip_markdown(F.col("md")))
    page = F.try_element_at("pages", F.lit(1)).alias("page")
    src = text_lines.select(*CHAPTER, "page", F.explode(numeric.tokens_in_context(F.col("raw"))).alias("m")).select(*CHAPTER, "page", "m.token", "m.ctx")
    out = shown.select(*CHAPTER, page, F.explode(numeric.tokens(F.col("shown"))).alias("token"))
    chars, seen = text_lines.select(*CHAPTER, "raw"), lines.select(*CHAPTER, "page")
    if items is not None:  # what stands in figures and tables is no line of text
        here = items if only is None else items.join(wanted, CHAPTER, "left_semi")
        src = src.unionByName(here.select(*CHAPTER, "page", F.explode("raw_numbers").alias("token"), F.lit("").alias("ctx")))
        chars = chars.unionByName(here.select(*CHAPTER, F.concat_ws(" ", F.when(F.col("t") == "table", F.col("clean")), F.array_join("labels", " ")).alias("raw")))
        seen = seen.unionByName(here.select(*CHAPTER, "page"))
    numbers = qa.number_issues(src, out)
    flags = qa.encoding_pages(lines) if page_flags is None else qa.encoding_pages(lines).unionByName(page_flags.select(*CHAPTER, "page", "flags"))
    issues = qa.all_issues([
        found, qa.heading_issues(b), qa.citation_issues(b), qa.figure_mentions(b, chapter_table), qa.mark_issues(b), qa.short_pages(lines), qa.blank_pages(lines), qa.pages_skipped(chapter_table, seen),
        qa.pages_not_in_output(text_lines, b), qa.loss_issues(qa.lost_chars(qa.char_counts(chars, CHAPTER, "raw"), qa.char_counts(shown, CHAPTER, "shown"), CHAPTER)),
        qa.issue(numbers, F.col("severity"), F.col("code"), F.concat_ws(" → ", "source", "output"), F.col("page")), qa.page_flags(flags),
    ])
    return Converted(b, assemble.sections(b), assemble.source_map(b), assemble.document(b, chapter_table), issues, qa.status_of(issues, chapter_table, failed), rag.chunks(b))


def inspect(books: DataFrame, lines: DataFrame) -> DataFrame:
    """Metadata of each book, where its chapters can be found, and a warning if only the fallback is left."""
    openers, contents = chapters.layout_openers(lines), chapters.contents_entries(lines)
    n = lambda df, name: df.groupBy("book_id").agg(F.count("*").alias(name))
    df = metadata(books, lines).join(n(openers, "n_openers"), "book_id", "left").join(n(contents, "n_contents"), "book_id", "left").fillna(0, ["n_openers", "n_contents"])
    return df.withColumn("warning", F.when((F.col("n_openers") == 0) & (F.col("n_contents") == 0), "no outline"))


def profile(lines: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """book_id, body, n_pages, patterns, repeated_images: what all chapters of a book share."""
    from vellumspark.operators import figures

    running = layout.book_patterns(lines).groupBy("book_id").agg(F.array_sort(F.collect_list("pattern")).alias("patterns"))
    df = lines.groupBy("book_id").agg(F.count_distinct("page").alias("n_pages")).join(layout.body_size(lines, ["book_id"]), "book_id", "left").join(running, "book_id", "left")
    if images is None:
        df = df.withColumn("repeated_images", F.array().cast("array<string>"))
    else:
        often = figures.repeated_images(images, lines).groupBy("book_id").agg(F.array_sort(F.collect_list(F.col("image_id").cast("string"))).alias("repeated_images"))
        df = df.join(often, "book_id", "left")
    none = F.array().cast("array<string>")
    return df.withColumn("patterns", F.coalesce("patterns", none)).withColumn("repeated_images", F.coalesce("repeated_images", none))


def chapter_payload(c: Converted, book_id: str, chapter_key: str) -> DataFrame:
    """Blocks of one chapter with the Markdown of their line range and their issues."""
    here = (F.col("book_id") == book_id) & (F.col("chapter_key") == chapter_key)
    lines = F.split("markdown", "\n")
    md = c.markdown.where(here).select(*CHAPTER, lines.alias("lines"))
    part = F.array_join(F.slice("lines", F.col("line_start").cast("int"), (F.col("line_end") - F.col("line_start") + 1).cast("int")), "\n")
    own = c.issues.where(here & F.col("block_id").isNotNull()).groupBy("block_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    df = c.source_map.where(here).join(md, CHAPTER).withColumn("part", part)
    return df.join(own, "block_id", "left").select("block_id", "block_type", "page_marker", "line_start", "line_end", F.col("part").alias("markdown"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


SEARCHED, WEIGHTS = ["clean", "path_text", "chapter_title"], [1.0, 0.4, 0.2]


def search_index(blocks_table: DataFrame, chapter_table: DataFrame | None = None, path: str | None = None) -> search.Index:
    """Index over text, heading path and chapter title of the blocks."""
    units = blocks_table.withColumn("path_text", F.array_join("heading_path", " "))
    if chapter_table is None:
        units = units.withColumn("chapter_title", F.lit(None).cast("string"))
    else:
        units = units.join(chapter_table.groupBy(*CHAPTER).agg(F.min("title").alias("chapter_title")), CHAPTER, "left")
    return search.build(units, "block_id", SEARCHED, path)


def find_units(index: search.Index, query: str, limit: int = 50, among: DataFrame | None = None) -> DataFrame:
    return search.find(index, query, WEIGHTS, limit, among)


def find(blocks_table: DataFrame, query: str, limit: int = 50, chapter_key: str | None = None, block_type: str | None = None, specialty: str | None = None, index: search.Index | None = None) -> DataFrame:
    """Hits of a full-text query over text, path and chapter title, with snippet, best first.

    Without an index one is made of the blocks. ``specialty`` is part of the column of that name and needs it.
    """
    where = [F.col(k) == v for k, v in (("chapter_key", chapter_key), ("block_type", block_type)) if v is not None]
    where += [] if specialty is None else [F.contains(F.lower("specialty"), F.lit(specialty.lower()))]
    among = reduce(DataFrame.where, where, blocks_table).select(F.col("block_id").alias("unit_id")) if where else None
    hits = find_units(index or search_index(blocks_table), query, limit, among)
    found = hits.join(blocks_table, hits["unit_id"] == blocks_table["block_id"])
    return found.select("block_id", *CHAPTER, "block_type", "heading_path", "pages", "score", search.snippet(F.col("clean"), search.parse_query(query)).alias("snippet")).orderBy(F.desc("score"), "block_id")
