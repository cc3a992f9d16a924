"""The stream of blocks of a chapter: title, headings, captions, references, lists, formulas, footnotes, paragraphs, figures,
tables and callouts, in reading order, with the issues found on the way.

Each step is a window or a running sum over the paragraphs of a chapter; only captions and figures, of which a page has few,
are paired one to one by a fold.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import numeric, text
from vellumspark.operators import assemble, blocks, figures, qa, spans
from vellumspark.session import written

CHAPTER = ["book_id", "chapter_key"]
# Signs that mark footnotes.
NOTE_MARK = r"^[*†‡§¶]"
ITEM = (
    "book_id string, chapter_key string, item_no int, t string, page int, x0 double, y0 double, x1 double, y1 double, asset string, labels array<string>, body_md string, clean string, conf double, "
    "n_rows int, n_cols int, n_cells int, n_empty int, n_holes int, header_inferred boolean, is_html boolean, raw_numbers array<string>"
)
CALLOUT_MOST = 8  # blocks of a callout whose extent is inferred


def running(*order: str) -> Window:
    return Window.partitionBy(*CHAPTER).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def with_title(paras: DataFrame, chapters: DataFrame | None) -> DataFrame:
    """Paras with ``is_title`` and ``title_overlap``; the lines of a title that was set as several paragraphs are one.

    A title is a run of neighbours on the chapter's first page, from the first of the largest on, in sizes within a point,
    1.35 times the body or more; a run of several must hold half of the words of the chapter's title.
    """
    whole = Window.partitionBy(*CHAPTER)
    first = F.try_element_at("pages", F.lit(1))
    df = paras if chapters is None else paras.join(chapters.groupBy(*CHAPTER).agg(F.min("title").alias("_outline")), CHAPTER, "left")
    df = df if chapters is not None else df.withColumn("_outline", F.lit(None).cast("string"))
    large = (first == F.min(first).over(whole)) & (F.col("size") >= 1.35 * F.col("body")) & (F.col("h_conf") >= 0.8)
    df = df.withColumn("_in", F.coalesce(large & (F.max(F.when(large, F.col("size"))).over(whole) - F.col("size") < 1.0), F.lit(False)))
    df = df.withColumn("_from", F.min(F.when(F.col("_in"), F.col("seq"))).over(whole)).withColumn("_k", F.sum(F.col("_in").cast("int")).over(running("seq")))
    df = df.withColumn("_run", F.col("_in") & (F.col("seq") - F.col("_from") == F.col("_k") - 1))
    parts = F.array_sort(F.collect_list(F.when(F.col("_run"), F.struct("seq", "text", "raw"))).over(whole))
    joined = lambda c, by: F.array_join(F.transform(parts, lambda x: x[c]), by)
    df = df.withColumn("_title", joined("text", " ")).withColumn("_raw", joined("raw", "\n")).withColumn("_n", F.size(parts))
    df = df.withColumn("title_overlap", F.when(F.col("_outline").isNotNull(), text.title_overlap(F.col("_outline"), F.col("_title"))))
    accepted = (F.col("_n") == 1) | (F.coalesce("title_overlap", F.lit(0.0)) >= 0.5)
    df = df.withColumn("is_title", F.col("_run") & accepted & (F.col("seq") == F.col("_from"))).where(~(F.col("_run") & accepted & (F.col("seq") > F.col("_from"))))
    many = F.col("is_title") & (F.col("_n") > 1)
    df = df.withColumn("text", F.when(many, F.col("_title")).otherwise(F.col("text"))).withColumn("raw", F.when(many, F.col("_raw")).otherwise(F.col("raw")))
    return df.drop("_outline", "_in", "_from", "_k", "_run", "_title", "_raw", "_n")


def caption_start() -> Column:
    """Whether a paragraph begins a caption and not a sentence about a figure: its label stands out by weight, size, case or
    a sign behind it."""
    label = F.regexp_extract("text", text.CAPTION, 0)
    apart = F.coalesce("bold", F.lit(False)) | F.rtrim(label).rlike(r"[.:|]$") | (F.col("size") < F.col("body") - 0.4) | F.col("text").rlike(r"^\s*[A-Z]{3,}")
    return F.col("text").rlike(text.CAPTION) & F.coalesce(apart, F.lit(False))


def kinds(paras: DataFrame, threshold: float, page_height: float) -> DataFrame:
    """Paras with block_type, tested in the order heading, caption, reference, list, formula, footnote, paragraph."""
    head = F.col("is_title") | (F.col("h_conf") >= threshold)
    df = paras.withColumn("_open", F.last(F.when(head, F.trim("text")), ignorenulls=True).over(running("seq")))
    refs = F.coalesce(F.col("_open").rlike(text.REFERENCES), F.lit(False))
    formula = (F.col("n_lines") == 1) & (F.length("text") <= 140) & F.contains("text", F.lit("=")) & F.col("text").rlike("[×÷±≥≤≠≈−√∑∫∞αβγδΔµπσλθ→²³]")
    note = (F.col("size") < F.col("body") - 0.5) & (F.col("y0") > 0.75 * page_height) & F.col("text").rlike(NOTE_MARK)
    kind = (
        F.when(head, "heading").when(caption_start() & ~refs, "caption").when(refs, "reference").when(F.col("kind") == "list", "list").when(formula, "formula")
        .when(F.coalesce(note, F.lit(False)), "footnote").otherwise("paragraph")
    )
    return df.withColumn("block_type", kind).drop("_open")


def list_md(items: Column) -> Column:
    """Markdown of a list from its (x0, text) in order, nested by indent: a stack of indents, hence Arrow batches."""

    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: blocks.render_list([(x["x0"] or 0.0, x["text"] or "") for x in xs]))

    return F.pandas_udf(run, "string")(items)


def grouped(paras: DataFrame) -> DataFrame:
    """Items of one list, and the parts of one reference, as one row each.

    A list ends where the box changes or where numbered and plain items of one indent meet; a reference goes on while its text
    does not end a sentence and no number begins the next.
    """
    w = Window.partitionBy(*CHAPTER).orderBy("seq")
    before = lambda c: F.lag(c).over(w)
    df = paras.withColumn("_ordered", F.coalesce(F.col("marker_kind") == "num", F.lit(False)))
    same_list = (F.col("block_type") == "list") & (before("block_type") == "list") & F.col("box").eqNullSafe(before("box")) & ~((F.col("_ordered") != before("_ordered")) & (F.abs(F.col("x0") - before("x0")) < 4))
    same_ref = (F.col("block_type") == "reference") & (before("block_type") == "reference") & (F.col("kind") != "list") & ~text.ends_sentence(before("text")) & ~F.col("text").rlike(r"^\s*\[?\d")
    df = df.withColumn("_g", F.sum(F.when(F.coalesce(same_list | same_ref, F.lit(False)), 0).otherwise(1)).over(running("seq")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "text", "raw", "x0", "pages", "bboxes")))
    first = lambda c: F.min_by(c, "seq").alias(c)
    out = df.groupBy(*CHAPTER, "_g").agg(
        parts.alias("_parts"), F.min("seq").alias("seq"), F.min("conf").alias("conf"), F.flatten(F.collect_list("uncertain")).alias("uncertain"),
        *[first(c) for c in ("block_type", "size", "bold", "body", "box", "h_conf", "is_title", "title_overlap", "x0", "y0", "x1", "n_lines")], F.max_by("y1", "seq").alias("y1"),
    )
    joined = lambda c, by: F.array_join(F.transform("_parts", lambda x: F.coalesce(x[c], F.lit(""))), by)
    out = out.withColumn("text", F.when(F.col("block_type") == "list", joined("text", "\n")).otherwise(joined("text", " "))).withColumn("raw", joined("raw", "\n"))
    out = out.withColumn("pages", F.array_sort(F.array_distinct(F.flatten(F.transform("_parts", lambda x: x["pages"]))))).withColumn("bboxes", F.flatten(F.transform("_parts", lambda x: x["bboxes"])))
    return out.withColumn("_items", F.when(F.col("block_type") == "list", F.transform("_parts", lambda x: F.struct(x["x0"].alias("x0"), x["text"].alias("text"))))).drop("_parts", "_g")


def rendered(rows: DataFrame) -> DataFrame:
    """Rows with md by their block_type and h_level."""
    c = F.col("text")
    formula = spans.to_latex(F.array(F.struct(c.alias("text"), F.lit(0).alias("bits"), F.lit(None).cast("int").alias("mark"))))
    low = F.when(F.col("conf") < 0.8, F.concat(F.lit("\n<!-- UNCERTAIN: low OCR confidence, page "), F.coalesce(F.try_element_at("pages", F.lit(1)).cast("string"), F.lit("")), F.lit(" -->"))).otherwise("")
    lists = rows.where("block_type = 'list'").withColumn("md", list_md(F.col("_items")))
    rest = rows.where("block_type <> 'list'").withColumn(
        "md",
        F.when(F.col("block_type") == "heading", F.concat_ws(" ", F.repeat(F.lit("#"), F.coalesce("h_level", F.lit(2))), text.escape_md(c))).when(F.col("block_type") == "caption", text.bold_label(text.escape_md(c)))
        .when(F.col("block_type") == "reference", text.autolink(reference_md(c))).when(F.col("block_type") == "formula", F.concat(F.lit("$$\n"), formula, F.lit("\n$$"))).otherwise(F.concat(assemble.paragraph_md(c), low)),
    )
    return rest.unionByName(lists).drop("_items")


def reference_md(c: Column) -> Column:
    """A reference with an anchor by its number."""
    n = F.regexp_extract(c, r"^\s*[\[(]?(\d{1,4})[\].)]", 1)
    return F.when(n != "", F.concat(F.lit('<a id="ref-'), n, F.lit('"></a>'), c)).otherwise(c)


def with_footnotes(rows: DataFrame) -> DataFrame:
    """Footnotes go behind the nearest paragraph before them on their page that holds their mark, which becomes a link; one
    without such a paragraph stays where it is, as a paragraph with ``unlinked``."""
    mark, page = F.substring("text", 1, 1), F.try_element_at("pages", F.lit(1))
    notes = rows.where("block_type = 'footnote'").select(*CHAPTER, F.col("seq").alias("note"), mark.alias("mark"), page.alias("page"))
    notes = notes.withColumn("fid", F.concat(F.lit("fn"), F.col("page").cast("string"), F.lit("-x")))
    of_page = rows.where("block_type = 'paragraph'").select(*CHAPTER, F.explode("pages").alias("page"), "seq", "text")
    near = notes.join(of_page, [*CHAPTER, "page"]).where((F.col("seq") < F.col("note")) & F.contains("text", F.col("mark")))
    links = near.groupBy(*CHAPTER, "note", "mark", "fid").agg(F.max("seq").alias("target"))
    calls = links.groupBy(*CHAPTER, F.col("target").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("note", "mark", "fid"))).alias("_calls"))
    df = rows.join(calls, [*CHAPTER, "seq"], "left").join(links.select(*CHAPTER, F.col("note").alias("seq"), "target", "fid"), [*CHAPTER, "seq"], "left")
    one = lambda md, x: F.regexp_replace(md, F.concat(F.lit(r"(?s)^(.*?)\\?\Q"), x["mark"], F.lit(r"\E")), F.concat(F.lit("$1[^"), x["fid"], F.lit("]")))
    md = F.when(F.col("_calls").isNotNull(), F.aggregate("_calls", F.col("md"), one)).when(F.col("target").isNotNull(), F.concat(F.lit("[^"), F.col("fid"), F.lit("]: "), text.escape_md(F.trim(F.expr("substring(text, 2)"))))).otherwise(F.col("md"))
    note = F.col("block_type") == "footnote"
    df = df.withColumn("md", md).withColumn("unlinked", note & F.col("target").isNull()).withColumn("_at", F.coalesce("target", "seq").cast("double")).withColumn("_sub", F.when(F.col("target").isNotNull(), F.col("seq")).otherwise(0))
    return df.withColumn("block_type", F.when(F.col("unlinked"), "paragraph").otherwise(F.col("block_type"))).drop("_calls", "target", "fid")


def with_items(rows: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the figures, tables and scanned pages of ``items`` (schema ITEM) among them, each with its caption, which then
    stands for itself no more; and the items with the order they got. An item stands behind what is above it on its page."""
    kind = F.when(F.col("text").rlike(r"(?i)^\s*table\b"), "table").otherwise("figure")
    caps = rows.where("block_type = 'caption'").select(*CHAPTER, F.try_element_at("pages", F.lit(1)).alias("page"), kind.alias("t"), F.col("seq").alias("cap_no"), "x0", "y0", "x1", "y1", F.col("text").alias("caption"))
    keys = [*CHAPTER, "t", "page"]
    pairs = written(blocks.match_captions(items.where("t in ('figure', 'table')").withColumn("fig_no", F.col("item_no")), caps, keys=keys))
    got = items.join(pairs.select(*keys, F.col("fig_no").alias("item_no"), "cap_no"), [*keys, "item_no"], "left").join(caps.select(*CHAPTER, "cap_no", "caption"), [*CHAPTER, "cap_no"], "left")
    above = rows.select(*CHAPTER, F.explode("bboxes").alias("b"), "seq").select(*CHAPTER, F.col("b.page").alias("page"), F.col("b.y0").alias("_y0"), "seq")
    place = got.select(*CHAPTER, "item_no", "page", "y0").join(above, [*CHAPTER, "page"], "left")
    place = place.groupBy(*CHAPTER, "item_no").agg(F.max(F.when(F.col("_y0") <= F.col("y0"), F.col("seq"))).alias("a"), F.min("seq").alias("b"))
    earlier = rows.select(*CHAPTER, F.try_element_at("pages", F.lit(1)).alias("p"), "seq")
    before = got.select(*CHAPTER, "item_no", "page").join(earlier, CHAPTER).where("p < page").groupBy(*CHAPTER, "item_no").agg(F.max("seq").alias("c"))
    got = got.join(place, [*CHAPTER, "item_no"], "left").join(before, [*CHAPTER, "item_no"], "left").withColumn("_at", F.coalesce(F.col("a") + 0.5, F.col("b") - 0.5, F.col("c") + 0.5, F.lit(0.5)))
    n = F.row_number().over(Window.partitionBy(*CHAPTER, "t").orderBy("_at", "item_no"))
    got = written(got.withColumn("n", n).withColumn("_id", F.xxhash64(*CHAPTER, "item_no")))
    figs = figures.figure_blocks(got.where("t = 'figure'").select(F.col("_id").alias("fig_id"), "asset", F.when(F.col("caption").isNotNull(), text.bold_label(text.escape_md(F.col("caption")))).alias("caption_md"), "caption", "labels"))
    tabs = figures.table_blocks(got.where("t = 'table'").select(F.col("_id").alias("table_id"), F.col("chapter_key").alias("tag"), F.col("n").alias("table_no"), "n_rows", "n_cols", "caption", "body_md", F.lit(None).cast("string").alias("notes_md")))
    md = figs.select(F.col("fig_id").alias("_id"), "md").unionByName(tabs.select(F.col("table_id").alias("_id"), "md"))
    page = F.col("page").cast("string")
    unread = F.concat(F.lit("<!-- UNCERTAIN: source text unreadable, page "), page, F.lit(" -->\n[Unreadable source text]\n\n![Scanned page "), page, F.lit("]("), F.coalesce("asset", F.lit("")), F.lit(")"))
    got = got.join(md, "_id", "left").withColumn("md", F.when(F.col("t") == "scanned", unread).otherwise(F.col("md")))
    box = F.array(F.struct("page", "x0", "y0", "x1", "y1"))
    new = got.select(
        *CHAPTER, F.lit(None).cast("int").alias("seq"), "_at", F.col("item_no").alias("_sub"), F.when(F.col("t") == "scanned", "unreadable").otherwise(F.col("t")).alias("block_type"), "md", F.coalesce("caption", F.lit("")).alias("raw"),
        F.when(F.col("t") == "table", F.coalesce("clean", F.lit(""))).otherwise(F.coalesce("caption", F.lit(""))).alias("text"), F.array("page").alias("pages"), box.alias("bboxes"), "conf", "item_no",
    )
    kept = rows.join(pairs.select(*CHAPTER, F.col("cap_no").alias("seq")), [*CHAPTER, "seq"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True), got


def with_callouts(rows: DataFrame) -> DataFrame:
    """Paragraphs and lists in one box of a page as one callout; without a box, a callout's title in bold or capitals and up to
    seven paragraphs and lists after it on its page, with ``inferred``."""
    w = Window.partitionBy(*CHAPTER).orderBy("_at", "_sub")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    page = F.try_element_at("pages", F.lit(1))
    plain = F.col("block_type").isin("paragraph", "list")
    boxed = plain & F.col("box").isNotNull() & (F.col("box") >= 0)
    df = rows.withColumn("_page", page).withColumn("_plain", plain).withColumn("_boxed", F.coalesce(boxed, F.lit(False)))
    named = F.regexp_replace(F.trim("text"), ":$", "").rlike(text.CALLOUT) & (F.length("text") < 40)
    df = df.withColumn("_named", F.coalesce(named, F.lit(False))).withColumn("_i", F.row_number().over(w))
    df = df.withColumn("_starts", F.col("_named") & ~F.col("_boxed") & (F.col("block_type") == "paragraph") & (F.coalesce("bold", F.lit(False)) | (F.upper("text") == F.col("text"))))
    breaks = ~F.col("_plain") | F.col("_boxed") | ~F.col("_page").eqNullSafe(F.lag("_page").over(w)) | F.coalesce(F.lag("_boxed").over(w) | ~F.lag("_plain").over(w), F.lit(True))
    df = df.withColumn("_island", F.sum(F.when(breaks, 1).otherwise(0)).over(run))
    in_island = Window.partitionBy(*CHAPTER, "_island").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_from", F.last(F.when(F.col("_starts"), F.col("_i")), ignorenulls=True).over(in_island))
    df = df.withColumn("_in", F.col("_plain") & ~F.col("_boxed") & F.col("_from").isNotNull() & (F.col("_i") - F.col("_from") < CALLOUT_MOST))
    alone = F.count(F.when(F.col("_in"), 1)).over(Window.partitionBy(*CHAPTER, "_from")) < 2
    df = df.withColumn("_in", F.coalesce(F.col("_in") & ~alone, F.lit(False)))
    same_box = F.col("_boxed") & F.coalesce(F.lag("_boxed").over(w), F.lit(False)) & F.col("box").eqNullSafe(F.lag("box").over(w)) & F.col("_page").eqNullSafe(F.lag("_page").over(w))
    same = same_box | (F.col("_in") & (F.col("_i") > F.col("_from")))
    df = df.withColumn("_g", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(run)).withColumn("_callout", F.col("_boxed") | F.col("_in"))
    parts = F.array_sort(F.collect_list(F.struct("_i", "md", "text", "raw", "pages", "bboxes", "_named")))
    first = lambda c: F.min_by(c, "_i").alias(c)
    rest = ["block_type", "_at", "_sub", "size", "bold", "body", "h_conf", "h_level", "is_title", "title_overlap", "unlinked", "item_no", "_boxed", "_callout", "seq"]
    out = df.groupBy(*CHAPTER, "_g").agg(parts.alias("p"), F.min("conf").alias("conf"), F.flatten(F.collect_list(F.coalesce("uncertain", F.array().cast("array<string>")))).alias("uncertain"), *[first(c) for c in rest])
    titled = F.element_at("p", 1)["_named"]
    quoted = lambda md: F.regexp_replace(F.regexp_replace(md, "(?m)^", "> "), "(?m)^> $", ">")
    body = F.array_join(F.transform(F.when(titled, F.slice("p", F.lit(2), F.size("p"))).otherwise(F.col("p")), lambda x: quoted(x["md"])), "\n>\n")
    head = F.when(titled, F.concat(F.lit("> **"), F.regexp_replace(F.trim(F.element_at("p", 1)["text"]), "[*]", ""), F.lit("**\n>\n"))).otherwise("")
    each = lambda c: F.array_join(F.transform("p", lambda x: F.coalesce(x[c], F.lit(""))), "\n")
    of = lambda c: F.flatten(F.transform("p", lambda x: x[c]))
    return out.select(
        *CHAPTER, *[c for c in rest if c not in ("block_type", "_boxed", "_callout")], "conf", "uncertain", F.when(F.col("_callout"), "callout").otherwise(F.col("block_type")).alias("block_type"),
        F.when(F.col("_callout"), F.concat(head, body)).otherwise(F.element_at("p", 1)["md"]).alias("md"), each("raw").alias("raw"), each("text").alias("text"),
        F.array_sort(F.array_distinct(of("pages"))).alias("pages"), of("bboxes").alias("bboxes"), (F.col("_callout") & ~F.col("_boxed")).alias("inferred"),
    )


def block_stream(paras: DataFrame, chapters: DataFrame | None = None, items: DataFrame | None = None, resolved: DataFrame | None = None, memory: DataFrame | None = None, threshold: float = 0.6, page_height: float = 842.0) -> tuple[DataFrame, DataFrame]:
    """Blocks (block_id, seq, block_type, md, raw, clean, pages, bboxes, conf, h_level, flags, h_conf) and issues.

    ``resolved`` (book_id, chapter_key, para_no, level) is what a classifier of doubtful headings, such as a model, decided;
    ``memory`` (book_id, style, level) keeps levels from earlier conversions. A chapter without paragraphs gives no blocks.
    """
    conf = blocks.heading_conf(F.col("size") / F.col("body"), F.coalesce("bold", F.lit(False)), F.coalesce("italic", F.lit(False)), F.col("n_lines"), F.col("text"), F.col("box").isNotNull() & (F.col("box") >= 0), F.col("kind") == "list")
    df = paras.withColumn("seq", F.col("para_no")).withColumn("h_conf", conf).withColumn("_told", F.lit(None).cast("int"))
    if resolved is not None:
        df = df.drop("_told").join(resolved.select(*CHAPTER, "para_no", F.col("level").alias("_told")), [*CHAPTER, "para_no"], "left")
    doubtful = (F.col("h_conf") >= 0.4) & (F.col("h_conf") < threshold)
    df = df.withColumn("h_conf", F.when(doubtful & F.col("_told").isNotNull(), F.greatest(F.lit(threshold), F.lit(0.7))).otherwise(F.col("h_conf")))
    df = kinds(with_title(df, chapters), threshold, page_height)
    heads = df.where("block_type = 'heading' and not is_title").select(*CHAPTER, "seq", "size", "bold", "_told")
    levels = blocks.heading_levels(heads, ["book_id"]) if memory is None else blocks.levels_with_memory(heads, memory, ["book_id"])
    rows = grouped(df).join(levels.select(*CHAPTER, "seq", F.greatest(F.coalesce("_told", "level"), F.lit(2)).alias("h_level")), [*CHAPTER, "seq"], "left")
    rows = rows.withColumn("h_level", F.when(F.col("is_title"), 1).otherwise(F.col("h_level")))
    rows = with_footnotes(written(rendered(rows))).withColumn("item_no", F.lit(None).cast("int"))
    got = None
    if items is not None:
        rows, got = with_items(written(rows), items)
    out = with_callouts(rows)
    order = F.row_number().over(Window.partitionBy(*CHAPTER).orderBy("_at", "_sub"))
    flags = F.array_compact(F.array(F.when((F.col("conf") < 0.8) & F.col("item_no").isNull(), "OCR_LOW_CONFIDENCE"), F.when(F.size("uncertain") > 0, "HYPHEN_UNCERTAIN"), F.when((F.col("h_conf") >= 0.4) & (F.col("h_conf") < threshold) & (F.col("block_type") != "heading"), "HEADING_AMBIGUOUS")))
    out = written(out.withColumn("seq", order).withColumn("block_id", F.xxhash64(*CHAPTER, F.lit("block"), "seq")).withColumn("flags", flags).withColumnRenamed("text", "clean").drop("_at", "_sub"))
    return out, stream_issues(out, got)


def stream_issues(b: DataFrame, items: DataFrame | None) -> DataFrame:
    """Issues that the stream itself finds."""
    page, i = F.try_element_at("pages", F.lit(1)), F.col("block_id")
    short = F.substring("clean", 1, 80)
    low = b.where(F.array_contains("flags", "OCR_LOW_CONFIDENCE"))
    parts = [
        qa.issue(b.where(F.array_contains("flags", "HEADING_AMBIGUOUS")), "MEDIUM", "HEADING_AMBIGUOUS", short, page, i),
        qa.issue(b.where("is_title and title_overlap < 0.5"), "LOW", "TITLE_MISMATCH", short, page, i),
        qa.issue(b.where("block_type = 'formula'"), "LOW", "FORMULA_LATEX", short, page, i),
        qa.issue(b.where("size(uncertain) > 0"), "LOW", "HYPHEN_UNCERTAIN", F.array_join(F.slice("uncertain", 1, 5), ", "), page, i),
        qa.issue(low, F.when(F.size(numeric.tokens(F.col("clean"))) > 0, "HIGH").otherwise("MEDIUM"), "OCR_LOW_CONFIDENCE", F.col("conf").cast("string"), page, i),
        qa.issue(b.where("unlinked"), "LOW", "FOOTNOTE_UNLINKED", short, page, i),
        qa.issue(b.where("inferred"), "LOW", "CALLOUT_INFERRED", short, page, i),
        qa.issue(b.where("block_type = 'unreadable'"), "HIGH", "PAGE_UNREADABLE", F.lit("no text could be read"), page, i),
        qa.issue(qa.doubled_words(b, [*CHAPTER, "block_id", "pages"], "clean", most=20, order=["seq"]), "LOW", "POSSIBLE_SOURCE_TYPO", F.col("word"), page, i),
    ]
    if items is not None:
        table = F.col("clean").rlike(r"(?i)^\s*table\b")
        own = b.where("item_no is not null").select(*CHAPTER, "item_no", "block_id", "md", "clean")
        tabs = items.where("t = 'table'").drop("md", "clean", "block_id").join(own, [*CHAPTER, "item_no"])
        parts += [
            qa.issue(items.where("t = 'figure' and caption is null"), "MEDIUM", "FIGURE_NO_CAPTION", F.lit(""), F.col("page")),
            qa.issue(b.where("block_type = 'caption'"), F.when(table, "MEDIUM").otherwise("HIGH"), "CAPTION_ORPHAN", short, page, i),
            figures.table_issues(tabs), figures.table_number_issues(tabs), figures.count_issues(items, b),
        ]
    return reduce(DataFrame.unionByName, parts)
