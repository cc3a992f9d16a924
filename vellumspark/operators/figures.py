"""Figures, tables and boxes of a page: candidates, merging, captions, notes, rendering, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import numeric
from vellumspark.functions.text import CAPTION, label_anchor, normal_label, strip_markdown
from vellumspark.operators.folds import fold_groups
from vellumspark.operators.qa import all_issues, issue

PAGE = ["book_id", "page"]
MARGIN = 0.085
BIG_ROWS, BIG_CELLS = 40, 300


def width() -> Column:
    return F.col("x1") - F.col("x0")


def height() -> Column:
    return F.col("y1") - F.col("y0")


def repeated_images(images: DataFrame, pages: DataFrame, share: float = 0.25, least: int = 3) -> DataFrame:
    """book_id, image_id, n_pages of images on a share of a book's pages: logos and ornaments."""
    k = pages.select(*PAGE).distinct().groupBy("book_id").agg(F.count("*").alias("k"))
    n = images.select("book_id", "image_id", "page").distinct().groupBy("book_id", "image_id").agg(F.count("*").alias("n_pages"))
    return n.join(k, "book_id").where(F.col("n_pages") >= F.greatest(F.lit(least), F.col("k") * share)).drop("k")


def image_candidates(images: DataFrame, pages: DataFrame, tables: DataFrame, repeated: DataFrame) -> DataFrame:
    """Images that are figures: 36 points or more each way, not repeated, not the whole page, off the margins, not half
    inside a table. pages: book_id, page, w, h."""
    df = images.join(pages, PAGE).where((width() >= 36) & (height() >= 36) & (width() * height() < F.col("w") * F.col("h") * 0.85))
    df = df.where((F.col("y1") >= F.col("h") * MARGIN) & (F.col("y0") <= F.col("h") * (1 - MARGIN))).join(repeated.select("book_id", "image_id"), ["book_id", "image_id"], "left_anti")
    a, t = df.alias("a"), tables.alias("t")
    common = F.greatest(F.least("a.x1", "t.x1") - F.greatest("a.x0", "t.x0"), F.lit(0.0)) * F.greatest(F.least("a.y1", "t.y1") - F.greatest("a.y0", "t.y0"), F.lit(0.0))
    inside = (F.col("a.book_id") == F.col("t.book_id")) & (F.col("a.page") == F.col("t.page")) & (common > (F.col("a.x1") - F.col("a.x0")) * (F.col("a.y1") - F.col("a.y0")) * 0.5)
    return a.join(t, inside, "left_anti")


def drawing_candidates(drawings: DataFrame, pages: DataFrame, tables: DataFrame, boxes: DataFrame) -> DataFrame:
    """Drawings that may belong to figures: no rules, not the whole page, outside tables and callout boxes."""
    df = drawings.join(pages, PAGE)
    rule = ((width() < 2.5) & (height() > 30)) | ((height() < 2.5) & (width() > F.col("w") * 0.55))
    df = df.where(~rule & (width() * height() < F.col("w") * F.col("h") * 0.8))
    same = lambda b: (F.col("a.book_id") == F.col(f"{b}.book_id")) & (F.col("a.page") == F.col(f"{b}.page"))
    touch = (F.col("a.x0") < F.col("t.x1")) & (F.col("a.x1") > F.col("t.x0")) & (F.col("a.y0") < F.col("t.y1")) & (F.col("a.y1") > F.col("t.y0"))
    within = (F.col("a.x0") >= F.col("b.x0")) & (F.col("a.x1") <= F.col("b.x1")) & (F.col("a.y0") >= F.col("b.y0")) & (F.col("a.y1") <= F.col("b.y1"))
    df = df.alias("a").join(tables.alias("t"), same("t") & touch, "left_anti")
    return df.alias("a").join(boxes.alias("b"), same("b") & within, "left_anti")


def callout_boxes(rects: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Filled boxes of 80 by 30 points or more, up to 70 % of the page, not white, of two lines or more, the outermost.
    rects: book_id, page, rect_no, x0, y0, x1, y1, fill (array of shares, null if none)."""
    white = F.forall(F.col("fill"), lambda c: c > 0.97)
    df = rects.join(pages, PAGE).where(F.col("fill").isNotNull() & ~white & (width() >= 80) & (height() >= 30) & (width() * height() <= F.col("w") * F.col("h") * 0.7))
    a, b = df.alias("a"), df.alias("b")
    same = (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.rect_no") != F.col("b.rect_no"))
    inside = (F.col("a.x0") >= F.col("b.x0")) & (F.col("a.x1") <= F.col("b.x1")) & (F.col("a.y0") >= F.col("b.y0")) & (F.col("a.y1") <= F.col("b.y1"))
    equal = (F.col("a.x0") == F.col("b.x0")) & (F.col("a.x1") == F.col("b.x1")) & (F.col("a.y0") == F.col("b.y0")) & (F.col("a.y1") == F.col("b.y1"))
    outer = a.join(b, same & inside & (~equal | (F.col("b.rect_no") < F.col("a.rect_no"))), "left_anti")
    x, y = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    hold = (F.col("r.book_id") == F.col("l.book_id")) & (F.col("r.page") == F.col("l.page")) & x.between(F.col("r.x0"), F.col("r.x1")) & y.between(F.col("r.y0"), F.col("r.y1"))
    n = outer.alias("r").join(lines.alias("l"), hold).groupBy("r.book_id", "r.page", "r.rect_no").agg(F.count("*").alias("n_lines"))
    return outer.join(n.where("n_lines >= 2"), [*PAGE, "rect_no"]).drop("w", "h")


def merged(rects: DataFrame, near: float = 4.0) -> DataFrame:
    """book_id, page, fig_no, x0, y0, x1, y1, n: rectangles within ``near`` points taken together. A rectangle joins the
    first group it meets and widens it, so the groups of a page are a fold over its rectangles from the top."""

    def fold(rows: list[tuple]) -> list[tuple]:
        groups: list[list[float]] = []
        for _, _, x0, y0, x1, y1 in rows:
            for g in groups:
                if x0 <= g[2] + near and x1 >= g[0] - near and y0 <= g[3] + near and y1 >= g[1] - near:
                    g[:] = [min(g[0], x0), min(g[1], y0), max(g[2], x1), max(g[3], y1), g[4] + 1]
                    break
            else:
                groups.append([x0, y0, x1, y1, 1])
        return [(rows[0][0], rows[0][1], k, *g[:4], int(g[4])) for k, g in enumerate(groups, 1)]

    cols = rects.select(*PAGE, "x0", "y0", "x1", "y1")
    return fold_groups(cols, PAGE, ["y0", "x0", "x1", "y1"], fold, "book_id string, page int, fig_no int, x0 double, y0 double, x1 double, y1 double, n int")


def scanned_pages(lines: DataFrame, images: DataFrame, pages: DataFrame, least_chars: int = 25) -> DataFrame:
    """Pages with hardly any text under an image of at least half the page."""
    n = lines.groupBy(*PAGE).agg(F.sum(F.length(F.trim(F.coalesce("raw", F.lit(""))))).alias("chars"))
    large = images.join(pages, PAGE).where(width() * height() >= F.col("w") * F.col("h") * 0.5).select(*PAGE).distinct()
    return pages.select(*PAGE).join(large, PAGE).join(n, PAGE, "left").where(F.coalesce("chars", F.lit(0)) < least_chars).select(*PAGE)


def nearest_edge(edges: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value_id, cluster: grid line (from cluster_edges) nearest to each value; edges of one table are few."""
    a, b = values.alias("a"), edges.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = a.join(b, same).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.value_id").alias("value_id"))
    return near.agg(F.min_by("b.cluster", F.struct(F.abs(F.col("a.value") - F.col("b.edge")), "b.cluster")).alias("cluster"))


def table_notes(tables: DataFrame, paras: DataFrame, most: int = 4, reach: float = 40.0) -> DataFrame:
    """table_id, para_id of the notes under a table: the paragraphs after it on its last page, smaller than the body and
    near, up to four, ending at the first that is not. tables: seq, page, y1, body; paras: seq, page, y0, size."""
    a, b = tables.alias("a"), paras.alias("b")
    after = a.join(b, (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("b.seq") > F.col("a.seq")) & (F.col("b.seq") <= F.col("a.seq") + most))
    ok = (F.col("b.y0") - F.col("a.y1") < reach) & (F.col("b.size") < F.col("a.body") - 0.5)
    df = after.select(F.col("a.table_id").alias("table_id"), F.col("b.para_id").alias("para_id"), F.col("b.seq").alias("seq"), F.col("a.seq").alias("t"), ok.cast("int").alias("ok"))
    w = Window.partitionBy("table_id").orderBy("seq")
    df = df.withColumn("run", F.min("ok").over(w)).withColumn("gap", F.col("seq") - F.row_number().over(w) - F.col("t"))
    return df.where("run = 1 and gap = 0").select("table_id", "para_id")


def table_blocks(tables: DataFrame) -> DataFrame:
    """table_id, anchor, is_big, file, md of tables (tag, table_no, n_rows, n_cols, caption, body_md, notes_md): a large
    table goes to a file of its own and leaves a link."""
    kind, num = F.regexp_extract("caption", r"(?i)^\s*(table)\s+([0-9IVXA-Z][0-9.A-Za-z-]*)", 1), F.regexp_extract("caption", r"(?i)^\s*(table)\s+([0-9IVXA-Z][0-9.A-Za-z-]*)", 2)
    anchor = F.when(F.coalesce(num, F.lit("")) != "", label_anchor(kind, num))
    big = (F.col("n_rows") > BIG_ROWS) | (F.col("n_rows") * F.col("n_cols") > BIG_CELLS)
    file = F.concat(F.lit("table_"), F.col("tag"), F.lit("_"), F.lpad(F.col("table_no").cast("string"), 2, "0"), F.lit(".md"))
    head = F.coalesce(F.concat(F.lit('<a id="'), anchor, F.lit('"></a>\n')), F.lit(""))
    full = F.concat(head, F.coalesce(F.concat(F.col("caption"), F.lit("\n\n")), F.lit("")), F.col("body_md"), F.coalesce(F.concat(F.lit("\n\n"), F.col("notes_md")), F.lit("")))
    link = F.concat(head, F.lit("["), F.coalesce("caption", F.concat(F.lit("Table "), F.col("table_no").cast("string"))), F.lit("](tables/"), file, F.lit(")"))
    return tables.select("table_id", anchor.alias("anchor"), big.alias("is_big"), F.when(big, file).alias("file"), F.when(big, link).otherwise(full).alias("md"))


def figure_blocks(figures: DataFrame) -> DataFrame:
    """fig_id, label, anchor, md of figures (asset, caption, labels array): anchor, picture, caption, folded labels."""
    kind, num = F.regexp_extract("caption", CAPTION_PARTS, 1), F.regexp_extract("caption", CAPTION_PARTS, 2)
    has = F.coalesce(num, F.lit("")) != ""
    label, anchor = F.when(has, normal_label(kind, num)), F.when(has, label_anchor(kind, num))
    parts = [
        F.concat(F.lit('<a id="'), anchor, F.lit('"></a>')), F.concat(F.lit("!["), F.coalesce(label, F.lit("Figure")), F.lit("]("), F.col("asset"), F.lit(")")), F.col("caption"),
        F.when(F.size("labels") > 0, F.concat(F.lit("<details><summary>Labels in the figure</summary>\n\n"), F.array_join("labels", "; "), F.lit("\n\n</details>"))),
    ]
    return figures.select("fig_id", label.alias("label"), anchor.alias("anchor"), F.concat_ws("\n\n", *parts).alias("md"))


CAPTION_PARTS = r"(?i)^\s*(figure|fig\.?|plate|algorithm)\s+([0-9IVXA-Z][0-9.A-Za-z-]*)"


def place_orphans(captions: DataFrame, blocks: DataFrame) -> DataFrame:
    """cap_id, after_id, before_id: block a caption without figure is put behind, the last of its page above it, or else the
    one it is put before, the first of its page below it; both null if the page has none. captions and blocks: page, y0, seq."""
    a, b = captions.alias("a"), blocks.alias("b")
    above = F.col("b.y0") <= F.col("a.y0")
    both = a.join(b, F.col("a.page") == F.col("b.page"), "left").groupBy(F.col("a.cap_id").alias("cap_id"))
    out = both.agg(F.max_by(F.when(above, F.col("b.block_id")), F.when(above, F.col("b.seq"))).alias("after_id"), F.min_by("b.block_id", "b.seq").alias("first_id"))
    return out.select("cap_id", "after_id", F.when(F.col("after_id").isNull(), F.col("first_id")).alias("before_id"))


def table_issues(tables: DataFrame) -> DataFrame:
    """Checks of tables (book_id, chapter_key, page, block_id, conf, n_cells, n_empty, n_holes, header_inferred, is_html)."""
    p, b, none = F.col("page"), F.col("block_id"), F.lit("")
    return all_issues([
        issue(tables.where("conf < 0.7"), "HIGH", "TABLE_LOW_CONFIDENCE", F.col("conf").cast("string"), p, b),
        issue(tables.where("n_cells > 0 and n_empty > 0.4 * n_cells"), "MEDIUM", "TABLE_SPARSE", F.concat_ws("/", F.col("n_empty").cast("string"), F.col("n_cells").cast("string")), p, b),
        issue(tables.where("n_holes > 0"), "MEDIUM", "TABLE_IRREGULAR", F.col("n_holes").cast("string"), p, b),
        issue(tables.where("header_inferred"), "LOW", "TABLE_HEADER_INFERRED", none, p, b),
        issue(tables.where("is_html"), "LOW", "TABLE_HTML", none, p, b),
    ])


def table_number_issues(tables: DataFrame) -> DataFrame:
    """Tables whose Markdown (md) and cells (raw_numbers) differ in their numbers, those of the caption and the notes excused.
    A table that went to a file of its own is compared by its body (body_md)."""
    counts = lambda c: F.map_from_entries(F.transform(F.array_distinct(c), lambda t: F.struct(t, F.size(F.filter(c, lambda x: x == t)))))
    shown = numeric.tokens(strip_markdown(F.when((F.col("n_rows") > BIG_ROWS) | (F.col("n_rows") * F.col("n_cols") > BIG_CELLS), F.col("body_md")).otherwise(F.col("md"))))
    df = tables.where("raw_numbers is not null").select("*", counts(F.col("raw_numbers")).alias("_a"), counts(F.coalesce(shown, F.array().cast("array<string>"))).alias("_b"), counts(F.coalesce(numeric.tokens(F.col("caption")), F.array().cast("array<string>"))).alias("_c"))
    of = lambda m, t: F.coalesce(F.try_element_at(m, t), F.lit(0))
    every = F.array_union(F.map_keys("_a"), F.map_keys("_b"))
    left = lambda t: of(F.col("_b"), t) - F.least(of(F.col("_c"), t), F.greatest(of(F.col("_b"), t) - of(F.col("_a"), t), F.lit(0)))
    differ = F.array_sort(F.filter(every, lambda t: left(t) != of(F.col("_a"), t)))
    return issue(df.withColumn("_d", differ).where(F.size("_d") > 0), "HIGH", "TABLE_NUMERIC_MISMATCH", F.array_join(F.slice("_d", 1, 6), ", "), F.col("page"), F.col("block_id"))


def count_issues(on_pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Figures on pages and in blocks that differ in number, tables of which none arrived. on_pages: book_id, chapter_key, t."""
    keys = ["book_id", "chapter_key"]
    a = on_pages.groupBy(*keys).agg(F.count_if(F.col("t").isin("figure", "scanned")).alias("figs"), F.count_if(F.col("t") == "table").alias("tabs"))
    z = blocks.groupBy(*keys).agg(F.count_if(F.col("block_type").isin("figure", "unreadable")).alias("fig_blocks"), F.count_if(F.col("block_type") == "table").alias("tab_blocks"))
    df = a.join(z, keys, "left").fillna(0)
    text = F.concat_ws(" / ", F.col("figs").cast("string"), F.col("fig_blocks").cast("string"))
    return all_issues([issue(df.where("figs <> fig_blocks"), "HIGH", "FIGURE_COUNT", text), issue(df.where("tabs > 0 and tab_blocks = 0"), "HIGH", "TABLE_COUNT", F.col("tabs").cast("string"))])


def caption_issues(figures: DataFrame, captions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Figures without caption, captions without figure or table. pairs: book_id, page, fig_no, cap_no."""
    lone = figures.join(pairs, [*PAGE, "fig_no"], "left_anti")
    orphan = captions.join(pairs, [*PAGE, "cap_no"], "left_anti")
    is_table = F.col("text").rlike(r"(?i)^\s*table\b")
    return all_issues([issue(lone, "MEDIUM", "FIGURE_NO_CAPTION", F.lit(""), F.col("page")), issue(orphan.where(F.col("text").rlike(CAPTION)), F.when(is_table, "MEDIUM").otherwise("HIGH"), "CAPTION_ORPHAN", F.col("text"), F.col("page"))])
