"""Sections, anchors, page markers, line numbers, source map, Markdown rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import escape_line_start, escape_md, fingerprint, slugify
from vellumspark.model import BOLD, ITALIC, SUB, SUP

CHAPTER = ["book_id", "chapter_key"]


def heading_paths(blocks: DataFrame) -> DataFrame:
    """Blocks with section_no, path (titles of the open headings from level 1 down) and section_level.

    A heading closes all headings of its level or deeper. The last heading of each level is a window per level, and a
    deeper one counts only if it came after every shallower one, so no stack is carried along.
    """
    w = Window.partitionBy(*CHAPTER).orderBy("seq", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("block_type") == "heading"
    level = F.when(is_head, F.least(F.greatest(F.coalesce("h_level", F.lit(2)), F.lit(1)), F.lit(6)))
    df = blocks.withColumn("_l", level).withColumn("section_no", F.sum(F.when(is_head, 1).otherwise(0)).over(w))
    for k in range(1, 7):
        here = F.when(F.col("_l") == k, F.struct("seq", "block_id", F.col("clean").alias("title")))
        df = df.withColumn(f"_h{k}", F.last(here, ignorenulls=True).over(w))
    kept = []
    for k in range(1, 7):
        above = [F.col(f"_h{j}.seq") for j in range(1, k)]
        later = reduce(Column.__and__, [F.coalesce(a < F.col(f"_h{k}.seq"), F.lit(True)) for a in above], F.col(f"_h{k}").isNotNull())
        kept.append(F.when(later, F.struct(F.lit(k).alias("level"), F.col(f"_h{k}.title").alias("title"))))
    path = F.filter(F.array(*kept), lambda x: x.isNotNull())
    df = df.withColumn("_p", path).withColumn("path", F.transform("_p", lambda x: x["title"])).withColumn("section_level", F.try_element_at("_p", F.lit(-1))["level"])
    return df.drop("_l", "_p", *[f"_h{k}" for k in range(1, 7)])


def sections(blocks: DataFrame) -> DataFrame:
    """One row per heading: section_no, level, title, path, parent title, section_id.

    The id is the slug of the title; if it collides in its chapter, the parent's slug goes before it, and what still
    collides is numbered from 2 in document order.
    """
    heads = heading_paths(blocks).where("block_type = 'heading'").select(*CHAPTER, "seq", "block_id", "section_no", F.col("section_level").alias("level"), F.col("clean").alias("title"), "path")
    heads = heads.withColumn("slug", slugify(F.coalesce("title", F.lit("")))).withColumn("parent", F.try_element_at("path", F.lit(-2)))
    heads = heads.withColumn("parent_slug", F.when(F.col("parent").isNotNull(), slugify(F.col("parent"))))
    first = F.row_number().over(Window.partitionBy(*CHAPTER, "slug").orderBy("seq", "block_id"))
    heads = heads.withColumn("_n", first).withColumn("base", F.when((F.col("_n") == 1) | F.col("parent_slug").isNull(), F.col("slug")).otherwise(F.concat_ws("-", "parent_slug", "slug")))
    again = F.row_number().over(Window.partitionBy(*CHAPTER, "base").orderBy("seq", "block_id"))
    heads = heads.withColumn("_m", again).withColumn("section_id", F.when(F.col("_m") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("_m").cast("string"))))
    return heads.drop("_n", "_m", "slug", "parent_slug", "base")


def heading_anchors(heads: DataFrame, title: str = "title") -> DataFrame:
    """Anchor of each heading: lower case, no punctuation, blanks as dashes; repeats get -1, -2 in document order."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.col(title)), r"[^\p{L}\p{N}_ -]", ""), " ", "-")
    n = F.row_number().over(Window.partitionBy(*CHAPTER, "anchor_slug").orderBy("seq", "block_id")) - 1
    out = heads.withColumn("anchor_slug", slug).withColumn("_n", n)
    return out.withColumn("anchor", F.when(F.col("_n") == 0, F.col("anchor_slug")).otherwise(F.concat_ws("-", "anchor_slug", F.col("_n").cast("string")))).drop("_n", "anchor_slug")


def source_map(blocks: DataFrame) -> DataFrame:
    """block_id, page_marker (page named before the block, or null), line_start, line_end, fingerprint.

    A marker line stands before a block whose first page differs from the last page of the block before; each block ends
    with an empty line. Blocks without text or pages take no marker.
    """
    w = Window.partitionBy(*CHAPTER).orderBy("seq", "block_id")
    first, last = F.try_element_at("pages", F.lit(1)), F.try_element_at("pages", F.lit(-1))
    df = blocks.where("md is not null").withColumn("_prev", F.lag(last).over(w))
    marker = F.when(first.isNotNull() & (F.col("_prev").isNull() | (first != F.col("_prev"))), first)
    n_lines = F.length("md") - F.length(F.replace("md", F.lit("\n"), F.lit(""))) + 1
    df = df.withColumn("page_marker", marker).withColumn("_n", n_lines).withColumn("_lead", F.when(marker.isNotNull(), 2).otherwise(0))
    before = F.coalesce(F.sum(F.col("_n") + F.col("_lead") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + F.col("_lead") + 1
    return df.select(*CHAPTER, "block_id", "block_type", "section_id", "page_marker", start.alias("line_start"), (start + F.col("_n") - 1).alias("line_end"), fingerprint(F.coalesce("clean", "md")).alias("fingerprint"), "conf")


def markdown(blocks: DataFrame) -> DataFrame:
    """Markdown of each chapter: its blocks in order with page markers, an empty line after each."""
    marked = source_map(blocks).select("block_id", "page_marker").join(blocks, "block_id")
    text = F.concat(F.coalesce(F.concat(F.lit("<!-- source_page: "), F.col("page_marker").cast("string"), F.lit(" -->\n\n")), F.lit("")), F.col("md"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "block_id", text.alias("t"))))
    return marked.groupBy(*CHAPTER).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("markdown"), F.count("*").alias("n_blocks"))


def contents(blocks: DataFrame, least: int = 3) -> DataFrame:
    """book_id, chapter_key, toc: linked list of the headings of levels 2 and 3 of chapters with ``least`` of level 2."""
    heads = heading_anchors(blocks.where("block_type = 'heading' and clean is not null"), "clean").where("h_level in (2, 3)")
    line = F.concat(F.when(F.col("h_level") == 3, "  - [").otherwise("- ["), F.col("clean"), F.lit("](#"), F.col("anchor"), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("seq", "block_id", line.alias("line"))))
    per = heads.groupBy(*CHAPTER).agg(F.count_if(F.col("h_level") == 2).alias("n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("list"))
    return per.where(F.col("n") >= least).select(*CHAPTER, F.concat(F.lit("<!-- generated:toc -->\n"), F.col("list"), F.lit("\n<!-- /generated:toc -->")).alias("toc"))


def document(blocks: DataFrame, chapters: DataFrame, fields: tuple[str, ...] = ("title", "chapter_no")) -> DataFrame:
    """Markdown of each chapter as ``markdown`` gives it, with front matter (``fields`` of the chapter) and contents list in
    ``head``, which stands before it in the file but does not count in line numbers."""
    about = front_matter(chapters.groupBy(*CHAPTER).agg(*[F.min(f).alias(f) for f in fields]), list(fields)).select(*CHAPTER, "front_matter")
    df = markdown(blocks).join(about, CHAPTER, "left").join(contents(blocks), CHAPTER, "left")
    return df.withColumn("head", F.concat_ws("\n\n", "front_matter", "toc")).drop("front_matter", "toc")


def merge_runs(spans: Column) -> Column:
    """Neighbouring spans of equal style, without a page mark between, as one; empty spans are dropped."""
    empty = F.array().cast("array<struct<text:string,bits:int,mark:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.concat(last["text"], s["text"]).alias("text"), s["bits"].alias("bits"), last["mark"].alias("mark"))))
        same = (F.size(acc) > 0) & (last["bits"] == s["bits"]) & s["mark"].isNull()
        return F.when(F.coalesce(s["text"], F.lit("")) == "", acc).when(same, joined).otherwise(F.concat(acc, F.array(F.struct(s["text"].alias("text"), s["bits"].alias("bits"), s["mark"].alias("mark")))))

    return F.aggregate(spans, empty, step)


def spans_to_md(spans: Column) -> Column:
    """Markdown of styled spans: emphasis hugs the text, page marks stay inline, runs of blanks become one."""

    def one(s: Column) -> Column:
        has = lambda bit: s["bits"].bitwiseAND(F.lit(bit)) != 0
        lead, trail, core = F.regexp_extract(s["text"], r"^\s*", 0), F.regexp_extract(s["text"], r"\s*$", 0), escape_md(F.trim(s["text"]))
        core = F.when(has(SUP), F.concat(F.lit("<sup>"), core, F.lit("</sup>"))).when(has(SUB), F.concat(F.lit("<sub>"), core, F.lit("</sub>"))).otherwise(core)
        mark = F.when(has(BOLD) & has(ITALIC), "***").when(has(BOLD), "**").when(has(ITALIC), "*").otherwise("")
        page = F.coalesce(F.concat(F.lit(" <!-- source_page: "), s["mark"].cast("string"), F.lit(" --> ")), F.lit(""))
        return F.concat(page, F.when(F.trim(s["text"]) == "", s["text"]).otherwise(F.concat(lead, mark, core, mark, trail)))

    return F.trim(F.regexp_replace(F.array_join(F.transform(merge_runs(spans), one), ""), " {2,}", " "))


def spans_to_html(spans: Column) -> Column:
    def one(s: Column) -> Column:
        has = lambda bit: s["bits"].bitwiseAND(F.lit(bit)) != 0
        t = s["text"]
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            t = F.replace(t, F.lit(a), F.lit(b))
        for bit, tag in ((SUP, "sup"), (SUB, "sub"), (ITALIC, "i"), (BOLD, "b")):
            t = F.when(has(bit), F.concat(F.lit(f"<{tag}>"), t, F.lit(f"</{tag}>"))).otherwise(t)
        return t

    return F.array_join(F.transform(merge_runs(spans), one), "")


def gfm_table(rows: DataFrame, keys: list[str], row: str, col: str, cell: str) -> DataFrame:
    """Pipe table of each key: pipes escaped, the first row as header, missing cells empty, rows of equal width."""
    text = F.replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit("<br>"))
    per_row = rows.groupBy(*keys, row).agg(F.map_from_entries(F.collect_list(F.struct(F.col(col).alias("k"), text.alias("v")))).alias("cells"), F.max(col).alias("m"))
    width = F.max("m").over(Window.partitionBy(*keys)) + 1
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda i: F.coalesce(F.try_element_at("cells", i.cast("int")), F.lit(""))), " | "), F.lit(" |"))
    per_row = per_row.withColumn("w", width.cast("int")).withColumn("line", line)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), "line"))), lambda x: x["line"])
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.max("w")))
    return per_row.groupBy(*keys).agg(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n").alias("gfm"), F.count("*").alias("n_rows"), F.max("w").alias("n_cols"))


def html_table(cells: DataFrame, keys: list[str]) -> DataFrame:
    """HTML table of cells with row and column spans; covered positions do not occur as cells. Columns: r, c, rs, cs, raw, header."""
    t = F.col("raw")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    tag = F.when(F.col("header"), "th").otherwise("td")
    attrs = F.concat(
        F.when(F.col("rs") > 1, F.concat(F.lit(' rowspan="'), F.col("rs").cast("string"), F.lit('"'))).otherwise(""), F.when(F.col("cs") > 1, F.concat(F.lit(' colspan="'), F.col("cs").cast("string"), F.lit('"'))).otherwise("")
    )
    cell = F.concat(F.lit("<"), tag, attrs, F.lit(">"), F.coalesce(t, F.lit("")), F.lit("</"), tag, F.lit(">"))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", cell.alias("t")))), lambda x: x["t"]), "")
    rows = cells.groupBy(*keys, "r").agg(F.concat(F.lit("<tr>"), row, F.lit("</tr>")).alias("tr"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tr"))), lambda x: x["tr"]), "\n")
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>\n"), body, F.lit("\n</table>")).alias("html"))


def front_matter(chapters: DataFrame, fields: list[str]) -> DataFrame:
    """YAML front matter of each chapter, fields in the order given, nulls as empty."""
    quoted = lambda f: F.concat(F.lit('"'), F.replace(F.replace(F.col(f).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(quoted(f), F.lit('""'))) for f in fields]
    body = F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))
    return chapters.withColumn("front_matter", body)


def paragraph_md(text: Column) -> Column:
    return escape_line_start(escape_md(text))
