"""From lines to blocks: paragraphs, headings, lists, captions, footnotes, references, callouts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text
from vellumspark.operators import hyphen
from vellumspark.operators.folds import fold_groups

CHAPTER = ["book_id", "chapter_key"]
_CAPTION, _BULLET, _DASH, _NUM, _ALPHA = (re.compile(p) for p in (text.CAPTION, text.BULLET, text.DASH, text.NUMBERED, text.ALPHA))
_ENDS = re.compile(r"[.!?:;)\]\"'”’]\s*$")


def marker(raw: str) -> tuple[str, str] | None:
    """(kind, marker) of a line that begins a list item."""
    for kind, p in (("bullet", _BULLET), ("dash", _DASH), ("num", _NUM), ("alpha", _ALPHA)):
        m = p.match(raw)
        if m:
            return kind, m[1]
    return None


def caption_start(raw: str, size: float, bold: bool, body: float) -> bool:
    m = _CAPTION.match(raw)
    return bool(m) and (bold or m[0].rstrip()[-1:] in ".:|" or size < body - 0.4 or bool(re.match(r"\s*[A-Z]{3,}", raw)))


class Segmenter:
    """Fold over the lines of a chapter in reading order. Its state is the open paragraph's marker and the line before;
    whether a line opens a paragraph depends on both, so a window over the line before would not do."""

    def __init__(self, body: float, gap: float, right: dict) -> None:
        self.body, self.gap, self.right = body, gap, right
        self.prev: dict | None = None
        self.marker: tuple[str, str] | None = None
        self.n = 0

    def opens(self, it: dict) -> bool:
        mk = marker(it["raw"])
        fresh = self.prev is None or mk is not None or self._parts(it)
        if fresh:
            self.n, self.marker = 0, mk
        self.n += 1
        self.prev = it
        return fresh

    def _parts(self, it: dict) -> bool:
        p = self.prev
        if abs(it["size"] - p["size"]) > 0.7 or it["box"] != p["box"]:
            return True
        if it["bold"] != p["bold"] and len((it if it["bold"] else p)["raw"]) < 90:
            return True
        if caption_start(it["raw"], it["size"], it["bold"], self.body):
            return True
        ended = bool(_ENDS.search(p["raw"]))
        if (p["page"], p["col"]) != (it["page"], it["col"]):
            goes_on = it["raw"].lstrip()[:1].islower() or it["raw"].lstrip()[:1] in tuple(",;)]")
            return (ended and not goes_on) or it["bold"] != p["bold"]
        gap, indent, size = it["y0"] - p["y1"], it["x0"] - p["x0"], it["size"]
        if gap > self.gap + 0.45 * size:
            return True
        if self.marker is None and ended:
            if gap > -1 and 0.9 * size < indent < 4 * size:
                return True
            if p["x1"] < self.right.get((it["page"], it["col"]), 1e9) - 3.2 * size:
                return True
        return self.marker is not None and indent < -3


def segment_lines(lines: list[dict], body: float, gap: float, right: dict) -> list[int]:
    """Number of the paragraph of each line, from 1."""
    fold, n, out = Segmenter(body, gap, right), 0, []
    for it in lines:
        n += fold.opens(it)
        out.append(n)
    return out


SEGMENTED = (
    "book_id string, chapter_key string, line_id bigint, page int, order_no int, raw string, size double, bold boolean, italic boolean, x0 double, box int, conf double, x1 double, y0 double, y1 double, para_no int"
)


def segment(lines: DataFrame) -> DataFrame:
    """Lines with para_no. ``lines`` has order_no, col, body, gap, right_edge beside the line's own columns. One group is
    one chapter, which is bounded by its book; null sizes count as the body's."""
    cols = ["book_id", "chapter_key", "line_id", "page", "order_no", "raw", "size", "bold", "italic", "x0", "box", "conf", "x1", "y0", "y1", "col", "body", "gap", "right_edge"]

    def fold(rows: list[tuple]) -> list[tuple]:
        items = [dict(zip(cols, r)) for r in rows]
        right = {(it["page"], it["col"]): it["right_edge"] for it in items}
        body, gap = items[0]["body"] or 10.0, items[0]["gap"]
        for it in items:
            it["size"], it["bold"], it["raw"] = it["size"] or body, bool(it["bold"]), it["raw"] or ""
            for c in ("x0", "x1", "y0", "y1"):
                it[c] = it[c] or 0.0
        no = segment_lines(items, body, 2.0 if gap is None else gap, right)
        return [(*r[:15], n) for r, n in zip(rows, no)]

    return fold_groups(lines.select(*cols), CHAPTER, ["page", "order_no", "line_id"], fold, SEGMENTED)


def paragraphs_of(segmented: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """One row per paragraph: text (lines joined), pages, size, bold, italic, n_lines, kind, marker, uncertain (cut words left
    as they are). ``vocab`` holds the words of each book; by default those of the lines themselves."""
    df = segmented
    item = F.struct("page", "order_no", "line_id", F.coalesce("raw", F.lit("")).alias("raw"), "x0", "y0", "x1", "y1")
    grouped = df.groupBy(*CHAPTER, "para_no").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.round(F.max("size"), 1).alias("size"), F.min(F.coalesce("bold", F.lit(False))).alias("bold"), F.min(F.coalesce("italic", F.lit(False))).alias("italic"),
        F.min("x0").alias("x0"), F.max("box").alias("box"), F.min("conf").alias("conf"),
    )
    raws = F.transform("items", lambda x: x["raw"])
    df = grouped.withColumn("raw", F.array_join(raws, "\n")).withColumn("pages", F.array_distinct(F.transform("items", lambda x: x["page"])))
    df = df.withColumn("y0", F.element_at("items", 1)["y0"]).withColumn("y1", F.element_at("items", -1)["y1"]).withColumn("x1", F.array_max(F.transform("items", lambda x: x["x1"])))
    df = df.withColumn("bboxes", page_boxes(F.col("items")))
    first = F.element_at(raws, 1)
    kind = text.list_kind(first)
    df = df.withColumn("n_lines", F.size("items")).withColumn("kind", F.when(kind.isNotNull(), "list").otherwise("para")).withColumn("marker_kind", kind).withColumn("first_size", F.col("size")).drop("items", "first_size")
    if vocab is None:
        vocab = hyphen.inner_words(segmented, ["book_id"], "raw")
    return hyphen.join_lines(df, [*CHAPTER, "para_no"], "raw", vocab, ["book_id"]).withColumnRenamed("joined", "text")


def page_boxes(items: Column) -> Column:
    """Box of a paragraph on each of its pages: page, x0, y0, x1, y1."""
    edge = lambda page, f, c: f(F.transform(F.filter(items, lambda x: x["page"] == page), lambda x: x[c]))
    pages = F.array_distinct(F.transform(items, lambda x: x["page"]))
    return F.transform(pages, lambda p: F.struct(p.alias("page"), edge(p, F.array_min, "x0").alias("x0"), edge(p, F.array_min, "y0").alias("y0"), edge(p, F.array_max, "x1").alias("x1"), edge(p, F.array_max, "y1").alias("y1")))


def heading_conf(ratio: Column, bold: Column, italic: Column, n_lines: Column, c: Column, boxed: Column, is_list: Column) -> Column:
    """Confidence that a paragraph is a heading, 0 to 0.99."""
    base = (
        F.when(ratio >= 1.45, 0.95).when(ratio >= 1.22, 0.9).when(ratio >= 1.1, 0.8).when(bold & (ratio >= 0.97), 0.62).when(bold, 0.4).when(italic & (F.length(c) < 70) & (ratio >= 0.97), 0.35).otherwise(0.0)
    )
    stop = c.endswith(".") & ~c.rlike(r"\b(vs|etc|Dr|Jr|Inc)\.$")
    pts = base - F.when(stop, 0.3).otherwise(0.0) - F.when(F.length(c) > 100, 0.2).otherwise(0.0) - F.when(n_lines > 2, 0.15).otherwise(0.0)
    pts = pts - F.when(c.rlike(r"^\p{Ll}"), 0.4).otherwise(0.0) + F.when(c.rlike(r"^\d+(\.\d+)*\s+\S"), 0.08).otherwise(0.0)
    none = is_list | (n_lines > 3) | boxed | (F.coalesce(F.length(c), F.lit(0)) == 0) | (F.length(c) > 160) | F.trim(c).rlike(text.CALLOUT) | c.rlike(text.CAPTION) | (base == 0)
    return F.when(none, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), pts)), 2))


def heading_levels(heads: DataFrame, keys: list[str]) -> DataFrame:
    """Heads with level: styles (size rounded half to even, bold) in descending order get levels from 2, at most 4."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(F.bround("size", 0)), F.desc(F.coalesce("bold", F.lit(False)).cast("int"))))
    return heads.withColumn("style", F.concat_ws("|", F.bround("size", 0).cast("int").cast("string"), F.when(F.col("bold"), "b").otherwise("n"))).withColumn("level", F.least(rank + 1, F.lit(4)).cast("int"))


def levels_with_memory(heads: DataFrame, memory: DataFrame, keys: list[str]) -> DataFrame:
    """Heads whose style the memory (keys, style, level) knows keep that level; new styles are one deeper than the style
    above them. Two passes over styles, which are few, not over headings."""
    styles = heading_levels(heads, keys).groupBy(*keys, "style").agg(F.max("size").alias("size"), F.max(F.coalesce("bold", F.lit(False)).cast("int")).alias("b"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), (-F.col("b")).alias("b"), "style", "known")))
    lists = styles.join(memory.select(*keys, "style", F.col("level").alias("known")), [*keys, "style"], "left").groupBy(*keys).agg(order.alias("o"))
    empty = F.struct(F.lit(1).alias("prev"), F.array().cast("array<struct<style:string,level:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        level = F.coalesce(x["known"], F.when(acc["prev"] >= 2, F.least(acc["prev"] + 1, F.lit(4))).otherwise(2)).cast("int")
        return F.struct(level.alias("prev"), F.concat(acc["out"], F.array(F.struct(x["style"].alias("style"), F.least(level, F.lit(4)).alias("level")))).alias("out"))

    flat = lists.select(*keys, F.explode(F.aggregate("o", empty, step)["out"]).alias("p")).select(*keys, "p.style", "p.level")
    return heading_levels(heads, keys).drop("level").join(flat, [*keys, "style"])


def list_levels(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items with depth: distinct indents, rounded to 4 points, in ascending order from 0."""
    return items.withColumn("depth", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.round(F.col("x0") / 4, 0) * 4)) - 1)


def render_list(items: list[tuple[float, str]]) -> str:
    """Markdown of a list of (x0, line): markers as ``n.`` or ``-``, children under the text of their parent."""
    xs = sorted({round(x / 4) * 4 for x, _ in items})
    depth = {x: k for k, x in enumerate(xs)}
    stack: list[int] = []
    out = []
    for x, raw in items:
        level = depth[round(x / 4) * 4]
        stack = stack[:level] + [0] * (level - len(stack))
        mk = marker(raw)
        body = raw.strip()
        sign = "-"
        if mk:
            body = raw.strip()[len(mk[1]) :].strip()
            if mk[0] == "num":
                sign = re.sub(r"\D", "", mk[1]) + "."
            elif mk[0] == "alpha":
                body = f"{mk[1]} {body}"
        out.append(" " * sum(stack) + f"{sign} {body}")
        stack.append(len(sign) + 1)
    return "\n".join(out)


def list_blocks(blocks: DataFrame) -> DataFrame:
    """block_id, n_items, md of list blocks, from their raw lines."""
    lines = F.filter(F.split("raw", "\n"), lambda x: F.trim(x) != "")
    sign = lambda x: (
        F.when(x.rlike(text.NUMBERED), F.concat(F.regexp_extract(x, r"(\d+)", 1), F.lit(". "), F.regexp_extract(x, text.NUMBERED, 2)))
        .when(x.rlike(text.ALPHA), F.concat(F.lit("- "), F.trim(x)))
        .when(x.rlike(text.BULLET) | x.rlike(text.DASH), F.concat(F.lit("- "), F.regexp_replace(F.trim(x), r"^\S\s*", "")))
        .otherwise(F.concat(F.lit("  "), F.trim(x)))
    )
    items = F.filter(lines, lambda x: text.list_kind(x).isNotNull())
    return blocks.where("block_type = 'list' and raw is not null").select("block_id", F.size(items).cast("bigint").alias("n_items"), F.array_join(F.transform(lines, sign), "\n").alias("list_md"))


def match_captions(figures: DataFrame, captions: DataFrame, reach: float = 90.0, keys: list[str] | None = None) -> DataFrame:
    """keys (page), fig_no, cap_no, distance: each caption goes to the nearest free figure of its page within reach that it
    overlaps sideways. Greedy and one to one, so the pairs of one page are folded in order of distance."""
    keys = keys or ["page"]
    a, b = figures.select(*keys, "fig_no", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")]), captions.select(*keys, "cap_no", "x0", "y0", "x1", "y1")
    d = F.greatest(F.col("y0") - F.col("a_y1"), F.col("a_y0") - F.col("y1"), F.lit(0.0))
    near = a.join(b, keys).where("a_x0 <= x1 and a_x1 >= x0").select(*keys, "fig_no", "cap_no", d.alias("d")).where(F.col("d") < reach)
    item = F.array_sort(F.collect_list(F.struct("d", "fig_no", "cap_no")))
    empty = F.array().cast("array<struct<d:double,fig_no:int,cap_no:int>>")

    def step(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda y: (y["fig_no"] == x["fig_no"]) | (y["cap_no"] == x["cap_no"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(x)))

    return near.groupBy(*keys).agg(F.aggregate(item, empty, step).alias("p")).select(*keys, F.explode("p").alias("x")).select(*keys, "x.fig_no", "x.cap_no", F.round("x.d", 2).alias("distance"))


def link_footnotes(paras: DataFrame, notes: DataFrame) -> DataFrame:
    """note_id, para_id of the nearest paragraph before a note on its page that holds its mark; null if there is none."""
    a, b = notes.alias("a"), paras.alias("b")
    hit = (F.col("a.page") == F.col("b.page")) & (F.col("b.seq") < F.col("a.seq")) & F.contains(F.col("b.text"), F.col("a.mark"))
    return a.join(b, hit, "left").groupBy(F.col("a.note_id").alias("note_id")).agg(F.max_by("b.para_id", "b.seq").alias("para_id"))


def callout_groups(paras: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, box, group_no, n, first_seq: runs of neighbours in the same box on the same page."""
    w = Window.partitionBy(*keys).orderBy("seq", "para_id")
    same = F.col("box").eqNullSafe(F.lag("box").over(w)) & (F.col("page") == F.lag("page").over(w))
    df = paras.withColumn("_f", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("group_no", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.where("box is not null").groupBy(*keys, "page", "box", "group_no").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def classify(paras: DataFrame, heading: Column) -> DataFrame:
    """Paras with block_type, tests in the order heading, caption, reference, list, formula, paragraph. Whether a
    reference list is open is the title of the last heading, a window; no fold is needed for it."""
    w = Window.partitionBy(*CHAPTER).orderBy("seq", "para_id").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(heading, F.trim("text"))
    df = paras.withColumn("_open", F.last(title, ignorenulls=True).over(w))
    formula = (F.col("n_lines") == 1) & (F.length("text") <= 140) & F.contains("text", F.lit("=")) & F.col("text").rlike("[×÷±≥≤≠≈−√∑∫∞αβγδΔµπσλθ→²³]")
    kind = (
        F.when(heading, "heading").when(F.col("text").rlike(text.CAPTION) & (F.col("n_lines") <= 3), "caption").when(F.coalesce(F.col("_open").rlike(text.REFERENCES), F.lit(False)), "reference")
        .when(text.list_kind(F.col("text")).isNotNull(), "list").when(formula, "formula").otherwise("paragraph")
    )
    return df.withColumn("block_type", kind).drop("_open")


def merge_tables(tables: DataFrame) -> DataFrame:
    """table_id, chain: a table goes on in the next one if that is simple, of as many columns, on the next page and near
    its head. The chain is a running sum of its breaks."""
    w = Window.partitionBy(*CHAPTER).orderBy("page", "table_id")
    goes_on = (F.col("page") == F.lag("page").over(w) + 1) & (F.col("n_cols") == F.lag("n_cols").over(w)) & F.col("simple") & F.lag("simple").over(w) & (F.col("y0") < 140)
    df = tables.withColumn("_f", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return df.withColumn("chain", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")
