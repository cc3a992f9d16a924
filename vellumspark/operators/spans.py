"""From styled spans and words to lines: dominant size, emphasis, raised and lowered text, list marks drawn apart, formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import normalize_chars
from vellumspark.model import BOLD, ITALIC, SUB, SUP
from vellumspark.operators.assemble import merge_runs

LINE = ["book_id", "page", "line_no"]
MARK_ONLY = r"^\s*(?:[•·▪●◦○■▫‣⁃∙–—-]|\(?\d{1,3}[.)]|\(?[a-h][.)])\s*$"
# Signs in formulas.
LATEX = {
    "×": r"\times ", "÷": r"\div ", "±": r"\pm ", "≥": r"\geq ", "≤": r"\leq ", "≠": r"\neq ", "≈": r"\approx ", "−": "-", "–": "-", "√": r"\sqrt", "∑": r"\sum ", "∫": r"\int ", "∞": r"\infty ", "α": r"\alpha ",
    "β": r"\beta ", "γ": r"\gamma ", "δ": r"\delta ", "Δ": r"\Delta ", "μ": r"\mu ", "µ": r"\mu ", "π": r"\pi ", "σ": r"\sigma ", "λ": r"\lambda ", "θ": r"\theta ", "→": r"\rightarrow ", "°": r"^{\circ}", "·": r"\cdot ",
}


def is_bold(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(F.lit(16)) != 0) | F.lower(font).rlike("bold|black|heavy|semibold|-bd|demi")


def is_italic(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(F.lit(2)) != 0) | F.lower(font).rlike("italic|oblique")


def lines_of_spans(spans: DataFrame) -> DataFrame:
    """One line per (book_id, page, line_no) of spans (span_no, text, font, flags, size, x0, y0, x1, y1).

    The longest span, of equals the first, gives size and base line; smaller spans well above or below it are raised or
    lowered. A line is bold or italic if four fifths of its characters are. Lines without text are dropped.
    """
    n = F.length(F.trim("text"))
    base = F.col("y1") - F.col("size") * 0.22
    df = spans.where("text <> ''").withColumn("n", n).withColumn("base", base).withColumn("b", is_bold(F.col("font"), F.col("flags"))).withColumn("i", is_italic(F.col("font"), F.col("flags")))
    w = Window.partitionBy(*LINE).orderBy(F.desc("n"), "span_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("dom", F.first("size").over(w)).withColumn("dom_base", F.first("base").over(w))
    small = F.col("size") <= F.col("dom") * 0.86
    bits = F.when(F.col("b"), BOLD).otherwise(0) + F.when(F.col("i"), ITALIC).otherwise(0)
    bits = bits + F.when(small & (F.col("base") < F.col("dom_base") - F.col("dom") * 0.18), SUP).when(small & (F.col("base") > F.col("dom_base") + F.col("dom") * 0.12), SUB).otherwise(0)
    item = F.struct("span_no", normalize_chars(F.col("text")).alias("text"), bits.alias("bits"), F.lit(None).cast("int").alias("mark"))
    total = F.greatest(F.sum("n"), F.lit(1))
    out = df.groupBy(*LINE).agg(
        F.array_sort(F.collect_list(item)).alias("s"), F.round(F.first("dom"), 2).alias("size"), F.round(F.min("x0"), 2).alias("x0"), F.round(F.min("y0"), 2).alias("y0"), F.round(F.max("x1"), 2).alias("x1"), F.round(F.max("y1"), 2).alias("y1"),
        (F.sum(F.when(F.col("b"), F.col("n")).otherwise(0)) >= total * 0.8).alias("bold"), (F.sum(F.when(F.col("i"), F.col("n")).otherwise(0)) >= total * 0.8).alias("italic"),
    )
    plain = F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["bits"].alias("bits"), x["mark"].alias("mark")))
    out = out.withColumn("spans", merge_runs(plain)).withColumn("raw", F.array_join(F.transform("s", lambda x: x["text"]), "")).drop("s")
    return out.where("trim(raw) <> ''")


def attach_marks(lines: DataFrame) -> DataFrame:
    """Lines in which a list mark drawn by itself goes before the text on its row: at least half as high in common, to its
    right within two and a half sizes, the leftmost. The page is the key of the join; marks are few."""
    is_mark = F.col("raw").rlike(MARK_ONLY)
    a, b = lines.where(is_mark).alias("a"), lines.where(~is_mark).alias("b")
    common = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    gap = F.col("b.x0") - F.col("a.x1")
    near = (common >= F.least(F.col("a.y1") - F.col("a.y0"), F.col("b.y1") - F.col("b.y0")) * 0.5) & (gap >= 0) & (gap < F.greatest("a.size", F.lit(8.0)) * 2.5)
    pairs = a.join(b, (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.page") == F.col("b.page")) & near).groupBy(F.col("a.line_id").alias("mark_id")).agg(F.min_by("b.line_id", F.struct("b.x0", "b.line_id")).alias("line_id"), F.first(F.trim("a.raw")).alias("sign"), F.first("a.x0").alias("mark_x0"))
    one = pairs.groupBy("line_id").agg(F.min_by(F.struct("mark_id", "sign", "mark_x0"), F.struct("mark_x0", "mark_id")).alias("m"))
    df = lines.join(one, "line_id", "left").join(one.select(F.col("m.mark_id").alias("line_id")), "line_id", "left_anti")
    return df.withColumn("raw", F.when(F.col("m").isNotNull(), F.concat_ws(" ", "m.sign", "raw")).otherwise(F.col("raw"))).withColumn("x0", F.coalesce(F.least("x0", "m.mark_x0"), "x0")).drop("m")


def to_latex(spans: Column) -> Column:
    """LaTeX of the spans of a formula: words as text, signs by the table, raised and lowered parts in braces, a root over
    its bracket (up to two levels of brackets inside)."""

    def one(s: Column) -> Column:
        t = F.regexp_replace(s["text"], r"([A-Za-z]{2,}(?: [A-Za-z]{2,})*)", "\x01$1\x02")
        t = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1].replace("\\", "\x03"))), LATEX.items(), t)
        t = F.regexp_replace(F.regexp_replace(t, "([%&#])", "\x03$1"), "\x01([^\x02]*)\x02", "\x03text{$1}")
        has = lambda bit: s["bits"].bitwiseAND(F.lit(bit)) != 0
        return F.when(has(SUP), F.concat(F.lit("^{"), F.trim(t), F.lit("}"))).when(has(SUB), F.concat(F.lit("_{"), F.trim(t), F.lit("}"))).otherwise(t)

    flat = F.regexp_replace(F.array_join(F.transform(merge_runs(spans), one), ""), r"\s+", " ")
    rooted = F.regexp_replace(flat, "\x03sqrt\\(((?:[^()]|\\((?:[^()]|\\([^()]*\\))*\\))*)\\)", "\x03sqrt{$1}")
    return F.trim(F.replace(rooted, F.lit("\x03"), F.lit("\\")))
