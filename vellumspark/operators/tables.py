"""Tables out of lines of text: where they stand, their grid, their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.operators.layout import PAGE, cluster_edges

GAP_LINES, LEAST_HEIGHT, LEAST_ROWS, LEAST_COLUMNS = 2.6, 25.0, 2, 3
CAPTION = r"(?i)^\s*table\s+[0-9IVXA-Z]+[0-9.A-Za-z-]*"
BASE = {"ruled": 0.92, "text": 0.62}  # confidence of a grid by how it was found


def table_regions(lines: DataFrame) -> DataFrame:
    """Lines below the caption of a table, with table_id (the caption's line_id) and strategy ``text``: from the caption down to
    the first gap of more than GAP_LINES lines or the next caption. A running gap test, so a window; a page is small."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_id")
    is_cap = F.coalesce(F.col("raw").rlike(CAPTION), F.lit(False))
    df = lines.where("y0 is not null and y1 is not null and x0 is not null").withColumn("_cap", is_cap).withColumn("_bottom", F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    wide = F.col("y0") - F.col("_bottom") > GAP_LINES * F.coalesce("size", F.lit(10.0))
    df = df.withColumn("_run", F.sum(F.when(F.col("_cap") | F.coalesce(wide, F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    head = Window.partitionBy(*PAGE, "_run").orderBy("y0", "x0", "line_id")
    df = df.withColumn("_first", F.first(F.struct("line_id", "_cap", "y0")).over(head))
    return df.where("_first._cap and not _cap").withColumn("table_id", F.col("_first.line_id")).withColumn("strategy", F.lit("text")).drop("_cap", "_bottom", "_run", "_first")


def grids(cells: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Cells (table_id, line_id, x0, y0, x1, y1, raw) with r, c, cs: rows by their upper, columns by their left edges, which may
    be apart by ``tolerance``; a cell over further columns spans them. Edges of one table are few, so they are counted, not sorted
    over the collection."""
    keys = ["table_id"]
    rows, cols = cluster_edges(cells, keys, "y0", tolerance).select(*keys, F.col("edge").alias("ye")), cluster_edges(cells, keys, "x0", tolerance).select(*keys, F.col("edge").alias("xe"))
    edges = cells.select(*keys).distinct().join(rows.groupBy(*keys).agg(F.array_sort(F.collect_list("ye")).alias("_ys")), keys).join(cols.groupBy(*keys).agg(F.array_sort(F.collect_list("xe")).alias("_xs")), keys)
    near = lambda es, v: F.size(F.filter(es, lambda e: e <= v + tolerance)) - 1
    df = cells.join(edges, keys).withColumn("r", near(F.col("_ys"), F.col("y0"))).withColumn("c", near(F.col("_xs"), F.col("x0")))
    over = F.size(F.filter("_xs", lambda e: (e > F.col("x0") + tolerance) & (e < F.col("x1") - tolerance)))
    return df.withColumn("cs", F.lit(1) + over).drop("_ys", "_xs")


def found_tables(lines: DataFrame) -> DataFrame:
    """table_id, book_id, page, x0, y0, x1, y1, n_rows, n_cols, n_cells, n_filled, strategy, conf of the tables below captions: of
    LEAST_ROWS by LEAST_COLUMNS or more and LEAST_HEIGHT points, and no mere box."""
    cells = grids(table_regions(lines))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    per = cells.groupBy("table_id", *PAGE, "strategy").agg(*box, (F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"), F.count("*").alias("n_cells"), F.count_if(F.trim("raw") != "").alias("n_filled"))
    ok = per.where((F.col("n_rows") >= LEAST_ROWS) & (F.col("n_cols") >= LEAST_COLUMNS) & (F.col("y1") - F.col("y0") >= LEAST_HEIGHT))
    return not_boxes(ok).withColumn("conf", F.lit(BASE["text"]))


def not_boxes(tables: DataFrame) -> DataFrame:
    """Tables but those of two cells or fewer, or one with text: drawn boxes."""
    return tables.where("n_cells > 2 and n_filled > 1")


def usual_strategy(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, strategy: how most tables were found; of equals the first by name."""
    n = tables.groupBy(*keys, "strategy").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min_by("strategy", F.struct((-F.col("n")).alias("n"), "strategy")).alias("strategy"))


def figure_labels(figures: DataFrame, lines: DataFrame) -> DataFrame:
    """fig_id, labels: lines whose centre stands in a figure, from the top, by an equality join on the page."""
    a, b = figures.select("fig_id", *PAGE, *[F.col(c).alias(f"f{c}") for c in ("x0", "y0", "x1", "y1")]), lines.where("raw is not null")
    inside = ((F.col("x0") + F.col("x1")) / 2).between(F.col("fx0"), F.col("fx1")) & ((F.col("y0") + F.col("y1")) / 2).between(F.col("fy0"), F.col("fy1"))
    rows = a.join(b, PAGE).where(inside).groupBy("fig_id").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "line_id", F.trim("raw").alias("raw")))).alias("l"))
    return rows.select("fig_id", F.transform("l", lambda x: x["raw"]).alias("labels"))


def outside_removed(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows (lines or numbers with a box) that no removed head or foot of their page overlaps."""
    r = removed.select(*[F.col(c).alias(f"r_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")])
    touch = (F.col("x0") <= F.col("r_x1")) & (F.col("x1") >= F.col("r_x0")) & (F.col("y0") <= F.col("r_y1")) & (F.col("y1") >= F.col("r_y0"))
    return rows.join(r, (F.col("book_id") == F.col("r_book_id")) & (F.col("page") == F.col("r_page")) & touch, "left_anti")
