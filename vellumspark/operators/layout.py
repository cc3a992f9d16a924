"""Lines on pages: zones, columns, reading order, gutters, running lines, body size, boxes, table grids."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import norm_pattern
from vellumspark.operators.folds import fold_groups

PAGE = ["book_id", "page"]


def body_size(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, body: size (one decimal) that most characters have; of equals the smaller."""
    n = lines.where("size is not null and raw is not null").groupBy(*keys, F.round("size", 1).alias("body")).agg(F.sum(F.length(F.trim("raw"))).alias("n"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "body"))
    return n.withColumn("_k", first).where("_k = 1").select(*keys, "body")


def line_gap(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gap: median gap between neighbouring lines of like size on a page, between -2 and 1.5 sizes. Where ``lines`` has
    its column (``col``), neighbours are of one column."""
    w = Window.partitionBy(*PAGE).orderBy("seq", "line_id")
    df = lines.withColumn("gap", F.col("y0") - F.lag("y1").over(w)).withColumn("d", F.abs(F.col("size") - F.lag("size").over(w)))
    if "col" in lines.columns:
        df = df.withColumn("_same", F.col("col") == F.lag("col").over(w)).where("_same")
    return df.where((F.col("d") < 0.3) & (F.col("gap") > -2) & (F.col("gap") < F.col("size") * 1.5)).groupBy(*keys).agg(F.round(F.median("gap"), 4).alias("gap"))


def zone_lines(lines: DataFrame) -> DataFrame:
    """Lines in the head or foot zone, with the pattern they would be recognised by."""
    return lines.where("zone in ('top', 'bottom') and raw is not null").withColumn("pattern", norm_pattern(F.col("raw"))).where("pattern <> ''")


def book_patterns(lines: DataFrame, share: float = 0.25, least: int = 3) -> DataFrame:
    """book_id, pattern, n_pages of zone lines on a share of the book's pages."""
    pages = lines.select("book_id", "page").distinct().groupBy("book_id").agg(F.count("*").alias("k"))
    n = zone_lines(lines).select("book_id", "pattern", "page").distinct().groupBy("book_id", "pattern").agg(F.count("*").alias("n_pages"))
    return n.join(pages, "book_id").where(F.col("n_pages") >= F.greatest(F.lit(least), F.col("k") * share)).drop("k")


def chapter_patterns(lines: DataFrame, share: float = 0.6) -> DataFrame:
    """book_id, chapter_key, pattern of zone lines on 60 % of the chapter's pages; chapters of one page have none."""
    keys = ["book_id", "chapter_key"]
    pages = lines.select(*keys, "page").distinct().groupBy(*keys).agg(F.count("*").alias("k")).where("k >= 2")
    n = zone_lines(lines).select(*keys, "pattern", "page").distinct().groupBy(*keys, "pattern").agg(F.count("*").alias("n_pages"))
    return n.join(pages, keys).where(F.col("n_pages") >= F.greatest(F.lit(2), F.floor(F.col("k") * share + 0.5))).drop("k")


def without_running(lines: DataFrame) -> DataFrame:
    """Lines with ``removed``: zone lines that are book or chapter patterns or bare page numbers. Other zone lines keep
    their text and lose their zone (``kept_zone`` is null)."""
    of_book = book_patterns(lines).select("book_id", "pattern", F.lit(True).alias("of_book"))
    of_chapter = chapter_patterns(lines).select("book_id", "chapter_key", "pattern", F.lit(True).alias("of_chapter"))
    df = lines.withColumn("pattern", F.when(F.col("zone").isin("top", "bottom"), norm_pattern(F.col("raw"))))
    df = df.join(of_book, ["book_id", "pattern"], "left").join(of_chapter, ["book_id", "chapter_key", "pattern"], "left")
    number = F.col("pattern").rlike(r"^(?:page\s*)?#+$") | F.col("pattern").rlike("^[ivxlc]+$")
    gone = F.col("pattern").isNotNull() & (F.coalesce("of_book", F.lit(False)) | F.coalesce("of_chapter", F.lit(False)) | F.coalesce(number, F.lit(False)))
    return df.withColumn("removed", gone).withColumn("kept_zone", F.when(gone, F.col("zone"))).drop("of_book", "of_chapter", "pattern")


def page_box(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PAGE).agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("y0").alias("top"), F.max("y1").alias("bottom"))


def gutters(lines: DataFrame, page_width: float = 612.0) -> DataFrame:
    """book_id, page, gutter of two-column pages.

    Each narrow line crosses a range of whole x. Where ranges begin (+1) and end (-1) a running sum changes, so stretches
    between such places, not positions, are counted. Runs of 8 or more positions that few lines cross are gaps, the widest wins.
    """
    w = Window.partitionBy(*PAGE)
    body = lines.where("zone is null or zone = 'body'").withColumn("n", F.count("*").over(w)).withColumn("a", F.min("x0").over(w)).withColumn("b", F.max("x1").over(w))
    body = body.where((F.col("n") >= 8) & (F.col("b") - F.col("a") >= page_width * 0.4))
    narrow = body.where((F.col("x1") - F.col("x0") < (F.col("b") - F.col("a")) * 0.62) & (F.length(F.trim("raw")) > 2)).withColumn("m", F.count("*").over(w)).where("m >= 8")
    lo, hi = F.floor(F.col("a") + (F.col("b") - F.col("a")) * 0.3).cast("int"), F.floor(F.col("a") + (F.col("b") - F.col("a")) * 0.7).cast("int")
    first, last = F.floor(F.col("x0") + 0.5).cast("int") + 1, F.ceil(F.col("x1") - 0.5).cast("int")
    ends = F.array(F.struct(first.alias("x"), F.when(last > first, 1).otherwise(0).alias("d")), F.struct(last.alias("x"), F.when(last > first, -1).otherwise(0).alias("d")), F.struct(lo.alias("x"), F.lit(0).alias("d")), F.struct((hi + 1).alias("x"), F.lit(0).alias("d")))
    events = narrow.select(*PAGE, "m", lo.alias("lo"), hi.alias("hi"), F.explode(ends).alias("e")).groupBy(*PAGE, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"), F.max("m").alias("m"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    by_x = Window.partitionBy(*PAGE).orderBy("x")
    parts = events.withColumn("c", F.sum("d").over(by_x)).withColumn("end", F.lead("x").over(by_x) - 1).where("x >= lo and end <= hi")
    free = (F.col("c") <= F.greatest(F.lit(1), F.floor(F.col("m") * 0.08))).cast("int")
    runs = parts.withColumn("free", free).withColumn("r", F.sum(F.when(F.col("free") == 0, 1).otherwise(0)).over(by_x.rowsBetween(Window.unboundedPreceding, 0))).where("free = 1")
    gaps = runs.groupBy(*PAGE, "r").agg(F.min("x").alias("g0"), F.max("end").alias("g1"), F.max("m").alias("m")).where("g1 - g0 >= 7")
    best = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc(F.col("g1") - F.col("g0")), "g0"))
    gap = gaps.withColumn("k", best).where("k = 1").select(*PAGE, ((F.col("g0") + F.col("g1")) / 2).alias("gutter"))
    sides = narrow.join(gap, PAGE).groupBy(*PAGE, "gutter").agg(F.count_if(F.col("x1") <= F.col("gutter") + 1).alias("l"), F.count_if(F.col("x0") >= F.col("gutter") - 1).alias("r"), F.max("m").alias("m"))
    return sides.where("l >= 3 and r >= 3 and l + r >= 0.85 * m").select(*PAGE, F.round("gutter", 2).alias("gutter"))


def column_of(x0: Column, x1: Column, gutter: Column) -> Column:
    """F for full width or no gutter, else L or R by the centre."""
    return F.when(gutter.isNull() | ((x0 < gutter - 3) & (x1 > gutter + 3)), "F").when((x0 + x1) / 2 < gutter, "L").otherwise("R")


def with_columns(lines: DataFrame, gutter: DataFrame) -> DataFrame:
    return lines.join(gutter, PAGE, "left").withColumn("col", column_of(F.col("x0"), F.col("x1"), F.col("gutter")))


def column_edges(lines: DataFrame) -> DataFrame:
    """Right edge of each column of a page."""
    return lines.groupBy(*PAGE, "col").agg(F.max("x1").alias("right_edge"))


def rows_of(items: list[tuple], share: float) -> list[list[tuple]]:
    """Items (y0, y1, x0, key, ...) in rows: an item belongs to the open row if its centre is near that of the row's
    first item."""
    rows: list[list[tuple]] = []
    for it in sorted(items, key=lambda r: (r[0], r[2])):
        if rows:
            y0, y1 = rows[-1][0][:2]
            if abs((it[0] + it[1]) / 2 - (y0 + y1) / 2) <= share * max(y1 - y0, 1):
                rows[-1].append(it)
                continue
        rows.append([it])
    return rows


def zones_of_page(items: list[tuple], height: float) -> dict:
    """Zone of each line (y0, y1, x0, key, size, n_chars): walks in from either end while rows stand apart or at the edge."""
    sizes: Counter = Counter()
    for it in items:
        sizes[round(it[4] or 0, 1)] += it[5]
    body = min((-n, s) for s, n in sizes.items())[1] if sizes else 10.0
    rows = [(min(i[0] for i in r), max(i[1] for i in r), max(i[4] or 0 for i in r), [i[3] for i in r]) for r in rows_of(items, 0.4)]
    out: dict = {}
    for k, (y0, y1, size, keys) in enumerate(rows):
        gap = rows[k + 1][0] - y1 if k + 1 < len(rows) else 99
        if size > 1.15 * body or not (y1 < 0.065 * height or (y1 < 0.12 * height and gap >= 0.6 * max(y1 - y0, 1))):
            break
        out.update(dict.fromkeys(keys, "top"))
    for k in range(len(rows) - 1, -1, -1):
        y0, y1, size, keys = rows[k]
        gap = y0 - rows[k - 1][1] if k else 99
        if size > 1.15 * body or not (y0 > 0.935 * height or (y0 > 0.88 * height and gap >= 0.6 * max(y1 - y0, 1))):
            break
        out.update(dict.fromkeys(keys, "bottom"))
    return out


def assign_zones(lines: DataFrame, height: float = 842.0) -> DataFrame:
    """book_id, page, line_id, new_zone. A fold over the rows of one page, hence a grouped function; pages are small."""

    def fold(rows: list[tuple]) -> list[tuple]:
        items = [(y0, y1, x0, i, size, len((raw or "").strip())) for _, _, i, y0, y1, x0, size, raw in rows if y0 is not None and y1 is not None]
        zone = zones_of_page(items, height)
        return [(book, page, i, zone.get(i)) for book, page, i, *_ in rows]

    cols = ["book_id", "page", "line_id", "y0", "y1", "x0", "size", "raw"]
    return fold_groups(lines.select(*cols), PAGE, ["line_id"], fold, "book_id string, page int, line_id bigint, new_zone string")


def page_order(items: list[tuple], gutter: float | None) -> list:
    """Reading order of keys of (y0, y1, x0, key, x1, zone): head, body, foot; full-width items part regions, in a
    region the left column precedes the right."""

    def flat(part: list[tuple]) -> list:
        return [i[3] for row in rows_of(part, 0.35) for i in sorted(row, key=lambda r: r[2])]

    body = [i for i in items if i[5] not in ("top", "bottom")]
    out = flat([i for i in items if i[5] == "top"])
    if gutter is None:
        out += flat(body)
    else:
        left: list[tuple] = []
        right: list[tuple] = []
        for it in sorted(body, key=lambda r: (r[0], r[2])):
            x0, x1 = it[2], it[4]
            if x0 < gutter - 3 and x1 > gutter + 3:
                out += [*flat(left), *flat(right), it[3]]
                left, right = [], []
            else:
                (left if (x0 + x1) / 2 < gutter else right).append(it)
        out += [*flat(left), *flat(right)]
    return out + flat([i for i in items if i[5] == "bottom"])


def reading_order(lines: DataFrame, gutter: DataFrame) -> DataFrame:
    """book_id, page, line_id, order_no (from 0)."""

    def fold(rows: list[tuple]) -> list[tuple]:
        book, page, gap = rows[0][0], rows[0][1], rows[0][8]
        items = [(y0, y1, x0, i, x1, zone) for _, _, i, y0, y1, x0, x1, zone, _ in rows if y0 is not None and y1 is not None]
        order = page_order(items, gap)
        order += [r[2] for r in rows if r[3] is None or r[4] is None]  # lines without a place come last
        return [(book, page, i, k) for k, i in enumerate(order)]

    cols = ["book_id", "page", "line_id", "y0", "y1", "x0", "x1", "zone", "gutter"]
    placed = lines.join(gutter, PAGE, "left").select(*cols)
    return fold_groups(placed, PAGE, ["line_id"], fold, "book_id string, page int, line_id bigint, order_no int")


PLACED = (
    "book_id string, chapter_key string, page int, line_id bigint, raw string, size double, bold boolean, italic boolean, box int, conf double, x0 double, y0 double, x1 double, y1 double, zone string, gutter double, order_no int"
)


def placed(lines: DataFrame) -> DataFrame:
    """Lines with order_no and col: gutter, order and column of a page in one pass over its lines, which are brought together
    once and go through with all that later steps need."""

    def fold(rows: list[tuple]) -> list[tuple]:
        items = [(r[11], r[13], r[10], r[3], r[12], r[14]) for r in rows if r[11] is not None and r[13] is not None]
        at = {i: k for k, i in enumerate(page_order(items, rows[0][15]))}
        # Lines without a place come last.
        at |= {i: len(at) + k for k, i in enumerate(r[3] for r in rows if r[11] is None or r[13] is None)}
        return [(*r, at[r[3]]) for r in rows]

    cols = [f.split()[0] for f in PLACED.split(", ")[:-1]]
    out = fold_groups(lines.join(gutters(lines), PAGE, "left").select(*cols), PAGE, ["line_id"], fold, PLACED)
    return out.withColumn("col", column_of(F.col("x0"), F.col("x1"), F.col("gutter")))


def cluster_edges(df: DataFrame, keys: list[str], value: str, tolerance: float = 2.0) -> DataFrame:
    """keys, cluster, edge (mean), n: neighbouring values at most ``tolerance`` apart are one edge."""
    w = Window.partitionBy(*keys).orderBy(value)
    fresh = F.when(F.col(value) - F.lag(value).over(w) > tolerance, 1).otherwise(0)
    df = df.where(F.col(value).isNotNull()).withColumn("_f", fresh).withColumn("cluster", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "cluster").agg(F.round(F.avg(value), 3).alias("edge"), F.count("*").alias("n"))


def overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.x0") <= F.col(f"{b}.x1")) & (F.col(f"{a}.x1") >= F.col(f"{b}.x0")) & (F.col(f"{a}.y0") <= F.col(f"{b}.y1")) & (F.col(f"{a}.y1") >= F.col(f"{b}.y0"))


def centre_in(a: str, b: str) -> Column:
    x, y = (F.col(f"{a}.x0") + F.col(f"{a}.x1")) / 2, (F.col(f"{a}.y0") + F.col(f"{a}.y1")) / 2
    return x.between(F.col(f"{b}.x0"), F.col(f"{b}.x1")) & y.between(F.col(f"{b}.y0"), F.col(f"{b}.y1"))


def boxes_of(lines: DataFrame) -> DataFrame:
    """Frames of callout boxes: hull of the lines of a box with two lines or more."""
    hull = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_lines")]
    return lines.where("box is not null").groupBy(*PAGE, "box").agg(*hull).where("n_lines >= 2")


def lines_in_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """line_id, box_found: first box that holds the centre of the line. The page is an equality key of the join."""
    a, b = lines.alias("a"), boxes.alias("b")
    cond = (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.page") == F.col("b.page")) & centre_in("a", "b")
    return a.join(b, cond).groupBy(F.col("a.line_id").alias("line_id")).agg(F.min("b.box").alias("box_found"))


def lines_outside(lines: DataFrame, rects: DataFrame) -> DataFrame:
    """Lines that overlap none of the rectangles of their page."""
    a, b = lines.alias("a"), rects.alias("b")
    return a.join(b, (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.page") == F.col("b.page")) & overlaps("a", "b"), "left_anti")


def table_quality(cells: DataFrame) -> DataFrame:
    """table_id, n_rows, n_cols, n_header, header_inferred, n_holes, is_complex, confidence of cells (r, c, rs, cs, raw,
    bold_chars, chars). Cells cover grid positions; positions that no cell covers are holes."""
    cover = cells.select("table_id", F.explode(F.sequence("r", F.col("r") + F.col("rs") - 1)).alias("r"), "c", "cs").select("table_id", "r", F.explode(F.sequence("c", F.col("c") + F.col("cs") - 1)).alias("c"))
    size = cover.groupBy("table_id").agg((F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"), F.count_distinct("r", "c").alias("covered"))
    rows = cells.groupBy("table_id", "r").agg((F.sum("bold_chars") >= F.sum("chars") * 0.7).alias("bold"), F.sum("chars").alias("n"))
    w = Window.partitionBy("table_id").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    head = rows.withColumn("all_bold", F.min((F.col("bold") & (F.col("n") > 0)).cast("int")).over(w)).where("r < 3").groupBy("table_id").agg(F.sum("all_bold").alias("h"))
    empty = cells.groupBy("table_id").agg(F.avg((F.trim(F.coalesce("raw", F.lit(""))) == "").cast("double")).alias("empty"), F.max(F.greatest("rs", "cs")).alias("span"))
    df = size.join(head, "table_id").join(empty, "table_id").withColumn("n_holes", F.col("n_rows") * F.col("n_cols") - F.col("covered"))
    n_header = F.greatest(F.col("h"), F.lit(1)).cast("bigint")
    conf = F.round(0.92 - F.when(F.col("empty") > 0.5, 0.25).otherwise(0.0) - F.when(F.col("n_holes") > 0, 0.1).otherwise(0.0), 2)
    return df.select(
        "table_id", F.col("n_rows").cast("bigint").alias("n_rows"), F.col("n_cols").cast("bigint").alias("n_cols"), n_header.alias("n_header"), (F.col("h") == 0).alias("header_inferred"),
        F.col("n_holes").cast("bigint").alias("n_holes"), ((F.col("span") > 1) | (F.col("n_holes") > 0) | (n_header > 1)).alias("is_complex"), conf.alias("confidence"),
    )


def page_sample(df: DataFrame, keys: list[str], page: str, most: int = 60) -> DataFrame:
    """keys, page of at most ``most`` evenly spaced pages, the first and the last among them. A sampling operator."""
    pages = df.select(*keys, page).where(F.col(page).isNotNull()).distinct()
    w = Window.partitionBy(*keys)
    df = pages.withColumn("i", F.row_number().over(w.orderBy(page)) - 1).withColumn("n", F.count("*").over(w))
    m = F.least(F.col("n"), F.lit(most))
    # i is sampled if some j in 0..m-1 has floor(j * (n - 1) / (m - 1)) = i
    j = F.ceil(F.col("i") * (m - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    hit = (F.floor(j * (F.col("n") - 1) / F.greatest(m - 1, F.lit(1))) == F.col("i")) | (F.col("n") <= most)
    return df.where(hit).select(*keys, page)
