"""Queries over page-record fixtures (spans, images, drawings, tables) and the conversion of whole books."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark import pipeline
from vellumspark.operators import figures as G
from vellumspark.operators import layout as L
from vellumspark.operators import spans as S
from vellumspark.operators import stream
from vellumspark.operators import tables as T
from vellumspark.plans import fixture_book
from vellumspark.plans.common import BLOCKS, CHAPTERS, LINES, blocks, chapters, lines
from vellumspark.session import table
from vellumspark.sources import readers, sinks
from vellumspark.streaming import resume

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
RECT = "x0 double, y0 double, x1 double, y1 double"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def pages(spark):
    return spark.createDataFrame([("b", 1, 600.0, 800.0), ("b", 2, 600.0, 800.0), ("b", 3, 600.0, 800.0), ("b", 4, 600.0, 800.0)], "book_id string, page int, w double, h double")


@query("""SELECT * FROM (VALUES (1, 'Dose2 is fixed', 10.0::DOUBLE, true, false), (2, 'H2O', 10.0, false, false), (3, 'plain note', 8.0, false, true)) t(line_no, raw, size, bold, italic)""")
def j1_span_lines(spark, d):
    rows = [
        ("b", 1, 1, 1, "Dose", "Serif-Bold", 16, 10.0, 10.0, 10.0, 30.0, 20.0), ("b", 1, 1, 2, "2", "Serif", 0, 6.0, 30.0, 8.0, 33.0, 14.0), ("b", 1, 1, 3, " is fixed", "Serif-Bold", 16, 10.0, 33.0, 10.0, 80.0, 20.0),
        ("b", 1, 2, 1, "H", "Serif", 0, 10.0, 10.0, 30.0, 16.0, 40.0), ("b", 1, 2, 2, "2", "Serif", 0, 6.0, 16.0, 36.0, 19.0, 43.0), ("b", 1, 2, 3, "O", "Serif", 0, 10.0, 19.0, 30.0, 26.0, 40.0),
        ("b", 1, 3, 1, "plain note", "Serif-Oblique", 0, 8.0, 10.0, 50.0, 60.0, 58.0), ("b", 1, 4, 1, "   ", "Serif", 0, 8.0, 10.0, 70.0, 60.0, 78.0),
    ]
    df = spark.createDataFrame(rows, f"book_id string, page int, line_no int, span_no int, text string, font string, flags int, size double, {RECT}")
    return S.lines_of_spans(df).select("line_no", "raw", "size", "bold", "italic")


@query("""SELECT * FROM (VALUES (2, '• First item', 40.0::DOUBLE), (4, 'Other text', 50.0), (5, '3.', 300.0)) t(line_id, raw, x0)""")
def j2_attached_marks(spark, d):
    rows = [(1, "b", 1, "•", 10.0, 40.0, 100.0, 45.0, 110.0), (2, "b", 1, "First item", 10.0, 55.0, 100.0, 200.0, 110.0), (4, "b", 1, "Other text", 10.0, 50.0, 120.0, 200.0, 130.0), (5, "b", 1, "3.", 10.0, 300.0, 120.0, 310.0, 130.0)]
    df = spark.createDataFrame(rows, f"line_id bigint, book_id string, page int, raw string, size double, {RECT}")
    return S.attach_marks(df).select(F.col("line_id").cast("int").alias("line_id"), "raw", "x0")


@query(r"""SELECT * FROM (VALUES (1, '\text{rate} = x^{2} \pm 3 \times \sqrt{a(b)c}'), (2, '5\% \leq C_{m}')) t(id, latex)""")
def j3_latex(spark, d):
    rows = [(1, [("rate = x", 0, None), ("2", 4, None), (" ±3 ×√(a(b)c)", 0, None)]), (2, [("5% ≤C", 0, None), ("m", 8, None)])]
    df = spark.createDataFrame(rows, "id int, spans array<struct<text:string,bits:int,mark:int>>")
    return df.select("id", S.to_latex(F.col("spans")).alias("latex"))


@query("""SELECT * FROM (VALUES ('keep', 1), ('alone', 2)) t(image_id, page)""")
def j4_image_candidates(spark, d):
    rows = [("b", p, "logo", 10.0, 100.0, 90.0, 180.0) for p in (1, 2, 3)] + [
        ("b", 1, "keep", 100.0, 300.0, 300.0, 500.0), ("b", 1, "tiny", 10.0, 300.0, 30.0, 330.0), ("b", 2, "page", 0.0, 0.0, 600.0, 800.0), ("b", 2, "head", 100.0, 5.0, 200.0, 50.0),
        ("b", 2, "alone", 100.0, 300.0, 300.0, 500.0), ("b", 3, "intable", 120.0, 310.0, 200.0, 400.0),
    ]
    images = spark.createDataFrame(rows, f"book_id string, page int, image_id string, {RECT}")
    tables = spark.createDataFrame([("b", 3, 100.0, 300.0, 400.0, 500.0)], f"book_id string, page int, {RECT}")
    return G.image_candidates(images, pages(spark), tables, G.repeated_images(images, pages(spark))).select("image_id", "page")


@query("""SELECT * FROM (VALUES (1, 1, 10.0::DOUBLE, 10.0::DOUBLE, 60.0::DOUBLE, 62.0::DOUBLE, 3), (1, 2, 200.0, 10.0, 220.0, 30.0, 1), (2, 1, 0.0, 0.0, 5.0, 5.0, 1)) t(page, fig_no, x0, y0, x1, y1, n)""")
def j5_merged_figures(spark, d):
    rows = [("b", 1, 10.0, 10.0, 30.0, 30.0), ("b", 1, 33.0, 12.0, 60.0, 40.0), ("b", 1, 40.0, 43.0, 50.0, 62.0), ("b", 1, 200.0, 10.0, 220.0, 30.0), ("b", 2, 0.0, 0.0, 5.0, 5.0)]
    return G.merged(spark.createDataFrame(rows, f"book_id string, page int, {RECT}")).drop("book_id")


@query("""SELECT 1 AS rect_no, 2::BIGINT AS n_lines""")
def j6_callout_boxes(spark, d):
    rects = [("b", 1, 1, 50.0, 100.0, 300.0, 300.0, [0.9, 0.9, 0.8]), ("b", 1, 2, 60.0, 110.0, 200.0, 200.0, [0.5, 0.5, 0.5]), ("b", 1, 3, 50.0, 400.0, 300.0, 600.0, [1.0, 1.0, 1.0]), ("b", 1, 4, 50.0, 610.0, 300.0, 700.0, [0.2, 0.2, 0.2])]
    ls = [("b", 1, 60.0, 120.0, 200.0, 130.0), ("b", 1, 60.0, 140.0, 200.0, 150.0), ("b", 1, 60.0, 620.0, 200.0, 630.0)]
    r = spark.createDataFrame(rects, f"book_id string, page int, rect_no int, {RECT}, fill array<double>")
    return G.callout_boxes(r, pages(spark), spark.createDataFrame(ls, f"book_id string, page int, {RECT}")).select("rect_no", "n_lines")


@query("""SELECT 2 AS page""")
def j7_scanned_pages(spark, d):
    ls = spark.createDataFrame([("b", 1, "a line of native text on the page"), ("b", 2, "12")], "book_id string, page int, raw string")
    im = spark.createDataFrame([("b", 1, "i", 0.0, 0.0, 600.0, 700.0), ("b", 2, "j", 0.0, 0.0, 600.0, 700.0), ("b", 3, "k", 0.0, 0.0, 60.0, 70.0)], f"book_id string, page int, image_id string, {RECT}")
    return G.scanned_pages(ls, im, pages(spark)).select("page")


@query("""SELECT * FROM (VALUES ('t', 11), ('t', 12)) t(table_id, para_id)""")
def j8_table_notes(spark, d):
    t = spark.createDataFrame([("t", "b", 1, 3, 500.0, 10.0)], "table_id string, book_id string, page int, seq int, y1 double, body double")
    p = spark.createDataFrame([(10, "b", 1, 2, 480.0, 8.0), (11, "b", 1, 4, 510.0, 8.0), (12, "b", 1, 5, 522.0, 8.0), (13, "b", 1, 6, 530.0, 10.0), (14, "b", 1, 7, 535.0, 8.0)], "para_id int, book_id string, page int, seq int, y0 double, size double")
    return G.table_notes(t, p)


@query("""SELECT * FROM (VALUES ('a', 'table-2-1', false, NULL, '<a id="table-2-1"></a>' || chr(10) || 'Table 2.1 Doses' || chr(10) || chr(10) || '| x |'), ('b', NULL, true, 'table_ch2_02.md', '[Table 2](tables/table_ch2_02.md)')) t(table_id, anchor, is_big, file, md)""")
def j9_table_blocks(spark, d):
    rows = [("a", "ch2", 1, 3, 2, "Table 2.1 Doses", "| x |", None), ("b", "ch2", 2, 59, 4, None, "| big |", "note")]
    return G.table_blocks(spark.createDataFrame(rows, "table_id string, tag string, table_no int, n_rows int, n_cols int, caption string, body_md string, notes_md string"))


@query("""SELECT 1 AS fig_id, 'Figure 3.2' AS label, 'figure-3-2' AS anchor, '<a id="figure-3-2"></a>' || chr(10) || chr(10) || '![Figure 3.2](f.png)' || chr(10) || chr(10) || 'Fig. 3.2 Cells' || chr(10) || chr(10) || '<details><summary>Labels in the figure</summary>' || chr(10) || chr(10) || 'a; b' || chr(10) || chr(10) || '</details>' AS md""")
def j10_figure_blocks(spark, d):
    return G.figure_blocks(spark.createDataFrame([(1, "f.png", "Fig. 3.2 Cells", ["a", "b"])], "fig_id int, asset string, caption string, labels array<string>"))


@query("""SELECT * FROM (VALUES (1, 12::BIGINT, NULL::BIGINT), (2, NULL, 14)) t(cap_id, after_id, before_id)""")
def j11_orphan_places(spark, d):
    caps = spark.createDataFrame([(1, 1, 300.0), (2, 2, 50.0)], "cap_id int, page int, y0 double")
    return G.place_orphans(caps, spark.createDataFrame([(11, 1, 1, 100.0), (12, 1, 2, 250.0), (13, 1, 3, 400.0), (14, 2, 4, 90.0)], "block_id bigint, page int, seq int, y0 double"))


@query("""SELECT * FROM (VALUES ('TABLE_LOW_CONFIDENCE', 1::BIGINT), ('TABLE_SPARSE', 1), ('TABLE_IRREGULAR', 2), ('TABLE_HEADER_INFERRED', 2), ('TABLE_HTML', 3)) t(code, block_id)""")
def j12_table_issues(spark, d):
    rows = [("b", "c", 1, 1, 0.62, 10, 5, 0, False, False), ("b", "c", 2, 2, 0.82, 10, 1, 2, True, False), ("b", "c", 3, 3, 0.92, 0, 0, 0, False, True)]
    return G.table_issues(spark.createDataFrame(rows, "book_id string, chapter_key string, page int, block_id bigint, conf double, n_cells int, n_empty int, n_holes int, header_inferred boolean, is_html boolean")).select("code", "block_id")


@query("""SELECT * FROM (VALUES ('c1', 'FIGURE_COUNT'), ('c2', 'TABLE_COUNT')) t(chapter_key, code)""")
def j13_count_issues(spark, d):
    a = spark.createDataFrame([("b", "c1", "figure"), ("b", "c1", "figure"), ("b", "c2", "table"), ("b", "c3", "table")], "book_id string, chapter_key string, t string")
    z = spark.createDataFrame([("b", "c1", "figure"), ("b", "c2", "paragraph"), ("b", "c3", "table")], "book_id string, chapter_key string, block_type string")
    return G.count_issues(a, z).select("chapter_key", "code")


@query("""SELECT * FROM (VALUES ('CAPTION_ORPHAN', 'HIGH', 'Figure 2'), ('CAPTION_ORPHAN', 'MEDIUM', 'Table 9'), ('FIGURE_NO_CAPTION', 'MEDIUM', '')) t(code, severity, message)""")
def j14_caption_issues(spark, d):
    figs = spark.createDataFrame([("b", "c", 1, 1), ("b", "c", 1, 2)], "book_id string, chapter_key string, page int, fig_no int")
    caps = spark.createDataFrame([("b", "c", 1, 1, "Figure 1"), ("b", "c", 1, 2, "Figure 2"), ("b", "c", 1, 3, "Table 9")], "book_id string, chapter_key string, page int, cap_no int, text string")
    return G.caption_issues(figs, caps, spark.createDataFrame([("b", 1, 1, 1)], "book_id string, page int, fig_no int, cap_no int")).select("code", "severity", "message")


@query("""SELECT * FROM (VALUES ('a', 0::BIGINT), ('b', 1::BIGINT), ('c', 2::BIGINT)) t(value_id, cluster)""")
def j15_nearest_edges(spark, d):
    xs = spark.createDataFrame([("t", v) for v in (10.0, 11.0, 50.0, 51.5, 100.0)], "table_id string, v double")
    vs = spark.createDataFrame([("t", "a", 9.0), ("t", "b", 52.0), ("t", "c", 97.0)], "table_id string, value_id string, value double")
    return G.nearest_edge(L.cluster_edges(xs, ["table_id"], "v"), vs, ["table_id"]).select("value_id", "cluster")


# ---- whole books -----------------------------------------------------------------------------------------------


@query(f"""WITH {LINES}, f AS (SELECT book_id, seq, line_id, raw FROM (SELECT *, max(size) OVER (PARTITION BY book_id) AS m FROM l WHERE page = 1 AND trim(raw) <> '') WHERE size >= m - 0.5),
h AS (SELECT book_id, string_agg(raw, ' ' ORDER BY seq, line_id) AS found FROM f GROUP BY 1), g AS (SELECT book_id, min(title) AS given FROM books GROUP BY 1)
SELECT g.book_id, coalesce(CASE WHEN trim(given) <> '' THEN given END, found, '') AS title FROM g LEFT JOIN h ON g.book_id = h.book_id""")
def k1_titles(spark, d):
    return pipeline.metadata(table(spark, d, "books"), lines(spark, d)).select("book_id", "title")


@query()
def k2_inspect(spark, d):
    return pipeline.inspect(table(spark, d, "books"), lines(spark, d))


@query()
def k3_converted_blocks(spark, d):
    return pipeline.to_blocks(pipeline.paragraphs(lines(spark, d)))


@query()
def k4_converted_status(spark, d):
    return pipeline.convert(lines(spark, d), chapters(spark, d)).status


def _converted(spark):
    flags = spark.createDataFrame([("b", "c2", 3, ["ocr_failed: no engine"])], "book_id string, chapter_key string, page int, flags array<string>")
    return pipeline.convert(fixture_book.lines(spark), fixture_book.chapters(spark), fixture_book.items(spark), page_flags=flags)


_N = "' || chr(10) || '"


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: str(x) if isinstance(x, int) else "NULL" if x is None else "'" + x.replace("'", "''").replace("\n", _N) + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


# Lines of a table of four columns below its caption, a sentence further down, and a box of two cells below another caption.
_CELLS = [(1, 100.0, 50.0, 200.0, "Table 2.1 Doses")] + [(10 + 10 * r + c, 115.0 + 14 * r, 50.0 + 80 * c, 90.0 + 80 * c, t) for r, row in enumerate([("Drug", "Dose", "Unit", "Route"), ("A", "12", "mg", "oral"), ("B", "7", "mg", "")]) for c, t in enumerate(row) if t]
_CELLS += [(60, 200.0, 50.0, 300.0, "A sentence of the text below the table."), (70, 300.0, 50.0, 200.0, "Table 2.2 Box"), (71, 315.0, 50.0, 100.0, "one"), (72, 329.0, 50.0, 100.0, "two")]


def _cells(spark):
    return spark.createDataFrame([("b", 1, i, x0, y0, x1, y0 + 10, 10.0, t) for i, y0, x0, x1, t in _CELLS], f"book_id string, page int, line_id bigint, {RECT}, size double, raw string")


@query("SELECT 1::BIGINT AS table_id, 3 AS n_rows, 4 AS n_cols, 11::BIGINT AS n_cells, 0.62::DOUBLE AS conf")
def j16_found_tables(spark, d):
    return T.found_tables(_cells(spark)).select("table_id", "n_rows", "n_cols", "n_cells", F.col("conf").cast("double").alias("conf"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {(i - 10) // 10}, {(i - 10) % 10})" for i, *_ in _CELLS if 10 <= i < 60) + ", (71, 0, 0), (72, 1, 0)) t(line_id, r, c)")
def j17_table_grid(spark, d):
    return T.grids(T.table_regions(_cells(spark))).select("line_id", "r", "c")


@query("SELECT 1 AS fig_id, ['Drug', 'A', 'B'] AS labels")
def j18_figure_labels(spark, d):
    return T.figure_labels(spark.createDataFrame([(1, "b", 1, 40.0, 110.0, 100.0, 160.0)], f"fig_id int, book_id string, page int, {RECT}"), _cells(spark))


@query("""SELECT line_id FROM lines WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT book_id, page, x0, y0, x1, y1 FROM lines WHERE zone = 'bottom') r
  WHERE r.book_id = lines.book_id AND r.page = lines.page AND lines.x0 <= r.x1 AND lines.x1 >= r.x0 AND lines.y0 <= r.y1 AND lines.y1 >= r.y0) GROUP BY 1""")
def j19_outside_removed(spark, d):
    ls = lines(spark, d)
    return T.outside_removed(ls, ls.where("zone = 'bottom'")).select("line_id")


@query(f"""WITH {LINES}, s AS (SELECT book_id, page, string_agg(coalesce(raw, ''), chr(10) ORDER BY seq NULLS FIRST, line_id) AS t FROM l GROUP BY 1, 2) SELECT book_id, page, sha256(t) AS sha256 FROM s""")
def k10_page_hashes(spark, d):
    return sinks.page_hashes(lines(spark, d))


@query(f"""WITH {BLOCKS} SELECT book_id, chapter_key, section_id, string_agg(clean, chr(10) || chr(10) ORDER BY seq NULLS FIRST, block_id) AS text FROM b WHERE trim(clean) <> '' GROUP BY 1, 2, 3""")
def k11_section_texts(spark, d):
    return sinks.section_texts(blocks(spark, d))


@query(rf"""WITH {BLOCKS}, g AS (SELECT book_id, chapter_key, seq, regexp_extract(CASE WHEN trim(raw) <> '' THEN raw ELSE clean END, '(?i)^\s*(figure|fig\.?|table|box|algorithm|plate)\s+([0-9IVXA-Z][0-9.A-Za-z-]*)', ['k', 'n']) AS g FROM b WHERE block_type IN ('caption', 'figure', 'table')),
k AS (SELECT book_id, chapter_key, seq, regexp_replace(lower(g.k), '\.$', '') AS kind, g.n AS n FROM g WHERE g.k <> ''),
l AS (SELECT book_id, chapter_key, seq, kind, CASE kind WHEN 'fig' THEN 'Figure' ELSE upper(kind[1]) || kind[2:] END || ' ' || regexp_replace(n, '[.]+$', '') AS label, CASE kind WHEN 'table' THEN 'table-' ELSE 'figure-' END || regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS anchor FROM k)
SELECT book_id, chapter_key, label, arg_min(anchor, seq) AS anchor, arg_min(kind, seq) AS kind FROM l GROUP BY 1, 2, 3""")
def k12_labels(spark, d):
    return sinks.labels_of(blocks(spark, d))


BOOK = [
    ("c1", 1, "heading", "# Cell Walls"),
    ("c1", 2, "paragraph", "The wall of a plant cell is made of cellulose, takes 5 mg and gives a firm shape[^fn1-x] in well-known cases of growth."),
    ("c1", 3, "footnote", "[^fn1-x]: Measured dry."),
    ("c1", 4, "heading", "## Layers"),
    ("c1", 5, "list", "- primary wall\n  - middle layer\n- cellulose"),
    ("c1", 6, "figure", '<a id="figure-1-1"></a>\n\n![Figure 1.1](figure_c1_01.png)\n\nFigure 1.1. A wall\n\n<details><summary>Labels in the figure</summary>\n\nlumen\n\n</details>'),
    ("c1", 7, "formula", "$$\nE = m \\times v\n$$"),
    ("c1", 8, "paragraph", "The the text goes on as Figure 1.2 shows with an odd-bod in it.\n<!-- UNCERTAIN: low OCR confidence, page 1 -->"),
    ("c1", 9, "paragraph", "‡ Nowhere marked."),
    ("c1", 10, "callout", "> **Key points**\n>\n> Walls are firm."),
    ("c1", 11, "table", '<a id="table-1-1"></a>\nTable 1.1: Doses\n\n| Drug | Dose |\n| --- | --- |\n| A | 12 mg |'),
    ("c1", 12, "callout", "> **WARNING**\n>\n> Keep them dry [1,3]."),
    ("c1", 13, "heading", "## References"),
    ("c1", 14, "reference", '<a id="ref-1"></a>1. Author A. On walls and their layers, at <https://walls.test/a>.'),
    ("c1", 15, "reference", '<a id="ref-2"></a>2. Author B. On cells.'),
    ("c2", 1, "heading", "# Another Title"),
    ("c2", 2, "paragraph", "Some text of the second chapter, which ends here."),
    ("c2", 3, "unreadable", "<!-- UNCERTAIN: source text unreadable, page 4 -->\n[Unreadable source text]\n\n![Scanned page 4](figure_c2_01.png)"),
]
BOOK_ISSUES = [
    ("c1", "CALLOUT_INFERRED", 2), ("c1", "CITATION_NOT_IN_LIST", None), ("c1", "FIGURE_MENTION_MISSING", None), ("c1", "FOOTNOTE_UNLINKED", 1), ("c1", "FORMULA_LATEX", 1), ("c1", "HYPHEN_UNCERTAIN", 1),
    ("c1", "MISSING_NUMBER", 2), ("c1", "OCR_LOW_CONFIDENCE", 1), ("c1", "TABLE_HEADER_INFERRED", 2), ("c1", "TABLE_LOW_CONFIDENCE", 2), ("c1", "TABLE_NUMERIC_MISMATCH", 2),
    ("c2", "OCR_FAILED", 3), ("c2", "PAGE_UNREADABLE", 4), ("c2", "TITLE_MISMATCH", 3),
]


@query(_values(BOOK, "chapter_key, seq, block_type, md"))
def k9_book_blocks(spark, d):
    """Every kind of block, out of the lines, figures and tables of the hand-written book."""
    return _converted(spark).blocks.select("chapter_key", "seq", "block_type", "md")


@query(_values(BOOK_ISSUES, "chapter_key, code, page"))
def k9_book_issues(spark, d):
    return _converted(spark).issues.select("chapter_key", "code", "page")


@query(rf"""WITH {BLOCKS} SELECT block_id, CASE WHEN regexp_matches(clean, '^\s*[\[(]?(\d{{1,4}})[\].)]') THEN '<a id="ref-' || regexp_extract(clean, '^\s*[\[(]?(\d{{1,4}})[\].)]', 1) || '"></a>' || clean ELSE clean END AS md FROM b WHERE block_type = 'reference' AND clean IS NOT NULL""")
def k5_reference_anchors(spark, d):
    return blocks(spark, d).where("block_type = 'reference' and clean is not null").select("block_id", stream.reference_md(F.col("clean")).alias("md"))


@query("""SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def k6_event_windows(spark, d):
    return resume.event_counts(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"WITH {CHAPTERS}, s AS (SELECT book_id, chapter_key FROM (SELECT book_id, chapter_key, max({{'a': loaded_at, 'status': status, 'page': page}}) AS s FROM chapter_state GROUP BY 1, 2)) SELECT c.book_id, count(*) AS n_rows FROM c LEFT JOIN s ON s.book_id = c.book_id AND s.chapter_key = c.chapter_key GROUP BY 1")
def k7_manifest_rows(spark, d):
    m = sinks.manifest(chapters(spark, d), table(spark, d, "chapter_state"), spark.createDataFrame([], "book_id string, chapter_key string"))
    return m.select("book_id", F.json_array_length("manifest").cast("bigint").alias("n_rows"))


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE text IS NOT NULL""")
def k8_text_lines(spark, d):
    return readers.text_lines(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_lines"))
