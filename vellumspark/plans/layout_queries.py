"""Groups B and H: lines on pages, running lines, sizes, columns, headings, captions, footnotes, chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark import pipeline
from vellumspark.functions import text
from vellumspark.operators import blocks as B
from vellumspark.operators import chapters as C
from vellumspark.operators import hyphen
from vellumspark.operators import layout as L
from vellumspark.operators import qa
from vellumspark.plans.common import BLOCKS, CHAPTERS, COMPAT, LINES, PARAS, blocks, chapters, lines, paras
from vellumspark.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


PATTERN_SQL = r"""z AS (SELECT *, trim(regexp_replace(regexp_replace(lower(regexp_replace(translate(replace(replace(replace(raw, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'),
  chr(160) || chr(8194) || chr(8195) || chr(8201) || chr(8239) || chr(8232) || chr(8233) || chr(9) || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279), '        '), '[\x00-\x09\x0b-\x1f\x7f]', '', 'g')), '[0-9]', '#', 'g'), '\s+', ' ', 'g')) AS pattern
  FROM l WHERE zone IN ('top', 'bottom') AND raw IS NOT NULL)"""
BOOK_PATTERNS = """bp AS (SELECT z.book_id, pattern, count(DISTINCT page) AS n_pages FROM z JOIN (SELECT book_id, count(DISTINCT page) AS k FROM l GROUP BY 1) t ON z.book_id = t.book_id
  WHERE pattern <> '' GROUP BY z.book_id, pattern, k HAVING count(DISTINCT page) >= greatest(3, 0.25 * k))"""
CHAPTER_PATTERNS = """cp AS (SELECT z.book_id, z.chapter_key, pattern, count(DISTINCT page) AS n_pages FROM z JOIN (SELECT book_id, chapter_key, count(DISTINCT page) AS k FROM l GROUP BY 1, 2) t
  ON z.book_id = t.book_id AND z.chapter_key = t.chapter_key WHERE pattern <> '' AND k >= 2 GROUP BY z.book_id, z.chapter_key, pattern, k HAVING count(DISTINCT page) >= greatest(2, floor(0.6 * k + 0.5)))"""


@query(f"WITH {LINES}, {PATTERN_SQL}, {BOOK_PATTERNS} SELECT * FROM bp")
def a2_book_patterns(spark, d):
    return L.book_patterns(lines(spark, d))


@query(f"WITH {LINES}, {PATTERN_SQL}, {CHAPTER_PATTERNS} SELECT * FROM cp")
def a2_chapter_patterns(spark, d):
    return L.chapter_patterns(lines(spark, d))


@query(rf"""WITH {LINES}, {PATTERN_SQL}, {BOOK_PATTERNS}, {CHAPTER_PATTERNS}
SELECT line_id FROM z WHERE EXISTS (SELECT 1 FROM bp WHERE bp.book_id = z.book_id AND bp.pattern = z.pattern)
  OR EXISTS (SELECT 1 FROM cp WHERE cp.book_id = z.book_id AND cp.chapter_key = z.chapter_key AND cp.pattern = z.pattern) OR regexp_matches(pattern, '^(?:page\s*)?#+$') OR regexp_matches(pattern, '^[ivxlc]+$')""")
def a3_running_removed(spark, d):
    return L.without_running(lines(spark, d)).where("removed").select("line_id")


@query(f"""WITH {LINES}, n AS (SELECT book_id, round(size, 1) AS body, sum(length(trim(raw))) AS n FROM l WHERE size IS NOT NULL AND raw IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, body) AS k FROM n) SELECT book_id, body FROM k WHERE k = 1""")
def b2_body_size(spark, d):
    return L.body_size(lines(spark, d), ["book_id"])


@query(f"""WITH {LINES}, g AS (SELECT book_id, chapter_key, size, y0 - lag(y1) OVER w AS gap, abs(size - lag(size) OVER w) AS d FROM l WINDOW w AS (PARTITION BY book_id, page ORDER BY seq NULLS FIRST, line_id))
SELECT book_id, chapter_key, round(median(gap), 4) AS gap FROM g WHERE d < 0.3 AND gap > -2 AND gap < size * 1.5 GROUP BY 1, 2""")
def b2_line_gap(spark, d):
    return L.line_gap(lines(spark, d), ["book_id", "chapter_key"])


CHARS = COMPAT + ", " + ", ".join(
    rf"""{name} AS (SELECT book_id, chapter_key, ch, count(*) AS {n} FROM (SELECT book_id, chapter_key, unnest(string_split(regexp_replace(lower(coalesce(to_ch, c.ch)), '[^\p{{L}}\p{{N}}]', '', 'g'), '')) AS ch
  FROM (SELECT book_id, chapter_key, unnest(string_split(nfc_normalize({column}), '')) AS ch FROM b WHERE {column} IS NOT NULL) c LEFT JOIN kc ON kc.ch = c.ch) WHERE ch <> '' GROUP BY ALL)"""
    for name, n, column in (("ra", "n", "raw"), ("cl", "m", "clean"))
)


@query(f"""WITH {BLOCKS}, {CHARS} SELECT ra.book_id, ra.chapter_key, CAST(sum(n) AS BIGINT) AS n_source, CAST(sum(greatest(n - coalesce(m, 0), 0)) AS BIGINT) AS n_lost, round(sum(greatest(n - coalesce(m, 0), 0)) / sum(n), 5) AS loss_ratio
FROM ra LEFT JOIN cl ON ra.book_id = cl.book_id AND ra.chapter_key = cl.chapter_key AND ra.ch = cl.ch GROUP BY 1, 2""")
def b3_char_loss(spark, d):
    return qa.char_loss(blocks(spark, d), ["book_id", "chapter_key"], "raw", "clean")


@query(f"""WITH {LINES}, n AS (SELECT book_id, chapter_key, page, sum(length(trim(coalesce(raw, '')))) AS chars FROM l GROUP BY ALL),
w AS (SELECT *, median(chars) OVER p AS md, count(*) OVER p AS k, min(page) OVER p AS a, max(page) OVER p AS z FROM n WINDOW p AS (PARTITION BY book_id, chapter_key))
SELECT book_id, chapter_key, page FROM w WHERE k >= 4 AND chars > 0 AND chars < 0.2 * md AND page > a AND page < z""")
def b4_short_pages(spark, d):
    return qa.short_pages(lines(spark, d)).select("book_id", "chapter_key", "page")


@query(f"""WITH {LINES}, f AS (SELECT book_id, page, x0, CASE WHEN x0 - lag(x0) OVER w > 2 THEN 1 ELSE 0 END AS f FROM l WHERE x0 IS NOT NULL WINDOW w AS (PARTITION BY book_id, page ORDER BY x0)),
k AS (SELECT *, CAST(sum(f) OVER (PARTITION BY book_id, page ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM f) SELECT book_id, page, cluster, round(avg(x0), 3) AS edge, count(*) AS n FROM k GROUP BY 1, 2, 3""")
def b5_edge_clusters(spark, d):
    return L.cluster_edges(lines(spark, d), ["book_id", "page"], "x0")


@query(f"""WITH {LINES}, body AS (SELECT *, count(*) OVER p AS n, min(x0) OVER p AS a, max(x1) OVER p AS b FROM l WHERE zone IS NULL OR zone = 'body' WINDOW p AS (PARTITION BY book_id, page)),
nar AS (SELECT *, count(*) OVER (PARTITION BY book_id, page) AS m FROM body WHERE n >= 8 AND b - a >= 612 * 0.4 AND x1 - x0 < (b - a) * 0.62 AND length(trim(raw)) > 2),
pg AS (SELECT book_id, page, max(m) AS m, max(CAST(floor(a + (b - a) * 0.3) AS INT)) AS lo, max(CAST(floor(a + (b - a) * 0.7) AS INT)) AS hi FROM nar WHERE m >= 8 GROUP BY 1, 2),
xs AS (SELECT book_id, page, m, unnest(range(lo, hi + 1)) AS x FROM pg),
c AS (SELECT xs.book_id, xs.page, xs.m, xs.x, count(nar.line_id) AS c FROM xs LEFT JOIN nar ON nar.book_id = xs.book_id AND nar.page = xs.page AND nar.m >= 8 AND nar.x0 + 0.5 < xs.x AND xs.x < nar.x1 - 0.5 GROUP BY ALL),
r AS (SELECT book_id, page, m, x, x - row_number() OVER (PARTITION BY book_id, page ORDER BY x) AS r FROM c WHERE c <= greatest(1, floor(m * 0.08))),
g AS (SELECT book_id, page, max(m) AS m, min(x) AS g0, max(x) AS g1 FROM r GROUP BY book_id, page, r HAVING max(x) - min(x) >= 7),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id, page ORDER BY g1 - g0 DESC, g0) AS k FROM g), best AS (SELECT book_id, page, m, (g0 + g1) / 2 AS gutter FROM k WHERE k = 1)
SELECT best.book_id, best.page, round(gutter, 2) AS gutter FROM best JOIN nar ON nar.book_id = best.book_id AND nar.page = best.page GROUP BY best.book_id, best.page, best.m, gutter
HAVING count(*) FILTER (nar.x1 <= gutter + 1) >= 3 AND count(*) FILTER (nar.x0 >= gutter - 1) >= 3 AND count(*) FILTER (nar.x1 <= gutter + 1) + count(*) FILTER (nar.x0 >= gutter - 1) >= 0.85 * best.m""")
def b6_gutters(spark, d):
    return L.gutters(lines(spark, d))


@query()
def b7_zones(spark, d):
    return L.assign_zones(lines(spark, d))


@query()
def b8_reading_order(spark, d):
    ls = lines(spark, d)
    return L.reading_order(ls, L.gutters(ls))


@query(f"""WITH {LINES} SELECT book_id, page, 'F' AS col, max(x1) AS right_edge FROM l GROUP BY 1, 2""")
def b9_column_edges(spark, d):
    one = lines(spark, d).withColumn("col", L.column_of(F.col("x0"), F.col("x1"), F.lit(None).cast("double")))
    return L.column_edges(one)


# A page of two columns: a head, a title over both, six rows, a figure legend over both, four rows, a page number.
_ROWS = [(0, 60.0, 540.0, 30.0, 40.0, "Running head of the page"), (1, 60.0, 540.0, 104.0, 116.0, "A title over both columns of the page")]
_ROWS += [(10 + 2 * k + side, 60.0 + 250 * side, 290.0 + 250 * side, 126.0 + 14 * k, 136.0 + 14 * k, f"row {k} of column {side}") for k in range(6) for side in (1, 0)]
_ROWS += [(40, 60.0, 540.0, 216.0, 226.0, "A legend that stands over both columns")]
_ROWS += [(50 + 2 * k + side, 60.0 + 250 * side, 290.0 + 250 * side, 240.0 + 14 * k, 250.0 + 14 * k, f"row {6 + k} of column {side}") for k in range(4) for side in (1, 0)]
_ROWS += [(90, 280.0, 320.0, 815.0, 825.0, "17")]
_ORDER = [0, 1, *range(10, 22, 2), *range(11, 22, 2), 40, *range(50, 58, 2), *range(51, 58, 2), 90]
_IN_TWO = [i for i in _ORDER if i not in (0, 1, 40, 90)]


def two_columns(spark):
    rows = [("b", "c", 1, i, i, x0, y0, x1, y1, 10.0, raw, None) for i, x0, x1, y0, y1, raw in _ROWS]
    return spark.createDataFrame(rows, "book_id string, chapter_key string, page int, line_id bigint, seq int, x0 double, y0 double, x1 double, y1 double, size double, raw string, zone string")


@query("SELECT 'b' AS book_id, 1 AS page, 300.0::DOUBLE AS gutter")
def b13_gutter(spark, d):
    """The gutter of a hand-written page; the tables hold pages of one column only."""
    return L.gutters(two_columns(spark))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {k}, '{'F' if i not in _IN_TWO else 'LR'[i % 2]}')" for k, i in enumerate(_ORDER)) + ") t(line_id, order_no, col)")
def b13_reading_order(spark, d):
    """Order and column of the lines of that page: the left column before the right one, lines over both part them."""
    ls = two_columns(spark)
    zoned = ls.drop("zone").join(L.assign_zones(ls).withColumnRenamed("new_zone", "zone"), ["book_id", "page", "line_id"])
    g = L.gutters(zoned)
    return L.with_columns(zoned.join(L.reading_order(zoned, g), ["book_id", "page", "line_id"]), g).select("line_id", "order_no", "col")


@query("SELECT * FROM (VALUES (0::BIGINT, 'top'), (90, 'bottom')) t(line_id, new_zone)")
def b13_zones(spark, d):
    return L.assign_zones(two_columns(spark)).where("new_zone is not null").select("line_id", "new_zone")


@query("SELECT * FROM (VALUES ('F', 540.0::DOUBLE), ('L', 290.0), ('R', 540.0)) t(col, right_edge)")
def b13_column_edges(spark, d):
    ls = two_columns(spark)
    return L.column_edges(L.with_columns(ls, L.gutters(ls))).select("col", "right_edge")


@query("SELECT 4.0::DOUBLE AS gap")
def b13_line_gap(spark, d):
    """Gaps are those between lines of one column; in reading order, or else by position, lines side by side have none."""
    ls = two_columns(spark)
    return L.line_gap(L.with_columns(ls, L.gutters(ls)).withColumn("seq", F.col("x0").cast("int") * 1000 + F.col("y0").cast("int")), ["chapter_key"]).select("gap")


@query("SELECT 3 AS page")
def b14_short_page(spark, d):
    """A page with hardly any text between full ones, and a page that is missing (b14_gap), on hand-written chapters."""
    rows = [("b", "c", p, "x" * (5 if p == 3 else 400)) for p in range(1, 8) if p != 5]
    return qa.short_pages(spark.createDataFrame(rows, "book_id string, chapter_key string, page int, raw string")).select("page")


@query("SELECT * FROM (VALUES (5), (8)) t(page)")
def b14_gap(spark, d):
    rows = [("b", "c", p) for p in range(1, 8) if p != 5]
    return qa.pages_skipped(spark.createDataFrame([("b", "c", 1, 8)], "book_id string, chapter_key string, page_from int, page_to int"), spark.createDataFrame(rows, "book_id string, chapter_key string, page int")).select("page")


@query(f"""WITH {LINES}, bx AS (SELECT book_id, page, box, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM l WHERE box IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT l.line_id, min(bx.box) AS box_found FROM l JOIN bx ON l.book_id = bx.book_id AND l.page = bx.page AND (l.x0 + l.x1) / 2 BETWEEN bx.x0 AND bx.x1 AND (l.y0 + l.y1) / 2 BETWEEN bx.y0 AND bx.y1 GROUP BY 1""")
def b10_lines_in_boxes(spark, d):
    ls = lines(spark, d)
    return L.lines_in_boxes(ls, L.boxes_of(ls))


@query(f"""WITH {LINES}, bx AS (SELECT book_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM l WHERE zone = 'top' GROUP BY 1, 2)
SELECT l.line_id FROM l WHERE NOT EXISTS (SELECT 1 FROM bx WHERE l.book_id = bx.book_id AND l.page = bx.page AND l.x0 <= bx.x1 AND l.x1 >= bx.x0 AND l.y0 <= bx.y1 AND l.y1 >= bx.y0)""")
def b11_lines_outside_heads(spark, d):
    ls = lines(spark, d)
    hull = ls.where("zone = 'top'").groupBy("book_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return L.lines_outside(ls, hull).select("line_id")


@query(f"""WITH {LINES}, pg AS (SELECT DISTINCT book_id, page FROM l WHERE page IS NOT NULL), i AS (SELECT book_id, page, row_number() OVER (PARTITION BY book_id ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY book_id) AS n FROM pg),
j AS (SELECT DISTINCT book_id, CAST(floor(u * (n - 1) / 19.0) AS BIGINT) AS i FROM (SELECT DISTINCT book_id, n FROM i WHERE n > 20), range(20) r(u))
SELECT i.book_id, page FROM i LEFT JOIN j ON i.book_id = j.book_id AND i.i = j.i WHERE n <= 20 OR j.i IS NOT NULL""")
def b12_page_sample(spark, d):
    return L.page_sample(lines(spark, d), ["book_id"], "page", 20)


CELLS = [("t1", 0, 0, 1, 1, "Dose", 4, 4), ("t1", 0, 1, 1, 1, "Unit", 4, 4), ("t1", 1, 0, 1, 1, "12", 0, 2), ("t1", 1, 1, 1, 1, "mg", 0, 2), ("t2", 0, 0, 2, 1, "A", 1, 1), ("t2", 0, 1, 1, 2, "B", 1, 1), ("t2", 1, 1, 1, 1, "x", 1, 1), ("t2", 2, 0, 1, 1, "y", 0, 1), ("t3", 0, 0, 1, 1, "", 0, 0), ("t3", 0, 1, 1, 1, "", 0, 0), ("t3", 1, 0, 1, 1, "z", 0, 1)]
CELL_SCHEMA = "table_id string, r int, c int, rs int, cs int, raw string, bold_chars int, chars int"


@query("""SELECT table_id, n_rows::BIGINT AS n_rows, n_cols::BIGINT AS n_cols, n_header::BIGINT AS n_header, header_inferred, n_holes::BIGINT AS n_holes, is_complex, confidence::DOUBLE AS confidence FROM (VALUES ('t1', 2, 2, 1, false, 0, false, 0.92), ('t2', 3, 3, 2, false, 3, true, 0.82), ('t3', 2, 2, 1, true, 1, true, 0.57)) t(table_id, n_rows, n_cols, n_header, header_inferred, n_holes, is_complex, confidence)""")
def f7_table_quality(spark, d):
    return L.table_quality(spark.createDataFrame(CELLS, CELL_SCHEMA))


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(rf"""WITH {BLOCKS}, {LINES}, wd AS (SELECT DISTINCT book_id, unnest(list_transform(regexp_extract_all(regexp_replace(rtrim(raw), '\S*[-\x{{2010}}\x{{2011}}\x{{AD}}]$', ''), '[A-Za-z][A-Za-z\-]*[A-Za-z]|[A-Za-z]'), lambda x: lower(x))) AS w FROM l WHERE raw IS NOT NULL),
pc AS (SELECT block_id, book_id, string_split(regexp_replace(raw, '(\S[-\x{{2010}}\x{{2011}}\x{{AD}}])[ \t]*\n[ \t]*(\S)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM b WHERE raw IS NOT NULL),
p AS (SELECT block_id, book_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS x, ps FROM pc),
q AS (SELECT *, x[-1] AS sign, regexp_extract(x, '(?:^|[^A-Za-z\x{{2010}}\x{{2011}}\x{{AD}}-])([A-Za-z]+)[-\x{{2010}}\x{{2011}}\x{{AD}}]$', 1) AS pre, regexp_extract(ps[i + 1], '^[A-Za-z]+') AS suf FROM p),
v AS (SELECT q.*, CASE WHEN i = len(ps) THEN 'END' WHEN sign = chr(173) THEN 'JOIN' WHEN pre = '' OR suf = '' OR regexp_matches(suf, '^[A-Z]') THEN 'KEEP' WHEN length(pre || suf) >= 4 AND a.w IS NOT NULL THEN 'JOIN' WHEN h.w IS NOT NULL THEN 'KEEP'
  WHEN list_contains({_LIST(text.COMPOUND_PREFIXES)}, lower(pre)) OR length(pre) <= 1 THEN 'KEEP' WHEN length(pre) >= 3 AND length(suf) <= 12 AND len(list_filter({_LIST(text.COMMON_SUFFIXES)}, lambda e: ends_with(lower(suf), e))) > 0 THEN 'JOIN' ELSE 'UNCERTAIN' END AS verdict
  FROM q LEFT JOIN wd a ON a.book_id = q.book_id AND a.w = lower(pre || suf) AND NOT contains(a.w, '-') LEFT JOIN wd h ON h.book_id = q.book_id AND h.w = lower(pre || '-' || suf)),
j AS (SELECT block_id, string_agg(CASE WHEN verdict = 'JOIN' THEN x[:-2] ELSE x END, '' ORDER BY i) AS t, CAST(count(*) FILTER (verdict = 'UNCERTAIN') AS INT) AS n_uncertain FROM v GROUP BY 1)
SELECT block_id, trim(regexp_replace(regexp_replace(t, '(\S[\x{{2013}}\x{{2014}}/])[ \t]*\n[ \t]*(\S)', '\1\2', 'g'), '[ \t]*\n[ \t\n]*', ' ', 'g')) AS joined, n_uncertain FROM j""")
def h10_joined_lines(spark, d):
    """Lines of blocks joined with the words of the book's lines as proof."""
    vocab = hyphen.inner_words(lines(spark, d), ["book_id"], "raw")
    out = hyphen.join_lines(blocks(spark, d).where("raw is not null").select("block_id", "book_id", "raw"), ["block_id"], "raw", vocab, ["book_id"])
    return out.select("block_id", "joined", F.size("uncertain").alias("n_uncertain"))


@query()
def h2_paragraph_segments(spark, d):
    return pipeline.segmented(lines(spark, d)).select("book_id", "chapter_key", "line_id", "para_no")


@query()
def h2_paragraphs(spark, d):
    return pipeline.paragraphs(lines(spark, d)).select("book_id", "chapter_key", "para_no", "text", "pages", "size", "bold", "n_lines", "kind", "uncertain")


CONF_SQL = rf"""WITH {PARAS}, {LINES}, body AS (SELECT book_id, body FROM (SELECT book_id, body, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, body) AS k FROM
  (SELECT book_id, round(size, 1) AS body, sum(length(trim(raw))) AS n FROM l WHERE size IS NOT NULL AND raw IS NOT NULL GROUP BY 1, 2)) WHERE k = 1),
x AS (SELECT para_id, text, n_lines, p.size / body AS ratio, coalesce(bold, false) AS bold FROM p JOIN body USING (book_id) WHERE text IS NOT NULL),
y AS (SELECT *, CASE WHEN ratio >= 1.45 THEN 0.95 WHEN ratio >= 1.22 THEN 0.9 WHEN ratio >= 1.1 THEN 0.8 WHEN bold AND ratio >= 0.97 THEN 0.62 WHEN bold THEN 0.4 ELSE 0.0 END AS base FROM x)
SELECT para_id, CASE WHEN n_lines > 3 OR length(text) = 0 OR length(text) > 160 OR base = 0 OR regexp_matches(trim(text), '{text.CALLOUT.replace("'", "''")}') OR regexp_matches(text, '{text.CAPTION}')
  OR regexp_matches(text, '^\s*([•·▪●◦○■▫‣⁃∙])\s*(\S.*)?$') OR regexp_matches(text, '^\s*([–—-])\s+(\S.*)$') OR regexp_matches(text, '^\s*(\(?\d{{1,3}}[.)])\s+([A-Z(\[0-9].*)$') OR regexp_matches(text, '^\s*(\(?[a-h][.)])\s+(\S.*)$') THEN 0.0
  ELSE round(greatest(0.0, least(0.99, base - CASE WHEN text LIKE '%.' AND NOT regexp_matches(text, '\b(vs|etc|Dr|Jr|Inc)\.$') THEN 0.3 ELSE 0 END - CASE WHEN length(text) > 100 THEN 0.2 ELSE 0 END - CASE WHEN n_lines > 2 THEN 0.15 ELSE 0 END
  - CASE WHEN regexp_matches(text, '^\p{{Ll}}') THEN 0.4 ELSE 0 END + CASE WHEN regexp_matches(text, '^\d+(\.\d+)*\s+\S') THEN 0.08 ELSE 0 END)), 2) END AS heading_conf FROM y"""


@query(CONF_SQL)
def h3_heading_conf(spark, d):
    body = L.body_size(lines(spark, d), ["book_id"])
    c = F.col("text")
    conf = B.heading_conf(F.col("size") / F.col("body"), F.coalesce("bold", F.lit(False)), F.lit(False), F.col("n_lines"), c, F.lit(False), text.list_kind(c).isNotNull())
    return paras(spark, d).where("text is not null").join(body, "book_id").where("size is not null and n_lines is not null").select("para_id", conf.alias("heading_conf"))


@query(f"""WITH {PARAS} SELECT para_id, CAST(least(4, 1 + dense_rank() OVER (PARTITION BY book_id ORDER BY round_even(size, 0) DESC, CAST(coalesce(bold, false) AS INT) DESC)) AS INT) AS level FROM p WHERE kind = 'heading' AND size IS NOT NULL""")
def h3_heading_levels(spark, d):
    return B.heading_levels(paras(spark, d).where("kind = 'heading' and size is not null"), ["book_id"]).select("para_id", "level")


@query("""SELECT * FROM (VALUES (1, 1, 2, 8.0), (1, 2, 1, 12.0), (2, 1, 1, 5.0)) t(page, fig_no, cap_no, distance)""")
def h4_caption_match(spark, d):
    figs = spark.createDataFrame([(1, 1, 50.0, 100.0, 250.0, 200.0), (1, 2, 50.0, 300.0, 250.0, 400.0), (2, 1, 60.0, 90.0, 200.0, 180.0)], "page int, fig_no int, x0 double, y0 double, x1 double, y1 double")
    caps = spark.createDataFrame([(1, 1, 50.0, 412.0, 240.0, 424.0), (1, 2, 50.0, 208.0, 240.0, 220.0), (2, 1, 60.0, 185.0, 190.0, 197.0), (2, 2, 400.0, 185.0, 500.0, 197.0)], "page int, cap_no int, x0 double, y0 double, x1 double, y1 double")
    return B.match_captions(figs, caps)


@query("""SELECT * FROM (VALUES (1, 12), (2, NULL), (3, 20)) t(note_id, para_id)""")
def h5_footnote_links(spark, d):
    ps = spark.createDataFrame([(11, 1, 1, "A dose† of two"), (12, 1, 2, "Again† and more"), (13, 1, 4, "after† the note"), (20, 2, 1, "see * here")], "para_id int, page int, seq int, text string")
    ns = spark.createDataFrame([(1, 1, 3, "†"), (2, 1, 3, "‡"), (3, 2, 5, "*")], "note_id int, page int, seq int, mark string")
    return B.link_footnotes(ps, ns)


@query(f"""WITH {LINES}, f AS (SELECT *, CASE WHEN box IS NOT DISTINCT FROM lag(box) OVER w AND page = lag(page) OVER w THEN 0 ELSE 1 END AS f FROM l WINDOW w AS (PARTITION BY book_id, chapter_key ORDER BY seq NULLS FIRST, line_id)),
g AS (SELECT *, CAST(sum(f) OVER (PARTITION BY book_id, chapter_key ORDER BY seq NULLS FIRST, line_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM f)
SELECT book_id, chapter_key, page, box, group_no, count(*) AS n, min(seq) AS first_seq FROM g WHERE box IS NOT NULL GROUP BY 1, 2, 3, 4, 5""")
def h7_callout_groups(spark, d):
    return B.callout_groups(lines(spark, d).withColumnRenamed("line_id", "para_id"), ["book_id", "chapter_key"])


@query(f"""WITH {PARAS}, o AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY book_id, chapter_key ORDER BY seq NULLS FIRST, para_id ROWS UNBOUNDED PRECEDING) AS open FROM p)
SELECT para_id, CASE WHEN kind = 'heading' THEN 'heading' WHEN regexp_matches(text, '{text.CAPTION}') AND n_lines <= 3 THEN 'caption' WHEN coalesce(regexp_matches(open, '{text.REFERENCES}'), false) THEN 'reference'
 WHEN regexp_matches(text, '{text.BULLET}') OR regexp_matches(text, '{text.DASH}') OR regexp_matches(text, '{text.NUMBERED}') OR regexp_matches(text, '{text.ALPHA}') THEN 'list'
 WHEN n_lines = 1 AND length(text) <= 140 AND contains(text, '=') AND regexp_matches(text, '[×÷±≥≤≠≈−√∑∫∞αβγδΔµπσλθ→²³]') THEN 'formula' ELSE 'paragraph' END AS block_type FROM o WHERE text IS NOT NULL""")
def h8_classify(spark, d):
    ps = paras(spark, d)
    return B.classify(ps, F.col("kind") == "heading").where("text is not null").select("para_id", "block_type")


@query(rf"""WITH {BLOCKS} SELECT block_id, len(list_filter(string_split(raw, chr(10)), lambda x: trim(x) <> '' AND (regexp_matches(x, '{text.BULLET}') OR regexp_matches(x, '{text.DASH}') OR regexp_matches(x, '{text.NUMBERED}') OR regexp_matches(x, '{text.ALPHA}')))) AS n_items
FROM b WHERE block_type = 'list' AND raw IS NOT NULL""")
def h9_list_items(spark, d):
    return B.list_blocks(blocks(spark, d)).select("block_id", "n_items")


@query(rf"""WITH {BLOCKS}, x AS (SELECT block_id, list_filter(string_split(raw, chr(10)), lambda x: trim(x) <> '') AS ls FROM b WHERE block_type = 'list' AND raw IS NOT NULL)
SELECT block_id, len(list_filter(ls, lambda x: regexp_matches(x, '{text.BULLET}') OR regexp_matches(x, '{text.DASH}') OR regexp_matches(x, '{text.NUMBERED}') OR regexp_matches(x, '{text.ALPHA}'))) AS n_items,
  array_to_string(list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '{text.NUMBERED}') THEN regexp_extract(x, '(\d+)', 1) || '. ' || regexp_extract(x, '{text.NUMBERED}', 2) WHEN regexp_matches(x, '{text.ALPHA}') THEN '- ' || trim(x)
    WHEN regexp_matches(x, '{text.BULLET}') OR regexp_matches(x, '{text.DASH}') THEN '- ' || regexp_replace(trim(x), '^\S\s*', '') ELSE '  ' || trim(x) END), chr(10)) AS list_md FROM x""")
def h9_list_markdown(spark, d):
    return B.list_blocks(blocks(spark, d))


OUTLINE = [("b1", 1, 1, "Preface", 1, None), ("b1", 2, 1, "Part I Basics", 2, None), ("b1", 3, 2, "Chapter 1 Cells", 2, None), ("b1", 4, 2, "Chapter 2 Tissue", 4, 300.0), ("b1", 5, 1, "Part II More", 8, None), ("b1", 6, 2, "Chapter 3 Organs", 8, None), ("b1", 7, 1, "Index", 11, None)]


@query("""SELECT * FROM (VALUES ('b1', 3, 'Cells', 1, 'Basics', 2, 4, NULL, 0.95), ('b1', 4, 'Tissue', 2, 'Basics', 4, 7, 300.0, 0.95), ('b1', 6, 'Organs', 3, 'More', 8, 10, NULL, 0.95)) t(book_id, seq, title, number, part, start, "end", start_y, confidence)""")
def h6_outline_chapters(spark, d):
    out = spark.createDataFrame(OUTLINE, "book_id string, seq int, level int, title string, page int, y double")
    return C.outline_chapters(out, spark.createDataFrame([("b1", 12)], "book_id string, n_pages int"))


@query(f"""WITH {CHAPTERS}, k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_from NULLS FIRST, chapter_key) AS pos FROM c),
m AS (SELECT *, CASE WHEN chapter_no IS NOT NULL THEN 'ch_' || lpad(CAST(chapter_no AS VARCHAR), 3, '0') ELSE 'ch_x' || lpad(CAST(pos AS VARCHAR), 3, '0') END AS base FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id, base ORDER BY page_from NULLS FIRST, chapter_key) AS n FROM m) SELECT book_id, chapter_key, CASE WHEN n = 1 THEN base ELSE base || chr(CAST(95 + n AS INT)) END AS key FROM n""")
def h6_chapter_keys(spark, d):
    c = chapters(spark, d).select("book_id", "chapter_key", F.col("chapter_no").alias("number"), F.col("page_from").alias("start"), F.col("chapter_key").alias("seq"))
    return C.chapter_keys(c).select("book_id", "chapter_key", "key")


@query(f"""WITH {CHAPTERS}, bk AS (SELECT book_id, max(n_pages) AS n_pages FROM books GROUP BY 1), w AS (SELECT c.*, n_pages, max(page_to) OVER p AS e, last_value(chapter_no IGNORE NULLS) OVER p AS pn,
 count(chapter_no) OVER (PARTITION BY c.book_id, chapter_no) AS dn FROM c LEFT JOIN bk ON c.book_id = bk.book_id WINDOW p AS (PARTITION BY c.book_id ORDER BY page_from NULLS FIRST, chapter_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, coalesce(page_from < 1 OR page_to < page_from OR page_to > n_pages, false) AS i1, coalesce(page_from <= e, false) AS i2, coalesce(chapter_no IS NOT NULL AND dn > 1, false) AS i3, coalesce(chapter_no <> pn + 1 AND chapter_no <> pn, false) AS i4 FROM w)
SELECT book_id, chapter_key, round(least(confidence, CASE WHEN i1 THEN 0.2 ELSE 1 END, CASE WHEN i2 THEN 0.3 ELSE 1 END, CASE WHEN i3 THEN 0.4 ELSE 1 END, CASE WHEN i4 THEN 0.75 ELSE 1 END), 2) AS checked,
 concat_ws(',', CASE WHEN i1 THEN 'INVALID_RANGE' END, CASE WHEN i2 THEN 'OVERLAP' END, CASE WHEN i3 THEN 'DUPLICATE_NUMBER' END, CASE WHEN i4 THEN 'NUMBER_JUMP' END) AS issues FROM f""")
def h6_chapter_checks(spark, d):
    c = chapters(spark, d).select("book_id", "chapter_key", F.col("chapter_no").alias("number"), F.col("page_from").alias("start"), F.col("page_to").alias("end"), F.col("chapter_key").alias("seq"), "confidence", F.lit(None).cast("double").alias("start_y"))
    books = table(spark, d, "books").groupBy("book_id").agg(F.max("n_pages").alias("n_pages"))
    return C.validate(c, books).select("book_id", "chapter_key", "checked", F.array_join("issues", ",").alias("issues"))


@query(rf"""WITH {LINES}, u AS (SELECT book_id, page, arg_max(raw, {{'s': size, 'q': -seq}}) AS raw FROM l WHERE size >= 16 AND y0 < 842 * 0.4 GROUP BY 1, 2)
SELECT book_id, page, CAST(regexp_extract(raw, '(?i)^\s*(?:chapter|ch\.?)\s*(\d{{1,4}})\b', 1) AS INT) AS number, trim(regexp_extract(raw, '(?i)^\s*(?:chapter|ch\.?)\s*(\d{{1,4}})\b[\s.:–—-]*(.*)$', 2)) AS title FROM u WHERE regexp_matches(raw, '(?i)^\s*(?:chapter|ch\.?)\s*\d')""")
def h6_layout_openers(spark, d):
    return C.layout_openers(lines(spark, d))


@query(rf"""WITH {LINES}, m AS (SELECT book_id, page, seq, regexp_extract(raw, '{C.CONTENTS_LINE}', 1) AS a, regexp_extract(raw, '{C.CONTENTS_LINE}', 2) AS t, regexp_extract(raw, '{C.CONTENTS_LINE}', 3) AS p, count(*) OVER (PARTITION BY book_id, page) AS n FROM l WHERE page <= 40 AND regexp_matches(raw, '{C.CONTENTS_LINE}'))
SELECT book_id, page, seq, TRY_CAST(a AS INT) AS number, trim(t) AS title, TRY_CAST(p AS INT) AS printed_page FROM m WHERE n >= 3""")
def h6_contents_entries(spark, d):
    return C.contents_entries(lines(spark, d))
