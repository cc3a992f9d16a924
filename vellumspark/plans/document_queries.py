"""Groups C to G and I: search, chunks, checks, sections, rendering, cross-references, navigation, incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark import pipeline
from vellumspark.functions import numeric, text
from vellumspark.model import CHUNK_CHARS, CONTENT_TYPE, DONE_STATES, literal_map
from vellumspark.operators import assemble as A
from vellumspark.operators import chapters as C
from vellumspark.operators import incremental as I

from vellumspark.operators import navigate as N
from vellumspark.operators import qa, rag, search, xref
from vellumspark.plans.common import BLOCKS, CHAPTERS, LINES, blocks, chapters, documents, lines
from vellumspark.plans.text_queries import CITED
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


# ---- C: search -------------------------------------------------------------------------------------------------

TOK = r"regexp_extract_all(strip_accents(lower({c})), '[\p{{L}}\p{{N}}]+')"
_INDEXES: dict = {}


def _blocks_index(spark, d):
    """The index over the text of blocks, made once per session and folder, as queries share it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = search.build(blocks(spark, d), "block_id", ["clean"])
    return _INDEXES[key]

BM25 = """
tf AS (SELECT t, unit_id, sum(n * w) AS tf FROM hits GROUP BY 1, 2), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1), ok AS (SELECT unit_id FROM tf GROUP BY 1 HAVING count(*) = (SELECT max(t) + 1 FROM hits)),
s AS (SELECT count(*) AS n, avg(k) AS a FROM len)
SELECT tf.unit_id, round(sum(greatest(ln((s.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * k / s.a))), 6) AS score
FROM tf JOIN df USING (t) JOIN len USING (unit_id) JOIN ok USING (unit_id) JOIN s ON true {where} GROUP BY 1 ORDER BY score DESC, unit_id LIMIT {limit}"""
ONE = "len AS (SELECT block_id AS unit_id, coalesce(len(" + TOK.format(c="clean") + "), 0) AS k FROM b)"


def word_hits(t: int, condition: str, c: str = "clean", w: float = 1.0, table: str = "b", key: str = "block_id") -> str:
    return f"SELECT {t} AS t, {key} AS unit_id, {w} AS w, len(list_filter({TOK.format(c=c)}, lambda x: {condition})) AS n FROM {table} WHERE {c} IS NOT NULL AND len(list_filter({TOK.format(c=c)}, lambda x: {condition})) > 0"


@query(f"WITH {BLOCKS}, {ONE}, hits AS ({word_hits(0, '''x = 'method' ''')} UNION ALL {word_hits(1, '''starts_with(x, 'exampl') ''')}), {BM25.format(where='', limit=50)}")
def c1_bm25_and(spark, d):
    return search.find(_blocks_index(spark, d), "method exampl")


@query(f"""WITH {BLOCKS}, {ONE}, tk AS (SELECT block_id, {TOK.format(c='clean')} AS ts FROM b WHERE clean IS NOT NULL), ps AS (SELECT block_id, ts, unnest(range(1, len(ts))) AS i FROM tk),
hits AS (SELECT 0 AS t, block_id AS unit_id, 1.0 AS w, count(*) AS n FROM ps WHERE ts[i] = 'in' AND ts[i + 1] = 'most' AND ts[i + 2] = 'cases' GROUP BY 2), {BM25.format(where='', limit=50)}""")
def c2_phrase(spark, d):
    return search.find(_blocks_index(spark, d), '"in most cases"')


@query(f"WITH {BLOCKS} SELECT block_id AS unit_id FROM b WHERE len(list_filter({TOK.format(c='clean')}, lambda x: starts_with(x, 'frequen'))) > 0")
def c3_prefix(spark, d):
    return search.matches(_blocks_index(spark, d), search.Term(("frequen",), True)).select("unit_id")


@query(f"WITH {BLOCKS}, {ONE}, hits AS ({word_hits(0, '''x = 'result' ''')} UNION ALL {word_hits(1, '''starts_with(x, 'common') ''')}), {BM25.format(where='''JOIN b ON b.block_id = tf.unit_id AND block_type = 'paragraph' AND book_id LIKE '%1%' ''', limit=20)}")
def c4_filtered(spark, d):
    return search.find(_blocks_index(spark, d), "result common", limit=20, among=blocks(spark, d).where((F.col("block_type") == "paragraph") & F.col("book_id").like("%1%")).select(F.col("block_id").alias("unit_id")))


@query(rf"""WITH {BLOCKS}, t AS (SELECT block_id, regexp_extract_all(clean, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\x{{0300}}-\x{{036F}}]*') AS ts FROM b WHERE clean IS NOT NULL), p AS (SELECT block_id, ts, list_position(list_transform(ts, lambda x: strip_accents(lower(x))), 'example') AS pos FROM t),
s AS (SELECT *, greatest(1, least(pos - 14, len(ts) - 27)) AS st FROM p WHERE pos > 0)
SELECT block_id, CASE WHEN st > 1 THEN ' … ' ELSE '' END || array_to_string(list_transform(ts[st:st + 27], lambda x: CASE WHEN strip_accents(lower(x)) = 'example' THEN '[[' || x || ']]' ELSE x END), ' ') || CASE WHEN st + 28 <= len(ts) THEN ' … ' ELSE '' END AS snippet FROM s""")
def c5_snippet(spark, d):
    return blocks(spark, d).where("clean is not null").select("block_id", search.snippet(F.col("clean"), "example").alias("snippet")).where("snippet is not null")


@query(f"""WITH len AS (SELECT doc_id AS unit_id, coalesce(len({TOK.format(c='text')}), 0) + coalesce(len({TOK.format(c='title')}), 0) AS k FROM documents),
hits AS ({word_hits(0, '''x = 'protein' ''', 'text', 1.0, 'documents', 'doc_id')} UNION ALL {word_hits(0, '''x = 'protein' ''', 'title', 0.4, 'documents', 'doc_id')} UNION ALL {word_hits(1, '''starts_with(x, 'cell') ''', 'text', 1.0, 'documents', 'doc_id')} UNION ALL {word_hits(1, '''starts_with(x, 'cell') ''', 'title', 0.4, 'documents', 'doc_id')}), {BM25.format(where='', limit=50)}""")
def c6_weighted_columns(spark, d):
    return search.search(documents(spark, d), "doc_id", ["text", "title"], "protein cell", [1.0, 0.4])


@query(f"""WITH {BLOCKS}, {CHAPTERS}, u AS (SELECT b.block_id, clean, array_to_string(list_filter(heading_path, lambda x: x IS NOT NULL), ' ') AS path, t.title FROM b LEFT JOIN (SELECT book_id, chapter_key, min(title) AS title FROM c GROUP BY 1, 2) t ON t.book_id = b.book_id AND t.chapter_key = b.chapter_key),
len AS (SELECT block_id AS unit_id, coalesce(len({TOK.format(c='clean')}), 0) + coalesce(len({TOK.format(c='path')}), 0) + coalesce(len({TOK.format(c='title')}), 0) AS k FROM u),
hits AS ({" UNION ALL ".join(word_hits(t, cond, c, w, 'u') for t, cond in ((0, "x = 'method' "), (1, "starts_with(x, 'exam') ")) for c, w in (('clean', 1.0), ('path', 0.4), ('title', 0.2)))}), {BM25.format(where='', limit=50)}""")
def c9_three_columns(spark, d):
    return pipeline.find_units(pipeline.search_index(blocks(spark, d), chapters(spark, d)), "method exam")


@query("""SELECT * FROM (VALUES (1, 'see the [[heart rate]] of the [[drugs]] in use'), (2, NULL)) t(id, snippet)""")
def c10_phrase_snippet(spark, d):
    df = spark.createDataFrame([(1, "See the Heart-Rate of the drugs in use"), (2, "none of it")], "id int, text string")
    return df.select("id", F.lower(search.snippet(F.col("text"), search.parse_query('"heart rate" drug'))).alias("snippet"))


@query(f"WITH {BLOCKS}, {CHAPTERS} SELECT content_type, count(*) AS n FROM (SELECT CASE block_type WHEN 'heading' THEN 'heading' WHEN 'list' THEN 'list' WHEN 'table' THEN 'table' WHEN 'figure' THEN 'figure' WHEN 'unreadable' THEN 'figure' WHEN 'caption' THEN 'figure' WHEN 'callout' THEN 'callout' WHEN 'reference' THEN 'reference' ELSE 'text' END AS content_type FROM b WHERE trim(clean) <> '') GROUP BY 1")
def c7_index_units(spark, d):
    return blocks(spark, d).where("trim(clean) <> ''").select(literal_map(CONTENT_TYPE)[F.col("block_type")].alias("content_type")).groupBy("content_type").agg(F.count("*").alias("n"))


@query(f"WITH {BLOCKS}, t AS (SELECT block_id, unnest({TOK.format(c='clean')}) AS term FROM b WHERE clean IS NOT NULL) SELECT term, count(*) AS n_postings, count(DISTINCT block_id) AS n_units FROM t GROUP BY 1")
def c8_postings(spark, d):
    return search.postings(blocks(spark, d), "block_id", ["clean"]).groupBy("term").agg(F.count("*").alias("n_postings"), F.count_distinct("unit_id").alias("n_units"))


# ---- D: chunks -------------------------------------------------------------------------------------------------

FOLD = f"""o AS (SELECT *, CASE block_type WHEN 'table' THEN 'table' WHEN 'reference' THEN 'reference' WHEN 'figure' THEN 'figure_caption' WHEN 'unreadable' THEN 'figure_caption' WHEN 'caption' THEN 'figure_caption' WHEN 'callout' THEN 'callout' ELSE 'text' END AS ctype,
  length(md) AS len, row_number() OVER (PARTITION BY book_id, chapter_key, section_id ORDER BY seq NULLS FIRST, block_id) AS i FROM b WHERE md IS NOT NULL AND trim(md) <> ''),
f AS (SELECT book_id, chapter_key, section_id, block_id, i, ctype, 1 AS no, len AS size FROM o WHERE i = 1 UNION ALL
  SELECT o.book_id, o.chapter_key, o.section_id, o.block_id, o.i, o.ctype, CASE WHEN s THEN f.no ELSE f.no + 1 END, CASE WHEN s THEN f.size + o.len ELSE o.len END
  FROM f JOIN o ON o.book_id = f.book_id AND o.chapter_key = f.chapter_key AND o.section_id IS NOT DISTINCT FROM f.section_id AND o.i = f.i + 1,
  LATERAL (SELECT (o.ctype = 'text' AND f.ctype = 'text' AND f.size + o.len <= {CHUNK_CHARS}) OR (o.ctype = 'reference' AND f.ctype = 'reference' AND f.size < {CHUNK_CHARS}) AS s) q)"""


@query(f"WITH RECURSIVE {BLOCKS}, {FOLD} SELECT block_id, CAST(no AS INT) AS chunk_no FROM f")
def d1_chunk_packing(spark, d):
    rows = blocks(spark, d).where("md is not null and trim(md) <> ''").withColumn("ctype", rag.chunk_type(F.col("block_type"))).withColumn("len", F.length("md"))
    return rag.section_runs(rows, ["book_id", "chapter_key", "section_id"]).select("block_id", "chunk_no")


@query(f"WITH RECURSIVE {BLOCKS}, {FOLD} SELECT book_id, content_type, count(*) AS n_chunks, CAST(sum(k) AS BIGINT) AS n_blocks FROM (SELECT book_id, chapter_key, section_id, no, min(ctype) AS content_type, count(*) AS k FROM f GROUP BY ALL) GROUP BY 1, 2")
def d2_chunk_types(spark, d):
    return rag.chunks(blocks(spark, d)).groupBy("book_id", "content_type").agg(F.count("*").alias("n_chunks"), F.sum(F.size("block_ids")).alias("n_blocks"))


@query(f"WITH RECURSIVE {BLOCKS}, {FOLD} SELECT book_id, chapter_key, section_id || '#' || no AS chunk_id, list(block_id ORDER BY i) AS block_ids FROM f WHERE section_id IS NOT NULL GROUP BY book_id, chapter_key, section_id, no")
def d4_chunk_ids(spark, d):
    return rag.chunks(blocks(spark, d)).where("section_id is not null").select("book_id", "chapter_key", "chunk_id", "block_ids")


@query(rf"""WITH RECURSIVE {BLOCKS}, {FOLD}, t AS (SELECT f.book_id, f.chapter_key, f.section_id, f.no, f.ctype, f.i, f.block_id, b.seq, b.pages, b.heading_path, trim(regexp_replace(md, '<!-- source_page: \d+ -->', '', 'g')) AS x FROM f JOIN b USING (block_id))
SELECT book_id, chapter_key, coalesce(section_id, 'start') || '#' || no AS chunk_id, min(ctype) AS content_type, string_agg(x, chr(10) || chr(10) ORDER BY seq NULLS FIRST, block_id) AS text, list_sort(list_distinct(flatten(list(pages)))) AS source_pages,
  list(block_id ORDER BY i) AS block_ids FROM t GROUP BY book_id, chapter_key, section_id, no""")
def d5_chunk_texts(spark, d):
    """Chunks but for path and cited numbers; those of blocks without a section are among them."""
    return rag.chunks(blocks(spark, d)).select("book_id", "chapter_key", "chunk_id", "content_type", "text", "source_pages", "block_ids")


@query()
def d5_chunks(spark, d):
    return rag.chunks(blocks(spark, d))


# ---- E: checks -------------------------------------------------------------------------------------------------


def _numbers(df, column):
    return df.where(F.col(column).isNotNull()).select("book_id", "chapter_key", F.explode(numeric.tokens(F.col(column))).alias("token"))


NUM = r"(^|[^A-Za-z0-9])((?:[<>≤≥±~])?\s?\d+(?:[.,]\d+)*(?:\s?%)?)"
NUM_SQL = rf"""SELECT book_id, chapter_key, token FROM (SELECT book_id, chapter_key, regexp_replace(regexp_replace(unnest(regexp_extract_all(nfc_normalize({{c}}), '{NUM}', 2)), '\s+', '', 'g'), '[.,]+$', '') AS token FROM b WHERE {{c}} IS NOT NULL) WHERE token <> ''"""


@query(f"WITH {BLOCKS}, a AS ({NUM_SQL.format(c='raw')}), z AS ({NUM_SQL.format(c='md')}) SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM z) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM z EXCEPT ALL SELECT * FROM a)")
def e1_number_difference(spark, d):
    b = blocks(spark, d)
    return qa.number_difference(_numbers(b, "raw"), _numbers(b, "md"))


DIGITS = "regexp_replace({c}, '[^0-9]', '', 'g')"
SIMILAR = """(({x} = {y} AND {a} <> {b}) OR (length({x}) > 1 AND list_sort(string_split({x}, '')) = list_sort(string_split({y}, ''))) OR (length({x}) = length({y}) AND len(list_filter(list_zip(string_split({x}, ''), string_split({y}, '')), lambda p: p[1] IS DISTINCT FROM p[2])) = 1)
  OR (abs(length({x}) - length({y})) = 1 AND (starts_with({x}, {y}) OR starts_with({y}, {x}) OR ends_with({x}, {y}) OR ends_with({y}, {x}))))""".format(x=DIGITS.format(c="g.token"), y=DIGITS.format(c="u.token"), a="g.token", b="u.token")  # fmt: skip


@query(rf"""WITH RECURSIVE {BLOCKS}, ra AS (SELECT book_id, chapter_key, pages[1] AS page, nfc_normalize(raw) AS s FROM b WHERE raw IS NOT NULL),
w AS (SELECT book_id, chapter_key, page, s, unnest(regexp_extract_all(s, '{NUM}', 2)) AS m, unnest(list_transform(string_split_regex(regexp_replace(s, '{NUM}', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(1)), lambda x, i: i)[2:]) AS i,
  string_split_regex(regexp_replace(s, '{NUM}', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(1)) AS parts FROM ra),
c AS (SELECT book_id, chapter_key, page, regexp_replace(regexp_replace(m, '\s+', '', 'g'), '[.,]+$', '') AS token,
  left(replace(regexp_replace(array_to_string(parts[i:], ''), '^[^' || chr(2) || ']*' || chr(2), ''), chr(2), ''), 14) AS ctx FROM w),
ga AS (SELECT book_id, chapter_key, token, count(*) AS a, min({{'p': page, 'c': ctx}}) AS f FROM c WHERE token <> '' GROUP BY 1, 2, 3),
gb AS (SELECT book_id, chapter_key, token, count(*) AS b, min(page) AS pb FROM (SELECT book_id, chapter_key, pages[1] AS page, regexp_replace(regexp_replace(unnest(regexp_extract_all(nfc_normalize(md), '{NUM}', 2)), '\s+', '', 'g'), '[.,]+$', '') AS token FROM b WHERE md IS NOT NULL) WHERE token <> '' GROUP BY 1, 2, 3),
d AS (SELECT coalesce(ga.book_id, gb.book_id) AS book_id, coalesce(ga.chapter_key, gb.chapter_key) AS chapter_key, coalesce(ga.token, gb.token) AS token, coalesce(a, 0) - coalesce(b, 0) AS d, coalesce(f.p, pb) AS page, coalesce(f.c, '') AS ctx
  FROM ga FULL JOIN gb ON ga.book_id = gb.book_id AND ga.chapter_key = gb.chapter_key AND ga.token = gb.token WHERE coalesce(a, 0) <> coalesce(b, 0)),
e AS (SELECT *, contains(token, '%') OR contains(token, '.') OR regexp_matches(ctx, '{numeric.UNIT}') OR regexp_matches(token, '^[<>≤≥±~]') AS clinical, unnest(range(CAST(abs(d) AS BIGINT))) AS k FROM d),
st AS (SELECT book_id, chapter_key, list({{'token': token, 'page': page, 'clinical': clinical}} ORDER BY token, k) FILTER (d > 0) AS gone, list({{'token': token, 'page': page, 'clinical': clinical}} ORDER BY token, k) FILTER (d < 0) AS extra FROM e GROUP BY 1, 2),
f AS (SELECT book_id, chapter_key, coalesce(gone, []) AS gone, coalesce(extra, []) AS extra, 0 AS i, NULL::BIGINT AS hit, NULL::VARCHAR AS output FROM st
  UNION ALL SELECT book_id, chapter_key, gone, CASE WHEN q.hit > 0 THEN list_concat(extra[:q.hit - 1], extra[q.hit + 1:]) ELSE extra END, f.i + 1, q.hit, CASE WHEN q.hit > 0 THEN extra[q.hit].token END
  FROM f, LATERAL (SELECT coalesce(list_position(list_transform(extra, lambda u: {SIMILAR.replace('g.token', 'gone[f.i + 1].token')}), true), 0) AS hit) q WHERE f.i < len(gone)),
o AS (SELECT book_id, chapter_key, gone[i] AS g, hit, output FROM f WHERE i > 0)
SELECT book_id, chapter_key, CASE WHEN hit > 0 THEN CASE WHEN g.clinical THEN 'CRITICAL' ELSE 'HIGH' END ELSE CASE WHEN g.clinical THEN 'HIGH' ELSE 'MEDIUM' END END AS severity, CASE WHEN hit > 0 THEN 'CHANGED_NUMBER' ELSE 'MISSING_NUMBER' END AS code, g.token AS source, output, g.page AS page FROM o
UNION ALL SELECT book_id, chapter_key, 'MEDIUM', 'UNEXPECTED_NUMBER', NULL, u.token, u.page FROM (SELECT book_id, chapter_key, unnest(extra) AS u FROM f WHERE i = len(gone))""")
def e2_number_issues(spark, d):
    b = blocks(spark, d)
    page = F.try_element_at("pages", F.lit(1)).alias("page")
    src = b.where("raw is not null").select("book_id", "chapter_key", page, F.explode(numeric.tokens_in_context(F.col("raw"))).alias("m")).select("book_id", "chapter_key", "page", "m.token", "m.ctx")
    out = b.where("md is not null").select("book_id", "chapter_key", page, F.explode(numeric.tokens(F.col("md"))).alias("token"))
    return qa.number_issues(src, out)


@query(rf"""WITH {BLOCKS}, h AS (SELECT *, lag(h_level) OVER (PARTITION BY book_id, chapter_key ORDER BY seq NULLS FIRST, block_id) AS before FROM b WHERE block_type = 'heading'),
n AS (SELECT *, lead(block_type) OVER w AS nt, lead(h_level) OVER w AS nl FROM b WINDOW w AS (PARTITION BY book_id, chapter_key ORDER BY seq NULLS FIRST, block_id)),
p AS (SELECT book_id, chapter_key, count(*) FILTER (block_type = 'heading') AS n, count(*) FILTER (block_type = 'heading' AND h_level = 1) AS n1 FROM b GROUP BY 1, 2)
SELECT book_id, chapter_key, 'NO_HEADINGS' AS code, NULL AS block_id FROM p WHERE n = 0 UNION ALL SELECT book_id, chapter_key, 'H1_COUNT', NULL FROM p WHERE n > 0 AND n1 <> 1
UNION ALL SELECT book_id, chapter_key, 'HEADING_JUMP', block_id FROM h WHERE h_level > before + 1 UNION ALL SELECT book_id, chapter_key, 'EMPTY_SECTION', block_id FROM n WHERE block_type = 'heading' AND nt = 'heading' AND nl <= h_level AND h_level > 1""")
def e4_heading_issues(spark, d):
    return qa.heading_issues(blocks(spark, d)).select("book_id", "chapter_key", "code", "block_id")


LISTED = r"""listed AS (SELECT DISTINCT book_id, chapter_key, CAST(unnest(regexp_extract_all(coalesce(raw, clean), '(?m)^[ \t]*\[?(\d{1,3})[\].)]', 1)) AS INT) AS n FROM b WHERE block_type = 'reference'),
per AS (SELECT book_id, chapter_key, list(n) AS have, min(n) AS a, max(n) AS z FROM listed GROUP BY 1, 2), ct AS (SELECT DISTINCT book_id, chapter_key, n FROM nums WHERE block_type <> 'reference')"""


@query(f"""WITH {BLOCKS}, {CITED}, {LISTED}
SELECT book_id, chapter_key, 'CITATIONS_NO_REFERENCES' AS code, count(*) || ' cited numbers' AS message FROM ct WHERE NOT EXISTS (SELECT 1 FROM per WHERE per.book_id = ct.book_id AND per.chapter_key = ct.chapter_key) GROUP BY 1, 2
UNION ALL SELECT ct.book_id, ct.chapter_key, 'CITATION_NOT_IN_LIST', string_agg(n, ',' ORDER BY n) FROM ct JOIN per ON per.book_id = ct.book_id AND per.chapter_key = ct.chapter_key WHERE NOT list_contains(have, CAST(n AS INT)) GROUP BY 1, 2
UNION ALL SELECT book_id, chapter_key, 'REFERENCE_GAPS', string_agg(g, ',' ORDER BY g) FROM (SELECT book_id, chapter_key, have, unnest(range(a, z + 1)) AS g FROM per) WHERE NOT list_contains(have, CAST(g AS INT)) GROUP BY 1, 2""")
def e5_citation_issues(spark, d):
    return qa.citation_issues(blocks(spark, d)).select("book_id", "chapter_key", "code", "message")


@query(rf"""WITH {BLOCKS}, {CHAPTERS}, own AS (SELECT DISTINCT book_id, chapter_key, chapter_no FROM c WHERE chapter_no IS NOT NULL),
m AS (SELECT DISTINCT book_id, chapter_key, unnest(regexp_extract_all(clean, '\b(?:Figure|Fig\.) (\d+\.\d+)', 1)) AS n FROM b WHERE block_type IN ('paragraph', 'list', 'callout')),
k AS (SELECT DISTINCT book_id, chapter_key, regexp_extract(clean, '(?i)^\s*(?:figure|fig\.?)\s+(\d+\.\d+)', 1) AS n FROM b WHERE block_type = 'caption')
SELECT book_id, chapter_key, 'Figure ' || n AS message FROM m JOIN own USING (book_id, chapter_key) WHERE CAST(regexp_extract(n, '^(\d+)\.', 1) AS INT) = chapter_no AND NOT EXISTS (SELECT 1 FROM k WHERE k.book_id = m.book_id AND k.chapter_key = m.chapter_key AND k.n = m.n)""")
def e6_figure_mentions(spark, d):
    return qa.figure_mentions(blocks(spark, d), chapters(spark, d)).select("book_id", "chapter_key", "message")


@query("""SELECT * FROM (VALUES (1, 'ch2.md#x'), (2, 'img/none.png')) t(id, target)""")
def e7_link_check(spark, d):
    docs = spark.createDataFrame([(1, "see [a](ch1.md), [b](ch2.md#x), [c](https://x.test/y) and [d](#top)"), (2, "![i](img/none.png) [k](./ch1.md#a)")], "id int, md string")
    return qa.link_check(docs, "id", "md", spark.createDataFrame([("ch1.md",)], "path string"), "path")


@query(f"""WITH {CHAPTERS}, {LINES}, w AS (SELECT DISTINCT book_id, chapter_key, unnest(range(page_from, page_to + 1)) AS page FROM c WHERE page_from IS NOT NULL AND page_to >= page_from)
SELECT book_id, chapter_key, CAST(page AS INT) AS page FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.book_id = w.book_id AND l.chapter_key = w.chapter_key AND l.page = w.page)""")
def e8_pages_skipped(spark, d):
    return qa.pages_skipped(chapters(spark, d), lines(spark, d)).select("book_id", "chapter_key", "page")


@query(f"""WITH {BLOCKS}, {LINES}, h AS (SELECT DISTINCT book_id, chapter_key, page FROM l WHERE trim(raw) <> '') SELECT book_id, chapter_key, page FROM h
WHERE NOT EXISTS (SELECT 1 FROM (SELECT book_id, chapter_key, unnest(pages) AS page FROM b) o WHERE o.book_id = h.book_id AND o.chapter_key = h.chapter_key AND o.page = h.page)""")
def e9_pages_not_in_output(spark, d):
    return qa.pages_not_in_output(lines(spark, d), blocks(spark, d)).select("book_id", "chapter_key", "page")


def _issues(spark, d):
    b, ls, c = blocks(spark, d), lines(spark, d), chapters(spark, d)
    parts = [qa.heading_issues(b), qa.citation_issues(b), qa.figure_mentions(b, c), qa.mark_issues(b), qa.short_pages(ls), qa.blank_pages(ls), qa.pages_skipped(c, ls), qa.pages_not_in_output(ls, b), qa.text_loss(b, "raw", "clean")]
    return qa.all_issues(parts), c


@query(rf"""WITH {BLOCKS}, r AS (SELECT book_id, chapter_key, block_id, unnest(list_filter([CASE WHEN regexp_matches(clean, '[ﬀ-ﬆ]') THEN 'LIGATURE_LEFT' END, CASE WHEN regexp_matches(clean, '[\x{{E000}}-\x{{F8FF}}]|\(cid:\d+\)|\x{{FFFD}}') THEN 'ENCODING_IN_MD' END,
 CASE WHEN regexp_matches(clean, '(^|[^A-Za-z])(?:[A-Za-z] ){{5,}}[A-Za-z]([^A-Za-z]|$)') THEN 'SPACED_LETTERS' END, CASE WHEN regexp_matches(clean, '[A-Za-z]{{2,}}- [a-z]{{2,}}') THEN 'HYPHEN_SPACE' END], lambda x: x IS NOT NULL)) AS code FROM b WHERE clean IS NOT NULL) SELECT * FROM r""")
def e10_mark_issues(spark, d):
    return qa.mark_issues(blocks(spark, d)).select("book_id", "chapter_key", "block_id", "code")


def _all_codes() -> str:
    """SQL of all issues as book_id, chapter_key, code, out of the SQL of each rule."""
    from vellumspark.plans import layout_queries

    one = lambda sql, code="code": f"SELECT book_id, chapter_key, {code} AS code FROM ({sql})"
    loss = f"SELECT * FROM ({layout_queries.ORACLE['b3_char_loss']}) WHERE loss_ratio > 0.003"
    blank = f"WITH {LINES} SELECT book_id, chapter_key, page FROM l GROUP BY ALL HAVING sum(length(trim(coalesce(raw, '')))) = 0"
    return " UNION ALL ".join([
        one(ORACLE["e4_heading_issues"]), one(ORACLE["e5_citation_issues"]), one(ORACLE["e6_figure_mentions"], "'FIGURE_MENTION_MISSING'"), one(ORACLE["e10_mark_issues"]), one(layout_queries.ORACLE["b4_short_pages"], "'PAGE_TEXT_SHORT'"),
        one(blank, "'PAGE_BLANK'"), one(ORACLE["e8_pages_skipped"], "'PAGE_SKIPPED'"), one(ORACLE["e9_pages_not_in_output"], "'PAGE_NOT_IN_MARKDOWN'"), one(loss, "CASE WHEN loss_ratio > 0.01 THEN 'TEXT_LOSS' ELSE 'TEXT_LOSS_MINOR' END"),
    ])


STATE = "st AS (SELECT book_id, chapter_key, s.status AS status FROM (SELECT book_id, chapter_key, max({'a': loaded_at, 'status': status, 'page': page}) AS s FROM chapter_state GROUP BY 1, 2))"


@query()
def e3_issues(spark, d):
    return qa.in_order(_issues(spark, d)[0])


@query(f"SELECT book_id, chapter_key, code, count(*) AS n FROM ({_all_codes()}) GROUP BY 1, 2, 3")
def e3_issue_counts(spark, d):
    return _issues(spark, d)[0].groupBy("book_id", "chapter_key", "code").agg(F.count("*").alias("n"))


@query(f"""WITH {CHAPTERS}, {STATE}, i AS (SELECT book_id, chapter_key, CASE WHEN code IN ('PAGE_SKIPPED', 'PAGE_NOT_IN_MARKDOWN') THEN 'c' WHEN code = 'TEXT_LOSS' THEN 'h' WHEN code IN ('EMPTY_SECTION', 'REFERENCE_GAPS', 'SPACED_LETTERS', 'HYPHEN_SPACE', 'PAGE_BLANK') THEN 'l' ELSE 'm' END AS s FROM ({_all_codes()})),
n AS (SELECT k.book_id, k.chapter_key, count(*) FILTER (s = 'c') AS n_critical, count(*) FILTER (s = 'h') AS n_high, count(*) FILTER (s = 'm') AS n_medium, count(*) FILTER (s = 'l') AS n_low
  FROM (SELECT DISTINCT book_id, chapter_key FROM c) k LEFT JOIN i ON i.book_id = k.book_id AND i.chapter_key = k.chapter_key GROUP BY 1, 2)
SELECT n.*, CASE WHEN st.status = 'FAILED' THEN 'FAILED' WHEN n_critical + n_high > 0 THEN 'REVIEW_REQUIRED' WHEN n_medium + n_low > 0 THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS status FROM n LEFT JOIN st ON st.book_id = n.book_id AND st.chapter_key = n.chapter_key""")
def e3_chapter_status(spark, d):
    found, c = _issues(spark, d)
    return qa.status_of(found, c, C.latest_state(table(spark, d, "chapter_state")).where("status = 'FAILED'"))


# ---- F: sections and rendering ---------------------------------------------------------------------------------


@query(rf"""WITH RECURSIVE {BLOCKS}, h AS (SELECT book_id, chapter_key, seq, block_id, least(greatest(coalesce(h_level, 2), 1), 6) AS lv, clean AS title, row_number() OVER (PARTITION BY book_id, chapter_key ORDER BY seq NULLS FIRST, block_id) AS i FROM b WHERE block_type = 'heading'),
st AS (SELECT book_id, chapter_key, i, block_id, [{{'l': lv, 't': title}}] AS s FROM h WHERE i = 1 UNION ALL
  SELECT h.book_id, h.chapter_key, h.i, h.block_id, list_append(list_filter(st.s, lambda x: x.l < h.lv), {{'l': h.lv, 't': h.title}}) FROM st JOIN h ON h.book_id = st.book_id AND h.chapter_key = st.chapter_key AND h.i = st.i + 1)
SELECT block_id, list_transform(s, lambda x: x.t) AS path FROM st""")
def f1_heading_paths(spark, d):
    return A.heading_paths(blocks(spark, d)).where("block_type = 'heading'").select("block_id", "path")


_Z = "regexp_replace(substr(regexp_replace(regexp_replace(lower(strip_accents({t})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '')"
SLUG = f"CASE WHEN {_Z} = '' THEN 'untitled' ELSE {_Z} END"


@query(rf"""WITH RECURSIVE {BLOCKS}, h AS (SELECT book_id, chapter_key, seq, block_id, least(greatest(coalesce(h_level, 2), 1), 6) AS lv, clean AS title, row_number() OVER (PARTITION BY book_id, chapter_key ORDER BY seq NULLS FIRST, block_id) AS i FROM b WHERE block_type = 'heading'),
st AS (SELECT book_id, chapter_key, i, seq, block_id, title, [{{'l': lv, 't': title}}] AS s FROM h WHERE i = 1 UNION ALL
  SELECT h.book_id, h.chapter_key, h.i, h.seq, h.block_id, h.title, list_append(list_filter(st.s, lambda x: x.l < h.lv), {{'l': h.lv, 't': h.title}}) FROM st JOIN h ON h.book_id = st.book_id AND h.chapter_key = st.chapter_key AND h.i = st.i + 1),
q AS (SELECT book_id, chapter_key, seq, block_id, i, s[-1].l AS level, title, CASE WHEN len(s) > 1 THEN s[-2].t END AS parent FROM st),
r AS (SELECT *, {SLUG.format(t="coalesce(title, '')")} AS slug, CASE WHEN parent IS NOT NULL THEN {SLUG.format(t='parent')} END AS ps FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_key, slug ORDER BY seq NULLS FIRST, block_id) AS n FROM r), bs AS (SELECT *, CASE WHEN n = 1 OR ps IS NULL THEN slug ELSE ps || '-' || slug END AS base FROM n),
m AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_key, base ORDER BY seq NULLS FIRST, block_id) AS m FROM bs)
SELECT block_id, i AS section_no, level, parent, CASE WHEN m = 1 THEN base ELSE base || '-' || m END AS section_id FROM m""")
def f2_section_ids(spark, d):
    return A.sections(blocks(spark, d)).select("block_id", F.col("section_no").cast("bigint").alias("section_no"), "level", "parent", "section_id")


@query()
def f2_sections(spark, d):
    return A.sections(blocks(spark, d))


@query(rf"""WITH {BLOCKS}, h AS (SELECT block_id, book_id, chapter_key, seq, replace(regexp_replace(lower(clean), '[^\p{{L}}\p{{N}}_ -]', '', 'g'), ' ', '-') AS s FROM b WHERE block_type = 'heading' AND clean IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_key, s ORDER BY seq NULLS FIRST, block_id) - 1 AS n FROM h) SELECT block_id, CASE WHEN n = 0 THEN s ELSE s || '-' || n END AS anchor FROM n""")
def f3_anchors(spark, d):
    return A.heading_anchors(blocks(spark, d).where("block_type = 'heading' and clean is not null"), "clean").select("block_id", "anchor")


MARKED = r"""x AS (SELECT *, lag(pages[-1]) OVER w AS pv FROM b WHERE md IS NOT NULL WINDOW w AS (PARTITION BY book_id, chapter_key ORDER BY seq NULLS FIRST, block_id)),
m AS (SELECT *, CASE WHEN pages[1] IS NOT NULL AND (pv IS NULL OR pages[1] <> pv) THEN pages[1] END AS page_marker, length(md) - length(replace(md, chr(10), '')) + 1 AS n FROM x),
k AS (SELECT *, coalesce(sum(n + CASE WHEN page_marker IS NULL THEN 0 ELSE 2 END + 1) OVER (PARTITION BY book_id, chapter_key ORDER BY seq NULLS FIRST, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM m)"""


@query(rf"""WITH {BLOCKS}, {MARKED}
SELECT block_id, page_marker, CAST(bf + CASE WHEN page_marker IS NULL THEN 0 ELSE 2 END + 1 AS BIGINT) AS line_start, CAST(bf + CASE WHEN page_marker IS NULL THEN 0 ELSE 2 END + n AS BIGINT) AS line_end,
 substr(sha1(regexp_replace(lower(coalesce(clean, md)), '[^0-9a-z]+', '', 'g')), 1, 12) AS fingerprint FROM k""")
def f4_source_map(spark, d):
    return A.source_map(blocks(spark, d)).select("block_id", "page_marker", "line_start", "line_end", "fingerprint")


@query(f"""WITH {BLOCKS}, {MARKED} SELECT book_id, chapter_key, string_agg(coalesce('<!-- source_page: ' || page_marker || ' -->' || chr(10) || chr(10), '') || md, chr(10) || chr(10) ORDER BY seq NULLS FIRST, block_id) AS markdown, count(*) AS n_blocks FROM k GROUP BY 1, 2""")
def f4_markdown(spark, d):
    return A.markdown(blocks(spark, d))


@query(rf"""WITH {BLOCKS}, r AS (SELECT block_id, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) - 1 AS r FROM b WHERE block_type = 'table' AND raw IS NOT NULL),
c AS (SELECT block_id, r, regexp_split_to_array(trim(line), '\s{{2,}}') AS cs FROM r), w AS (SELECT *, max(len(cs)) OVER (PARTITION BY block_id) AS w FROM c),
t AS (SELECT block_id, r, w, '| ' || array_to_string(list_transform(range(1, w + 1), lambda i: coalesce(replace(cs[i], '|', '\|'), '')), ' | ') || ' |' AS line FROM w)
SELECT block_id, string_agg(line || CASE WHEN r = 0 THEN chr(10) || '|' || repeat(' --- |', CAST(w AS INT)) ELSE '' END, chr(10) ORDER BY r) AS gfm, count(*) AS n_rows FROM t GROUP BY 1""")
def f5_gfm_tables(spark, d):
    rows = blocks(spark, d).where("block_type = 'table' and raw is not null").select("block_id", F.posexplode(F.split("raw", "\n")).alias("r", "line"))
    cells = rows.select("block_id", "r", F.posexplode(F.split(F.trim("line"), r"\s{2,}")).alias("c", "cell"))
    return A.gfm_table(cells, ["block_id"], "r", "c", "cell").select("block_id", "gfm", "n_rows")


@query("""SELECT * FROM (VALUES (1, '**Bold name** plain *it* x<sup>2</sup>', '<b>Bold name</b> plain <i>it</i> x<sup>2</sup>'), (2, 'a <!-- source_page: 4 --> b \\*c', 'a b *c')) t(id, md, html)""")
def f6_spans(spark, d):
    rows = [(1, [("Bold ", 1, None), ("name", 1, None), (" plain ", 0, None), ("it", 2, None), (" x", 0, None), ("2", 4, None)]), (2, [("a ", 0, None), ("b ", 0, 4), ("*c", 0, None)])]
    df = spark.createDataFrame(rows, "id int, spans array<struct<text:string,bits:int,mark:int>>")
    return df.select("id", A.spans_to_md(F.col("spans")).alias("md"), A.spans_to_html(F.col("spans")).alias("html"))


@query(f"""WITH {CHAPTERS} SELECT book_id, chapter_key, title, '---' || chr(10) || 'title: ' || to_json(title) || chr(10) || 'chapter_no: ' || coalesce(to_json(CAST(chapter_no AS VARCHAR)), '""') || chr(10) || '---' AS front_matter FROM c WHERE title IS NOT NULL""")
def f8_front_matter(spark, d):
    return A.front_matter(chapters(spark, d).where("title is not null"), ["title", "chapter_no"]).select("book_id", "chapter_key", "title", "front_matter").distinct()


@query("""SELECT 't' AS table_id, '<table>' || chr(10) || '<tr><th rowspan="2">A</th><th colspan="2">B &amp; C</th></tr>' || chr(10) || '<tr><td>x</td><td>&lt;y</td></tr>' || chr(10) || '</table>' AS html""")
def f9_html_table(spark, d):
    rows = [("t", 0, 0, 2, 1, "A", True), ("t", 0, 1, 1, 2, "B & C", True), ("t", 1, 1, 1, 1, "x", False), ("t", 1, 2, 1, 1, "<y", False)]
    return A.html_table(spark.createDataFrame(rows, "table_id string, r int, c int, rs int, cs int, raw string, header boolean"), ["table_id"])


# ---- G: cross-references ---------------------------------------------------------------------------------------

REFS = r"""m AS (SELECT block_id, book_id, chapter_key, unnest(regexp_extract_all(regexp_replace(clean, '<!--(?s:.*?)-->|<[^>\n]+>|!\[[^\]]*\]\([^)]*\)|\[[^\]]*\]\([^)]*\)|`[^`]*`|\[\^[^\]]+\]', ' ', 'g'), '\b(?:Chapter|Table|Figure|Fig\.|Box)\s+\d+(?:\.\d+)*[A-Za-z]?')) AS ref FROM b WHERE clean IS NOT NULL),
g AS (SELECT *, regexp_extract(ref, '^(Chapter|Table|Figure|Fig\.|Box)\s+(.*)$', ['w', 'n']) AS g FROM m),
rf AS (SELECT block_id, book_id, chapter_key, ref, CASE g.w WHEN 'Fig.' THEN 'figure' ELSE lower(g.w) END AS kind, g.n AS num,
  CASE WHEN g.w = 'Chapter' THEN CAST(regexp_extract(g.n, '^(\d+)', 1) AS INT) WHEN contains(g.n, '.') THEN CAST(regexp_extract(g.n, '^(\d+)\.', 1) AS INT) END AS target_chapter FROM g)"""


@query(f"WITH {BLOCKS}, {REFS} SELECT block_id, ref, kind, num, upper(kind[1]) || kind[2:] || ' ' || num AS label, target_chapter FROM rf")
def g1_mentions(spark, d):
    return xref.mentions(blocks(spark, d), ["block_id"], "clean")


def _registry(spark, d):
    """One file per chapter number (of equal numbers the first chapter) and the labels of its captions."""
    c = chapters(spark, d).where("chapter_no is not null").groupBy(F.col("chapter_no").alias("chapter_number")).agg(F.min(F.concat_ws("-", "book_id", "chapter_key")).alias("k"))
    files = c.select("chapter_number", F.concat("k", F.lit(".md")).alias("file"))
    b = blocks(spark, d).where("block_type = 'caption' and clean is not null").withColumn("k", F.concat_ws("-", "book_id", "chapter_key"))
    kind, num = F.regexp_extract("clean", text.LABEL, 1), F.regexp_extract("clean", text.LABEL, 2)
    labels = b.join(c, "k").where(kind != "").select("chapter_number", text.normal_label(kind, num).alias("label"), text.label_anchor(kind, num).alias("anchor"))
    return files, labels.groupBy("chapter_number", "label").agg(F.min("anchor").alias("anchor")).withColumn("table_file", F.lit(None).cast("string"))


REGISTRY = r"""rc AS (SELECT chapter_no AS num_c, min(book_id || '-' || chapter_key) AS k FROM c WHERE chapter_no IS NOT NULL GROUP BY 1),
lg AS (SELECT num_c, regexp_extract(clean, '(?i)^\s*(figure|fig\.?|table|box|algorithm|plate)\s+([0-9IVXA-Z][0-9.A-Za-z-]*)', ['kind', 'num']) AS g FROM b JOIN rc ON rc.k = b.book_id || '-' || b.chapter_key WHERE block_type = 'caption' AND clean IS NOT NULL),
lk AS (SELECT num_c, lower(regexp_replace(g.kind, '\.$', '')) AS kd, g.num AS num FROM lg WHERE g.kind <> ''),
lb AS (SELECT num_c, label, min(anchor) AS anchor FROM (SELECT num_c, CASE kd WHEN 'fig' THEN 'Figure' ELSE upper(kd[1]) || kd[2:] END || ' ' || regexp_replace(num, '[.]+$', '') AS label,
  CASE kd WHEN 'table' THEN 'table-' ELSE 'figure-' END || regexp_replace(regexp_replace(lower(num), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS anchor FROM lk) GROUP BY 1, 2)"""


@query(f"""WITH {BLOCKS}, {CHAPTERS}, {REFS}, {REGISTRY}, cn AS (SELECT book_id, chapter_key, min(chapter_no) AS own FROM c WHERE chapter_no IS NOT NULL GROUP BY 1, 2),
x AS (SELECT rf.*, own, coalesce(target_chapter, own) AS t, upper(kind[1]) || kind[2:] || ' ' || num AS label FROM rf JOIN cn ON cn.book_id = rf.book_id AND cn.chapter_key = rf.chapter_key)
SELECT block_id, ref, CASE WHEN kind = 'chapter' THEN CASE WHEN t <> own AND rc.k IS NOT NULL THEN './' || rc.k || '.md' END WHEN anchor IS NOT NULL THEN coalesce(CASE WHEN t <> own THEN './' || rc.k || '.md#' || anchor END, '#' || anchor) END AS url
FROM x LEFT JOIN rc ON rc.num_c = t LEFT JOIN lb ON lb.num_c = t AND lb.label = x.label""")
def g2_resolved(spark, d):
    files, labels = _registry(spark, d)
    own = chapters(spark, d).where("chapter_no is not null").groupBy("book_id", "chapter_key").agg(F.min("chapter_no").alias("chapter_number"))
    refs = xref.mentions(blocks(spark, d), ["block_id", "book_id", "chapter_key"], "clean").join(own, ["book_id", "chapter_key"])
    return xref.resolve(refs, files, labels).select("block_id", "ref", "url")


@query("""SELECT * FROM (VALUES ('b1', 'Chapter 2', './ch2.md'), ('b2', 'Table 2.1', 'tables/t21.md'), ('b3', 'Figure 2.2', './ch2.md#figure-2-2')) t(block_id, ref, url)""")
def g3_late_binding(spark, d):
    refs = spark.createDataFrame([("b1", "see Chapter 2 and Box 1.1", 1), ("b2", "Table 2.1 of [Table 2.1](x)", 1), ("b3", "`Figure 2.9` but Figure 2.2", 1)], "block_id string, md string, chapter_number int")
    waiting = xref.mentions(refs, ["block_id", "chapter_number"], "md")
    none = spark.createDataFrame([], "chapter_number int, label string, anchor string, table_file string")
    first = xref.pending(xref.resolve(waiting, spark.createDataFrame([(1, "ch1.md")], "chapter_number int, file string"), none))
    files = spark.createDataFrame([(1, "ch1.md"), (2, "ch2.md")], "chapter_number int, file string")
    labels = spark.createDataFrame([(2, "Table 2.1", "table-2-1", "tables/t21.md"), (2, "Figure 2.2", "figure-2-2", None)], "chapter_number int, label string, anchor string, table_file string")
    return xref.resolve_pending(first, files, labels)[0].select("block_id", "ref", "url")


@query("""SELECT * FROM (VALUES (1, 'see [Table 2.1](t.md), `Table 2.1` and [Table 2.1](old.md)'), (2, 'Table 2.10 stays')) t(id, linked)""")
def g4_rewrite(spark, d):
    df = spark.createDataFrame([(1, "see Table 2.1, `Table 2.1` and [Table 2.1](old.md)", {"Table 2.1": "t.md"}), (2, "Table 2.10 stays", {"Table 2.1": "t.md"})], "id int, md string, urls map<string,string>")
    return df.select("id", xref.rewrite(F.col("md"), F.col("urls")).alias("linked"))


# ---- I: incremental, navigation, states ------------------------------------------------------------------------



@query(f"WITH {BLOCKS} SELECT book_id, count(*) AS n_blocks, count(*) FILTER (book_id = 'b000002') AS n_fresh FROM (SELECT * FROM b WHERE book_id <> 'b000002' UNION ALL SELECT * FROM b WHERE book_id = 'b000002' AND block_type = 'paragraph') GROUP BY 1")
def i1_replace_by_key(spark, d):
    b = blocks(spark, d)
    fresh = b.where("book_id = 'b000002' and block_type = 'paragraph'")
    out = I.replace_by_key(b, fresh, ["book_id"])
    return out.groupBy("book_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("book_id") == "b000002").alias("n_fresh"))


@query(f"""WITH {LINES}, w AS (SELECT DISTINCT book_id, chapter_key, page FROM l), dn AS (SELECT DISTINCT book_id, chapter_key, page FROM chapter_state WHERE parser_version = '1.4.1' AND ocr IS NOT DISTINCT FROM true)
SELECT book_id, chapter_key, page FROM w WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.book_id = w.book_id AND dn.chapter_key = w.chapter_key AND dn.page = w.page)""")
def i2_remaining_pages(spark, d):
    keys = ["book_id", "chapter_key", "page"]
    return I.remaining_pages(lines(spark, d).select(*keys).distinct(), table(spark, d, "chapter_state"), keys, "1.4.1", True)


ENDINGS = ["ment", "tion", "ity", "ance"]


@query(rf"""WITH {BLOCKS}, t AS (SELECT book_id, chapter_key, section_id, seq, lower(unnest(regexp_extract_all(clean, '\b[A-Za-z]{{3,}}(?:ment|tion|ity|ance)\b'))) AS term FROM b WHERE clean IS NOT NULL)
SELECT book_id, chapter_key, term, count(*) AS n FROM t GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def i3_terms_by_ending(spark, d):
    return N.terms_by_ending(blocks(spark, d), ENDINGS).select("book_id", "chapter_key", "term", "n")


@query(f"""WITH {BLOCKS}, t AS (SELECT book_id, chapter_key, trim(clean) AS term, section_id FROM b WHERE block_type = 'heading' AND h_level IN (2, 3) AND clean IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY book_id, chapter_key, section_id NULLS FIRST) AS n FROM t)
SELECT term, count(*) AS n_places FROM n WHERE n <= 8 GROUP BY 1""")
def i3_topic_index(spark, d):
    return N.index_lines(N.topics(blocks(spark, d)).where("term is not null")).select("term", "n_places")


@query()
def i3_navigation(spark, d):
    return N.navigation(blocks(spark, d), ENDINGS)


@query(f"WITH {CHAPTERS}, {STATE} SELECT DISTINCT book_id, chapter_key FROM c WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.book_id = c.book_id AND st.chapter_key = c.chapter_key AND status IN ({', '.join(repr(s) for s in DONE_STATES)}))")
def i4_chapters_to_do(spark, d):
    return I.chapters_to_do(chapters(spark, d), table(spark, d, "chapter_state")).select("book_id", "chapter_key").distinct()


@query(f"""WITH {CHAPTERS}, {STATE}, k AS (SELECT DISTINCT book_id, chapter_key FROM c) SELECT k.book_id, count(*) AS n_chapters, count(*) FILTER (status IN ({', '.join(repr(s) for s in DONE_STATES)})) AS n_done,
round(count(*) FILTER (status IN ({', '.join(repr(s) for s in DONE_STATES)})) * 100.0 / count(*), 1) AS percent FROM k LEFT JOIN st ON st.book_id = k.book_id AND st.chapter_key = k.chapter_key GROUP BY 1""")
def i5_progress(spark, d):
    return C.progress(chapters(spark, d), table(spark, d, "chapter_state"))


@query(f"""WITH {LINES}, cs AS (SELECT book_id, chapter_key, page, min(clip_lo) AS lo, max(clip_hi) AS hi FROM chapter_state GROUP BY 1, 2, 3)
SELECT line_id FROM l LEFT JOIN cs ON cs.book_id = l.book_id AND cs.chapter_key = l.chapter_key AND cs.page = l.page WHERE (lo IS NULL OR y0 >= lo - 2) AND (hi IS NULL OR y0 < hi - 2)""")
def i6_clip_lines(spark, d):
    bounds = table(spark, d, "chapter_state").groupBy("book_id", "chapter_key", "page").agg(F.min("clip_lo").alias("lo"), F.max("clip_hi").alias("hi"))
    return I.clip_lines(lines(spark, d), bounds).select("line_id")


@query(f"WITH {CHAPTERS}, n AS (SELECT book_id, chapter_key, page_from, CASE WHEN book_id = 'b000001' THEN page_to + 1 ELSE page_to END AS page_to FROM c) SELECT DISTINCT c.book_id, c.chapter_key FROM c JOIN n ON n.book_id = c.book_id AND n.chapter_key = c.chapter_key WHERE c.page_to IS DISTINCT FROM n.page_to")
def i7_changed_chapters(spark, d):
    c = chapters(spark, d).groupBy("book_id", "chapter_key").agg(F.max("page_from").alias("page_from"), F.max("page_to").alias("page_to"))
    after = c.withColumn("page_to", F.when(F.col("book_id") == "b000001", F.col("page_to") + 1).otherwise(F.col("page_to")))
    return I.changed_chapters(c, after, ["page_from", "page_to"])


