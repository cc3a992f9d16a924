"""Group A: scalar text functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.functions import numeric, text
from vellumspark.operators import hyphen, qa
from vellumspark.plans.common import BLOCKS, CHAPTERS, blocks, chapters, documents, lines, LINES

KEYS = ["book_id", "chapter_key"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(nfc_normalize(text), '(^|[^A-Za-z0-9])((?:[<>≤≥±~])?\s?\d+(?:[.,]\d+)*(?:\s?%)?)', 2)) AS t FROM documents),
n AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\s+', '', 'g'), '[.,]+$', '') AS token FROM t)
SELECT doc_id, token, count(*) AS n FROM n WHERE token <> '' GROUP BY ALL""")
def a1_numeric_tokens(spark, d):
    return documents(spark, d).select("doc_id", F.explode(numeric.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(rf"""
WITH {BLOCKS}, t AS (SELECT block_id, list_filter(string_split(trim(regexp_replace(clean, '\s+', ' ', 'g')), ' '), lambda x: true) AS ws FROM b WHERE clean IS NOT NULL),
w AS (SELECT block_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS at0, ws FROM t)
SELECT block_id, word, CAST(at0 AS INT) AS "at" FROM w WHERE word = ws[at0 + 2] AND regexp_full_match(word, '[A-Za-z]{{2,}}') AND lower(word) NOT IN ('had', 'that', 'is', 'do')""")
def a4_doubled_words(spark, d):
    return qa.doubled_words(blocks(spark, d), ["block_id"], "clean")


@query(rf"""
WITH {BLOCKS} SELECT block_id,
  regexp_matches(clean, '(^|[^A-Za-z])(?:[A-Za-z] ){{5,}}[A-Za-z]([^A-Za-z]|$)') AS spaced,
  regexp_matches(clean, '[A-Za-z]{{2,}}- [a-z]{{2,}}') AS hyphen_blank,
  regexp_matches(clean, '[\x{{E000}}-\x{{F8FF}}]|\(cid:\d+\)|\x{{FFFD}}') AS artefact FROM b WHERE clean IS NOT NULL""")
def a5_artefact_flags(spark, d):
    c = F.col("clean")
    return blocks(spark, d).where("clean is not null").select("block_id", c.rlike(text.SPACED_LETTERS).alias("spaced"), c.rlike(text.HYPHEN_BLANK).alias("hyphen_blank"), c.rlike(text.ENCODING_ARTEFACT).alias("artefact"))


@query(rf"""
WITH {LINES}, e AS (SELECT line_id, regexp_replace(regexp_replace(regexp_replace(raw, '([*`\\])', '\\\1', 'g'), '(^|[^A-Za-z0-9])_', '\1\\_', 'g'), '<([A-Za-z!?/])', '\\<\1', 'g') AS m FROM l WHERE raw IS NOT NULL)
SELECT line_id, CASE WHEN regexp_matches(m, '^(#{{1,6}}\s|>|[-+*]\s|\d+[.)]\s|={{3,}}|-{{3,}}|\|)') THEN '\' || m ELSE m END AS md FROM e""")
def a6_escape_md(spark, d):
    return lines(spark, d).where("raw is not null").select("line_id", text.escape_line_start(text.escape_md(F.col("raw"))).alias("md"))


STRIP_STEPS = [
    (r"\A---\n(?s:.*?)\n---\n", ""), (r"<!--(?s:.*?)-->", ""), (r"\[\^fn\d+-([^\]]+)\](:?)", r"\1 "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"</?(?:sup|sub)>", ""),
    (r"<br\s*/?>", " "), (r"<a [^>]*></a>", ""), (r"</?(?:t[dhr]|thead|tbody|table|details|summary|p|div)[^>]*>", " "), (r"<(https?://[^>]+)>", r"\1"), (r"(?m)^[ \t]*(?:>[ \t]?)+", ""), (r"\|", " "),
    (r"\\([\\`*_{}\[\]()#+\-.!<>|])", r"\1"), (r"\*", ""), (r"(?m)^[ \t]*-{3,}[ \t]*$", " "), (r"(?m)^[ \t]*:?-{2,}:?(?:[ \t]*:?-{2,}:?)*[ \t]*$", " "),
]


def strip_sql(c: str) -> str:
    for pattern, by in STRIP_STEPS:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", chr(160)), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    return c


@query(f"SELECT doc_id, length(s) AS n_chars, sha256(s) AS digest FROM (SELECT doc_id, {strip_sql('text')} AS s FROM documents WHERE text IS NOT NULL)")
def a7_strip_markdown(spark, d):
    s = text.strip_markdown(F.col("text"))
    return documents(spark, d).where("text is not null").select("doc_id", F.length(s).cast("bigint").alias("n_chars"), F.sha2(s, 256).alias("digest"))


@query(rf"""
WITH {BLOCKS} SELECT block_id, regexp_replace(translate(replace(replace(replace(replace(replace(replace(replace(clean, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st'),
  chr(160) || chr(8194) || chr(8195) || chr(8201) || chr(8239) || chr(8232) || chr(8233) || chr(9) || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279), '        '), '[\x00-\x09\x0b-\x1f\x7f]', '', 'g') AS clean_text
FROM b WHERE clean IS NOT NULL""")
def a8_normalize_chars(spark, d):
    return blocks(spark, d).where("clean is not null").select("block_id", text.normalize_chars(F.col("clean")).alias("clean_text"))


VOCAB = r"""v AS (SELECT DISTINCT book_id, word, contains(word, '-') AS is_hyph FROM (
  SELECT book_id, lower(unnest(regexp_extract_all(regexp_replace(raw, '[A-Za-z-]*[-\x{2010}\x{2011}\x{00AD}][ \t]*\n[ \t]*\S*', ' ', 'g'), '[A-Za-z][A-Za-z\-]*[A-Za-z]|[A-Za-z]'))) AS word FROM b WHERE raw IS NOT NULL)
  WHERE contains(word, '-') OR length(word) >= 4)"""


@query(f"WITH {BLOCKS}, {VOCAB} SELECT * FROM v")
def a9_vocabulary(spark, d):
    return hyphen.vocabulary(blocks(spark, d), ["book_id"], "raw")


@query(rf"""
WITH {BLOCKS}, {VOCAB},
x AS (SELECT book_id, unnest(regexp_extract_all(raw, '([A-Za-z][A-Za-z-]*?)([-\x{{2010}}\x{{2011}}\x{{00AD}}])[ \t]*\n[ \t]*([^\s]*)')) AS m FROM b WHERE raw IS NOT NULL),
q AS (SELECT book_id, regexp_extract(m, '^([A-Za-z][A-Za-z-]*?)([-\x{{2010}}\x{{2011}}\x{{00AD}}])[ \t]*\n[ \t]*([^\s]*)', ['prefix', 'sign', 'tail']) AS g FROM x),
r AS (SELECT book_id, g.prefix AS prefix, g.sign AS sign, regexp_extract(g.tail, '^[A-Za-z]*') AS suffix FROM q),
d AS (SELECT r.*, EXISTS (SELECT 1 FROM v WHERE v.book_id = r.book_id AND NOT v.is_hyph AND v.word = lower(r.prefix || r.suffix)) AS plain_hit,
  EXISTS (SELECT 1 FROM v WHERE v.book_id = r.book_id AND v.is_hyph AND v.word = lower(r.prefix || '-' || r.suffix)) AS hyph_hit FROM r)
SELECT book_id, verdict, count(*) AS n FROM (SELECT book_id, CASE WHEN sign = chr(173) THEN 'JOIN' WHEN suffix = '' OR regexp_matches(suffix, '^[A-Z]') THEN 'KEEP' WHEN plain_hit THEN 'JOIN' WHEN hyph_hit THEN 'KEEP'
  WHEN lower(prefix) IN ({", ".join(repr(x) for x in text.COMPOUND_PREFIXES)}) OR length(prefix) <= 1 THEN 'KEEP'
  WHEN length(prefix) >= 3 AND length(suffix) <= 12 AND regexp_matches(lower(suffix), '(?:{"|".join(text.COMMON_SUFFIXES)})$') THEN 'JOIN' ELSE 'UNCERTAIN' END AS verdict FROM d) GROUP BY ALL""")
def a10_hyphen_verdicts(spark, d):
    b = blocks(spark, d)
    pairs = hyphen.line_end_pairs(b, ["book_id"], "raw")
    return hyphen.decide(pairs, hyphen.vocabulary(b, ["book_id"], "raw"), ["book_id"]).groupBy("book_id", "verdict").agg(F.count("*").alias("n"))


@query(r"""
SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug, substr(sha1(regexp_replace(lower(title), '[^0-9a-z]+', '', 'g')), 1, 12) AS fingerprint FROM (
  SELECT doc_id, title, regexp_replace(substr(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS s FROM documents WHERE title IS NOT NULL)""")
def a11_slug_fingerprint(spark, d):
    t = F.col("title")
    return documents(spark, d).where("title is not null").select("doc_id", text.slugify(t).alias("slug"), text.fingerprint(t).alias("fingerprint"))


CITED = r"""cited AS (SELECT block_id, book_id, chapter_key, block_type, unnest(regexp_extract_all(clean, '\[(\d{1,4}(?:\s*[–-]\s*\d{1,4})?(?:\s*,\s*\d{1,4}(?:\s*[–-]\s*\d{1,4})?)*)\]', 1)) AS g FROM b WHERE clean IS NOT NULL),
parts AS (SELECT * EXCLUDE g, unnest(regexp_split_to_array(g, '\s*,\s*')) AS part FROM cited),
ends AS (SELECT * EXCLUDE part, CAST(regexp_extract(part, '^(\d+)', 1) AS INT) AS a, TRY_CAST(regexp_extract(part, '[–-]\s*(\d+)$', 1) AS INT) AS z FROM parts),
nums AS (SELECT DISTINCT * EXCLUDE (a, z), unnest(CASE WHEN z IS NULL THEN [a] WHEN z >= a AND z - a <= 60 THEN range(a, z + 1) ELSE [a, z] END) AS n FROM ends)"""


@query(f"WITH {BLOCKS}, {CITED} SELECT block_id, CAST(n AS INT) AS n FROM nums")
def a12_citations(spark, d):
    return blocks(spark, d).where("clean is not null").select("block_id", F.explode(numeric.citations(F.col("clean"))).alias("n"))


@query(rf"""WITH {LINES} SELECT line_id, regexp_matches(rtrim(raw), '[.!?:;)\]"''”’]$') AS ends, regexp_matches(ltrim(raw), '^[\p{{Ll}},;)\]]') AS goes_on FROM l WHERE raw IS NOT NULL""")
def a13_sentence_ends(spark, d):
    return lines(spark, d).where("raw is not null").select("line_id", text.ends_sentence(F.col("raw")).alias("ends"), text.starts_continuation(F.col("raw")).alias("goes_on"))


@query(rf"""WITH {LINES}, k AS (SELECT line_id, CASE WHEN regexp_matches(raw, '^\s*([•·▪●◦○■▫‣⁃∙])\s*(\S.*)?$') THEN 'bullet' WHEN regexp_matches(raw, '^\s*([–—-])\s+(\S.*)$') THEN 'dash'
 WHEN regexp_matches(raw, '^\s*(\(?\d{{1,3}}[.)])\s+([A-Z(\[0-9].*)$') THEN 'num' WHEN regexp_matches(raw, '^\s*(\(?[a-h][.)])\s+(\S.*)$') THEN 'alpha' END AS kind FROM l WHERE raw IS NOT NULL)
SELECT line_id, kind FROM k WHERE kind IS NOT NULL""")
def a14_list_markers(spark, d):
    return lines(spark, d).where("raw is not null").select("line_id", text.list_kind(F.col("raw")).alias("kind")).where("kind is not null")


@query(rf"""WITH {BLOCKS}, x AS (SELECT block_id, regexp_extract(clean, '(?i)^\s*(figure|fig\.?|table|box|algorithm|plate)\s+([0-9IVXA-Z][0-9.A-Za-z-]*)', ['kind', 'num']) AS g FROM b WHERE block_type = 'caption' AND clean IS NOT NULL),
y AS (SELECT block_id, lower(regexp_replace(g.kind, '\.$', '')) AS kind, g.num AS num FROM x WHERE g.kind <> '')
SELECT block_id, CASE kind WHEN 'fig' THEN 'Figure' ELSE upper(kind[1]) || kind[2:] END || ' ' || regexp_replace(num, '[.]+$', '') AS label,
  CASE kind WHEN 'table' THEN 'table-' ELSE 'figure-' END || regexp_replace(regexp_replace(lower(num), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS anchor FROM y""")
def a17_labels(spark, d):
    kind, num = F.regexp_extract("clean", text.LABEL, 1), F.regexp_extract("clean", text.LABEL, 2)
    return blocks(spark, d).where("block_type = 'caption' and clean is not null").where(kind != "").select("block_id", text.normal_label(kind, num).alias("label"), text.label_anchor(kind, num).alias("anchor"))


@query(rf"""WITH {BLOCKS}, h AS (SELECT block_id, clean, regexp_extract(clean, '(?i)^\s*(?:chapter|ch\.?)\s*(\d{{1,4}})\b[\s.:–—-]*(.*)$', ['num', 'title']) AS a, regexp_extract(clean, '^\s*(\d{{1,4}})[\s.:–—)-]+(\S.*)$', ['num', 'title']) AS z
 FROM b WHERE block_type = 'heading' AND clean IS NOT NULL)
SELECT block_id, CAST(CASE WHEN a.num <> '' THEN a.num WHEN z.num <> '' THEN z.num END AS INT) AS number, trim(CASE WHEN a.num <> '' THEN a.title WHEN z.num <> '' THEN z.title ELSE clean END) AS title FROM h""")
def a18_chapter_titles(spark, d):
    t = text.chapter_title(F.col("clean"))
    return blocks(spark, d).where("block_type = 'heading' and clean is not null").select("block_id", t["number"].alias("number"), t["title"].alias("title"))


@query(rf"""WITH {CHAPTERS}, t AS (SELECT book_id, chapter_key, title, list_filter(regexp_extract_all(lower(title), '[a-z]{{4,}}'), lambda w: w NOT IN ({", ".join(repr(w) for w in text.TITLE_STOP)})) AS ws FROM c WHERE title IS NOT NULL),
u AS (SELECT book_id, chapter_key, title, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t), f AS (SELECT book_id, chapter_key, title, w, min(i) AS i FROM u GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_key, title ORDER BY i) AS r FROM f)
SELECT book_id, chapter_key, title, string_agg(w, ',' ORDER BY i) AS tags FROM k WHERE r <= 6 GROUP BY ALL""")
def a19_chapter_tags(spark, d):
    c = chapters(spark, d).where("title is not null").select("book_id", "chapter_key", "title", F.array_join(text.tags(F.lit(""), F.col("title")), ",").alias("tags"))
    return c.where("tags <> ''").distinct()


@query("""SELECT * FROM (VALUES ('see <https://example.org/a>.', 'see https://example.org/a.'), ('(http://x.test/b)', '(http://x.test/b)'), ('none', 'none'), ('<https://kept.test>', '<https://kept.test>')) t(linked, source)""")
def a15_autolink(spark, d):
    rows = [("see https://example.org/a.",), ("(http://x.test/b)",), ("none",), ("<https://kept.test>",)]
    df = spark.createDataFrame(rows, "source string")
    return df.select("source", text.autolink(F.col("source")).alias("linked"))


@query("""SELECT a, b, s AS similar FROM (VALUES ('12.5','125',true),('12','21',true),('7','7',false),('120','12',true),('15','19',true),('100','300',true),('1,000','1000',true),('3','44',false),('5%','5',true)) t(a, b, s)""")
def a16_similar_numbers(spark, d):
    pairs = [("12.5", "125"), ("12", "21"), ("7", "7"), ("120", "12"), ("15", "19"), ("100", "300"), ("1,000", "1000"), ("3", "44"), ("5%", "5")]
    return spark.createDataFrame(pairs, "a string, b string").select("a", "b", numeric.similar(F.col("a"), F.col("b")).alias("similar"))
