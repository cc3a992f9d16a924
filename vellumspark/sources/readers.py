"""Sources: page records, OCR words, plain text, book definitions. All give the tables of ``vellumspark.model``."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_RECORD = (
    "book_id string, chapter_key string, page int, w double, h double, scanned boolean, native_chars int, flags array<string>, "
    "items array<struct<t:string,bbox:array<double>,raw:string,size:double,bold:boolean,italic:boolean,zone:string,box:int,conf:double>>, _parser string, _ocr boolean"
)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON page records with the schema given; records that do not parse come out as nulls and are dropped, fields that
    are missing are null."""
    return spark.read.schema(PAGE_RECORD).option("mode", "PERMISSIVE").json(path).where("page is not null")


def record_lines(records: DataFrame) -> DataFrame:
    """Line items of page records as lines, in the order of the record."""
    df = records.select("book_id", "chapter_key", "page", F.posexplode("items").alias("seq", "i")).where("i.t = 'line'")
    box = lambda k: F.get("i.bbox", F.lit(k))
    return df.select(
        F.xxhash64("book_id", "page", "seq").alias("line_id"), "book_id", "chapter_key", "page", (F.col("seq") + 1).alias("seq"), box(0).alias("x0"), box(1).alias("y0"), box(2).alias("x1"), box(3).alias("y1"),
        "i.size", "i.bold", "i.italic", "i.raw", "i.zone", "i.box", "i.conf",
    )


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of tab-separated OCR output: level 5 rows, no quoting, confidence as a share, not below 0."""
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
    df = spark.read.schema(schema).options(sep="\t", header=True, quote="").csv(path)
    return df.where("level = 5 and trim(text) <> ''").withColumn("conf", F.greatest(F.col("conf") / 100, F.lit(0.0)))


def ocr_lines(words: DataFrame, scale: float = 1.0) -> DataFrame:
    """Lines of OCR words: hull, mean and least confidence, size 0.85 of the height, words in order."""
    keys = ["page_num", "block_num", "par_num", "line_num"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "text"))), lambda x: x["text"]), " ")
    df = words.groupBy(*keys).agg(
        F.min(F.col("left") / scale).alias("x0"), F.min(F.col("top") / scale).alias("y0"), F.max((F.col("left") + F.col("width")) / scale).alias("x1"), F.max((F.col("top") + F.col("height")) / scale).alias("y1"),
        text.alias("raw"), F.round(F.avg("conf"), 3).alias("conf"), F.min("conf").alias("min_conf"),
    )
    order = F.row_number().over(Window.partitionBy("page_num").orderBy("y0", "x0"))
    return df.withColumn("size", F.round((F.col("y1") - F.col("y0")) * 0.85, 2)).withColumn("seq", order)


def text_lines(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of plain texts: id, seq (from 1), raw; a null text has none."""
    return documents.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw")).select(id_col, (F.col("pos") + 1).alias("seq"), "raw")


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, seq, block_type, clean of headings, paragraphs, list items and cells. Scripts, styles, comments and navigation
    go first, tags that are left open end at the next block tag."""
    c = F.col(html_col)
    for pattern in (r"(?is)<!--.*?-->", r"(?is)<(script|style|nav|footer|head)\b.*?</\1\s*>"):
        c = F.regexp_replace(c, pattern, " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    marked = F.regexp_replace(c, r"(?i)<(h[1-6]|p|li|td|th)\b[^>]*>", "\x01$1\x02")
    parts = F.filter(F.split(marked, "\x01"), lambda x: x.contains("\x02"))
    df = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col), F.posexplode(parts).alias("seq", "part"))
    tag, body = F.lower(F.substring_index("part", "\x02", 1)), F.regexp_replace(F.substring_index("part", "\x02", -1), "<[^>]*>", " ")
    kind = F.when(tag.rlike("^h[1-6]"), "heading").when(tag == "li", "list").when(tag.isin("td", "th"), "table").otherwise("paragraph")
    level = F.when(tag.rlike("^h[1-6]"), F.substring(tag, 2, 1).cast("int"))
    out = df.select(id_col, "seq", kind.alias("block_type"), level.alias("h_level"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("clean"))
    return out.where("clean <> ''")


def book_definition(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Book and chapters out of a YAML definition, a small file read on the driver; a missing file gives empty tables."""
    book_schema, chapter_schema = "book_id string, title string, edition string, n_pages int", "book_id string, chapter_key string, chapter_no int, title string, page_from int, page_to int"
    file = Path(path)
    if not file.exists():
        return spark.createDataFrame([], book_schema), spark.createDataFrame([], chapter_schema)
    import yaml

    data = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
    book = data.get("book", data)
    chapters = [(book.get("book_id"), c.get("key"), c.get("number"), c.get("title"), c.get("start"), c.get("end")) for c in data.get("chapters", [])]
    return spark.createDataFrame([(book.get("book_id"), book.get("title"), str(book.get("edition") or ""), book.get("n_pages"))], book_schema), spark.createDataFrame(chapters, chapter_schema)


def json_or_default(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows, or an empty table of the schema where there is no file."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def files_below(spark: SparkSession, path: str, excluded: str = r"/(\.[^/]+|__pycache__|\.tmp_[^/]*)(/|$)") -> DataFrame:
    """path, length of all files below a folder but hidden and temporary ones; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return df.where(~F.col("path").rlike(excluded))


def page_numbers(lines: DataFrame) -> DataFrame:
    """book_id, page, seq, n, token, context (the characters behind it) of the numbers on lines in reading order."""
    from vellumspark.functions.numeric import tokens_in_context

    df = lines.where("raw is not null").select("book_id", "page", "seq", F.posexplode(tokens_in_context(F.col("raw"))).alias("n", "m"))
    return df.select("book_id", "page", "seq", "n", F.col("m.token").alias("token"), F.col("m.ctx").alias("context"))


PAGE_OBJECT = "/Type /Page"


def checked_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, problem of page-description files: ``missing`` where there is none, ``corrupt`` without the head of such a
    file, ``encrypted``, ``no pages``; null where there is none. Contents are looked at in the scan and go no further. The reader
    passes over files of no length."""
    from pyspark.errors import AnalysisException

    schema = "path string, length bigint, problem string"
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException:
        return spark.createDataFrame([(path, None, "missing")], schema)
    has = lambda part: F.locate(part, F.decode("content", "ISO-8859-1")) > 0
    problem = (
        F.when(F.decode(F.substring("content", 1, 5), "ISO-8859-1") != "%PDF-", "corrupt").when(has("/Encrypt"), "encrypted").when(~has(PAGE_OBJECT) & ~has(PAGE_OBJECT.replace(" ", "")), "no pages")
    )
    return files.select("path", "length", problem.alias("problem"))


def log_tail(spark: SparkSession, path: str, schema: str, time_col: str, most: int = 200) -> DataFrame:
    """The latest ``most`` rows of a JSON-lines log, newest first: the tail is what is asked for."""
    return json_or_default(spark, path, schema).orderBy(F.desc(time_col)).limit(most)


def recent_first(projects: DataFrame, opened: str = "last_opened") -> DataFrame:
    """Projects by the time they were opened last; those never opened come last."""
    return projects.orderBy(F.desc_nulls_last(opened), *[c for c in projects.columns if c != opened])
