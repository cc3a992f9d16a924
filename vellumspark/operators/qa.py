"""Fidelity checks. Each rule gives issues with one schema; rules are independent plans and are put together by union."""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import numeric, text
from vellumspark.model import severity_rank

CHAPTER = ["book_id", "chapter_key"]


def issue(df: DataFrame, severity: Column | str, code: Column | str, message: Column, page: Column | None = None, block: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        *CHAPTER, lit(severity).alias("severity"), lit(code).alias("code"), message.alias("message"),
        (F.lit(None) if page is None else page).cast("int").alias("page"), (F.lit(None) if block is None else block).cast("bigint").alias("block_id"),
    )


def all_issues(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def in_order(issues: DataFrame) -> DataFrame:
    return issues.orderBy(*CHAPTER, severity_rank(F.col("severity")), F.coalesce("page", F.lit(0)), "code", "block_id")


def pages_skipped(chapters: DataFrame, lines: DataFrame) -> DataFrame:
    """Pages of a chapter's range without any line."""
    want = chapters.where("page_from is not null and page_to >= page_from").select(*CHAPTER, F.explode(F.sequence("page_from", "page_to")).alias("page")).distinct()
    have = lines.select(*CHAPTER, "page").distinct()
    return issue(want.join(have, [*CHAPTER, "page"], "left_anti"), "CRITICAL", "PAGE_SKIPPED", F.lit("page was not processed"), F.col("page"))


def pages_not_in_output(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages with text on lines that no block names."""
    have = lines.where("trim(raw) <> ''").select(*CHAPTER, "page").distinct()
    out = blocks.select(*CHAPTER, F.explode("pages").alias("page")).distinct()
    return issue(have.join(out, [*CHAPTER, "page"], "left_anti"), "CRITICAL", "PAGE_NOT_IN_MARKDOWN", F.lit("page has text but no block"), F.col("page"))


def page_chars(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*CHAPTER, "page").agg(F.sum(F.length(F.trim(F.coalesce("raw", F.lit(""))))).alias("chars"))


def short_pages(lines: DataFrame, share: float = 0.2, least_pages: int = 4) -> DataFrame:
    """Pages with text, but less than a share of the chapter's median; first and last pages are exempt."""
    w = Window.partitionBy(*CHAPTER)
    df = page_chars(lines).withColumn("median", F.median("chars").over(w)).withColumn("n", F.count("*").over(w)).withColumn("a", F.min("page").over(w)).withColumn("b", F.max("page").over(w))
    hit = df.where((F.col("n") >= least_pages) & (F.col("chars") > 0) & (F.col("chars") < F.col("median") * share) & (F.col("page") > F.col("a")) & (F.col("page") < F.col("b")))
    return issue(hit, "MEDIUM", "PAGE_TEXT_SHORT", F.concat(F.col("chars").cast("string"), F.lit(" characters")), F.col("page"))


def blank_pages(lines: DataFrame) -> DataFrame:
    return issue(page_chars(lines).where("chars = 0"), "LOW", "PAGE_BLANK", F.lit("no text on page"), F.col("page"))


def char_counts(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, ch, n: multiset of letters and digits, NFKC, in lower case. Each Arrow batch is counted to a map per key before
    anything is shuffled, so an alphabet, not the text, leaves a task."""
    schema = df.select(*keys).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held: dict[tuple, Counter] = defaultdict(Counter)
            for *key, value in b.itertuples(index=False, name=None):
                held[tuple(key)].update(unicodedata.normalize("NFKC", value).lower())
            rows = [(*key, ch, n) for key, c in held.items() for ch, n in c.items() if ch.isalpha() or ch.isnumeric()]
            yield pd.DataFrame(rows, columns=[*keys, "ch", "n"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return df.where(F.col(column).isNotNull()).select(*keys, column).mapInPandas(run, f"{fields}, ch string, n bigint").groupBy(*keys, "ch").agg(F.sum("n").alias("n"))


def char_loss(df: DataFrame, keys: list[str], source: str, output: str) -> DataFrame:
    """keys, n_source, n_lost, loss_ratio (5 digits): characters of the source that the output lacks."""
    return lost_chars(char_counts(df, keys, source), char_counts(df, keys, output), keys)


def lost_chars(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    both = a.join(b.withColumnRenamed("n", "m"), [*keys, "ch"], "left").withColumn("lost", F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0)))
    out = both.groupBy(*keys).agg(F.sum("n").alias("n_source"), F.sum("lost").alias("n_lost"))
    return out.withColumn("loss_ratio", F.round(F.col("n_lost") / F.col("n_source"), 5))


def text_loss(df: DataFrame, source: str, output: str) -> DataFrame:
    return loss_issues(char_loss(df, CHAPTER, source, output))


def loss_issues(loss: DataFrame) -> DataFrame:
    severe = F.col("loss_ratio") > 0.01
    return issue(loss.where("loss_ratio > 0.003"), F.when(severe, "HIGH").otherwise("MEDIUM"), F.when(severe, "TEXT_LOSS").otherwise("TEXT_LOSS_MINOR"), F.col("loss_ratio").cast("string"))


def page_flags(pages: DataFrame) -> DataFrame:
    """Issues out of the flags of pages (book_id, chapter_key, page, flags): failed recognition, encoding artefacts."""
    each = pages.select(*CHAPTER, "page", F.explode("flags").alias("flag"))
    failed = each.where(F.startswith("flag", F.lit("ocr_failed")))
    return all_issues([
        issue(failed, "HIGH", "OCR_FAILED", F.trim(F.regexp_replace("flag", "^ocr_failed:?", "")), F.col("page")),
        issue(each.where("flag = 'encoding_artifact'"), "MEDIUM", "ENCODING_ARTIFACT", F.lit("private-use or replacement characters"), F.col("page")),
    ])


def encoding_pages(lines: DataFrame) -> DataFrame:
    """book_id, chapter_key, page, flags of pages that hold private-use or replacement characters."""
    hit = lines.where(F.col("raw").rlike(text.ENCODING_ARTEFACT)).select(*CHAPTER, "page").distinct()
    return hit.withColumn("flags", F.array(F.lit("encoding_artifact")))


def helper_errors(errors: DataFrame, most: int = 3) -> DataFrame:
    """AI_UNAVAILABLE for up to ``most`` distinct errors (book_id, chapter_key, error) of a helper that could not be asked."""
    n = F.row_number().over(Window.partitionBy(*CHAPTER).orderBy("error"))
    return issue(errors.select(*CHAPTER, "error").distinct().withColumn("_n", n).where(F.col("_n") <= most), "LOW", "AI_UNAVAILABLE", F.col("error"))


def heading_issues(blocks: DataFrame) -> DataFrame:
    """No headings, not one H1, level jumps, empty sections."""
    w = Window.partitionBy(*CHAPTER).orderBy("seq", "block_id")
    per = blocks.groupBy(*CHAPTER).agg(F.count_if(F.col("block_type") == "heading").alias("n"), F.count_if((F.col("block_type") == "heading") & (F.col("h_level") == 1)).alias("n1"))
    none = issue(per.where("n = 0"), "MEDIUM", "NO_HEADINGS", F.lit("no headings"))
    h1 = issue(per.where("n > 0 and n1 <> 1"), "MEDIUM", "H1_COUNT", F.concat(F.col("n1").cast("string"), F.lit(" first-level headings")))
    heads = blocks.where("block_type = 'heading'").withColumn("before", F.lag("h_level").over(w))
    jump = issue(heads.where("h_level > before + 1"), "MEDIUM", "HEADING_JUMP", F.concat_ws(" to ", F.col("before").cast("string"), F.col("h_level").cast("string")), F.try_element_at("pages", F.lit(1)), F.col("block_id"))
    after = blocks.withColumn("next_type", F.lead("block_type").over(w)).withColumn("next_level", F.lead("h_level").over(w))
    empty = after.where("block_type = 'heading' and next_type = 'heading' and next_level <= h_level and h_level > 1")
    return all_issues([none, h1, jump, issue(empty, "LOW", "EMPTY_SECTION", F.coalesce("clean", F.lit("")), F.try_element_at("pages", F.lit(1)), F.col("block_id"))])


def citation_issues(blocks: DataFrame) -> DataFrame:
    """Cited numbers without a reference list, not in the list, and gaps in the list."""
    cited = blocks.where("block_type <> 'reference'").select(*CHAPTER, F.explode(numeric.citations(F.col("clean"))).alias("n")).distinct()
    listed = blocks.where(F.col("block_type") == "reference").select(*CHAPTER, F.explode(reference_numbers(F.coalesce("raw", "clean"))).alias("n")).distinct()
    per = listed.groupBy(*CHAPTER).agg(F.array_sort(F.collect_set("n")).alias("have"), F.max("n").alias("top"))
    none = cited.groupBy(*CHAPTER).agg(F.count("*").alias("k")).join(per, CHAPTER, "left_anti")
    missing = cited.join(per.select(*CHAPTER), CHAPTER, "left_semi").join(listed, [*CHAPTER, "n"], "left_anti").groupBy(*CHAPTER).agg(F.array_sort(F.collect_set("n")).alias("ns"))
    gaps = per.withColumn("gap", F.array_except(F.sequence(F.array_min("have"), F.col("top")), "have")).where(F.size("gap") > 0)
    names = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",")
    return all_issues([
        issue(none, "MEDIUM", "CITATIONS_NO_REFERENCES", F.concat(F.col("k").cast("string"), F.lit(" cited numbers"))),
        issue(missing, "MEDIUM", "CITATION_NOT_IN_LIST", names("ns")),
        issue(gaps, "LOW", "REFERENCE_GAPS", names("gap")),
    ])


def reference_numbers(c: Column) -> Column:
    """Numbers that begin the lines of a reference block."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^[ \t]*\[?(\d{1,3})[\].)]"), F.lit(1)), lambda x: x.cast("int"))


def figure_mentions(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Figures of the chapter's own number that are mentioned but have no caption."""
    own = chapters.where("chapter_no is not null").select(*CHAPTER, "chapter_no").distinct()
    found = F.regexp_extract_all(F.col("clean"), F.lit(r"\b(?:Figure|Fig\.) (\d+\.\d+)"), F.lit(1))
    mentioned = blocks.where("block_type in ('paragraph', 'list', 'callout')").select(*CHAPTER, F.explode(found).alias("n")).distinct()
    mine = mentioned.join(own, CHAPTER).where(F.regexp_extract("n", r"^(\d+)\.", 1).cast("int") == F.col("chapter_no"))
    have = blocks.where("block_type in ('caption', 'figure')").select(*CHAPTER, F.regexp_extract("clean", r"(?i)^\s*(?:figure|fig\.?)\s+(\d+\.\d+)", 1).alias("n")).distinct()
    return issue(mine.join(have, [*CHAPTER, "n"], "left_anti"), "MEDIUM", "FIGURE_MENTION_MISSING", F.concat(F.lit("Figure "), F.col("n")))


def mark_issues(blocks: DataFrame) -> DataFrame:
    """Joined letters, encoding artefacts, spaced letters, hyphen before a blank, doubled words."""
    page, block = F.try_element_at("pages", F.lit(1)), F.col("block_id")
    rules = [
        ("MEDIUM", "LIGATURE_LEFT", F.col("clean").rlike("[ﬀ-ﬆ]")),
        ("MEDIUM", "ENCODING_IN_MD", F.col("clean").rlike(text.ENCODING_ARTEFACT)),
        ("LOW", "SPACED_LETTERS", F.col("clean").rlike(text.SPACED_LETTERS)),
        ("LOW", "HYPHEN_SPACE", F.col("clean").rlike(text.HYPHEN_BLANK)),
    ]
    # One scan: every block gives an array of the rules it breaks.
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(s).alias("s"), F.lit(k).alias("k"))) for s, k, c in rules]), lambda x: x.isNotNull())
    rows = blocks.where("clean is not null").withColumn("hit", F.explode(hits))
    return issue(rows, F.col("hit.s"), F.col("hit.k"), F.lit(""), page, block)


def doubled_words(df: DataFrame, keys: list[str], column: str, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """keys, word, at (position): a word said twice in a row, but for had, that, is, do. ``most`` keeps the first of each
    chapter, as the report does."""
    toks = F.split(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")), " ")
    # Neighbours come from a shifted copy of the array: a lambda that reads the array again would cut the text anew for
    # every word.
    both = F.zip_with(toks, F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("word"), y.alias("next")))
    pairs = F.filter(
        F.transform(both, lambda p, i: F.struct(p["word"].alias("word"), i.alias("at"), p["next"].alias("next"))),
        lambda p: (p["word"] == p["next"]) & p["word"].rlike("^[A-Za-z]{2,}$") & ~F.lower(p["word"]).isin(text.DOUBLED_EXEMPT),
    )
    out = df.where(F.col(column).isNotNull()).select(*keys, *(order or []), F.explode(pairs).alias("p")).select(*keys, *(order or []), F.col("p.word").alias("word"), F.col("p.at").alias("at"))
    if most is not None:
        n = F.row_number().over(Window.partitionBy(*CHAPTER).orderBy(*(order or []), "at"))
        out = out.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")
    return out


def number_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference of two token tables with the same columns, both ways: columns, side. Counts are compared, so a
    token that comes a million times on both sides is one row in the shuffle of each task."""
    cols = a.columns
    n = a.withColumn("_d", F.lit(1)).unionByName(b.select(*cols, F.lit(-1).alias("_d"))).groupBy(*cols).agg(F.sum("_d").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "missing").otherwise("unexpected").alias("side")
    return n.select(*cols, side, F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int"))).alias("_i")).drop("_i")


def number_issues(source: DataFrame, output: DataFrame) -> DataFrame:
    """severity, code, source, output, page of the changed, missing and unexpected numbers of each chapter, from (book_id,
    chapter_key, token, page, ctx) and (book_id, chapter_key, token, page).

    Equal tokens cancel out before anything is grouped, by counts; only the differences of a chapter, in order of token, are
    paired: each missing number takes the first unexpected one that may be its misprint and is still free.
    """
    n_a = source.groupBy(*CHAPTER, "token").agg(F.count("*").alias("a"), F.min(F.struct("page", "ctx")).alias("first"))
    n_b = output.groupBy(*CHAPTER, "token").agg(F.count("*").alias("b"), F.min("page").alias("page_b"))
    diff = n_a.join(n_b, [*CHAPTER, "token"], "full").withColumn("d", F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).where("d <> 0")
    row = F.struct("token", F.coalesce("first.page", "page_b").cast("int").alias("page"), F.coalesce(numeric.clinical(F.col("token"), F.col("first.ctx")), F.lit(False)).alias("clinical"), F.abs("d").cast("int").alias("times"))
    both = diff.groupBy(*CHAPTER).agg(F.array_sort(F.collect_list(F.when(F.col("d") > 0, row))).alias("gone"), F.array_sort(F.collect_list(F.when(F.col("d") < 0, row))).alias("extra"))
    each = lambda c: F.flatten(F.transform(F.col(c), lambda x: F.array_repeat(x, x["times"])))
    item = "struct<token:string,page:int,clinical:boolean,times:int>"
    empty = F.struct(each("extra").cast(f"array<{item}>").alias("left"), F.array().cast("array<struct<severity:string,code:string,source:string,output:string,page:int>>").alias("out"))

    def step(acc: Column, g: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(acc["left"], lambda u: numeric.similar(g["token"], u["token"])), True), F.lit(0)).cast("int")
        hit = at > 0
        left = F.when(hit, F.concat(F.slice(acc["left"], F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(acc["left"], at + 1, F.greatest(F.size(acc["left"]) - at, F.lit(0))))).otherwise(acc["left"])
        severity = F.when(hit, F.when(g["clinical"], "CRITICAL").otherwise("HIGH")).otherwise(F.when(g["clinical"], "HIGH").otherwise("MEDIUM"))
        found = F.struct(severity.alias("severity"), F.when(hit, "CHANGED_NUMBER").otherwise("MISSING_NUMBER").alias("code"), g["token"].alias("source"), F.when(hit, F.get(acc["left"], at - 1)["token"]).alias("output"), g["page"].alias("page"))
        return F.struct(left.alias("left"), F.concat(acc["out"], F.array(found)).alias("out"))

    folded = both.select(*CHAPTER, F.aggregate(each("gone"), empty, step).alias("f"))
    rest = F.transform("f.left", lambda u: F.struct(F.lit("MEDIUM").alias("severity"), F.lit("UNEXPECTED_NUMBER").alias("code"), F.lit(None).cast("string").alias("source"), u["token"].alias("output"), u["page"].alias("page")))
    return folded.select(*CHAPTER, F.explode(F.concat("f.out", rest)).alias("i")).select(*CHAPTER, "i.*")


def status_of(issues: DataFrame, chapters: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Status of each chapter: failed, review required (critical or high), with warnings, completed; and its counts."""
    counts = issues.groupBy(*CHAPTER).agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])
    df = chapters.select(*CHAPTER).distinct().join(counts, CHAPTER, "left").fillna(0)
    if failed is not None:
        df = df.join(failed.select(*CHAPTER, F.lit(True).alias("bad")).distinct(), CHAPTER, "left")
    else:
        df = df.withColumn("bad", F.lit(None).cast("boolean"))
    status = F.when(F.col("bad"), "FAILED").when(F.col("n_critical") + F.col("n_high") > 0, "REVIEW_REQUIRED").when(F.col("n_medium") + F.col("n_low") > 0, "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED")
    return df.withColumn("status", status).drop("bad")


def link_check(documents: DataFrame, id_col: str, column: str, files: DataFrame, path_col: str) -> DataFrame:
    """id, target of relative links whose file is missing; a fragment is no part of the path."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
    links = documents.select(F.col(id_col), F.explode(F.array_distinct(found)).alias("target")).where(~F.col("target").rlike("^(?:[a-z]+:|#|//)"))
    links = links.withColumn("path", F.regexp_replace(F.regexp_replace("target", "#.*$", ""), r"^(?:\./)+", ""))
    return links.where("path <> ''").join(files.select(F.col(path_col).alias("path")), "path", "left_anti").select(id_col, "target")


