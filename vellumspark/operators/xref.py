"""Cross-references: mentions of chapters, tables, figures and boxes, resolved against labels, now or when they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MENTION = r"\b(Chapter|Table|Figure|Fig\.|Box)\s+(\d+(?:\.\d+)*[A-Za-z]?)(?!\d)"
SKIPPED = r"(?s)<!--.*?-->|<[^>\n]+>|!\[[^\]]*\]\([^)]*\)|\[[^\]]*\]\([^)]*\)|`[^`]*`|\[\^[^\]]+\]"


def mentions(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, ref, kind, num, label, target_chapter of each mention outside comments, tags, links, code and footnotes."""
    plain = F.regexp_replace(F.col(column), SKIPPED, " \x00 ")
    found = F.regexp_extract_all(plain, F.lit(MENTION), F.lit(0))
    out = df.where(F.col(column).isNotNull()).select(*keys, F.explode(found).alias("ref"))
    word, num = F.regexp_extract("ref", MENTION, 1), F.regexp_extract("ref", MENTION, 2)
    kind = F.when(word == "Fig.", "figure").otherwise(F.lower(word))
    label = F.concat_ws(" ", F.initcap(kind), num)
    dotted = F.when(num.contains("."), F.regexp_extract(num, r"^(\d+)\.", 1).cast("int"))
    target = F.when(kind == "chapter", F.regexp_extract(num, r"^(\d+)", 1).cast("int")).otherwise(dotted)
    return out.withColumns({"kind": kind, "num": num, "label": label, "target_chapter": target})


def resolve(refs: DataFrame, chapters: DataFrame, labels: DataFrame) -> DataFrame:
    """refs with url, null if unresolved.

    refs: chapter_number beside mentions. chapters: chapter_number, file. labels: chapter_number, label, anchor,
    table_file. A chapter links to its file, but not to itself; a label links to its own file, else to the anchor, with
    the file before it if that is another. The registries are joined by equality; a label without a dot is looked up in
    the chapter it stands in.
    """
    want = F.coalesce("target_chapter", "chapter_number")
    df = refs.withColumn("_t", want)
    own = chapters.select(F.col("chapter_number").alias("_t"), F.col("file").alias("_file"))
    known = labels.select(F.col("chapter_number").alias("_t"), "label", "anchor", "table_file")
    df = df.join(own, "_t", "left").join(known, ["_t", "label"], "left")
    other = F.col("_t") != F.col("chapter_number")
    to_chapter = F.when(other & F.col("_file").isNotNull(), F.concat(F.lit("./"), F.col("_file")))
    to_label = F.when(F.col("anchor").isNotNull(), F.coalesce("table_file", F.when(other, F.concat(F.lit("./"), F.col("_file"), F.lit("#"), F.col("anchor"))), F.concat(F.lit("#"), F.col("anchor"))))
    return df.withColumn("url", F.when(F.col("kind") == "chapter", to_chapter).otherwise(to_label)).drop("_t", "_file", "anchor", "table_file")


def rewrite(text: Column, urls: Column) -> Column:
    """Text with mentions turned into links by a map from mention to url. What is skipped stays as it is: the text is cut
    into alternating parts and only the parts between are rewritten."""
    skipped = F.regexp_extract_all(text, F.lit(SKIPPED), F.lit(0))
    between = F.split(F.regexp_replace(text, SKIPPED, "\x00"), "\x00")
    one = lambda seg: F.aggregate(
        F.map_keys(urls), seg, lambda acc, ref: F.regexp_replace(acc, F.concat(F.lit(r"(?<![\[\w])"), F.regexp_replace(ref, r"([.])", r"\\$1"), F.lit(r"(?![\w.]*\d)(?!\])")), F.concat(F.lit("["), ref, F.lit("]("), F.try_element_at(urls, ref), F.lit(")")))
    )
    done = F.transform(between, one)
    return F.array_join(F.transform(done, lambda seg, i: F.concat(seg, F.coalesce(F.get(skipped, i), F.lit("")))), "")


def pending(resolved: DataFrame) -> DataFrame:
    return resolved.where("url is null").drop("url")


def resolve_pending(waiting: DataFrame, chapters: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Late binding: (now resolved, still waiting) when new chapters or labels have come. Only the waiting rows are
    joined again."""
    again = resolve(waiting, chapters, labels)
    return again.where("url is not null"), pending(again)
