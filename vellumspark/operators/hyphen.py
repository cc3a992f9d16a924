"""Vocabulary of a book and the decision whether a word cut at a line end is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions import text

LINE_END = r"([A-Za-z][A-Za-z-]*?)([-\u2010\u2011\u00ad])[ \t]*\n[ \t]*([^\s]*)"


def vocabulary(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, word, is_hyph: words of four letters or more, and words with a hyphen. Fragments at line ends are cut off
    before, so that they prove nothing. Distinct words leave each row, then each task, before the shuffle."""
    whole = F.regexp_replace(F.col(column), r"[A-Za-z-]*[-\u2010\u2011\u00ad][ \t]*\n[ \t]*\S*", " ")
    found = df.where(F.col(column).isNotNull()).select(*keys, F.explode(F.array_distinct(text.words(whole))).alias("word"))
    found = found.withColumn("is_hyph", F.col("word").contains("-"))
    return found.where(F.col("is_hyph") | (F.length("word") >= 4)).distinct()


def merge_vocabulary(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()


def line_end_pairs(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, prefix, sign, suffix of every word cut at a line end."""
    pairs = F.regexp_extract_all(F.col(column), F.lit(LINE_END), F.lit(0))
    cut = F.transform(
        pairs,
        lambda p: F.struct(F.regexp_extract(p, LINE_END, 1).alias("prefix"), F.regexp_extract(p, LINE_END, 2).alias("sign"), F.regexp_extract(F.regexp_extract(p, LINE_END, 3), r"^[A-Za-z]*", 0).alias("suffix")),
    )
    return df.where(F.col(column).isNotNull()).select(*keys, F.explode(cut).alias("p")).select(*keys, "p.*")


def suffix_ends(suffix: Column) -> Column:
    low = F.lower(suffix)
    return (F.length(suffix) <= 12) & low.rlike("(?:" + "|".join(text.COMMON_SUFFIXES) + ")$")


def decide(pairs: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with verdict: JOIN, KEEP or UNCERTAIN.

    Proof by the book's own words comes first, then prefixes that stay apart, then common endings. The vocabulary is
    probed once for the joined and once for the hyphenated form, both by an equality join.
    """
    df = pairs.withColumn("joined", F.lower(F.concat("prefix", "suffix"))).withColumn("hyphenated", F.lower(F.concat_ws("-", "prefix", "suffix")))
    plain = vocab.where(~F.col("is_hyph")).select(*keys, F.col("word").alias("joined"), F.lit(True).alias("plain_hit"))
    hyph = vocab.where(F.col("is_hyph")).select(*keys, F.col("word").alias("hyphenated"), F.lit(True).alias("hyph_hit"))
    df = df.join(plain, [*keys, "joined"], "left").join(hyph, [*keys, "hyphenated"], "left")
    low = F.lower("prefix")
    verdict = (
        F.when(F.col("sign") == "\u00ad", "JOIN")
        .when((F.col("suffix") == "") | F.col("suffix").rlike("^[A-Z]"), "KEEP")
        .when(F.col("plain_hit"), "JOIN")
        .when(F.col("hyph_hit"), "KEEP")
        .when(low.isin(text.COMPOUND_PREFIXES) | (F.length("prefix") <= 1), "KEEP")
        .when((F.length("prefix") >= 3) & suffix_ends(F.col("suffix")), "JOIN")
        .otherwise("UNCERTAIN")
    )
    return df.withColumn("verdict", verdict).drop("plain_hit", "hyph_hit", "joined", "hyphenated")


BREAK = r"(?<=\S[-\u2010\u2011\u00ad])[ \t]*\n[ \t]*(?=\S)"


def inner_words(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Vocabulary of lines: what a hyphen at the end cuts off proves nothing."""
    return vocabulary(df.withColumn("_whole", F.regexp_replace(F.rtrim(F.col(column)), r"\S*[-\u2010\u2011\u00ad]$", "")), keys, "_whole")


def join_lines(df: DataFrame, row: list[str], column: str, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``joined``, the lines of ``column`` as one line, and ``uncertain``, the cut words that were left as they
    are for want of proof. ``row`` names each row, ``keys`` the book whose vocabulary decides.

    At a hyphen the verdict decides whether it stays, and no blank is put in; soft hyphens vanish; after a dash or slash no
    blank is put in either. Only cut words, not texts, are joined with the vocabulary.
    """
    pieces = F.split(F.col(column), BREAK)
    bounds = F.transform(
        F.sequence(F.lit(1), F.size("_pieces") - 1),
        lambda i: F.struct(
            i.alias("i"), F.regexp_extract(F.element_at("_pieces", i), r"(?:^|[^A-Za-z\u2010\u2011\u00ad-])([A-Za-z]+)[-\u2010\u2011\u00ad]$", 1).alias("prefix"), F.right(F.element_at("_pieces", i), F.lit(1)).alias("sign"),
            F.regexp_extract(F.element_at("_pieces", i + 1), r"^[A-Za-z]+", 0).alias("suffix"),
        ),
    )
    named = list(dict.fromkeys([*row, *keys]))
    cut = df.select(*named, pieces.alias("_pieces")).where(F.size("_pieces") > 1).select(*named, F.explode(bounds).alias("b")).select(*named, "b.*")
    cut = cut.withColumn("suffix", F.when((F.col("prefix") == "") & (F.col("sign") != "\u00ad"), "").otherwise(F.col("suffix")))
    verdicts = decide(cut, vocab, keys).groupBy(*row).agg(
        F.map_from_entries(F.collect_list(F.struct("i", "verdict"))).alias("_verdicts"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("verdict") == "UNCERTAIN"), F.struct("i", F.concat_ws("-", "prefix", "suffix").alias("w"))))), lambda x: x["w"]).alias("uncertain"),
    )
    out = df.withColumn("_pieces", pieces).join(verdicts, row, "left")
    last = F.size("_pieces")
    whole = F.array_join(F.transform("_pieces", lambda x, i: F.when((i + 1 < last) & (F.try_element_at("_verdicts", i + 1) == "JOIN"), F.left(x, F.length(x) - 1)).otherwise(x)), "")
    return out.withColumn("joined", flat(whole)).withColumn("uncertain", F.coalesce("uncertain", F.array().cast("array<string>"))).drop("_pieces", "_verdicts")


def flat(c: Column) -> Column:
    """Lines without cut words as one line: no blank is put in after a dash or slash that a word stands before."""
    c = F.regexp_replace(c, r"(?<=\S[\u2013\u2014/])[ \t]*\n[ \t]*(?=\S)", "")
    return F.trim(F.regexp_replace(c, r"[ \t]*\n[ \t\n]*", " "))
