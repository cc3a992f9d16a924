"""Queries of the training-data problems; ``queries()`` and ``oracle_sql()`` are merged into the driver's entry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.plans.common import COMPAT
from vellumspark.session import table


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumspark.llm.terms import mark_terms

    return mark_terms(table(spark, sf_dir, "blocks"), "block_id", "clean")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where("mark is not null").select("term", "mark")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumspark.llm.repeated import repeated_lines

    return repeated_lines(table(spark, sf_dir, "lines"), "line_id", "book_id", "page", "raw", arrived="loaded_at").select(F.col("id").alias("line_id"))


def p2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumspark.llm.repeated import pages_in_parts

    return pages_in_parts(table(spark, sf_dir, "lines"), "line_id", "book_id", "page", "seq", "raw", "loaded_at").withColumnRenamed("source", "book_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumspark.llm.scans import repair_scans

    return repair_scans(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "paras"), table(spark, sf_dir, "lines"), defects=True)


def p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumspark.llm.scans import repair_scans

    return repair_scans(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "paras"), table(spark, sf_dir, "lines"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).select("block_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumspark.llm.split import split_oversized

    return split_oversized(table(spark, sf_dir, "blocks"), "block_id", "clean", "heading_path").withColumnRenamed("id", "block_id")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumspark.llm.encoding import repair, train

    lines, blocks = table(spark, sf_dir, "lines"), table(spark, sf_dir, "blocks")
    model = train(lines.select("raw").unionByName(blocks.select("raw")), "raw")
    found = [repair(df, i, "raw", model).withColumn("rec", F.lit(rec)) for rec, df, i in (("line", lines, "line_id"), ("block", blocks, "block_id"))]
    return found[0].unionByName(found[1]).select("rec", F.col("id").alias("rec_id"), "chain", "original", "restored")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_restored(spark, sf_dir).select("rec", "rec_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumspark.llm.leakage import leaks

    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items")).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumspark.llm.leakage import remove_leaks

    return remove_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items")).withColumnRenamed("id", "doc_id")


def p8_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumspark.llm.subjects import subjects_of

    found = subjects_of(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))
    return found.withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumspark.llm.subjects import composition

    return composition(p8_subjects(spark, sf_dir).withColumnRenamed("doc_id", "id"), table(spark, sf_dir, "documents"), "doc_id", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_terms, p2_found, p2_pages, p3_found, p3_texts, p4_found, p4_pieces, p5_found, p5_restored, p6_containers, p7_found, p7_leaks, p7_cleaned, p8_found, p8_subjects, p8_composition]
    return {f.__name__: f for f in named}


# The text in NFKC, character by character, as SQL has NFC only.
P1 = rf"""{COMPAT}, bl AS (SELECT DISTINCT block_id, clean FROM blocks WHERE block_id IS NOT NULL AND clean IS NOT NULL),
ch AS (SELECT block_id, unnest(cs) AS ch, generate_subscripts(cs, 1) AS i FROM (SELECT block_id, string_split(nfc_normalize(regexp_replace(clean, '[\x{{AD}}\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g')), '') AS cs FROM bl)),
tx AS (SELECT block_id, string_agg(coalesce(to_ch, ch.ch), '' ORDER BY i) AS t FROM ch LEFT JOIN kc ON kc.ch = ch.ch GROUP BY 1),
tm AS (SELECT block_id, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) AS term FROM tx), n AS (SELECT count(DISTINCT block_id) AS total FROM blocks),
fq AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT block_id) AS n_records FROM tm GROUP BY 1),
mk AS (SELECT term, n_occurrences, n_records, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records >= 0.1 * total THEN 'common' END AS mark FROM fq, n)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_terms": f"WITH {P1} SELECT term, CAST(n_occurrences AS BIGINT) AS n_occurrences, CAST(n_records AS BIGINT) AS n_records, mark FROM mk",
        "p1_found": f"WITH {P1} SELECT term, mark FROM mk WHERE mark IS NOT NULL",
        "p4_found": r"""
            SELECT DISTINCT block_id FROM blocks
            WHERE block_id IS NOT NULL AND length(regexp_replace(regexp_replace(clean, '^[\s\x1c-\x1f\x85\p{Z}]+', ''), '[\s\x1c-\x1f\x85\p{Z}]+$', ''))
                + CASE WHEN heading_path IS NOT NULL AND len(heading_path) > 0
                       THEN length(array_to_string(list_transform(heading_path, lambda x: coalesce(x, '')), ' > ')) + 1 ELSE 0 END > 2200""",
    }
