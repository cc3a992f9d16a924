"""Retrieval chunks: blocks of a section packed up to a budget, other blocks alone, references merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.numeric import citation_ends
from vellumspark.functions.text import strip_markdown
from vellumspark.model import CHUNK_CHARS

PACKED = ["paragraph", "heading", "list", "formula", "footnote"]


def chunk_type(block_type: Column) -> Column:
    return (
        F.when(block_type == "table", "table").when(block_type == "reference", "reference").when(block_type.isin("figure", "unreadable", "caption"), "figure_caption").when(block_type == "callout", "callout").otherwise("text")
    )


def section_runs(sections: DataFrame, keys: list[str], max_chars: int = CHUNK_CHARS) -> DataFrame:
    """keys, seq, block_id, ctype, chunk_no: greedy packing is a fold, done over the sorted array of a section.

    The array holds only what the fold needs (order, id, type, length), never the texts. A section is bounded by its
    chapter; a text block that does not fit into the open chunk starts another, and an oversized block is a chunk of its
    own size. References go on in one chunk while less than the budget is in it.
    """
    item = F.struct("seq", "block_id", F.col("ctype"), F.col("len"))
    empty = F.struct(F.lit(0).alias("no"), F.lit(0).alias("size"), F.lit("").alias("open"), F.array().cast("array<struct<block_id:bigint,no:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        packs = (x["ctype"] == "text") & (s["open"] == "text") & (s["size"] + x["len"] <= max_chars)
        refs = (x["ctype"] == "reference") & (s["open"] == "reference") & (s["size"] < max_chars)
        same = packs | refs
        no = F.when(same, s["no"]).otherwise(s["no"] + 1)
        size = F.when(same, s["size"]).otherwise(0) + x["len"]
        return F.struct(no.alias("no"), size.alias("size"), x["ctype"].alias("open"), F.concat(s["out"], F.array(F.struct(x["block_id"].alias("block_id"), no.alias("no")))).alias("out"))

    grouped = sections.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    folded = grouped.select(*keys, F.explode(F.aggregate("items", empty, step)["out"]).alias("o"))
    return folded.select(*keys, F.col("o.block_id").alias("block_id"), F.col("o.no").alias("chunk_no"))


def chunks(blocks: DataFrame, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per chunk: id ``section#n``, type, text, pages, cited numbers, block ids, heading path of its first block.

    Blocks without Markdown add nothing; nulls in pages and paths stay null.
    """
    keys = ["book_id", "chapter_key", "section_id"]
    text = F.trim(F.regexp_replace("md", r"<!-- source_page: \d+ -->", ""))
    rows = blocks.where(F.col("md").isNotNull() & (F.trim("md") != "")).withColumn("ctype", chunk_type(F.col("block_type")))
    rows = rows.withColumn("len", F.length("md")).withColumn("chunk_text", text)
    runs = section_runs(rows.select(*keys, "seq", "block_id", "ctype", "len"), keys, max_chars)
    placed = rows.join(runs.drop("section_id"), ["book_id", "chapter_key", "block_id"])  # a section may be null, a block not
    part = F.array_sort(F.collect_list(F.struct("seq", "block_id", "chunk_text")))
    out = placed.groupBy(*keys, "chunk_no").agg(
        F.min("ctype").alias("content_type"), part.alias("p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("source_pages"), F.min_by("heading_path", "seq").alias("heading_path")
    )
    out = out.withColumn("text", F.array_join(F.transform("p", lambda x: x["chunk_text"]), "\n\n"))
    return out.select(
        *keys, "chunk_no", F.concat_ws("#", F.coalesce("section_id", F.lit("start")), F.col("chunk_no").cast("string")).alias("chunk_id"), "content_type", "text", "source_pages", "heading_path",
        F.transform("p", lambda x: x["block_id"]).alias("block_ids"), citation_ends(strip_markdown(F.col("text"))).alias("references"),
    )


def unique_ids(chunked: DataFrame) -> DataFrame:
    """chunk ids that occur more than once; none is expected."""
    n = F.count("*").over(Window.partitionBy("book_id", "chapter_key", "chunk_id"))
    return chunked.withColumn("n", n).where("n > 1").select("book_id", "chapter_key", "chunk_id")
