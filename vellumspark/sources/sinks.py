"""Sinks: chapter Markdown, source map, chunks, indexes, manifest, archives. Tables go through Spark's committers; single
small files are written on the driver, to a temporary name first and then renamed."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_text(path: str | Path, text: str) -> None:
    """One text file, whole or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=".tmp_")
    with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
    os.replace(name, target)


def write_json(path: str | Path, data: object) -> None:
    write_text(path, json.dumps(data, ensure_ascii=False, indent=1) + "\n")


def write_chapters(markdown: DataFrame, path: str) -> None:
    """Markdown of each chapter as text below book_id=…/chapter_key=…; only the chapters at hand are replaced."""
    rows = markdown.select("book_id", "chapter_key", F.col("markdown").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id", "chapter_key").text(path)


def write_by_chapter(df: DataFrame, path: str) -> None:
    """A Parquet table of which only the chapters at hand are replaced: source maps, blocks, labels, issues, units."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id", "chapter_key").parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines of retrieval chunks."""
    chunks.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def report(issues: DataFrame, most_per_code: int = 60) -> DataFrame:
    """book_id, chapter_key, report: Markdown list of issues by severity. The cap is that of the report."""
    from pyspark.sql import Window

    from vellumspark.model import severity_rank

    n = F.row_number().over(Window.partitionBy("book_id", "chapter_key", "code").orderBy(F.coalesce("page", F.lit(0)), "message", F.coalesce("block_id", F.lit(0))))
    kept = issues.withColumn("n", n).where(F.col("n") <= most_per_code).withColumn("rank", severity_rank(F.col("severity")))
    line = F.concat(F.lit("- **"), F.col("severity"), F.lit("** `"), F.col("code"), F.lit("` "), F.coalesce("message", F.lit("")), F.coalesce(F.concat(F.lit(" (p. "), F.col("page").cast("string"), F.lit(")")), F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("rank", "code", "n", line.alias("line"))))
    return kept.groupBy("book_id", "chapter_key").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("report"))


def manifest(chapters: DataFrame, states: DataFrame, markdown: DataFrame) -> DataFrame:
    """One row per book: JSON of its chapters with status and whether Markdown is there."""
    from vellumspark.operators.chapters import latest_state

    df = chapters.join(latest_state(states), ["book_id", "chapter_key"], "left").join(markdown.select("book_id", "chapter_key", F.lit(True).alias("md")), ["book_id", "chapter_key"], "left")
    entry = F.struct("chapter_key", "chapter_no", "title", "page_from", "page_to", "status", F.coalesce("md", F.lit(False)).alias("markdown"))
    return df.groupBy("book_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("manifest"))


def book_index(chapters: DataFrame, states: DataFrame) -> DataFrame:
    """book_id, index: pipe table of the book's chapters."""
    from vellumspark.operators.assemble import gfm_table
    from vellumspark.operators.chapters import latest_state

    df = chapters.join(latest_state(states), ["book_id", "chapter_key"], "left")
    cells = F.array(F.coalesce(F.col("chapter_no").cast("string"), F.lit("")), F.coalesce("title", F.lit("")), F.concat_ws("–", F.col("page_from").cast("string"), F.col("page_to").cast("string")), F.coalesce("status", F.lit("NOT_STARTED")))
    rows = df.select("book_id", F.col("chapter_key").alias("row"), F.posexplode(cells).alias("c", "cell"))
    head = df.select("book_id").distinct().select("book_id", F.lit("").alias("row"), F.posexplode(F.array(*map(F.lit, ("No.", "Chapter", "Pages", "Status")))).alias("c", "cell"))
    return gfm_table(head.unionByName(rows), ["book_id"], "row", "c", "cell").select("book_id", F.col("gfm").alias("index"))


def obsidian(markdown: DataFrame, column: str = "markdown") -> DataFrame:
    """Exported copy with callout titles as notes and relative links as wikilinks."""
    c = F.regexp_replace(F.col(column), r"(?m)^> \*\*([^*\n]+)\*\*[ ]*\n>[ ]*$", "> [!note] $1")
    c = F.regexp_replace(c, r"\[([^\]]+)\]\((?:\./)?([^)\s:]+)\.md(#[^)\s]*)?\)", r"[[$2$3|$1]]")
    return markdown.withColumn(column, c)


def labels_of(blocks: DataFrame) -> DataFrame:
    """book_id, chapter_key, label, anchor, kind of the captions, figures and tables of blocks: the registry that references
    are resolved with. Of equal labels of a chapter the first counts."""
    from vellumspark.functions import text

    found = blocks.where("block_type in ('caption', 'figure', 'table')").withColumn("_c", F.when(F.trim("raw") != "", F.col("raw")).otherwise(F.col("clean")))
    kind, number = F.regexp_extract("_c", text.LABEL, 1), F.regexp_extract("_c", text.LABEL, 2)
    rows = found.where(kind != "").select("book_id", "chapter_key", "seq", text.normal_label(kind, number).alias("label"), text.label_anchor(kind, number).alias("anchor"), F.lower(F.regexp_replace(kind, r"\.$", "")).alias("kind"))
    return rows.groupBy("book_id", "chapter_key", "label").agg(F.min_by("anchor", "seq").alias("anchor"), F.min_by("kind", "seq").alias("kind"))


def merge_pending(old: DataFrame, fresh: DataFrame, chapters: DataFrame) -> DataFrame:
    """Unresolved references with those of ``chapters`` replaced by ``fresh``, each block and text once."""
    keys = ["book_id", "chapter_key"]
    return old.join(chapters.select(*keys).distinct(), keys, "left_anti").unionByName(fresh).dropDuplicates([*keys, "block_id", "ref"])


def page_hashes(lines: DataFrame) -> DataFrame:
    """book_id, page, sha256 of the text of each page, its lines in order: tells whether a page changed."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "line_id", F.coalesce("raw", F.lit("")).alias("raw"))))
    return lines.groupBy("book_id", "page").agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["raw"]), "\n"), 256).alias("sha256"))


def section_texts(blocks: DataFrame) -> DataFrame:
    """book_id, chapter_key, section_id, text: blocks of each section in order. A section is bounded by its chapter."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "block_id", F.col("clean").alias("t"))))
    return blocks.where("trim(clean) <> ''").groupBy("book_id", "chapter_key", "section_id").agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n").alias("text"))


def write_tables(tables: DataFrame, path: str) -> None:
    """Markdown of tables that went to files of their own (book_id, chapter_key, file, full_md), below their chapter."""
    rows = tables.where("file is not null").select("book_id", "chapter_key", "file", F.col("full_md").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id", "chapter_key", "file").text(path)


def book_yaml(book: dict, chapters: list[dict]) -> str:
    """Definition of a book and its chapters in YAML, as ``readers.book_definition`` reads it."""
    quoted = lambda v: "null" if v is None else str(v) if isinstance(v, (int, float)) else json.dumps(str(v), ensure_ascii=False)
    out = ["book:", *[f"  {k}: {quoted(book.get(k))}" for k in ("book_id", "title", "edition", "n_pages")], "chapters:" if chapters else "chapters: []"]
    for c in chapters:
        out += [("  - " if k == 0 else "    ") + f"{name}: {quoted(c.get(name))}" for k, name in enumerate(("key", "number", "title", "start", "end"))]
    return "\n".join(out) + "\n"


def project_readme(book: dict, n_chapters: int, n_done: int, created: str | None = None) -> str:
    """What a folder of outputs holds, in Markdown."""
    rows = ["chapters | Markdown of each chapter", "tables | large tables", "chunks | JSON lines for retrieval", "index | postings and lengths of the search index", "reports | issues of each chapter"]
    return "\n".join([
        f"# {book.get('title') or book.get('book_id')}", "", f"{n_done} of {n_chapters} chapters are converted. Written {created or now_iso()}.", "", "| Folder | Contents |", "| --- | --- |", *[f"| {r} |" for r in rows], "",
        "Every block names its page; `source_map` leads from lines of Markdown to pages.", "",
    ])


def now_iso() -> str:
    """The time in UTC, to the second."""
    from datetime import datetime, timezone

    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def zip_chapter(folder: str, target: str, book_id: str, chapter_key: str) -> int:
    """Archive of what lies below one chapter's folders; the number of files."""
    part = (f"book_id={book_id}", f"chapter_key={chapter_key}")
    return _zip(folder, target, lambda parts: any(parts[i : i + 2] == part for i in range(len(parts))))


def zip_rag(folder: str, target: str) -> int:
    """Archive of the retrieval chunks alone."""
    return _zip(folder, target, lambda parts: parts[0] == "chunks")


def _zip(folder: str, target: str, wanted) -> int:
    root, n = Path(folder), 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*")):
            parts = f.relative_to(root).parts
            if f.is_file() and not any(p.startswith((".", "_")) for p in parts) and wanted(parts):
                z.write(f, str(Path(*parts)))
                n += 1
    return n


def zip_folder(folder: str, target: str, skipped: tuple[str, ...] = ("__pycache__",)) -> int:
    """Archive of a folder without hidden, temporary and state files; the number of files."""
    root, n = Path(folder), 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*")):
            parts = f.relative_to(root).parts
            if f.is_file() and not any(p in skipped or p.startswith((".tmp_", ".")) for p in parts):
                z.write(f, str(Path(*parts)))
                n += 1
    return n
