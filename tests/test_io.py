import json

import pytest
from pyspark.sql import functions as F

from vellumspark import model
from vellumspark.operators import incremental, xref
from vellumspark.sources import readers, sinks
from vellumspark.streaming import resume


def test_page_records(spark, tmp_path):
    rec = {"book_id": "b", "chapter_key": "c", "page": 3, "items": [{"t": "line", "bbox": [1, 2, 3, 4], "raw": "x", "size": 9}, {"t": "figure"}]}
    (tmp_path / "p.json").write_text(json.dumps(rec) + "\nnot json\n")
    got = readers.record_lines(readers.page_records(spark, str(tmp_path))).collect()
    assert len(got) == 1 and (got[0]["page"], got[0]["seq"], got[0]["x1"], got[0]["raw"]) == (3, 1, 3.0, "x")


def test_ocr(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    rows = ["5\t1\t1\t1\t1\t2\t40\t10\t20\t10\t50\tworld", '5\t1\t1\t1\t1\t1\t10\t10\t20\t12\t90\t"hello', "4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t", "5\t1\t1\t1\t2\t1\t5\t30\t9\t9\t-1\tx"]
    (tmp_path / "o.tsv").write_text("\n".join([head, *rows]))
    got = readers.ocr_lines(readers.ocr_words(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r["raw"], r["min_conf"], r["x1"]) for r in got] == [('"hello world', 0.5, 60.0), ("x", 0.0, 14.0)]


def test_html(spark):
    html = "<nav><p>menu</p></nav><h1>Title</h1><p>One <b>bold<p>two<script>var a='</p><p>no';</script><li>item"
    df = readers.html_blocks(spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string"), "id", "html")
    assert [(r["block_type"], r["clean"]) for r in df.orderBy("seq").collect()] == [("heading", "Title"), ("paragraph", "One bold"), ("paragraph", "two"), ("list", "item")]


def test_missing_files(spark, tmp_path):
    assert readers.json_or_default(spark, str(tmp_path / "none.json"), "a int").count() == 0
    assert readers.book_definition(spark, str(tmp_path / "none.yaml"))[0].count() == 0


def test_definition_and_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "book.yaml").write_text("book: {book_id: b, title: T, n_pages: 9}\nchapters: []\n")
    assert readers.book_definition(spark, str(tmp_path / "book.yaml"))[0].first()["title"] == "T"
    (tmp_path / ".state").mkdir()
    (tmp_path / ".state" / "state.json").write_text("{}")
    assert [r["path"].rsplit("/", 1)[-1] for r in readers.files_below(spark, str(tmp_path)).collect()] == ["book.yaml"]
    assert sinks.zip_folder(str(tmp_path), str(tmp_path.parent / "out.zip")) == 1


def test_rewriting_one_chapter_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "md")
    sinks.write_chapters(spark.createDataFrame([("b", "c1", "one"), ("b", "c2", "two")], "book_id string, chapter_key string, markdown string"), path)
    sinks.write_chapters(spark.createDataFrame([("b", "c2", "new")], "book_id string, chapter_key string, markdown string"), path)
    assert {(r["chapter_key"], r["value"]) for r in spark.read.text(path).collect()} == {("c1", "one"), ("c2", "new")}


def test_report_and_index(spark):
    issues = spark.createDataFrame([("b", "c", "LOW", "Y", "m", 2, None), ("b", "c", "HIGH", "X", "n", None, 4)], model.ISSUE)
    assert sinks.report(issues).first()["report"].split("\n") == ["- **HIGH** `X` n", "- **LOW** `Y` m (p. 2)"]
    chapters = spark.createDataFrame([("b", "c", 1, "T|x", 1, 4)], "book_id string, chapter_key string, chapter_no int, title string, page_from int, page_to int")
    states = spark.createDataFrame([], "book_id string, chapter_key string, status string, page int, loaded_at timestamp")
    assert r"T\|x" in sinks.book_index(chapters, states).first()["index"]
    md = spark.createDataFrame([("b", "c", "> **Note**\n>\n> a [x](./y.md#z)")], "book_id string, chapter_key string, markdown string")
    assert sinks.obsidian(md).first()["markdown"] == "> [!note] Note\n> a [[y#z|x]]"
    assert json.loads(sinks.manifest(chapters, states, md).first()["manifest"])[0]["markdown"] is True


def test_resumed_equals_uninterrupted(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    rows = [(i, "b", "c", 1, i, 0.0, 0.0, 1.0, 1.0, 9.0, False, False, f"line {i}", None, None, 0.9) for i in range(20)]
    all_rows = spark.createDataFrame(rows, model.LINE)
    work = lambda df: df.select("line_id", F.upper("raw").alias("up"))
    for part in (all_rows.where("line_id < 8"), all_rows.where("line_id >= 8").union(all_rows.where("line_id = 9"))):
        part.coalesce(1).write.mode("append").parquet(src)
        resume.convert_arrived(spark, src, model.LINE, out, ck, work).awaitTermination()
    got = spark.read.parquet(out).select("line_id", "up")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, work(all_rows).collect()))


def test_late_references(spark, tmp_path):
    waiting = spark.createDataFrame([("b1", "Table 2.1", "table", "2.1", "Table 2.1", 2, 1), ("b2", "Box 1", "box", "1", "Box 1", None, 1)], "block_id string, ref string, kind string, num string, label string, target_chapter int, chapter_number int")
    waiting.write.parquet(str(tmp_path / "w" / "0"))
    labels = spark.createDataFrame([(2, "Table 2.1", "table-2-1", None)], "chapter_number int, label string, anchor string, table_file string")
    files = spark.createDataFrame([(2, "ch2.md")], "chapter_number int, file string")
    resume.late_references(spark, labels, str(tmp_path / "w"), str(tmp_path / "r"), files, 0)
    assert spark.read.parquet(str(tmp_path / "r")).first()["url"] == "./ch2.md#table-2-1"
    assert [r["block_id"] for r in spark.read.parquet(str(tmp_path / "w" / "1")).collect()] == ["b2"]
    assert xref.pending(xref.resolve(waiting, files, labels)).count() == 1


def test_remaining(spark):
    want = spark.createDataFrame([("b", "c", p) for p in range(1, 5)], "book_id string, chapter_key string, page int")
    done = spark.createDataFrame([("b", "c", 1, "1.4", True), ("b", "c", 2, "1.3", True), ("b", "c", 3, "1.4", None)], "book_id string, chapter_key string, page int, parser_version string, ocr boolean")
    left = incremental.remaining_pages(want, done, ["book_id", "chapter_key", "page"], "1.4", True)
    assert sorted(r["page"] for r in left.collect()) == [2, 3, 4]


def test_guards_of_files(spark, tmp_path):
    (tmp_path / "ok.pdf").write_bytes(b"%PDF-1.4 ... /Type /Page ... %%EOF")
    (tmp_path / "locked.pdf").write_bytes(b"%PDF-1.4 /Encrypt 1 0 R /Type /Page")
    (tmp_path / "broken.pdf").write_bytes(b"hello")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "none.pdf").write_bytes(b"%PDF-1.4 /Catalog")
    got = {r["path"].rsplit("/", 1)[-1]: r["problem"] for r in readers.checked_files(spark, str(tmp_path)).collect()}
    assert got == {"ok.pdf": None, "locked.pdf": "encrypted", "broken.pdf": "corrupt", "none.pdf": "no pages"}
    assert readers.checked_files(spark, str(tmp_path / "gone")).first()["problem"] == "missing"


def test_tail_of_a_log_and_recent_projects(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(f'{{"at": {i}, "what": "w{i}"}}' for i in range(5)) + "\nnot json\n")
    got = readers.log_tail(spark, str(tmp_path / "log.jsonl"), "at bigint, what string", "at", 2).collect()
    assert [r["what"] for r in got] == ["w4", "w3"]
    assert readers.log_tail(spark, str(tmp_path / "gone"), "at bigint, what string", "at").count() == 0
    df = spark.createDataFrame([("a", None), ("b", "2024-01-01"), ("c", "2024-05-01")], "name string, last_opened string")
    assert [r["name"] for r in readers.recent_first(df).collect()] == ["c", "b", "a"]


def test_book_definition_round_trip(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "book.yaml"
    sinks.write_text(path, sinks.book_yaml({"book_id": "b", "title": 'A "title": x', "edition": "2", "n_pages": 9}, [{"key": "c1", "number": 1, "title": "One", "start": 1, "end": None}]))
    book, chapters = readers.book_definition(spark, str(path))
    assert book.first()["title"] == 'A "title": x' and tuple(chapters.first()) == ("b", "c1", 1, "One", 1, None)
    assert "# T" in sinks.project_readme({"title": "T"}, 3, 1) and sinks.now_iso().endswith("Z")


def test_archives_of_parts(tmp_path):
    for name in ("md/book_id=b/chapter_key=c1/x.txt", "md/book_id=b/chapter_key=c2/x.txt", "chunks/part.json", "chunks/_SUCCESS"):
        (tmp_path / "out" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "out" / name).write_text("x")
    assert sinks.zip_chapter(str(tmp_path / "out"), str(tmp_path / "a.zip"), "b", "c1") == 1
    assert sinks.zip_rag(str(tmp_path / "out"), str(tmp_path / "b.zip")) == 1


def test_pending_references_are_replaced_by_chapter(spark):
    schema = "book_id string, chapter_key string, block_id string, ref string"
    old = spark.createDataFrame([("b", "c1", "1", "Table 1"), ("b", "c2", "2", "Table 9")], schema)
    fresh = spark.createDataFrame([("b", "c1", "1", "Table 2"), ("b", "c1", "1", "Table 2")], schema)
    got = sinks.merge_pending(old, fresh, fresh)
    assert {tuple(r) for r in got.collect()} == {("b", "c1", "1", "Table 2"), ("b", "c2", "2", "Table 9")} and got.count() == 2
