import random

import pytest
from pyspark.sql import functions as F

from vellumspark import model
from vellumspark.operators import assemble, blocks, chapters, layout, navigate, qa, rag, search, xref


def line(raw, y, size=10.0, bold=False, x0=50.0, x1=300.0, page=1, col="F", box=-1):
    return {"raw": raw, "y0": y, "y1": y + size, "size": size, "bold": bold, "x0": x0, "x1": x1, "page": page, "col": col, "box": box}


def test_segmentation_breaks():
    right = {(1, "F"): 300.0, (2, "F"): 300.0}
    lines = [
        line("A Heading", 40, 16.0, True), line("First line of text that goes", 70), line("on and ends here.", 82, x1=150), line("A new one after a short line", 94), line("• an item", 106), line("that goes on", 118, x0=60),
        line("2. Next item", 130), line("which the page does not", 142), line("end, it goes on", 60, page=2), line("Figure 1. A caption", 72, 9.0, page=2),
    ]
    assert blocks.segment_lines(lines, 10.0, 2.0, right) == [1, 2, 2, 3, 4, 4, 5, 5, 5, 6]


def test_segmentation_of_nothing():
    assert blocks.segment_lines([], 10.0, 2.0, {}) == []


def test_reading_order_of_two_columns():
    items = [(100 + 12 * i, 110 + 12 * i, x, f"{c}{i}", x + 200, None) for i in range(5) for c, x in (("L", 50.0), ("R", 300.0))]
    random.Random(3).shuffle(items)
    order = layout.page_order([*items, (80, 95, 50.0, "wide", 500, None), (20, 30, 50.0, "head", 300, "top")], 275.0)
    assert order == ["head", "wide", *[f"L{i}" for i in range(5)], *[f"R{i}" for i in range(5)]]


def test_zones():
    items = [(20, 30, 50, "head", 9.0, 10), (60, 72, 50, "b1", 10.0, 40), (74, 86, 50, "b2", 10.0, 40), (810, 820, 50, "foot", 9.0, 4)]
    assert layout.zones_of_page(items, 842.0) == {"head": "top", "foot": "bottom"}
    assert layout.zones_of_page([], 842.0) == {}


def test_gutter_of_two_columns(spark):
    rows = [(2 * i + k, "b", "c", 1, i, x, 100.0 + 12 * i, x + 200, 110.0 + 12 * i, 10.0, False, False, "some words here", None, None, 0.9) for i in range(10) for k, x in ((0, 50.0), (1, 300.0))]
    df = spark.createDataFrame(rows, model.LINE)
    assert 250 < layout.gutters(df).first()["gutter"] < 300
    assert layout.gutters(df.where("x0 = 50")).count() == 0


def block(i, kind="paragraph", md="text", section="s", seq=None, level=None, pages=(1,), clean=None):
    return (i, "b", "c", i if seq is None else seq, kind, section, md, md, md if clean is None else clean, list(pages), 0.9, level, None, None)


def test_chunks_pack_and_merge(spark):
    rows = [block(1, md="a" * 1500), block(2, md="b" * 600), block(3, md="c" * 300), block(4, "table", "| t |"), block(5, "reference", "1. R"), block(6, "reference", "2. S"), block(7, md="z" * 5000), block(8, md="<!-- source_page: 2 --> end [1,2]"), block(9, md=None), block(10, md="  ")]
    got = {r["chunk_id"]: (r["content_type"], r["block_ids"], r["references"]) for r in rag.chunks(spark.createDataFrame(rows, model.BLOCK)).collect()}
    assert got == {"s#1": ("text", [1, 2], []), "s#2": ("text", [3], []), "s#3": ("table", [4], []), "s#4": ("reference", [5, 6], []), "s#5": ("text", [7], []), "s#6": ("text", [8], [1, 2])}
    assert rag.unique_ids(rag.chunks(spark.createDataFrame(rows, model.BLOCK))).count() == 0


def test_sections_paths_and_ids(spark):
    heads = [(1, "Cells", 1), (2, "Types", 2), (3, "Small", 3), (4, "Organs", 1), (5, "Types", 2), (6, "Types", 2), (7, None, None)]
    df = spark.createDataFrame([block(i, "heading", t, level=lv, clean=t) for i, t, lv in heads], model.BLOCK)
    paths = {r["block_id"]: r["path"] for r in assemble.heading_paths(df).collect()}
    assert paths[3] == ["Cells", "Types", "Small"] and paths[5] == ["Organs", "Types"]
    ids = [r["section_id"] for r in assemble.sections(df).orderBy("seq").collect()]
    assert ids[:6] == ["cells", "types", "small", "organs", "organs-types", "organs-types-2"] and len(set(ids)) == 7


def test_source_map_lines_match_the_markdown(spark):
    df = spark.createDataFrame([block(1, md="# A\nb", pages=(1,)), block(2, md="c", pages=(1, 2)), block(3, md="d\ne\nf", pages=(3,)), block(4, md="g", pages=())], model.BLOCK)
    text = assemble.markdown(df).first()["markdown"].split("\n")
    md = {1: "# A\nb", 2: "c", 3: "d\ne\nf", 4: "g"}
    for r in assemble.source_map(df).collect():
        assert "\n".join(text[r["line_start"] - 1 : r["line_end"]]) == md[r["block_id"]]


def test_list_rendering():
    assert blocks.render_list([(50.0, "• top"), (70.0, "– child"), (50.0, "3. Number"), (72.0, "a) letter")]) == "- top\n  - child\n3. Number\n   - a) letter"


def test_levels_keep_memory(spark):
    heads = spark.createDataFrame([("b", 1, 13.0, True), ("b", 2, 11.0, True), ("b", 3, 9.5, True)], "book_id string, seq int, size double, bold boolean")
    memory = spark.createDataFrame([("b", "11|b", 2)], "book_id string, style string, level int")
    none = memory.where("false")
    levels = lambda m: [r["level"] for r in blocks.levels_with_memory(heads, m, ["book_id"]).orderBy("seq").collect()]
    assert levels(none) == [2, 3, 4]
    assert levels(memory) == [2, 2, 3]


@pytest.mark.parametrize(("source", "output", "want"), [
    (["5 mg", "7"], ["5", "7"], set()), (["12"], ["21"], {("CHANGED_NUMBER", "12", "21")}), (["12.5"], [], {("MISSING_NUMBER", "12.5", None)}), ([], ["4"], {("UNEXPECTED_NUMBER", None, "4")}),
])
def test_number_issues(spark, source, output, want):
    a = spark.createDataFrame([("b", "c", s.split()[0], 1, s[len(s.split()[0]) :]) for s in source], "book_id string, chapter_key string, token string, page int, ctx string")
    z = spark.createDataFrame([("b", "c", s, 1) for s in output], "book_id string, chapter_key string, token string, page int")
    assert {(r["code"], r["source"], r["output"]) for r in qa.number_issues(a, z).collect()} == want


def test_loss_of_nothing(spark):
    df = spark.createDataFrame([("b", "c", "Abc 12", "abc-12"), ("b", "d", "xx", "x"), ("b", "e", None, "y")], "book_id string, chapter_key string, raw string, clean string")
    assert {r["chapter_key"]: r["loss_ratio"] for r in qa.char_loss(df, ["book_id", "chapter_key"], "raw", "clean").collect()} == {"c": 0.0, "d": 0.5}


def test_status(spark):
    issues = spark.createDataFrame([("b", "c1", "HIGH", "X", "", None, None), ("b", "c2", "LOW", "Y", "", None, None)], model.ISSUE)
    chaps = spark.createDataFrame([("b", "c1"), ("b", "c2"), ("b", "c3"), ("b", "c4")], "book_id string, chapter_key string")
    got = {r["chapter_key"]: r["status"] for r in qa.status_of(issues, chaps, chaps.where("chapter_key = 'c4'")).collect()}
    assert got == {"c1": "REVIEW_REQUIRED", "c2": "COMPLETED_WITH_WARNINGS", "c3": "COMPLETED", "c4": "FAILED"}


def test_query_parsing():
    assert search.parse_query('"heart rate" drug-like dos') == [search.Term(("heart", "rate")), search.Term(("drug", "like")), search.Term(("dos",), True)]
    assert search.parse_query("  ") == [] and search.parse_query('"') == []


def test_search_edges(spark):
    units = spark.createDataFrame([(1, "Heart rate rises. heart"), (2, "rate of the heart"), (3, None), (4, "")], "unit int, text string")
    assert search.search(units, "unit", ["text"], "").count() == 0
    assert [r["unit_id"] for r in search.search(units, "unit", ["text"], '"heart rate"').collect()] == [1]
    assert {r["unit_id"] for r in search.search(units, "unit", ["text"], "heart rat").collect()} == {1, 2}
    assert search.search(units.where("false"), "unit", ["text"], "heart").count() == 0


def test_links_are_idempotent(spark):
    df = spark.createDataFrame([("see Table 1.2", {"Table 1.2": "#t"})], "md string, urls map<string,string>")
    once = df.select(xref.rewrite(F.col("md"), F.col("urls")).alias("md"), "urls")
    twice = once.select(xref.rewrite(F.col("md"), F.col("urls")).alias("md"))
    assert once.first()["md"] == twice.first()["md"] == "see [Table 1.2](#t)"


def test_cascade_takes_the_first_source(spark):
    schema = "book_id string, title string"
    a, b = spark.createDataFrame([("x", "outline")], schema), spark.createDataFrame([("x", "layout"), ("y", "layout")], schema)
    assert {(r["book_id"], r["title"]) for r in chapters.first_source([a, b]).collect()} == {("x", "outline"), ("y", "layout")}


def test_page_offset(spark):
    titles = spark.createDataFrame([("b", "Cells", 1), ("b", "Organs", 9)], "book_id string, title string, printed_page int")
    pages = spark.createDataFrame([("b", 5, "CELLS and more"), ("b", 13, "about organs"), ("b", 14, "organs")], "book_id string, page int, text string")
    assert chapters.page_offset(titles, pages).first()["offset"] == 4


def test_merged_tables(spark):
    rows = [("b", "c", 1, 1, 3, True, 600.0), ("b", "c", 2, 2, 3, True, 80.0), ("b", "c", 3, 3, 3, True, 400.0), ("b", "c", 4, 4, 2, True, 90.0)]
    df = blocks.merge_tables(spark.createDataFrame(rows, "book_id string, chapter_key string, table_id int, page int, n_cols int, simple boolean, y0 double"))
    assert [r["chain"] for r in df.orderBy("table_id").collect()] == [1, 1, 2, 3]


def test_terms_need_two(spark):
    df = spark.createDataFrame([block(1, clean="amoxicillin and Amoxicillin, penicillin")], model.BLOCK)
    assert [r["term"] for r in navigate.terms_by_ending(df, navigate.DRUG_ENDINGS).collect()] == ["amoxicillin"]


def test_index_on_disk(spark, tmp_path):
    units = spark.createDataFrame([(1, "Café culture in Zürich", "x"), (2, "The café of the cultures", None), (3, None, None), (4, "in most cases, in most", "cases")], "unit bigint, text string, title string")
    index = search.build(units, "unit", ["text", "title"], str(tmp_path / "ix"))
    again = search.open_index(spark, str(tmp_path / "ix"))
    assert again.n_units == 4 and again.avg_tokens == index.avg_tokens
    assert {r["unit_id"] for r in search.find(again, "cafe cult").collect()} == {1, 2}
    assert [r["unit_id"] for r in search.find(again, '"most cases"').collect()] == [4]  # no phrase runs from one column into the next
    assert {(r["unit_id"], r["n"]) for r in search.matches(again, search.Term(("in", "most"))).collect()} == {(4, 2)}
    assert search.find(again, "cafe", among=units.where("unit = 2").select(F.col("unit").alias("unit_id"))).count() == 1
    plan = search.matches(again, search.Term(("cafe",)))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,cafe)" in plan
    fresh = search.build(spark.createDataFrame([(1, "tea", None)], "unit bigint, text string, title string"), "unit", ["text", "title"])
    new = search.reindexed(again, fresh.lengths, fresh)
    assert new.n_units == 4 and {r["unit_id"] for r in search.find(new, "cafe").collect()} == {2} and search.find(new, "tea").count() == 1
    assert search.find(search.build(units.where("false"), "unit", ["text"]), "cafe").count() == 0


def test_chunks_without_a_section(spark):
    rows = [block(1, section=None, md="a"), block(2, section=None, md="b")]
    got = rag.chunks(spark.createDataFrame(rows, model.BLOCK)).collect()
    assert [(r["chunk_id"], r["block_ids"]) for r in got] == [("start#1", [1, 2])]


def test_order_keeps_lines_without_a_place(spark):
    rows = [(1, "b", "c", 1, 1, 50.0, 100.0, 200.0, 110.0, 10.0, False, False, "first", None, None, 0.9), (2, "b", "c", 1, 2, None, None, None, None, None, None, None, "lost", None, None, None)]
    got = {r["line_id"]: r["order_no"] for r in layout.placed(spark.createDataFrame(rows, model.LINE)).collect()}
    assert got == {1: 0, 2: 1}
    assert layout.placed(spark.createDataFrame([], model.LINE)).count() == 0


def test_conversion_of_nothing(spark):
    from vellumspark import pipeline

    chapters_ = spark.createDataFrame([], "book_id string, chapter_key string, chapter_no int, title string, page_from int, page_to int")
    c = pipeline.convert(spark.createDataFrame([], model.LINE), chapters_)
    assert c.blocks.count() == 0 and c.issues.count() == 0 and c.status.count() == 0
