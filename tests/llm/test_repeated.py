from datetime import datetime, timedelta

from vellumspark.llm import repeated as R

SCHEMA = "line_id bigint, book_id string, page int, seq int, raw string, source string, key string, id int"


def lines(spark, rows):
    return spark.createDataFrame([(i, b, p, i, t, "clash", "clash", 7) for i, b, p, t in rows], SCHEMA)


def test_same_line_in_spite_of_noise():
    same = ["Introduction to Law, page 8 of 90", "INTRODUCTION  TO LAW – Page 17 of 90", "12  Introduction to Law, page of"]
    assert len({R.key_of(x) for x in same}) == 1
    assert R.key_of("Tous droits rÃ©servÃ©s") == R.key_of("Tous droits réservés") == R.key_of("Tous droits r├®serv├®s")
    assert R.key_of("Printed 3 May 2011 for X College") == R.key_of("Printed 2009-07-02 for X College")


def test_page_numbers_and_blanks_have_no_key():
    assert {R.key_of(x) for x in ("12", "- 12 -", "xiv", "Page 7", "Seite 12", "p. 3", "page 3 of 9", "", "   ", "–", None)} == {None}
    assert R.key_of("ГРЁМОВ И ЛУНСКИЙ, 7") == R.key_of("Грёмов и Лунский 12")


def book(n, every, text):
    return [(p, f"{text} {p}") for p in range(1, n + 1) if p % every == 0]


def test_found_lines(spark):
    rows, i = [], 0
    want = set()
    for p in range(1, 41):
        i += 1
        rows.append((i, "b", p, f"Body text of page number {'abcdefghij'[p % 10]}{'klmnopqrst'[p // 10]} and some more {'uvwxyz'[p % 6]}"))
        i += 1
        if p % 2 == 0:
            rows.append((i, "b", p, "Contract Law in Practice, 2nd edition" if p % 8 else "C0ntract Lavv in Practice, 2nd edition"))
            want.add(i)
        elif p % 9 == 0:
            rows.append((i, "b", p, "Once in a while"))  # 4 of 40 pages: under a fifth
        i += 1
        rows.append((i, "b", p, f"- {p} -"))
    for p in (1, 2, 3):
        i += 1
        rows.append((i, "short", p, "On all of three pages"))  # under four pages
    rows += [(None, "b", 2, "Contract Law in Practice"), (i + 1, None, 1, "x"), (i + 2, "b", None, "Contract Law in Practice"), (i + 3, "b", 3, None), (i + 4, "b", 3, "x" * 50_000)]
    df = lines(spark, rows + rows[:5])
    got = {r["id"] for r in R.repeated_lines(df, "line_id", "book_id", "page", "raw").collect()}
    assert got == want
    pages = {(r["source"], r["page"]): r for r in R.pages_without(df, spark.createDataFrame([(x,) for x in got], "id bigint"), "line_id", "book_id", "page", "seq", "raw").collect()}
    assert pages["b", 2]["n_removed"] == 1 and "Contract Law in Practice, 2nd" not in pages["b", 2]["text"] and pages["b", 1]["text"].startswith("Body text")


def test_empty(spark):
    df = lines(spark, [(1, "b", 1, "x")]).where("false")
    assert R.repeated_lines(df, "line_id", "book_id", "page", "raw").count() == 0


def test_increments_equal_the_whole(spark):
    rows = [(p * 10 + k, "b", p, t) for p in range(1, 21) for k, t in enumerate([f"unlike {'abcdefghijklmnopqrst'[p - 1] * 5} line", "Share this section"] if p > 10 else [f"other {'abcdefghijklmnopqrst'[p - 1] * 5} row"])]
    rows += [(1000 + p, "c", p, "Another book") for p in range(1, 9)]
    first, second = lines(spark, [r for r in rows if r[1] == "c" or r[2] <= 12]), lines(spark, [r for r in rows if r[1] == "b" and r[2] > 12])
    cols = ("line_id", "book_id", "page", "raw")
    before = R.merge_partition(None, first, *cols)
    assert [tuple(r) for r in before.repeated().collect()] == [("c", "anotherbook")]  # the other line is on 2 of 12 pages
    now = R.merge_partition(before, second, *cols)
    whole = R.merge_partition(None, lines(spark, rows), *cols)
    assert sorted(map(tuple, now.counts.collect()), key=repr) == sorted(map(tuple, whole.counts.collect()), key=repr)
    assert {tuple(r) for r in now.repeated().collect()} == {("b", "sharethissection"), ("c", "anotherbook")} == {tuple(r) for r in whole.repeated().collect()}
    # the new pages, and the two old ones with the line that has crossed the threshold; nothing of the other book
    assert {tuple(r) for r in R.to_rebuild(before, now, second, "book_id", "page").collect()} == {("b", p) for p in (11, 12, *range(13, 21))}


def test_pages_in_parts_equal_the_whole(spark):
    schema = SCHEMA + ", loaded_at timestamp"
    t = datetime(2024, 1, 1)
    rows = [(p * 10 + k, "b", p, k, text, "clash", "clash", 7, t if p <= 12 else t + timedelta(days=60)) for p in range(1, 21) for k, text in enumerate([f"page {'abcdefghijklmnopqrst'[p - 1] * 5}", "Share this section" if p > 10 else "other " + "klmnopqrstuvw"[p] * 6])]
    rows += [(900, "b", 3, 9, "Share this section", None, None, None, None), (101, "b", 10, 1, "other uuuuuu", None, None, 1, t + timedelta(days=90))]
    df = spark.createDataFrame(rows, schema)
    gone = R.repeated_lines(df, "line_id", "book_id", "page", "raw")
    whole = R.pages_without(df, gone, "line_id", "book_id", "page", "seq", "raw")
    parts = R.pages_in_parts(df, "line_id", "book_id", "page", "seq", "raw", "loaded_at")
    assert sorted(map(tuple, parts.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert gone.count() == 11 == R.repeated_lines(df, "line_id", "book_id", "page", "raw", arrived="loaded_at").count()


def test_forms_that_are_too_many_to_broadcast(spark, monkeypatch):
    rows = [(i, b, p, "Share this sectlon" if p == 4 else "Share this section" if p % 2 else f"own {'abcdefghij'[p] * 7}") for i, (b, p) in enumerate((b, p) for b in "xyz" for p in range(10))]
    df = lines(spark, rows)
    want = {r["id"] for r in R.repeated_lines(df, "line_id", "book_id", "page", "raw").collect()}
    monkeypatch.setattr(R, "BROADCAST_BYTES", -1)
    assert {r["id"] for r in R.repeated_lines(df, "line_id", "book_id", "page", "raw").collect()} == want and len(want) == 18


def test_pages_are_bits_of_blocks(spark):
    df = lines(spark, [(i, "b", p, "Share this section") for i, p in enumerate((0, 63, 64, -1, -64, -65, 2**30))])
    got = {r["block"]: r["mask"] for r in R.merge_partition(None, df, "line_id", "book_id", "page", "raw").counts.where("key is not null").collect()}
    assert got == {0: 1 - 2**63, 1: 1, -1: 1 - 2**63, -2: -(2**63), 2**24: 1}


def test_other_scripts():
    assert R.key_of("ISBN Привет") != R.key_of("ISBN Пока") and R.key_of("目次") == R.key_of("  目次 12")
    assert R.key_of("Ð¡") is None and R.key_of("Müller’s Handbuch") == R.key_of("MÃ¼llerâ€™s Handbuch")
