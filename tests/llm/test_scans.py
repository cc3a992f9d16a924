import random

import pytest

from vellumspark.llm import scans as S
from vellumspark.llm.boosting import Boosted

TEXT = (
    "the contract gives every tenant a fair reading of the statute and the judge repeals the verdict in most cases because "
    "the constitutional damages were recorded as a well-known example of the method under such conditions while the creditor "
    "explains the liability and the self-contained sentence of the petition through long-term measures"
).split()


def paragraph(rng, n=40):
    return " ".join(rng.choice(TEXT) for _ in range(n))


BLOCK = "block_id bigint, book_id string, raw string, clean string, pages array<int>, text string, token string"
PARA = "para_id bigint, book_id string, text string, rec string"
LINE = "line_id bigint, book_id string, page int, raw string, y0 double, key string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    blocks = [(i, "b", paragraph(rng), paragraph(rng), [1], "clash", "clash") for i in range(200)]
    running = "\nContract Law in Practice | 3rd edition\n- 12 -\n"
    blocks += [
        (1001, "b", "the consti-\ntutional damages of a well-\nknown example\nin most ca-\nses", None, [2], "", ""),
        (1002, "b", "the ten­\nant gives every verd¬\nict to the judge", None, [2], "", ""),
        (1003, "b", "every tcnant repea1s the stafute and rnost cases of l866", None, [2], "", ""),
        (1004, "b", "the creditor explains" + running + "the liability in a con-" + running + "tract of the judge", None, [12, 13], "", ""),
        (1005, "b", None, "the consti-tutional damages of a well-known judge", [1], "", ""),
        (1006, "b", None, None, [1], "", ""), (1007, "b", "", None, [1, 2], "", ""), (None, "b", "ca-\nses", None, [1], "", ""), (1008, "none", "x " * 60_000 + "consti-\ntutional", None, None, "", ""),
    ]
    paras = [(i, "b", paragraph(rng), "clash") for i in range(50)] + [(2001, "b", "the consti- tutional dama- ges", ""), (2002, "b", None, ""), (2003, None, "tenants of H2O and B12 near Brenøme", "")]
    lines = [(i, "b", i % 60, paragraph(rng, 8), 100.0 + i, "") for i in range(240)] + [(1000 + p, "b", p, "Contract Law in Practice | 3rd edition", 20.0, "") for p in range(40)] + [(5000, "b", 9, "last", 800.0, ""), (5001, "c", 1, None, None, "")]
    return spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(paras, PARA), spark.createDataFrame(lines, LINE)


def test_defects(tables):
    got: dict = {}
    for r in S.repair_scans(*tables, defects=True).collect():
        got.setdefault((r["rec"], r["rec_id"]), set()).add((r["defect"], r["token"]))
    assert got.pop(("block", 1001)) == {("broken_word", "constitutional"), ("broken_word", "cases")}
    assert got.pop(("block", 1002)) == {("broken_word", "tenant"), ("broken_word", "verdict")}
    assert got.pop(("block", 1003)) == {("misread", x) for x in ("tenant", "repeals", "statute", "most", "1866")}
    assert got.pop(("block", 1004)) == {("running_line", "Contract Law in Practice | 3rd edition"), ("page_number", "- 12 -"), ("broken_word", "contract")}
    assert got.pop(("block", 1005)) == {("broken_word", "constitutional")}
    assert got.pop(("block", 1008)) == {("broken_word", "constitutional")}
    assert got.pop(("para", 2001)) == {("broken_word", "constitutional"), ("broken_word", "damages")}
    assert got == {}


def test_texts(tables):
    texts = {(r["rec"], r["rec_id"]): r["text"] for r in S.repair_scans(*tables).collect()}
    assert texts["block", 1001] == "the constitutional damages of a well- known example in most cases".replace("well- known", texts["block", 1001].split(" a ")[1].split(" example")[0])
    assert texts["block", 1003] == "every tenant repeals the statute and most cases of 1866"
    assert texts["block", 1004] == "the creditor explains the liability in a contract of the judge"
    assert ("block", 1006) not in texts and texts["block", 1007] == ""


def test_empty(tables):
    blocks, paras, lines = (t.where("false") for t in tables)
    assert S.repair_scans(blocks, paras, lines, defects=True).count() == 0


@pytest.mark.parametrize(("line", "yes"), [("- 8 -", True), ("[16]", True), ("157 |", True), ("Page 55", True), ("p. 161", True), ("xii", True), ("3].", False), ("1964;30:209", False), ("mix of", False), ("71  R2  91", False)])
def test_page_numbers(line, yes):
    assert S.is_page_number(line) is yes


def test_look_costs():
    assert S.look_cost("rnodel", "model") == S.look_cost("tcst", "test") == pytest.approx(0.4)
    assert S.look_cost("judges", "judge") == 1.0 and S.look_cost("abc", "xyzuvw") > 2


def test_edit_distance():
    assert S.edits("kitten", "sitting", 5) == 3 and S.edits("abc", "abc", 2) == 0 and S.edits("abcdef", "uvwxyz", 2) == 3


def test_boosting_learns():
    rng = random.Random(0)
    x = [[rng.random(), rng.random()] for _ in range(800)]
    y = [a > 0.5 and b < 0.7 for a, b in x]
    m = Boosted(rounds=30).fit(x, y)
    assert sum((m.chance(r) > 0.5) == t for r, t in zip(x, y)) > 780
    assert Boosted().fit([[0.0]], [1]).chance([5.0]) > 0.9


def repairer(spark, counts, text, alone=()):
    """Decisions for a text in a collection with such counts of words."""
    asked = S.questions(text, True, True) | {"w\t" + w.lower() for w in S.RUN.findall(text) if w.lower() not in counts}
    rows = [("w\t" + w, n, 0, 0, n if w in alone else 0) for w, n in counts.items()] + [(k, 0, 0, 0, 0) for k in sorted(asked)]
    tally = spark.createDataFrame(rows, "key string, n bigint, n_capital bigint, n_foreign bigint, n_alone bigint")
    return S.Repairer({r["key"]: r["value"] for r in S.decisions(tally, S.learn(tally)).collect()})


@pytest.mark.parametrize("times", [1, 400])
def test_size_of_the_collection_does_not_matter(spark, times):
    counts = {w: 40 for w in TEXT} | {"1866": 79, "l866": 6, "l02": 30, "102": 15, "consti-tutional": 3, "well-known": 30}
    text = "the consti-tutional damages of a well-known l02 in l866"
    text, found = repairer(spark, {w: n * times for w, n in counts.items()}, text).text(text, None, True, True)
    assert text == "the constitutional damages of a well-known l02 in 1866"
    assert found == [("misread", "1866"), ("broken_word", "constitutional")]


def test_codes_are_no_misread_numbers(spark):
    counts = {w: 300 for w in TEXT} | {str(x): 50 for x in (12, 1866, 20, 100)}
    r = repairer(spark, counts, "B12 G8 l00 I866, 2O% (3rd) H2O")
    assert [r.token(x) for x in ("B12", "G8", "l00", "I866,", "2O%", "(3rd)", "H2O")] == [None, None, "100", "1866", "20", None, None]


def test_short_words_stand_alone(spark):
    line = "the tax on each ore and the low-cost contract of a judge; docu- ent the peti-\nent of the ent-\nent be at rest"
    df = spark.createDataFrame([(" ".join([line, *TEXT]), False, False, None)] * 40, "text string, blanks boolean, inner boolean, furniture array<string>")
    tally = S.tallies(df)
    real = {r["word"] for r in S.vocabulary(tally, S.learn(tally)).where("real").collect()}
    assert {"tax", "ore", "low"} <= real and "ent" not in real
    counts = {w: 300 for w in TEXT} | {"tax": 206, "ore": 181, "be": 7000}
    r = repairer(spark, counts, "fax bc BC au", alone=counts)
    assert [r.token(x) for x in ("fax", "bc", "BC", "au")] == ["tax", "be", None, None]


def test_no_candidate_is_missed_by_the_join():
    rng = random.Random(4)
    for _ in range(4000):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 14)))
        seen, k = word, 0
        for _ in range(rng.randint(1, 2)):  # places apart, as confusions of what was confused already are changes of another kind
            options = [(i, n, x) for i in range(k, len(seen)) for n in (1, 2) if i + n <= len(seen) for x in sorted(S.PAIRS.get(seen[i : i + n], ()))]
            if options:
                i, n, x = rng.choice(options)
                seen, k = seen[:i] + x + seen[i + n :], i + len(x)
        assert S.confusions(seen, word) is not None
        frequency = {g: rng.randint(0, 9) for g, _ in S.gram_places(seen, (2, 3))}
        all_of = S.gram_places(word, (2,) * (len(word) <= 10) + (3,) * (len(word) >= 7))
        assert any(g == h and abs(p - q) <= 2 for g, p in S.telling_grams(seen, frequency) for h, q in all_of), (seen, word)


def test_decisions_that_are_too_many_to_broadcast(tables, monkeypatch):
    want = {tuple(r) for r in S.repair_scans(*tables, defects=True).collect()}
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    assert {tuple(r) for r in S.repair_scans(*tables, defects=True).collect()} == want and len(want) > 15


def test_furniture_is_told_by_its_line_pairs(spark):
    rng = random.Random(6)
    lines = [(p * 100 + k, "b", p, paragraph(rng, 8) + ("." if k == 29 else ""), 100.0 + 20 * k, "") for p in range(60) for k in range(30)]
    lines += [(9000 + p, "b", p, "Contract Law in Practice", 20.0, "") for p in range(60)] + [(9900 + p, "b", p, f"- {p} -", 800.0, "") for p in range(60)]
    df = spark.createDataFrame(lines, LINE)
    seeds = S.edge_keys(df, "book_id", "page", "raw", "y0")
    model = S.learn_furniture(df, seeds, "book_id", "page", "raw", "y0")
    f = S.Furniture(seeds.first()["seeds"].split("\n"), model)
    assert model.trees and f.of(["the creditor explains", "Contract Law in Practicc", "- 12 -", "the liability of it"], 2) == ["", "running_line", "page_number", ""]
    assert f.of(["the creditor", "Contract Law in Practice", "the liability"], 1) == [""] * 3
