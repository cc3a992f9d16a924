import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumspark.llm import split


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n,#-é", max_size=400), st.integers(20, 90), st.integers(0, 15))
def test_pieces_cover_the_text(text, room, overlap):
    out = split.cuts(text, room, overlap)
    assert out[0][0] == 0 and out[-1][1] == len(text)
    assert all(0 <= b - a <= room for a, b in out)
    for (a, b), (c, d) in zip(out, out[1:]):
        assert a < c <= b < d and b - c <= overlap


@given(st.lists(st.integers(0, 7), min_size=1, max_size=60), st.data())
def test_range_maximum(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    best = max(range(lo, hi + 1), key=lambda i: (values[i], i))
    assert split.RangeMax(np.array(values, np.int8)).query(lo, hi) == best


def test_cut_at_the_strongest_boundary():
    text = "One sentence here. " * 30 + "\n\n" + "Another part of it. " * 30
    (a, b), (c, _) = split.cuts(text, 700, 100)[:2]
    assert text[:b].endswith("\n\n") and 75 <= b - c <= 100 and text[c : c + 7] in ("One sen", "senten") or text[c - 1].isspace()


def test_no_boundary_at_all():
    out = split.cuts("x" * 1000, 300, 50)
    assert all(b - a <= 300 for a, b in out) and out[1][0] == out[0][1] - 50


SCHEMA = "block_id bigint, clean string, heading_path array<string>, piece string, id int"


def rows(spark, data):
    return spark.createDataFrame([(i, t, h, "clash", 3) for i, t, h in data], SCHEMA)


def test_oversized(spark):
    exact, over = "w " * 1099 + "wx", "w " * 1099 + "wxy"
    data = [(1, exact, None), (2, over, None), (3, exact, ["A", "B"]), (4, "  " + exact + " \n", []), (5, None, ["A"]), (6, "", None), (2, over, None), (None, over, None), (7, "z" * 200_000, ["H" * 5000]), (8, "a" * 2195 + " b", [None, "x"])]
    out = split.split_oversized(rows(spark, data), "block_id", "clean", "heading_path").collect()
    assert {r["id"] for r in out} == {2, 3, 7, 8}
    assert all(len(r["piece"]) <= 2200 for r in out)
    assert all(r["piece"].startswith("A > B\n") for r in out if r["id"] == 3)
    seven = sorted((r["piece_no"], r["start"], r["end"]) for r in out if r["id"] == 7)
    assert seven[0][1] == 0 and seven[-1][2] == 200_000 and [p[0] for p in seven] == list(range(1, len(seven) + 1))
    assert split.split_oversized(rows(spark, data).where("false"), "block_id", "clean", "heading_path").count() == 0


def test_stretches_change_nothing(monkeypatch):
    text = ("Some words here, and more; then a stop. Next\n\n" * 400)[:15_000]
    want = split.cuts(text, 700, 90)
    monkeypatch.setattr(split, "STRETCH", 50)
    assert split.cuts(text, 700, 90) == want and len(want) > 20
