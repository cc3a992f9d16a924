import unicodedata
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from vellumspark.llm import terms

SCHEMA = "block_id bigint, clean string, term string, ids int, n int"


def brute(rows):
    """Terms by walking over characters, each id once."""
    occ, df = Counter(), Counter()
    for _, text in sorted({i: t for i, t in rows if i is not None and t is not None}.items()):
        words, cur = [], ""
        for ch in unicodedata.normalize("NFKC", "".join(c for c in text if c not in "­​‌‍⁠﻿")).lower() + " ":
            if ch.isalnum():
                cur += ch
            elif cur:
                words.append(cur)
                cur = ""
        occ.update(words)
        df.update(set(words))
    return {t: (occ[t], df[t]) for t in df}


def test_against_brute_force(spark):
    rows = [(1, "Alpha beta, ALPHA ﬁne"), (2, "alpha­bet ２ x²"), (2, "alpha­bet ２ x²"), (3, None), (None, "lost"), (4, ""), (5, "  --- "), (70000, "alpha " * 30000), (6, "Été éte")]
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], SCHEMA).repartition(4)
    got = {r["term"]: (r["n_occurrences"], r["n_records"]) for r in terms.term_frequencies(df, "block_id", "clean").collect()}
    assert got == brute(rows)


def test_marks_count_records_without_text(spark):
    rows = [(i, "all " + ("half" if i % 2 else "") + (" few" if i < 3 else " some" if i < 6 else "")) for i in range(40)] + [(i, None) for i in range(40, 400)]
    df = spark.createDataFrame(rows, "block_id bigint, clean string")
    got = {r["term"]: r["mark"] for r in terms.mark_terms(df, "block_id", "clean").collect()}
    assert got == {"all": "common", "half": None, "few": None, "some": None} | {"few": None}
    rare = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "a")] + [(i, None) for i in range(4, 90)], "block_id bigint, clean string")
    assert {r["term"]: r["mark"] for r in terms.mark_terms(rare, "block_id", "clean").collect()} == {"a": None, "b": "rare"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "block_id bigint, clean string")
    assert terms.mark_terms(df, "block_id", "clean").count() == 0


@given(st.lists(st.lists(st.integers(0, 65535), min_size=1, max_size=50, unique=True), min_size=1, max_size=4))
def test_union_of_containers(parts):
    ids = [terms.pack_ids(np.array(sorted(p))) for p in parts]
    counts = [terms.pack_counts(np.array([x % 300 + 1 for x in sorted(p)])) for p in parts]
    n, occ, packed, _ = terms.union(ids, counts)
    every = sorted(set().union(*parts))
    assert (n, occ, terms.unpack_ids(packed).tolist()) == (len(every), sum(x % 300 + 1 for x in every), every)


def test_large_containers_become_bitmaps():
    a = np.arange(0, 65536, 3)
    assert len(terms.pack_ids(a)) == 8193 and (terms.unpack_ids(terms.pack_ids(a)) == a).all()


def test_flush_in_between(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(terms, "FLUSH_POSTINGS", 1)
    out = pd.concat(terms.build_postings(iter([pd.DataFrame({"rid": [1, 2], "text": ["a a b", "b"]}), pd.DataFrame({"rid": [3], "text": ["a"]})])))
    assert sorted(zip(out["term"], out["n"], out["occ"])) == [("a", 1, 1), ("a", 1, 2), ("b", 2, 2)]
