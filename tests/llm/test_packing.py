from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from vellumspark.llm import packing


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=12))
def test_plan_uses_every_item_once(histogram):
    used: Counter = Counter()
    for times, taken in packing.plan(histogram, 40):
        assert sum(k * n for k, n in taken.items()) <= 40
        used.update({k: n * times for k, n in taken.items()})
    assert dict(used) == histogram


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(1, 60))
def test_fullest_is_optimal(items, room):
    counts = Counter(items)
    taken = packing.fullest(sorted(counts, reverse=True), counts, room)
    best = max(sum(c) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= room)
    assert sum(k * n for k, n in taken.items()) == best and all(n <= counts[k] for k, n in taken.items())


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 7)  # so that one length is spread over several buckets
    texts = ["word " * 3] * 50 + ["word " * 900, "word " * 5000, None, "", "   ", "é" * 100] + [f"text number {i} " * (i % 9 + 1) for i in range(60)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, container string, length int").repartition(3)
    out = packing.pack(df, "doc_id", "text", 512).toPandas().rename(columns={"id": "doc_id"})
    out["n"] = out.token_to - out.token_from
    size = out.groupby("container").n.sum()
    assert size.max() <= 512 and set(size.index) == set(range(len(size)))
    assert len(size) <= -(-out.n.sum() // 512) + 1
    assert set(out.doc_id) == set(range(len(texts)))
    long = out[out.doc_id == 51].sort_values("piece_no")
    assert long.token_from.tolist() == [512 * k for k in range(len(long))] and (long.n[:-1] == 512).all()
    enc = packing.encoder(packing.TOKENIZER)
    totals = out.groupby("doc_id").n.sum()
    assert all(totals[i] == (len(enc.encode_ordinary(t)) if t else 0) for i, t in enumerate(texts))
    assert out[~out.doc_id.isin([50, 51])].groupby("doc_id").size().max() == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(df, "doc_id", "text").count() == 0
