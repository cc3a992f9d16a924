import random

from vellumspark.llm import leakage

rng = random.Random(5)
NOUNS = [a + b for a in ("lawn", "brick", "cloud", "fern", "glass", "hinge", "lamp", "mast", "nail", "oar") for b in ("smith", "work", "line", "mark", "wood", "stone")]


def sentence(n=12):
    return " ".join(rng.choice(NOUNS) for _ in range(n)).capitalize() + "."


PASSAGES = [" ".join(sentence() for _ in range(6)) for _ in range(8)]
QUESTIONS = [f"Read the text and answer. Why does the {rng.choice(NOUNS)} of {rng.choice(NOUNS)} near {rng.choice(NOUNS)} fail to reach the {rng.choice(NOUNS)} before the {rng.choice(NOUNS)}?" for _ in range(8)]
ITEMS = [(100 + i, "s", p, q, None) for i, (p, q) in enumerate(zip(PASSAGES, QUESTIONS))] + [(200, "s", PASSAGES[0], None, None), (201, "s", None, None, "x")]


def find(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, suite string, passage string, question string, answer string")
    df = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in docs], "doc_id bigint, text string, part string, share double")
    return {(r["id"], r["item_id"]) for r in leakage.leaks(df, "doc_id", "text", items).collect()}


def test_leaks(spark):
    filler = lambda: " ".join(sentence() for _ in range(5))
    s = [p.split(". ") for p in PASSAGES]
    docs = [
        (1, filler() + " " + PASSAGES[0] + " " + filler()),  # whole; its twin item comes too
        (2, ". ".join(s[1][:3]) + ". " + filler() + " " + s[1][4] + "."),  # most of it, with text between
        (3, s[2][0] + ". " + filler()),  # one sentence only
        (4, ". ".join(reversed(s[3]))),  # another order
        (5, filler() + " Read the text and answer. " + QUESTIONS[4].split(". ")[1]),
        (6, "Read the text and answer. Why does the moon of cheese near Paris fail to reach the sky before the rain?"),  # the same shape
        (7, filler()), (8, None), (9, ""), (10, PASSAGES[5].upper().replace(" ", "\n\n")), (11, " ".join(filler() for _ in range(800)) + PASSAGES[6]), (None, PASSAGES[7]),
    ]
    assert find(spark, docs) == {(1, 100), (1, 200), (2, 101), (4, 103), (5, 104), (10, 105), (11, 106)}


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_TOKENS", 150)
    assert find(spark, [(1, PASSAGES[0]), (2, PASSAGES[7])]) == {(1, 100), (1, 200), (2, 107)}


def test_empty(spark):
    items = spark.createDataFrame([], "item_id bigint, passage string, question string")
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    assert leakage.leaks(docs, "doc_id", "text", items).count() == 0
    assert find(spark, [(1, "x")]) == set()


def test_damaged_encoding_and_layout_change_nothing():
    assert leakage.tokens_of("Keldúñez’s ﬁne con-\ntract") == leakage.tokens_of("KeldÃºÃ±ezâ€™s fine contract")


def test_every_place_is_checked():
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"][:14]
    q = " ".join(words)
    index = leakage.Index.over([(1, None, q)])
    false = " ".join(" ".join(words[k : k + 4]) + " x" * 40 for k in (0, 3, 6, 9) * 20)  # stronger than the true place has it
    true = " ".join(f"{w} y" if k % 4 == 3 else w for k, w in enumerate(words))  # inserted words split its votes
    for text in (f"{false} {true}", f"{true} {false}"):
        assert [(i, s) for i, _, s, _ in index.scan(text, 0.42, 0.8)] == [(1, 1.0)]


def test_results_do_not_depend_on_blocks():
    items = [(i, None, f"Think about the matter at length. Why is the {a} {b} so {c}?") for i, (a, b, c) in enumerate(zip(NOUNS, NOUNS[7:], NOUNS[13:]))]
    every = leakage.Items(items)
    blocks = every.blocks(30)
    assert len(blocks) > 3
    text = "Think about the matter at length. " + items[3][2] + " More. " + items[20][2]
    want = {x[0] for x in leakage.Index.over(items).scan(text)}
    assert {x[0] for b in blocks for x in b.scan(text)} == want == {3, 20}


def test_short_items_and_other_scripts(spark):
    items = spark.createDataFrame([(1, None, "What is DNA?"), (2, "Москва стоит на семи холмах у реки. Её стены из белого камня помнят многих князей.", None), (3, None, "水は何度で沸騰しますか"), (4, "x", "?")], "item_id bigint, passage string, question string")
    docs = [(1, "Ask: what is DNA? It is a molecule."), (2, "What DNA is"), (3, "Текст. МОСКВА стоит на семи холмах у реки. Её стены из белого камня помнят многих князей! Далее."), (4, "Москва далеко"), (5, "問題：水は何度で沸騰しますか。"), (6, "水は冷たい")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {(r["id"], r["item_id"]) for r in leakage.leaks(df, "doc_id", "text", items).collect()} == {(1, 1), (3, 2), (5, 3)}


def test_removal(spark, monkeypatch):
    own = sentence(60), sentence(60)
    items = spark.createDataFrame(ITEMS, "item_id bigint, suite string, passage string, question string, answer string")
    docs = [(1, f"{own[0]}\n\n{PASSAGES[0]}\n\n{own[1]} {sentence(60)}"), (2, PASSAGES[1]), (3, own[0]), (4, None), (5, ""), (6, f"{own[0]} {QUESTIONS[2]} {own[1]}"), (7, "Out of place: " + PASSAGES[3].replace(" ", "-\n", 1) + " " + own[0] * 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for most in (leakage.BLOCK_TOKENS, 150):
        monkeypatch.setattr(leakage, "BLOCK_TOKENS", most)
        got = {r["id"]: r for r in leakage.remove_leaks(df, "doc_id", "text", items).collect()}
        assert set(got) == {1, 2, 6, 7} and got[1]["n_items"] == 2 and got[2]["text"] is None and got[2]["removed"] > 0.9
        assert got[1]["text"].startswith(own[0] + "\n" + own[1])
        assert got[6]["text"].startswith(own[0]) and got[6]["text"].endswith(own[1]) and QUESTIONS[2].split(". ")[1] not in got[6]["text"]
        assert got[7]["text"].startswith("Out of place:") and PASSAGES[3].split(". ")[1] not in got[7]["text"]
        again = spark.createDataFrame([(i, r["text"]) for i, r in got.items() if r["text"]], "doc_id bigint, text string")
        assert leakage.leaks(again, "doc_id", "text", items).count() == 0


def test_tokens_and_their_places_agree():
    text = "Keldúñez’s ﬁne con-\n  tract, «Привет мир» 東京 x\u00a0y a-\nb"
    tokens, places = leakage.token_spans(text)
    assert tokens == leakage.tokens_of(text) and all(a < b for a, b in places)
