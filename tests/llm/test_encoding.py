import pytest

from vellumspark.llm import encoding as E

WORDS = "für Größe über nähere Verbindung größtenteils mesurés étudiés près après même côté déjà añade montañas relación señalada según también Müller Brême Søren Håkon – ‰ °C “so” l’été niño".split()
PLAIN = "the rule for patents is plain and some courts need it because every lease was read again in most cases 1804 2,408 km".split()


@pytest.fixture(scope="module")
def model(spark):
    lines = [" ".join([PLAIN[(i + k) % len(PLAIN)] for k in range(5)] + [WORDS[(i * 3 + k) % len(WORDS)] for k in range(4)]) for i in range(600)]
    lines += ["SÃO MAÇÃ E ÂNGELA", "√42 = ± x · ©", "ГРЁМОВ И ЛУНСКИЙ, 9", "│ 1 │ ├── n", "L’Âge – À LIRE", "(cid:9) leaf"] * 20
    return E.train(spark.createDataFrame([(x,) for x in lines], "raw string"), "raw")


SENTENCE = "Peu de cas étudiés à côté – für größtenteils"


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
def test_round_trip_of_utf8(model, codec):
    table = E.from_bytes(codec)
    damaged = "".join(table[b] for b in SENTENCE.encode())
    hit, _, restored = E.Reader(model).record(damaged)
    assert hit and restored == SENTENCE


def test_round_trip_twice(model):
    t = E.from_bytes("cp1252")
    once = "".join(t[b] for b in SENTENCE.encode())
    hit, chain, restored = E.Reader(model).record("".join(t[b] for b in once.encode()))
    assert hit and restored == SENTENCE and chain.count("utf-8") >= 2


@pytest.mark.parametrize("codec", ["mac_roman", "cp1251"])
def test_round_trip_of_single_bytes(model, codec):
    text = "über nähere Größe mesurés après montañas"
    damaged = "".join(E.from_bytes(codec)[b] for b in text.encode("cp1252"))
    hit, _, restored = E.Reader(model).record(damaged)
    assert hit and restored == text


@pytest.mark.parametrize("text", ["SÃO MAÇÃ E ÂNGELA", "√77 = ± x · ©", "ГРЁМОВ И ЛУНСКИЙ, 3", "│ 5 │ ├── n", "(cid:77) leaf", "für nähere Größe", "plain text", "", "   "])
def test_correct_text_is_left_alone(model, text):
    assert E.Reader(model).record(text)[0] is False


def test_lost_characters(model):
    assert E.Reader(model).record("pr�s de") == (True, "lost", None)


def test_repair(spark, model):
    bad = "".join(E.from_bytes("cp1252")[b] for b in "montañas".encode())
    rows = [(1, bad), (1, bad), (2, "montañas"), (3, None), (None, bad), (4, ""), (5, "x " * 50_000 + bad), (6, bad * 200)]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "line_id bigint, raw string, chain string, id string")
    got = {r["id"]: r["restored"] for r in E.repair(df, "line_id", "raw", model).collect()}
    assert set(got) == {1, 5, 6} and got[1] == "montañas" and got[5].endswith("montañas")
    assert E.repair(df.where("false"), "line_id", "raw", model).count() == 0


def test_training_on_nothing(spark):
    empty = E.train(spark.createDataFrame([], "raw string"), "raw")
    assert E.Reader(empty).record("abc")[0] is False


def test_margin_is_validated_on_all_words(monkeypatch):
    m, asked = E.Model(), set()
    monkeypatch.setattr(m, "best", lambda w: asked.add(w) or (1.0, w, ""), raising=False)
    words = sorted(f"wört{i}" for i in range(700))
    m.validate(words)
    assert {d for w in words for d in E.damages(w)} <= asked


@pytest.mark.parametrize("before", range(296, 302))
def test_long_words_are_not_cut_inside_damage(model, before):
    word = "x" * before + "für" + "y" * 300
    bad = "x" * before + "".join(E.from_bytes("cp1252")[b] for b in "für".encode()) + "y" * 300
    assert E.Reader(model).record(bad)[::2] == (True, word)


DAMAGED = ("“so”", "°C", "été")


def damaged_corpus(spark):
    """Clean lines, and three words that are damaged so that no rule is sure of it."""
    lines = [" ".join(WORDS[(i * 3 + k) % len(WORDS)] + "abcdefgh"[i % 8] * (k == 0) for k in range(5)) for i in range(900)]
    bad = ["".join(E.from_bytes("mac_roman")[b] for b in w.encode("cp1252")) for w in DAMAGED]
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines + [f"plain {w} case" for w in bad])], "line_id bigint, raw string"), bad


def test_margin_is_that_of_all_words_and_ngrams(spark):
    df, bad = damaged_corpus(spark)
    words = {r["word"]: r["n"] for r in E.clean_words(df, ["raw"]).collect()}
    clean = {w: n for w, n in words.items() if w not in bad}
    alone = E.Model.of(E.grams(clean.items()))
    alone.validate(sorted(w for w in clean if not w.isascii()))
    model = E.train(df, "raw")
    assert set(bad) <= set(words) and model.counts == alone.counts
    assert model.margin == pytest.approx(alone.margin)


def test_words_seen_once_count(spark):
    rows = [("für Größe",)] * 40 + [("Ångström",)]
    model = E.train(spark.createDataFrame(rows, "raw string"), "raw")
    assert model.counts["3Ång"] == 1


def test_damage_does_not_vouch_for_itself(spark):
    df, bad = damaged_corpus(spark)
    got = {r["original"]: r["restored"] for r in E.repair(df, "line_id", "raw", E.train(df, "raw")).collect()}
    assert got == {f"plain {w} case": f"plain {t} case" for w, t in zip(bad, DAMAGED)}


def test_models_that_stay_tables_give_the_same(spark, monkeypatch):
    df, _ = damaged_corpus(spark)
    once = "".join(E.from_bytes("cp1252")[b] for b in "montañas".encode())
    more = spark.createDataFrame([(2000, once * 70 + " x"), (2001, "pr�s " + once), (2001, "pr�s " + once), (2002, "\r" + once)], "line_id bigint, raw string")
    df = df.unionByName(more)
    model = E.train(df, "raw")
    rows = {tuple(r) for r in E.repair(df, "line_id", "raw", model).collect()}
    monkeypatch.setattr(E, "MODEL_BYTES", -1)
    monkeypatch.setattr(E, "TASK_WORDS", 20)
    table = E.train(df, "raw")
    assert table.table is not None and table.margin == pytest.approx(model.margin)
    assert {tuple(r) for r in E.repair(df, "line_id", "raw", table).collect()} == rows and len(rows) > 3


def test_rank_is_exact(spark):
    values = sorted([-3.5, -3.4999, 0.0, 0.25, 0.25, 0.2501, 7.0, 7.0000005])
    df = spark.createDataFrame([(v,) for v in values], "gain double")
    assert [E.ranked(df, k) for k in range(len(values))] == pytest.approx(values, abs=1e-9)
