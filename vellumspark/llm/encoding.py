"""Problem 5: text that was decoded with a wrong character encoding.

Smoothed character n-gram models are trained on the words of all clean records, less those that a first model finds
damaged. Every chain of encoding and decoding again is tried on every word with characters outside ASCII; the likeliest
reading is accepted if it beats the word as it stands by a margin, which is validated on all clean words and on the same
words damaged on purpose. Words are scored once per worker, whole records are rebuilt from their words.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.worker import new_key, per_worker
from vellumspark.session import size_bytes, written

# Encodings as which text is wrongly decoded, and the single-byte ones that the text itself may be in.
WRONG_FOR_UTF8 = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-15"]
WRONG_FOR_CP1252 = ["mac_roman", "cp850", "cp437", "cp1251", "latin-1"]
BLANK = re.compile(r"([ \t\n\r]+)")
NO_BREAK = "\u00a0"
# A word that no clean record should hold: two scripts in one word, a symbol inside a word, a capital with a mark inside.
MIXED = re.compile(
    r"[A-Za-zÀ-ɏ][^\s]*[Ͱ-ӿ]|[Ͱ-ӿ][^\s]*[A-Za-zÀ-ɏ]"
    r"|[^\W\d_][^\x00-\x7f\w’‘‐‑–—…\u00ad\u00a0\u00ac\u200b-\u200d\u2060\ufeff]+[^\W\d_]"
    r"|[a-zß-öø-ÿ][À-ÖØ-Þ][a-zß-öø-ÿ]|[¨¯´¸ˆˇ˘˙˚˛˜˝][^\W\d_]"
)
DEEPEST = 3
LEAST_SHARE = 1e-6  # of all characters: a rarer n-gram is no proof, in the first model, that its word is clean
LEAST_MARGIN, MOST_MARGIN = 1.5, 12.0
MODEL_BYTES = 16_000_000  # of n-grams that are broadcast; beyond that they are joined to the words that ask for them
TASK_WORDS = 2000


@lru_cache(maxsize=None)
def to_bytes(codec: str) -> dict[str, int]:
    """Byte of every character of a code page; undefined bytes stand for the control character of the same number."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


def encoded(word: str, codec: str) -> bytes | None:
    table = to_bytes(codec)
    try:
        return bytes([table[c] for c in word])
    except (KeyError, ValueError):
        return None


@lru_cache(maxsize=None)
def from_bytes(codec: str) -> list[str]:
    back = {b: c for c, b in to_bytes(codec).items()}
    return [back.get(b, chr(b)) for b in range(256)]


def readings(word: str) -> dict[str, str]:
    """Other readings of a word, each with the chain that leads to it, through up to three wrong decodings."""
    found: dict[str, str] = {}
    todo = [(word, "", 0)]
    while todo:
        at, chain, depth = todo.pop()
        for codec in WRONG_FOR_UTF8:
            data = encoded(at, codec)
            if data is None:
                continue
            try:
                text = data.decode("utf-8")
            except UnicodeDecodeError:
                if at[-1:] in ("Ã", "Â") and codec in ("cp1252", "latin-1"):
                    try:  # the no-break space that ended it was turned into a blank, which now stands behind the word
                        text = (data + b"\xa0").decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                else:
                    continue
            if text != at and text not in found:
                found[text] = f"{chain}{codec}>utf-8 "
                if depth + 1 < DEEPEST:
                    todo.append((text, found[text], depth + 1))
        if depth == 0:
            for codec in WRONG_FOR_CP1252:
                data = encoded(at.replace(NO_BREAK, "?"), codec)  # a no-break space by itself is no damage
                if data is not None:
                    text = "".join(c if c == NO_BREAK else from_bytes("cp1252")[b] for c, b in zip(at, data))
                    if text != at and text not in found:
                        found[text] = f"{codec}>cp1252 "
    return found


def damages(word: str) -> list[str]:
    """The word as wrong decodings would show it."""
    out = []
    for codec in WRONG_FOR_UTF8:
        table = from_bytes(codec)
        once = "".join(table[b] for b in word.encode("utf-8"))
        out.append(once)
        if codec == "cp1252":
            out.append("".join(table[b] for b in once.encode("utf-8")))
    data = encoded(word, "cp1252")
    if data is not None:
        out += ["".join(from_bytes(codec)[b] for b in data) for codec in WRONG_FOR_CP1252]
    return [x for x in dict.fromkeys(out) if x != word]


def shape(c: str) -> str:
    if c.isascii():
        return "L" if c.islower() else "U" if c.isupper() else "0" if c.isdigit() else "_" if c == " " else "."
    # Letters by case and script (the block of 128 code points), other characters by block alone.
    return ("l" if c.islower() else "u" if c.isupper() else "s") + ("" if ord(c) < 0x250 else chr(ord(c) >> 7))


SHAPES: dict[str, str] = {}


def shape_of(c: str) -> str:
    s = SHAPES.get(c)
    if s is None:
        s = SHAPES[c] = shape(c)
    return s


def plain(word: str) -> str:
    return " " + re.sub(r"[0-9]", "0", word) + " "


def grams(words: Iterator[tuple[str, int]]) -> Counter:
    """Counts of n-grams of characters (t3, t2, t1) and of shapes (s3) over words with their counts."""
    out: Counter = Counter()
    for word, n in words:
        w = plain(word)
        s = [shape_of(c) for c in w]
        for i in range(1, len(w)):
            a = w[i - 2] if i > 1 else " "
            out["3" + a + w[i - 1 : i + 1]] += n
            out["2" + w[i - 1 : i + 1]] += n
            out["1" + w[i]] += n
            out["s" + "|".join((s[i - 2] if i > 1 else "_", s[i - 1], s[i]))] += n
    return out


def asked(word: str) -> set[str]:
    """Keys of all counts that the scores of a word and of its readings are made of (see ``with_sums``)."""
    keys: set[str] = set()
    others = readings(word)
    for text in (word, *others) if others else ():
        w = plain(text)
        for i in range(1, len(w)):
            a, b, c = w[i - 2] if i > 1 else " ", w[i - 1], w[i]
            s, before = shape_of(c), "s" + "|".join((shape_of(a), shape_of(b)))
            keys |= {"3" + a + b + c, "2" + b + c, "1" + c, before + "|" + s, "c3" + a + b, "c2" + b, "c" + before, "k" + s, "o" + s}
    return keys


def margin_between(top: float, low: float) -> float:
    """The margin over the highest gain of clean words, and as far below the lowest of damaged words as that allows."""
    return float(min(max(LEAST_MARGIN, top + 0.5, (top + low) / 2 if low > top else 0.0), MOST_MARGIN))


@dataclass
class Model:
    """Interpolated character trigrams over a base of shape trigrams. ``table`` has the counts if they are too many for here."""

    log: dict[str, float] = field(default_factory=dict)
    margin: float = 3.0
    table: DataFrame | None = None

    def __post_init__(self) -> None:
        self.counts: dict[str, int] = {}

    @classmethod
    def of(cls, counts: dict[str, int]) -> Model:
        m = cls()
        m.counts = counts
        context: Counter = Counter()
        for k, n in counts.items():
            if k[0] in "32":
                context[k[:-1]] += n
            elif k[0] == "s":
                context[k[: k.rindex("|")]] += n
        m.context = dict(context)
        m.n = sum(n for k, n in counts.items() if k[0] == "1") or 1
        kinds: Counter = Counter()
        of_kind: Counter = Counter()
        for k, n in counts.items():
            if k[0] == "1":
                kinds[shape_of(k[1])] += n
                of_kind[shape_of(k[1])] += 1
        m.kinds, m.of_kind = dict(kinds), dict(of_kind)
        return m

    @classmethod
    def of_rows(cls, rows: dict[str, int]) -> Model:
        """The part of a model that some words ask for, out of rows of ``with_sums``."""
        m = cls()
        m.counts = {k: n for k, n in rows.items() if k[0] in "321s"}
        m.context, m.kinds, m.of_kind = ({k[1:]: n for k, n in rows.items() if k[0] == kind} for kind in "cko")
        return m

    def chance(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        p = self.log.get(key)
        if p is None:
            get, con = self.counts.get, self.context.get
            s = shape_of(c)
            sk = "s" + "|".join((shape_of(a), shape_of(b)))
            base = (get(sk + "|" + s, 0) + 0.02) / (con(sk, 0) + 1.0) * (get("1" + c, 0) + 0.2) / (self.kinds.get(s, 0) + 0.2 * (self.of_kind.get(s, 0) + 40))
            if len(self.log) > 500_000:
                self.log.clear()
            low = (get("2" + b + c, 0) + 6 * base) / (con("2" + b, 0) + 6)
            p = self.log[key] = math.log((get("3" + key, 0) + 4 * low) / (con("3" + a + b, 0) + 4))
        return p

    def score(self, word: str) -> float:
        w = plain(word)
        return sum(self.chance(w[i - 2] if i > 1 else " ", w[i - 1], w[i]) for i in range(1, len(w)))

    def best(self, word: str) -> tuple[float, str, str]:
        """Gain over the word as it stands, likeliest reading, its chain."""
        others = readings(word)
        if not others:
            return -math.inf, word, ""
        here = self.score(word)
        return max((self.score(t) - here, t, chain) for t, chain in others.items())

    def validate(self, clean: list[str]) -> None:
        """Set the margin by clean words at hand; ``validated`` does so for a table of them."""
        false = [g for w in clean if (g := self.best(w)[0]) > -math.inf]
        true = sorted(self.best(d)[0] for w in clean for d in damages(w))
        top = max(false, default=0.0)
        self.margin = margin_between(top, true[int(len(true) * 0.01)] if true else top)


def damaged_for_sure(word: str) -> bool:
    """A word that no clean record should hold: a replacement character, a mixture, or a strict reading as UTF-8."""
    return "\ufffd" in word or MIXED.search(word) is not None or any(">utf-8" in c for c in readings(word).values())


def clean_words(df: DataFrame, texts: list[str]) -> DataFrame:
    """word, n of the records without damage for sure, counted in each map task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sure: dict[str, bool] = {}
        held: Counter = Counter()
        for b in batches:
            for text in b["text"].tolist():
                words = text.replace("\n", " ").replace("\t", " ").split(" ")
                if text.isascii():
                    held.update(words)
                    continue
                for w in words:
                    if not w.isascii() and w not in sure:
                        sure[w] = damaged_for_sure(w)
                if not any(sure.get(w, False) for w in words):
                    held.update(p for w in words for p in ((w,) if len(w) <= 400 else in_parts(w)))
            if len(held) > 400_000:
                yield pd.DataFrame(list(held.items()), columns=["word", "n"])
                held.clear()
        yield pd.DataFrame(list(held.items()), columns=["word", "n"])

    rows = df.select(F.explode(F.array(*[F.col(t) for t in texts])).alias("text")) if len(texts) > 1 else df.select(F.col(texts[0]).alias("text"))
    return rows.where("text is not null").mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


ASCII_PAIR = re.compile(r"[\x00-\x7f](?=[\x00-\x7f])")


def in_parts(w: str) -> list[str]:
    """A word of great length in parts of 300 characters or more, cut between two ASCII characters, where no garbled
    sequence is cut."""
    cuts = [0]
    for m in ASCII_PAIR.finditer(w):
        if m.start() + 1 - cuts[-1] >= 300:
            cuts.append(m.start() + 1)
    return [w[a:b] for a, b in zip(cuts, [*cuts[1:], len(w)])]


def counted(words: DataFrame) -> DataFrame:
    """gram, n over all words with their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            held.update(grams(zip(b["word"].tolist(), b["n"].tolist())))
            if len(held) > 300_000:
                yield pd.DataFrame(list(held.items()), columns=["gram", "n"])
                held = Counter()
        yield pd.DataFrame(list(held.items()), columns=["gram", "n"])

    return written(words.mapInPandas(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))


def with_sums(table: DataFrame) -> DataFrame:
    """The n-grams and, under keys of their own, the sums a model needs: of each context (c), and of each shape its
    characters' occurrences (k) and number (o)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = Model.of(dict(zip(b["gram"].tolist(), b["n"].tolist())))
            rows = [(kind + k, n) for kind, sums in (("c", part.context), ("k", part.kinds), ("o", part.of_kind)) for k, n in sums.items()]
            yield pd.DataFrame(rows, columns=["gram", "n"])

    sums = table.mapInPandas(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return written(table.unionByName(sums))


def model_of(table: DataFrame) -> Model:
    """A model of all n-grams of the table: in memory if they are small, which is measured, else it stays a table."""
    if size_bytes(table) > MODEL_BYTES:
        return Model(table=with_sums(table))
    rows = table.toPandas()
    return Model.of(dict(zip(rows["gram"], rows["n"].astype(int))))


def spread(words: DataFrame) -> DataFrame:
    """``words`` over tasks of some TASK_WORDS each."""
    return words.repartition(max(1, math.ceil(words.count() / TASK_WORDS)), "word")


def scored(words: DataFrame, model: Model) -> DataFrame:
    """word, gain, reading, chain of every word, as ``Model.best`` gives them; without other readings the gain is null.

    With a model that stays a table, the words are dealt into blocks, and each block gets the counts that its words ask for.
    """
    columns, schema = ["word", "gain", "reading", "chain"], "word string, gain double, reading string, chain string"

    def rows(words: list[str], model: Model) -> pd.DataFrame:
        best = [(w, *model.best(w)) for w in words]
        return pd.DataFrame([(w, None if g == -math.inf else g, t, c) for w, g, t, c in best], columns=columns).astype({"gain": "float64"})

    if model.table is None:
        key = new_key()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = per_worker(key, lambda: model)
            for b in batches:
                yield rows(b["word"].tolist(), held)

        return words.mapInPandas(run, schema)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            needs: dict[int, set[str]] = defaultdict(set)
            for w, block in zip(b["word"].tolist(), b["block"].tolist()):
                needs[block] |= asked(w)
            yield pd.DataFrame([(block, k) for block, keys in needs.items() for k in keys], columns=["block", "gram"])

    def one(words: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        return rows(words["word"].tolist(), Model.of_rows(dict(zip(counts["gram"].tolist(), counts["n"].tolist()))))

    many = max(1, math.ceil(words.count() / TASK_WORDS))
    dealt = words.select("word", F.pmod(F.xxhash64("word"), F.lit(many)).alias("block"))
    own = dealt.mapInPandas(ask, "block bigint, gram string").distinct().join(model.table, "gram")
    return dealt.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(one, schema)


def ranked(values: DataFrame, k: int) -> float:
    """The value of rank ``k`` from below, in the one column ``gain``: counted in bins, then in finer ones within one bin, at last by value."""
    for of_bin in (*(F.floor(F.col("gain") * parts) for parts in (1, 1000, 1_000_000)), F.col("gain")):
        for r in values.groupBy(of_bin.alias("bin")).count().orderBy("bin").toLocalIterator():
            if k < r["count"]:
                values = values.where(of_bin == r["bin"])
                break
            k -= r["count"]
    return r["bin"]


def validated(model: Model, clean: DataFrame) -> None:
    """Set the margin of the model by all clean words (``word``) and all their damages, as ``Model.validate`` does."""

    def damage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([d for w in b["word"].tolist() for d in damages(w)], columns=["word"])

    top = scored(clean, model).agg(F.max("gain").alias("gain")).first()["gain"]
    true = written(scored(clean.mapInPandas(damage, "word string"), model).select("gain"))
    n, none = true.count(), true.where("gain is null").count()
    k = int(n * 0.01)
    top = 0.0 if top is None else top
    low = top if n == 0 else -math.inf if k < none else ranked(true.where("gain is not null"), k - none)
    model.margin = margin_between(top, low)


def train(df: DataFrame, text_col: str) -> Model:
    """A model of all clean records of ``df``: all their words, all n-grams.

    Damage that no rule is sure of is still in these records, and would vouch for itself by its own n-grams. A first model,
    which knows frequent n-grams only, finds such words, and they teach the second model nothing. Its margin is validated on
    every word left that has characters outside ASCII.
    """
    words = written(clean_words(df, [text_col]))
    marked = spread(words.where(F.col("word").rlike(r"[^\x00-\x7f]")).select("word"))
    table = counted(words)
    total = table.where(F.col("gram").startswith("1")).agg(F.sum("n").alias("n")).first()["n"] or 0
    first = model_of(written(table.where((F.col("n") > 1) & (F.col("n") >= total * LEAST_SHARE))))
    damaged = written(scored(marked, first).where(F.col("gain") > MOST_MARGIN).select("word"))
    model = model_of(counted(words.join(damaged, "word", "left_anti")))
    validated(model, marked.join(damaged, "word", "left_anti"))
    return model


class Reader:
    """Reads records with a model; words are scored once."""

    def __init__(self, model: Model) -> None:
        self.model, self.seen = model, {}

    def word(self, w: str) -> tuple[float, str, str]:
        hit = self.seen.get(w)
        if hit is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            hit = self.seen[w] = self.model.best(w[:400]) if len(w) <= 400 else self.long(w)
        return hit

    def long(self, w: str) -> tuple[float, str, str]:
        """A word of great length, in whole, through its parts."""
        parts = in_parts(w)
        hits = [self.model.best(p) if not p.isascii() else (-math.inf, p, "") for p in parts]
        good = [h for h in hits if h[0] > self.model.margin]
        return (max(h[0] for h in good), "".join(h[1] if h[0] > self.model.margin else p for h, p in zip(hits, parts)), good[0][2]) if good else (-math.inf, w, "")

    def record(self, text: str) -> tuple[bool, str, str | None]:
        """affected, chains used, restored text (null if a replacement character is left: the original is lost)."""
        parts = BLANK.split(text)
        chains: Counter = Counter()
        lost = False
        weak: list[tuple[int, str, str]] = []
        sums: Counter = Counter()
        for i, w in enumerate(parts):
            if w.isascii():
                continue
            if "\ufffd" in w:
                lost = True
                continue
            gain, reading, chain = self.word(w)
            if gain > self.model.margin:
                parts[i] = reading
                chains[chain.strip()] += 1
            elif gain > 0:
                weak.append((i, reading, chain.strip()))
                sums[chain.strip()] += gain
        if not chains:  # what no word alone proves, several may together
            chains.update(c for c, total in sums.items() if total > 1.5 * self.model.margin)
        for i, reading, chain in weak:  # what one word alone does not prove, the same chain in the record does
            if chain in chains:
                parts[i] = reading
        return bool(chains) or lost, " + ".join([c for c, _ in chains.most_common()] + ["lost"] * lost), None if lost else "".join(parts)


class Decided:
    """Stands for a model where the words of a record have been scored before."""

    def __init__(self, margin: float, hits: dict[str, tuple[float, str, str]]) -> None:
        self.margin, self.hits = margin, hits

    def best(self, word: str) -> tuple[float, str, str]:
        return self.hits.get(word, (-math.inf, word, ""))


def with_scores(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (id, text) with the words each asks for that another reading is likelier of, as parallel arrays."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b["id"].tolist(), b["text"].tolist()):
                words = {w for w in BLANK.split(text) if not w.isascii() and "\ufffd" not in w}
                out += [(i, p) for p in {p for w in words for p in ((w,) if len(w) <= 400 else in_parts(w))} if not p.isascii()]
            yield pd.DataFrame(out, columns=["id", "word"])

    need = written(rows.mapInPandas(ask, "id bigint, word string").distinct())
    better = scored(need.select("word").distinct(), model).where("gain > 0")
    own = need.join(better, "word").groupBy("id").agg(F.collect_list(F.struct("word", "gain", "reading", "chain")).alias("h"))
    return rows.join(own, "id", "left").select("id", "text", *(F.col(f"h.{c}").alias(c) for c in ("word", "gain", "reading", "chain")))


def repair(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """id, chain, original, restored of every affected record.

    Records without text or identifier and records in pure ASCII (the filter runs in the scan stage) are never affected;
    a record delivered again comes out once; ``restored`` is null where the original cannot be had. Only distinct
    affected records are shuffled, but with a model that stays a table all that are not in ASCII.
    """
    schema = "id bigint, chain string, original string, restored string"
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]"))

    def found(read: Iterator[tuple[int, str, Reader]]) -> pd.DataFrame:
        hits = [(i, text, *reader.record(text)) for i, text, reader in read]
        return pd.DataFrame([(i, chain, text, restored) for i, text, hit, chain, restored in hits if hit], columns=["id", "chain", "original", "restored"])

    if model.table is None:
        key = new_key()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = per_worker(key, lambda: Reader(model))
            for b in batches:
                yield found((i, text, reader) for i, text in zip(b["id"].tolist(), b["text"].tolist()))

        return rows.mapInPandas(run, schema).dropDuplicates(["id"])
    margin = model.margin

    def run_decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = ({} if w is None else {k: (g, t, c) for k, g, t, c in zip(w, gain, to, chain)} for w, gain, to, chain in zip(*(b[c].tolist() for c in ("word", "gain", "reading", "chain"))))
            yield found((i, text, Reader(Decided(margin, hits))) for i, text, hits in zip(b["id"].tolist(), b["text"].tolist(), own))

    return with_scores(rows, model).mapInPandas(run_decided, schema).dropDuplicates(["id"])
