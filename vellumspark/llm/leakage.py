"""Problem 7: passages and questions of evaluation items inside a training corpus.

The n-grams of all items are held in a hash set that goes to every executor. Documents are scanned window by window
against it; items with enough hits are verified sentence by sentence: a sentence is held if most of its tokens stand in one
place of the document in nearly the same order. What is common to many items is worked out over all items; items beyond
the size of one block are verified block by block, on those documents alone that one scan with a filter of fixed size let
through. Held passages and questions are cut out of the documents, or the documents dropped.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.session import written

N = 4
SHARED_MOST = 3
BLOCK_TOKENS = 4_000_000  # of items in one block: the bound of what is broadcast
FILTER_BITS = 28  # of the filter that stands for all blocks: 32 MB
DROP_SHARE = 0.5  # of a document's tokens in held passages and questions, from which on it is dropped as a whole
TOKEN = re.compile(r"[a-z0-9]+")
SENTENCE = re.compile(r"(?<=[.!?])[\"”’»)\]]*\s+")
# Joined letters, and what is dropped from words or stands for a blank.
TABLE = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st"}
TABLE |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
TABLE |= dict.fromkeys([0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], " ")
TABLE |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
SPECIAL = re.compile("[" + "".join(map(chr, TABLE)) + "]")
CUT_WORD = re.compile(r"(?<=[a-z])-[ \t]*\n[ \t>|]*(?=[a-z])")
PIECE = re.compile(r"\S+(?:(?<=-)[ \t]*\n[ \t>|]*\S+)*")
# Letters of scripts other than Latin, which only such runs hold as touch no ASCII letter or digit: inside words they are damage.
FAR = re.compile(r"[\u0370-\u1cff\u2c00-\ud7ff\uf900-\ufaff\U00010000-\U0003ffff]")
FAR_RUN = re.compile(r"(?<![a-z0-9])[^\x00-\x7f]{2,}(?![a-z0-9])")
FAR_WORD = re.compile(r"[\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]|[^\W\d_\u0000-\u036f\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
FAR_TOKEN = re.compile(r"[a-z0-9]+|" + FAR_WORD.pattern)
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, N + 1)], np.uint64)

PASSAGE_SHARE, QUESTION_SHARE, SENTENCE_SHARE = 0.42, 0.8, 0.6


def far_words(run: re.Match) -> str:
    """The words of other scripts in a run outside ASCII, if they have two letters or more; ideographs are words each."""
    words = FAR_WORD.findall(run[0])
    return f" {' '.join(words)} " if sum(map(len, words)) >= 2 else ""


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens. Words in ASCII letters lose other characters, so damaged encodings change nothing; words in
    scripts other than Latin are tokens of their own."""
    text = text.lower()
    pattern = TOKEN
    if not text.isascii():
        text = SPECIAL.sub(lambda m: TABLE[ord(m[0])] or "", unicodedata.normalize("NFC", text))
        if FAR.search(text):
            text, pattern = FAR_RUN.sub(far_words, text), FAR_TOKEN
            text = "".join(c for c in text if c.isascii() or FAR.match(c))
            text = re.sub(r"(?<=[a-z0-9])[^\x00-\x7f]+|[^\x00-\x7f]+(?=[a-z0-9])", "", text)
        else:
            text = text.encode("ascii", "ignore").decode("ascii")
    if "-" in text:
        text = CUT_WORD.sub("", text)
    return pattern.findall(text)


def token_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The tokens of ``tokens_of`` and, for each, start and end of the blank-delimited piece of the text it stands in."""
    tokens: list[str] = []
    spans: list[tuple[int, int]] = []
    for m in PIECE.finditer(text):
        here = tokens_of(m[0])
        tokens += here
        spans += [m.span()] * len(here)
    return tokens, spans


def standing_phrases(questions: list[str], least: int = 3) -> set[tuple[str, ...]]:
    """First sentences that open several questions which then go on differently."""
    firsts: Counter = Counter()
    for q in set(questions):
        parts = SENTENCE.split(q.strip())
        if len(parts) > 1:
            firsts[tuple(tokens_of(parts[0]))] += 1
    return {k for k, n in firsts.items() if n >= least}


def bare_question(question: str, standing: set[tuple[str, ...]]) -> list[str]:
    parts = SENTENCE.split(question.strip())
    while len(parts) > 1 and tuple(tokens_of(parts[0])) in standing:
        parts = parts[1:]
    return tokens_of(" ".join(parts))


@dataclass
class Unit:
    """A passage or question that one item or several share."""

    items: list[int]
    is_passage: bool
    sentences: list[np.ndarray]  # token ids
    windows: np.ndarray  # hashes of the n-grams that tell it from others; none of a unit shorter than an n-gram
    size: int


class Items:
    """All items as units, with what depends on all of them: standing phrases, turns of phrase, the rarity of tokens."""

    def __init__(self, items: list[tuple[int, str | None, str | None]]) -> None:
        self.ids: dict[str, int] = {}
        self.units: list[Unit] = []
        standing = standing_phrases([q for _, _, q in items if q])
        shared: dict[tuple, Unit] = {}
        for item, passage, question in items:
            for is_passage, sentences in ((True, [tokens_of(s) for s in SENTENCE.split(passage or "")]), (False, [bare_question(question or "", standing)])):
                sentences = [s for s in sentences if s]
                key = (is_passage, tuple(map(tuple, sentences)))
                if key in shared:  # items with the same passage are one unit
                    shared[key].items.append(item)
                elif sentences:
                    arrays = [np.array([self.ids.setdefault(t, len(self.ids)) for t in s]) for s in sentences]
                    windows = np.unique(np.concatenate([Index.windows(a) for a in arrays]))
                    shared[key] = Unit([item], is_passage, arrays, windows, sum(map(len, sentences)))
                    self.units.append(shared[key])
        every = [u.windows for u in self.units]
        common, times = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.uint64), np.zeros(0))
        common = common[times > SHARED_MOST]
        weight: Counter = Counter()
        for u in self.units:
            # Windows that many items share are turns of phrase and prove nothing, unless an item has hardly any other.
            rare = u.windows[~np.isin(u.windows, common)]
            u.windows = rare if len(rare) >= 4 else u.windows
            weight.update({int(t) for s in u.sentences for t in s})
        # Rarity of a token among the units: words of the shape of a question weigh little, what it is about weighs much.
        self.weight = np.array([np.log(1 + len(self.units) / (1 + weight[t])) for t in range(len(self.ids))]) if self.ids else np.zeros(0)

    def blocks(self, most: int) -> list[Index]:
        """The units in blocks of at most ``most`` tokens, at least one unit each."""
        parts: list[list[Unit]] = [[]]
        held = 0
        for u in self.units:
            if held + u.size > most and parts[-1]:
                parts.append([])
                held = 0
            parts[-1].append(u)
            held += u.size
        return [Index(units, self) for units in parts]

    def filter(self) -> np.ndarray:
        """A bit for every n-gram, at its hash, of all blocks together."""
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for u in self.units:
            at = Index.slot(u.windows)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return bits


class Index:
    """Hash set of the n-grams of a block of units, with what verification needs."""

    def __init__(self, units: list[Unit], of: Items) -> None:
        self.units = units
        names = {int(t) for u in units for s in u.sentences for t in s}
        self.ids = of.ids if len(names) == len(of.ids) else {t: k for t, k in of.ids.items() if k in names}
        self.weight = of.weight
        self.n_grams = np.array([max(1, len(u.windows)) for u in units], np.int64)
        every = np.concatenate([u.windows for u in units]) if units else np.zeros(0, np.uint64)
        own = np.repeat(np.arange(len(units)), [len(u.windows) for u in units]) if units else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.owners = own[order]
        self.hashes, self.first = np.unique(every[order], return_index=True)
        self.last = np.append(self.first[1:], len(every))
        self.short: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # by first token: units shorter than an n-gram
        for k, u in enumerate(units):
            if u.size < N:
                tokens = np.concatenate(u.sentences).tolist()
                self.short[tokens[0]].append((tokens, k))
        self.firsts = np.array(sorted(self.short), np.int64)

    @classmethod
    def over(cls, items: list[tuple[int, str | None, str | None]]) -> Index:
        """One index of all items."""
        every = Items(items)
        return cls(every.units, every)

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    @staticmethod
    def windows(ids: np.ndarray) -> np.ndarray:
        if len(ids) < N:
            return np.zeros(0, np.uint64)
        u = (ids + 1).astype(np.uint64)
        return reduce(np.add, (u[k : len(u) - N + 1 + k] * MULTIPLIERS[k] for k in range(N)))

    @staticmethod
    def known_windows(ids: np.ndarray) -> np.ndarray:
        """Hashes of the n-grams of which every token is one of the items."""
        if len(ids) < N:
            return np.zeros(0, np.uint64)
        known = ids >= 0
        whole = known[: len(ids) - N + 1].copy()
        for k in range(1, N):
            whole &= known[k : len(ids) - N + 1 + k]
        return Index.windows(ids)[whole] if whole.any() else np.zeros(0, np.uint64)

    def hits(self, ids: np.ndarray) -> Counter:
        """Distinct n-grams of each unit that stand in the document."""
        if not len(self.hashes):
            return Counter()
        h = np.unique(self.known_windows(ids))
        at = np.searchsorted(self.hashes, h)
        at = at[(at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h)]
        return Counter(np.concatenate([self.owners[self.first[a] : self.last[a]] for a in at]).tolist()) if len(at) else Counter()

    @staticmethod
    def places(tokens: list[tuple[int, list[int]]], w: np.ndarray, slack: int, least: float) -> list[tuple[float, int]]:
        """(most, diagonal) of every diagonal that a token stands on and that could hold ``least`` of the weight, the most
        first: a token counts where it stands within the slack, whatever its order."""
        off = len(w) + slack
        gain = np.zeros(max(at[-1] for _, at in tokens) + off + slack + 2)
        stood = np.zeros(len(gain), bool)
        for i, at in tokens:
            d = np.array(at) - i + off
            stood[d] = True
            gain[d - slack] += w[i]
            gain[np.minimum(d + slack + 1, np.append(d[1:] - slack, len(gain)))] -= w[i]
        most = np.cumsum(gain) / w.sum()
        d = np.flatnonzero(stood & (most >= least - 1e-9))
        d = d[np.argsort(-most[d], kind="stable")]
        return list(zip(most[d].tolist(), (d - off).tolist()))

    def held(self, sentence: np.ndarray, where: dict[int, list[int]], weighted: bool, least: float = SENTENCE_SHARE) -> tuple[float, tuple[int, int]]:
        """Share of the sentence's tokens that stand in one place of the document in nearly the same order, and first and
        last token of that place; 0 if no place can hold ``least``."""
        tokens = [(i, where[t]) for i, t in enumerate(sentence.tolist()) if t in where]
        if not tokens:
            return 0.0, (0, -1)
        w = self.weight[sentence] if weighted else np.ones(len(sentence))
        best, span = 0.0, (0, -1)
        slack = 2 + len(sentence) // 8
        for most, d in self.places(tokens, w, slack, least):
            if most <= best:
                break
            got = np.zeros(len(sentence), bool)
            last, start = -1, -1
            for i, at in tokens:  # in order, along the diagonal, with some slack for changed words
                lo = max(last + 1, i + d - slack)
                k = bisect_left(at, lo)
                near = -1
                while k < len(at) and at[k] <= i + d + slack:
                    if near < 0 or abs(at[k] - i - d) < abs(near - i - d):
                        near = at[k]
                    k += 1
                if near >= 0:
                    last, got[i] = near, True
                    start = near if start < 0 else start
            share = float(w[got].sum() / w.sum())
            if share > best:
                best, span = share, (start, last)
        return best, span

    def check(self, k: int, where: dict[int, list[int]], question_share: float = QUESTION_SHARE) -> tuple[float, list[tuple[int, int]]]:
        """Of a passage the share of its tokens in held sentences, of a question the weighted share that is held; and where."""
        unit = self.units[k]
        if not unit.is_passage:
            share, span = self.held(unit.sentences[0], where, True, question_share)
            return share, [span]
        held = [(len(x), *self.held(x, where, True)) for x in unit.sentences]
        held = [x for x in held if x[1] >= SENTENCE_SHARE]
        return sum(n * min(1.0, share / 0.95) for n, share, _ in held) / unit.size, [span for *_, span in held]

    def short_hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Units shorter than an n-gram whose tokens stand one after the other, and where."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if len(self.firsts):
            for at in np.flatnonzero(np.isin(ids, self.firsts)).tolist():
                for tokens, k in self.short[int(ids[at])]:
                    if ids[at : at + len(tokens)].tolist() == tokens:
                        found[k].append((at, at + len(tokens) - 1))
        return found

    def scan_tokens(self, tokens: list[str], passage_share: float, question_share: float) -> list[tuple[int, bool, float, list[tuple[int, int]]]]:
        """item, is it a passage, share held, first and last tokens of the places."""
        get = self.ids.get
        ids = np.array([get(t, -1) for t in tokens], np.int64)
        found = [(item, self.units[k].is_passage, 1.0, spans) for k, spans in self.short_hits(ids).items() for item in self.units[k].items]
        where: dict[int, list[int]] | None = None
        for k, n in self.hits(ids).items():
            unit = self.units[k]
            # Half a passage with every eighth word changed keeps a tenth of its windows; so does a changed question.
            if n >= max(2, self.n_grams[k] * 0.12) or n == self.n_grams[k]:
                if where is None:
                    where = defaultdict(list)
                    for j, t in enumerate(ids.tolist()):
                        if t >= 0:
                            where[t].append(j)
                share, spans = self.check(k, where, question_share)
                if share >= (passage_share if unit.is_passage else question_share):
                    found += [(item, unit.is_passage, share, spans) for item in unit.items]
        return found

    def scan(self, text: str, passage_share: float = PASSAGE_SHARE, question_share: float = QUESTION_SHARE) -> list[tuple[int, bool, float, list[tuple[int, int]]]]:
        return self.scan_tokens(tokens_of(text), passage_share, question_share)


def read_items(items: DataFrame) -> Items:
    """The items on the driver: their number is that of test suites, not of documents."""
    rows = items.select("item_id", "passage", "question").where("item_id is not null").distinct().orderBy("item_id", "passage", "question")
    return Items([(r["item_id"], r["passage"], r["question"]) for r in rows.toLocalIterator()])


def let_through(text: DataFrame, every: Items) -> DataFrame:
    """The documents that hold two n-grams of any items, an item's only n-gram, or an item shorter than an n-gram, and
    maybe a few more: one scan for all blocks, with a filter of fixed size."""
    few = [u for u in every.units if len(u.windows) < 2]
    shared = text.sparkSession.sparkContext.broadcast((every.ids, every.filter(), Index(few, every)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, bits, few_index = shared.value
        for b in batches:
            keep = []
            for t in b["text"].tolist():
                ids = np.array([ids_of.get(x, -1) for x in tokens_of(t)], np.int64)
                h = np.unique(Index.known_windows(ids))
                at = Index.slot(h)
                keep.append(int((bits[at >> 3] >> (at & 7) & 1).sum()) >= 2 or bool(few_index.hits(ids)) or bool(few_index.short_hits(ids)))
            yield b[keep]

    return written(text.mapInPandas(run, text.schema))


def probed(docs: DataFrame, id_col: str, text_col: str, every: Items, run_of, schema: str) -> DataFrame:
    """Rows of ``run_of(index)`` over the documents for every block of items."""
    text = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    blocks = every.blocks(BLOCK_TOKENS)
    if len(blocks) > 1:
        text = let_through(text, every)

    def over(block: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        return text.mapInPandas(lambda batches: run_of(shared.value, batches), schema)

    return reduce(DataFrame.unionByName, [over(b) for b in blocks])


def leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, passage_share: float = PASSAGE_SHARE, question_share: float = QUESTION_SHARE) -> DataFrame:
    """id, item_id, part (passage or question), share of every document that holds an item.

    ``items`` has item_id, passage, question; null passages and questions hold nothing, items with the same passage come
    out together; an item of fewer tokens than an n-gram is held where its tokens stand one after the other. Documents
    without text or identifier hold nothing; an empty table gives no rows.
    """

    def run(index: Index, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, item, "passage" if p else "question", x) for i, t in zip(b["id"].tolist(), b["text"].tolist()) for item, p, x, _ in index.scan(t, passage_share, question_share)]
            yield pd.DataFrame(found, columns=["id", "item_id", "part", "share"])

    return probed(docs, id_col, text_col, read_items(items), run, "id bigint, item_id bigint, part string, share double")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the (start, end) given, which may overlap; what stood around a gap is set apart by its line break,
    if there was one, or by a blank."""
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        if a > at:
            out.append(text[at:a])
        at = b
    out.append(text[at:])
    kept = [x.strip() for x in out]
    gaps = ["\n" if "\n" in (x[len(x.rstrip()) :] + y[: len(y) - len(y.lstrip())]) else " " for x, y in zip(out, out[1:])]
    return "".join(x + (g if x else "") for x, g in zip(kept, [*gaps, ""])).strip()


def remove_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, drop_share: float = DROP_SHARE, passage_share: float = PASSAGE_SHARE, question_share: float = QUESTION_SHARE) -> DataFrame:
    """id, n_items, n_spans, removed (share of its tokens), text of every document that holds an item, without the places
    where held sentences and questions stand; text is null where these make up ``drop_share`` or more, and the document is
    dropped as a whole. Documents that are not here stay as they are. Nulls and empty tables are as for ``leaks``."""

    def run(index: Index, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for i, t in zip(b["id"].tolist(), b["text"].tolist()):
                hits = index.scan(t, passage_share, question_share)
                if hits:
                    tokens, places = token_spans(t)
                    hits = index.scan_tokens(tokens, passage_share, question_share) or hits
                    spans = sorted({(places[a][0], places[min(z, len(places) - 1)][1]) for *_, held in hits for a, z in held if a < len(places)})
                    found.append((i, t, [h[0] for h in hits], [{"a": a, "z": z} for a, z in spans]))
            yield pd.DataFrame(found, columns=["id", "text", "items", "spans"])

    hit = probed(docs, id_col, text_col, read_items(items), run, "id bigint, text string, items array<bigint>, spans array<struct<a:int,z:int>>")
    whole = hit.groupBy("id").agg(F.first("text").alias("text"), F.size(F.array_distinct(F.flatten(F.collect_list("items")))).alias("n_items"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, n, spans in zip(b["id"].tolist(), b["text"].tolist(), b["n_items"].tolist(), b["spans"].tolist()):
                left = without_spans(t, [(x["a"], x["z"]) for x in spans])
                removed = 1 - len(tokens_of(left)) / max(1, len(tokens_of(t)))
                rows.append((i, n, len(spans), removed, None if removed >= drop_share else left))
            yield pd.DataFrame(rows, columns=["id", "n_items", "n_spans", "removed", "text"])

    return whole.mapInPandas(cut, "id bigint, n_items int, n_spans int, removed double, text string")
