"""Problem 3: noise in text from scanned pages.

Words cut at line ends, misread characters, running lines and page numbers are found and repaired. One pass over all texts
counts words and collects what is in question: distinct words, cut pairs, numbers with letters. Words in question meet the
words of the whole collection in an inverted join on character q-grams; boosted trees rank the candidates. Boosted
classifiers over line pairs decide whether a cut word is joined or a compound keeps its hyphen, and whether a line between
two others is furniture. The decisions, not the vocabulary, go back to the texts. The classifiers are trained on words and
pages of the collection, a bounded number of them; counts, candidates and decisions cover all.
"""

from __future__ import annotations

import base64
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.boosting import Boosted
from vellumspark.llm.encoding import MIXED, readings
from vellumspark.llm.repeated import PAGE_SET, edits, key_of, keyed, pieces_of
from vellumspark.llm.worker import new_key, per_worker
from vellumspark.session import join_measured, size_bytes, written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LEAST_COUNT = 15  # of a word of the vocabulary; what is rarer tells nothing and counts as unseen
UNSEEN_SHARE = 5.8e-6  # of all words; a form that is rarer counts as unseen when it is judged, at every size of the collection
SAMPLE_WORDS = 50_000  # most frequent words, which the models are trained on
SAMPLE_PAGES = 400  # pages, picked by hash, which the classifier of furniture is trained on
TRAINING_WORDS = 1500
BROADCAST_BYTES = 48_000_000  # of decisions or edge keys; beyond that they are joined to the records that ask for them
LEAST_TAUGHT = 40
ACCEPT = 0.3
ALONE_SHARE = 0.5  # of the occurrences of a word of up to three letters; parts of words seldom stand alone
RARER, RARER_MARKS = 12, 5  # times that a misread word, or a misread number or cut compound, is rarer than its right form
BAND, EDGE_SHARE = 0.05, 0.6
HYPHENS = "-\u2010\u2011\u00ad\u00ac"
RUN = re.compile(r"[^\W_]+")
# A word of two or three letters between blanks; what follows a hyphen and a blank is the rest of a cut word.
ALONE = re.compile(rf"(?<![{HYPHENS}]\s)(?<![^\s(\"'“„«\[])[^\W\d_]{{2,3}}(?=[.,;:!?)\"'”“»\]]*(?:\s|$))")
COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
TOKEN = re.compile(r"\S+")
CUT = re.compile(rf"[{HYPHENS}][ \t]*\n[ \t]*(?=[^\W_])")
CUT_BLANK = re.compile(rf"[{HYPHENS}][ \t\n]+(?=[^\W_])")
NEXT_PART = re.compile(r"\S+")
LEADS = "ÃÂ"  # before a soft hyphen these are one damaged letter, not a cut word
INNER = re.compile(rf"([^\W\d_]+)(?<![{LEADS}])[{HYPHENS}]([^\W\d_]+)")
INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st"}
PAGE_NUMBER = re.compile(r"[\W_]*(?:(?P<word>[^\W\d_]{1,8}?)(?:[.:]\s*|\s+))?(?P<n>\d{1,5}|[ivxlcIVXLC]+)[\W_]*")
# Characters that scans take for one another, in both directions.
LOOKS = "0-o 1-l 1-i |-l |-i |-1 !-l !-i 5-s 6-b 8-b 9-g 9-q 2-z c-e n-u f-t h-b i-l i-j g-q rn-m ii-u vv-w cl-d li-h nn-m lc-k fi-h".split()
# Words that only sentences in German, French or Spanish hold.
FOREIGN = frozenset(
    (
        "der die das und nach für nicht wurden werden sind mit von bei als zwischen keine wird ist ohne auch zu den dem "
        "le les des et est une pour dans avec sur chez du aux au sont entre sans selon très ce peu "
        "el los las una con para según y del por que muestran hoy cuando sin pocos este más se como año"
    ).split()
)
SENTENCE = re.compile(r"(?<=[.!?:;])\s+")
DIGIT_OF = {"l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "b": "6", "G": "6", "Z": "2", "z": "2", "g": "9", "q": "9"}
NUMBER = re.compile(r"[±<>≤≥~]?[\dlIi|!OoSsBbGZzgq]+(?:[.,–:;/-][\dlIi|!OoSsBbGZzgq]+)*%?")

PAIRS: dict[str, set[str]] = defaultdict(set)
for _pair in LOOKS:
    _a, _b = _pair.split("-")
    PAIRS[_a].add(_b)
    PAIRS[_b].add(_a)


def _classes() -> dict[str, str]:
    """Every character that looks like another, with the one that stands for all that are linked by likeness."""
    stands: dict[str, str] = {}
    for a in sorted(x for x in PAIRS if len(x) == 1):
        todo = [a]
        while todo:
            c = todo.pop()
            if c not in stands:
                stands[c] = stands.get(a, a)
                todo += [x for x in PAIRS[c] if len(x) == 1]
    return stands


FOLD = str.maketrans(_classes())


def confusions(seen: str, word: str, most: int = 2) -> int | None:
    """Least number of known confusions by which ``word`` is read as ``seen``; null if more than ``most``, or any other
    change, is needed."""
    n, m, best = len(seen), len(word), None
    todo = [(0, 0, 0)]
    while todo:
        i, j, k = todo.pop()
        while True:
            if k < most:
                for a, b in ((1, 1), (1, 2), (2, 1)):
                    if word[j : j + b] in PAIRS.get(seen[i : i + a], ()):
                        todo.append((i + a, j + b, k + 1))
            if i < n and j < m and seen[i] == word[j]:
                i, j = i + 1, j + 1
            else:
                break
        if i == n and j == m and (best is None or k < best):
            best = k
    return best


def look_cost(seen: str, word: str, most: float = 2.6) -> float:
    """Least cost to read ``word`` as ``seen``: 0.4 for a known confusion (up to two characters on either side), 1 for
    any other change; above ``most`` it is not worked out."""
    n, m = len(seen), len(word)
    if abs(n - m) > 3:
        return 9.0
    d = [[9.0] * (m + 1) for _ in range(n + 1)]
    d[0] = [float(j) for j in range(m + 1)]
    for i in range(1, n + 1):
        row, before = d[i], d[i - 1]
        row[0] = float(i)
        low = row[0]
        for j in range(max(1, i - 3), min(m, i + 3) + 1):
            a, b = seen[i - 1], word[j - 1]
            x = before[j - 1] + (0.0 if a == b else 0.4 if b in PAIRS.get(a, ()) else 1.0)
            y = min(before[j], row[j - 1]) + 1.0
            x = min(x, y)
            if i > 1 and b in PAIRS.get(seen[i - 2 : i], ()):
                x = min(x, d[i - 2][j - 1] + 0.4)
            if j > 1:
                two = word[j - 2 : j]
                if two in PAIRS.get(a, ()):
                    x = min(x, before[j - 2] + 0.4)
                if i > 1 and two in PAIRS.get(seen[i - 2 : i], ()):
                    x = min(x, d[i - 2][j - 2] + 0.4)
            row[j] = x
            low = min(low, x)
        if low > most and min(before) > most:
            return 9.0
    return d[n][m]


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    from vellumspark.llm.packing import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vellum-multi", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Words:
    """What is known of words from a sample of them: counts, and which are words of a language rather than names or coined
    terms. Public tokenizers hold long pieces of real words only, so pieces a letter give first labels, from which a naive
    Bayes model over character n-grams is trained and trained again on its own labels."""

    def __init__(self, rows: list[tuple[str, int, int, int]], tokenizer: str, alone: dict[str, int] | None = None) -> None:
        self.tokenizer = tokenizer
        self.n = {w: n for w, n, _, _ in rows}
        alone = Counter(alone or {})
        for w, n in self.n.items():
            if "-" in w and self.n.get(w.replace("-", ""), 0) < RARER_MARKS * n:  # parts of compounds are words too
                alone.update({part: n for part in w.split("-")})
        plain = [(w, n, c / n, f / n) for w, n, c, f in rows if w.isalpha()]
        pieces = {w: self.pieces(w) for w, *_ in plain}
        real = [w for w, _, c, _ in plain if (pieces[w] <= 0.25 and len(w) >= 4) or (pieces[w] <= 0.34 and c < 0.3 and len(w) <= 6)]
        other = [w for w, _, c, _ in plain if (pieces[w] >= 0.34 and len(w) >= 9 and c < 0.3) or (pieces[w] >= 0.42 and c > 0.95 and len(w) >= 6)]
        self.llr, self.unseen = {}, 0.0
        # A collection without a stock of both kinds teaches no model; there the pieces a letter decide.
        self.taught = min(len(real), len(other)) >= LEAST_TAUGHT
        if self.taught:
            self._count(real, other)
        for _ in range(2 if self.taught else 0):
            score = {w: self.score(w) for w, *_ in plain}
            self._count([w for w in score if score[w] > -4 and len(w) >= 4], [w for w in score if score[w] <= -4 and len(w) >= 5])
        self.real = {w: n for w, n, c, f in plain if self.is_real(w, n, c, f, alone[w])}

    def pieces(self, word: str) -> float:
        encode = encoder(self.tokenizer).encode_ordinary
        return min(len(encode(" " + word)), len(encode(" " + word.capitalize()))) / len(word)

    def is_real(self, word: str, n: int, capital: float, foreign: float, alone: int) -> bool:
        """Names and coined terms stand in sentences of any language; a word is at home in one of them."""
        if len(word) < 2 or not word.isalpha():
            return False
        pieces = self.pieces(word)
        if len(word) <= 3:  # parts of words are as short, but do not stand alone
            return pieces <= 0.5 and alone >= max(LEAST_COUNT, ALONE_SHARE * n)
        if not self.taught:
            return pieces <= 0.34
        score = self.score(word)
        if foreign >= 0.75:
            return score > -16
        if capital >= 0.97 and score < 2:
            return False
        return score > -3 or (score > -9 and pieces <= 0.34)

    @staticmethod
    def features(word: str) -> set[str]:
        x = f"^{word}$"
        return {x[i : i + n] for n in (2, 3, 4) for i in range(len(x) - n + 1)}

    def _count(self, real: list[str], other: list[str]) -> None:
        p, q = Counter(f for w in real for f in self.features(w)), Counter(f for w in other for f in self.features(w))
        a, b = math.log(len(real) + 0.6), math.log(len(other) + 0.6)
        self.llr = {f: math.log(p[f] + 0.3) - a - math.log(q[f] + 0.3) + b for f in set(p) | set(q)}
        self.unseen = b - a

    def score(self, word: str) -> float:
        get, u = self.llr.get, self.unseen
        return sum(get(f, u) for f in self.features(word)) / math.sqrt(len(word) + 1)


def q_grams(word: str) -> list[str]:
    q = 2 if len(word) < 5 else 3
    x = f"^{word}$"
    return [x[i : i + q] for i in range(len(x) - q + 1)]


def overlap(word: str, c: str) -> float:
    """Share of the q-grams of ``word`` that the candidate holds; pairs count for short candidates only."""
    grams = q_grams(word)
    if len(word) < 5 and len(c) > 6:
        return 0.0
    x = f"^{c}$"
    return sum(g in x for g in set(grams)) / len(grams)


class Corrector:
    """The trained models: ``rank`` orders candidates for a misread word, ``join`` decides on the line pair around a cut
    word, ``digits`` on a number with letters in it."""

    def __init__(self, words: Words, unseen: float = LEAST_COUNT) -> None:
        self.words, self.unseen = words, unseen
        self.scale = LEAST_COUNT / unseen  # counts are put to the size at which a form of LEAST_COUNT is the first that is seen
        self.rank = Boosted()
        self.join = Boosted(rounds=40)
        self.digits = Boosted(rounds=40)

    def teachers(self, index: dict[str, list[str]], word: str) -> list[tuple[float, float, str]]:
        """(cost, overlap, candidate) of the six nearest words of the sample: examples to learn from."""
        grams = q_grams(word)
        shared: Counter = Counter()
        for g in set(grams):
            shared.update(index.get(g, ()))
        least = 1 if len(word) < 5 else max(2, len(grams) - 6 if len(grams) > 10 else len(grams) // 2 - 1)
        near = ((look_cost(word, c), k / len(grams), c) for c, k in shared.items() if k >= least and abs(len(c) - len(word)) <= 2 and c != word)
        return sorted(x for x in near if x[0] <= 2.0)[:6]

    def row(self, word: str, n: int, cost: float, share: float, c: str, m: int) -> list[float]:
        m, n = max(1.0, m * self.scale), n * self.scale
        return [cost, cost / len(c), share, math.log(m), math.log(m / (n + 1)), len(c), float(any(not ch.isalpha() for ch in word)), float(word[0] == c[0]), self.words.score(word), abs(len(word) - len(c)), float(word[:-1] == c or c[:-1] == word)]

    def chance(self, word: str, n: int, c: str, m: int) -> float:
        """Chance that ``word``, seen ``n`` times, is a misread ``c``, seen ``m`` times; 0 if they do not look alike."""
        k = confusions(word, c) if c != word else None
        return 0.0 if k is None else self.rank.chance(self.row(word, n, 0.4 * k, overlap(word, c), c, m))

    @staticmethod
    def pair_row(a: str, b: str, soft: bool, whole: int, kept: int, na: int, nb: int, real_a: bool, real_b: bool) -> list[float]:
        return [math.log1p(whole), math.log1p(kept), math.log1p(whole) - math.log1p(kept), math.log1p(na), math.log1p(nb), math.log1p(min(na, nb)), len(a), len(b), float(real_a), float(real_b), float(soft)]

    def joined(self, a: str, b: str, soft: bool, inner: bool, whole: int, kept: int, na: int, nb: int, real_a: bool, real_b: bool) -> bool:
        """Whether the lower-case parts before and after a hyphen sign are one word. Within a line (``inner``) a compound
        that is not much rarer than the whole word stands as it is."""
        if inner and kept > 0 and whole < RARER_MARKS * kept:
            return False
        return self.join.chance(self.pair_row(a, b, soft, whole, kept, na, nb, real_a, real_b)) >= 0.5

    @staticmethod
    def digit_row(form: str, n: int, m: int) -> list[float]:
        letters = [ch for ch in form if ch.isalpha() or ch in "|!"]
        return [len(letters) / len(form), len(letters), float(form[0].isdigit()), float(form[0] in "lIiO|!"), float(form[-1] in "lIiO|!"), math.log1p(n), math.log1p(m), math.log((m + 1) / (n + 1)), len(form), float(form[0].isalpha() and form[1:].isdigit())]

    def number(self, form: str, n: int, m: int) -> bool:
        """Whether a form with letters, seen ``n`` times, is a number seen ``m`` times, rather than a code of its own."""
        if n > 0 and m < RARER_MARKS * n:
            return False
        return self.digits.chance(self.digit_row(form, n, m)) >= 0.5

    def train(self) -> Corrector:
        rng = random.Random(7)
        words, n = self.words, self.words.n
        real = sorted(w for w in words.real if len(w) >= 3)
        coined = sorted(w for w in n if w.isalpha() and w not in words.real and len(w) >= 5)
        index: dict[str, list[str]] = defaultdict(list)
        for w in words.real:
            x = f"^{w}$"
            for g in {x[i : i + q] for q in (2, 3) if q == 3 or len(w) <= 6 for i in range(len(x) - q + 1)}:
                index[g].append(w)
        x, y = [], []
        for w in rng.sample(real, min(len(real), TRAINING_WORDS)):
            for seen in sorted({misread(w, rng), misread(w, rng)} - set(words.real)):
                times = rng.choice((0, 0, 1, 3)) / self.scale
                for cand in self.teachers(index, seen):
                    x.append(self.row(seen, times, *cand, words.real[cand[2]]))
                    y.append(cand[2] == w)
            times = rng.choice((0, 1, 3, 9)) / self.scale  # the word itself, were it rare: no candidate is right
            for cand in self.teachers(index, w)[:3]:
                x.append(self.row(w, times, *cand, words.real[cand[2]]))
                y.append(False)
        for w in rng.sample(coined, min(len(coined), TRAINING_WORDS)):
            for cand in self.teachers(index, w)[:3]:
                x.append(self.row(w, rng.choice((0, 1, 3, 9)) / self.scale, *cand, words.real[cand[2]]))
                y.append(False)
        self.rank.fit(x, y) if x else self.rank.fit([[0.0]], [0])
        x, y = [], []
        known = lambda a, b, soft: self.pair_row(a, b, soft, n.get(a + b, 0), n.get(f"{a}-{b}", 0), n.get(a, 0), n.get(b, 0), a in words.real, b in words.real)
        for w in rng.sample(real + coined, min(len(real) + len(coined), 2 * TRAINING_WORDS)):
            if len(w) >= 5:
                for _ in range(2):
                    k = rng.randint(2, len(w) - 2)
                    row = known(w[:k], w[k:], rng.random() < 0.3)
                    if rng.random() < 0.25:  # words the collection holds only cut
                        row[0], row[2] = 0.0, -row[1]
                    x.append(row)
                    y.append(True)
        kept = sorted(w for w in n if w.count("-") == 1 and COMPOUND.fullmatch(w))
        for w in kept:
            a, b = w.split("-")
            if n.get(a + b, 0) * 5 < n[w]:
                row = known(a, b, False)
                for once in (row, [row[0], 0.0, row[0], *row[3:]]):
                    x += [once] * 4
                    y += [False] * 4
                x += [[*row[:-1], 1.0]] * 4  # at a soft hyphen a word is cut, whatever else is written with a hyphen
                y += [True] * 4
        self.join.fit(x, y) if x else self.join.fit([[0.0]], [1])
        x, y = [], []
        numbers = sorted(w for w in n if w.isdigit() and len(w) >= 2) + [str(rng.randrange(10, 10 ** rng.randint(2, 5))) for _ in range(400)]
        for w in rng.sample(numbers, min(len(numbers), TRAINING_WORDS)):
            for seen in (misread_number(w, rng), misread_number(w, rng)):
                if as_number(seen) == w:
                    x.append(self.digit_row(seen, rng.choice((0, 0, 0, 1)), n.get(w, 0)))
                    y.append(True)
            code = rng.choice("BGZbgzq") + w[1:] if rng.random() < 0.7 else w[:-1] + rng.choice("abgqz")  # B12, 7b: codes of their own
            x.append(self.digit_row(code, rng.choice((0, 1, 3, 9)), n.get(w, 0)))
            y.append(False)
        for w in sorted(n):
            if NUMBER.fullmatch(w) and not w.isdigit() and not w.isalpha():
                m = n.get(as_number(w), 0)
                x.append(self.digit_row(w, n[w], m))
                y.append(m >= RARER_MARKS * n[w])
        self.digits.fit(x, y)
        return self


def as_number(form: str) -> str:
    return "".join(DIGIT_OF.get(ch, ch) for ch in form)


LETTERS_OF: dict[str, list[str]] = defaultdict(list)
for _letter, _digit in DIGIT_OF.items():
    LETTERS_OF[_digit].append(_letter)


def misread_number(number: str, rng: random.Random) -> str:
    """The number with one or two digits read as letters, as scans do: 1 and 0 most of all; at its beginning 1, 0 and 5 only,
    since other letters before digits make codes."""
    at = [i for i, ch in enumerate(number) if ch in "10"] if rng.random() < 0.6 else [i for i, ch in enumerate(number) if ch in "10" or (ch in LETTERS_OF and (i or ch == "5"))]
    at = at or [i for i, ch in enumerate(number) if ch in LETTERS_OF and (i or ch in "105")] or [0]
    for i in rng.sample(at, min(len(at), rng.choice((1, 1, 2)))):
        number = number[:i] + rng.choice([x for x in LETTERS_OF.get(number[i], "l") if i or x in "lIiOo|!Ss"] or ["l"]) + number[i + 1 :]
    return number


def misread(word: str, rng: random.Random) -> str:
    """The word with one or two characters read wrongly."""
    for _ in range(1 if rng.random() < 0.85 else 2):
        options = [(i, n, r) for i in range(len(word)) for n in (1, 2) for r in sorted(PAIRS.get(word[i : i + n], ())) if i + n <= len(word)]
        if options and rng.random() < 0.9:
            i, n, r = rng.choice(options)
        else:
            i, n, r = rng.randrange(len(word)), 1, rng.choice("abcdefghijklmnopqrstuvwxyz")
        word = word[:i] + r + word[i + n :]
    return word


MARKS = re.compile("[" + "".join(map(chr, (*INVISIBLE, *LIGATURES))) + "]")


def clean_marks(text: str) -> str:
    """The text without invisible characters and with joined letters apart."""
    if text.isascii() or not MARKS.search(text):
        return text
    return text.translate(INVISIBLE).translate(LIGATURES)


DIGITED = re.compile(r"\d[lIi|!OoSsBbGZzgq]|[lIi|!OoSsBbGZzgq]\d")


def cut_places(text: str, blanks: bool) -> Iterator[tuple[re.Match, str, str, str, str, bool]]:
    """Match, part before and after the hyphen sign with what belongs to them, their letters, and whether the sign is soft,
    of every place where a word may have been cut at a line end."""
    at = 0
    for m in (CUT_BLANK if blanks else CUT).finditer(text):
        cut = m.start()
        if cut <= at or not text[cut - 1].isalnum() or text[cut - 1] in LEADS:
            continue
        left = strip_outer(text[max(text.rfind(" ", at, cut), text.rfind("\n", at, cut), text.rfind("\t", at, cut), at - 1) + 1 : cut])
        right = strip_outer(NEXT_PART.match(text, m.end())[0])
        a, b = RUN.findall(left)[-1:], RUN.match(right)
        if a and b and b[0][0].isalpha() and not (b[0][:1].isupper() and not a[0].isupper()):
            yield m, left, right, a[0], b[0], m[0][0] in "\u00ad\u00ac"


def pair_key(a: str, b: str, soft: bool, inner: bool) -> str:
    return f"c\t{a.lower()}\t{b.lower()}\t{int(soft)}{int(inner)}"


def is_number_form(core: str) -> bool:
    """Whether digits and letters that look like digits make up a token."""
    return any(ch.isdigit() for ch in core) and any(ch.isalpha() or ch in "|!" for ch in core) and NUMBER.fullmatch(core) is not None


def questions(text: str, blanks: bool, inner: bool) -> set[str]:
    """What a text asks of the collection beside its words: ``u`` runs with signs or joined from parts, ``c`` cut pairs,
    ``d`` numbers with letters."""
    asked: set[str] = set()
    if "|" in text or "!" in text:
        for t in text.split():
            if "|" in t or "!" in t:
                asked |= {"u\t" + run.lower() for run in MIXED_RUN.findall(t) if "|" in run or "!" in run}
    if DIGITED.search(text):
        for t in text.split():
            if DIGITED.search(t) and is_number_form(strip_outer(t)):
                asked.add("d\t" + strip_outer(t))
    for _, left, right, a, b, soft in cut_places(text, blanks):
        asked.add(pair_key(a, b, soft, False))
        asked |= {"u\t" + run.lower() for run in MIXED_RUN.findall(left + right)}
    if inner:
        for m in INNER.finditer(text):
            if not (m[2][:1].isupper() and not m[1].isupper()):
                asked |= {pair_key(m[1], m[2], False, True), "u\t" + (m[1] + m[2]).lower()}
    return asked


def tallies(texts: DataFrame) -> DataFrame:
    """key, n, n_capital, n_foreign, n_alone, pre-aggregated in each map task. A key is ``w`` and a word (lower case,
    compounds with their hyphen too; n_alone: of words of two or three letters, between blanks), or a question."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        home: Counter = Counter()
        away: Counter = Counter()
        alone: Counter = Counter()
        asked: set[str] = set()

        def flush() -> pd.DataFrame:
            low: dict[str, list[int]] = {}
            for held, foreign in ((home, 0), (away, 1)):
                for w, n in held.items():
                    row = low.setdefault("w\t" + w.lower(), [0, 0, 0, 0])
                    row[0] += n
                    row[1] += n if w[0].isupper() else 0
                    row[2] += n * foreign
                held.clear()
            for w, n in alone.items():
                low.setdefault("w\t" + w.lower(), [0, 0, 0, 0])[3] += n
            alone.clear()
            rows = [(w, *v) for w, v in low.items()] + [(k, 0, 0, 0, 0) for k in asked]
            asked.clear()
            return pd.DataFrame(rows, columns=["key", "n", "n_capital", "n_foreign", "n_alone"])

        for b in batches:
            for raw, blanks, inner, marks in zip(b["text"].tolist(), b["blanks"].tolist(), b["inner"].tolist(), b["furniture"].tolist()):
                text = clean_marks(raw)
                alone.update(ALONE.findall(text))
                words = RUN.findall(text)
                if FOREIGN.isdisjoint(words):
                    home.update(words)
                else:
                    for sentence in SENTENCE.split(text):
                        words = RUN.findall(sentence)
                        (home if FOREIGN.isdisjoint(words) else away).update(words)
                if "-" in text:
                    home.update(COMPOUND.findall(text))
                asked.update(questions(clean_marks(without_lines(raw, marks)), blanks, inner))
            if len(home) + len(away) + len(asked) > 300_000:
                yield flush()
        yield flush()

    rows = texts.mapInPandas(run, "key string, n bigint, n_capital bigint, n_foreign bigint, n_alone bigint")
    return rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "n_capital", "n_foreign", "n_alone")])


def of_kind(tally: DataFrame, kind: str) -> DataFrame:
    return tally.where(F.col("key").startswith(kind + "\t")).withColumn("word", F.expr("substring(key, 3)"))


def learn(tally: DataFrame, tokenizer: str = TOKENIZER) -> Corrector:
    """The models, from the SAMPLE_WORDS most frequent words."""
    rows = of_kind(tally, "w").where(f"n >= {LEAST_COUNT}").orderBy(F.desc("n"), "word").limit(SAMPLE_WORDS).collect()
    rows.sort(key=lambda r: r["word"])
    total = of_kind(tally, "w").agg(F.sum("n").alias("n")).first()["n"] or 0
    words = Words([(r["word"], r["n"], r["n_capital"], r["n_foreign"]) for r in rows], tokenizer, {r["word"]: r["n_alone"] for r in rows if r["n_alone"]})
    return Corrector(words, max(LEAST_COUNT, total * UNSEEN_SHARE)).train()


def vocabulary(tally: DataFrame, corrector: Corrector) -> DataFrame:
    """word, n, real of all words of LEAST_COUNT occurrences. A short word stands alone also as a part of compounds."""
    words = of_kind(tally, "w").where(f"n >= {LEAST_COUNT}")
    whole = words.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    compounds = words.where("instr(word, '-') > 0").select(F.col("n").alias("times"), F.split("word", "-").alias("parts"), F.expr("replace(word, '-', '')").alias("joined"))
    parts = compounds.join(whole, "joined", "left").where(F.coalesce("n_joined", F.lit(0)) < RARER_MARKS * F.col("times"))
    parts = parts.select(F.explode("parts").alias("word"), "times").where("length(word) <= 3").groupBy("word").agg(F.sum("times").alias("times"))
    shared, name = tally.sparkSession.sparkContext.broadcast(corrector.words), new_key()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = per_worker(name, lambda: shared.value)
        for b in batches:
            real = [known.is_real(w, n, c / n, f / n, a) for w, n, c, f, a in zip(*(b[c].tolist() for c in ("word", "n", "n_capital", "n_foreign", "alone")))]
            yield pd.DataFrame({"word": b["word"], "n": b["n"], "real": real})

    rows = words.join(parts, "word", "left").select("word", "n", "n_capital", "n_foreign", (F.col("n_alone") + F.coalesce("times", F.lit(0))).alias("alone"))
    return rows.mapInPandas(run, "word string, n bigint, real boolean")


def gram_places(word: str, lengths: tuple[int, ...]) -> list[tuple[str, int]]:
    """q-grams of the word between ^ and $, look-alikes folded into one another, with their places."""
    x = f"^{word.translate(FOLD)}$"
    return [(x[i : i + q], i) for q in lengths for i in range(len(x) - q + 1)]


def telling_grams(word: str, frequency: dict[str, int]) -> list[tuple[str, int]]:
    """Three q-grams of the word so far apart that two confusions leave one of them as it is, of those the rarest together.
    Words of less than six characters have no room for three; all their pairs count."""
    q = 3 if len(word) >= 9 else 2
    grams = gram_places(word, (q,))
    if len(word) < 6:
        return grams
    cost = [frequency.get(g, 0) for g, _ in grams]
    best: list[list[tuple[float, int]]] = [[(c, -1) for c in cost]]  # least cost with 1, 2, 3 grams of which this is the last
    for _ in range(2):
        row, least, at = [], math.inf, -1
        for i, c in enumerate(cost):
            if i > q and best[-1][i - q - 1][0] < least:
                least, at = best[-1][i - q - 1][0], i - q - 1
            row.append((least + c, at))
        best.append(row)
    i = min(range(len(cost)), key=lambda k: best[2][k][0])
    picked = []
    for row in reversed(best):
        picked.append(grams[i])
        i = row[i][1]
    return picked


def misread_words(tally: DataFrame, vocabulary: DataFrame, corrector: Corrector) -> DataFrame:
    """key (``w`` and a word), value: right form of every word that is misread.

    An inverted join on character q-grams: words in question with three telling q-grams each, words of the vocabulary with
    all of theirs, at most two places apart. A right form is RARER times as frequent, so shares are compared, not numbers.
    Every pair that looks alike is ranked.
    """
    spark = tally.sparkSession
    seen = of_kind(tally, "w").where("instr(word, '-') = 0").unionByName(of_kind(tally, "u")).where(F.length("word") >= 2).where(~F.col("word").rlike("^[0-9]+$"))
    seen = seen.groupBy("word").agg(F.max(F.when(F.col("n") >= corrector.unseen, F.col("n")).otherwise(0)).alias("n"))
    real = vocabulary.where("real")
    top = (real.agg(F.max("n").alias("n")).first()["n"] or 0) / RARER

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(g, at, w, m) for w, m in zip(b["word"].tolist(), b["n"].tolist()) for g, at in gram_places(w, (2,) * (len(w) <= 10) + (3,) * (len(w) >= 7))]
            yield pd.DataFrame(rows, columns=["gram", "at", "right", "m"])

    index = written(real.select("word", "n").mapInPandas(spread, "gram string, at int, right string, m bigint"))
    total = index.count()
    frequency = {r["gram"]: r["k"] for r in index.groupBy("gram").agg(F.count("*").alias("k")).where(F.col("k") >= max(2, total * 1e-5)).toLocalIterator()}  # 100,000 at most
    shared, name = spark.sparkContext.broadcast(frequency), new_key()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(g, p, w, n) for w, n in zip(b["word"].tolist(), b["n"].tolist()) for g, p in telling_grams(w, shared.value)]
            yield pd.DataFrame(rows, columns=["gram", "place", "word", "n"])

    asked = seen.where(F.col("n") <= top).mapInPandas(ask, "gram string, place int, word string, n bigint")
    pairs = join_measured(asked, index, ["gram"]).where("abs(place - at) <= 2 and abs(length(word) - length(right)) <= 2 and word != right").where(F.col("m") >= RARER * F.col("n"))
    models = spark.sparkContext.broadcast(corrector)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = per_worker(name, lambda: models.value)
        for b in batches:
            rows = []
            for word, n, right, m in zip(*(b[x].tolist() for x in ("word", "n", "right", "m"))):
                chance = c.chance(word, n, right, m)
                if chance >= ACCEPT:
                    rows.append((word, right, chance))
            yield pd.DataFrame(rows, columns=["word", "right", "chance"])

    ranked = pairs.select("word", "n", "right", "m").mapInPandas(rank, "word string, right string, chance double")
    best = written(ranked.groupBy("word").agg(F.max(F.struct("chance", "right")).alias("best")).select("word", F.col("best.right").alias("right")))
    # In a large collection a misread form may itself be frequent enough for the vocabulary: then its own right form counts.
    again = best.select(F.col("word").alias("right"), F.col("right").alias("further"))
    out = join_measured(best, again, ["right"], "left")
    return out.select(F.concat(F.lit("w\t"), "word").alias("key"), F.coalesce("further", "right").alias("value")).where("substring(key, 3) != value")


def counts_of(asked: DataFrame, names: dict[str, Column], vocabulary: DataFrame) -> DataFrame:
    """The rows of ``asked`` (key) with n and real of several words each, 0 and false where the vocabulary lacks them."""
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("role"), w.alias("word")) for k, w in names.items()])).alias("of")
    roles = asked.select("key", of).select("key", "of.role", "of.word").join(vocabulary, "word", "left")
    cols = [x for k in names for x in (F.max(F.when(F.col("role") == k, F.coalesce("n", F.lit(0)))).alias(f"n_{k}"), F.max(F.when(F.col("role") == k, F.coalesce("real", F.lit(False)))).alias(f"real_{k}"))]
    return roles.groupBy("key").agg(*cols)


def decisions(tally: DataFrame, corrector: Corrector) -> DataFrame:
    """key, value of everything that is to be changed: ``w`` words with their right form, ``c`` pairs to be joined, ``d``
    forms with their number."""
    words = written(vocabulary(tally, corrector))
    seen = words.where(F.col("n") >= corrector.unseen)
    models, name = tally.sparkSession.sparkContext.broadcast(corrector), new_key()
    part = F.split("key", "\t")
    cut = tally.where(F.col("key").startswith("c\t")).select("key", part[1].alias("a"), part[2].alias("b"))
    cut = counts_of(cut, {"whole": F.concat("a", "b"), "kept": F.concat_ws("-", "a", "b"), "a": F.col("a"), "b": F.col("b")}, seen)
    letters = "".join(k for k in DIGIT_OF)
    forms = tally.where(F.col("key").startswith("d\t")).select("key", F.expr("substring(key, 3)").alias("form"))
    forms = counts_of(forms, {"form": F.lower("form"), "number": F.translate("form", letters, "".join(DIGIT_OF[k] for k in letters))}, seen)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = per_worker(name, lambda: models.value)
        for b in batches:
            keep = []
            for key, *rest in zip(*(b[x].tolist() for x in ("key", "n_whole", "n_kept", "n_a", "n_b", "real_a", "real_b"))):
                _, left, right, flags = key.split("\t")
                keep.append(c.joined(left, right, flags[0] == "1", flags[1] == "1", *rest))
            yield pd.DataFrame({"key": b["key"][keep], "value": ""})

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = per_worker(name, lambda: models.value)
        for b in batches:
            rows = [(key, as_number(key[2:])) for key, n, m in zip(b["key"].tolist(), b["n_form"].tolist(), b["n_number"].tolist()) if c.number(key[2:], n, m)]
            yield pd.DataFrame(rows, columns=["key", "value"])

    schema = "key string, value string"
    return misread_words(tally, words, corrector).unionByName(cut.mapInPandas(pairs, schema)).unionByName(forms.mapInPandas(numbers, schema))


def edge_keys(lines: DataFrame, source: str, page: str, raw: str, y: str) -> DataFrame:
    """source, seeds: keys of lines that stand on two pages or more, mostly in the outer band of the page, as one string
    with line breaks between: it goes along with many rows and is taken apart once per source."""
    ends = lines.groupBy(F.col(source).alias("book")).agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    both = join_measured(lines.select(F.col(source).alias("book"), F.col(page).alias("page_no"), F.col(raw).alias("line"), F.col(y).alias("y")), written(ends), ["book"])
    band = (F.col("hi") - F.col("lo")) * BAND
    outer = F.coalesce((F.col("y") < F.col("lo") + band) | (F.col("y") > F.col("hi") - band), F.lit(False))
    found = keyed(both, "book", "page_no", "line", flag=outer).where("key is not null").groupBy("source", "key")
    counted = found.agg(F.min("page").alias("a"), F.max("page").alias("b"), F.avg("flag").alias("share"))
    return counted.where(f"a < b and share >= {EDGE_SHARE}").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("key")), "\n").alias("seeds"))


def near_key(key: str, by_length: dict[int, list[tuple[str, list[str]]]]) -> bool:
    """Whether a key equals a seed but for a few misread letters."""
    for n in range(len(key) - 8, len(key) + 9):
        most = min(8, n // 8 + 1)
        if abs(n - len(key)) <= most:
            for s, pieces in by_length.get(n, ()):
                if any(p in key for p in pieces) and edits(key, s, most) <= most:
                    return True
    return False


def is_page_number(line: str) -> bool:
    """Whether a line has the form of a page number, alone or after a word for a page; numbers that end a sentence or an
    enumeration have not."""
    m = PAGE_NUMBER.fullmatch(line.strip())
    if m is None or line.strip()[-1:] in ".," and not m["word"]:
        return False
    return not m["word"] or m["word"].lower() in PAGE_SET or m["word"].lower().encode("ascii", "ignore").decode() in PAGE_SET


ENDED = re.compile(r"[.!?:;…][\"”’»)\]]*$")


class Furniture:
    """Running lines and page numbers inside the text of a block, told by a classifier over the pairs that a line makes
    with the one before and the one after it."""

    def __init__(self, seeds: list[str] | None, model: Boosted | None = None) -> None:
        self.exact, self.model = frozenset(seeds or ()), model
        self.by_length: dict[int, list[tuple[str, list[str]]]] = defaultdict(list)
        for s in self.exact:
            self.by_length[len(s)].append((s, pieces_of(s, min(8, len(s) // 8 + 1))))
        self.seen: dict[str, bool] = {}

    def running(self, line: str) -> bool:
        """Whether a line is one that stands at the edges of several pages, but for misread letters."""
        key = key_of(line)
        if key is None or not self.exact:
            return False
        hit = self.seen.get(key)
        if hit is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            hit = self.seen[key] = key in self.exact or (len(key) >= 8 and near_key(key, self.by_length))
        return hit

    def row(self, before: str, line: str, after: str) -> list[float]:
        """Features of the pairs (before, line) and (line, after), and of the gap that the line would leave."""
        before, line, after = before.strip(), line.strip(), after.strip()
        beside = [self.running(x) or is_page_number(x) for x in (before, after)]
        return [
            float(self.running(line)), float(is_page_number(line)), float(sum(beside)), float(ENDED.search(before) is not None), float(ENDED.search(line) is not None),
            float(line[:1].islower()), float(after[:1].islower()), float(before[-1:] in HYPHENS and before != ""), min(3.0, len(line) / (len(before) + 1)), min(3.0, len(line) / (len(after) + 1)),
            sum(ch.isdigit() for ch in line) / (len(line) + 1), float(len(line)),
        ]

    def of(self, lines: list[str], n_pages: int) -> list[str]:
        """Defect of each line, or nothing. Furniture is inside a text where that goes on over a page break, so it stands in
        a block on two pages or more, after a line and before a line."""
        out = [""] * len(lines)
        if n_pages < 2:
            return out
        for i in range(1, len(lines) - 1):
            running = self.running(lines[i])
            if (running or is_page_number(lines[i])) and (self.model is None or self.model.chance(self.row(*lines[i - 1 : i + 2])) >= 0.5):
                out[i] = "running_line" if running else "page_number"
        return out


def learn_furniture(lines: DataFrame, seeds: DataFrame, source: str, page: str, raw: str, y: str) -> Boosted:
    """Classifier of furniture, from SAMPLE_PAGES pages, picked by hash. The lines of a page are put as they stand where a
    text goes on to the next page: last lines of the text, foot, head, first lines of the text. Lines in the outer band that
    stand on several pages or are numbers are furniture, and so they are with a letter misread; those between are not."""
    rows = lines.select(F.col(source).alias("book"), F.col(page).alias("page"), F.col(raw).alias("raw"), F.col(y).alias("y")).where("book is not null and page is not null and raw is not null and y is not null")
    picked = rows.select("book", "page").distinct().orderBy(F.xxhash64("book", "page"), "book", "page").limit(SAMPLE_PAGES)
    books = picked.select("book").distinct()
    ends = rows.join(F.broadcast(books), "book", "left_semi").groupBy("book").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))  # as many books as pages at most
    known = {r["source"]: Furniture(r["seeds"].split("\n")) for r in seeds.join(F.broadcast(books), F.col("source") == F.col("book"), "left_semi").collect()}
    pages: dict[tuple, list] = defaultdict(list)
    for r in rows.join(F.broadcast(picked), ["book", "page"]).join(F.broadcast(ends), "book").collect():
        band = (r["hi"] - r["lo"]) * BAND
        pages[r["book"], r["page"]].append((r["y"], r["raw"], r["y"] < r["lo"] + band, r["y"] > r["hi"] - band))
    rng, x, y_true = random.Random(3), [], []
    for (book, _), held in sorted(pages.items(), key=lambda p: (str(p[0][0]), p[0][1])):
        held = sorted(set(held))
        of = known.get(book) or Furniture(None)
        head, foot, body = [h[1] for h in held if h[2]], [h[1] for h in held if h[3] and not h[2]], [h[1] for h in held if not h[2] and not h[3]]
        text = body[-4:] + foot + head + body[:4]
        outer = set(range(len(body[-4:]), len(body[-4:]) + len(foot) + len(head)))
        for i in range(1, len(text) - 1):
            furniture = of.running(text[i]) or is_page_number(text[i])
            if i in outer and not furniture:
                continue
            for line in (text[i], misread(text[i], rng)) if i in outer and len(text[i]) >= 12 else (text[i],):
                x.append(of.row(text[i - 1], line, text[i + 1]))
                y_true.append(i in outer)
    if sum(y_true) < LEAST_TAUGHT or len(y_true) - sum(y_true) < LEAST_TAUGHT:  # too few pages to learn from: the form decides
        return Boosted().fit([[0.0]], [1])
    return Boosted(rounds=40).fit(x, y_true)


def without_lines(text: str, furniture: list[str] | None) -> str:
    return "\n".join(line for line, d in zip(text.split("\n"), furniture) if not d) if furniture is not None and any(furniture) else text


def strip_outer(token: str) -> str:
    a, b = 0, len(token)
    while a < b and not (token[a].isalnum() or token[a] == "|"):
        a += 1
    while b > a and not (token[b - 1].isalnum() or token[b - 1] == "|"):
        b -= 1
    return token[a:b]


MIXED_RUN = re.compile(r"[^\W_]+(?:[|!][^\W_]+)*[|!]?|[|][^\W_]+")


class Repairer:
    """Carries out decisions on texts."""

    def __init__(self, decided: dict[str, str]) -> None:
        self.decided = decided
        self.tokens: dict[str, str | None] = {}

    def token(self, token: str) -> str | None:
        """Right form of a misread blank-delimited token in lower case, without punctuation around it, or null."""
        if token in self.tokens:
            return self.tokens[token]
        if len(self.tokens) > 400_000:
            self.tokens.clear()
        hit = self.tokens[token] = self._token(token)
        return hit

    def _token(self, token: str) -> str | None:
        core = strip_outer(token)
        if len(core) < 2:
            return None
        if not core.isascii() and (MIXED.search(core) or any(">utf-8" in c for c in readings(core).values())):
            return None  # damage from an encoding is another matter
        number = self.decided.get("d\t" + core)
        if number is not None:
            return number
        changed, out, at = False, [], 0
        for m in MIXED_RUN.finditer(core):
            run = m[0].lower()
            fixed = None
            # Two letters are looked up where they are a word to themselves and no abbreviation or foreign word.
            if len(run) >= 3 or (len(run) == 2 and (not run.isalpha() or (m[0] == core and core.islower() and run not in FOREIGN))):
                fixed = self.decided.get("w\t" + run)
            out += [core[at : m.start()], fixed or m[0]]
            changed |= fixed is not None
            at = m.end()
        return ("".join(out) + core[at:]).lower() if changed else None

    def text(self, text: str, furniture: list[str] | None, blanks: bool, inner: bool) -> tuple[str, list[tuple[str, str]]]:
        """Repaired text and its defects. ``blanks``: lines were joined with blanks; ``inner``: with nothing."""
        found: list[tuple[str, str]] = []
        if furniture is not None and any(furniture):
            found += [(d, line.strip()) for line, d in zip(text.split("\n"), furniture) if d]
            text = without_lines(text, furniture)
        text = clean_marks(text)
        joined: set[str] = set()
        out, at = [], 0
        for m, left, right, a, b, soft in cut_places(text, blanks):
            if pair_key(a, b, soft, False) in self.decided:
                out.append(text[at : m.start()])
                at = m.end()
                joined.add((left + right).lower())
        text = "".join(out) + text[at:]
        if inner:
            def close(m: re.Match) -> str:
                if not (m[2][:1].isupper() and not m[1].isupper()) and pair_key(m[1], m[2], False, True) in self.decided:
                    joined.add((m[1] + m[2]).lower())
                    return m[1] + m[2]
                return m[0]

            text = INNER.sub(close, text)
        wrong = {t: fixed for t in set(text.split()) if (fixed := self.token(t)) is not None}
        if wrong:

            def replace(m: re.Match) -> str:
                fixed = wrong.get(m[0])
                if fixed is None:
                    return m[0]
                core = strip_outer(m[0])
                found.append(("misread", fixed))
                return m[0].replace(core, fixed.upper() if core.isupper() else fixed.capitalize() if core[:1].isupper() else fixed, 1)

            text = TOKEN.sub(replace, text)
        for w in joined:
            found.append(("broken_word", self.token(w) or w))
        return paragraphs(text), list(dict.fromkeys(found))


WIDE = re.compile(r"\S {2,}\S")
LIST_MARK = re.compile(r"\s*(?:[-•–*]|\d{1,3}[.)]|[a-h][.)])\s")


def paragraphs(text: str) -> str:
    """Lines joined into paragraphs; an empty line, a list mark or a table row starts a new one."""
    out: list[str] = []
    fresh = True
    for line in text.split("\n"):
        if not line.strip():
            fresh = True
            continue
        line = line.strip()
        row = "|" in line or ("  " in line and WIDE.search(line) is not None)
        if fresh or row or LIST_MARK.match(line):
            out.append(line)
        else:
            out[-1] += " " + line
        fresh = row
    return "\n".join(out)


def with_furniture(texts: DataFrame, seeds: DataFrame, model: Boosted) -> DataFrame:
    """``texts`` with ``furniture``: the defect of each line of a block on two pages or more, null for other records."""
    shared, name = texts.sparkSession.sparkContext.broadcast(model), new_key()
    small = size_bytes(seeds) <= BROADCAST_BYTES
    of_source = {r["source"]: r["seeds"] for r in seeds.toLocalIterator()} if small else {}
    held = texts.sparkSession.sparkContext.broadcast(of_source)
    cols = ["rec", "rec_id", "source", "text", "n_pages", "blanks", "inner"]
    many = texts.where("n_pages > 1").select(*cols)
    # Keys of edges that are too many for one broadcast go along with the blocks on several pages, the few that ask for them.
    many = many.withColumn("seeds", F.lit(None).cast("string")) if small else many.join(seeds, "source", "left").select(*cols, "seeds")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Furniture] = per_worker(name, dict)
        for b in batches:
            marks = []
            for source, text, n_pages, own in zip(b["source"].tolist(), b["text"].tolist(), b["n_pages"].tolist(), b["seeds"].tolist()):
                if source not in known:
                    if len(known) > 500:
                        known.clear()
                    packed = own or held.value.get(source)
                    known[source] = Furniture(packed.split("\n") if packed else None, shared.value)
                marks.append(known[source].of(text.split("\n"), n_pages))
            out = b.drop(columns="seeds")
            out["furniture"] = marks
            yield out

    kinds = dict(texts.dtypes)
    marked = many.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", furniture array<string>")
    return marked.unionByName(texts.where("n_pages <= 1").select(*cols).withColumn("furniture", F.lit(None).cast("array<string>")))


def with_decisions(texts: DataFrame, decided: DataFrame) -> DataFrame:
    """``texts`` with the decisions each asks for, as parallel arrays ``keys`` and ``values``: for decisions that are too
    many for a broadcast."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rec, i, raw, blanks, inner, marks in zip(*(b[c].tolist() for c in ("rec", "rec_id", "text", "blanks", "inner", "furniture"))):
                text = clean_marks(without_lines(raw, marks))
                asked = {k.replace("u\t", "w\t", 1) if k[0] == "u" else k for k in questions(text, blanks, inner)} | {"w\t" + w.lower() for w in RUN.findall(text)}
                rows += [(rec, i, k) for k in asked]
            yield pd.DataFrame(rows, columns=["rec", "rec_id", "key"])

    asked = texts.mapInPandas(ask, "rec string, rec_id bigint, key string").distinct()
    own = asked.join(decided, "key").groupBy("rec", "rec_id").agg(F.collect_list("key").alias("keys"), F.collect_list("value").alias("values"))
    return texts.dropDuplicates(["rec", "rec_id"]).join(own, ["rec", "rec_id"], "left")


def repair_scans(blocks: DataFrame, paras: DataFrame, lines: DataFrame, tokenizer: str = TOKENIZER, defects: bool = False) -> DataFrame:
    """rec, rec_id, text (repaired, in paragraphs) of every block and paragraph, or with ``defects`` rec, rec_id, defect,
    token of everything that was repaired.

    Of a block, raw is repaired or, where it is null, clean. Null identifiers and texts give no rows; a record delivered
    again counts once (its text is the same); a book without repeated lines has no running lines; empty tables give no
    rows. ``tokenizer`` is a path that every executor can read.
    """
    text = F.coalesce("raw", "clean")
    b = blocks.where(F.col("block_id").isNotNull() & text.isNotNull()).select(
        F.lit("block").alias("rec"), F.col("block_id").alias("rec_id"), F.col("book_id").alias("source"), text.alias("text"), F.coalesce(F.size("pages"), F.lit(1)).alias("n_pages"),
        (F.instr(text, "\n") == 0).alias("blanks"), F.col("raw").isNull().alias("inner"),
    )
    p = paras.where("para_id is not null and text is not null").select(
        F.lit("para").alias("rec"), F.col("para_id").alias("rec_id"), F.col("book_id").alias("source"), "text", F.lit(0).alias("n_pages"), F.lit(True).alias("blanks"), F.lit(False).alias("inner")
    )
    seeds = written(edge_keys(lines, "book_id", "page", "raw", "y0"))
    texts = with_furniture(b.unionByName(p), seeds, learn_furniture(lines, seeds, "book_id", "page", "raw", "y0"))
    tally = written(tallies(texts))
    decided = written(decisions(tally, learn(tally, tokenizer)))
    columns = ["rec", "rec_id", "defect", "token"] if defects else ["rec", "rec_id", "text"]
    small = size_bytes(decided) <= BROADCAST_BYTES
    shared = blocks.sparkSession.sparkContext.broadcast({r["key"]: r["value"] for r in decided.toLocalIterator()} if small else None)
    name = new_key()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = per_worker(name, lambda: Repairer(shared.value)) if small else None
        for batch in batches:
            rows = []
            for rec, i, text, blanks, inner, marks, *own in zip(*(batch[c].tolist() for c in ("rec", "rec_id", "text", "blanks", "inner", "furniture", *(() if small else ("keys", "values"))))):
                repairer = every or Repairer(dict(zip(*own)) if own[0] is not None else {})
                fixed, found = repairer.text(text, marks, blanks, inner)
                if defects:
                    rows += [(rec, i, d, t) for d, t in found]
                else:
                    rows.append((rec, i, fixed))
            yield pd.DataFrame(rows, columns=columns)

    schema = "rec string, rec_id bigint, " + ("defect string, token string" if defects else "text string")
    out = (texts if small else with_decisions(texts, decided)).mapInPandas(run, schema)
    return out.distinct() if defects else out.dropDuplicates(["rec", "rec_id"])
