"""Problem 8: the subjects each document treats.

Weighted subject terms are curated from the labelled sample and the scope notes, matched with a multi-pattern automaton,
weighted by how telling and how rare they are, and summed by sentence. The share of a document's sentences that a subject
wins is its score, normalised by length; every subject over its threshold is assigned. Thresholds are calibrated on labelled
documents that are held out: each is scored with terms curated without it and its fold.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.worker import new_key, per_worker

LABELLED_MOST = 20_000
FOLDS = 5
PRIOR = 30  # labels of a subject that weigh as much as those of all subjects in its threshold
LEAST_DOCS = 2
LEAST_WORDS = 4
LEAST_SENTENCES = 2
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
SENTENCE = re.compile(r"(?<=[.!?…])[\"”’»)\]]*\s+|\n+")


def sentences_of(text: str) -> list[list[str]]:
    """Words of each sentence in lower case; what has fewer than four words (headings, cells, marks) is no sentence."""
    found = (WORD.findall(s) for s in SENTENCE.split(text.lower()))
    return [w for w in found if len(w) >= LEAST_WORDS]


@dataclass
class Lexicon:
    """Weights of terms by subject, and the share of sentences a subject must win."""

    subjects: list[str]
    weights: dict[str, list[tuple[int, float]]]
    least: float = 0.5
    threshold: float = 1 / 6
    own: list[float] | None = None  # threshold of each subject

    def thresholds(self) -> list[float]:
        return self.own or [self.threshold] * len(self.subjects)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(f" {term} ", w)
        if self.weights:
            a.make_automaton()
        return a

    def shares(self, automaton, text: str) -> dict[int, float]:
        """Share of the document's sentences that each subject wins."""
        sentences = sentences_of(text)
        if not sentences or not self.weights:
            return {}
        lines = [" " + " ".join(s) + " " for s in sentences]
        ends = np.cumsum([len(x) + 1 for x in lines])
        sums: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        at, k = [], []
        for end, w in automaton.iter("\n".join(lines)):
            at.append(end)
            k.append(w)
        for line, w in zip(np.searchsorted(ends, at, "right").tolist(), k):
            row = sums[line]
            for s, x in w:
                row[s] += x
        wins: Counter = Counter()
        for row in sums.values():
            s = max(row, key=lambda i: (row[i], -i))
            if row[s] >= self.least:
                wins[s] += 1
        enough = min(LEAST_SENTENCES, sum(wins.values()))  # one sentence in passing, beside others, is no subject
        return {s: n / len(sentences) for s, n in wins.items() if n >= enough}


def curate(counts: dict[str, dict[str, int]], docs: dict[str, int], notes: dict[str, str], subjects: list[str]) -> Lexicon:
    """A lexicon from the numbers of labelled documents that hold a term, by subject.

    A term's weight for a subject is the subject's share of its rate among documents, drawn to nothing for terms seen
    in few documents, times a factor of one to two for rarity. Terms that tell no subject from others are left out.
    Words of a scope note count as if two more documents of the subject held them.
    """
    index = {s: i for i, s in enumerate(subjects)}
    extra: dict[str, Counter] = defaultdict(Counter)
    for s, note in notes.items():
        for w in set(WORD.findall((note or "").lower())):
            extra[w][s] += 2
    spread = {w for w, c in extra.items() if len(c) > max(1, len(subjects) // 3)}  # words of all notes, not of one
    every = max(2, sum(docs.values()))
    weights: dict[str, list[tuple[int, float]]] = {}
    for term in set(counts) | set(extra):
        c = Counter(counts.get(term, {}))
        if term not in spread:
            c.update(extra.get(term, {}))
        n = sum(c.values())
        if n < LEAST_DOCS:
            continue
        rate = {s: x / max(docs.get(s, 0), 5) for s, x in c.items() if s in index}
        total = sum(rate.values())
        if not total:
            continue
        share = {s: r / total * n / (n + 1.0) for s, r in rate.items()}
        if max(share.values()) < 0.42:
            continue
        rarity = 1 + math.log(every / n) / math.log(every) if n < every else 1.0
        weights[term] = [(index[s], x * rarity) for s, x in sorted(share.items()) if x >= 0.25]
    return Lexicon(subjects, weights)


GRID = [round(0.08 + 0.005 * k, 3) for k in range(25)]


def best_threshold(scores: list[float]) -> float:
    """Of the thresholds of the grid the one of the best score; of a run of equals its middle; a sixth if all are nothing."""
    top = [t for t, x in zip(GRID, scores) if x >= max(scores) - 0.002]
    return top[len(top) // 2] if max(scores) > 0 else 1 / 6


def calibrate(rows: list[tuple[int, str, float]], labels: dict[int, set[str]], subjects: list[str]) -> tuple[float, list[float]]:
    """Threshold of all subjects together and of each, by best F1 on (document, subject, share) of held-out documents.

    To the counts of a subject those of all are added, scaled to PRIOR labels, so that few labels move its threshold little.
    """
    n_true = Counter(s for given in labels.values() for s in given)
    got = {s: [0] * len(GRID) for s in subjects}
    hit = {s: [0] * len(GRID) for s in subjects}
    for i, s, x in rows:
        for k, t in enumerate(GRID):
            if x >= t:
                got[s][k] += 1
                hit[s][k] += s in labels.get(i, ())
    all_true, all_got, all_hit = sum(n_true[s] for s in subjects), [sum(x) for x in zip(*got.values())], [sum(x) for x in zip(*hit.values())]
    if not all_true:
        return 1 / 6, [1 / 6] * len(subjects)
    w = PRIOR / all_true
    f1 = lambda h, g, n: round(2 * h / max(1e-9, g + n), 3)
    overall = best_threshold([f1(h, g, all_true) for h, g in zip(all_hit, all_got)])
    return overall, [best_threshold([f1(h + w * ah, g + w * ag, n_true[s] + PRIOR) for h, g, ah, ag in zip(hit[s], got[s], all_hit, all_got)]) for s in subjects]


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, most: int) -> DataFrame:
    """id, text, given (subjects), fold of at most ``most`` labelled documents, picked by hash."""
    given = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("given"))
    given = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("id"), "given", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    text = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return text.join(F.broadcast(given), "id")  # at most ``most`` rows of an id and a few subjects


def learn(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, subjects: DataFrame, most: int = LABELLED_MOST) -> Lexicon:
    """Curate and calibrate on the labelled sample, whose bound is ``most`` documents. What reaches the driver is the
    sample's terms that two documents hold, and a few shares for each of its documents."""
    from vellumspark.session import checkpointed

    notes = {r["subject"]: f"{r['title']} {r['scope_note']}" for r in subjects.select("subject", "title", "scope_note").where("subject is not null").collect()}
    names = sorted(notes)
    sample = checkpointed(labelled_sample(docs, id_col, text_col, labels, most))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for text, given, fold in zip(b["text"], b["given"], b["fold"]):
                if len(given) == 1:  # which sentences a second subject has is not known
                    held["", given[0], fold] += 1
                    held.update((w, given[0], fold) for w in {w for s in sentences_of(text) for w in s})
        yield pd.DataFrame([(w, s, f, n) for (w, s, f), n in held.items()], columns=["term", "subject", "fold", "n"])

    rows = sample.mapInPandas(count, "term string, subject string, fold int, n bigint").groupBy("term").agg(F.sum("n").alias("n"), F.collect_list(F.struct("subject", "fold", "n")).alias("by"))
    counts: dict[str, Counter] = {}
    of_fold: list[dict[str, Counter]] = [{} for _ in range(FOLDS)]
    for r in rows.where(f"n >= {LEAST_DOCS} or term = ''").toLocalIterator():
        c = counts[r["term"]] = Counter()
        for x in r["by"]:
            c[x["subject"]] += x["n"]
            of_fold[x["fold"]].setdefault(r["term"], Counter())[x["subject"]] += x["n"]
    docs_of = counts.pop("", Counter())
    lexicon = curate(counts, docs_of, notes, names)
    held_out = [curate({t: c - f.get(t, Counter()) for t, c in counts.items()}, docs_of - f.get("", Counter()), notes, names) for f in of_fold]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = [lex.automaton() for lex in held_out]
        for b in batches:
            own = [(i, lex.subjects[s], x) for i, t, f in zip(b["id"].tolist(), b["text"].tolist(), b["fold"].tolist()) for lex in (held_out[f],) for s, x in lex.shares(automata[f], t).items() if x >= GRID[0]]
            yield pd.DataFrame(own, columns=["id", "subject", "share"])

    own = sample.mapInPandas(score, "id bigint, subject string, share double").collect()
    given = {r["id"]: set(r["given"]) for r in sample.select("id", "given").collect()}
    lexicon.threshold, lexicon.own = calibrate([(r["id"], r["subject"], r["share"]) for r in own], given, names)
    return lexicon


def shares(docs: DataFrame, id_col: str, text_col: str, lexicon: Lexicon, least: list[float]) -> DataFrame:
    """id, subject, share of sentences, of the subjects that win at least their part ``least`` of a document's sentences."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)
    key = new_key()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        automaton = per_worker(key, lex.automaton)
        for b in batches:
            rows = [(i, lex.subjects[s], x) for i, t in zip(b["id"].tolist(), b["text"].tolist()) for s, x in lex.shares(automaton, t).items() if x >= least[s]]
            yield pd.DataFrame(rows, columns=["id", "subject", "share"])

    text = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return text.mapInPandas(run, "id bigint, subject string, share double")


def subjects_of(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, subjects: DataFrame, most: int = LABELLED_MOST) -> DataFrame:
    """id, subject, share of every subject a document treats.

    Documents without text or identifier have none; without labels the words of the scope notes alone decide, and the
    threshold is a sixth. Labels are read as doc_id and subject; wrong ones are outvoted, repeated ones count once.
    """
    lexicon = learn(docs, id_col, text_col, labels, subjects, most)
    return shares(docs, id_col, text_col, lexicon, lexicon.thresholds())


def composition(found: DataFrame, docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """source, subject, n_docs: the make-up of the corpus; documents without subject count under a null subject."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).alias("source")).join(found.select("id", "subject"), "id", "left")
    return rows.groupBy("source", "subject").agg(F.count("*").alias("n_docs"))
