"""Problem 2: lines repeated across the pages of one source.

Per source a count table is kept: for every key and block of 64 pages a mask of the pages it stands on. A key is the line
without letter case, blanks, punctuation, digits, dates and what a wrong encoding damages. A new partition gives such a
table, too, and is merged into it by bitwise union; only sources that the partition holds are looked at again. Keys that
stand on enough pages in one form are seeds; every line within a few misread letters of a seed belongs to it; a seed whose
lines stand on the asked share of the distinct pages is a repeated line. Only pages that hold a line which crossed the
threshold, and pages with new rows, are rebuilt.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.worker import new_key, per_worker
from vellumspark.session import join_measured, size_bytes, written

# Month names and their usual short forms in English, German, French and Spanish, in ASCII letters with
# any other letter left out, as in a key.
MONTHS = (
    "january february march april may june july august september october november december "
    "jan feb mar apr jun jul aug sept sep oct nov dec "
    "januar februar mrz mai juni juli oktober dezember okt dez "
    "janvier fvrier mars avril juin juillet aot septembre octobre novembre dcembre janv fvr avr juil dc "
    "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre ene abr ago dic"
).split()
# Words for a page and the words between a page number and a total.
PAGE_WORDS = "page pages p pp pg seite seiten s pgina pginas pgs pag pgina folio leaf blatt feuillet hoja of von de sur".split()

SHARE, LEAST_PAGES = 0.2, 4
FORM_SHARE = 0.4  # of the pages asked for, on which one form of the line must stand: noise spoils some lines, not most
BROADCAST_BYTES = 48_000_000  # of seeds; beyond that they are sorted beside the keys they are compared with
SALTS = 32

DIGITS = re.compile(r"[0-9]+")
NOT_LETTER = re.compile(r"[^a-z]+")
OTHER_SCRIPT = re.compile(r"(?<![a-z0-9])[^\x00-\x7f]{2,}(?![a-z0-9])")
OTHER_LETTER = re.compile(r"[^\W\d_\u0000-\u036f]")
ROMAN = re.compile(r"[ivxlc]+")
PAGE_SET = frozenset(PAGE_WORDS)
# A month counts as part of a date only beside a number.
_NAMES = "|".join(sorted(MONTHS, key=len, reverse=True))
DATED = re.compile(rf"(?<=\d)(?:st|nd|rd|th)?[ .,/-]*(?:de |of )?(?:{_NAMES})\b|\b(?:{_NAMES})(?=[ .,/-]*\d)")


def other_script(low: str) -> str:
    """Letters of scripts other than Latin, of words that hold two or more of them and no ASCII letter or digit: damage
    from a wrong encoding stands inside words or is a letter or two among signs."""
    runs = (OTHER_LETTER.findall(run) for run in OTHER_SCRIPT.findall(low))
    return "".join("".join(x) for x in runs if len(x) >= 2)


def key_of(raw: str | None) -> str | None:
    """Key under which lines count as the same; null for lines without a word and for bare page numbers.

    Roman numbers count as digits at either end of a line. Of words outside ASCII those in other scripts than Latin count;
    marked Latin letters, which encodings damage, do not.
    """
    if not raw:
        return None
    low = raw.lower().replace("\u00a0", " ")
    ascii_only = low.isascii()
    text = low if ascii_only else low.encode("ascii", "ignore").decode("ascii")
    if DIGITS.search(text):
        text = DIGITS.sub("", DATED.sub(" ", text))
    words = NOT_LETTER.sub(" ", text).split()
    if words and ROMAN.fullmatch(words[0]):
        words = words[1:]
    if words and ROMAN.fullmatch(words[-1]):
        words = words[:-1]
    key = "".join(words)
    other = "" if ascii_only else other_script(low)
    if other:
        return key + other
    if len(key) < 2 or sum(len(w) for w in words if w not in PAGE_SET) < 2:
        return None
    return key


def allowed_edits(n: int) -> int:
    """Misread letters between a key of ``n`` letters and the same line: none below 4, else a seventh, rounded up, at most 8."""
    return 0 if n < 4 else min(8, -(-n // 7))


def pieces_of(seed: str, most: int) -> list[str]:
    """The seed cut into most + 1 pieces; what differs from it in at most ``most`` places holds one of them unchanged."""
    n, k = len(seed), most + 1
    return [seed[n * i // k : n * (i + 1) // k] for i in range(k)]


def edits(a: str, b: str, most: int) -> int:
    """Edit distance, worked out up to ``most``; above that, most + 1. What both begin and end with is left out first."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n, m = len(a), len(b)
    i = 0
    least = min(n, m)
    while i < least and a[i] == b[i]:
        i += 1
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[i:n], b[i:m]
    if not a or not b:
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        lo, hi = max(1, i - most), min(len(b), i + most)
        if lo > 1:
            row[lo - 1], last = most + 1, row[lo - 1]
        best = row[lo - 1] if lo > 1 else i
        for j in range(lo, hi + 1):
            here = last if x == b[j - 1] else 1 + min(last, row[j], row[j - 1])
            last, row[j] = row[j], here
            best = min(best, here)
        if hi < len(b):
            row[hi + 1] = most + 1
        if best > most:
            return most + 1
    return row[len(b)]


def pairs_of(key: str) -> set[str]:
    return {key[i : i + 2] for i in range(len(key) - 1)}


class Seeds:
    """Keys of one source that stand on several pages, and which of them a key is a misreading of."""

    def __init__(self, forms: list[tuple[str, int]]) -> None:
        import ahocorasick

        self.n = dict(forms)
        self.of: list[tuple[str, int, set[str]]] = []
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)  # piece: seeds that hold it, and where it ends there
        for key in sorted(self.n):
            most = allowed_edits(len(key))
            if most:
                end = -1
                for piece in pieces_of(key, most):
                    end += len(piece)
                    places[piece].append((len(self.of), end))
                self.of.append((key, most, pairs_of(key)))
        self.pieces = ahocorasick.Automaton()
        for piece, where in places.items():
            self.pieces.add_word(piece, where)
        if places:
            self.pieces.make_automaton()
        self.any = bool(places)

    def near(self, key: str) -> list[str]:
        """Seeds that the key equals but for misread letters.

        A key that is a form itself and stands on more than half as many pages is another line of the same make, such as
        a sentence with another noun, not a misreading. A piece of the seed must stand unchanged near its place, and an
        edit touches two pairs of letters at most, so distances are worked out for few.
        """
        own, size, pairs = self.n.get(key, 0), len(key), None
        hit = [key] if own else []
        if not self.any:
            return hit
        tried: set[int] = set()
        for end, where in self.pieces.iter(key):
            for k, at in where:
                if k in tried:
                    continue
                s, most, own_pairs = self.of[k]
                if abs(end - at) > most or abs(len(s) - size) > most:
                    continue
                tried.add(k)
                if s != key and own * 2 <= self.n[s]:
                    pairs = pairs or pairs_of(key)
                    if len(own_pairs - pairs) <= 2 * most and edits(s, key, most) <= most:
                        hit.append(s)
        return hit


def keyed(df: DataFrame, source: str, page: str, raw: str, id_col: str | None = None, flag: Column | None = None) -> DataFrame:
    """source, page, key and, if asked, id and flag of the rows that have a source and a page. Keys are made in Arrow batches:
    one pass of a compiled pattern is several times cheaper here than the chain of JVM patterns it replaces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.drop(columns="raw")
            out["key"] = [key_of(x) for x in b["raw"].tolist()]
            yield out

    names = [F.col(source).cast("string").alias("source"), F.col(page).cast("bigint").alias("page"), F.col(raw).cast("string").alias("raw")]
    kept = [] if id_col is None else [F.col(id_col).cast("bigint").alias("id")]
    kept += [] if flag is None else [flag.cast("int").alias("flag")]
    rows = df.select(*names, *kept).where("source is not null and page is not null")
    return rows.mapInPandas(run, "source string, page bigint, " + ("" if id_col is None else "id bigint, ") + ("" if flag is None else "flag int, ") + "key string")


def masks(rows: DataFrame, *by: str) -> DataFrame:
    """by, block, mask: the pages of ``rows``, 64 of them to a mask."""
    page = F.expr("shiftleft(1L, int(pmod(page, 64)))")
    return rows.groupBy(*by, F.expr("page div 64 - int(page < 0 and page % 64 != 0)").alias("block")).agg(F.bit_or(page).alias("mask"))


def line_counts(rows: DataFrame) -> DataFrame:
    """Count table (source, key, block, mask) of keyed rows. The pages of a source, whatever stands on them, rest in rows
    whose key is null. A row delivered again sets a bit that is set. A line on all pages of a source is a row for 64 pages."""
    every = masks(rows.select("source", "page"), "source").select("source", F.lit(None).cast("string").alias("key"), "block", "mask")
    return masks(rows.where("key is not null"), "source", "key").unionByName(every)


def merge_counts(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The count table with the delta of a new partition. Rows of sources that the delta lacks are passed on as they are."""
    touched = delta.where("key is null").select("source").distinct()
    old = join_measured(state, touched, ["source"], "left_semi").unionByName(delta)
    return old.groupBy("source", "key", "block").agg(F.bit_or("mask").alias("mask")).unionByName(join_measured(state, touched, ["source"], "left_anti"))


def forms(counts: DataFrame, share: float = SHARE, form_share: float = FORM_SHARE) -> DataFrame:
    """source, key, n, pages: keys on enough pages to tell a line from its misreadings, two or more. Half of what a seed
    needs is enough, as a form that stands on half as many pages as a seed is no misreading of it."""
    per_block = counts.withColumn("n", F.bit_count("mask"))
    every = per_block.where("key is null").select("source", "block", F.col("n").alias("here"))
    totals = every.groupBy("source").agg(F.sum("here").alias("pages"))
    least = share * form_share / 2
    # What stands on a share of all pages stands on that share of the pages of one block at least.
    some = join_measured(per_block.where("key is not null"), every, ["source", "block"]).where(F.col("n") >= F.col("here") * least)
    some = some.select("source", "key").distinct()
    n = join_measured(per_block.where("key is not null"), written(some), ["source", "key"], "left_semi").groupBy("source", "key").agg(F.sum("n").alias("n"))
    return join_measured(n.where("n >= 2"), totals, ["source"]).where(F.col("n") >= F.col("pages") * least).select("source", "key", "n", "pages")


def matched(rows: DataFrame, of: DataFrame) -> DataFrame:
    """The rows (source, key, block, mask) that are near a form of ``of``, one for each: with seed, seed_n, pages.

    Forms that together are small, which is measured, go to every executor and are indexed there once; others are sorted
    in before the keys of their source, a source over SALTS tasks.
    """
    schema = "source string, key string, block bigint, mask bigint, seed string, seed_n bigint, pages bigint"
    columns = ["source", "key", "block", "mask", "seed", "seed_n", "pages"]
    rows = rows.where("key is not null").select("source", "key", "block", "mask")
    if size_bytes(of) <= BROADCAST_BYTES:
        held: dict[str, list[tuple[str, int]]] = defaultdict(list)
        pages: dict[str, int] = {}
        for r in of.toLocalIterator():
            held[r["source"]].append((r["key"], r["n"]))
            pages[r["source"]] = r["pages"]
        shared, name = rows.sparkSession.sparkContext.broadcast((dict(held), pages)), new_key()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, total = shared.value
            index: dict[str, Seeds] = per_worker(name, dict)
            for b in batches:
                out = []
                for source, key, block, mask in zip(*(b[c].tolist() for c in ("source", "key", "block", "mask"))):
                    seeds = index.get(source)
                    if seeds is None:
                        seeds = index[source] = Seeds(known.get(source, []))
                    if hit := seeds.near(key):
                        out += [(source, key, block, mask, s, seeds.n[s], total[source]) for s in hit]
                yield pd.DataFrame(out, columns=columns)

        return rows.mapInPandas(run, schema)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, known, total, seeds = None, [], 0, None
        for b in batches:
            out = []
            for s, key, block, mask, n, all_pages in zip(*(b[c].tolist() for c in ("source", "key", "block", "mask", "n", "pages"))):
                if s != source:
                    source, known, seeds = s, [], None
                if n > 0:
                    known.append((key, n))
                    total = all_pages
                    continue
                seeds = seeds or Seeds(known)
                out += [(s, key, block, mask, x, seeds.n[x], total) for x in seeds.near(key)]
            yield pd.DataFrame(out, columns=columns)

    zero = F.lit(0).cast("bigint")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    first = of.select("source", "key", zero.alias("block"), zero.alias("mask"), "n", "pages", salts)
    then = rows.select("source", "key", "block", "mask", zero.alias("n"), zero.alias("pages"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    both = first.unionByName(then).repartition("source", "salt").sortWithinPartitions("source", "salt", F.col("n").desc())
    return both.mapInPandas(merged, schema)


def crossed_keys(counts: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES, form_share: float = FORM_SHARE) -> DataFrame:
    """source, key of the lines over the threshold, from a count table alone (no original lines are read)."""
    hits = written(matched(counts, written(forms(counts, share, form_share))))
    pages = hits.groupBy("source", "seed", "block").agg(F.bit_or("mask").alias("mask"), F.max("pages").alias("pages"), F.max("seed_n").alias("seed_n"))
    total = pages.groupBy("source", "seed").agg(F.sum(F.bit_count("mask")).alias("n"), F.max("pages").alias("pages"), F.max("seed_n").alias("seed_n"))
    asked = F.col("pages") * share
    over = total.where((F.col("n") >= asked) & (F.col("n") >= least_pages) & (F.col("seed_n") >= asked * form_share)).select("source", "seed")
    return join_measured(hits, over, ["source", "seed"], "left_semi").select("source", "key").distinct()


@dataclass
class State:
    """What is kept from partition to partition: keyed lines, count table, keys over the threshold. Each is a table of
    Parquet files in the shared folder; ``keys`` holds those of each threshold that was asked for."""

    rows: DataFrame
    counts: DataFrame
    keys: dict[tuple[float, int], DataFrame] = field(default_factory=dict)

    def repeated(self, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
        """source, key of the lines over the threshold now."""
        if (share, least_pages) not in self.keys:
            self.keys[share, least_pages] = written(crossed_keys(self.counts, share, least_pages))
        return self.keys[share, least_pages]

    def ids(self, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
        rows = self.rows.where("id is not null and key is not null")
        return join_measured(rows, self.repeated(share, least_pages), ["source", "key"], "left_semi").select("id").distinct()


def merge_partition(state: State | None, lines: DataFrame, id_col: str, source: str, page: str, raw: str) -> State:
    """The state with a new partition of lines; without a state the partition is the first."""
    rows = written(keyed(lines, source, page, raw, id_col))
    delta = written(line_counts(rows))
    if state is None:
        return State(rows, delta)
    return State(state.rows.unionByName(rows), written(merge_counts(state.counts, delta)))


def to_rebuild(before: State, now: State, lines: DataFrame, source: str, page: str) -> DataFrame:
    """source, page of the pages that must be made anew after ``lines`` came in: those with new rows, and those with a line
    that crossed the threshold in either direction, of which the keyed rows tell where they stand."""
    old, new = before.repeated(), now.repeated()
    changed = written(new.exceptAll(old).unionByName(old.exceptAll(new)))
    fresh = lines.select(F.col(source).cast("string").alias("source"), F.col(page).cast("bigint").alias("page")).where("source is not null and page is not null")
    return join_measured(now.rows, changed, ["source", "key"], "left_semi").select("source", "page").unionByName(fresh).distinct()


def arrivals(df: DataFrame, at: str | None, days: int = 31) -> list[DataFrame]:
    """Partitions in the order they came in: what arrived within ``days`` of the first row, and what came later."""
    first = df.agg(F.min(at).alias("t")).first()["t"] if at else None
    if first is None:
        return [df]
    late = F.coalesce(F.col(at) >= F.lit(first + timedelta(days=days)), F.lit(True))
    return [df.where(~late), df.where(late)]


def repeated_lines(df: DataFrame, id_col: str, source: str, page: str, raw: str, share: float = SHARE, least_pages: int = LEAST_PAGES, arrived: str | None = None) -> DataFrame:
    """id of every line that stands on at least ``share`` of the distinct pages of its source and on ``least_pages``.

    The count table is built from the partitions in the order of ``arrived``, each merged as a delta; the order does not
    change the result. A row without identifier, source, page or text is never repeated; equal identifiers come out once;
    bare page numbers are left out; an empty table gives no rows. Only columns named are used, so further columns may have
    any name.
    """
    state = None
    for part in arrivals(df, arrived):
        state = merge_partition(state, part, id_col, source, page, raw)
    return state.ids(share, least_pages)


def pages_without(df: DataFrame, repeated: DataFrame, id_col: str, source: str, page: str, seq: str, raw: str) -> DataFrame:
    """source, page, n_removed and the text of each page without its repeated lines, in the order of ``seq``.

    ``repeated`` holds the ids to remove. A page of nothing but repeated lines keeps an empty text; rows delivered again
    count once; lines without text add nothing.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.col(page).cast("bigint").alias("page"), F.col(seq).alias("seq"), F.col(raw).alias("raw"))
    rows = rows.where("source is not null and page is not null").groupBy("source", "page", "id").agg(F.min(F.struct("seq", "raw")).alias("r"))
    rows = rows.join(repeated.select("id", F.lit(True).alias("gone")), "id", "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("gone").isNull() & F.col("r.raw").isNotNull(), F.struct("r.seq", "id", "r.raw"))))
    return rows.groupBy("source", "page").agg(F.count("gone").alias("n_removed"), F.array_join(F.transform(kept, lambda x: x["raw"]), "\n").alias("text"))


def pages_in_parts(df: DataFrame, id_col: str, source: str, page: str, seq: str, raw: str, arrived: str | None = None) -> DataFrame:
    """The pages as ``pages_without`` gives them, made partition by partition: each new one rebuilds the pages it touches and
    those with newly crossed lines, the others are taken over as they are."""
    state, pages, seen = None, None, None
    for part in arrivals(df, arrived):
        now = merge_partition(state, part, id_col, source, page, raw)
        seen = part if seen is None else seen.unionByName(part)
        if pages is None:
            pages = written(pages_without(seen, now.ids(), id_col, source, page, seq, raw))
        else:
            anew = written(to_rebuild(state, now, part, source, page))
            spot = seen.join(anew.select(F.col("source").alias("_source"), F.col("page").alias("_page")), (F.col(source).cast("string") == F.col("_source")) & (F.col(page).cast("bigint") == F.col("_page")), "left_semi")
            pages = pages.join(anew, ["source", "page"], "left_anti").unionByName(pages_without(spot, now.ids(), id_col, source, page, seq, raw))
        state = now
    return pages
