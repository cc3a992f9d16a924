"""Problem 1: how often every distinct term occurs, and in how many records.

Vertical layout: every map task builds, per term, compressed sets of record identifiers (containers of 2**16
identifiers, a sorted 16-bit array or, when that is larger, a bitmap) with an occurrence counter beside each
identifier. Containers of the same term and range are merged by union, so a record that was delivered twice counts once
without shuffling any text. The document frequency is the cardinality of the union, the occurrences are the sum of its
counters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INVISIBLE = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff"))
WORD = re.compile(r"[^\W_]+")
ARRAY_MOST = 4096
FLUSH_POSTINGS = 3_000_000
POSTING = "term string, hi bigint, n int, occ bigint, ids binary, counts binary"


def terms_of(text: str) -> list[str]:
    """Longest runs of letters and digits of the text without invisible characters, in NFKC and lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(INVISIBLE))
    return WORD.findall(text.lower())


def pack_ids(low: np.ndarray) -> bytes:
    """A sorted array of 16-bit identifiers as a container."""
    if len(low) <= ARRAY_MOST:
        return low.astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return np.packbits(bits).tobytes() + b"B"  # an odd length tells a bitmap from an array


def unpack_ids(data: bytes) -> np.ndarray:
    if len(data) % 2:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data[:-1], np.uint8))).astype(np.int64)
    return np.frombuffer(data, "<u2").astype(np.int64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counters beside the identifiers: nothing if all are one, else in the least width that holds them."""
    most = int(counts.max())
    return b"" if most == 1 else counts.astype("u1").tobytes() + b"1" if most < 256 else counts.astype("<u4").tobytes() + b"4"


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    if not data:
        return np.ones(n, np.int64)
    return np.frombuffer(data[:-1], "u1" if data[-1:] == b"1" else "<u4").astype(np.int64)


def union(ids: list[bytes], counts: list[bytes]) -> tuple[int, int, bytes, bytes]:
    """Cardinality, occurrences and container of the union; an identifier in several parts keeps one counter."""
    arrays = [unpack_ids(bytes(x)) for x in ids]
    every = np.concatenate(arrays)
    beside = np.concatenate([unpack_counts(bytes(c), len(a)) for a, c in zip(arrays, counts)])
    low, first = np.unique(every, return_index=True)
    beside = beside[first]
    return len(low), int(beside.sum()), pack_ids(low), pack_counts(beside)


def build_postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each map task: a container per term and identifier range."""
    index: dict[str, list[int]] = {}
    held = 0

    def flush() -> Iterator[pd.DataFrame]:
        rows = []
        for term, flat in index.items():
            a = np.array(flat, np.int64).reshape(-1, 2)
            rid, first = np.unique(a[:, 0], return_index=True) if len(a) > 1 else (a[:, 0], [0])
            cnt, hi = a[first, 1], rid >> 16
            if hi[0] == hi[-1]:
                rows.append((term, int(hi[0]), len(rid), int(cnt.sum()), pack_ids(rid & 65535), pack_counts(cnt)))
            else:
                cuts = np.flatnonzero(np.diff(hi)) + 1
                for r, c in zip(np.split(rid, cuts), np.split(cnt, cuts)):
                    rows.append((term, int(r[0] >> 16), len(r), int(c.sum()), pack_ids(r & 65535), pack_counts(c)))
            if len(rows) >= 50_000:
                yield pd.DataFrame(rows, columns=["term", "hi", "n", "occ", "ids", "counts"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["term", "hi", "n", "occ", "ids", "counts"])

    for batch in batches:
        for rid, text in zip(batch.iloc[:, 0].tolist(), batch.iloc[:, 1].tolist()):
            for term, n in Counter(terms_of(text)).items():
                flat = index.get(term)
                if flat is None:
                    index[term] = [rid, n]
                else:
                    flat += (rid, n)
                held += 1
        if held > FLUSH_POSTINGS:
            yield from flush()
            index, held = {}, 0
    yield from flush()


def merge_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        merged = [union(list(i), list(c)) for i, c in zip(b["ids"], b["counts"])]
        yield pd.DataFrame({"term": b["term"], "n": [m[0] for m in merged], "occ": [m[1] for m in merged]})


def term_frequencies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, n_occurrences, n_records over all records of ``df``.

    Records without identifier or text hold no terms; an identifier that comes several times counts once (its text is
    taken to be the same). An empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("rid"), F.col(text_col).cast("string").alias("text"))
    postings = rows.where("rid is not null and text is not null").mapInPandas(build_postings, POSTING)
    grouped = postings.groupBy("term", "hi").agg(
        F.count("*").alias("parts"), F.max("n").alias("n"), F.max("occ").alias("occ"), F.collect_list("ids").alias("ids"), F.collect_list("counts").alias("counts")
    )
    # One scan of the shuffled groups: single parts pass through, only groups of several parts are united.
    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            one = b["parts"].to_numpy() == 1
            if one.any():
                yield b.loc[one, ["term", "n", "occ"]]
            if not one.all():
                yield from merge_parts(iter([b[~one]]))

    sized = grouped.mapInPandas(finish, "term string, n bigint, occ bigint")
    return sized.groupBy("term").agg(F.sum("occ").alias("n_occurrences"), F.sum("n").alias("n_records"))


def mark_terms(df: DataFrame, id_col: str, text_col: str, rare_most: int = 2, common_share: float = 0.1) -> DataFrame:
    """term_frequencies with ``mark``: rare (at most ``rare_most`` records), common (at least ``common_share`` of all
    distinct identifiers, those without text included) or null. A term that is both, in a tiny table, is rare."""
    total = df.agg(F.count_distinct(F.col(id_col)).alias("total")).select("total").scalar()
    mark = F.when(F.col("n_records") <= rare_most, "rare").when(F.col("n_records") >= total * F.lit(common_share), "common")
    return term_frequencies(df, id_col, text_col).withColumn("mark", mark)
