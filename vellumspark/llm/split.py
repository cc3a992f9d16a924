"""Problem 4: cut oversized texts into pieces under a limit, at the strongest natural boundary, with an overlap.

Each position between two characters has a boundary strength. A sparse table answers range-maximum queries over these
strengths: the strongest cut in the permissible window is taken, of equals the rightmost. The next piece starts one
overlap further left, or somewhat later so as to start at a boundary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2200, 200
STRETCH = 1 << 17  # positions that the sparse table covers at a time
# Strength of a cut at the end of each pattern, strongest first.
BOUNDARIES = [
    (7, re.compile(r"\n[^\S\n]*\n\s*(?=#)")),
    (6, re.compile(r"\n[^\S\n]*\n\s*")),
    (5, re.compile(r"\n\s*(?=[-*•#>|]|\d+[.)])")),
    (4, re.compile(r"(?<=[.!?…])[\"”’»)\]]*\s+(?=[\"“«¿¡(\[]?[^\W\d_a-zß-öø-ÿ])")),
    (3, re.compile(r"[.!?…;:][\"”’»)\]]*\s+|\n\s*")),
    (2, re.compile(r"[,–—][\"”’»)\]]*\s+")),
    (1, re.compile(r"\s+")),
]


def strengths(text: str) -> np.ndarray:
    """Boundary strength of a cut before each position; 0 inside words."""
    s = np.zeros(len(text) + 1, np.int8)
    for value, pattern in reversed(BOUNDARIES):
        at = [m.end() for m in pattern.finditer(text)]
        if at:
            s[at] = np.maximum(s[at], value)
    return s


class RangeMax:
    """Sparse table over strengths; the rightmost position of the maximum of a closed range of at most ``widest``
    positions, in constant time."""

    def __init__(self, values: np.ndarray, widest: int | None = None) -> None:
        n = len(values)
        key = values.astype(np.int64) * (n + 1) + np.arange(n)  # of equal strengths the rightmost is greatest
        self.n, self.levels = n, [key]
        width = 1
        while 2 * width <= min(n, widest or n):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[: n - 2 * width + 1], last[width : n - width + 1]))
            width *= 2

    def query(self, lo: int, hi: int) -> int:
        level = (hi - lo + 1).bit_length() - 1
        row = self.levels[level]
        return int(max(row[lo], row[hi - (1 << level) + 1])) % (self.n + 1)


def cuts(text: str, room: int, overlap: int) -> list[tuple[int, int]]:
    """Starts and ends of the pieces of ``text``, each of at most ``room`` characters; together they cover it. The table
    holds one stretch of the text after the other, so that its size does not grow with the text."""
    n = len(text)
    if n <= room:
        return [(0, n)]
    overlap = min(overlap, room // 4)
    s = strengths(text)
    base, best = 0, RangeMax(s[: STRETCH + room], room)
    out, start, least = [], 0, max(overlap + 1, room // 2)
    while n - start > room:
        if start + room >= base + best.n:
            base, best = start, RangeMax(s[start : start + STRETCH + room], room)
        end = base + best.query(start + least - base, start + room - base)
        if s[end] == 0:
            end = start + room
        out.append((start, end))
        back = base + best.query(end - overlap - base, end - overlap * 3 // 4 - base) if overlap else end
        start = back if s[back] > 0 else end - overlap
    out.append((start, n))
    return out


def heading_of(path: object) -> str:
    return "" if path is None or len(path) == 0 else " > ".join("" if x is None else str(x) for x in path)


def split_text(text: str, path: object, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, piece) of the outer-trimmed text; each piece starts with the heading path and a line break.

    A heading path that leaves less than a quarter of the limit is cut to that length, so that any text fits.
    """
    text, head = text.strip(), heading_of(path)
    if head:
        head = head[: limit * 3 // 4 - 1] + "\n"
    return [(a, b, head + text[a:b]) for a, b in cuts(text, limit - len(head), overlap)]


# Python's str.strip and this class agree: all Unicode white space and the separators U+001C to U+001F.
_OUTER = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


def size_of(text: Column, path: Column) -> Column:
    """Characters of the outer-trimmed text plus, if there is a heading path, that of the path and a line break."""
    joined = F.array_join(F.transform(path, lambda x: F.coalesce(x, F.lit(""))), " > ")
    head = F.when(path.isNotNull() & (F.size(path) > 0), F.length(joined) + 1).otherwise(0)
    return F.length(F.regexp_replace(text, _OUTER, "")) + head


def oversized(df: DataFrame, id_col: str, text_col: str, path_col: str, limit: int = LIMIT) -> DataFrame:
    """The rows of ``df`` over the limit, one of each identifier, as id, text, path. The filter runs in the scan stage,
    so only the few large texts are shuffled to drop rows that were delivered again."""
    big = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(path_col).alias("path"))
    # A raw length at or under the limit less the path cannot pass; it spares the trim of most rows.
    return big.where(F.col("id").isNotNull() & (size_of(F.col("text"), F.col("path")) > limit)).dropDuplicates(["id"])


def split_oversized(df: DataFrame, id_col: str, text_col: str, path_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """id, piece_no (from 1), start, end, piece for every row over the limit.

    Rows without identifier or text have no size and give nothing; rows of one identifier count once; an empty or null
    heading path adds nothing. Start and end are positions in the outer-trimmed text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, s, e, p) for i, t, h in zip(b["id"], b["text"], b["path"]) for k, (s, e, p) in enumerate(split_text(t, h, limit, overlap), 1)]
            yield pd.DataFrame(rows, columns=["id", "piece_no", "start", "end", "piece"])

    return oversized(df, id_col, text_col, path_col, limit).mapInPandas(run, "id bigint, piece_no int, start int, end int, piece string")
