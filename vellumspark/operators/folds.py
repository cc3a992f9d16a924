"""Folds over small groups in order, many groups to a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame


def fold_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``fold`` over the rows of each group, as tuples in the order of the columns; nulls come as None.

    Groups are brought together by one shuffle and one sort inside partitions and read as a stream, so that thousands of
    small groups cost no more than their rows. One group must fit into memory.
    """
    at = [df.columns.index(k) for k in keys]
    key = itemgetter(*at)
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for b in batches:
            columns = [[None if x is pd.NaT or x != x else x for x in b[c].tolist()] if b[c].dtype.kind in "fM" else b[c].tolist() for c in b.columns]
            out: list[tuple] = []
            for k, rows in groupby(zip(*columns), key):
                part = list(rows)
                if held and key(held[0]) == k:
                    held += part
                else:
                    if held:
                        out += fold(held)
                    held = part
            if out:
                yield pd.DataFrame(out, columns=names).convert_dtypes(convert_string=False, convert_boolean=False, convert_floating=False)
        if held:
            yield pd.DataFrame(fold(held), columns=names).convert_dtypes(convert_string=False, convert_boolean=False, convert_floating=False)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
