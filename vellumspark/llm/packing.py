"""Problem 6: fill containers of fixed capacity with items of varying length, splitting only what exceeds a container.

Minimum bin slack over the histogram of lengths. Only lengths matter for a packing, and there are at most ``capacity``
of them, so the plan is made once from the histogram, however many items there are: the largest remaining length opens
a container, a bitset subset-sum picks the multiset of remaining lengths that fills it closest to capacity, and the
pattern found is used as often as the counts allow. The items then take the slots of their length by rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.session import checkpointed

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUCKET = 100_000
# Fixed value: the public pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vellum", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, n_tokens; a null or empty text has no tokens. ``tokenizer`` is a path that every executor can read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id bigint, n_tokens int")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the remaining lengths (descending) whose sum comes closest to ``room`` without exceeding it."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room or not counts[length]:
            continue
        copies, part = min(counts[length], room // length), 1
        while copies > 0:
            n = min(part, copies)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & full
            copies, part = copies - n, part * 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):  # a sum that was reachable before did not need this step
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + n
            at -= length * n
    return taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(repetitions, lengths with counts) of each kind of container; every item of the histogram has one slot.

    Each pattern uses up at least one length, so the plan has no more patterns than twice the capacity or so, and the
    work does not grow with the number of items.
    """
    counts = {k: v for k, v in histogram.items() if k > 0 and v > 0}
    lengths, patterns = sorted(counts, reverse=True), []
    for largest in list(lengths):
        while counts[largest]:
            counts[largest] -= 1
            taken = fullest(lengths, counts, capacity - largest)
            taken[largest] = taken.get(largest, 0) + 1
            counts[largest] += 1
            times = min(counts[k] // n for k, n in taken.items())
            for k, n in taken.items():
                counts[k] -= n * times
            patterns.append((times, taken))
    return patterns


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows of first rank, first container, copies in each container; ascending by rank."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    base = 0
    for times, taken in patterns:
        for length, n in taken.items():
            out.setdefault(length, []).append((used.get(length, 0), base, n))
            used[length] = used.get(length, 0) + n * times
        base += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, piece_no, token_from, token_to, container for every row of ``df``.

    A text of more than ``capacity`` tokens is split into full pieces and a rest; every other text stays whole. A text
    without tokens (null, empty) takes no space and is put into container 0. Rows without identifier are packed too;
    equal identifiers are packed as separate items. Containers count from 0 without gaps.
    """
    spark = df.sparkSession
    counted = count_tokens(df, id_col, text_col, tokenizer)
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    pieces = counted.withColumn("piece_no", F.explode(F.sequence(F.lit(1), n_pieces))).select(
        "id", "piece_no", ((F.col("piece_no") - 1) * capacity).alias("token_from"), F.least(F.col("n_tokens"), F.col("piece_no") * capacity).alias("token_to")
    )
    pieces = checkpointed(pieces.withColumn("length", F.col("token_to") - F.col("token_from")).withColumn("part", F.spark_partition_id()))
    # Rank within a length without a window over all its items: a length with many items is spread over buckets.
    sizes = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` + 1 rows
    histogram = {r["length"]: r["n"] for r in sizes}
    many = {k: -(-v // BUCKET) for k, v in histogram.items()}
    spread = spark.createDataFrame([(k, v) for k, v in many.items()] or [(0, 1)], "length int, buckets int")
    bucketed = pieces.join(F.broadcast(spread), "length").withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), F.col("buckets")).cast("int"))
    by_length = slots(plan(histogram, capacity))
    held = {(r["length"], r["bucket"]): r["n"] for r in bucketed.where("buckets > 1").groupBy("length", "bucket").agg(F.count("*").alias("n")).collect()} if any(v > 1 for v in many.values()) else {}
    first = {}  # one row per 100,000 items of a hot length
    for length, n in many.items():
        at = 0
        for b in range(n):
            first[length, b] = at
            at += held.get((length, b), 0) if n > 1 else histogram[length]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            container = np.zeros(len(b), np.int64)
            for (length, bucket), at in b.groupby(["length", "bucket"]).indices.items():
                if length > 0:
                    rank = b["rank"].to_numpy()[at] + first[length, bucket]
                    table = by_length[length]
                    k = np.searchsorted(table[:, 0], rank, "right") - 1
                    container[at] = table[k, 1] + (rank - table[k, 0]) // table[k, 2]
            yield pd.DataFrame({"id": b["id"], "piece_no": b["piece_no"], "token_from": b["token_from"], "token_to": b["token_to"], "container": container})

    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece_no", "part")) - 1
    return bucketed.withColumn("rank", rank).mapInPandas(assign, "id bigint, piece_no int, token_from int, token_to int, container bigint")
