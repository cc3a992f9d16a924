"""Full-text search over units: an index of postings, conjunctive and phrase match, weighted BM25, snippets.

The index is made once: postings (term, unit_id, col, n, positions), clustered by term, and the lengths of units, both as
Parquet. A query reads the terms it names, as their filter reaches the scan, and the lengths of the units it finds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.session import written

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"
MARKED = r"[\p{L}\p{N}][\p{L}\p{N}\x{0300}-\x{036F}]*"  # a token in text as it stands: marks belong to their letter


@dataclass(frozen=True)
class Term:
    """Consecutive words; of a prefix term the last word only begins so."""

    words: tuple[str, ...]
    prefix: bool = False


def parse_query(q: str) -> list[Term]:
    """Quoted phrases stay together, hyphenated words are phrases, the last bare word is a prefix; all must match."""
    parts = re.findall(r'"([^"]+)"|(\S+)', q.strip())
    terms = []
    for i, (phrase, word) in enumerate(parts):
        text = phrase or re.sub(r"[^\w\-]", "", word).replace("-", " ")
        found = tuple(re.findall(r"[^\W_]+", "".join(T.bare_letter(c) for c in text.lower())))
        if found:
            terms.append(Term(found, not phrase and i == len(parts) - 1))
    return terms


def tokens_of(c: Column) -> Column:
    """Lower-case tokens without diacritics."""
    return F.regexp_extract_all(T.bare(F.lower(c)), F.lit(TOKEN), F.lit(0))


def postings(units: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """unit_id, col, pos (from 0), term of every token; nulls hold none."""
    each = F.array(*[F.struct(F.lit(i).alias("col"), tokens_of(F.col(c)).alias("toks")) for i, c in enumerate(columns)])
    rows = units.select(F.col(id_col).alias("unit_id"), F.explode(each).alias("e")).select("unit_id", "e.*")
    return rows.select("unit_id", "col", F.posexplode("toks").alias("pos", "term"))


def lengths(units: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """unit_id, n_tokens over all columns."""
    total = reduce(Column.__add__, [F.coalesce(F.size(tokens_of(F.col(c))), F.lit(0)) for c in columns])
    return units.select(F.col(id_col).alias("unit_id"), F.greatest(total, F.lit(0)).cast("bigint").alias("n_tokens"))


@dataclass(frozen=True)
class Index:
    """Tables of an index and the number and mean length of its units."""

    postings: DataFrame
    lengths: DataFrame
    n_units: int
    avg_tokens: float


def _index(post: DataFrame, size: DataFrame) -> Index:
    r = size.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("a")).first()
    return Index(post, size, r["n"], r["a"] or 0.0)


def build(units: DataFrame, id_col: str, columns: list[str], path: str | None = None) -> Index:
    """Index of units, written below ``path`` or, without one, in the shared folder. Ranges of (term, unit) part the postings,
    so a term that stands in all units is spread over files."""
    post = postings(units, id_col, columns).groupBy("term", "unit_id", "col").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    post = post.select("term", "unit_id", "col", F.size("positions").cast("bigint").alias("n"), "positions").repartitionByRange("term", "unit_id").sortWithinPartitions("term", "unit_id", "col")
    size = lengths(units, id_col, columns)
    if path is None:
        return _index(written(post), written(size))
    post.write.mode("overwrite").parquet(f"{path}/postings")
    size.write.mode("overwrite").parquet(f"{path}/lengths")
    return open_index(units.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return _index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def matches(index: Index, term: Term) -> DataFrame:
    """unit_id, col, n: how often a term, phrase or prefix stands in a column. Of a phrase, places where it may begin are
    taken from each word's positions; it stands where all words agree."""
    is_word = lambda k: F.col("term").startswith(term.words[k]) if term.prefix and k == len(term.words) - 1 else F.col("term") == term.words[k]
    if len(term.words) == 1:
        return index.postings.where(is_word(0)).groupBy("unit_id", "col").agg(F.sum("n").alias("n"))
    begins = [index.postings.where(is_word(k)).select("unit_id", "col", F.lit(k).alias("k"), F.explode("positions").alias("at")).withColumn("at", F.col("at") - k) for k in range(len(term.words))]
    places = reduce(DataFrame.unionByName, begins).groupBy("unit_id", "col", "at").agg(F.count_distinct("k").alias("k")).where(F.col("k") == len(term.words))
    return places.groupBy("unit_id", "col").agg(F.count("*").alias("n"))


def find(index: Index, query: str, weights: list[float] | None = None, limit: int = 50, among: DataFrame | None = None) -> DataFrame:
    """unit_id, score: the best ``limit`` units that match all terms, greater is better, ties by unit_id.

    BM25 (k1 1.2, b 0.75) with weights on the columns' frequencies, 1 where none is given. ``among`` (unit_id) filters the
    result, not the statistics. An empty or malformed query finds nothing.
    """
    terms = parse_query(query)
    if not terms:
        return index.lengths.where("false").select("unit_id", F.lit(0.0).alias("score"))
    weight = reduce(lambda acc, iw: F.when(F.col("col") == iw[0], iw[1]).otherwise(acc), enumerate(weights or []), F.lit(1.0))
    per_term = [matches(index, t).groupBy("unit_id").agg(F.sum(F.col("n") * weight).alias("tf")).withColumn("t", F.lit(i)) for i, t in enumerate(terms)]
    tf = reduce(DataFrame.unionByName, per_term)
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    wanted = tf.groupBy("unit_id").agg(F.count("*").alias("k")).where(F.col("k") == len(terms)).select("unit_id")
    if among is not None:
        wanted = wanted.join(among.select("unit_id").distinct(), "unit_id", "left_semi")
    rows = tf.join(wanted, "unit_id", "left_semi").join(index.lengths, "unit_id").join(F.broadcast(df), "t")  # a row per term of the query
    idf = F.greatest(F.log((index.n_units - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = K1 * (1 - B + B * F.col("n_tokens") / index.avg_tokens)
    score = F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
    return rows.groupBy("unit_id").agg(F.round(score, 6).alias("score")).orderBy(F.desc("score"), "unit_id").limit(limit)


def search(units: DataFrame, id_col: str, columns: list[str], query: str, weights: list[float] | None = None, limit: int = 50, where: Column | None = None) -> DataFrame:
    """``find`` over an index made for this one query; where many are asked, ``build`` it once."""
    return find(build(units, id_col, columns), query, weights, limit, None if where is None else units.where(where).select(F.col(id_col).alias("unit_id")))


def snippet(text: Column, terms: str | list[Term], width: int = 28) -> Column:
    """``width`` tokens around the first hit, every word, phrase and prefix hit in double brackets, an ellipsis where text is
    left out; null without a hit."""
    terms = [Term((terms,))] if isinstance(terms, str) else terms
    toks = F.regexp_extract_all(text, F.lit(MARKED), F.lit(0))
    low = F.transform(toks, lambda x: T.bare(F.lower(x)))
    n = F.size(low)
    # Shifted copies side by side: a lambda that reads the array again would cut the text anew for every token.
    longest = max((len(t.words) for t in terms), default=1)
    side = F.arrays_zip(*[(low if k == 0 else F.slice(low, F.lit(k + 1), F.greatest(n - k, F.lit(0)))).alias(f"w{k}") for k in range(longest)])

    def begins(t: Term) -> Column:
        same = lambda z: [F.coalesce(z[f"w{k}"].startswith(w) if t.prefix and k == len(t.words) - 1 else z[f"w{k}"] == w, F.lit(False)) for k, w in enumerate(t.words)]
        return F.transform(side, lambda z: reduce(Column.__and__, same(z)))

    starts = [begins(t) for t in terms]
    ends = [F.slice(F.concat(F.array_repeat(F.lit(False), len(t.words) - 1), b), F.lit(1), F.greatest(n, F.lit(1))) for t, b in zip(terms, starts)]
    either = lambda cs: reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False))), cs)
    opens, closes = either(starts), either(ends)
    at = F.array_position(opens, True).cast("int")
    start = F.greatest(F.lit(1), F.least(at - width // 2, F.size(toks) - width + 1))
    part = F.transform(F.slice(F.arrays_zip(toks.alias("x"), opens.alias("o"), closes.alias("c")), start, F.lit(width)), lambda z: F.concat(F.when(z["o"], "[[").otherwise(""), z["x"], F.when(z["c"], "]]").otherwise("")))
    body = F.array_join(part, " ")
    return F.when(at > 0, F.concat(F.when(start > 1, " … ").otherwise(""), body, F.when(start + width <= F.size(toks), " … ").otherwise("")))


def replace_units(index: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the keys in ``fresh`` replaced: delete, then insert."""
    return index.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def reindexed(index: Index, gone: DataFrame, fresh: Index) -> Index:
    """The index without the units of ``gone`` (unit_id) and with those of ``fresh``, postings and lengths alike."""
    out = lambda old, new: old.join(gone.select("unit_id").distinct(), "unit_id", "left_anti").unionByName(new)
    return _index(written(out(index.postings, fresh.postings)), written(out(index.lengths, fresh.lengths)))


def top_terms(units: DataFrame, id_col: str, column: str, most: int) -> DataFrame:
    """term, n_units of the most frequent terms."""
    per = units.select(F.col(id_col).alias("unit_id"), F.explode(F.array_distinct(tokens_of(F.col(column)))).alias("term"))
    return per.groupBy("term").agg(F.count("*").alias("n_units")).orderBy(F.desc("n_units"), "term").limit(most)


__all__ = ["Index", "Term", "build", "find", "lengths", "matches", "open_index", "parse_query", "postings", "reindexed", "replace_units", "search", "snippet", "tokens_of", "top_terms"]
