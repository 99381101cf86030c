"""Importance resampling towards a target distribution.

An untrained Regex Split pre-tokenises ASCII-lowered texts into words with offsets. Windows over the
pairs of offsets are the features; their CRC buckets are counted over all documents and over the target
texts, and a document's weight is the mean log ratio of its features' buckets. Documents are drawn
by weight plus Gumbel noise from a hash of their id.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from mlledger.llm.common import fresh_name, hashes, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = 1  # words of a feature
BUCKETS = 10_000
MIN_WORDS, DRAWN_PERCENT, SEED = 20, 10, 2024
#: A longer text is pre-tokenised in pieces of about so many characters.
PIECE = 1 << 20
#: Features whose bucket a task remembers.
CACHED = 1 << 17
#: Equal rows are numbered in runs of so many.
RUN = 4096
FEATURES = "doc_id long, k1 long, k2 long, n_words long, n_features long, buckets array<int>, counts array<long>"


def splitter() -> Split:
    """Keeps the words and removes what stands between them."""
    return Split(Regex(WORD), behavior="removed", invert=True)


def pieces(text: str, size: int) -> Iterator[str]:
    """Pieces of at least ``size`` signs but the last one; each ends at a space or the like, never
    inside a word. A run without such a sign stays whole."""
    start = 0
    while start < len(text):
        end = start + size
        while end < len(text) and (text[end].isalnum() or text[end] >= "\x80"):
            end += 1
        yield text[start:end]
        start = end


def features(text: str, split: Split, longest: int, piece: int = PIECE) -> Iterator[tuple[int, list[str]]]:
    """(words, features) of each piece of a text: all runs of 1 to ``longest`` consecutive words,
    joined by one space. A piece goes on from the last words of the one before."""
    carried: list[str] = []
    lowered = text.encode().lower().decode()  # bytes lower A-Z only
    for part in pieces(lowered, piece):
        found = split.pre_tokenize_str(part)
        words = carried + [word for word, _ in found]
        runs = words[len(carried) :]
        for run in range(2, longest + 1):
            # Runs that end in the carried words were given with the piece before.
            first = max(0, len(carried) - run + 1)
            runs += [" ".join(words[i : i + run]) for i in range(first, len(words) - run + 1)]
        yield len(found), runs
        carried = words[len(words) - longest + 1 :] if longest > 1 else []


def with_features(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """FEATURES of (doc_id, text), one row each: distinct buckets, ascending, and how often each occurs;
    so a row has at most ``buckets`` entries however long its text is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, bucket_of = splitter(), {}
        for batch in batches:
            rows = []
            for text in batch.pop("text"):
                n_words, n_features, counts = 0, 0, Counter()
                for n, found in features(text, split, longest):
                    n_words += n
                    n_features += len(found)
                    for feature, times in Counter(found).items():
                        bucket = bucket_of.get(feature)
                        if bucket is None:
                            if len(bucket_of) >= CACHED:
                                bucket_of.clear()
                            bucket = bucket_of[feature] = zlib.crc32(feature.encode()) % buckets
                        counts[bucket] += times
                places = sorted(counts)
                rows.append((n_words, n_features, places, [counts[b] for b in places]))
            names = ["n_words", "n_features", "buckets", "counts"]
            yield pd.concat([batch, pd.DataFrame(rows, columns=names, index=batch.index)], axis=1)

    k1, k2 = hashes(F.col("doc_id"), F.col("text"))
    return texts.select(
        "doc_id", k1.alias("k1"), k2.alias("k2"), F.coalesce("text", F.lit("")).alias("text")
    ).mapInPandas(run, FEATURES)


def histogram(featured: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs. Each task adds up its rows first; the driver gets one number a
    bucket."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for places, counts in zip(batch["buckets"], batch["counts"], strict=True):
                total[places] += counts  # distinct places
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    rows = (
        featured.select("buckets", "counts")
        .mapInPandas(add, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row.bucket] = row.n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / share in the documents)) of each bucket, with one added."""
    buckets = len(documents)
    s_all, t_all = int(documents.sum()) + buckets, int(target.sum()) + buckets
    return np.array(
        [
            math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all)))
            for s, t in zip(documents.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weighed(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, k1, k2, n_words, n_features, weight: the floored mean gain of a row's features."""

    @F.pandas_udf("long")
    def total(buckets: pd.Series, counts: pd.Series) -> pd.Series:
        sums = [int(gain[b] @ n) for b, n in zip(buckets, counts, strict=True)]
        return pd.Series(sums, dtype="int64")

    n = F.col("n_features")
    mean = F.expr("(total - pmod(total, n_features)) div n_features")  # div cuts off, this floors
    return (
        featured.select("doc_id", "k1", "k2", "n_words", "n_features", total("buckets", "counts").alias("total"))
        .withColumn("weight", F.when(n > 0, mean).otherwise(F.lit(0)).cast("long"))
        .drop("total")
    )


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 x Gumbel noise) from a hash of seed and id; a null id is the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, drawn_percent: int, min_words: int) -> DataFrame:
    """Adds ``rank`` to stored rows with doc_id, n_words and score: the drawn ones are numbered by
    (score descending, doc_id, nulls last, k1, k2), the others get null.

    Scores are whole numbers between bounds that grow with the logarithm of the counts only, so
    their histogram has some 100,000 rows at any size and says where the draw ends. Equal rows are
    one until they are numbered, so a hot one sorts in no single task.
    """
    fit = scored.filter(F.col("n_words") >= min_words)
    per_score = stored(fit.groupBy("score").agg(F.count("*").alias("n")), "resampling-scores")
    wanted = (per_score.agg(F.sum("n")).first()[0] or 0) * drawn_percent // 100
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        per_score.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0)))
        .filter(F.col("before") < wanted)
        .select("score", "before")
    )
    names = scored.columns
    classes = scored.groupBy(*names).agg(F.count("*").alias("copies"))
    classes = classes.join(starts, "score", "left").withColumn(
        "before", F.when(F.col("n_words") >= min_words, F.col("before"))
    )
    ties = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "k1", "k2")
    earlier = F.coalesce(
        F.sum("copies").over(ties.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    chosen = classes.filter("before IS NOT NULL").withColumn("first", F.col("before") + earlier + 1)
    rest = classes.filter("before IS NULL").withColumn("first", F.lit(None).cast("long"))
    # A class's copies come back in runs, so one of them is never a single array.
    runs = chosen.union(rest).withColumn(
        "from", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(RUN)))
    )
    spread = runs.filter(F.col("copies") > RUN).repartition("from", "k1", "k2")
    until = F.least(F.col("copies"), F.col("from") + RUN) - 1
    rank = F.col("first") + F.col("place")
    return (
        runs.filter(F.col("copies") <= RUN)
        .union(spread)
        .withColumn("place", F.explode(F.sequence(F.col("from"), until)))
        .select(*names, F.when(rank <= wanted, rank).alias("rank"))
    )


def resample(
    documents: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    drawn_percent: int = DRAWN_PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, k1, k2, n_words, n_features, weight, score, rank of every row of documents.

    (k1, k2) identify a (doc_id, text). rank numbers the drawn rows from 1, the others have null.

    Args:
        documents: doc_id, text; other columns are ignored.
        target: text; other columns are ignored.
        longest: words of the longest feature.
        buckets: hash buckets. The driver holds a few numbers for each of them.
        min_words: rows with fewer words are never drawn.
        drawn_percent: of the rows with enough words, rounded down.
        seed: of the noise.

    A null text has no words, weight 0 and is never drawn. Repeated rows and equal ids are rows of
    their own; the noise follows the id, so equal ids share it, and all null ids do. Ties go to the
    smaller doc_id, null last. A very long text is split in pieces within its task. Empty tables on
    either side are fine; without target texts every target count is 0.
    """
    featured = stored(with_features(documents, longest, buckets), "resampling-features")
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    gain = gains(
        histogram(featured, buckets), histogram(with_features(wanted, longest, buckets), buckets)
    )
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    scored = stored(weighed(featured, gain).withColumn("score", score), "resampling-weights")
    return ranked(scored, drawn_percent, min_words)


def drawn_documents(documents: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn rows of ``documents`` with all their columns.

    Of rows with one doc_id and text all come back if the draw ends among them.
    """
    a, b = fresh_name(documents, "_k1"), fresh_name(documents, "_k2")
    k1, k2 = hashes(F.col("doc_id"), F.col("text"))
    drawn = resample(documents, target, **options).filter("rank IS NOT NULL")
    keys = drawn.select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    return documents.withColumns({a: k1, b: k2}).join(keys, [a, b], "left_semi").drop(a, b)
