"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad. A line's features are shares of kinds of bytes and of repeated
words, of the line itself and of its neighbours; neighbouring labels are coupled. Forward-backward
gives each line's probability of being good, and their mean, weighted by line length, is the
document's score. The field is fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlledger.llm.common import stored

#: Labelled documents that the field is fitted on, and lines of all of them together. A document is
#: learnt from whole or not at all.
SAMPLE_DOCUMENTS = 4000
SAMPLE_LINES = 400_000
#: Longer documents are learnt as several chains of so many lines.
CHAIN_LINES = 2000
#: Bytes of text whose features are computed at once.
CHUNK_BYTES = 1 << 22

LOWER, UPPER, DIGIT, SPACE, STOP, BAR, SIGN, HIGH, BREAK = range(9)
KINDS = np.full(256, SIGN, dtype=np.int64)
KINDS[128:] = HIGH
KINDS[ord("a") : ord("z") + 1] = LOWER
KINDS[ord("A") : ord("Z") + 1] = UPPER
KINDS[ord("0") : ord("9") + 1] = DIGIT
KINDS[[9, 11, 12, 13, 32]] = SPACE
KINDS[[ord(c) for c in ".,;:?'\"-"]] = STOP
KINDS[ord("|")] = BAR
KINDS[10] = BREAK
POWER = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass
class Lines:
    """Features of all lines of some documents, and where each document's lines begin."""

    features: np.ndarray
    weights: np.ndarray
    starts: np.ndarray


def word_shares(data: np.ndarray, line_of: np.ndarray, n_lines: int) -> list[np.ndarray]:
    """For each line: words, share of words equal to the one before, share of distinct words."""
    inside = (KINDS[data] != SPACE) & (KINDS[data] != BREAK)
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(first):
        return [np.zeros(n_lines), np.zeros(n_lines), np.ones(n_lines)]
    scale = np.cumprod(np.full(len(data), POWER, dtype=np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * scale)])
    # the same word at two places differs by a power only, which the inverse power takes away
    inverse = np.uint64(pow(int(POWER), -1, 1 << 64))
    back = np.cumprod(np.full(len(data), inverse, dtype=np.uint64))
    word = (sums[last] - sums[first]) * back[first]
    line = line_of[first]
    count = np.bincount(line, minlength=n_lines)
    again = np.zeros(len(word), dtype=bool)
    again[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((word, line))
    new = np.ones(len(word), dtype=bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], weights=new, minlength=n_lines)
    some = np.maximum(count, 1)
    return [
        count.astype(float),
        np.bincount(line, weights=again, minlength=n_lines) / some,
        np.where(count > 0, distinct / some, 1.0),
    ]


def chunk_lines(texts: list[bytes]) -> Lines:
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    lengths = np.diff(ends, prepend=-1)  # with the line feed
    n = len(ends)
    line_of = np.repeat(np.arange(n), lengths)
    kinds = np.bincount(line_of * 9 + KINDS[data], minlength=9 * n).reshape(n, 9).astype(float)
    size = lengths - 1
    some = np.maximum(size, 1)[:, None]
    words, again, distinct = word_shares(data, line_of, n)
    letters = np.maximum(kinds[:, LOWER] + kinds[:, UPPER] + kinds[:, HIGH], 1)
    own = np.column_stack(
        [
            np.log1p(size),
            np.log1p(words),
            np.minimum(size / np.maximum(words, 1), 40) / 10,
            kinds[:, :BREAK] / some,
            kinds[:, UPPER] / letters,
            np.minimum((kinds[:, SIGN] + kinds[:, BAR]) / np.maximum(words, 1), 4),
            again,
            distinct,
            size == 0,
        ]
    )
    breaks = np.cumsum([t.count(b"\n") + 1 for t in texts])
    starts = np.concatenate([[0], breaks[:-1]]).astype(np.int64)
    opening, closing = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    opening[starts], closing[breaks - 1] = True, True
    before = np.vstack([np.zeros((1, own.shape[1])), own[:-1]]) * ~opening[:, None]
    after = np.vstack([own[1:], np.zeros((1, own.shape[1]))]) * ~closing[:, None]
    features = np.column_stack([own, before, after, opening, closing])
    return Lines(features, (size + 1).astype(float), starts)


def lines_of(texts: pd.Series) -> Iterator[tuple[np.ndarray, Lines]]:
    """Places in the series and their lines, some megabytes at a time; null counts as empty."""
    places, chunk, size = [], [], 0
    for i, text in enumerate(texts):
        raw = (text if isinstance(text, str) else "").encode()
        places.append(i)
        chunk.append(raw)
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield np.array(places), chunk_lines(chunk)
            places, chunk, size = [], [], 0
    if chunk:
        yield np.array(places), chunk_lines(chunk)


@dataclass
class Field:
    """Weights of a line's good label and of neighbouring labels; rows and columns: bad, good."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    pairs: np.ndarray

    def odds(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.spread @ self.weights + self.bias, -30, 30)


def marginals(
    odds: np.ndarray, starts: np.ndarray, pairs: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once: each line's probability of good, and the
    expected number of each pair of neighbouring labels."""
    n = len(odds)
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    first, lengths = starts[order], lengths[order]
    emit = np.column_stack([1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))])
    step = np.exp(pairs)
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    longest = int(lengths[0]) if len(lengths) else 0
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest + 1)]
    for t in range(longest):
        at = first[: active[t]] + t
        f = emit[at] if t == 0 else emit[at] * (forward[at - 1] @ step)
        forward[at] = f / f.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        later = emit[at + 1] * backward[at + 1]
        joint = forward[at][:, :, None] * step[None] * later[:, None, :]
        expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = later @ step.T
        backward[at] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), expected


def train(
    documents: list[tuple[np.ndarray, int]], steps: int = 150, rate: float = 0.1, decay: float = 1e-4
) -> Field:
    """Maximise the likelihood of the labels, each line having that of its document."""
    chains = [
        (x[at : at + CHAIN_LINES], y, len(x)) for x, y in documents for at in range(0, len(x), CHAIN_LINES)
    ]
    features = np.vstack([x for x, _, _ in chains])
    lengths = np.array([len(x) for x, _, _ in chains])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    good = np.repeat([float(y) for _, y, _ in chains], lengths)
    mean, spread = features.mean(axis=0), features.std(axis=0)
    spread[spread < 1e-9] = 1.0
    scaled = (features - mean) / spread
    # a document counts as one, however many lines it has
    share = np.repeat([1 / whole for _, _, whole in chains], lengths)
    pair_counts = np.zeros((2, 2))
    for x, y, _ in chains:
        pair_counts[y, y] += len(x) - 1
    size = scaled.shape[1]
    theta = np.zeros(size + 5)
    slope, square = np.zeros_like(theta), np.zeros_like(theta)
    n = len(documents)
    for t in range(1, steps + 1):
        odds = np.clip(scaled @ theta[:size] + theta[size], -30, 30)
        p, expected = marginals(odds, starts, theta[size + 1 :].reshape(2, 2))
        off = (good - p) * share
        gradient = np.concatenate(
            [
                off @ scaled / n - decay * theta[:size],
                [off.sum() / n],
                ((pair_counts - expected) / max(1, len(good))).ravel() - decay * theta[size + 1 :],
            ]
        )
        slope = 0.9 * slope + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta += rate * (slope / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Field(mean, spread, theta[:size], float(theta[size]), theta[size + 1 :].reshape(2, 2))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning, by the crc of its id; a null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    sample_documents: int = SAMPLE_DOCUMENTS,
    sample_lines: int = SAMPLE_LINES,
) -> Field | None:
    """Fit on the labelled documents with the smallest id hashes that aren't held out.

    Args:
        documents: doc_id, text.
        labels: doc_id, quality (1 good, 0 bad); the largest counts if there are several.
        sample_documents, sample_lines: bounds of the sample, which the driver learns from. All lines
            of a document count; one that would take the sample beyond its lines is left out.

    Rows with one doc_id are one document, that with the smallest text. Returns None if no document is
    labelled.
    """
    ids = (
        labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_documents)
    )
    text = F.coalesce("text", F.lit(""))
    sample = stored(
        documents.select("doc_id", text.alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("quality").alias("quality")),
        "crf-sample",
    )
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    sizes = sample.select("doc_id", n_lines.alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen, total = [], 0
    for row in sizes.collect():  # at most sample_documents
        if total + row.n <= sample_lines:
            chosen.append(row.doc_id)
            total += row.n

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        out = []
        for _, lines in lines_of(texts):
            ends = np.append(lines.starts[1:], len(lines.features))
            for a, b in zip(lines.starts, ends, strict=True):
                out.append(lines.features[a:b].astype(np.float32).tobytes())
        return pd.Series(out)

    rows = (
        sample.filter(F.col("doc_id").isin(chosen))
        .select("doc_id", "quality", packed("text").alias("features"))
        .toPandas()
        .sort_values("doc_id")
    )
    if rows.empty:
        return None
    width = chunk_lines([b""]).features.shape[1]
    return train(
        [
            (np.frombuffer(x, dtype=np.float32).reshape(-1, width).astype(float), int(y > 0))
            for x, y in zip(rows["features"], rows["quality"], strict=True)
        ]
    )


def quality_score(text: Column, field: Field | None) -> Column:
    """The length-weighted probability of good lines, 0 to 1.

    A null text counts as empty, which is one empty line; equal texts have equal scores. Without a
    fitted field every score is 0.5.
    """
    if field is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for places, lines in lines_of(texts):
            good, _ = marginals(field.odds(lines.features), lines.starts, field.pairs)
            mean = np.add.reduceat(good * lines.weights, lines.starts)
            out[places] = mean / np.add.reduceat(lines.weights, lines.starts)
        return pd.Series(np.clip(out, 0.0, 1.0))

    return scored(text)


def score_documents(
    documents: DataFrame, labels: DataFrame, threshold: float = 0.7
) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) for every document.

    Labels are learnt from documents that aren't held out; ids, languages and sources are no inputs
    of a score. Repeated rows have a row each. Extra columns are ignored. Empty tables give an empty
    result, or scores of 0.5 where only the labels are empty.
    """
    field = fit(documents, labels)
    return documents.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), field).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
