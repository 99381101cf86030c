"""Byte-level BPE by monoid tree reduction.

A text is encoded in halves, recursively. Two neighbours are joined by encoding again only a window
around their seam, which grows until both of its ends are places where every encoding of the text
must have a token boundary. Texts of more than one segment are cut into rows first, so that a giant
text is spread over tasks, and their segments are joined up the same tree. Ids are decoded in halves,
too, and the bytes concatenated.

Why a joint is safe: a pre-token never goes on from a non-space sign to a space, whatever stands
before or behind (in the pattern a space may only open a pre-token or stand in a run of white
space, and a run of white space starts at white space). So each (non-space, space) pair is a boundary
in the encoding of any text that contains it. From a boundary on, the pre-tokens depend only on
what follows; and those before it don't look beyond it, as only a run of white space looks ahead.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlledger.llm.common import small_batches

Encode = Callable[[str], list[int]]

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters that are encoded at once; longer texts are halved.
LEAF_CHARS = 16384
#: Characters in a row of a text that is spread over tasks.
SEGMENT_CHARS = 65536
SEAM = re.compile(r"(?<=\S) ")


def tokenizer(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def join(
    left: str, left_ids: list[int], right: str, right_ids: list[int], encode: Encode
) -> list[int]:
    """The ids of left + right from those of its two parts."""
    start, reach = len(left), 32
    while start:  # the last safe boundary of the left part, in a growing window
        start = max(0, len(left) - reach)
        found = [m.start() for m in SEAM.finditer(left, start)]
        if found:
            start = found[-1]
            break
        reach *= 2
    end, reach = 0, 32
    while end < len(right):
        end = min(len(right), reach)
        if found := SEAM.search(right, 0, end):
            end = found.start()
            break
        reach *= 2
    kept = len(left_ids) - len(encode(left[start:]))
    dropped = len(encode(right[:end]))
    return left_ids[:kept] + encode(left[start:] + right[:end]) + right_ids[dropped:]


def encode_tree(text: str, encode: Encode, leaf_chars: int = LEAF_CHARS) -> list[int]:
    if len(text) <= leaf_chars:
        return encode(text)
    middle = len(text) // 2
    left, right = text[:middle], text[middle:]
    return join(
        left,
        encode_tree(left, encode, leaf_chars),
        right,
        encode_tree(right, encode, leaf_chars),
        encode,
    )


def decode_tree(ids: list[int], decode: Callable[[list[int]], bytes], leaf: int = 8192) -> bytes:
    if len(ids) <= leaf:
        return decode(ids)
    middle = len(ids) // 2
    return decode_tree(ids[:middle], decode, leaf) + decode_tree(ids[middle:], decode, leaf)


def summary(doc_id: object, ids: list[int], decode: Callable[[list[int]], bytes]) -> tuple:
    listed = ",".join(map(str, ids)).encode()
    return (
        doc_id,
        len(ids),
        hashlib.sha256(listed).hexdigest(),
        hashlib.sha256(decode_tree(ids, decode)).hexdigest(),
    )


SUMMARY = "doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
COLUMNS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def _encode_rows(batches: Iterator[pd.DataFrame], path: str | None, out: Callable) -> Iterator:
    codec = tokenizer(path or public_tokenizers.path(RANKS))
    for batch in batches:
        yield out(batch, codec)


def _ids(batch: pd.DataFrame, codec: tiktoken.Encoding) -> pd.DataFrame:
    return batch.assign(ids=[encode_tree(t, codec.encode_ordinary) for t in batch["text"]])


def _summaries(batch: pd.DataFrame, codec: tiktoken.Encoding) -> pd.DataFrame:
    rows = [
        summary(d, encode_tree(t, codec.encode_ordinary), codec.decode_bytes)
        for d, t in zip(batch["doc_id"], batch["text"], strict=True)
    ]
    return pd.DataFrame(rows, columns=COLUMNS)


def _reduce(batches: Iterator[pd.DataFrame], path: str | None) -> Iterator[pd.DataFrame]:
    """Join the sorted segments of each document. A stack of subtrees keeps the tree balanced:
    two neighbours of one height are joined as soon as both are there."""
    codec = tokenizer(path or public_tokenizers.path(RANKS))
    encode = codec.encode_ordinary
    key, stack = None, []

    def merged() -> None:
        _, right, right_ids = stack.pop()
        height, left, left_ids = stack.pop()
        stack.append((height + 1, left + right, join(left, left_ids, right, right_ids, encode)))

    def finished() -> tuple:
        while len(stack) > 1:
            merged()
        return summary(key[1], stack.pop()[2], codec.decode_bytes)

    for batch in batches:
        rows = []
        for row, doc_id, text, ids in zip(
            batch["row"], batch["doc_id"], batch["text"], batch["ids"], strict=True
        ):
            if key is not None and row != key[0]:
                rows.append(finished())
            key = (row, doc_id)
            stack.append((0, text, list(ids)))
            while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                merged()
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS)
    if stack:
        yield pd.DataFrame([finished()], columns=COLUMNS)


def encode_documents(
    documents: DataFrame, path: str | None = None, segment_chars: int = SEGMENT_CHARS
) -> DataFrame:
    """Encode every text and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids with commas), decoded_sha256 (of the
    decoded bytes).

    Args:
        documents: doc_id, text; other columns are ignored.
        path: ranks file in the tiktoken format, readable on every executor; by default the
            installed multilingual one.
        segment_chars: texts above this are encoded in rows of this size.

    A null text counts as empty, which has no tokens. Each repeated row has a row of its own. An
    empty table gives an empty result.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = small_batches(documents).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    short = texts.filter(F.length("text") <= segment_chars).mapInPandas(
        partial(_encode_rows, path=path, out=_summaries), SUMMARY.format(kind=kind)
    )
    # The shuffle spreads the segments of a giant text; row numbers keep repeated rows apart.
    segments = (
        texts.filter(F.length("text") > segment_chars)
        .withColumn("row", F.monotonically_increasing_id())
        .select(
            "row",
            "doc_id",
            F.posexplode(
                F.regexp_extract_all("text", F.lit(f"(?s).{{1,{segment_chars}}}"), F.lit(0))
            ).alias("segment", "text"),
        )
    )
    parts = shuffle_partitions(documents)
    encoded = segments.repartition(parts, "row", "segment").mapInPandas(
        partial(_encode_rows, path=path, out=_ids),
        f"row long, doc_id {kind}, segment int, text string, ids array<int>",
    )
    long = (
        encoded.repartition(parts, "row")
        .sortWithinPartitions("row", "segment")
        .mapInPandas(partial(_reduce, path=path), SUMMARY.format(kind=kind))
    )
    return short.unionByName(long)


def shuffle_partitions(df: DataFrame) -> int:
    return max(1, math.ceil(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
