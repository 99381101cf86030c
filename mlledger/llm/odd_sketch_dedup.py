"""Near duplicates by MinHash bands and odd sketches.

The MinHash samples of a document's shingles give band keys, and are folded into an odd sketch: a
bitmap in which each sample flips one bit. The population count of the XOR of two sketches tells how
many samples differ, precisely for similar sets. Documents that share a band key are compared by
sketch; the comparison keeps no more pairs than connect the candidates, and pairs that pass are
confirmed on the full shingle sets.

Only the connected components of the links are wanted, so nothing ever lists all pairs of a group:

1. Equal sets collapse to their smallest doc_id before anything else.
2. In each band bucket, in blocks of bounded size, a spanning forest of the best estimates goes to
   confirmation.
3. Where candidates of one bucket are in different components after that, the exact sets of those
   blocks decide, again as a spanning forest. So a candidate pair is left out only if its two
   documents are connected already.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlledger.llm.common import fresh_name, small_batches, stored
from mlledger.llm.components import components

ROWS = 5
SKETCH_BITS = 1024
#: Rows of a bucket that are compared at once; larger buckets are cut into pairs of blocks.
BLOCK = 512
#: Chance to miss a pair at the threshold itself, which the number of bands is chosen for.
MISS = 1e-8


@dataclass(frozen=True)
class Plan:
    words: int
    percent: int
    bands: int

    @classmethod
    def of(cls, words: int, percent: int) -> Plan:
        one = math.log1p(-((percent / 100) ** ROWS)) if percent < 100 else -math.inf
        return cls(words, percent, max(1, math.ceil(math.log(MISS) / one)))

    @property
    def samples(self) -> int:
        return self.bands * ROWS

    @property
    def most_differing(self) -> int:
        """Bits that sketches of sets at the threshold can differ in: two for each differing
        sample, and five deviations more samples than expected."""
        t = self.percent / 100
        return math.ceil(2 * (self.samples * (1 - t) + 5 * math.sqrt(self.samples * t * (1 - t))))

    def linked(self, common: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (left + right - common)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of words; a shorter text is one run."""
    parts = (text or "").encode().lower().split()  # ASCII case and white space
    if not parts:
        return np.empty(0, dtype=np.uint64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    run = min(words, len(word))
    out = np.zeros(len(word) - run + 1, dtype=np.uint64)
    for i in range(run):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word[i : i + len(out)])
    return np.unique(out)


def minhash(values: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    small = (values >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(small), 4096):
        part = small[start : start + 4096]
        low = np.minimum(low, (factors[:, None] * part[None, :] + offsets[:, None]).min(axis=1))
    return low


def family(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return (
        rng.integers(0, 1 << 32, samples, dtype=np.uint32) | np.uint32(1),
        rng.integers(0, 1 << 32, samples, dtype=np.uint32),
    )


def describe(samples: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys and odd sketch of MinHash samples."""
    place = np.arange(len(samples), dtype=np.uint64) << np.uint64(32)
    tagged = mixed(samples.astype(np.uint64) | place)
    bands = np.zeros(len(samples) // ROWS, dtype=np.uint64)
    for column in tagged.reshape(-1, ROWS).T:
        bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + column)
    flips = np.bincount((tagged % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
    return bands.view(np.int64), np.packbits(flips & 1).tobytes()


def _signatures(batches: Iterator[pd.DataFrame], plan: Plan) -> Iterator[pd.DataFrame]:
    factors, offsets = family(plan.samples)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            values = shingle_set(text, plan.words)
            if len(values):
                same = xxhash.xxh3_128_digest(values.tobytes())
                s1, s2 = np.frombuffer(same, dtype=np.int64)
                bands, sketch = describe(minhash(values, factors, offsets))
                rows.append((doc_id, len(values), s1, s2, bands, sketch))
            else:
                rows.append((doc_id, 0, None, None, None, None))
        yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])


def _sets(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        packed = [shingle_set(text, words).tobytes() for text in batch["text"]]
        yield pd.DataFrame({"rep": batch["doc_id"], "shingles": packed})


def _confirm(batches: Iterator[pd.DataFrame], plan: Plan) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            left, right = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            common = len(np.intersect1d(left, right, assume_unique=True))
            keep.append(bool(plan.linked(common, len(left), len(right))))
        yield batch.loc[keep, ["a", "b"]]


KEYS = ["key", "p", "q"]


def group_starts(chunk: pd.DataFrame) -> np.ndarray:
    new = np.ones(len(chunk), dtype=bool)
    if len(chunk):
        new[1:] = False
    for name in KEYS:
        values = chunk[name].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of a partition sorted by KEYS in chunks that hold whole groups, and where these start.
    What is held back of a batch is its last group, which is no larger than two blocks."""
    held = None
    for batch in batches:
        chunk = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if chunk.empty:
            continue
        starts = group_starts(chunk)
        held = chunk.iloc[starts[-1] :]
        if len(starts) > 1:
            yield chunk.iloc[: starts[-1]], starts[:-1]
    if held is not None:
        yield held.reset_index(drop=True), np.zeros(1, dtype=np.int64)


def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for chunk, starts in whole_groups(batches):
        for start, end in zip(starts, [*starts[1:], len(chunk)], strict=True):
            yield chunk.iloc[start:end]


def forest(closeness: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the closest pairs (Prim); pairs of -1 are none."""
    n = len(closeness)
    best, via = np.full(n, -1.0), np.zeros(n, dtype=np.int64)
    left = np.ones(n, dtype=bool)
    edges = []
    for _ in range(n):
        i = int(np.where(left, best, -2.0).argmax())
        if best[i] >= 0:
            edges.append((int(via[i]), i))
        left[i] = False
        nearer = closeness[i] > best
        best = np.where(nearer, closeness[i], best)
        via[nearer] = i
    return edges


def matrix(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(len(sketches), -1)


def closeness(
    sketches: np.ndarray, reps: np.ndarray, block: np.ndarray, across: bool, plan: Plan
) -> np.ndarray:
    """For the pairs of a group that may be linked, the bits in which they don't differ, else -1.
    Where two blocks meet, pairs inside a block are left to the group that the block has alone."""
    n = len(reps)
    differing = np.zeros((n, n), dtype=np.int64)
    for column in sketches.T:
        differing += np.bitwise_count(column[:, None] ^ column[None, :])
    wanted = (differing <= plan.most_differing) & (reps[:, None] != reps[None, :])
    if across:
        wanted &= block[:, None] != block[None, :]
    return np.where(wanted, SKETCH_BITS - differing, -1)


def candidates(group: pd.DataFrame, plan: Plan) -> np.ndarray:
    return closeness(
        matrix(group["sketch"]),
        group["rep"].to_numpy(),
        group["block"].to_numpy(),
        group["p"].iloc[0] != group["q"].iloc[0],
        plan,
    )


def likely_twos(chunk: pd.DataFrame, two: np.ndarray, plan: Plan) -> np.ndarray:
    """Of the groups of two that begin at the given places, those whose pair may be linked."""
    reps, block, p, q = (chunk[c].to_numpy() for c in ("rep", "block", "p", "q"))
    two = two[reps[two] != reps[two + 1]]
    two = two[(p[two] == q[two]) | (block[two] != block[two + 1])]
    if not len(two):
        return two
    differing = np.bitwise_count(matrix(chunk["sketch"].iloc[two]) ^ matrix(chunk["sketch"].iloc[two + 1]))
    return two[differing.sum(axis=1, dtype=np.int64) <= plan.most_differing]


def _likely(batches: Iterator[pd.DataFrame], plan: Plan) -> Iterator[pd.DataFrame]:
    """Spanning forests of the candidates of each group. Groups of two, which most are, are
    compared all at once."""
    for chunk, starts in whole_groups(batches):
        sketches, reps = matrix(chunk["sketch"]), chunk["rep"].to_numpy()
        block, p, q = (chunk[c].to_numpy() for c in ("block", "p", "q"))
        size = np.diff(np.append(starts, len(chunk)))
        two = likely_twos(chunk, starts[size == 2], plan)
        found = [pd.DataFrame({"a": reps[two], "b": reps[two + 1]})]
        for start, n in zip(starts[size > 2], size[size > 2], strict=True):
            part = slice(start, start + n)
            near = closeness(sketches[part], reps[part], block[part], p[start] != q[start], plan)
            edges = np.array(forest(near.astype(float)), dtype=np.int64).reshape(-1, 2) + start
            found.append(pd.DataFrame({"a": reps[edges[:, 0]], "b": reps[edges[:, 1]]}))
        yield pd.concat(found)


def open_pairs(group: pd.DataFrame, plan: Plan) -> np.ndarray:
    """Pairs of a group that may be linked and aren't connected, in the first bucket they share."""
    wanted = candidates(group, plan) >= 0
    label = group["component"].to_numpy()
    wanted &= label[:, None] != label[None, :]
    asked = np.flatnonzero(wanted.any(axis=1))
    if not len(asked):
        return wanted
    bands, key = np.array(group["bands"].tolist()), group["key"].iloc[0]
    for i in asked:
        others = np.flatnonzero(wanted[i])
        first = (bands[others] == bands[i]).argmax(axis=1)
        wanted[i, others] = bands[i][first] == key
    return wanted


def open_twos(chunk: pd.DataFrame, two: np.ndarray, plan: Plan) -> np.ndarray:
    """The same for the groups of two that begin at the given places; returns those that are open."""
    label, key = chunk["component"].to_numpy(), chunk["key"].to_numpy()
    two = two[label[two] != label[two + 1]]
    left, right = (np.array(chunk["bands"].iloc[at].tolist()) for at in (two, two + 1))
    if not len(two):
        return two
    first = (left == right).argmax(axis=1)
    return two[left[np.arange(len(two)), first] == key[two]]


def _open(batches: Iterator[pd.DataFrame], plan: Plan) -> Iterator[pd.DataFrame]:
    columns = ["key", "p", "q", "block", "rep", "sketch", "bands", "component"]
    for chunk, starts in whole_groups(batches):
        size = np.diff(np.append(starts, len(chunk)))
        two = open_twos(chunk, likely_twos(chunk, starts[size == 2], plan), plan)
        active = np.zeros(len(chunk), dtype=bool)
        active[two] = active[two + 1] = True
        for start, n in zip(starts[size > 2], size[size > 2], strict=True):
            group = chunk.iloc[start : start + n]
            active[start : start + n] = open_pairs(group, plan).any(axis=1)
        yield chunk.loc[active, columns]


def common_shingles(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of 0/1 matrices."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    number = np.full(len(values), -1)
    number[shared] = np.arange(len(shared))
    column = number[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n))
    for start in range(0, len(shared), width):
        a, b = np.searchsorted(column, [start, start + width])
        dense = np.zeros((n, width), dtype=np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        out += dense @ dense.T
    return out


def _decide(batches: Iterator[pd.DataFrame], plan: Plan) -> Iterator[pd.DataFrame]:
    for group in runs(batches):
        wanted = open_pairs(group, plan)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in group["shingles"]]
        common, size = common_shingles(sets), np.array([len(s) for s in sets])
        wanted &= plan.linked(common, size[:, None], size[None, :])
        reps = group["rep"].to_numpy()
        found = [(reps[i], reps[j]) for i, j in forest(np.where(wanted, common, -1.0))]
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])


def in_blocks(hits: DataFrame, columns: list[str], run: Callable, schema: str) -> DataFrame:
    """Run over the pairs of blocks of each bucket. ``hits`` has key, blocks (of the bucket), rep."""
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        hits.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            F.least("block", "other").cast("int").alias("p"),
            F.greatest("block", "other").cast("int").alias("q"),
            "block",
            *columns,
        )
    )
    return dealt.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInPandas(run, schema)


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (smallest doc_id reachable by links, its
    own included), kept (whether it is that one).

    Args:
        documents: doc_id, text; other columns are ignored.
        words: words in a shingle. A shorter text is one shingle of all its words.
        percent: documents are linked if 100 * intersection >= percent * union of their sets.

    Words are runs of other signs than space and \\x09-\\x0D, with A-Z in lower case. A null text, or
    one without words, has an empty set and is linked with nothing. Rows with one doc_id are one
    document, linked by any of their texts. A row with a null doc_id is in the component of an equal
    set, if one has an id; otherwise its component is null and it is kept. An empty table gives an
    empty result. Band keys miss a pair at the threshold with a chance of about 1e-8, pairs above
    it with less; all else is exact.
    """
    plan = Plan.of(words, percent)
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = small_batches(documents).select("doc_id", "text")
    signed = stored(
        texts.mapInPandas(
            partial(_signatures, plan=plan),
            f"doc_id {kind}, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary",
        ),
        "near-signatures",
    )
    # Written, so that a join with it isn't tied to the layout of the groups, and Spark can split
    # the partition of a set that very many documents have.
    equal = stored(
        signed.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")),
        "near-equal",
    )
    named = signed.join(equal, ["s1", "s2"], "left")
    reps = stored(
        named.filter("doc_id = rep").select("rep", "bands", "sketch").dropDuplicates(),
        "near-representatives",
    )
    keys = reps.select("rep", F.explode("bands").alias("key"))
    buckets = (
        keys.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high"))
        .filter("low < high")
        .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    hits = stored(keys.join(buckets, "key"), "near-hits")
    pair = f"a {kind}, b {kind}"
    likely = (
        in_blocks(
            hits.join(reps.drop("bands"), "rep"),
            ["rep", "sketch"],
            partial(_likely, plan=plan),
            pair,
        )
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    likely = stored(likely, "near-likely")
    # all documents of a bucket that a candidate is in may be needed for the exact decision
    asked = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(
        texts.join(asked, "doc_id", "left_semi").mapInPandas(
            partial(_sets, words=words), f"rep {kind}, shingles binary"
        ),
        "near-sets",
    )
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    confirm = partial(_confirm, plan=plan)
    links = stored(likely.join(left, "a").join(right, "b").mapInPandas(confirm, pair), "near-links")
    labels = components(links)

    def labelled(df: DataFrame) -> DataFrame:
        return df.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep")
        )

    split = (
        labelled(hits.join(asked.withColumnRenamed("doc_id", "rep"), "rep", "left_semi"))
        .groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low < high")
        .select("key")
    )
    undecided = hits.join(split, "key", "left_semi").join(reps, "rep")
    payload = ["rep", "sketch", "bands", "component"]
    rows = "key long, p int, q int, block int, " + (
        f"rep {kind}, sketch binary, bands array<long>, component {kind}"
    )
    active = stored(
        in_blocks(labelled(undecided), payload, partial(_open, plan=plan), rows), "near-open"
    )
    more = (
        active.join(sets, "rep")
        .repartition(*KEYS)
        .sortWithinPartitions(*KEYS)
        .mapInPandas(partial(_decide, plan=plan), pair)
    )
    final = components(links.unionByName(more)).withColumnRenamed("node", "rep")
    component = F.coalesce("component", "rep", "doc_id")
    return (
        signed.select("doc_id", "n_shingles", "s1", "s2")
        .join(equal, ["s1", "s2"], "left")
        .join(final, "rep", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn(
            "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
        )
    )


#: Keys of rows that their doc_id doesn't tell apart begin here; they come behind all ids below.
OWN_KEYS = 1 << 62


def with_row_key(documents: DataFrame, name: str) -> DataFrame:
    """Adds a whole number that stands for a (doc_id, text): the doc_id where that is enough, else a
    62-bit hash of both. Ids of several texts, found by one aggregation of hashes, null ids, ids of
    2^62 or more and ids that are no whole numbers get the hash."""
    doc_id, both = F.col("doc_id"), F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    own = both.bitwiseAND(F.lit(OWN_KEYS - 1)) + F.lit(OWN_KEYS)
    if documents.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return documents.withColumn(name, own)
    shared = fresh_name(documents, "_shared")
    several = stored(
        documents.filter(doc_id.isNotNull())
        .groupBy("doc_id")
        .agg(F.min(both).alias("low"), F.max(both).alias("high"))
        .filter("low < high")
        .select("doc_id", F.lit(True).alias(shared)),
        "near-shared-ids",
    )
    enough = doc_id.isNotNull() & F.col(shared).isNull() & (doc_id < OWN_KEYS)
    return (
        documents.join(several, "doc_id", "left")
        .withColumn(name, F.when(enough, doc_id.cast("long")).otherwise(own))
        .select(*documents.columns, name)
    )


def kept_only(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, with all its columns.

    Each distinct (doc_id, text) is judged by itself: rows with a null doc_id, and different texts
    under one doc_id, take part like all others, and of equal rows one stays. The one that stays has
    the smallest doc_id of its group; rows without one, or whose id has several texts, come last.
    Texts without words are near nothing and stay, one of each (doc_id, text).
    """
    key, copy = fresh_name(documents, "_key"), fresh_name(documents, "_copy")
    keyed = with_row_key(documents, key)
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), words, percent)
    kept = found.filter("kept").select(F.col("doc_id").alias(key)).distinct()
    order = Window.partitionBy(key).orderBy(*[c for c in documents.columns if c != "text"])
    return (
        keyed.join(kept, key, "left_semi")
        .withColumn(copy, F.row_number().over(order))
        .filter(F.col(copy) == 1)
        .select(*documents.columns)
    )
