"""Benchmark decontamination: windows of benchmark words in documents, and their removal.

The hashes of all benchmark windows are broadcast as a set; every window of every document is looked
up in it, and what hits is verified on the words themselves. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlledger.llm.common import fresh_name, hashes, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows of this many words; a shorter item is one window.
WINDOW_WORDS = 10
#: Most hashes that are broadcast at once (8 bytes each, some 32 MB as a hash table). A benchmark
#: with more windows is looked up in blocks of so many.
BLOCK = 1 << 20


def words_of(text: Column) -> Column:
    """Normalised words in order; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def benchmark_windows(
    benchmark: DataFrame, length: int = WINDOW_WORDS
) -> tuple[DataFrame, DataFrame]:
    """(windows, owners), both stored.

    windows: key, length, window (array of words), g1, g2; each distinct window once.
    owners: g1, g2, ids (sorted texts; empty for a null item_id), a row for each distinct set of items
    that share some window, so that a window of many items isn't multiplied by them.
    """
    words = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        words_of(F.col("text")).alias("words"),
    ).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - (length - 1), F.lit(1))
    at = words.select("item_id", "words", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    owned = (
        at.select("item_id", F.slice("words", F.col("at"), length).alias("window"))
        .groupBy("window")
        .agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    )
    g1, g2 = hashes(F.col("ids"))
    key = F.xxhash64(F.transform("window", lambda w: F.xxhash64(w)))
    owned = stored(
        owned.select(
            key.alias("key"), F.size("window").alias("length"), "window",
            g1.alias("g1"), g2.alias("g2"), "ids",
        ),
        "benchmark-windows",
    )
    return owned.drop("ids"), owned.select("g1", "g2", "ids").distinct()


def window_key(word_hashes: Column, at: Column, length: int) -> Column:
    """The hash of an array of ``length`` hashes is that of its elements one after the other."""
    return F.xxhash64(*[F.get(word_hashes, at + i) for i in range(length)])


def find_candidates(documents: DataFrame, keys: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, k1, k2, n_words, at, key, window: one row with at = null for every document, and one
    for each of its windows whose key is in ``keys``; ``at`` is the place of its first word from 0.

    (k1, k2) identify a (doc_id, text); no row moves, as the keys are broadcast.
    """
    k1, k2 = hashes(F.col("doc_id"), F.col("text"))
    docs = documents.select(
        "doc_id", k1.alias("k1"), k2.alias("k2"), words_of(F.col("text")).alias("words")
    )
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    docs = docs.select("*", F.size("words").alias("n"), hashed.alias("hashed"))
    # Windows of all lengths are numbered from 1, those of the first length first; 0 is the document.
    no, total = F.col("no"), F.lit(0)
    at, key = F.lit(None).cast("int"), F.lit(None).cast("long")
    found = F.lit(None).cast("array<string>")
    for length in lengths:
        begin, total = total, total + F.greatest(F.col("n") - (length - 1), F.lit(0))
        place, inside = no - begin - 1, (no > begin) & (no <= total)
        at = F.when(inside, place).otherwise(at)
        key = F.when(inside, window_key(F.col("hashed"), place, length)).otherwise(key)
        found = F.when(inside, F.slice("words", place + 1, length)).otherwise(found)
    numbered = docs.select("*", F.explode(F.sequence(F.lit(0), total)).alias("no"))
    looked_up = numbered.withColumn("key", key).join(
        F.broadcast(keys.select("key", F.lit(True).alias("known"))), "key", "left"
    )
    return looked_up.filter("known OR no = 0").select(
        "doc_id", "k1", "k2", F.col("n").cast("long").alias("n_words"), at.alias("at"), "key",
        found.alias("window"),
    )


def contamination(
    documents: DataFrame, benchmark: DataFrame, length: int = WINDOW_WORDS, block: int = BLOCK
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, owners), stored.

    documents: doc_id, k1, k2, n_words, a row for each row of the input.
    hits: k1, k2, at, length, g1, g2: verified occurrences of benchmark windows, each once.
    owners: g1, g2, ids: the items that the windows of a hit come from.

    A benchmark of more than ``block`` distinct windows takes one scan of the documents a block.
    """
    windows, owners = benchmark_windows(benchmark, length)
    lengths = [r.length for r in windows.select("length").distinct().orderBy("length").collect()]
    keys = windows.select("key").distinct()
    blocks = max(1, math.ceil(keys.count() / block))
    docs = candidates = None
    for i in range(blocks):
        part = keys.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i)
        rows = stored(find_candidates(documents, part, lengths), "benchmark-candidates")
        docs = docs or rows.filter("at IS NULL").select("doc_id", "k1", "k2", "n_words")
        found = rows.filter("at IS NOT NULL").select("k1", "k2", "at", "key", "window")
        candidates = candidates.union(found) if candidates else found
    # Rows of equal documents shrink to one before they meet the windows.
    hits = candidates.distinct().join(windows, ["key", "window"])
    return docs, stored(hits.select("k1", "k2", "at", "length", "g1", "g2"), "benchmark-hits"), owners


def spans(hits: DataFrame) -> DataFrame:
    """k1, k2, start, end: for each occurrence the words that no earlier one covers (end excluded);
    they never overlap. A document's occurrences are sorted, not collected."""
    places = hits.groupBy("k1", "k2", "at").agg(
        (F.col("at") + F.max("length")).alias("end")
    )
    before = Window.partitionBy("k1", "k2").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.col("at"), F.coalesce(F.max("end").over(before), F.lit(0)))
    return places.select("k1", "k2", start.alias("start"), "end").filter("start < end")


def contaminated_documents(
    documents: DataFrame, benchmark: DataFrame, length: int = WINDOW_WORDS, block: int = BLOCK
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of documents.

    n_hit counts words inside any occurrence of a window, n_items the items that have one; the
    digest is that of their ids, sorted as texts, with commas.

    Args:
        documents: doc_id, text; other columns are ignored.
        benchmark: item_id, text; other columns are ignored. An item without an id has the empty one;
            rows with one id are one item, and an item without words has no window.
        length: words of a window.
        block: most window hashes that are broadcast at once.

    A null or empty text has no words. Repeated rows, equal ids with other texts and null ids each
    keep a row of their own. A very long text is searched whole, within its row: its words and their
    hashes, some 30 bytes a word, must fit in a task. Empty tables give empty or clean results.
    """
    docs, hits, owners = contamination(documents, benchmark, length, block)
    covered = spans(hits).groupBy("k1", "k2").agg(F.sum(F.expr("end - start")).alias("n_hit"))
    sets = hits.select("k1", "k2", "g1", "g2").distinct().join(owners, ["g1", "g2"])
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))
    found = covered.join(sets.groupBy("k1", "k2").agg(ids.alias("ids")), ["k1", "k2"])
    ids_or_none = F.coalesce("ids", F.array().cast("array<string>"))
    return docs.join(found, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids_or_none).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids_or_none, ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no benchmark window."""
    _, hits, _ = contamination(documents, benchmark, **options)
    a, b = fresh_name(documents, "_k1"), fresh_name(documents, "_k2")
    k1, k2 = hashes(F.col("doc_id"), F.col("text"))
    bad = hits.select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    return documents.withColumns({a: k1, b: k2}).join(bad, [a, b], "left_anti").drop(a, b)


def without_spans(documents: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """All rows of ``documents``; benchmark words go from their texts, each with what stands between it
    and the next word. Texts without a hit, null ones too, stay as they are."""
    _, hits, _ = contamination(documents, benchmark, **options)
    names = [fresh_name(documents, n) for n in ("_k1", "_k2", "_spans")]
    a, b, cuts = names
    k1, k2 = hashes(F.col("doc_id"), F.col("text"))
    ranges = (
        spans(hits)
        .groupBy(F.col("k1").alias(a), F.col("k2").alias(b))
        .agg(F.collect_list(F.struct("start", "end")).alias(cuts))
    )
    text = F.col("text")
    # Words keep their case here: the pattern leaves out A-Z, which was lowered for the search.
    word = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    pieces = F.zip_with(
        F.regexp_extract_all(text, F.lit(word), F.lit(0)),
        F.slice(F.split(text, word, -1), 2, F.length(text) + 1),
        lambda w, gap: F.concat(w, gap),
    )
    # A span of n words is n places in a sorted list without repeats.
    gone = F.flatten(F.transform(cuts, lambda r: F.sequence(r["start"], r["end"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), gone)
    rest = F.transform(kept, lambda i: F.get(pieces, i))
    head = F.get(F.split(text, word, 2), F.lit(0))
    cut = F.concat(head, F.array_join(rest, ""))
    marked = documents.withColumns({a: k1, b: k2}).join(ranges, [a, b], "left")
    return marked.withColumn("text", F.when(F.col(cuts).isNull(), text).otherwise(cut)).select(
        *documents.columns
    )
