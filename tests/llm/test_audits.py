"""Resampling, decontamination and the filter audit against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from mlledger.llm import decontamination, filter_audit, target_resampling
from mlledger.llm.common import table
from tests.conftest import SF
from tests.llm.test_operators import documents, odd_documents, sentence  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return WORD.findall(lowered)


def benchmark(spark, rows):
    """Items with columns whose names the operators use themselves."""
    full = [(i, text, 1, "key", True) for i, text in rows]
    return spark.createDataFrame(full, "item_id long, text string, k1 int, key string, known boolean")


# --- resampling ---------------------------------------------------------------------------------


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_resampling(docs, target, longest, buckets, min_words, percent, seed):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, text in docs for f in runs(text, longest))
    t = Counter(bucket(f) for text in target for f in runs(text, longest))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for doc_id, text in docs:
        found = [bucket(f) for f in runs(text, longest)]
        total = sum(
            math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in found
        )
        weight = total // len(found) if found else 0
        name = f"{seed}:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(found), weight, weight + noise, len(words(text)) >= min_words))
    fit = sorted((-r[3], r[0] is None, r[0] or 0) for r in out if r[4])
    drawn = Counter(fit[: len(fit) * percent // 100])
    return out, drawn


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 50)])
def test_resampling_is_that_of_brute_force(spark, longest, buckets):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randrange(60), 80) + " Ünï-cödé 9", "s") for i in range(120)]
    rows += [(None, "no id " * 15, "s"), (None, "no id " * 15, None), (7, "twice " * 30, "s")]
    rows += [(200 + i, rows[0][1], "s") for i in range(60)] + [(300, None, "s"), (301, "", "s")]
    target = [sentence(rng, 30, 20) for _ in range(8)] + [None, ""]
    got = target_resampling.resample(
        documents(spark, rows), benchmark(spark, list(enumerate(target))), longest=longest, buckets=buckets,
        min_words=20, drawn_percent=30,
    ).collect()
    wanted, drawn = brute_resampling(
        [(i, text) for i, text, _ in rows], target, longest, buckets, 20, 30, 2024
    )
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(
        r[:4] for r in wanted
    )
    ranked = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, sum(drawn.values()) + 1))
    order = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked]
    assert order == sorted(order) and Counter(order) == drawn


def test_many_equal_rows_are_each_ranked(spark):
    rows = [(None, "one two three " * 10, "s")] * 9_000 + [(i, "four five " * 12, "s") for i in range(1000)]
    got = target_resampling.resample(
        documents(spark, rows), benchmark(spark, [(1, "one two three")]), drawn_percent=90
    )
    assert got.count() == 10_000
    assert sorted(r.rank for r in got.filter("rank IS NOT NULL").collect()) == list(range(1, 9001))


def test_pieces_of_a_text_give_its_words_and_runs(spark):
    rng = random.Random(3)
    text = sentence(rng, 3000) + "-ÄÖ" * 400 + " . " * 500 + sentence(rng, 10)
    split = target_resampling.splitter()
    for piece in (1, 7, 64, 1000, 10**6):
        found = list(target_resampling.features(text, split, 3, piece))
        assert sum(n for n, _ in found) == len(words(text))
        assert Counter(f for _, fs in found for f in fs) == Counter(runs(text, 3))


def test_resampling_of_odd_rows(spark, odd_documents):  # noqa: F811
    target = benchmark(spark, [(None, None), (1, "w1 w2 same text")])
    got = target_resampling.resample(odd_documents, target).collect()
    assert len(got) == odd_documents.count()
    assert {r.weight for r in got if r.n_features == 0} == {0}
    none = target_resampling.resample(odd_documents.limit(0), target)
    assert none.count() == 0
    assert target_resampling.resample(odd_documents, target.limit(0)).count() == len(got)
    drawn = target_resampling.drawn_documents(odd_documents, target, drawn_percent=100, min_words=2)
    assert drawn.columns == odd_documents.columns
    assert drawn.count() == sum(r.n_words >= 2 for r in got)


# --- decontamination ----------------------------------------------------------------------------


def brute_hits(text, items, length):
    """Hit places, and the items that hit."""
    w, places, found = words(text), set(), set()
    for item_id, item in items:
        iw = words(item)
        windows = [iw[i : i + length] for i in range(max(1, len(iw) - length + 1))] if iw else []
        for window in windows:
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    places |= set(range(at, at + len(window)))
                    found.add("" if item_id is None else str(item_id))
    return places, sorted(found)


def contaminated(rng, items, n=80):
    rows = []
    for i in range(n):
        text = sentence(rng, rng.randrange(40), 60)
        for _ in range(rng.randrange(3)):
            _, item = rng.choice(items)
            piece = words(item)
            a = rng.randrange(len(piece) or 1)
            text += rng.choice([" ", ". "]) + ", ".join(piece[a : a + rng.randrange(1, 30)]).upper()
            text += " " + sentence(rng, rng.randrange(12), 60)
        rows.append((i, text, "s"))
    return rows


@pytest.fixture(scope="module")
def items():
    rng = random.Random(11)
    long = [(i, sentence(rng, rng.randrange(10, 40), 60) + ".") for i in range(12)]
    twice = [(20, long[0][1]), (21, long[0][1].upper()), (0, "another text of item zero")]
    return [*long, *twice, (30, "w1 w2 w3"), (31, "w7"), (32, ""), (33, None), (None, "ünï w5 w6")]


@pytest.mark.parametrize("length,block", [(10, 1 << 20), (4, 1 << 20), (10, 40)])
def test_contamination_is_that_of_brute_force(spark, items, length, block):
    rows = contaminated(random.Random(2), items)
    rows += [(None, rows[3][1], "s"), (3, rows[3][1], "s"), (3, rows[4][1], "s"), (90, None, "s")]
    got = decontamination.contaminated_documents(
        documents(spark, rows), benchmark(spark, items), length, block
    ).collect()
    expected = []
    for doc_id, text, _ in rows:
        places, found = brute_hits(text, items, length)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        expected.append((doc_id, len(words(text)), len(places), len(found), digest, bool(places)))
    assert Counter(tuple(r) for r in got) == Counter(expected)
    assert sum(r.contaminated for r in got) > 20


def test_benchmark_words_go_and_the_rest_stays(spark, items):
    rows = contaminated(random.Random(4), items, 40) + [(70, None, "s"), (71, "", "s")]
    docs = documents(spark, rows).withColumns({"k1": F.lit(0), "window": F.lit("x")})
    long = [r for r in items if len(words(r[1])) >= 10]
    got = decontamination.without_spans(docs, benchmark(spark, long))
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    cased = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    for doc_id, text, _ in rows:
        places, _ = brute_hits(text, long, 10)
        if places:
            gaps, found = cased.split(text), cased.findall(text)
            kept = [w + gap for i, (w, gap) in enumerate(zip(found, gaps[1:], strict=True)) if i not in places]
            text = gaps[0] + "".join(kept)
        assert texts[doc_id] == text
    clean = decontamination.clean_documents(docs, benchmark(spark, long))
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {
        i for i, text, _ in rows if not brute_hits(text, long, 10)[0]
    }


def test_contamination_of_odd_rows(spark, odd_documents, items):  # noqa: F811
    some = benchmark(spark, [*items, (50, " ".join(f"w{i}" for i in range(2000)))])
    got = decontamination.contaminated_documents(odd_documents, some)
    assert got.count() == odd_documents.count()
    assert decontamination.contaminated_documents(odd_documents.limit(0), some).count() == 0
    clean = decontamination.contaminated_documents(odd_documents, some.limit(0))
    assert clean.count() == odd_documents.count() and clean.filter("contaminated").isEmpty()
    both = decontamination.contaminated_documents(odd_documents.limit(0), some.limit(0))
    assert both.count() == 0


# --- filter audit -------------------------------------------------------------------------------


def brute_audit(docs, labels):
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    parts = {}
    for doc_id, text, lang in docs:
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and first[text] < doc_id,
        }
        own = [lab for lab in labels if doc_id is not None and lab[0] == doc_id]
        marks = any(lab[1] == 1 for lab in own), any(lab[2] == 1 for lab in own)
        parts.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, *marks))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in rows)
                out[part, "".join(order), step] = [
                    len(left), len(removed), failing - len(removed),
                    sum(r[0] == {f} for r in rows),
                    sum(r[1] for r in removed), sum(r[2] for r in removed),
                ]
                shapley[part, f] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("slice_rows", [4096, 3])
def test_audit_is_that_of_brute_force(spark, slice_rows):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        text = sentence(rng, rng.choice([0, 1, 50, 99, 100, 101, 140]), rng.choice([60, 2000]))
        text += rng.choice(["", " #", " " + "ABC " * 20, "\x0b\x0c|", " ÄÖ"])
        rows.append((i, text, rng.choice(["de", "en", "", None])))
    rows += [(1000 - i, rows[5][1], "en") for i in range(40)]
    rows += [(None, rows[5][1], "de"), (5, rows[5][1], "en"), (5, "other", "en"), (600, None, "de")]
    rows += [(None, None, None), (None, None, None), (601, "", "x"), (601, "", "x")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 1000, 3)]
    labels += [(5, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame(
        [(*r, 1, "x", 0) for r in rows], "doc_id long, text string, lang string, bits int, part string, n int"
    )
    marks = spark.createDataFrame(
        [(*r, 1) for r in labels], "doc_id long, quality int, toxic int, good int"
    )
    got = {
        (r.part, r.filter_order, r.step): tuple(r)[3:]
        for r in filter_audit.audit_filters(docs, marks, slice_rows).collect()
    }
    assert got == brute_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    got = filter_audit.audit_filters(docs, labels.limit(0))
    assert got.count() == 600 * docs.select("lang").distinct().count()
    assert got.filter("good_lost + toxic_lost > 0").isEmpty()
