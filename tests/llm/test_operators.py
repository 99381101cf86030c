"""Each operator against brute force, and on nulls, empty tables, ties, repeats and clashing names."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from mlledger.llm import (
    block_labeller,
    bpe_tree,
    chat_snapshots,
    common,
    hilbert_search,
    kdtree_search,
    license_digest,
    line_crf,
    mixing,
    odd_sketch_dedup,
    shards,
)
from mlledger.llm.common import numbered, stored, table
from mlledger.llm.components import components
from tests.conftest import SF

DOCS = "doc_id long, text string, source string, size long, shard int, rate double, n string"


def documents(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    full = [(i, text, source, -1, -1, -1.0, "x") for i, text, source in rows]
    return spark.createDataFrame(full, DOCS)


def sentence(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_documents(spark):
    rng = random.Random(1)
    long = sentence(rng, 30_000)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "Ünïcode straße", "b"),
        (5, "same text", "b"), (5, "same text", "b"), (6, "same text", None), (7, long, "c"),
        (8, long + " end", "c"), (None, "no id", "c"), (9, "one", "a"), (10, "two\nlines", "a"),
    ]
    return documents(spark, rows)


def test_numbered_is_gapless_in_every_cell(spark):
    rows = [(0 if i % 3 else 1, i) for i in range(3000)]
    df = stored(spark.createDataFrame(rows, "cell int, id long"), "test")
    got = numbered(df, ["cell"], ["id"], "no", slice_rows=100).collect()
    for cell in (0, 1):
        numbers = sorted(r.no for r in got if r.cell == cell)
        assert numbers == list(range(len(numbers)))


# --- mixing -------------------------------------------------------------------------------------


def targets(sizes, weights, share, most):
    """Deal the excess again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, rest = {}, sum(sizes.values()) * share
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        left = rest - sum(fixed.values())
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_meets_the_targets(spark):
    docs = table(spark, SF, "documents")
    rows = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    wanted = targets({s: sum(r.size for r in rs) for s, rs in by.items()}, (3, 1, 2), 1.5, 2)
    for source, rs in by.items():
        assert rs[0].target == pytest.approx(wanted[source])
        smallest = min(r.size for r in rs if r.size)
        # near: within a document of a typical size, where the sizes allow it
        assert abs(sum(r.taken for r in rs) - wanted[source]) <= max(10 * smallest, 60)
        assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in rs)
        assert all(0 <= r.rate <= 2 for r in rs)


def test_mix_rates_solve_the_dual(spark):
    rows = mixing.mix(table(spark, SF, "documents"), tolerance=1e-6).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for rs in by.values():
        got = sum(r.rate * r.size for r in rs if r.size)
        assert got == pytest.approx(rs[0].target, rel=1e-5)


def test_mix_of_odd_rows(spark, odd_documents):
    rows = mixing.mix(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    again = mixing.mix(odd_documents.repartition(7)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted(again, key=key)
    assert {r.taken for r in rows if r.doc_id in (1, 2, 3)} == {0}
    kept = mixing.mixed_documents(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.count() == sum(r.copies for r in rows)
    assert mixing.mix(odd_documents.limit(0)).count() == 0


# --- search -------------------------------------------------------------------------------------


def vectors(spark, rows, kind="float"):
    full = [(i, v, 5, 5, "x") for i, v in rows]
    return spark.createDataFrame(full, f"vec_id long, v array<{kind}>, rank int, dim int, q string")


def test_kdtree_finds_the_exact_best(spark):
    rng = np.random.default_rng(0)
    points = rng.integers(-5, 6, (700, 8))
    points[100:400] = points[100]  # one vector holds many rows
    rows = [(i, [int(x) for x in p]) for i, p in enumerate(points)]
    rows += [(None, [1] * 8), (9000, None), (9001, [1, 2])]
    found = kdtree_search.top_k(
        vectors(spark, rows, "long"), F.col("vec_id") % 10 == 0, k=7, shard_rows=150, block_rows=20
    ).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 10))
    for q in got:
        score = points @ points[q]
        best = [i for i in np.lexsort((np.arange(700), -score)) if i != q][:7]
        assert got[q] == [(i, score[i]) for i in best]
    assert kdtree_search.top_k(vectors(spark, [], "long"), F.lit(True)).count() == 0


@pytest.mark.parametrize("most", [2**27, 2**30])
def test_kdtree_scores_beyond_doubles(spark, most):
    """Sums of products above 2^53, many of them equal but for their last bits."""
    rng = random.Random(most)
    points = [[rng.choice([most, most - 1, -most, rng.randrange(most)]) for _ in range(4)] for _ in range(400)]
    rows = [(i, p) for i, p in enumerate(points)] + [(900, [0, 0, 0, 0])]
    found = kdtree_search.top_k(
        spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0, k=5
    )
    got = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    for i, q in rows[::20]:
        scored = [(-sum(a * b for a, b in zip(p, q, strict=True)), j) for j, p in rows if j != i]
        assert got[i] == [(j, -s) for s, j in sorted(scored)[:5]]


def test_whole_numbers_leave_out_what_is_not_finite(spark):
    rows = [(1, [0.5, -0.25]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None)]
    rows += [(5, [None, 1.0]), (6, [])]
    got = vectors(spark, rows).select("vec_id", kdtree_search.whole_numbers("v").alias("w"))
    assert dict(got.collect()) == {1: [512, -256], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_hilbert_curve_is_a_walk_through_every_cell():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert_search.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_hilbert_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    points = rng.standard_normal((3000, 32)).astype(np.float32)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    found = hilbert_search.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1)[:, None]
    hit = 0
    for r in found:
        score = unit @ unit[r.query_id]
        assert r.score == pytest.approx(score[r.vec_id], abs=1e-12)
        best = [i for i in np.argsort(-score) if i != r.query_id][:5]
        hit += r.vec_id in best
    assert len(found) == 300
    assert hit / 300 >= 0.9


def test_hilbert_ties_and_odd_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(200)] + [(300, [0.0, 0.0, 0.0]), (301, None)]
    rows += [(302, [float("nan"), 1.0, 1.0]), (None, same), (400, [1.0, 1.0]), (303, [None, 1.0, 1.0])]
    found = hilbert_search.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    assert got == {
        0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 150: [0, 1, 2, 3, 4],
    }
    assert hilbert_search.nearest(vectors(spark, []), F.lit(True)).count() == 0


def test_hilbert_tight_cluster(spark, monkeypatch):
    """A third of the rows share their key on every curve, yet no task gets more than a range."""
    rng = np.random.default_rng(2)
    points = rng.standard_normal((3000, 32))
    points[::3] = points[0] + 1e-6 * rng.standard_normal((1000, 32))
    points[1] = points[0]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    calls, large = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    whole = hilbert_search.rank_group

    def counted(candidates, queries, k):
        calls.add(1)
        large.add(int(len(candidates) > 60 or len(queries) > 20))
        return whole(candidates, queries, k)

    monkeypatch.setattr(hilbert_search, "rank_group", counted)
    asks = F.col("vec_id") % 50 == 0
    found = hilbert_search.nearest(vectors(spark, rows, "double"), asks, range_rows=60, block_rows=20)
    found = found.collect()
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    hit = 0
    for r in found:
        near = unit - unit[r.query_id]
        best = [i for i in np.argsort((near * near).sum(axis=1), kind="stable") if i != r.query_id][:5]
        hit += r.vec_id in best
    assert len(found) == 300
    assert calls.value > 0 and large.value == 0
    assert hit / 300 >= 0.9


# --- chats --------------------------------------------------------------------------------------


def test_snapshots_collapse_to_maximal_chats(spark):
    rng = random.Random(3)
    chats = {}
    for i in range(120):
        if chats and rng.random() < 0.6:
            base = rng.choice(list(chats.values()))
            turns = base[: rng.randint(1, len(base))]
        else:
            turns = []
        turns = turns + [
            (rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None]))
            for _ in range(rng.randint(0 if turns else 1, 2))
        ]
        chats[i] = turns
    rows = [(c, t, r, x, 1, "z") for c, turns in chats.items() for t, (r, x) in enumerate(turns)]
    rows += rng.sample(rows, 30)  # repeated rows
    df = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, n long, slice string"
    )
    got = {r.conv_id: r for r in chat_snapshots.format_chats(df).collect()}
    by_turns = defaultdict(list)
    for c, turns in chats.items():
        by_turns[tuple(turns)].append(c)
    wanted = {
        min(cs): len(cs)
        for turns, cs in by_turns.items()
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in by_turns)
    }
    assert {c: r.n_copies for c, r in got.items()} == wanted
    for c, r in got.items():
        shown = "".join(f"<|{role or ''}|>\n{text or ''}<|end|>\n" for role, text in chats[c])
        assert r.rendered == shown and r.n_turns == len(chats[c])


def test_long_and_null_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, t, "user", str(t)) for t in range(3000)] + [(2, t, "user", str(t)) for t in range(1500)]
    rows += [(None, 0, "user", "x"), (None, None, None, None)]
    parts = chat_snapshots.format_chats(spark.createDataFrame(rows, schema), part_turns=500).collect()
    whole = "".join(r.rendered for r in sorted(parts, key=lambda r: r.part) if r.conv_id == 1)
    assert whole == "".join(f"<|user|>\n{t}<|end|>\n" for t in range(3000))
    assert {r.conv_id for r in parts} == {1, None}
    assert chat_snapshots.format_chats(spark.createDataFrame([], schema)).count() == 0


# --- shards -------------------------------------------------------------------------------------


def test_assign_is_what_a_heap_does():
    import heapq

    rng = random.Random(5)
    for _ in range(200):
        loads = [rng.randrange(100) for _ in range(4)]
        n, weight = rng.randrange(1, 60), rng.randrange(1, 20)
        heap = [(float(x), s) for s, x in enumerate(loads)]
        heapq.heapify(heap)
        got = shards.assign(n, weight, heap)
        one_by_one = [(float(x), s) for s, x in enumerate(loads)]
        heapq.heapify(one_by_one)
        for _ in range(n):
            load, s = heapq.heappop(one_by_one)
            heapq.heappush(one_by_one, (load + weight, s))
        assert sum(got) == n
        assert sorted(x for x, _ in heap) == sorted(x for x, _ in one_by_one)


def test_shards_are_even_and_keep_equal_texts_together(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = shards.shard_documents(docs).collect()
    texts = dict(docs.collect())
    assert len(rows) == len(texts)
    shard_of, load, slots = {}, Counter(), defaultdict(list)
    for r in rows:
        text = texts[r.doc_id]
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        assert shard_of.setdefault(text, r.shard) == r.shard
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values())


def test_shards_of_odd_rows(spark, odd_documents):
    rows = shards.shard_documents(odd_documents, shards=3).collect()
    assert len(rows) == odd_documents.count()
    assert {r.size for r in rows if r.doc_id == 1} == {1}
    assert len({r.shard for r in rows if r.doc_id in (5, 6)}) == 1
    assert shards.shard_documents(odd_documents.limit(0)).count() == 0


# --- near duplicates ----------------------------------------------------------------------------


def brute_components(texts, words, percent):
    sets = {}
    for i, text in texts.items():
        parts = (text or "").encode().lower().split()
        n = min(words, len(parts))
        sets[i] = {tuple(parts[k : k + n]) for k in range(len(parts) - n + 1)} if parts else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_components_of_edited_copies(spark, words, percent, monkeypatch):
    monkeypatch.setattr(odd_sketch_dedup, "BLOCK", 16)  # large groups take several blocks
    rng = random.Random(words)
    texts = {}
    for group in range(6):
        base = sentence(rng, 120).split()
        for _ in range(45):
            copy = list(base)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy) if group else " ".join(copy).upper()
    texts |= {500: None, 501: "", 502: "one two", 503: "ONE two", 504: " \t"}
    docs = documents(spark, [(i, t, "s") for i, t in texts.items()] * 2)
    rows = odd_sketch_dedup.near_duplicates(docs, words, percent).collect()
    wanted, sizes = brute_components(texts, words, percent)
    assert len(rows) == 2 * len(texts)
    for r in rows:
        assert (r.component_id, r.n_shingles) == (wanted[r.doc_id], sizes[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)
    assert len(set(wanted.values())) > 20  # chains, not one lump per group


def test_near_duplicates_of_odd_rows(spark, odd_documents):
    rows = odd_sketch_dedup.near_duplicates(odd_documents, 3, 85).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == odd_documents.count()
    assert got[8].component_id == 7 and got[6].component_id == 5
    assert got[1].n_shingles == 0 and got[1].kept and got[None].kept
    kept = odd_sketch_dedup.kept_only(odd_documents)
    assert kept.columns == odd_documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 7, None, 9, 10])
    assert odd_sketch_dedup.near_duplicates(odd_documents.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    root = {i: i for i in range(400)}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: root[i] for a, b in links if a != b for i in (a, b)}


# --- pages --------------------------------------------------------------------------------------


def page(body, boilerplate="nav"):
    return (
        f"<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body>"
        f"<{boilerplate}><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></{boilerplate}>"
        f"<article>{body}</article><footer>&copy; me</footer></body></html>"
    )


def test_blocks_of_broken_pages():
    read = block_labeller.blocks(page("<h1>A &amp; B</h1><p>one\n  two<p><b>three<br>four<p>five"))
    assert [b.text for b in read] == [
        "Home", "About", "A & B", "one two", "three four", "five", "© me",
    ]
    assert block_labeller.blocks(None) == [] and block_labeller.blocks("<!-- x") == []
    assert [b.text for b in block_labeller.blocks("a < b <p>c")] == ["a < b", "c"]


def test_a_closed_svg_takes_nothing_with_it():
    read = block_labeller.blocks(
        '<article><p>one</p><svg class="i > j"/><p>two</p><svg><text>no</text></svg></article><p>three</p>'
    )
    assert [b.text for b in read] == ["one", "two", "three"]


def test_few_marked_pages_are_found_and_learnt_from(spark):
    """Most pages mark no article; the sample is taken from those that do."""
    plain = "<html><body><div class=x><p>Nothing marked {0}.</p></div></body></html>"
    rows = [(i, "u", plain.format(i)) for i in range(600)]
    rows += [(1000 + i, "u", page(f"<h1>Title {i}</h1><p>Some text {i}, and more of it.")) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in block_labeller.extract_main_text(pages).collect()}
    assert len(got) == len(rows)
    assert [got[1000 + i] for i in range(40)] == [f"Title {i}\n\nSome text {i}, and more of it." for i in range(40)]


def test_a_page_of_very_many_blocks_is_labelled_alone():
    rng = np.random.default_rng(1)
    net = block_labeller.Network.start(block_labeller.vectors(block_labeller.blocks("<p>a")).shape[1])
    pages = ["<p>a.<p>b.", page("<p>x." * 30_000), "", page("<p>y.<p>z.")] * 2
    alone = [block_labeller.main_text([p], net)[0] for p in pages]
    assert block_labeller.main_text(pages, net) == alone
    sizes = [int(n) for n in rng.integers(1, 400, 3000)] + [200_000]
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    parts = list(block_labeller.chunks(order, sizes))
    assert [i for part in parts for i in part] == order
    for part in parts:
        assert len(part) == 1 or len(part) * sizes[part[-1]] <= block_labeller.CHUNK_BLOCKS


def test_labeller_learns_the_article(spark):
    pages = [r.html for r in table(spark, SF, "pages").orderBy("page_id").collect()]
    read = [block_labeller.blocks(p) for p in pages]
    net = block_labeller.train(read[:30] * 4)
    right, total = block_labeller.evaluate(iter(read[30:]), net)
    assert right / total > 0.98


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", page("<h1>Hi</h1><p>There."), 3)] * 2
    schema = "page_id long, url string, html string, text int"
    rows += [(i, "u", page(f"<h1>Title {i}</h1><p>Some text {i}."), i) for i in range(10, 60)]
    got = block_labeller.extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == "" and by[2].text == "" and by[2].n_chars == 0
    assert by[3].text == "Hi\n\nThere." and by[3].n_chars == 10
    empty = spark.createDataFrame([], schema)
    assert block_labeller.extract_main_text(empty).count() == 0


# --- quality ------------------------------------------------------------------------------------


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(4)
    odds, pairs = rng.normal(size=5), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for labels in itertools.product((0, 1), repeat=5):
        w = np.exp(
            sum(odds[t] for t in range(5) if labels[t])
            + sum(pairs[labels[t], labels[t + 1]] for t in range(4))
        )
        total += w
        good += w * np.array(labels)
    p, _ = line_crf.marginals(
        np.concatenate([odds, odds[:1]]), np.array([0, 5]), pairs
    )
    assert p[:5] == pytest.approx(good / total)


def test_classifier_on_held_out_documents(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    labels = table(spark, sf, "labels")
    rows = line_crf.score_documents(table(spark, sf, "documents"), labels)
    judged = rows.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(judged) > 50
    assert sum(r.predicted == r.quality for r in judged) / len(judged) > 0.95


def test_scores_of_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(4, 1), (9, 0), (None, 1), (10, None)], "doc_id long, quality int")
    rows = line_crf.score_documents(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    for r in rows:
        assert r.held_out == (
            r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        )
    unlabelled = line_crf.score_documents(odd_documents, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert line_crf.score_documents(odd_documents.limit(0), labels).count() == 0


# --- tokens -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path(bpe_tree.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_tree_equals_the_whole_encoding(codec):
    rng = random.Random(8)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "中文", "!", "...", " ", "🙂", "\x1c"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120)))
        ids = bpe_tree.encode_tree(text, codec.encode_ordinary, leaf_chars=rng.randrange(1, 20))
        assert ids == codec.encode_ordinary(text)
        assert bpe_tree.decode_tree(ids, codec.decode_bytes, leaf=3) == text.encode()


def test_encoding_of_odd_rows(spark, odd_documents, codec):
    rows = bpe_tree.encode_documents(odd_documents, segment_chars=1000).collect()
    texts = Counter()
    for r in odd_documents.collect():
        ids = codec.encode_ordinary(r.text or "")
        listed = ",".join(map(str, ids)).encode()
        texts[
            (r.doc_id, len(ids), hashlib.sha256(listed).hexdigest(),
             hashlib.sha256((r.text or "").encode()).hexdigest())
        ] += 1
    assert Counter(map(tuple, rows)) == texts
    assert bpe_tree.encode_documents(odd_documents.limit(0)).count() == 0


# --- licences -----------------------------------------------------------------------------------


def test_licences_in_other_dress(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + license_digest.MIT.upper().replace("\n", "  \n * ")
    rows = [
        (1, mit, "s"), (2, "x\nReleased under the MIT Licence!\nSPDX-License-Identifier: MIT", "s"),
        (3, None, "s"), (4, "", "s"), (5, license_digest.MIT + " more", "s"), (5, mit, None),
    ]
    got = license_digest.scan_licenses(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    seen = sorted((r.doc_id, r.license_id or "", r.n_notices, r.notice_ids) for r in got)
    assert seen == [
        (1, "MIT", 0, ""), (2, "", 2, "MIT"), (3, "", 0, ""), (4, "", 0, ""), (5, "", 0, ""),
        (5, "MIT", 0, ""),
    ]
    assert license_digest.scan_licenses(documents(spark, rows[:0])).count() == 0


def rewrapped(text, width):
    """The text with other line ends; lines that state a copyright stay as they are."""
    out, open_lines = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip() and not re.match(license_digest.COPYRIGHT_LINE, line.lower()):
            open_lines.append(line)
            continue
        wrap = textwrap.fill(" ".join(open_lines), width, break_long_words=False, break_on_hyphens=False)
        out, open_lines = [*out, wrap, line], []
    return "\n".join(out)


def test_licences_at_any_width(spark):
    texts = [(key, text) for key, text in license_digest.LICENSES if "\n" in text]
    rows = [
        (i, "Copyright Jane Doe\n\n" + rewrapped(text, width), "s")
        for i, (_, text) in enumerate(texts)
        for width in (24, 40, 61, 72, 79, 80, 100, 1000)
    ]
    got = license_digest.scan_licenses(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [(r.doc_id, r.license_id) for r in got if r.license_id != texts[r.doc_id][0]] == []
    statements = ["Copyright 2020 A", "(c) 2021 B", "Copyright (c) C", "© D", "# Copyright The E Authors"]
    rows = [(i, f"{line}\n\n{license_digest.ISC}", "s") for i, line in enumerate(statements)]
    got = license_digest.scan_licenses(documents(spark, rows)).collect()
    assert [r.license_id for r in got] == ["ISC"] * len(statements)


def test_long_licences(spark):
    folder = Path(license_digest.__file__).parent / "licences"
    files = sorted(folder.glob("*.txt"))
    rows = [(i, f.read_text(), "s") for i, f in enumerate(files)]
    rows.append((len(files), "SPDX-License-Identifier: GPL-2.0-or-later", "s"))
    got = {r.doc_id: r for r in license_digest.scan_licenses(documents(spark, rows)).collect()}
    for i, f in enumerate(files):
        assert got[i].license_id.removesuffix(".0") == f.stem.removesuffix(".0")
    assert (got[len(files)].n_notices, got[len(files)].notice_ids) == (1, "GPL-2.0")


def test_python_gets_texts_in_small_batches(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(40).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("a b "), 1 << 18).alias("text")
    )

    def rows_of(batches):
        for batch in batches:
            yield batch[["doc_id"]].assign(n=len(batch)).head(1)

    before = spark.conf.get(limit, None)
    try:
        for run in (bpe_tree.encode_documents, odd_sketch_dedup.near_duplicates):
            spark.conf.unset(limit)
            run(texts.limit(0))
            sizes = texts.coalesce(1).mapInPandas(rows_of, "doc_id long, n long").collect()
            assert len(sizes) > 1 and all(r.n * (1 << 20) <= 2 * common.BATCH_BYTES for r in sizes)
            spark.conf.set(limit, "1m")
            run(texts.limit(0))
            assert spark.conf.get(limit) == "1m"
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
