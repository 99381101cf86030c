"""The whole corpus pipeline on small tables, and its stages on odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mlledger.llm import line_crf, mixing, odd_sketch_dedup
from mlledger.llm.common import table
from tests.conftest import SF
from tests.llm.test_operators import brute_components, codec, sentence  # noqa: F401

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def staged(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test")
        out[name] = docs
    return out


def test_each_stage_does_its_part(spark, codec):  # noqa: F811
    docs, out = table(spark, SF, "documents"), staged(spark, SF)
    field = line_crf.fit(docs, table(spark, SF, "labels"))
    good = docs.filter(line_crf.quality_score(F.col("text"), field) >= 0.7)
    assert out["quality"].columns == docs.columns
    assert sorted(out["quality"].collect()) == sorted(good.collect())
    left = {r.doc_id: r.text for r in out["quality"].collect()}
    wanted = {i for i, c in brute_components(left, 5, 80)[0].items() if i == c}
    assert {r.doc_id for r in out["near_dedup"].collect()} == wanted
    mixed = Counter(tuple(r) for r in out["source_mix"].collect())
    assert set(mixed) <= {tuple(r) for r in out["near_dedup"].collect()}
    assert max(mixed.values()) <= 2
    tokens = out["tokens"].collect()
    assert Counter(r.doc_id for r in tokens) == Counter(
        r[0] for r, n in mixed.items() for _ in range(n)
    )
    texts = {r[0]: r[1] for r in mixed}
    for r in tokens:
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(6)
    long = sentence(rng, 400)
    near = long + " end"
    rows = [
        (1, sentence(rng, 60)), (1, sentence(rng, 60)), (2, long), (None, long), (None, long),
        (None, near), (3, near), (4, None), (5, ""), (5, ""), (6, " \n "), (None, None),
        (None, sentence(rng, 50)), (7, sentence(rng, 5000).replace(" ", "\n")), (8, "one"),
    ]
    return [(i, text, "en" if k % 2 else None, None if k % 3 else "s", -1) for k, (i, text) in enumerate(rows)]


def test_near_dedup_judges_each_text(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows, COLUMNS).withColumns({"_copy": F.lit(1), "_key": F.lit("x")})
    kept = odd_sketch_dedup.kept_only(docs)
    assert kept.columns == docs.columns
    ours = [(r.doc_id, r.text) for r in kept.collect()]
    long = odd_rows[2][1]
    near = {(2, long), (None, long), (None, long + " end"), (3, long + " end")}
    assert [x for x in ours if x in near] == [(2, long)]
    rest = {(r[0], r[1]) for r in odd_rows} - near
    assert sorted(map(repr, (x for x in ours if x not in near))) == sorted(map(repr, rest))
    assert odd_sketch_dedup.kept_only(docs.limit(0)).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path, odd_rows):
    whole = staged(spark, folder(spark, tmp_path / "a", odd_rows, []))
    # nothing is labelled, so nothing can be rejected
    assert whole["quality"].count() == len(odd_rows)
    assert whole["tokens"].count() == whole["source_mix"].count() > 0
    empty = staged(spark, folder(spark, tmp_path / "b", [], [(1, 1, 0)]))
    assert [df.count() for df in empty.values()] == [0] * 4


def test_long_documents_are_learnt_whole(spark):
    good, bad = "A calm line of plain words here.", "@@## 99 || ## @@"
    late = "\n".join([good] * 4000 + [bad] * 8000)
    rows = [(i, late if i % 2 else "\n".join([good] * 5)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    field = line_crf.fit(docs, labels)
    scores = {r.doc_id: r.s for r in docs.select("doc_id", line_crf.quality_score(F.col("text"), field).alias("s")).collect()}
    assert max(s for i, s in scores.items() if i % 2) < min(s for i, s in scores.items() if not i % 2)
    assert line_crf.fit(docs, labels, sample_lines=20) is not None
    assert line_crf.fit(docs, labels, sample_lines=4) is None


def test_mixed_rows_come_as_often_as_they_are_taken(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows * 2, COLUMNS).withColumns({"_k1": F.lit(1), "n": F.lit("x")})
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    identity = [F.struct("doc_id", "source", F.md5("text"))]
    got = Counter(repr(r[0]) for r in rows.select(*identity).collect())
    given = Counter(repr(r[0]) for r in docs.select(*identity).collect())
    assert set(got) <= set(given)
    assert all(n <= 2 * given[k] for k, n in got.items())
    words = {s: 0 for s in (None, "s")}
    for r in rows.collect():
        words[r.source] += len((r.text or "").split())
    mixed = mixing.mix(docs).select("source", "taken").collect()
    assert words == {s: sum(r.taken for r in mixed if r.source == s) for s in words}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_very_many_copies_of_one_row(spark):
    rows = [(1, "w " * 5, "a")] * 9000 + [(i, f"x {i}", "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs).filter("source = 'a'").agg(F.sum("copies")).first()[0]
    assert mixing.mixed_documents(docs).filter("source = 'a'").count() == mixed > 4096
