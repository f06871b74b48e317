"""The pipeline: each stage against brute force on its own input, all of it over the smallest tables."""

import brute
import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from repotide.session import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [*brute.edge_rows(), (None, "no id at all"), (15, "a"), (700, "token=abcdefghijklmn and more"), (701, "0123456789abcdef0123")]
    return cut(brute.frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 700, None).otherwise(F.col("lang"))))


def ids(df):
    return sorted((-1 if r[0] is None else r[0]) for r in df.select("doc_id").collect())


def test_language_stage(spark, edges):
    out = pipeline.language_stage(spark, edges, SF)
    assert out.columns == edges.columns
    kept = sorted((-1 if r[0] is None else r[0]) for r in edges.collect() if any(c.isalpha() for c in r["text"] or ""))
    assert ids(out) == kept and out.filter("lang is null").count() == 0


def test_near_duplicate_stage(spark, edges):
    out = pipeline.near_duplicate_stage(spark, edges, SF)
    own = [(r["doc_id"], r["text"]) for r in edges.collect() if r["doc_id"] is not None]
    want = sorted({d for d, (_, c) in brute.components(own).items() if c == d})
    assert out.columns == edges.columns and ids(out) == [-1, *want]


def test_near_duplicate_stage_keeps_texts_of_one_id(spark):
    one, two = brute.prose(41, 60), brute.prose(42, 60)
    docs = brute.frame(spark, [(1, one), (1, two), (1, one), (2, two + " x"), (3, brute.prose(43, 60))])
    out = pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted([(1, one), (1, two), (3, brute.prose(43, 60))])


def test_decontamination_stage(spark, edges):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = brute.frame(spark, [(500 + i, brute.prose(i, 20) + " " + t + " end") for i, (_, t) in enumerate(items[:5])])
    out = pipeline.decontamination_stage(spark, edges.unionByName(dirty), SF)
    assert out.columns == edges.columns and ids(out) == ids(edges)


def test_secret_stage(spark, edges):
    out = {r["doc_id"]: r for r in pipeline.secret_stage(spark, edges, SF).collect()}
    assert out[700]["text"] == "[REDACTED] and more" and out[700]["n_chars"] == len("[REDACTED] and more")
    assert out[701]["text"] == "[REDACTED]" and out[12]["text"] is None
    untouched = {r["doc_id"]: r for r in edges.collect() if not brute.base_secrets(r["text"])}
    assert all(out[d] == r for d, r in untouched.items())
    assert len(pipeline.secret_stage(spark, edges, SF).collect()) == edges.count()


def test_stages_on_no_rows(spark, edges):
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, edges.limit(0), SF)
        assert out.columns == edges.columns and out.collect() == []


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pipeline.run(spark, SF).collect()
    own = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    alive = {d for d, t in own if any(c.isalpha() for c in t or "")}
    first = {d for d, (_, c) in brute.components([x for x in own if x[0] in alive]).items() if c == d}
    hit = {d for d, (_, n, _) in brute.contamination(own, items).items() if n}
    assert {r["doc_id"] for r in out} == first - hit
    assert all(0 <= r["offset"] and r["offset"] + r["length"] <= 1024 for r in out)
