"""A corpus pipeline of five stages; each calls one operator of ``repotide.llm`` and acts on what it finds.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``docs``; further columns pass through.
Null and empty texts go in the first stage (they have no language), repeated rows in the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repotide.llm.common import fitted, table
from repotide.llm.decontaminate import decontaminate
from repotide.llm.jaccard import jaccard_components
from repotide.llm.language import UNKNOWN, held_out, learn_profiles, predict_language
from repotide.llm.packing import pack_documents
from repotide.llm.secrets import RULES_VERSION, BlobLedger, redact, versions
from repotide.session import cut


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty or no letter) go; a null ``lang`` gets the predicted one."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    found = predict_language(docs, learn_profiles(known), keep=tuple(docs.columns))
    return found.filter(F.col("lang_pred") != UNKNOWN).select(
        *[F.coalesce("lang", "lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; rows without id stay.

    An id with several texts keeps each of them once; of rows with the same id and text one stays, always the same.
    """
    found = cut(jaccard_components(spark, docs))
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    side = fitted(kept)
    out = docs.join(side, docs["doc_id"] == side["__kept"], "left_semi")
    if not again.isEmpty():
        twice = fitted(again.select(F.col("doc_id").alias("__again")))
        same = Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy(F.xxhash64(*docs.columns))
        repeated = out.join(twice, out["doc_id"] == twice["__again"], "left_semi").withColumn("__row", F.row_number().over(same))
        out = out.join(twice, out["doc_id"] == twice["__again"], "left_anti").unionByName(repeated.filter("__row = 1").drop("__row"))
    return out.unionByName(docs.filter(F.col("doc_id").isNull()))


def _same(docs: DataFrame, found: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(found["__doc"]) & (F.xxhash64(docs["text"]) == found["__key"])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    found = fitted(found.select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key")).distinct())
    return docs.join(found, _same(docs, found), "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mark; ``n_chars`` follows."""
    ledger = BlobLedger(spark)
    ledger.scan(versions(docs))
    hits = ledger.entries(RULES_VERSION).filter(F.size("findings") > 0)
    hits = fitted(hits.select(F.col("blob").alias("__blob"), F.col("findings").alias("__findings")))
    joined = docs.join(hits, F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == hits["__blob"], "left")
    hit = F.col("__blob").isNotNull()
    clean = joined.withColumn("__clean", F.when(hit, redact(F.col("text"), F.col("__findings"))).otherwise(F.col("text")))
    new = {"text": F.col("__clean"), "n_chars": F.when(hit, F.length("__clean").cast("long")).otherwise(F.col("n_chars"))}
    return clean.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack_documents(spark, docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL cannot express language vectors, set links by a trie or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
