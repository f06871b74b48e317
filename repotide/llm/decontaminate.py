"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repotide.llm.common import ascii_lower, let
from repotide.session import cut

#: Words of a window: a shared span of so many words is always found.
SPAN = 10
#: Words per hashed k-gram; a fingerprint is kept for every SPAN - GRAM + 1 k-grams in a row.
GRAM = 6
#: Fingerprint hits (about 30 bytes each) that may be broadcast.
BROADCAST_HITS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of letters, digits and characters outside ASCII; none for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def _grams(hashes: Column, size: int) -> Column:
    """Hash of every run of ``size`` words."""
    def one(i: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, i + j) for j in range(size)])

    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), one)).otherwise(
        F.array().cast("array<bigint>"))


def winnow(hashes: Column, span: int = SPAN, gram: int = GRAM) -> Column:
    """Fingerprints (k, pos, hash) of a text's word hashes.

    A k-gram is kept if its hash is the least of some window of span - gram + 1 k-grams (all of them at a
    tie). The choice depends on the window's words alone, so two texts that share ``span`` words in a row
    keep the same k-gram of them.
    """
    window = span - gram + 1

    def kept(g: Column) -> Column:
        least = F.when(F.size(g) >= window, F.transform(
            F.sequence(F.lit(0), F.size(g) - window), lambda s: F.least(*[F.get(g, s + j) for j in range(window)])))

        def positions(m: Column) -> Column:
            # No window's least exceeds a hash in it, so one of them equals it if and only if the largest does.
            hit = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda p: F.get(g, p) == F.greatest(
                *[F.get(m, p - j) for j in range(window)]))
            return F.transform(hit, lambda p: F.struct(F.lit(gram).alias("k"), p.alias("pos"), F.get(g, p).alias("hash")))

        return F.when(F.size(g) >= window, let(least, positions))

    return let(_grams(hashes, gram), kept)


def _short(hashes: Column, size: int) -> Column:
    """Every k-gram of ``size`` words, for items of just so many."""
    return let(_grams(hashes, size), lambda g: F.transform(g, lambda h, i: F.struct(F.lit(size).alias("k"), i.alias("pos"), h.alias("hash"))))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _around(words: Column, pos: Column, k: Column, reach: Column) -> Column:
    """The k-gram at ``pos`` with the words before it (nearest first) and after it."""
    start = F.greatest(pos - reach, F.lit(0))
    return F.struct(
        F.slice(words, pos + 1, k).alias("core"),
        F.reverse(F.slice(words, start + 1, pos - start)).alias("before"),
        F.slice(words, pos + k + 1, reach).alias("after"))


def _agree(a: Column, b: Column, most: int) -> Column:
    """Number of leading words that two arrays share, up to ``most``."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(0), lambda n, i: F.when(
        (n == i) & (F.get(a, i) == F.get(b, i)), n + 1).otherwise(n))


def benchmark_fingerprints(items: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(k, hash, item_id, need, core, before, after) for every fingerprint of every item with words.

    An item of ``span`` words or more is winnowed; a shorter one is a single k-gram of all its words.
    """
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(
        F.col("item_id").isNotNull() & (F.size("words") > 0))
    n = F.size("words")
    long = words.filter(n >= span).select("item_id", "words", F.inline(winnow(_hashes(F.col("words")), span, gram)))
    short = words.filter(n < span)
    parts = [long.select("item_id", "k", "hash", F.lit(span).alias("need"), _around(
        F.col("words"), F.col("pos"), F.col("k"), F.lit(span - gram)).alias("ctx"))]
    for size in range(1, span):
        parts.append(short.filter(F.size("words") == size).select("item_id", "words", F.inline(_short(_hashes(F.col("words")), size))).select(
            "item_id", "k", "hash", F.lit(size).alias("need"), _around(F.col("words"), F.col("pos"), F.col("k"), F.lit(0)).alias("ctx")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("k", "hash", "item_id", "need", "ctx").distinct()


def contamination_spans(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, start, stop, item_id): runs of document words that occur in an item.

    ``key`` is a hash of the text, so rows of one id with different texts stay apart. Fingerprints of all
    documents meet those of all items in a semi join; the documents hit are read again, and each hit is
    extended word by word on both sides. Runs shorter than the item's window are dropped.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    marks = cut(benchmark_fingerprints(items, span, gram))
    lengths = sorted(r["k"] for r in marks.filter(F.col("need") < span).select("k").distinct().collect())  # fewer than ``span``

    def prints(h: Column) -> Column:
        own = F.coalesce(winnow(h, span, gram), F.array().cast("array<struct<k:int,pos:int,hash:bigint>>"))
        return F.concat(own, *[_short(h, size) for size in lengths]) if lengths else own

    found = keyed.select("doc_id", "key", F.inline(let(_hashes(words_of(F.col("text"))), prints)))
    hits = found.join(marks.select("k", "hash").distinct(), ["k", "hash"], "left_semi")
    hit_docs = cut(hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("k", "pos", "hash")).alias("hits")))
    right = hit_docs.withColumnsRenamed({"doc_id": "__doc", "key": "__key"})
    # Few enough hits go to every task, so the texts stay where they are; more meet the texts in a shuffle.
    if (hit_docs.agg(F.sum(F.size("hits")).alias("n")).first()["n"] or 0) <= BROADCAST_HITS:
        right = F.broadcast(right)
    again = keyed.join(right, keyed["doc_id"].eqNullSafe(right["__doc"]) & (keyed["key"] == right["__key"])).select("doc_id", "key", "text", "hits")
    # Copies of a row give the same runs; the aggregations below count them once.
    around = again.select("doc_id", "key", F.inline(let(words_of(F.col("text")), lambda w: F.transform("hits", lambda h: F.struct(
        h["k"].alias("k"), h["pos"].alias("pos"), h["hash"].alias("hash"), _around(w, h["pos"], h["k"], F.lit(span - gram)).alias("own"))))))
    pairs = around.join(marks, ["k", "hash"]).filter(F.col("own.core") == F.col("ctx.core"))
    left = _agree(F.col("own.before"), F.col("ctx.before"), span - gram)
    after = _agree(F.col("own.after"), F.col("ctx.after"), span - gram)
    return pairs.select("doc_id", "key", "k", "pos", "item_id", "need", left.alias("l"), after.alias("r")).filter(
        F.col("l") + F.col("k") + F.col("r") >= F.col("need")).select(
        "doc_id", "key", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("k") + F.col("r")).alias("stop"), "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_words, n_hit, hit_items (sorted as strings) for every document.

    A window is ``span`` consecutive item words (all of them in a shorter item); a document word inside any
    occurrence of one is hit. Every shared window is found. One row per input row; repeated rows get equal
    rows, a null text has no words, a null id is kept, an item without id or words is skipped, an empty table on
    either side gives no hits, other columns are ignored. ``key`` is a hash of the text.
    """
    spans = contamination_spans(docs, items, span, gram, id_col, text_col)
    runs = F.collect_set(F.sequence(F.col("start"), F.col("stop") - 1))
    per_doc = spans.groupBy("doc_id", "key").agg(
        F.size(F.array_distinct(F.flatten(runs))).cast("long").alias("hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "__doc", "key": "__key"})
    all_docs = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    on = all_docs["doc_id"].eqNullSafe(per_doc["__doc"]) & (all_docs["key"] == per_doc["__key"])
    return all_docs.join(per_doc, on, "left").select(
        "doc_id", "key", "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("hit_items"))
