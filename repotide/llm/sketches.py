"""Document fingerprints: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repotide.llm.common import let, rows_in

#: Words per shingle.
WORDS = 5
#: Share of the hash range whose hashes are kept.
FRACTION = 1 / 4
#: Rows per range of ids when the next document is looked up.
RANGE_ROWS = 2000
#: Most ranges; boundaries are literals of the plan.
MOST_RANGES = 4096


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The 64-bit hashes of a text's word shingles, with repeats; a text of fewer words is one shingle,
    one without words has none. Words are runs of other characters than white space."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    hashed = F.transform(split, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        def one(i: Column) -> Column:
            return F.xxhash64(*[F.get(h, i + j) for j in range(words)])

        whole = F.when(F.size(h) > 0, F.array(F.xxhash64(h)))
        return F.when(F.size(h) >= words, F.transform(F.sequence(F.lit(0), F.size(h) - words), one)).otherwise(
            F.coalesce(whole, F.array().cast("array<bigint>")))

    return let(hashed, shingles)


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """The kept hashes of a text: sorted, different, all below ``fraction`` of the hash range.

    Sketches of one fraction merge by union, and what two share estimates containment whatever their sizes.
    If no hash is below (short texts) the smallest one stands alone, so that only texts without words have
    an empty sketch.
    """
    limit = int(-(2**63) + fraction * 2**64)

    def kept(h: Column) -> Column:
        below = F.filter(h, lambda x: x < F.lit(limit))
        return F.when(F.size(below) > 0, F.array_sort(F.array_distinct(below))).when(
            F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>"))

    return let(shingle_hashes(text, words), kept)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two texts from their sketches: 1 for two empty ones, 0 for one."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a`` that is in ``b``; 0 for an empty ``a``."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def as_text(hashes: Column) -> Column:
    """A sketch as text: its hashes in hex."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def _place(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value`` (none for null): a binary search, one comparison a bit.

    The bounds are one literal and every step's place is bound, so the expression follows the number of bits, not
    a power of it.
    """
    if not bounds:
        return F.lit(0)

    def further(edges: Column, step: int) -> Callable[[Column], Column]:
        return lambda p: F.when(F.coalesce(F.get(edges, p + (step - 1)) <= value, F.lit(False)), p + step).otherwise(p)

    def search(edges: Column) -> Column:
        place = F.lit(0)
        for bit in reversed(range(len(bounds).bit_length())):
            place = let(place, further(edges, 1 << bit))
        return place

    return let(F.split(F.lit(",".join(str(int(b)) for b in bounds)), ",").cast("array<bigint>"), search)


def with_next(docs: DataFrame, order: str, carry: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``next_<c>`` for each column in ``carry``: its value in the next row by ``order`` (nulls first,
    then by the carried columns); the last row gets the first one's.

    Rows are dealt to ranges of the order column with about ``range_rows`` rows each (boundaries are
    approximate quantiles), looked up inside a range, and the last row of a range takes the first row of
    the next one that has rows. So no task sees more than its range.
    """
    n = rows_in(docs)
    parts = max(1, min(MOST_RANGES, n // range_rows))
    bounds = sorted(set(docs.stat.approxQuantile(order, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    ranged = docs.withColumn("__range", _place(F.col(order), bounds))
    # The first id of every range and of the one after it; at most MOST_RANGES rows.
    first = ranged.groupBy("__range").agg(F.min(F.struct(F.col(order).alias("o")))["o"].alias("o"))
    ring = Window.orderBy("__range")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ids = first.select(
        F.col("__range").alias("__at"),
        F.coalesce(F.lead("__range").over(ring), F.first("__range").over(whole)).alias("__from"),
        F.coalesce(F.lead(F.struct("o")).over(ring), F.first(F.struct("o")).over(whole))["o"].alias("__o"))
    # That row once more, as the end of the range before it; of several with one id the smallest.
    key = [F.col(order).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in carry if c != order]]
    on = (ranged["__range"] == ids["__from"]) & ranged[order].eqNullSafe(ids["__o"])
    ends = ranged.join(F.broadcast(ids), on).withColumn("__r", F.row_number().over(Window.partitionBy("__at").orderBy(*key)))
    ends = ends.filter("__r = 1").select(*docs.columns, F.col("__at").alias("__range"), F.lit(True).alias("__end"))
    inside = Window.partitionBy("__range").orderBy("__end", *key)
    led = ranged.withColumn("__end", F.lit(False)).unionByName(ends)
    for c in carry:
        led = led.withColumn(f"next_{c}", F.lead(c).over(inside))
    return led.filter(~F.col("__end")).drop("__range", "__end")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Sketches of every text, its edited form and the next text's, with their likeness.

    Columns: doc_id, n_chars (code points), edited, sketch, edited_sketch, next_sketch, near_edited,
    near_next. The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document by id; the last document's next is the first. Null texts are empty, rows of one
    id go by text, a single row is its own next, an empty table gives an empty result, other columns are
    ignored. The text goes through one shuffle, in ranges of ids.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "sketch", sketch(F.col("text"), words, fraction))
    pairs = with_next(own, "doc_id", ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    out = pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.col("next_sketch"))
    out = out.withColumn("edited_sketch", sketch(F.col("edited"), words, fraction))
    return out.select(
        "*", likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
