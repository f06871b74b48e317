"""Hard negatives by slots: positives' upper limits split an anchor's scores, each slot keeps its best few."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repotide.session import cut

#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 3
#: A negative scores at least LOW and at most HIGH hundredths of its positive.
LOW, HIGH = 50, 95
#: Components become floor(SCALE * x).
SCALE = 256
#: Anchors (a few hundred bytes each) that go through the rows together; more anchors take more passes.
PASS = 8192
#: Anchors and rows of a block of scores.
ANCHOR_BLOCK, ROW_BLOCK = 256, 2048

#: Largest score, so that hundredfold scores fit a long; larger ones count as this.
MOST = 1 << 55

_NONE = -(1 << 62)
_ROWS = "uid long, vec_id long, label long, q array<double>"
_FOUND = "anchor long, slot int, vec_id long, uid long, score long"


def valid_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(uid, vec_id, label, q) of the rows that take part, written down; ``q`` holds floor(SCALE * x) of every x.

    Rows with a null id, label or vector, and those with a null or non-finite component, stay out. ``uid`` tells
    repeated rows apart, so each of them is a row of its own.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def scaled(c: Column) -> Column:
        v = c.cast("double") * SCALE  # from 2 ** 53 on a double is a whole number already, and need not fit a long
        return F.when(F.abs(v) < 2.0 ** 53, F.floor(v).cast("double")).otherwise(v)

    whole = F.transform(x, scaled)
    fit = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~bad
    out = rows.filter(fit).select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("vec_id"),
                                  F.col(label).cast("long").alias("label"), whole.alias("q"))
    return cut(out)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as a matrix of ``width`` columns; shorter ones end in zeros, what lies beyond is dropped.

    The inner product with a vector of ``width`` components is then that over the common ones.
    """
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    ends = np.cumsum(sizes)
    for i, (stop, size) in enumerate(zip(ends, sizes, strict=True)):
        out[i, :min(size, width)] = flat[stop - size:stop - size + min(size, width)]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of all rows of ``a`` with all of ``b``, cut off at MOST either way.

    Floating-point products are exact where no sum can reach 2 ** 53; the few others are worked out in Python integers.
    """
    big = np.outer(np.abs(a).max(axis=1, initial=1), np.abs(b).max(axis=1, initial=1)) >= 2.0 ** 53 / max(a.shape[1], 1)
    with np.errstate(all="ignore"):
        out = np.where(big, 0, a @ b.T).astype(np.int64)
    for i, j in np.argwhere(big):
        exact = sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True))
        out[i, j] = max(-MOST, min(MOST, exact))
    return out


class _Best:
    """The ``k`` highest scores of each (anchor, slot) seen so far; ties go to the smaller vec_id."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k = k
        self.score = np.full((anchors, slots, k), _NONE, np.int64)
        self.vec = np.zeros((anchors, slots, k), np.int64)
        self.uid = np.zeros((anchors, slots, k), np.int64)

    def add(self, at: slice, slot: int, scores: np.ndarray, fits: np.ndarray, vec: np.ndarray, uid: np.ndarray) -> None:
        """Rows (sorted by vec_id) x anchors of one block; only those that fit can be kept."""
        live = np.nonzero(fits.any(axis=1))[0]
        if not len(live):
            return
        n = scores.shape[1]
        key = np.where(fits[live], scores[live], _NONE)
        take = min(self.k, n)
        # The k-th score first, then its ties by place: rows are sorted by id, so a stable sort of the few candidates settles them.
        least = np.partition(key, n - take, axis=1)[:, n - take]
        r, c = np.nonzero((key >= least[:, None]) & (key > _NONE))
        order = np.lexsort((c, -key[r, c], r))
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, c, place = r[place < take], c[place < take], place[place < take]
        wide = [np.concatenate([old[live + at.start, slot], np.full((len(live), take), fill, np.int64)], axis=1)
                for old, fill in ((self.score, _NONE), (self.vec, 0), (self.uid, 0))]
        for new, found in zip(wide, (key[r, c], vec[c], uid[c]), strict=True):
            new[r, self.k + place] = found
        best = np.lexsort((wide[2], wide[1], -wide[0]), axis=1)[:, :self.k]
        for old, new in zip((self.score, self.vec, self.uid), wide, strict=True):
            old[live + at.start, slot] = np.take_along_axis(new, best, axis=1)

    def batch(self, anchors: np.ndarray) -> pa.RecordBatch:
        a, s, p = np.nonzero(self.score > _NONE)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchors[a], pa.int64()), pa.array(s, pa.int32()), pa.array(self.vec[a, s, p], pa.int64()),
             pa.array(self.uid[a, s, p], pa.int64()), pa.array(self.score[a, s, p], pa.int64())],
            names=["anchor", "slot", "vec_id", "uid", "score"])


def _best_rows(rows: DataFrame, anchors: dict, k: int, limits: np.ndarray | None = None, floors: np.ndarray | None = None) -> DataFrame:
    """(anchor, slot, vec_id, uid, score): the best ``k`` rows of each anchor and slot, of every task.

    Without ``limits`` there is one slot, for other rows of the anchor's label; with them, slot j takes rows
    of other labels that score above limit j + 1 (or ``floors``, at the last one) and up to limit j.
    """
    sent = rows.sparkSession.sparkContext.broadcast((anchors, limits, floors))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, upper, lower = sent.value
        q, width = own["q"], own["q"].shape[1]
        best = _Best(len(q), 1 if upper is None else upper.shape[1], k)
        for batch in batches:
            vec = batch.column("vec_id").to_numpy()
            order = np.argsort(vec, kind="stable")
            vec, uid, label = vec[order], batch.column("uid").to_numpy()[order], batch.column("label").to_numpy()[order]
            x = _matrix(batch.column("q"), width)[order]
            for begin in range(0, len(vec), ROW_BLOCK):
                part = slice(begin, begin + ROW_BLOCK)
                for first in range(0, len(q), ANCHOR_BLOCK):
                    at = slice(first, min(first + ANCHOR_BLOCK, len(q)))
                    scores = _products(q[at], x[part])
                    same = own["label"][at][:, None] == label[part]
                    if upper is None:
                        best.add(at, 0, scores, same & (own["uid"][at][:, None] != uid[part]), vec[part], uid[part])
                        continue
                    fits = ~same & (scores >= lower[at][:, None])
                    for j in range(upper.shape[1]):
                        below = upper[at][:, j + 1][:, None] if j + 1 < upper.shape[1] else _NONE
                        best.add(at, j, scores, fits & (scores <= upper[at][:, j][:, None]) & (scores > below), vec[part], uid[part])
        yield best.batch(own["uid"])

    return rows.select("uid", "vec_id", "label", "q").mapInArrow(work, _FOUND)


def _top(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The first ``k`` of each key, numbered from 1; the rank limit holds per task before the shuffle too."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id", "uid")
    return found.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def _pass(rows: DataFrame, block: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result for one block of anchors (at most a little over PASS rows, on the driver by bound)."""
    took = block.orderBy("vec_id", "uid").collect()
    width = max((len(r["q"]) for r in took), default=0)
    q = np.zeros((len(took), width))
    for i, r in enumerate(took):
        q[i, :len(r["q"])] = r["q"]
    own = {"uid": np.array([r["uid"] for r in took], np.int64), "label": np.array([r["label"] for r in took], np.int64), "q": q}
    pos = cut(_top(_best_rows(rows, own, positives), ["anchor"], positives, "nth"))
    place = {u: i for i, u in enumerate(own["uid"].tolist())}
    # high * score // 100 is the upper limit; limits fall with the slot, equal ones leave the later slot empty.
    limits = np.full((len(took), positives), _NONE + 1, np.int64)
    floors = np.full(len(took), -_NONE, np.int64)
    for r in pos.collect():
        limits[place[r["anchor"]], r["nth"] - 1] = high * r["score"] // 100
        floors[place[r["anchor"]]] = min(floors[place[r["anchor"]]], -(-low * r["score"] // 100))
    found = _best_rows(rows, own, negatives, limits, floors)
    slots = _top(found, ["anchor", "slot"], negatives, "kth").drop("kth")
    # A positive's window starts in its own slot and runs on through the lower ones.
    wanted = pos.select(F.col("anchor").alias("a"), "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    suffix = slots.join(wanted, (F.col("anchor") == F.col("a")) & (F.col("slot") >= F.col("nth") - 1))
    few = _top(suffix, ["anchor", "nth"], negatives, "rank").filter(low * F.col("positive_score") <= 100 * F.col("score"))
    ids = rows.sparkSession.createDataFrame([(r["uid"], r["vec_id"]) for r in took], "anchor long, anchor_id long")
    return few.join(F.broadcast(ids), "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(
    rows: DataFrame, anchor: str, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, per_pass: int = PASS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor and positive.

    ``rows``: vec_id, embedding, label (others are not read); ``anchor``: a condition on (vec_id, label). The
    score of a row is its integer inner product with the anchor, over the components both have (at most MOST). An anchor's
    positives are its best ``positives`` other rows of its label; a positive's negatives are the best
    ``negatives`` rows of other labels from ``low`` to ``high`` hundredths of its score. Ties go to the smaller vec_id.

    Anchors are a stated query set: they go through all rows in blocks of ``per_pass``, two scans a block. The
    upper limits of the positives cut an anchor's scores into disjoint slots; every task keeps the best few of
    each slot, so a shuffle carries a bounded number of rows per anchor and task, whatever the labels' sizes.
    The window of a positive is what its slot and the lower ones kept, merged downwards.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Repeated
    rows are rows of their own. Empty tables, and anchors without positives or negatives, give no rows.
    """
    valid = valid_vectors(rows)
    asked = valid.filter(anchor)
    passes = max(1, -(-asked.count() // per_pass))
    asked = asked.withColumn("__pass", F.pmod(F.xxhash64("vec_id", "uid"), F.lit(passes)))
    parts = [cut(_pass(valid, asked.filter(F.col("__pass") == i).drop("__pass"), positives, negatives, low, high)) for i in range(passes)]
    return reduce(DataFrame.unionByName, parts)


def shifted_labels(rows: DataFrame) -> DataFrame:
    """``rows`` with the label of every vec_id divisible by 7 moved on by one, modulo 10."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return rows.select("vec_id", "embedding", moved.alias("label"))
