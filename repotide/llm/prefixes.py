"""Prefix trie of conversations from sorted sequences: LCPs, a sparse table, two binary searches per prefix.

Conversations are cut into chunks of CHUNK turns, each under the key of the prefix before it, so no row grows with a
conversation. Chunks are sorted by (depth, prefix key, turns); the range partitions are the slices that tasks work on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repotide.operators.windows import ordered_prefix
from repotide.session import cut

#: Turns of a chunk; chunks of a slice that are searched together, and about as many in a range partition times eight.
CHUNK, SLICE = 32, 8192
#: Ids of one piece of a member list.
PIECE = 4096
#: A node with more than this share of all children is met by broadcast: there are fewer than so many of them.
HEAVY = 1000
#: Heads are the first HEADS turns of every FAMILY-th conversation.
HEADS, FAMILY = 3, 20

_TURN = "array<struct<a:bigint,b:bigint,words:bigint>>"
_NODE = "ka long, kb long, pa long, pb long, depth long, n_convs long, conv_id long, n_leaves long, saved long"


def placed_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, at, ta, tb, words): turns numbered from 0 by ``turn``, null first; rows without conv_id go.

    Null roles and texts are empty. Rows of one (conv_id, turn) follow each other by a hash of role and text.
    The numbers come from slices with offsets, so a conversation may hold any share of the rows; what is sorted are
    hashes and counts, not texts.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    slim = rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), words.alias("words"),
        F.xxhash64(F.octet_length(role), role, text).alias("ta"), F.xxhash64(text, role, F.lit("turn")).alias("tb"))
    order = [F.col("turn").asc_nulls_first(), F.col("ta"), F.col("tb"), F.col("words")]
    return ordered_prefix(slim, ["conv_id"], order, "rn").select("conv_id", (F.col("rn") - 1).alias("at"), "ta", "tb", "words")


def _pair(depth: Column) -> list[Column]:
    """The identity of a turn at its depth."""
    return [F.xxhash64(depth, "ta", "tb").alias("a"), F.xxhash64("tb", "ta", depth, F.lit("turn")).alias("b")]


def rebuilt_turns(turns: DataFrame, heads: int = HEADS, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, a, b, words), (conv_id)): each conversation c begins with the first h turns of c - c % family.

    h = crc32(c) % (heads + 1). The second table holds every conversation, the turnless ones too. A remainder has
    the sign of c, as in SQL.
    """
    turns = cut(turns)
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    first = turns.filter((F.col("at") < heads) & (F.col("conv_id") % family == 0)).select(
        F.col("conv_id").alias("donor"), F.col("at").alias("head_at"), "ta", "tb", "words")
    given = first.groupBy("donor").agg(F.count("*").alias("given"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (heads + 1)).alias("h")
    plan = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("donor"), h).join(given, "donor", "left").select(
        "conv_id", "donor", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("shared"))
    plan = cut(plan)
    begun = plan.join(first, "donor").filter(F.col("head_at") < F.col("h")).select("conv_id", (F.col("head_at") + 1).alias("depth"), "ta", "tb", "words")
    # ``plan`` has one row a conversation; a long one is split by adaptive execution, since an exchange follows.
    own = turns.join(plan, "conv_id").filter(F.col("at") >= F.col("h")).select(
        "conv_id", (F.col("at") - F.col("h") + F.col("shared") + 1).alias("depth"), "ta", "tb", "words")
    return begun.unionByName(own).select("conv_id", "depth", *_pair(F.col("depth")), "words"), plan.select("conv_id")


def _chunks(turns: DataFrame, convs: DataFrame, chunk: int) -> DataFrame:
    """(conv_id, chunk, ra, rb, seq, cont): runs of ``chunk`` turns with the key of the prefix before them."""
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    bare = convs.select("conv_id", *[none.alias(c) for c in ("depth", "a", "b", "words")])  # so that turnless ones are there too
    number = F.coalesce(F.floor((F.col("depth") - 1) / chunk), zero).alias("chunk")
    turn = F.when(F.col("depth").isNotNull(), F.struct("depth", "a", "b", "words"))
    runs = turns.unionByName(bare).groupBy("conv_id", number).agg(
        F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["a"], t["b"], t["words"])).cast(_TURN).alias("seq"),
        F.coalesce(F.bit_xor("a"), zero).alias("xa"), F.coalesce(F.bit_xor("b"), zero).alias("xb"))
    by = Window.partitionBy("conv_id").orderBy("chunk")  # a row for every ``chunk`` turns
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(
        "conv_id", "chunk", F.coalesce(F.bit_xor("xa").over(before), zero).alias("ra"), F.coalesce(F.bit_xor("xb").over(before), zero).alias("rb"),
        "seq", F.lead("chunk").over(by).isNotNull().alias("cont"))


def _common(one: Column, two: Column) -> Column:
    """Turns that two sequences share from the start."""
    same = F.zip_with(one, two, lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same).cast("long")).otherwise(first - 1)


def _sorted_slices(chunks: DataFrame, per_slice: int) -> DataFrame:
    """Chunks in sorted slices, written down, with ``lcp`` to the chunk before and ``leaf`` where a childless node ends.

    The ends of neighbouring slices are compared through a table of one row a slice.
    """
    keys = ["chunk", "ra", "rb", F.transform("seq", lambda t: F.struct(t["a"], t["b"])), "cont", "conv_id"]
    n = max(1, -(-chunks.count() // per_slice))
    laid = chunks.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    laid = cut(laid.withColumn("at", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("at", 33)))
    row = F.struct("chunk", "ra", "rb", "seq")
    ends = laid.groupBy("slice").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"),
                                     F.min_by(row, "at").alias("first"), F.max_by(row, "at").alias("last"))
    along = Window.orderBy("slice")  # a row a slice
    ends = ends.select("slice", "first_at", "last_at", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after"))
    inside = Window.partitionBy("slice").orderBy("at")
    near = laid.withColumns({"prev": F.lag(row).over(inside), "next": F.lead(row).over(inside)}).join(ends, "slice")
    prev = F.when(F.col("at") == F.col("first_at"), F.col("before")).otherwise(F.col("prev"))
    after = F.when(F.col("at") == F.col("last_at"), F.col("after")).otherwise(F.col("next"))

    def lcp(other: Column) -> Column:
        here = (other["chunk"] == F.col("chunk")) & (other["ra"] == F.col("ra")) & (other["rb"] == F.col("rb"))
        return F.when(F.coalesce(here, F.lit(False)), _common(F.col("seq"), other["seq"])).otherwise(F.lit(-1).cast("long"))

    zero = F.lit(0).cast("long")
    add = lambda rows: F.aggregate(rows, zero, lambda s, t: s + t["words"])
    near = near.withColumns({"lcp": lcp(prev), "up": lcp(after)})
    new = F.slice("seq", F.greatest("lcp", zero).cast("int") + 1, F.size("seq"))
    return near.select(
        "slice", "at", "conv_id", "chunk", "ra", "rb", "seq", "cont", "lcp",
        (~F.col("cont") & (F.col("up") < F.size("seq"))).cast("long").alias("leaf"), add(F.col("seq")).alias("total"), add(new).alias("new"))


def _with_rest(marked: DataFrame) -> DataFrame:
    """``leaf``, ``total`` and ``new`` of each chunk with those of the conversation's later chunks added."""
    long_ = marked.filter("chunk > 0").select("conv_id").distinct()
    later = Window.partitionBy("conv_id").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = marked.join(long_, "conv_id", "left_semi").select(
        "conv_id", "chunk", *[F.sum(c).over(later).alias(f"{c}_rest") for c in ("leaf", "total", "new")])
    return marked.join(sums, ["conv_id", "chunk"], "left").withColumns(
        {c: F.coalesce(f"{c}_rest", c) for c in ("leaf", "total", "new")}).drop("leaf_rest", "total_rest", "new_rest")


def _levels(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level j holds the least of every 2 ** j values in a row."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def _extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the interval around row ``at`` whose neighbouring LCPs are all at least ``depth``.

    ``table`` is over the LCPs of each row with the one before. The two ends are found independently, each by a
    binary search whose range minima are single look-ups.
    """
    n, left, right = len(table[0]), at.copy(), at.copy()
    for j in range(len(table) - 1, -1, -1):
        size, level = 1 << j, table[j]
        # Rows left-size+1 .. left: going on to row left-size needs all their LCPs.
        fits = left >= size
        fits[fits] = level[left[fits] - size + 1] >= depth[fits]
        left[fits] -= size
        fits = right + size < n
        fits[fits] = level[right[fits] + 1] >= depth[fits]
        right[fits] += size
    return left, right


def _least(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least value of rows left .. right."""
    level = np.frexp(right - left + 1)[1] - 1
    out = np.empty(len(left), np.int64)
    for j in np.unique(level):
        m = level == j
        out[m] = np.minimum(table[j][left[m]], table[j][right[m] - (1 << int(j)) + 1])
    return out


def slice_nodes(rows: pa.Table, size: int) -> pa.RecordBatch:
    """What one run of sorted chunks (of ``size`` turns) adds to each of its nodes.

    Every (chunk, depth) is a candidate prefix; the one at its interval's first row speaks for the node.
    """
    n = rows.num_rows
    seq = rows.column("seq").combine_chunks()
    sizes = seq.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = seq.flatten()
    a, b, words = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    chunk, conv, lcp, leaf, total, new, ra, rb = (rows.column(c).to_numpy() for c in ("chunk", "conv_id", "lcp", "leaf", "total", "new", "ra", "rb"))
    near = lcp.copy()
    near[0] = -1  # rows before this run are not here
    near[1:][np.diff(rows.column("slice").to_numpy()) != 0] = -1  # nor are slices in between
    table = _levels(near)
    start = np.cumsum(sizes) - sizes
    # Candidates (row, depth): depth 0 is the root and only there a node of its own chunk.
    low = (chunk > 0).astype(np.int64)
    many = sizes + 1 - low
    at = np.repeat(np.arange(n), many)
    depth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + low[at]
    left, right = _extents(table, at, depth)
    own = left == at
    at, depth, right = at[own], depth[own], right[own]
    # Keys and word sums of all prefixes: running totals over the flat turns, less what stands before the row.
    def running(values: np.ndarray, op: np.ufunc) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), op.accumulate(values)]) if len(values) else np.zeros(1, np.int64)

    xa, xb, ws = running(a, np.bitwise_xor), running(b, np.bitwise_xor), running(words, np.add)

    def key(root: np.ndarray, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        return root[at] ^ x[start[at] + d] ^ x[start[at]]

    up = np.maximum(depth - 1, 0)
    before = ws[start[at] + up] - ws[start[at]]  # words of the prefix but for its last turn
    sums = [np.concatenate([np.zeros(1, np.int64), np.cumsum(v)]) for v in (leaf, total, new)]
    leaves, all_words, new_words = (s[right + 1] - s[at] for s in sums)
    count = right - at + 1
    # The first row's new turns begin above its true LCP; those of the subtree begin at ``depth``.
    known = np.maximum(lcp[at], 0)
    above = np.where(known < up, before - (ws[start[at] + np.minimum(known, up)] - ws[start[at]]), 0)
    saved = all_words - count * before - (new_words - above)
    return pa.RecordBatch.from_arrays(
        [pa.array(v.astype(np.int64)) for v in (
            key(ra, xa, depth), key(rb, xb, depth), key(ra, xa, up), key(rb, xb, up), depth + chunk[at] * size,
            count, _least(_levels(conv), at, right), leaves, saved)],
        names=["ka", "kb", "pa", "pb", "depth", "n_convs", "conv_id", "n_leaves", "saved"])


def _partial_nodes(marked: DataFrame, chunk: int, run: int) -> DataFrame:
    """Node rows of runs of at most ``run`` sorted chunks; those of one node add up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, have = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, run - have)
                kept.append(part)
                have, batch = have + part.num_rows, batch.slice(part.num_rows)
                if have == run:
                    yield slice_nodes(pa.Table.from_batches(kept), chunk)
                    kept, have = [], 0
        if kept:
            yield slice_nodes(pa.Table.from_batches(kept), chunk)

    slim = marked.select("slice", "at", "conv_id", "chunk", "ra", "rb", "seq", "lcp", "leaf", "total", "new")
    return slim.repartition("slice").sortWithinPartitions("slice", "at").mapInArrow(work, _NODE)


def _member_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(ka, kb, ends_sha256) of the ids in each group, ascending and comma-joined.

    Ids are numbered in slices and joined in pieces of ``piece``; a hash has to read the pieces of a group in
    order, which one task does without holding more than one of them.
    """
    numbered = ordered_prefix(ends, ["ka", "kb"], [F.col("conv_id")], "rn")
    pieces = numbered.groupBy("ka", "kb", F.floor((F.col("rn") - 1) / piece).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            rows = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2])], names=["ka", "kb", "ends_sha256"])

        for batch in batches:
            for ka, kb, ids in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "ids")), strict=True):
                if (ka, kb) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (ka, kb), hashlib.sha256(ids.encode())
            if out:
                yield flush()
        if now is not None:
            out.append((*now, state.hexdigest()))
            yield flush()

    return pieces.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "piece").select("ka", "kb", "ids").mapInArrow(
        digest, "ka long, kb long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, chunk: int = CHUNK, run: int = SLICE, per_slice: int = 8 * SLICE) -> DataFrame:
    """The trie of (conv_id, depth, a, b, words) ``turns`` over the conversations ``convs``, one row per node.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless
    nodes of its subtree, itself included), saved_tokens (over its subtree, members but one times the words of the
    last turn) and ends_sha256 of the members that end there. Without conversations there is no node.

    A turn's (a, b) are 128 bits of its depth, role and text. A chunk's LCP with the one before it in the whole order
    says which turns are new there and where a childless node ends; both are sums over the members of a node, so
    what each slice finds for a node adds up, and a prefix shared by all conversations is one row from each slice.
    """
    chunks = _chunks(turns, convs, chunk)
    marked = cut(_with_rest(cut(_sorted_slices(cut(chunks), per_slice))))
    parts = _partial_nodes(marked, chunk, run)
    nodes = cut(parts.groupBy("ka", "kb", "depth").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
    last = lambda c: F.aggregate("seq", F.col(f"r{c}"), lambda s, t: s.bitwiseXOR(t[c])).alias(f"k{c}")
    ends = marked.filter(~F.col("cont")).select(last("a"), last("b"), "conv_id")
    children = cut(nodes.filter("depth > 0").groupBy("pa", "pb").agg(F.count("*").alias("n_children")))
    parents = cut(nodes.join(children.withColumnsRenamed({"pa": "ka", "pb": "kb"}), ["ka", "kb"], "left").na.fill(0, ["n_children"]).join(
        _member_digests(ends), ["ka", "kb"], "left"))
    # Children meet their parent: few parents have a large share of all nodes, and those go to every task.
    heavy = F.col("n_children") > nodes.count() / HEAVY
    named = parents.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), heavy.alias("heavy"))
    near = parents.join(F.broadcast(named.filter("heavy").select("pa", "pb", F.col("parent_conv_id").alias("great"))), ["pa", "pb"], "left")
    rest = near.filter("great is null and depth > 0").join(named.filter("not heavy").drop("heavy"), ["pa", "pb"], "left")
    none = F.lit(None).cast("long")
    both = rest.unionByName(near.filter("great is not null or depth = 0").withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.col("great")).otherwise(none)))
    return both.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations; see ``placed_turns``, ``rebuilt_turns`` and ``prefix_trie``."""
    return prefix_trie(*rebuilt_turns(placed_turns(rows)))
