"""Exact n-gram Jaccard join: rare-token candidates, then a trie of ordered sets in every candidate group."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repotide.llm.common import begin_task, fitted, keeps
from repotide.llm.components import connected
from repotide.session import cut, release

WORDS = 5
#: Two sets link when 100 * common >= PERCENT * union.
PERCENT = 80
#: The hash-ordered prefix is a fifth of a set plus its n / PART next tokens. A smaller PART costs more tokens
#: and needs more of them shared before two sets become candidates: 27 % at 10, 33 % at 8, 40 % at 5.
PART = 8
#: Sets of at most so many tokens make candidates by all of them: the rarest fifth of a whole set tells sets that are put
#: together from common lines apart, where the rarest part of a prefix does not.
WHOLE = 256
#: Sets that share a token with at most so many are told apart pair by pair before they make a group.
LIGHT = 16
#: Sets that one task joins among themselves; larger candidate groups are joined in chunks of so many.
GROUP = 512
#: Tokens that one task holds of such a group or chunk; groups with more are large, whatever their number of sets.
TOKENS = 2_000_000
#: Leaders per round of a large group: few at first, which is enough for tight groups.
LEADERS = (64, 1024, 4096, 16384)
#: Classes near a set that are named in a round; a set near more of them becomes a leader itself.
NEAR = 32
#: A table of node ids with at most so many rows may be broadcast.
BROADCAST_ROWS = 500_000
#: Cells (different tokens x queries) of the table of queries that walk a trie together, a byte each.
CELLS = 1 << 25

_MASK = (1 << 48) - 1
_WHOLE_BIT = 48  # set in the tokens of whole sets, so that those never meet the tokens of prefixes
_FACTORS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS_KEPT = 500_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()
keeps("jaccard", _HASHES.clear)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted different 64-bit hashes of the word shingles of a text.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased. A text of fewer words is one
    shingle, one without words has none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > _WORDS_KEPT:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out += h[j:len(h) - size + 1 + j] * _FACTORS[j]
    out ^= out >> np.uint64(32)
    out *= _FACTORS[-1]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _least_overlap(n: int, percent: int) -> int:
    """What a set of n must share with any partner."""
    return -(-percent * n // 100)


def prefix_sizes(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(tokens of the hash-ordered prefix, those of it that count once ordered by rarity).

    Let a set of n share c >= least(n) tokens with a partner. The l least common tokens in hash order are
    among the first n - c + l of both sets, so with l = n / PART the hash-ordered prefixes share at least that
    part of the smaller set. Among so many common tokens in a prefix of p, the first in any other
    order is within the first p - l + 1. Ordering by document frequency, tokens that nothing shares come first.
    """
    least = _least_overlap(n, percent)
    prefix = n - least + max(1, n // PART)
    return min(n, prefix), min(n, prefix) - max(1, least // PART) + 1


def candidate_tokens(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The hashes of a set that make candidates, cut to 48 bits: all of at most WHOLE, marked, and the hash-ordered
    prefix of a set that may be linked with a larger one than that. So two linked sets meet as whole ones or by prefixes."""
    cut_, parts = (s & np.uint64(_MASK)).astype(np.int64), []
    if len(s) <= WHOLE:
        parts.append(cut_ | (1 << _WHOLE_BIT))
    if len(s) >= _least_overlap(WHOLE + 1, percent):
        parts.append(cut_[:prefix_sizes(len(s), percent)[0]])
    return np.concatenate(parts)


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, key, tokens): size and content hash of each document's set, and the tokens that make candidates,
    once for every different set of a partition (copies are told apart by content).

    Tokens only make candidates, so hashes that fall together cost time, not results.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("jaccard")
        seen: set[str] = set()
        for rows in parts:
            for begin in range(0, rows.num_rows, 1024):
                part = rows.slice(begin, 1024)
                ids, sizes, keys, prefixes = part.column("doc_id"), [], [], []
                for known, text in zip(ids.is_valid().to_pylist(), part.column("text"), strict=True):
                    s = shingle_set(text.as_py(), words)
                    key = xxhash.xxh128_hexdigest(s.tobytes())
                    sizes.append(len(s))
                    keys.append(key)
                    if not len(s) or not known or key in seen:
                        prefixes.append(None)
                    else:
                        seen.add(key)
                        prefixes.append(candidate_tokens(s, percent))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes, pa.int32()), pa.array(keys), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n int, key string, tokens array<long>")


def _once(sets: DataFrame) -> DataFrame:
    """The sets with tokens, each content once, under its smallest id (and again in other partitions with that id)."""
    held, content = sets.filter("tokens is not null"), F.xxhash64("key").alias("content")
    first = held.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).filter("k > 1")
    again = fitted(held.join(first, "key").filter("doc_id != least").select("doc_id", content).distinct())
    return held.select("doc_id", "n", "tokens", content).join(again, ["doc_id", "content"], "left_anti")


def _candidates(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(edges u, v between sets that share a rare enough token; node, n, weight of those sets).

    Sets that share it with few others become an edge only if their tokens have enough in common, else chance
    meetings would chain most sets into one group as the table grows. Those that share it with many become a star.
    """
    tokens = _once(sets).select(F.col("doc_id").alias("node"), "n", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    scheme = (F.shiftright("token", _WHOLE_BIT) == 1).alias("whole")
    rows = tokens.join(shared, "token").groupBy("node", "n", scheme).agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    least = -F.floor(-F.col("n") * percent / 100)
    part = F.least(F.col("n"), F.col("n") - least + F.greatest(F.lit(1), F.floor(F.col("n") / PART)))
    prefix = F.when(F.col("whole"), F.col("n")).otherwise(part)
    rare = prefix - F.when(F.col("whole"), least).otherwise(F.greatest(F.lit(1), F.floor(least / PART))) + 1
    # Tokens that nothing shares come first and take their places; what is left goes to shared ones.
    left = (rare - (prefix - F.size("t"))).cast("int")
    weight = F.aggregate("t", F.lit(0).cast("double"), lambda a, x: a + x["df"]) / F.col("n")
    kept = cut(rows.filter(left > 0).select(
        "node", "n", "whole", weight.alias("weight"), F.col("t.token").alias("shared"), F.slice(F.col("t.token"), F.lit(1), left).alias("tokens")))
    stars = kept.select("node", "n", "whole", F.explode("tokens").alias("token"))
    heads = stars.groupBy("token").agg(F.min("node").alias("head"), F.count("*").alias("k")).filter("k > 1")
    met = cut(stars.join(heads, "token"))
    many = met.filter(F.col("k") > LIGHT).filter("node != head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    edges = _alike(met.filter(F.col("k") <= LIGHT), kept, percent).unionByName(many).distinct()
    return edges, kept.groupBy("node", "n").agg(F.max("weight").alias("weight"))


def _alike(light: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the sets with a common token in ``light`` whose tokens in ``kept`` have as many in common as linked sets must.

    Whole sets must share what links them. Prefixes share a part of the smaller set at least (see ``prefix_sizes``).
    Tokens that came twice in a set count for it, so hashes that fall together lose nothing.
    """
    one = light.select("token", "whole", F.col("node").alias("u"), F.col("n").alias("a"))
    other = light.select("token", F.col("node").alias("v"), F.col("n").alias("b"))
    near = one.join(other, "token").filter("u < v").filter(
        (100 * F.col("a") >= percent * F.col("b")) & (100 * F.col("b") >= percent * F.col("a")))
    pairs = near.select("whole", "u", "a", "v", "b").distinct()
    twice = F.size("shared") - F.size(F.array_distinct("shared"))
    left = kept.select("whole", F.col("node").alias("u"), F.col("n").alias("a"), F.col("shared").alias("x"), twice.alias("spare"))
    right = kept.select("whole", F.col("node").alias("v"), F.col("n").alias("b"), F.col("shared").alias("y"))
    common = F.size(F.array_intersect("x", "y")) + F.col("spare")
    linked = common * (100 + percent) >= percent * (F.col("a") + F.col("b"))
    part = F.greatest(F.lit(1), F.floor(F.least("a", "b") / PART))
    enough = F.when(F.col("whole"), linked).otherwise(common >= F.least(part, -F.floor(-percent * F.greatest("a", "b") / 100)))
    return pairs.join(left, ["whole", "u", "a"]).join(right, ["whole", "v", "b"]).filter(enough).select("u", "v")


def _places(tokens: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Where the members of ``s`` stand in the sorted ``tokens``; members that are not there are left out."""
    at = np.searchsorted(tokens, s)
    known = at < len(tokens)
    known[known] = tokens[at[known]] == s[known]
    return at[known]


def _blocks(paths: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of queries whose tokens times their number stay within CELLS."""
    start, held = 0, 0
    for i, path in enumerate(paths):
        if i > start and (held + len(path)) * (i + 1 - start) > CELLS:
            yield start, i
            start, held = i, 0
        held += len(path)
    if start < len(paths):
        yield start, len(paths)


def trie_links(base: list[np.ndarray], queries: list[np.ndarray] | None = None, percent: int = PERCENT,
               strong: int = PERCENT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index in base, indexes in queries linked with it, which of them at ``strong`` percent) by walking a
    trie of the base sets; without queries the base is joined with itself (links of a set with itself come or not).

    Tokens are ranked by how many base sets have them, most first; the sets in rank order, sorted, are the trie:
    sets with a common beginning stand together, and its overlap with every query is counted once for all of
    them. Queries leave a subtree when what they share and the most that can follow is too little. Tokens that
    no pair can share are left out, and queries go in blocks of at most CELLS tokens times queries.
    """
    if not base:
        return
    sizes = np.array([len(s) for s in base])
    tokens, counts = np.unique(np.concatenate(base), return_counts=True)
    if queries is None:
        queries, useful = base, counts > 1
    else:
        useful = np.zeros(len(tokens), bool)
        for s in queries:
            useful[_places(tokens, s)] = True
    rank_of = np.full(len(tokens), -1, np.int64)
    order = np.argsort(-counts[useful], kind="stable")
    rank_of[np.flatnonzero(useful)[order]] = np.arange(len(order))

    def ranked(s: np.ndarray) -> np.ndarray:
        r = rank_of[_places(tokens, s)]
        return np.sort(r[r >= 0])

    paths = [ranked(s) for s in base]
    by_path = sorted(range(len(base)), key=lambda i: paths[i].astype(">u4").tobytes())
    trie, sizes = [paths[i] for i in by_path], sizes[by_path]
    depths = np.array([len(p) for p in trie])
    asked = paths if queries is base else [ranked(s) for s in queries]
    for start, end_ in _blocks(asked):
        block = asked[start:end_]
        q = np.array([len(s) for s in queries[start:end_]])
        present = np.unique(np.concatenate(block))
        row_of = np.zeros(len(order), np.int32)  # row 0: no query of the block has the token
        row_of[present] = np.arange(1, len(present) + 1)
        has = np.zeros((len(present) + 1, len(block)), np.uint8)
        for j, path in enumerate(block):
            has[row_of[path], j] = 1
        stack = [(0, len(trie), 0, np.arange(len(block)), np.zeros(len(block), np.int64))]
        while stack:
            low, high, depth, active, overlap = stack.pop()
            first, last = trie[low], trie[high - 1]
            most = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:most] != last[depth:most])
            stop = depth + int(differ[0]) if len(differ) else most
            if stop > depth:
                overlap = overlap + has[np.ix_(row_of[first[depth:stop]], active)].sum(0, dtype=np.int64)
            reach = overlap + np.minimum(q[active] - overlap, depths[low:high].max() - stop)
            smallest = int(sizes[low:high].min())
            keep = reach * (100 + percent) >= percent * (q[active] + smallest)
            active, overlap = active[keep], overlap[keep]
            if not len(active):
                continue
            while low < high and depths[low] == stop:  # sets that end here
                linked = overlap * (100 + percent) >= percent * (q[active] + sizes[low])
                if linked.any():
                    sure = overlap[linked] * (100 + strong) >= strong * (q[active[linked]] + sizes[low])
                    yield by_path[low], active[linked] + start, sure
                low += 1
            while low < high:  # children: runs with the same next token
                token, end = trie[low][stop], low + 1
                while end < high and trie[end][stop] == token:
                    end += 1
                stack.append((low, end, stop, active, overlap))
                low = end


def _merge(labels: np.ndarray, members: np.ndarray) -> None:
    found = np.unique(labels[members])
    if len(found) > 1:
        labels[np.isin(labels, found)] = found[0]


def _grouped(parts: Iterator[pa.RecordBatch], keys: list[str], words: int) -> Iterator[tuple[tuple, Iterator[tuple[dict, np.ndarray]]]]:
    """Runs of rows with equal keys in sorted batches, each row with the set of its text; rows without words are
    left out. Only some texts are held at a time."""
    def rows() -> Iterator[tuple[dict, np.ndarray]]:
        for part in parts:
            for begin in range(0, part.num_rows, 64):
                for row in part.slice(begin, 64).to_pylist():
                    if len(s := shingle_set(row.pop("text"), words)):
                        yield row, s

    begin_task("jaccard")
    return groupby(rows(), key=lambda r: tuple(r[0][k] for k in keys))


def _join_small(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v) spanning links inside groups of at most GROUP sets; rows: comp, node, text."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(parts, ["comp"], words):
            found = list(group)
            sets, nodes = [s for _, s in found], np.array([r["node"] for r, _ in found])
            labels = np.arange(len(sets))
            for i, linked, _ in trie_links(sets, None, percent, percent):
                _merge(labels, np.append(linked, i))
            moved = np.flatnonzero(labels != np.arange(len(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved], pa.int64()), pa.array(nodes[labels[moved]], pa.int64())], names=["u", "v"])

    return rows.repartition("comp").sortWithinPartitions("comp").select("comp", "node", "text").mapInArrow(run, "u long, v long")


def _leader_blocks(group: Iterator[tuple[dict, np.ndarray]]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(nodes, sets) of the leaders that follow, at most GROUP sets and about TOKENS tokens at a time."""
    nodes, sets, held = [], [], 0
    for row, s in group:
        if sets and (len(sets) >= GROUP or held + len(s) > TOKENS):
            yield nodes, sets
            nodes, sets, held = [], [], 0
        nodes.append(row["node"])
        sets.append(s)
        held += len(s)
    if sets:
        yield nodes, sets


def _join_leaders(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v, kind) of members u with leaders v in every chunk; rows: comp, chunk, leads, node, text.

    Kind ``link``: what connects the linked sets of the chunk, each pair of classes once. ``near``: u is too far
    from v to be linked, but near enough for a set linked with v to be linked with u; v stands for its class,
    and classes that hold u are left out. ``many``: u is near more than NEAR classes, which are not named. So a
    chunk writes at most NEAR + 1 rows a member and one a leader.
    """
    near = max(1, 2 * percent - 100)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(parts, ["comp", "chunk"], words):
            rest, first = [], None  # members come before the leaders
            for row, s in group:
                if row["leads"]:
                    first = (row, s)
                    break
                rest.append((row["node"], s))
            if first is None or not rest:
                continue
            nodes, members, seen = [n for n, _ in rest], [s for _, s in rest], []
            mine = np.arange(len(nodes))
            for lead_nodes, leads in _leader_blocks(chain([first], group)):
                at = len(nodes)
                nodes += lead_nodes
                mine = np.append(mine, np.arange(at, len(nodes)))
                close = np.zeros((len(leads), len(members)), bool)
                for i, found, sure in trie_links(leads, members, near, percent):
                    if sure.any():
                        _merge(mine, np.append(found[sure], at + i))
                    close[i, found[~sure]] = True
                seen.append((np.packbits(close, axis=0), len(leads)))
            names = np.array(nodes)
            moved = np.flatnonzero(mine != np.arange(len(mine)))
            u, v, kinds = [names[moved]], [names[mine[moved]]], ["link"] * len(moved)
            for j in range(len(members)):
                bits = np.concatenate([np.unpackbits(b[:, j], count=c) for b, c in seen])
                away = np.unique(mine[len(members):][bits.astype(bool)])
                away = away[away != mine[j]]
                if len(away) > NEAR:
                    u.append(names[j:j + 1])
                    v.append(names[j:j + 1])
                    kinds.append("many")
                else:
                    u.append(np.repeat(names[j], len(away)))
                    v.append(names[away])
                    kinds += ["near"] * len(away)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(u), pa.int64()), pa.array(np.concatenate(v), pa.int64()), pa.array(kinds, pa.string())], names=["u", "v", "kind"])

    return rows.repartition("comp", "chunk").sortWithinPartitions("comp", "chunk", "leads").select(
        "comp", "chunk", "leads", "node", "text").mapInArrow(run, "u long, v long, kind string")


def _join_large(spark: SparkSession, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Spanning links of groups with more than GROUP sets or TOKENS tokens; rows: comp, node, weight, chunks, text.

    Leaders (sets whose tokens are most common first) meet all sets of their group, chunk by chunk. What a
    round leaves open: sets that no leader is linked with, which may be linked with each other, and sets near
    a leader of another class, since Jaccard distance is a metric and only those can be linked with a set
    that the leader is linked with. The next leaders are taken from them, until none are left. Classes only
    grow together, so a near pair inside one class is dropped for good; a set with more than NEAR others left
    leads in any case, so what is written between rounds follows the sets, not their pairs.
    """
    rows = cut(rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))
    ids = rows.select("comp", "node", "weight").distinct()
    led = spark.createDataFrame([], "node long")
    must = spark.createDataFrame([], "node long")
    near = spark.createDataFrame([], "u long, v long")
    classes = spark.createDataFrame([], "u long, root long")
    pool, turn = ids, 0
    while True:
        pick = Window.partitionBy("comp").orderBy(F.desc("weight"), "node")
        most = LEADERS[min(turn, len(LEADERS) - 1)]
        chosen = cut(pool.withColumn("r", F.row_number().over(pick)).filter(F.col("r") <= most).select("comp", "node"))
        open_ = rows.join(chosen.select("comp").distinct(), "comp", "left_semi")
        leaders = rows.join(chosen.select("node"), "node", "left_semi")
        copies = leaders.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        both = open_.select("comp", "chunk", F.lit(False).alias("leads"), "node", "text").unionByName(
            copies.select("comp", "chunk", F.lit(True).alias("leads"), "node", "text"))
        met = cut(_join_leaders(both, words, percent))
        before = (led, must, near, classes, pool)
        led = cut(led.unionByName(chosen.select("node")))
        classes = cut(connected(classes.select("u", F.col("root").alias("v")).unionByName(met.filter("kind = 'link'").select("u", "v"))))
        named = lambda c: classes.select(F.col("u").alias(c), F.col("root").alias(f"{c}_class"))
        # What has led met every set of its group, so nothing is open for it.
        apart = near.unionByName(met.filter("kind = 'near'").select("u", "v")).join(led, F.col("u") == led["node"], "left_anti").join(
            must, F.col("u") == must["node"], "left_anti").join(named("u"), "u", "left").join(named("v"), "v", "left").select(
            "u", F.coalesce("v_class", "v").alias("v"), F.coalesce("u_class", "u").alias("c")).filter("c != v").select("u", "v").distinct()
        apart = cut(apart)
        crowded = apart.groupBy("u").agg(F.count("*").alias("k")).filter(F.col("k") > NEAR).select(F.col("u").alias("node"))
        must = cut(must.unionByName(met.filter("kind = 'many'").select(F.col("u").alias("node"))).unionByName(crowded).distinct().join(led, "node", "left_anti"))
        near = cut(apart.join(must, apart["u"] == must["node"], "left_anti"))
        alone = ids.join(classes.select(F.col("u").alias("node")), "node", "left_anti").join(led, "node", "left_anti")
        some = alone.groupBy("comp").agg(F.count("*").alias("k")).filter("k > 1").select("comp")
        left = alone.join(some, "comp", "left_semi").select("node").unionByName(near.select(F.col("u").alias("node"))).unionByName(must).distinct()
        pool = cut(ids.join(left, "node", "left_semi"))
        release(chosen, met, apart, *before)
        if pool.isEmpty():
            release(rows, led, must, near)
            return classes.select("u", F.col("root").alias("v"))
        turn += 1


def _with_text(docs: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """Nodes with their texts. Up to BROADCAST_ROWS ids are broadcast, more are joined by a shuffle."""
    side = F.broadcast(nodes) if count <= BROADCAST_ROWS else nodes
    return docs.join(side, docs["doc_id"] == side["node"]).drop("doc_id")


def _by_ids(sets: DataFrame) -> DataFrame:
    """(u, v) of ids that have several contents with the ids that stood for these contents."""
    known = sets.filter("n > 0 and doc_id is not null").select("doc_id", "key")
    several = known.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low != high").select("doc_id")
    theirs = known.join(fitted(several), "doc_id").distinct()
    stand = sets.filter("tokens is not null").groupBy("key").agg(F.min("doc_id").alias("v"))
    return theirs.join(stand, "key").filter("doc_id != v").select(F.col("doc_id").alias("u"), "v")


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document, by links of at least ``percent`` Jaccard.

    The component is named by the smallest id that links reach. Texts without words are alone. Rows of one id
    (ids should be unique) are linked with each other through it; a row with a null id has no component
    beyond itself (null) and links nothing. An empty table gives an empty result, other columns are ignored.

    1. Every different set emits the beginning of its hashes, 30 % of them, or all where it has at most WHOLE.
       Document frequencies of these tokens order each beginning by rarity, and only the part that a partner must
       meet makes candidates; what no other set has drops out here.
    2. Sets that share such a token form candidate groups: pairs whose tokens have enough in common where at most
       LIGHT sets share it, else stars, then components. So no token makes more than LIGHT pairs a set.
    3. In each group a trie of the ordered sets finds all links; groups of more than GROUP sets or TOKENS tokens
       are joined in chunks with leaders until nothing is left to find.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = cut(_sets(own, words, percent))
    known = own.filter(F.col("doc_id").isNotNull())
    edges, weights = _candidates(sets, percent)
    coarse = connected(edges).withColumnRenamed("u", "node").withColumnRenamed("root", "comp")
    weighed = coarse.join(weights.groupBy("node").agg(F.max("weight").alias("weight"), F.sum("n").alias("n")), "node")
    parts = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / TOKENS)).cast("int").alias("chunks")
    nodes = cut(weighed.join(weighed.groupBy("comp").agg(parts), "comp").select("node", "comp", "chunks", "weight"))
    small, large = nodes.filter("chunks = 1"), nodes.filter("chunks > 1")
    links = cut(_join_small(_with_text(known, small.select("node", "comp"), small.count()), words, percent))
    if n := large.count():
        rows = _with_text(known, large.select("node", "comp", "weight", "chunks"), n)
        rows = rows.withColumn("content", F.sha2("text", 256)).dropDuplicates(["node", "content"]).drop("content")
        links = links.unionByName(_join_large(spark, rows, words, percent))
    links = links.unionByName(_by_ids(sets))
    classes = connected(links)
    # Documents of one content share the class of the one that stood for them, whatever its partition.
    contents = sets.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    stood = sets.filter("n > 0").join(classes, sets["doc_id"] == classes["u"]).select("key", "root").groupBy("key").agg(F.min("root").alias("root"))
    named = contents.join(stood, "key", "left").select("key", "least", F.coalesce("root", "least").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = named.join(firsts, "root").select("key", "component_id")
    out = sets.join(by_key, "key", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out
