"""Best-fit packing of token sequences by linear grouping."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repotide.llm.common import numbered, rows_in
from repotide.llm.tokens import BYTE_BPE, batches, crc, encoder
from repotide.session import cut

CAPACITY = 1024
END_ID = 2
#: Lengths up to this share of the capacity are small and fill what the others leave.
SMALL = 1 / 4
#: Number of equal-cardinality groups that large lengths are rounded up in.
GROUPS = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, rank_from long, rank_to long, first_sequence long, offset long"


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, path: str = BYTE_BPE) -> DataFrame:
    """Ids of each text plus ``end_id``, cut into pieces of ``capacity`` where longer; the first may be shorter.

    A null text is empty and gives one piece of the end id alone.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for rows in parts:
            ids = rows.column("doc_id")
            for first, texts in batches(rows, "text"):
                out: list[list] = [[], [], [], [], []]
                for i, data in enumerate(encode(texts)):
                    data = memoryview(data + end)
                    n = len(data) // 4
                    begin, head = 0, n - (n - 1) // capacity * capacity
                    for piece, stop in enumerate(range(head, n + 1, capacity)):
                        row = (ids[first + i].as_py(), piece, begin, stop - begin, crc(data[4 * begin:4 * stop]))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        begin = stop
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


def _fill(sizes: np.ndarray, room: int) -> list[int]:
    """Indexes of sizes (repeats allowed) that fill ``room`` best: a reachability table over sums."""
    choice = np.full(room + 1, -1, np.int64)
    choice[0] = len(sizes)
    for r in range(1, room + 1):
        ok = np.flatnonzero(sizes <= r)
        if len(ok):
            hit = ok[choice[r - sizes[ok]] >= 0]
            if len(hit):
                choice[r] = hit[0]
    best = int(np.flatnonzero(choice >= 0)[-1])
    out = []
    while best > 0:
        out.append(int(choice[best]))
        best -= int(sizes[choice[best]])
    return out


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(number of sequences, indexes of sizes in each), largest size first; every step uses up a size."""
    sizes_, left, out = np.asarray(sizes), list(counts), []
    while any(left):
        live = [i for i, c in enumerate(left) if c]
        top = max(live, key=lambda i: sizes[i])
        inside = [top] + [live[j] for j in _fill(sizes_[live], capacity - sizes[top])]
        need = {i: inside.count(i) for i in inside}
        times = min(left[i] // k for i, k in need.items())
        if not times:  # too few of one size left: the largest that fit, one by one
            inside, room = [], capacity
            for i in sorted(live, key=lambda i: -sizes[i]):
                k = min(left[i], room // sizes[i])
                inside += [i] * k
                room -= k * sizes[i]
            need = {i: inside.count(i) for i in inside}
            times = min(left[i] // k for i, k in need.items())
        for i, k in need.items():
            left[i] -= k * times
        out.append((times, inside))
    return out


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS,
                 small: float = SMALL) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, rank_from, rank_to, first_sequence, offset).

    The piece of rank r in [rank_from, rank_to) of its length goes to sequence first_sequence + r - rank_from.
    Input and output depend on the number of different lengths (``capacity`` at most), not on the pieces.

    1. Lengths above ``small * capacity`` are sorted and cut into groups of equal cardinality, each
       rounded up to its longest member.
    2. Configurations over the few rounded sizes are chosen, each repeated as often as the counts allow.
    3. The actual lengths take the places of their group, longest first, in runs of equal sequences.
    4. Small lengths go, longest first, to the runs with the least room that still fits (best fit).
    """
    lengths = sorted((n for n in histogram if histogram[n] > 0), reverse=True)
    if any(n < 1 or n > capacity for n in lengths):
        raise ValueError("lengths must be from 1 to the capacity")
    large = [n for n in lengths if n > small * capacity]
    total = sum(histogram[n] for n in large)
    members: list[list[list[int]]] = []  # of each group: [length, count], longest first
    done = 0
    for n in large:
        count = histogram[n]
        while count:
            g = done * groups // max(total, 1)
            if g >= len(members) or not members:
                members.append([])
            stop = -(-(g + 1) * total // groups)  # the first position of the next group
            take = min(count, max(1, stop - done))
            members[-1].append([n, take])
            done += take
            count -= take
    sizes, counts = [m[0][0] for m in members], [sum(c for _, c in m) for m in members]
    runs: list[tuple[int, list[int]]] = []
    for times, inside in _configurations(sizes, counts, capacity):
        columns = []  # for each place in the sequence, its lengths in order
        for g in inside:
            need, column = times, []
            while need:
                n, have = members[g][0]
                take = min(need, have)
                column.append([n, take])
                need -= take
                members[g][0][1] -= take
                if not members[g][0][1]:
                    members[g].pop(0)
            columns.append(column)
        while columns[0]:
            step = min(c[0][1] for c in columns)
            runs.append((step, [c[0][0] for c in columns]))
            for c in columns:
                c[0][1] -= step
                if not c[0][1]:
                    c.pop(0)
    open_: list[tuple[int, int]] = sorted((capacity - sum(inside), i) for i, (_, inside) in enumerate(runs))
    for n in (x for x in lengths if x <= small * capacity):
        count = histogram[n]
        while count:
            at = bisect.bisect_left(open_, (n, -1))
            if at == len(open_):
                each = min(capacity // n, count)
                open_.append((capacity - each * n, len(runs)))
                runs.append((count // each, [n] * each))
                open_.sort()
                count -= count // each * each
                continue
            room, i = open_.pop(at)
            times, inside = runs[i]
            each = min(room // n, max(1, count // times))
            take = min(times, count // each)
            if take < times:
                runs[i] = (times - take, inside)
                bisect.insort(open_, (room, i))
                i = len(runs)
                runs.append((take, []))
            runs[i] = (take, inside + [n] * each)
            bisect.insort(open_, (room - each * n, i))
            count -= take * each
    plan, rank, sequence = [], dict.fromkeys(lengths, 0), 0
    for times, inside in runs:
        offset = 0
        for n in inside:
            plan.append((n, rank[n], rank[n] + times, sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    return plan


def pack_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, path: str = BYTE_BPE) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents longer
    than the capacity are cut. A null text is empty (its piece holds the end id alone), repeated rows are
    packed as often as they occur, an empty table gives an empty result, other columns are ignored.
    The driver sees counts by length alone; pieces get ranks inside their length in salted buckets.
    """
    pieces = cut(token_pieces(docs, id_col, text_col, capacity, end_id, path))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(plan_packing(histogram, capacity), PLAN)
    ranked = numbered(pieces, ["length"], ["doc_id", "piece"], "__rank", rows_in(pieces))
    # At most a few thousand runs, whatever the number of documents: it follows the number of lengths.
    p = F.broadcast(plan.withColumnRenamed("length", "__length"))
    hit = (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("rank_from")) & (F.col("__rank") < F.col("rank_to"))
    return ranked.join(p, hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("__rank") - F.col("rank_from")).alias("sequence_id"), "offset")
