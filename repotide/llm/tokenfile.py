"""Token ids of a corpus as files of independently coded blocks."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from repotide.llm.coder import BLOCK, decode_blocks, encode_blocks
from repotide.llm.common import fitted, rows_in
from repotide.llm.tokens import BYTE_BPE, batches, encoder
from repotide.session import checkpoint_dir, cut

END_ID = 0
#: Documents per file (about), and blocks that are coded side by side.
FILE_ROWS, ABREAST = 7000, 2560
#: A record: first id of the block in its file, first document in its file, documents in the block; then for
#: each of them its doc_id (least value: null) and its ids in this block; a checksum of all that; the coded block.
RECORD = struct.Struct("<QQI")
NULL_ID = -(2**63)

STORED = "part int, block long, record binary"
PIECES = "part int, first long, doc long, doc_id long, begin long, n long, crc long"


def _record(first: int, doc: int, ids: list[int], counts: list[int], coded: bytes) -> bytes:
    head = RECORD.pack(first, doc, len(ids)) + np.array(ids, "<i8").tobytes() + np.array(counts, "<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + coded


def _open(record: bytes) -> tuple[int, int, np.ndarray, np.ndarray, bytes]:
    first, doc, n = RECORD.unpack_from(record)
    size = RECORD.size + 12 * n
    if struct.unpack_from("<I", record, size)[0] != zlib.crc32(record[:size]):
        raise ValueError("damaged record")
    return (first, doc, np.frombuffer(record, "<i8", n, RECORD.size), np.frombuffer(record, "<u4", n, RECORD.size + 8 * n), record[size + 4:])


class _Writer:
    """Cuts a stream of documents into blocks and codes many of them together."""

    def __init__(self, part: int):
        self.part, self.written = part, 0
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.docs: list[tuple[int, int]] = []  # (doc_id, ids) still to be covered by blocks
        self.first = self.doc = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: list[int]) -> None:
        """Documents whose ids follow each other, so many of each."""
        self.ids.append(ids)
        self.held += len(ids)
        self.docs += zip((NULL_ID if d is None else d for d in doc_ids), counts, strict=True)

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Rows for every ABREAST blocks held; with ``last`` for the rest too."""
        while self.held >= ABREAST * BLOCK or last and self.held:
            yield self._code()

    def _code(self) -> pa.RecordBatch:
        stream, self.ids = np.concatenate(self.ids), []
        use = min(len(stream), ABREAST * BLOCK)
        cut = [stream[i:min(i + BLOCK, use)] for i in range(0, use, BLOCK)]
        coded = encode_blocks(cut)
        records, at = [], 0
        for ids, data in zip(cut, coded, strict=True):
            need, names, counts, doc = len(ids), [], [], self.doc
            while need:
                name, left = self.docs[at]
                take = min(need, left)
                names.append(name)
                counts.append(take)
                need -= take
                if take == left:
                    at, self.doc = at + 1, self.doc + 1
                else:
                    self.docs[at] = (name, left - take)
            records.append(_record(self.first, doc, names, counts, data))
            self.first += len(ids)
        self.docs = self.docs[at:]
        self.ids, self.held = [stream[use:].copy()], len(stream) - use
        n = len(records)
        self.written += n
        return pa.RecordBatch.from_arrays(
            [pa.array([self.part] * n, pa.int32()), pa.array(range(self.written - n, self.written), pa.int64()), pa.array(records, pa.binary())],
            names=["part", "block", "record"])


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, path: str = BYTE_BPE) -> str:
    """Write the ids of all documents in ascending id order; the folder.

    Ranges of ids become files (``part``), whose records are blocks of BLOCK ids. Null ids come first, rows of
    one id go by a hash of the text and the text, a null text is empty and holds the end id alone. The files are written by Spark's
    committer, so a lost executor leaves nothing behind.
    """
    folder = folder or f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(TaskContext.get().partitionId())
        encode = encoder(path).encode_flat
        for rows in parts:
            doc_ids = rows.column("doc_id").to_pylist()
            for first, texts in batches(rows, "text"):
                ids, ends = encode(texts)
                writer.add(doc_ids[first:first + len(texts)], np.insert(ids, ends, end_id), (np.diff(ends, prepend=0) + 1).tolist())
                yield from writer.flush(False)
        yield from writer.flush(True)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    files = max(1, rows_in(docs) // FILE_ROWS)
    # Ranges are sampled to the driver, so their keys hold no text.
    ranges = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    laid = own.repartitionByRange(files, *ranges).sortWithinPartitions(*ranges, F.col("text").asc_nulls_first())
    laid.mapInArrow(run, STORED).write.parquet(folder)
    return folder


def _pieces(stored: DataFrame) -> DataFrame:
    """(part, first, doc, doc_id, begin, n, crc) for every document in every block: place of the piece in
    its file, ordinal of the document in it, checksum of the piece."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for start in range(0, rows.num_rows, ABREAST):
                some = rows.slice(start, ABREAST)
                opened = [_open(r.as_py()) for r in some.column("record")]
                out: list[list] = [[] for _ in range(7)]
                for part, (first, doc, ids, counts, _), block in zip(
                        some.column("part").to_pylist(), opened, decode_blocks([o[-1] for o in opened]), strict=True):
                    data, at = memoryview(block.astype("<u4").tobytes()), 0
                    for k, (doc_id, n) in enumerate(zip(ids.tolist(), counts.tolist(), strict=True)):
                        row = (part, first, doc + k, None if doc_id == NULL_ID else doc_id, first + at, n,
                               zlib.crc32(data[4 * at:4 * (at + n)]))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        at += n
                kinds = [pa.int32(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                    names=["part", "first", "doc", "doc_id", "begin", "n", "crc"])

    return stored.select("part", "record").mapInArrow(run, PIECES)


def _zeros_matrix() -> list[list[int]]:
    """Rows r: the linear map that appends 2**r zero bytes to a crc32, as 32 columns."""
    one = [0xEDB88320, *[1 << i for i in range(31)]]

    def apply(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    maps = [one]
    for _ in range(66):
        last = maps[-1]
        maps.append([apply(last, c) for c in last])
    return maps[3:]


_ZEROS = _zeros_matrix()


def join_crc(left: int, right: int, size: int) -> int:
    """crc32 of two byte strings in a row from theirs; ``size``: bytes of the right one."""
    bit = 0
    while size:
        if size & 1:
            out, v, i = 0, left, 0
            while v:
                if v & 1:
                    out ^= _ZEROS[bit][i]
                v >>= 1
                i += 1
            left = out
        size >>= 1
        bit += 1
    return left ^ right


@F.pandas_udf(LongType())
def _joined(pieces):  # noqa: ANN001, ANN202
    """crc of a document from (begin, n, crc) of its pieces in order."""
    def one(rows) -> int:  # noqa: ANN001
        value = 0
        for r in rows:
            value = join_crc(value, int(r["crc"]), 4 * int(r["n"]))
        return value

    return pieces.map(one)


def read_token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``folder``.

    Blocks are decoded on their own and checked; a document that spans blocks is put together from the
    checksums of its pieces. ``start`` counts the ids of all files before (a sum per file) and in the file.
    """
    pieces = cut(_pieces(spark.read.schema(STORED).parquet(folder)))
    docs = pieces.groupBy("part", "doc").agg(
        F.max("doc_id").alias("doc_id"), F.min("begin").alias("begin"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("begin", "n", "crc"))).alias("pieces"))
    sizes = pieces.groupBy("part").agg(F.sum("n").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    shifts = fitted(shifts)  # one row per file
    out = docs.join(shifts, docs["part"] == shifts["p"])
    crc = F.when(F.size("pieces") == 1, F.get("pieces.crc", F.lit(0))).otherwise(_joined("pieces"))
    return out.select("doc_id", (F.col("shift") + F.col("begin")).cast("long").alias("start"), F.col("n_tokens").cast("long"), crc.cast("long").alias("ids_crc32"))
