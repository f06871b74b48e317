"""Secret scans with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repotide.session import checkpoint_dir

FINDINGS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
SCANNED = f"blob string, findings {FINDINGS}"


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that do not overlap; those with fewer than ``least`` characters in
    ``group`` are dropped after matching. What is found reaches over the group ``span``. A text without any of
    ``needles`` (in lower case) has no match."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = 0
    base: bool = False
    needles: tuple[str, ...] = ()
    span: int = 0


# The base rules and their order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2,
         re.IGNORECASE | re.ASCII, True, ("password", "passwd", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, 0, True, ("akia",)),
    # Runs are maximal, so the least length may stand in the pattern.
    Rule("hex", r"[0-9a-f]{16,}", 16, 0, 0, True),
)

# Further kinds of credential: public formats with fixed marks.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", needles=("-----begin",)),
    # Tried once for each run of its letters, from the first mark in the run on: later marks leave less before the dot.
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)",
         needles=("eyj",), span=1),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}", needles=("bearer ",)),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{6,64}@", needles=("://",)),
)

RULES = BASE_RULES + MORE_RULES
#: Name of the rule set; change it with the rules, and every blob is scanned anew under the new name.
RULES_VERSION = "1"


def scan_text(text: str, rules: Sequence[Rule] = RULES) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of one text, by start and then by the order of the rules; code points."""
    lower, found = text.lower(), []
    for order, rule in enumerate(rules):
        if rule.needles and not any(n in lower for n in rule.needles):
            continue
        for m in re.compile(rule.pattern, rule.flags).finditer(text):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(rule.span), order, m.end(rule.span), rule))
    return [(rule.kind, start, end, rule.base) for start, _, end, rule in sorted(found, key=lambda x: x[:2])]


def versions(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, content): every historical version of every path with the address of its content.

    Several rows of one path are its versions. A null text is the empty blob.
    """
    content = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(path_col).alias("path"), F.sha2(content, 256).alias("blob"), content.alias("content"))


class BlobLedger:
    """(rule_version, blob) -> findings, as a Parquet table in a shared folder, one subfolder a batch.

    A batch is written by Spark's committer, so one that fails leaves nothing to read and the next run
    scans its blobs again. Blobs without findings are entered too: they were seen. With the path of an
    earlier ledger its committed batches (those with a ``_SUCCESS`` file) are read; new ones get names of
    their own, so what a failed one left is in nobody's way.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{checkpoint_dir(spark)}/blob-ledger-{uuid.uuid4().hex}"
        self.batches: list[str] = self._committed() if path else []

    def _committed(self) -> list[str]:
        """Folders of the batches that an earlier ledger at this path finished, in the order of their names."""
        jvm, context = self.spark._jvm, self.spark.sparkContext
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/_SUCCESS")
        found = pattern.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(s.getPath().getParent().toString() for s in found or [])

    def entries(self, rule_version: str) -> DataFrame:
        """Blobs seen under a rule version, with their findings."""
        if not self.batches:
            return self.spark.createDataFrame([], SCANNED)
        found = self.spark.read.schema(f"rule_version string, {SCANNED}").parquet(*self.batches)
        found = found.filter(F.col("rule_version") == rule_version).select("blob", "findings")
        # Runs at the same time may each have entered a blob.
        return found.dropDuplicates(["blob"]) if len(self.batches) > 1 else found

    def scan(self, history: DataFrame, rules: Sequence[Rule] = RULES, rule_version: str = RULES_VERSION) -> str:
        """Scan the blobs of ``history`` that this rule version has not seen; the folder of the new batch.

        Copies of a blob are dropped before the shuffle and again after it, so a blob with a third of all
        rows is scanned once and gathers nowhere.
        """
        blobs = history.select("blob", "content")
        if self.batches:
            blobs = blobs.join(self.entries(rule_version).select("blob"), "blob", "left_anti")

        def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            for rows in parts:
                found = [[dict(zip(("kind", "start", "end", "base"), f, strict=True)) for f in scan_text(t.as_py(), rules)]
                         for t in rows.column("content")]
                yield pa.RecordBatch.from_arrays([rows.column("blob"), pa.array(found, kind)], names=["blob", "findings"])

        scanned = blobs.dropDuplicates(["blob"]).mapInArrow(scan, SCANNED)
        batch = f"{self.path}/batch={len(self.batches):06d}-{uuid.uuid4().hex}"
        scanned.select(F.lit(rule_version).alias("rule_version"), "blob", "findings").write.parquet(batch)
        self.batches.append(batch)
        return batch

    def findings(self, history: DataFrame, rule_version: str = RULES_VERSION) -> DataFrame:
        """(path, blob, findings) for every version, joined back from the ledger.

        Blobs without findings are not joined, so the right side is as small as the findings are rare.
        """
        hits = self.entries(rule_version).filter(F.size("findings") > 0)
        return history.select("path", "blob").join(hits, "blob", "left").select(
            "path", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def scan_secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 ledger: BlobLedger | None = None, rules: Sequence[Rule] = RULES,
                 rule_version: str = RULES_VERSION) -> DataFrame:
    """Secrets in every whole text: doc_id, blob, findings (kind, start, end, base; by start, code points).

    One row per input row. Null and empty texts have no findings, repeated rows and copies share one scan,
    a null id keeps its row, an empty table gives an empty result, other columns are ignored. With a ledger
    of an earlier run only unseen (blob, rule version) pairs are scanned.
    """
    ledger = ledger or BlobLedger(spark)
    history = versions(docs, id_col, text_col)
    ledger.scan(history, rules, rule_version)
    return ledger.findings(history, rule_version).withColumnRenamed("path", "doc_id")


def redact_text(text: str, spans: Sequence[tuple[int, int]]) -> str:
    """``text`` with a mark for each of ``spans`` (by start; code points), in one pass; one that starts in another joins it."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += text[at:start], "[REDACTED]"
        at = max(at, end)
    return "".join([*out, text[at:]])


@F.arrow_udf(T.StringType())
def _redacted(texts: pa.Array, findings: pa.Array) -> pa.Array:
    return pa.array([None if t is None else redact_text(t, sorted((f["start"], f["end"]) for f in found or []))
                     for t, found in zip(texts.to_pylist(), findings.to_pylist(), strict=True)], pa.string())


def redact(text: F.Column, findings: F.Column) -> F.Column:
    """``text`` with every found span replaced by ``[REDACTED]``; spans that overlap become one.

    A text without findings (or with null ones) stays as it is and is not sent to Python.
    """
    hit = F.coalesce(F.size(findings), F.lit(0)) > 0
    return F.when(hit, _redacted(F.when(hit, text), F.when(hit, findings))).otherwise(text)
