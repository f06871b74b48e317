"""Audit documents (markdown) to issue rows; three layouts, JVM string functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repotide.functions.text import infer_issue_type, is_fixable, norm_severity
from repotide.session import REPO

DOC = [REPO, "module_path"]
_FIXED = r"(?i)\[FIXED\]"


def _field(block: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(block, field_pattern(name), 1))


# Where issues start, their headings, and code in them.
ISSUE_START, ISSUE_HEADING = r"(?=###\s*\[)", r"###\s*\[(LOW|MEDIUM|HIGH|CRITICAL)\]\s*(.+)"
SNIPPET = r"(?s)(```.*?```)"


def field_pattern(name: str) -> str:
    """Pattern of a ``**Name**: value`` line; group 1 is the value."""
    return rf"\*\*{name}\*\*:\s*([^\n]+)"


def parse_bracket_issues(docs: DataFrame) -> DataFrame:
    """Issues under ``### [SEVERITY] title`` headings with file, line, texts, type, fixable flag."""
    heading = ISSUE_HEADING
    blocks = F.filter(F.split("content", ISSUE_START), lambda b: b.startswith("###") & b.rlike(heading))
    b = F.col("block")
    rows = docs.select(*DOC, F.posexplode(blocks).alias("seq", "block"))
    place = _field(b, "File")
    title, description = F.trim(F.regexp_extract(b, heading, 2)), _field(b, "Description")
    rows = rows.select(
        *DOC, F.col("seq").cast("bigint").alias("seq"), F.regexp_extract(b, heading, 1).alias("severity"),
        title.alias("title"), F.trim(F.split_part(place, F.lit(":"), F.lit(1))).alias("file"),
        F.coalesce(F.nullif(F.regexp_extract(F.split_part(place, F.lit(":"), F.lit(2)), r"^\s*(\d+)", 1), F.lit("")
                            ).try_cast("int"), F.lit(0)).alias("line"),
        description.alias("description"), _field(b, "Suggestion").alias("suggestion"),
        F.regexp_extract(b, SNIPPET, 1).alias("snippet"))
    return rows.withColumn("type", infer_issue_type(F.col("title"), F.col("description"))).withColumn(
        "fixable", is_fixable(F.col("type"), F.col("severity")))


def detect_severity(text: Column) -> Column:
    """Severity named in a text: a bracket tag, a ``Severity:`` field or a ``##`` heading."""
    grab = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    levels = "critical|error|warning|info|high|medium|low"
    tag, field = grab(rf"(?i)\[({levels})\]"), grab(r"(?i)Severity:\s*(?:\*\*)?(\w+)(?:\*\*)?")
    head = grab(rf"(?im)^##\s+({levels})\b")
    return norm_severity(F.coalesce(tag, field, head))


def file_severity(content: Column) -> Column:
    grab = lambda p: F.nullif(F.regexp_extract(content, p, 1), F.lit(""))
    return norm_severity(F.coalesce(grab(r"(?i)Severity:\s*\*\*(\w+)\*\*"), grab(r"(?i)##\s*Severity:\s*(\w+)"),
                                    grab(r"(?i)Severity:\s*(\w+)")))


def _heading_blocks(text: Column) -> Column:
    pieces = F.split(text, r"(?m)^### ")
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))


def parse_audit(docs: DataFrame) -> DataFrame:
    """Issues of any layout: (module_path, seq, title, body, severity, fixed).

    Headings below ``## Issues`` come first; documents without them are read as checklists, and the
    rest by any ``###`` heading.
    """
    section = F.regexp_extract("content", r"(?is)((?:^|(?<=\n))##\s+Issues\b.*)", 1)
    check = r"(?m)^[^\S\n]*-[^\S\n]*\[[ xX]\][^\S\n]*\S|^[^\S\n]*-[^\S\n]+[^\n]*\[(?i:FIXED)\]"
    found = docs.select(*DOC, "content", file_severity(F.col("content")).alias("_file_severity"),
                        _heading_blocks(section).alias("_section"))
    listed = (F.size("_section") == 0) & F.col("content").rlike(check)
    blocks = F.when(F.size("_section") > 0, F.col("_section")).otherwise(_heading_blocks(F.col("content")))
    headed = found.filter(~listed).select(*DOC, "_file_severity", F.posexplode(blocks).alias("seq", "block"))
    header = F.trim(F.substring_index("block", "\n", 1))
    body = F.btrim(F.regexp_extract("block", r"(?s)^[^\n]*\n(.*)$", 1), F.lit(" \n\t"))
    title = F.trim(F.regexp_replace(F.regexp_replace(header, r"^\d+\.\s*", ""), _FIXED + r"\s*", ""))
    by_heading = headed.select(
        *DOC, F.col("seq").cast("bigint").alias("seq"), title.alias("title"), body.alias("body"),
        F.coalesce(detect_severity(F.concat(header, F.lit("\n"), body)), F.col("_file_severity"), F.lit("info")
                   ).alias("severity"),
        (header.rlike(_FIXED) | body.rlike(_FIXED) | body.rlike(r"(?m)^\s*-\s*\[[xX]\]\s+")).alias("fixed"))
    return by_heading.unionByName(_checklist(found.filter(listed)))


def _checklist(found: DataFrame) -> DataFrame:
    line = found.select(*DOC, "_file_severity", F.posexplode(F.split("content", "\n", -1)).alias("seq", "line"))
    level = F.nullif(F.regexp_extract("line", r"^##\s+([A-Za-z]+)\b", 1), F.lit(""))
    box, bullet = r"^\s*-\s*\[([ xX])\]\s*(.+)$", r"^\s*-\s+(.+)$"
    kept = line.withColumn("_level", norm_severity(level)).filter(
        F.col("_level").isNotNull() | F.col("line").rlike(box)
        | (F.col("line").rlike(bullet) & F.col("line").rlike(_FIXED)))
    # One document per window: the nearest heading above sets the severity.
    above = Window.partitionBy(*DOC).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("_current", F.coalesce(
        F.last("_level", ignorenulls=True).over(above), "_file_severity", F.lit("info")))
    boxed = F.col("line").rlike(box)
    rest = F.trim(F.when(boxed, F.regexp_extract("line", box, 2)).otherwise(F.regexp_extract("line", bullet, 1)))
    return kept.filter(F.col("_level").isNull()).select(
        *DOC, F.col("seq").cast("bigint").alias("seq"),
        F.trim(F.regexp_replace(rest, _FIXED + r"\s*", "")).alias("title"), F.lit("").alias("body"),
        F.coalesce(detect_severity(rest), "_current").alias("severity"),
        (rest.rlike(_FIXED) | (boxed & (F.lower(F.regexp_extract("line", box, 1)) == "x"))).alias("fixed"))


def audit_header(docs: DataFrame) -> DataFrame:
    """Declared severity and issue count; a bulleted issue section without a count is counted."""
    grab = lambda p: F.nullif(F.regexp_extract("content", p, 1), F.lit(""))
    severity = F.lower(F.coalesce(grab(r"(?i)Severity:\s*\*\*(\w+)\*\*"), grab(r"(?i)##\s*Severity:\s*(\w+)"),
                                  F.lit("unknown")))
    section = F.regexp_extract("content", r"(?s)\n## Issues[^\n(]*\n(.*)", 1)
    count = F.coalesce(grab(r"## Issues \((\d+)\)").try_cast("bigint"),
                       F.regexp_count(section, F.lit(r"(?m)^- \*\*")).cast("bigint"))
    return docs.select(*DOC, severity.alias("severity"), count.alias("issue_count"))


def archive_issues(issues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(archived, kept renumbered from 1, documents with their new severity).

    ``issues`` is the output of ``parse_audit``; a document without open issues becomes ``NONE``.
    """
    archived = issues.filter("fixed")
    order = Window.partitionBy(*DOC).orderBy("seq")  # the issues of one document
    kept = issues.filter(~F.col("fixed")).withColumn("number", F.row_number().over(order).cast("bigint"))
    docs = issues.groupBy(*DOC).agg(
        F.count_if("fixed").alias("archived"), F.count_if(~F.col("fixed")).alias("kept"),
        F.when(F.count_if(~F.col("fixed")) == 0, "NONE").alias("new_severity"))
    return archived, kept, docs
