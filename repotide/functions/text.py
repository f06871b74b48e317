"""Text, message and label functions; built-in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity aliases and ranks.
SEVERITY_ALIASES = {
    "critical": "critical", "crit": "critical",
    "error": "error", "err": "error", "high": "error",
    "warning": "warning", "warn": "warning", "medium": "warning",
    "info": "info", "low": "info",
}
SCAN_RANK = {"error": 0, "warning": 1, "info": 2}
LEVEL_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}

# Issue types that can be repaired without a person.
FIXABLE_TYPES = [
    "missing_jsdoc", "console_log", "todo_fixme", "magic_number", "hardcoded_string",
    "missing_error_handling", "event_naming", "export_missing", "unused_import", "deprecated_api",
]

# Keyword rules for issue types, first hit wins; inner lists are alternatives of
# keyword groups that must all occur.
ISSUE_TYPE_RULES = [
    ("missing_jsdoc", [["jsdoc"], ["documentation"]]),
    ("console_log", [["console.log"], ["console."]]),
    ("todo_fixme", [["todo"], ["fixme"]]),
    ("magic_number", [["magic number"], ["hardcoded"]]),
    ("event_naming", [["event", "naming"]]),
    ("export_missing", [["export"]]),
    ("unused_import", [["import", "unused"]]),
    ("missing_error_handling", [["error", "handling"]]),
    ("deprecated_api", [["deprecated"]]),
]

# Failure wording.
NAMED_ERRORS = ("TypeError|ReferenceError|SyntaxError|RangeError|URIError|EvalError|AggregateError"
                "|AssertionError")
ERROR_PATTERNS = {
    "import_failure": ["cannot find module", "cannot resolve", "failed to resolve import",
                       "err_module_not_found", "module not found", "cannot find package"],
    "mock_issue": ["jest.mock", "vi.mock", "mockimplementation", "is not a mock function",
                   "cannot spyon"],
    "env_missing_globals": ["window is not defined", "document is not defined",
                            "localstorage is not defined"],
    "timeout": ["exceeded timeout", "timeout", "timed out"],
}


def head_lines(col: Column, n: int = 100) -> Column:
    """First ``n`` lines, then a line telling how many were left out."""
    lines = F.split(col, "\n", -1)
    rest = F.size(lines) - n
    return F.when(rest > 0, F.concat(
        F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n... ("), rest.cast("string"),
        F.lit(" more lines)"))).otherwise(col)


def line_count(col: Column) -> Column:
    """Number of ``\\n``-separated pieces; a trailing newline counts one more."""
    return F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit(""))) + 1


def truncate(col: Column, n: int = 60) -> Column:
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n - 1), F.lit("…"))).otherwise(
        F.coalesce(col, F.lit("")))


def norm_severity(col: Column) -> Column:
    """Alias to critical / error / warning / info; null when unknown."""
    table = F.create_map(*[F.lit(x) for pair in SEVERITY_ALIASES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(col)))


def rank_of(col: Column, ranks: dict[str, int], other: int = 99) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col), F.lit(other))


def infer_issue_type(title: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    out = F.lit("unknown")
    for name, groups in reversed(ISSUE_TYPE_RULES):
        hit = F.lit(False)
        for words in groups:
            every = F.lit(True)
            for word in words:
                every = every & text.contains(word)
            hit = hit | every
        out = F.when(hit, name).otherwise(out)
    return out


def is_fixable(issue_type: Column, severity: Column) -> Column:
    return issue_type.isin(FIXABLE_TYPES) & (severity != "CRITICAL")


def _haystack(message: Column, stack: Column | None) -> Column:
    stack = F.lit("") if stack is None else F.coalesce(stack, F.lit(""))
    return F.concat(F.coalesce(message, F.lit("")), F.lit("\n"), stack)


def error_type(message: Column, stack: Column | None = None, variant: str = "report") -> Column:
    """Named error of a failure. ``report`` searches anywhere and knows assertion wording;
    ``plan`` only looks at the start of the message and falls back to ``Other``."""
    if variant == "plan":
        found = F.regexp_extract(
            F.coalesce(message, F.lit("")),
            r"^(TypeError|ReferenceError|AssertionError|Error|SyntaxError)", 1)
        return F.when(found == "", "Other").otherwise(found)
    text = _haystack(message, stack)
    named = F.regexp_extract(text, rf"\b({NAMED_ERRORS})\b", 1)
    asserted = text.rlike(r"(?i)\bexpect\(.+\)\.") | text.rlike(r"(?i)\btoBe\b|\btoEqual\b|\btoMatch\b")
    return (F.when(named != "", named).when(asserted, "AssertionError")
            .when(text.rlike(r"\bError\b"), "Error").otherwise("Unknown"))


def error_patterns(message: Column, stack: Column | None = None) -> Column:
    """Labels of a failure (several may apply), ``other`` when none does."""
    text = F.lower(_haystack(message, stack))
    tags = []
    for tag, phrases in ERROR_PATTERNS.items():
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | text.contains(phrase)
        if tag == "mock_issue":
            hit = hit | text.rlike(r"\bmock\b")
        tags.append(F.when(hit, tag))
    found = F.array_compact(F.array(*tags))
    return F.when(F.size(found) == 0, F.array(F.lit("other"))).otherwise(found)


def error_location(message: Column) -> Column:
    """Struct (file, line, column) of the first ``file:line[:column]`` in a message."""
    pattern = r"(?:at\s+)?([^\s:]+):(\d+)(?::(\d+))?"
    part = lambda i: F.regexp_extract(message, pattern, i)
    return F.struct(
        F.nullif(part(1), F.lit("")).alias("file"),
        F.nullif(part(2), F.lit("")).try_cast("int").alias("line"),
        F.nullif(part(3), F.lit("")).try_cast("int").alias("column"),
    )


def assertion(message: Column) -> Column:
    """Struct (expected, received, diff) of an assertion message, capped in length."""
    grab = lambda p: F.regexp_extract(message, p, 1)
    cap = lambda c, n: F.nullif(F.substring(c, 1, n), F.lit(""))
    return F.struct(
        cap(F.trim(grab(r"(?is)Expected[:\s]+(.+?)(?=\n|Received|$)")), 200).alias("expected"),
        cap(F.trim(grab(r"(?is)Received[:\s]+(.+?)(?=\n|$)")), 200).alias("received"),
        cap(grab(r"(?s)(-\s+.+\n\+\s+.+)"), 500).alias("diff"),
    )


def failure_class(code: Column, text: Column, variant: str = "exit") -> Column:
    """``transient``, ``permanent`` or ``other``.

    ``exit`` judges an exit code and stderr (only rate limits are transient, nothing is known to
    be permanent); ``message`` judges an error message.
    """
    text = F.coalesce(text, F.lit(""))
    if variant == "exit":
        limited = (
            (F.coalesce(code, F.lit(0)) == 429) | text.rlike(r"\b429\b")
            | text.rlike(r"(?i)rate limit|too many requests")
            | (text.rlike(r"\b400\b") & text.rlike(r"(?i)no available|account"))
        )
        return F.when(limited, "transient").otherwise("other")
    return (F.when(text.rlike(r"(?i)invalid.?api.?key|unauthorized|401|403|not.?found|404"), "permanent")
            .when(text.rlike(r"(?i)rate.?limit|too.?many.?requests|429|overloaded|capacity"), "transient")
            .otherwise("other"))


def _one_decimal(ms: Column, unit: int, suffix: str) -> Column:
    # Half-up at one decimal, without the locale or grouping of number formatting.
    tenths = F.floor(ms * 10 / unit + 0.5)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(suffix))


def duration_label(ms: Column) -> Column:
    return (F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
            .when(ms < 60000, _one_decimal(ms, 1000, "s"))
            .when(ms < 3600000, _one_decimal(ms, 60000, "min"))
            .otherwise(_one_decimal(ms, 3600000, "h")))


def estimate_label(label: Column) -> Column:
    """``2.0min`` to ``2 min``: space before the unit, ``.0`` dropped."""
    pattern = r"^([0-9.]+)(ms|s|min|h)$"
    text = F.trim(label)
    number = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\.0$", "")
    return F.when(text.rlike(pattern), F.concat(number, F.lit(" "), F.regexp_extract(text, pattern, 2))
                  ).otherwise(text)


def age_label(ms: Column) -> Column:
    sec = F.floor(ms / 1000)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(unit + " ago"))
    return (F.when(sec < 60, ago(sec, "s")).when(sec < 3600, ago(F.floor(sec / 60), "m"))
            .when(sec < 86400, ago(F.floor(sec / 3600), "h")).otherwise(ago(F.floor(sec / 86400), "d")))


def older_than(col: Column, interval: str, now: Column) -> Column:
    """True when the timestamp is more than ``interval`` before ``now`` (missing counts as old)."""
    return F.coalesce(col < now - F.expr(f"INTERVAL {interval}"), F.lit(True))


def percent(part: Column, whole: Column, decimals: int = 0) -> Column:
    """Rounded-half-up percentage; 0 for an empty whole. BIGINT without decimals, else DOUBLE."""
    k = 10 ** decimals
    value = F.floor(part * 100.0 * k / whole + 0.5)
    value = value if decimals == 0 else value / k
    zero = F.lit(0).cast("bigint") if decimals == 0 else F.lit(0.0)
    return F.when(whole > 0, value).otherwise(zero)


def round_half_up(col: Column, decimals: int = 0) -> Column:
    k = 10 ** decimals
    value = F.floor(col * k + 0.5)
    return value if decimals == 0 else value / k


def extract_json(col: Column, schema: str, marker: str = "severity", fenced: bool = False,
                 ok: Column | None = None) -> Column:
    """Struct (status, payload): the JSON object inside free text.

    ``status`` is ``error`` when ``ok`` is false, ``unclear`` without an object that names
    ``marker``, ``parse_error`` when it is not valid JSON, else ``ok``. ``fenced`` takes the first
    fenced block instead. ``schema`` is a DDL string.
    """
    if fenced:
        raw = F.trim(F.regexp_extract(col, r"(?s)```(?:json)?\s*\n(.*?)\n\s*```", 1))
    else:
        raw = F.regexp_extract(col, rf'(?s)(\{{.*"{marker}".*\}})', 1)
    valid = F.get_json_object(raw, "$").isNotNull() & F.from_json(
        raw, f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )["_bad"].isNull()
    good = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    status = (F.when(~good, "error").when(F.coalesce(raw, F.lit("")) == "", "unclear")
              .when(valid, "ok").otherwise("parse_error"))
    return F.struct(status.alias("status"),
                    F.when(good & valid, F.from_json(raw, schema)).alias("payload"))


def object_between_braces(col: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; null when there is none."""
    return F.nullif(F.regexp_extract(col, r"(?s)(\{.*\})", 1), F.lit(""))
