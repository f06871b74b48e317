"""The few scanners that need state across characters: Arrow-batched, one text per row."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MATCHES = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("line", T.IntegerType()),
    T.StructField("description", T.StringType()), T.StructField("context", T.StringType())]))
_BLOCKS = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("body", T.StringType())]))

_TOKEN = re.compile(
    r"'(?:\\[\s\S]|[^'\\])*(?:'|\\?\Z)" r'|"(?:\\[\s\S]|[^"\\])*(?:"|\\?\Z)' r"|`(?:\\[\s\S]|[^`\\])*(?:`|\\?\Z)"
    r"|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)")
_NOT_NEWLINE = re.compile(r"[^\n]")


def _blank(match: re.Match) -> str:
    token = match.group()
    if token.startswith("//"):
        return " " * (len(token) - 1)
    if token.startswith("/*"):
        closed = len(token) >= 4 and token.endswith("*/")
        inner = token[2:-2] if closed else token[2:]
        return " " + _NOT_NEWLINE.sub(" ", inner) + (" " if closed else "")
    return token


@F.pandas_udf(T.StringType())
def strip_comments(texts: pd.Series) -> pd.Series:
    """Comments become blanks (newlines stay); string and template literals are kept."""
    return texts.map(lambda t: None if t is None else _TOKEN.sub(_blank, t))


# Test smell patterns by type.
SMELLS = [
    ("weak", r"expect\s*\(\s*true\s*\)\s*\.toBe\s*\(\s*true\s*\)", "expect(true).toBe(true)"),
    ("weak", r"expect\s*\(\s*false\s*\)\s*\.toBe\s*\(\s*false\s*\)", "expect(false).toBe(false)"),
    ("weak", r"expect\s*\([^)]+\)\s*\.toMatchObject\s*\(\s*\{\s*\}\s*\)", "toMatchObject({})"),
    ("weak", r"expect\s*\([^)]+\)\s*\.toBeDefined\s*\(\s*\)", "toBeDefined()"),
    ("weak", r"expect\s*\([^)]+\)\s*\.toBeTruthy\s*\(\s*\)", "toBeTruthy()"),
    ("weak", r"expect\s*\(\s*\d+\s*\)\s*\.toBeGreaterThan\s*\(\s*0\s*\)", "constant assertion"),
    ("skipped", r"(?:test|it|describe)\.skip\s*\(", "skipped"),
    ("skipped", r"(?:test|it|describe)\.todo\s*\(", "todo"),
    ("skipped", r"x(?:test|it|describe)\s*\(", "x prefix"),
    ("commented", r"//\s*(?:test|it|describe)\s*\(", "commented out"),
    ("commented", r"/\*[\s\S]*?(?:test|it|describe)\s*\([\s\S]*?\*/", "block commented out"),
    ("flaky", r"setTimeout\s*\([^,]+,\s*\d+\s*\)", "setTimeout"),
    ("flaky", r"Date\.now\s*\(\s*\)", "Date.now()"),
    ("flaky", r"Math\.random\s*\(\s*\)", "Math.random()"),
    ("flaky", r"new Date\s*\(\s*\)", "new Date()"),
]


def _newlines(text: str) -> list[int]:
    return [m.start() for m in re.finditer("\n", text)]


def match_scanner(patterns: list[tuple[str, str, str]]):
    """Column function: every match of every pattern with the line where it starts."""
    compiled = [(kind, re.compile(p), desc) for kind, p, desc in patterns]

    @F.pandas_udf(_MATCHES)
    def scan(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return []
            ends = _newlines(text)
            return [{"type": kind, "line": bisect_left(ends, m.start()) + 1, "description": desc, "context": m.group()}
                    for kind, rx, desc in compiled for m in rx.finditer(text)]
        return texts.map(one)

    return scan


# Fixed value: heading of a test block.
_BLOCK = re.compile(r"""(?:test|it)\s*\(\s*['"`]([^'"`]+)['"`]\s*,\s*(?:async\s*)?\([^)]*\)\s*=>\s*\{""")
_BRACE = re.compile(r"[{}]")


def find_test_blocks(text: str | None) -> list[dict]:
    """Name, line and body of each test block; the body ends at the matching brace or the text's end."""
    text = text or ""
    blocks, ends, closes, open_ = [], _newlines(text), {}, []
    heads = {m.end(): m for m in _BLOCK.finditer(text)}
    # One pass over all braces: ``open_`` holds where the bodies and braces still open began. A body
    # begins where its heading ends, and a brace after that belongs to what opened last.
    marks = sorted([(at, 0) for at in heads] + [(b.start(), 1 if b.group() == "{" else 2) for b in _BRACE.finditer(text)])
    for at, kind in marks:
        if kind == 0:
            open_.append(at)
        elif kind == 1:
            if at + 1 not in heads:  # the brace of a heading opens its body, once
                open_.append(None)
        elif open_:
            body = open_.pop()
            if body is not None:
                closes[body] = at + 1
    for at, m in heads.items():
        stop = closes.get(at, len(text))
        blocks.append({"name": m.group(1), "line": bisect_left(ends, m.start()) + 1, "body": text[m.end():stop - 1]})
    return blocks


@F.pandas_udf(_BLOCKS)
def test_block_array(texts: pd.Series) -> pd.Series:
    return texts.map(find_test_blocks)
