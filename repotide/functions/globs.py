"""Glob dialects as JVM regular expressions (one regex per pattern list)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STARS = re.compile(r"(\*\*/|\*\*|\*)")
_META = re.compile(r"([\\^$*+?.()|{}\[\]])")


def _literal(text: str) -> str:
    return _META.sub(r"\\\1", text)


def _anchored(pattern: str) -> str:
    wild = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}
    return "".join(wild.get(tok, _literal(tok)) for tok in _STARS.split(pattern) if tok)


def _simple(pattern: str) -> str:
    # Only "." is literal here. "**" means one character followed by any run
    # without "/", which is what existing policies written for it rely on.
    wild = {"**/": ".[^/]*/", "**": ".[^/]*", "*": "[^/]*"}
    return "".join(wild.get(tok, tok.replace(".", r"\.")) for tok in _STARS.split(pattern) if tok)


def _full(pattern: str) -> str:
    wild = {"**/": ".*/", "**": ".*", "*": "[^/]*"}
    return "".join(wild.get(tok, tok.replace(".", r"\.")) for tok in _STARS.split(pattern) if tok)


def _clean(pattern: str) -> str:
    return re.sub(r"/+$", "", re.sub(r"^/+", "", re.sub(r"^\./+", "", pattern.replace("\\", "/"))))


def glob_regex(patterns: Iterable[str], dialect: str = "anchored") -> str:
    """The alternation that ``glob_match`` tests, for the two prefix dialects."""
    source = {"anchored": _anchored, "simple": _simple}[dialect]
    return "^(?:" + "|".join(source(p) for p in patterns) + ")(?:/|$)"


def anchored_source(pattern: Column) -> Column:
    """The alternative of one ``anchored`` pattern, as ``_anchored`` builds it, for columns of patterns.

    Stars are taken two by two from the left, so a run before ``/`` ends in ``**/`` if its length is even.
    """
    out = F.regexp_replace(pattern, r"[\\^$+?.()|{}\[\]]", r"\\$0")
    out = F.regexp_replace(out, r"(?<!\*)((?:\*\*)*)\*\*/", "$1\u0001")
    out = F.regexp_replace(F.regexp_replace(out, r"\*\*", "\u0002"), r"\*", "[^/]\u0003")
    return F.replace(F.replace(F.replace(out, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*")), F.lit("\u0003"), F.lit("*"))


def glob_match(col: Column, patterns: Iterable[str], dialect: str = "anchored") -> Column:
    """True where the path matches any pattern.

    ``anchored``  ``*`` stays inside a segment, ``**`` crosses, ``**/`` may be empty; a match may
    end at a ``/`` boundary. ``simple``: see ``_simple``; same boundary rule. ``full``: whole
    string; patterns without ``/`` test the base name and ``dir/**`` also matches ``dir``.
    """
    patterns = [p for p in patterns if p]
    if not patterns:
        return F.lit(False)
    if dialect != "full":
        return col.rlike(glob_regex(patterns, dialect))
    cleaned = [c for c in (_clean(p) for p in patterns) if c]
    on_path = [_full(c) for c in cleaned if "/" in c]
    on_path += [_literal(c[:-3]) + "(?:/.*)?" for c in cleaned if c.endswith("/**")]
    on_name = [_full(c) for c in cleaned if "/" not in c]
    tests = []
    if on_path:
        tests.append(col.rlike("^(?:" + "|".join(on_path) + ")$"))
    if on_name:
        tests.append(F.regexp_extract(col, r"([^/]*)$", 1).rlike("^(?:" + "|".join(on_name) + ")$"))
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def include_scope(col: Column, include: Iterable[str]) -> tuple[Column, Column]:
    """(can_enter, should_count) of a directory under an include list."""
    include = [p for p in include if p]
    if not include:
        return F.lit(True), F.lit(True)
    counted = glob_match(col, include, "simple")
    parent = F.lit(False)
    for pattern in include:
        parent = parent | F.lit(pattern).startswith(F.concat(col, F.lit("/")))
    return counted | parent, counted


def test_policy(include: list[str], ignore: list[str], src_dirs=("js", "src"), test_dirs=("tests",),
                unit_dir="tests/unit", integration_dir="tests/integration") -> tuple[list[str], list[str]]:
    """Rewrite a source policy for test files: source prefixes become test prefixes."""
    targets = [unit_dir, integration_dir, *test_dirs]
    rewritten = [
        f"{target}/{pattern[len(src) + 1:]}"
        for pattern in include for src in src_dirs if pattern.startswith(src + "/")
        for target in targets
    ]
    kept = [p for p in ignore
            if not p.startswith(("tests/", "test/")) and "*.test." not in p and "*.spec." not in p]
    return rewritten or list(include), kept
