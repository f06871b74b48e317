"""Path functions; every one is a built-in column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names never descended into, code file extensions.
IGNORED_DIRS = [
    "node_modules", ".git", "dist", "build", ".next", "__pycache__", "venv", ".venv", "target",
    "vendor", ".cache", "coverage", ".turbo", ".nuxt", ".output", "out",
]
CODE_EXTENSIONS = [
    ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".kt", ".rb", ".php",
    ".c", ".cpp", ".h", ".hpp", ".cs", ".swift", ".vue", ".svelte",
]
DOC_EXTENSIONS = [".md"]


def base_name(col: Column) -> Column:
    return F.regexp_extract(col, r"([^/]*)$", 1)


def dir_name(col: Column) -> Column:
    return F.when(F.instr(col, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(col, r"/[^/]*$", ""))


def extension(col: Column) -> Column:
    return F.lower(F.regexp_extract(col, r"(\.[^./]+)$", 1))


def stem(col: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(col), r"(?<=.)\.[^.]*$", "")


def _segments(col: Column) -> Column:
    return F.filter(F.split(col, "/"), lambda s: (s != "") & (s != "."))


def norm_path(col: Column) -> Column:
    """Forward slashes, ``.`` and ``..`` resolved, no leading ``./`` or trailing ``/``; empty is ``.``."""
    posix = F.replace(col, F.lit("\\"), F.lit("/"))
    rooted = posix.startswith("/")
    folded = F.aggregate(
        _segments(posix),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s)))
        .when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
              F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(rooted, acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))
    return F.when(joined.isin("", "/"), F.lit(".")).otherwise(joined)


def join_path(base: Column, rel: Column) -> Column:
    return norm_path(F.concat(base, F.lit("/"), rel))


def to_graph_key(col: Column, root: str) -> Column:
    """Project path to graph-root-relative path."""
    if root in ("", "."):
        return col
    prefix = root.rstrip("/") + "/"
    return F.when(col.startswith(prefix), F.substr(col, F.lit(len(prefix) + 1))).otherwise(col)


def to_project_path(col: Column, root: str) -> Column:
    if root in ("", "."):
        return col
    return F.when(col == ".", F.lit(root)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), col))


def path_depth(col: Column) -> Column:
    return F.size(F.filter(F.split(col, "/"), lambda s: s != ""))


def ancestors(col: Column, include_self: bool = False) -> Column:
    """Directory prefixes, nearest first, ending with ``.``."""
    parts = _segments(col)
    longest = F.size(parts) - (0 if include_self else 1)
    prefixes = F.transform(
        F.sequence(F.greatest(longest, F.lit(1)), F.lit(1), F.lit(-1)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )
    none = F.array().cast("array<string>")
    return F.concat(F.when(longest >= 1, prefixes).otherwise(none), F.array(F.lit(".")))


def file_kind(col: Column) -> Column:
    """``test``, ``code``, ``doc`` or ``other``."""
    name, ext = base_name(col), extension(col)
    code = ext.isin(CODE_EXTENSIONS)
    marked = name.contains(".test.") | name.contains(".spec.")
    return (F.when(code & marked, "test").when(code, "code")
            .when(ext.isin(DOC_EXTENSIONS), "doc").otherwise("other"))


def is_source(col: Column) -> Column:
    return file_kind(col) == "code"


def test_type(col: Column) -> Column:
    return (F.when(col.contains(".e2e.") | col.contains("/e2e/"), "e2e")
            .when(col.contains(".int.") | col.contains("/integration/"), "integration")
            .otherwise("unit"))


def not_excluded(col: Column, names=IGNORED_DIRS) -> Column:
    """No directory segment of the path is ignored or hidden."""
    dirs = F.split(dir_name(col), "/")
    ignored = F.array(*[F.lit(n) for n in names])
    return ~F.arrays_overlap(dirs, ignored) & ~F.exists(
        dirs, lambda s: s.startswith(".") & (s != ".") & (s != ".."))


def in_scope(col: Column, scope: str) -> Column:
    scope = scope.rstrip("/")
    if scope in ("", "."):
        return F.lit(True)
    return (col == scope) | col.startswith(scope + "/")


def module_type(col: Column) -> Column:
    """Kind of a module directory by its path."""
    return (
        F.when(col.rlike(r"^src/(modules|features)/[^/]+$"), "feature")
        .when(col.rlike(r"^src/components/[^/]+$"), "component")
        .when(col.rlike(r"^src/(services|api)/[^/]+$"), "service")
        .when(col.rlike(r"^src/(utils|lib|helpers)$"), "utility")
        .when(col.rlike(r"^packages/[^/]+$"), "package")
        .when(col.rlike(r"^apps/[^/]+$"), "app")
    )


def module_of(col: Column, rule: str = "first", scope: str = ".") -> Column:
    """Module of a file path.

    ``first``: first segment, ``.`` for top-level files. ``root``: same with ``(root)``.
    ``two``: first two segments of a directory. ``layered``: three segments under ``js/agents``,
    two under ``js``, else one. ``scope``: the segment below ``scope``. ``change``: fallback of
    ``group_changes``.
    """
    parts = F.split(col, "/")
    head = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    nested = F.size(parts) > 1
    if rule == "first":
        return F.when(nested, head(1)).otherwise(".")
    if rule == "root":
        return F.when(nested & (head(1) != ""), head(1)).otherwise("(root)")
    if rule == "two":
        return head(2)
    if rule == "layered":
        return (F.when(col.startswith("js/agents/"), head(3)).when(col.startswith("js/"), head(2))
                .otherwise(head(1)))
    if rule == "change":
        mirrored = F.split(F.concat(F.lit("js/"), F.substr(col, F.lit(12))), "/")
        return (F.when(col.startswith("tests/unit/"), F.array_join(F.slice(mirrored, 1, 3), "/"))
                .when(col.startswith("tests/integration/"), "tests/integration")
                .when(col.startswith("js/"), head(3))
                .otherwise("other"))
    if rule == "scope":
        scope = scope.rstrip("/")
        if scope in ("", "."):
            return module_of(col, "first")
        rest = F.substr(col, F.lit(len(scope) + 2))
        return (F.when(~col.startswith(scope + "/"), scope).when(F.instr(rest, "/") == 0, scope)
                .otherwise(F.concat(F.lit(scope + "/"), F.substring_index(rest, "/", 1))))
    raise ValueError(f"unknown module rule {rule!r}")


def package_of(col: Column) -> Column:
    """``src/modules/x``, ``src/features/x`` or ``packages/x`` prefix of a changed path, else null."""
    hit = F.regexp_extract(col, r"^(src/(?:modules|features)/[^/]+|packages/[^/]+)", 1)
    return F.nullif(hit, F.lit(""))


_TEST_LAYOUTS = {  # layout -> (test root, suffix)
    "mirrored": ("tests", ".test.js"),
    "unit": ("tests/unit", ".test.js"),
    "integration": ("tests/integration", ".test.js"),
    "e2e": ("tests/e2e", ".e2e.test.js"),
}


def _under(root: str, directory: Column, name: Column) -> Column:
    return F.when(directory == ".", F.concat(F.lit(root + "/"), name)).otherwise(
        F.concat(F.lit(root + "/"), directory, F.lit("/"), name))


def expected_test_path(col: Column, layout: str = "unit", src_root: str = "js",
                       naming: str = "{name}.test.js", test_root: str = "tests/unit") -> Column:
    """Where the test of a source file belongs. ``layout='naming'`` uses ``naming`` and ``test_root``."""
    prefix = src_root.rstrip("/") + "/"
    rel = F.when(col.startswith(prefix), F.substr(col, F.lit(len(prefix) + 1))).otherwise(col)
    if layout == "naming":
        before, after = naming.split("{name}", 1)
        ext = F.regexp_replace(extension(col), r"^\.", "")
        name = F.concat(F.lit(before), stem(rel), F.replace(F.lit(after), F.lit("{ext}"), ext))
        return _under(test_root, dir_name(rel), name)
    root, suffix = _TEST_LAYOUTS[layout]
    return _under(root, dir_name(rel), F.concat(stem(rel), F.lit(suffix)))


def expected_source_path(col: Column, src_root: str = "js", layout: str = "mirrored") -> Column:
    """Where the source of a test file belongs.

    ``mirrored`` strips ``tests/``; ``typed`` strips ``tests/unit/`` or ``tests/integration/``.
    """
    strip = r"^tests/" if layout == "mirrored" else r"^tests/(unit|integration)/"
    rel = F.regexp_replace(F.regexp_replace(col, strip, ""), r"\.(test|spec)\.(js|ts|mjs)$", ".js")
    return F.concat(F.lit(src_root.rstrip("/") + "/"), rel)
