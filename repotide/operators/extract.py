"""Texts to rows: imports, exports, rule hits, test smells, dependencies, acceptance items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repotide.functions.paths import dir_name, join_path
from repotide.functions.scanners import SMELLS, match_scanner, strip_comments, test_block_array
from repotide.functions.text import SCAN_RANK, percent, rank_of
from repotide.session import REPO

FILE = [REPO, "path"]

# Import forms; group 1 is the module specifier.
IMPORT_FORMS = [
    r"""\bimport\s+(?:type\s+)?[\w*\s{},$]+\sfrom\s*['"]([^'"]+)['"]""",
    r"""\bimport\s*['"]([^'"]+)['"]\s*;?""",
    r"""\bimport\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    r"""\bexport\s*\{[\s\S]*?\}\s*from\s*['"]([^'"]+)['"]""",
    r"""\bexport\s*\*\s*from\s*['"]([^'"]+)['"]""",
    r"""\bexport\s*\*\s*as\s*[\w$]+\s*from\s*['"]([^'"]+)['"]""",
]
REQUIRE_FORM = r"""\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)"""
# Patterns of assertions, documented declarations and task dependencies.
ASSERTION = r"expect\s*\(|assert\.|should\."
DECLARATION_KINDS = r"(?:function|const|let|var|class|async\s+function)"
DEPENDENCY = r"(?i)(?:blocked\s+by|depends\s+on|after|requires)[:\s]+\[([a-zA-Z0-9]+)\]"
PYTHON_IMPORTS = [r"(?m)^\s*from\s+([\w.]+)\s+import", r"(?m)^\s*import\s+([\w.]+)"]


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def without_comments(files: DataFrame, column: str = "content") -> DataFrame:
    return files.withColumn(column, strip_comments(F.col(column)))


def extract_imports(files: DataFrame, language: str = "javascript", require: bool = False) -> DataFrame:
    """(path, spec), distinct per file. ``files.content`` should have its comments stripped."""
    text = F.col("content")
    forms = PYTHON_IMPORTS if language == "python" else IMPORT_FORMS + ([REQUIRE_FORM] if require else [])
    specs = F.concat(*[_all(text, p) for p in forms])
    trimmed = F.filter(F.array_distinct(F.transform(specs, lambda s: F.trim(s))), lambda s: s != "")
    return files.select(*FILE, F.explode(trimmed).alias("spec"))


def _listed(text: Column) -> Column:
    """Exported names of the items of ``{ a, b as c }`` lists."""
    items = F.transform(F.split(text, ","), lambda s: F.trim(s))
    names = F.transform(items, lambda s: F.when(
        s.rlike(r"^[\w$]+\s+as\s+[\w$]+$"), F.regexp_extract(s, r"([\w$]+)$", 1)
    ).when(s.rlike(r"^[\w$]+$"), s).otherwise(""))
    return F.filter(names, lambda s: s != "")


def extract_exports(files: DataFrame, language: str = "javascript", variant: str = "full") -> DataFrame:
    """(path, symbol), distinct per file; ``*`` marks a star re-export.

    ``variant='names'`` reads only the first name of a declaration and skips star forms.
    """
    text = F.col("content")
    none = F.array().cast("array<string>")
    if language == "python":
        symbols = _all(text, r"(?m)^(def|class)\s+(\w+)", 2)
    else:
        default = F.when(text.rlike(r"\bexport\s+default\b"), F.array(F.lit("default"))).otherwise(none)
        lists = F.flatten(F.transform(_all(text, r"\bexport\s*\{([^}]+)\}"), _listed))
        if variant == "names":
            symbols = F.concat(
                _all(text, r"export\s+(function|const|let|var|class|async\s+function)\s+(\w+)", 2), lists, default)
        else:
            declared = F.flatten(F.transform(
                _all(text, r"\bexport\s+(?:const|let|var)\s+([^;]+);?"),
                lambda d: F.regexp_extract_all(
                    d, F.lit(r"(?:^|,)\s*([A-Za-z_$][\w$]*)\s*(?==|,|\z)"), F.lit(1))))
            star = F.when(text.rlike(r"""\bexport\s*\*\s*from\s*['"][^'"]+['"]"""), F.array(F.lit("*"))).otherwise(none)
            symbols = F.concat(
                default, _all(text, r"\bexport\s+(?:async\s+)?function\s+([\w$]+)\b"),
                _all(text, r"\bexport\s+class\s+([\w$]+)\b"), declared, lists,
                _all(text, r"""\bexport\s*\*\s*as\s*([\w$]+)\s*from\s*['"][^'"]+['"]"""), star)
    return files.select(*FILE, F.explode(F.array_distinct(symbols)).alias("symbol"))


def extract_test_imports(tests: DataFrame) -> DataFrame:
    """(path, symbol, from_path) for relative named and default imports; the original name of aliases."""
    text = F.col("content")
    named = r"""import\s*\{([^}]+)\}\s*from\s*['"]([^'"]+)['"]"""
    default = r"""import\s+(\w+)\s+from\s*['"]([^'"]+)['"]"""
    pairs = F.concat(*[F.arrays_zip(_all(text, p, 1).alias("symbols"), _all(text, p, 2).alias("from_path"))
                       for p in (named, default)])
    rows = tests.select(*FILE, F.explode(pairs).alias("i")).filter(F.col("i.from_path").startswith("."))
    symbol = F.explode(F.filter(F.transform(F.split("i.symbols", ","), lambda s: F.trim(s)), lambda s: s != ""))
    rows = rows.select(*FILE, F.col("i.from_path").alias("from_path"), symbol.alias("symbol"))
    return rows.withColumn("symbol", F.when(
        F.col("symbol").rlike(r"\w+\s+as\s+\w+"), F.regexp_extract("symbol", r"(\w+)\s+as\s+\w+", 1)
    ).otherwise(F.col("symbol"))).distinct()


def with_js(path: Column) -> Column:
    """``.js`` appended when the last segment has no extension."""
    return F.when(path.rlike(r"[^/]\.[^/]*$"), path).otherwise(F.concat(path, F.lit(".js")))


def reexport_map(index_files: DataFrame) -> DataFrame:
    """(index_path, symbol, source_path) of index files; star re-exports keep the symbol ``*``."""
    text = F.col("content")
    named = r"""export\s*\{([^}]+)\}\s*from\s*['"]([^'"]+)['"]"""
    star = r"""export\s*\*\s*from\s*['"]([^'"]+)['"]"""
    pairs = F.concat(
        F.arrays_zip(_all(text, named, 1).alias("symbols"), _all(text, named, 2).alias("from_path")),
        F.transform(_all(text, star), lambda p: F.struct(F.lit("*").alias("symbols"), p.alias("from_path"))))
    rows = index_files.select(*FILE, F.posexplode(pairs).alias("pos", "e"))
    rows = rows.select(
        REPO, F.col("path").alias("index_path"), "pos",
        with_js(join_path(dir_name(F.col("path")), F.col("e.from_path"))).alias("source_path"),
        F.explode(F.filter(F.transform(F.split("e.symbols", ","), lambda s: F.trim(s)), lambda s: s != "")).alias("symbol"))
    symbol = F.when(F.col("symbol").rlike(r"\w+\s+as\s+\w+"), F.regexp_extract("symbol", r"\w+\s+as\s+(\w+)", 1)
                    ).otherwise(F.col("symbol"))
    rows = rows.withColumn("symbol", symbol)
    stars = rows.filter(F.col("symbol") == "*").select(REPO, "index_path", "symbol", "source_path").distinct()
    last = rows.filter(F.col("symbol") != "*").groupBy(REPO, "index_path", "symbol").agg(
        F.max_by("source_path", "pos").alias("source_path"))
    return last.unionByName(stars)


@dataclass(frozen=True)
class Rule:
    """One line rule. ``pattern`` is a Java regular expression; ``language`` empty means any."""

    id: str
    pattern: str
    severity: str
    message: str
    language: str = ""


_SECRET = r"""(?i)(password|secret|api_key|apikey)\s*[=:]\s*['"][^'"]+['"]"""
_MARKER = r"\b(TODO|FIXME|HACK|XXX)\b"
# Rule packs.
PACK_SCAN = [
    Rule("no-eval", r"\beval\s*\(", "error", "Avoid eval() - security risk", "javascript"),
    Rule("no-console", r"\bconsole\.(log|debug|info)\s*\(", "warning", "Remove console statements in production",
         "javascript"),
    Rule("no-debugger", r"\bdebugger\b", "error", "Remove debugger statements", "javascript"),
    Rule("no-alert", r"\balert\s*\(", "warning", "Avoid alert() in production", "javascript"),
    Rule("no-var", r"\bvar\s+\w", "info", "Use const/let instead of var", "javascript"),
    Rule("todo-fixme", _MARKER, "info", "Unresolved TODO/FIXME", "javascript"),
    Rule("no-secret", _SECRET, "error", "Possible hardcoded secret", "javascript"),
    Rule("no-any", r":\s*any\b", "warning", "Avoid using any type", "typescript"),
    Rule("no-ts-ignore", r"@ts-ignore", "warning", "Avoid @ts-ignore", "typescript"),
    Rule("no-eval", r"\beval\s*\(", "error", "Avoid eval() - security risk", "python"),
    Rule("no-exec", r"\bexec\s*\(", "error", "Avoid exec() - security risk", "python"),
    Rule("no-print", r"\bprint\s*\(", "info", "Consider using logging instead of print", "python"),
    Rule("todo-fixme", _MARKER, "info", "Unresolved TODO/FIXME", "python"),
]
PACK_MODULE = [
    Rule("security-eval", r"\beval\s*\(", "high", "eval() usage"),
    Rule("quality-console", r"\bconsole\.(log|debug)\s*\(", "low", "console statement"),
    Rule("quality-debugger", r"\bdebugger\b", "medium", "debugger statement"),
    Rule("security-secret", r"""(?i)(password|secret|api_key)\s*[=:]\s*['"][^'"]+['"]""", "high", "Hardcoded secret"),
    Rule("todo", r"TODO|FIXME|HACK|XXX", "info", "TODO comment"),
]
RULES_TOGETHER = 100  # rules whose matches are found in one array expression


def rules_from(table: DataFrame) -> list[Rule]:
    """A rule table (id, pattern, severity, message, language) as a pack. Packs are written by people, so
    the driver holds them; their patterns become constants of the plan."""
    rows = table.collect()
    return [Rule(r.id, r.pattern, r.severity, r.message, r.language or "") for r in rows]


def rules_for(pack: list[Rule], language: str) -> list[Rule]:
    """Rules of a language; TypeScript adds its own to the JavaScript ones, unknown means JavaScript."""
    own = [r for r in pack if r.language in ("", language)]
    base = [r for r in pack if r.language == "javascript"]
    if language == "typescript":
        return base + own
    return own or base


def rule_scan(files: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """Every (line, rule) match: path, line, rule, severity, message, 80-character snippet.

    Lines are split first and tested one by one, so anchors mean the line. The patterns are constants
    of the projection (compiled once, no join), in arrays of ``RULES_TOGETHER``.
    """
    rules = rules_from(rules) if isinstance(rules, DataFrame) else list(rules)
    line = files.select(*FILE, F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    text = F.col("text")
    none = F.array().cast("array<struct<rule:string,severity:string,message:string>>")
    hits = F.concat(none, *[F.array_compact(F.array(*[
        F.when(text.rlike(r.pattern), F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"),
                                               F.lit(r.message).alias("message"))) for r in rules[i:i + RULES_TOGETHER]]))
        for i in range(0, len(rules), RULES_TOGETHER)])
    return line.select(*FILE, (F.col("at") + 1).alias("line"), F.substring(F.trim(text), 1, 80).alias("snippet"),
                       F.explode(hits).alias("hit")).select(
        *FILE, "line", "hit.rule", "hit.severity", "hit.message", "snippet")


def min_severity(df: DataFrame, severity: str = "warning") -> DataFrame:
    """Findings at least as severe as ``severity``; an unknown name means ``warning``."""
    return df.filter(rank_of(F.col("severity"), SCAN_RANK) <= SCAN_RANK.get(severity, 1))


def smell_scan(tests: DataFrame, patterns=SMELLS) -> DataFrame:
    """Every match of the smell patterns over the whole file, with the line it starts on."""
    scan = match_scanner(list(patterns))
    return tests.select(*FILE, F.explode(scan(F.col("content"))).alias("s")).select(*FILE, "s.*")


def test_blocks(tests: DataFrame) -> DataFrame:
    """(path, name, line, body, pseudo, empty) for each test block."""
    rows = tests.select(*FILE, F.explode(test_block_array(F.col("content"))).alias("b")).select(*FILE, "b.*")
    body = F.col("body")
    return rows.withColumns({
        "pseudo": ~body.rlike(ASSERTION),
        "empty": F.length(F.btrim(body, F.lit(" \n\t\r"))) < 10})


def parse_task_deps(tasks: DataFrame, column: str = "description") -> DataFrame:
    """(project_id, task_id, dep) named in task texts, distinct."""
    return tasks.select("project_id", "task_id", F.explode(F.array_distinct(_all(F.col(column), DEPENDENCY))).alias("dep"))


def doc_comment_coverage(files: DataFrame) -> DataFrame:
    """Per file: exported names, those declared right after a doc comment, rounded share (100 if none)."""
    text = F.col("content")
    after = F.when(F.instr(text, "/**") > 0, F.substr(text, F.instr(text, "/**") + 3)).otherwise("")
    documented = _all(after, rf"\*/\s*(?:export\s+)?{DECLARATION_KINDS}\s+(\w+)")
    names = extract_exports(files, variant="names").groupBy(*FILE).agg(
        F.collect_set("symbol").alias("_names"))  # the names of one file
    rows = files.select(*FILE, documented.alias("_documented")).join(names, FILE, "left")
    total = F.when(F.col("_names").isNull(), 0).otherwise(F.size("_names"))
    hit = F.when(F.col("_names").isNull(), 0).otherwise(F.size(F.array_intersect("_names", "_documented")))
    return rows.select(*FILE, total.cast("bigint").alias("exports"), hit.cast("bigint").alias("documented"),
                       F.when(total == 0, F.lit(100).cast("bigint")).otherwise(percent(hit, total)).alias("coverage"))


def acceptance_items(tasks: DataFrame, column: str = "description") -> DataFrame:
    """(project_id, task_id, pos, item, done) below the acceptance heading of a task."""
    section = F.regexp_extract(
        column, r"(?ms)^## (?:验收标准|Acceptance Criteria)[^\n]*\n(.*?)(?=^## |\z)", 1)
    item = r"^\s*- \[([ x])\] (.+)$"
    lines = F.filter(F.split(section, "\n"), lambda s: s.rlike(item))
    rows = tasks.select("project_id", "task_id", F.posexplode(lines).alias("pos", "line"))
    return rows.select("project_id", "task_id", "pos", F.regexp_extract("line", item, 2).alias("item"),
                       (F.regexp_extract("line", item, 1) == "x").alias("done"))


def acceptance_share(items: DataFrame) -> DataFrame:
    return items.groupBy("project_id", "task_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if("done").alias("done"),
        percent(F.count_if("done"), F.count(F.lit(1))).alias("share_done"))
