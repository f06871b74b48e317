"""Code-entropy checks over source files; one pass over the texts for all checks, no per-line shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repotide.functions.globs import glob_match
from repotide.functions.paths import base_name, dir_name, stem
from repotide.functions.scanners import match_scanner
from repotide.session import REPO, cut

FILE = [REPO, "path"]

# Check id -> (name, risk).
CHECKS = {
    1: ("undocumented export", "medium"), 2: ("todo marker", "low"), 3: ("console residue", "medium"),
    4: ("swallowed error", "high"), 5: ("index export gap", "medium"), 6: ("unused export", "low"),
    7: ("async without try", "high"), 8: ("mutual import", "high"),
}

# The two forms of check 4.
_swallowed = match_scanner([("swallowed", r"(?a)catch\s*\([^)]*\)\s*\{\s*\}", "empty catch"),
                            ("swallowed", r"(?a)catch.*\{[^}]*throw\s+\w+\s*;?\s*\}", "bare rethrow")])


def _at(lines: Column, i: Column) -> Column:
    return F.coalesce(F.get(lines, i - 1), F.lit(""))


def _line_tests() -> dict:
    """Check -> (which files it looks at, whether 1-based line ``i`` of ``lines`` is a finding)."""
    content, path = F.col("content"), F.col("path")
    todo, console, start = "TODO|FIXME|HACK|XXX", r"console\.(log|warn|error|debug)", r"async function \w+\([^)]*\)\s*\{"
    doc = r"@param|@returns|@typedef"
    skipped = glob_match(path, ["cli/*", "**/examples/*"]) | base_name(path).rlike(r"^.*test.*\.js$")
    return {
        1: (F.lit(True), lambda ls, i: _at(ls, i).rlike(r"^export (async )?function \w+\(")
            & ~_at(ls, i - 1).rlike(doc) & ~_at(ls, i - 2).rlike(doc)),
        2: (content.rlike(todo), lambda ls, i: _at(ls, i).rlike(todo)),
        3: (content.rlike(console) & ~skipped, lambda ls, i: _at(ls, i).rlike(console)),
        7: (content.rlike(start), lambda ls, i: _at(ls, i).rlike(start)
            & ~F.exists(F.slice(ls, i, F.lit(11)), lambda s: s.rlike(r"try\s*\{"))),
    }


def _fact(check: int, kind: str, line: Column, detail: Column) -> Column:
    return F.struct(F.lit(check).alias("check_id"), F.lit(kind).alias("kind"), line.cast("int").alias("line"),
                    detail.cast("string").alias("detail"))


def _named(check: int, kind: str, names: Column) -> Column:
    return F.transform(names, lambda n: _fact(check, kind, F.lit(0), n))


def _hits(lines: Column, check: int, test) -> Column:
    hit = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: test(lines, i))
    return F.transform(hit, lambda i: _fact(check, "finding", i, F.lit("")))


def facts(files: DataFrame, checks=tuple(CHECKS)) -> DataFrame:
    """(check_id, kind, repo_id, path, line, detail): all that the checks need of a text, in one pass over the files.

    Kinds: ``finding``; for check 5 ``sibling`` (its module name), ``index`` and ``named`` (a module that an index
    names); for check 6 ``export`` and ``used`` symbols. A null text has none. Texts are split into lines once.
    """
    content, name = F.col("content"), base_name(F.col("path"))
    none = F.array().cast("array<struct<check_id:int,kind:string,line:int,detail:string>>")
    parts = []
    tests = {c: t for c, t in _line_tests().items() if c in checks}
    if tests:
        def of_lines(lines: Column) -> Column:
            return F.flatten(F.array(*[F.when(where, _hits(lines, c, test)).otherwise(none) for c, (where, test) in tests.items()]))

        parts.append(F.get(F.transform(F.array(F.split("content", "\n", -1)), of_lines), F.lit(0)))
    if 4 in checks:
        parts.append(F.transform(_swallowed(F.when(content.contains("catch"), content)),
                                 lambda m: _fact(4, "finding", m["line"], m["description"])))
    if 5 in checks:
        refs = F.regexp_extract_all(content, F.lit(r"""from[^\n]*['"]\./([^'"/]+)"""), F.lit(1))
        refs = F.transform(refs, lambda r: F.regexp_replace(r, r"\.js$", ""))
        parts += [F.when(name == "index.js", F.concat(F.array(_fact(5, "index", F.lit(0), F.lit(""))), _named(5, "named", F.array_distinct(refs)))
                         ).when(name.endswith(".js"), F.array(_fact(5, "sibling", F.lit(0), stem(F.col("path"))))).otherwise(none)]
    if 6 in checks:
        exported = F.regexp_extract_all(content, F.lit(r"(?m)^export (?:const|function|class) (\w+)"), F.lit(1))
        lines = F.filter(F.split("content", "\n"), lambda s: s.rlike(r"import|from"))
        # The words after the keyword, as the search for "import ... name" or "from ... name" sees them.
        words = F.flatten(F.transform(lines, lambda s: F.regexp_extract_all(
            F.regexp_extract(s, r"(?:import|from)(.*)", 1), F.lit(r"(\w+)"), F.lit(1))))
        parts += [_named(6, "export", F.array_distinct(exported)), _named(6, "used", F.array_distinct(words))]
    every = F.concat(*[F.coalesce(p, none) for p in parts])
    return files.select(*FILE, F.explode(every).alias("f")).select("f.check_id", "f.kind", *FILE, "f.line", "f.detail")


FINDING = ["check_id", REPO, "path", "line", "detail"]


def _findings(known: DataFrame, *checks: int) -> DataFrame:
    return known.filter((F.col("kind") == "finding") & F.col("check_id").isin(*checks)).select(*FINDING)


def _gaps(known: DataFrame) -> DataFrame:
    of = lambda kind: known.filter((F.col("check_id") == 5) & (F.col("kind") == kind)).withColumn(
        "_dir", dir_name(F.col("path")))
    gaps = of("sibling").join(of("index").select(REPO, "_dir").distinct(), [REPO, "_dir"], "left_semi")
    return gaps.join(of("named").select(REPO, "_dir", "detail").distinct(), [REPO, "_dir", "detail"], "left_anti").select(*FINDING)


def _unused(known: DataFrame) -> DataFrame:
    of = lambda kind: known.filter((F.col("check_id") == 6) & (F.col("kind") == kind))
    return of("export").join(of("used").select(REPO, "detail").distinct(), [REPO, "detail"], "left_anti").select(*FINDING)


def undocumented_exports(files: DataFrame) -> DataFrame:
    return _findings(facts(files, (1,)), 1)


def todo_markers(files: DataFrame) -> DataFrame:
    return _findings(facts(files, (2,)), 2)


def console_residue(files: DataFrame) -> DataFrame:
    return _findings(facts(files, (3,)), 3)


def swallowed_errors(files: DataFrame) -> DataFrame:
    """Empty catch blocks and catch blocks that only rethrow, one row per match with the line where it starts.

    Only texts that have the keyword go to the scanner.
    """
    return _findings(facts(files, (4,)), 4)


def index_gaps(files: DataFrame) -> DataFrame:
    """Siblings of an index file that it does not name; compared by whole module name."""
    return _gaps(facts(files, (5,)))


def unused_exports(files: DataFrame) -> DataFrame:
    """Exported names that no import or re-export line of the repository mentions."""
    return _unused(facts(files, (6,)))


def async_without_try(files: DataFrame) -> DataFrame:
    return _findings(facts(files, (7,)), 7)


def mutual_imports(edges: DataFrame) -> DataFrame:
    """Pairs of files that import each other, each pair once."""
    back = edges.select(REPO, F.col("src").alias("dst"), F.col("dst").alias("src"))
    return edges.filter(F.col("src") < F.col("dst")).join(back, [REPO, "src", "dst"], "left_semi").distinct()


def entropy_scan(files: DataFrame, edges: DataFrame | None = None, checks=tuple(CHECKS)) -> DataFrame:
    """Findings (check_id, repo_id, path, line, detail) of the chosen checks.

    The texts are read once, whatever the number of checks. Checks 5 and 6 meet their facts several times, so
    with them the facts, which are small beside the texts, are written to a table first.
    """
    of_text = [c for c in checks if c in CHECKS and c != 8]
    parts = []
    if of_text:
        known = facts(files, of_text)
        known = cut(known) if {5, 6} & set(of_text) else known
        parts.append(_findings(known, *of_text))
        parts += [job(known) for c, job in ((5, _gaps), (6, _unused)) if c in of_text]
    if 8 in checks and edges is not None:
        parts.append(mutual_imports(edges).select(
            F.lit(8).alias("check_id"), REPO, F.col("src").cast("string").alias("path"), F.lit(0).alias("line"),
            F.col("dst").cast("string").alias("detail")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def entropy_report(findings: DataFrame) -> DataFrame:
    """Findings per check with its risk, checks without findings included, and the grand total."""
    label = lambda i: F.create_map(*[x for k, v in CHECKS.items() for x in (F.lit(k), F.lit(v[i]))])
    spark = findings.sparkSession
    every = spark.createDataFrame([(k,) for k in CHECKS], "check_id int")
    counts = findings.groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))
    rows = every.join(counts, "check_id", "left").select("check_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    total = rows.rollup("check_id").agg(F.sum("n").alias("findings"))
    c = F.col("check_id")
    return total.select(F.coalesce(c, F.lit(0)).alias("check_id"),
                        F.coalesce(F.try_element_at(label(0), c), F.lit("TOTAL")).alias("check_name"),
                        F.try_element_at(label(1), c).alias("risk"), "findings")
