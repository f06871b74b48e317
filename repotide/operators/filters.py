"""Row filters and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repotide.functions.globs import anchored_source, glob_match
from repotide.session import REPO

FAILED_STATES = ["failed", "timeout", "cancelled"]


def apply_path_policy(df: DataFrame, include=(), ignore=(), path: str = "path", dialect: str = "anchored") -> DataFrame:
    """Keep paths that match an include pattern (if there are any) and no ignore pattern."""
    keep = F.lit(True) if not list(include) else glob_match(F.col(path), include, dialect)
    if list(ignore):
        keep = keep & ~glob_match(F.col(path), ignore, dialect)
    return df.filter(keep)


def _pattern_keys(policies: DataFrame) -> DataFrame:
    """(repo, kind, where, key, how, text): the key by which each pattern meets the paths, and what is left to test.

    ``prefix`` keys are paths or directories from the root, ``segment`` keys names anywhere, ``suffix`` keys endings
    of names from a dot on, ``any`` meets every path. ``how``: ``whole`` holds as it is, ``inside`` below the key
    only, ``run`` where the segments of ``text`` follow each other, ``regex`` by the pattern ``text``.
    """
    p = F.col("pattern")
    plain = lambda c: ~c.contains("*")
    body = F.regexp_replace(p, r"/\*\*?$", "")  # "dir/*" and "dir/**" are everything below dir
    below = body != p
    rest, inner = F.substr(p, F.lit(4)), F.substr(body, F.lit(4))
    deep = p.startswith("**/")
    ending = F.regexp_extract(p, r"^\*\*/\*(\.[^*/]*)$", 1)
    head = F.regexp_extract(p, r"^([^*]*)/[^/]*\*", 1)
    row = lambda where, key, how, text=F.lit(""): F.struct(
        F.lit(where).alias("where"), key.alias("key"), F.lit(how).alias("how"), text.alias("text"))
    first = lambda c: F.substring_index(c, "/", 1)
    found = (F.when(plain(p), row("prefix", p, "whole"))
             .when(below & plain(body), row("prefix", body, "inside"))
             .when(deep & plain(rest), row("segment", first(rest), "run", F.concat(F.lit("/"), rest, F.lit("/"))))
             .when(deep & below & (F.length(body) > 3) & plain(inner), row("segment", first(inner), "below", F.concat(F.lit("/"), inner, F.lit("/"))))
             .when(ending != "", row("suffix", ending, "whole"))
             .when(p.rlike(r"^[^*]*/[^/]*\*"), row("prefix", head, "regex", F.concat(F.lit("^(?:"), anchored_source(p), F.lit(")(?:/|$)"))))
             .otherwise(row("any", F.lit(""), "regex", F.concat(F.lit("^(?:"), anchored_source(p), F.lit(")(?:/|$)")))))
    return policies.select(REPO, "kind", found.alias("f")).select(REPO, "kind", "f.*").distinct()


def _path_keys(path: Column) -> Column:
    """(where, key, last) of a path: its ancestors and itself, its segments, their endings from a dot on."""
    parts = F.split(path, "/", -1)
    row = lambda where, key, last=F.lit(False): F.struct(F.lit(where).alias("where"), key.alias("key"), last.alias("last"))
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: row("prefix", F.array_join(F.slice(parts, 1, i), "/"), i == F.size(parts)))
    names = F.transform(F.array_distinct(parts), lambda s: row("segment", s))
    dotted = F.filter(F.array_distinct(parts), lambda s: s.contains("."))
    bits = lambda s: F.split(s, "\\.", -1)
    ends = F.flatten(F.transform(dotted, lambda s: F.transform(
        F.sequence(F.lit(2), F.size(bits(s))), lambda i: F.concat(F.lit("."), F.array_join(F.slice(bits(s), i, F.size(bits(s))), ".")))))
    return F.concat(upto, names, F.transform(F.array_distinct(ends), lambda e: row("suffix", e)), F.array(row("any", F.lit(""))))


def apply_repo_policies(df: DataFrame, policies: DataFrame, path: str = "path") -> DataFrame:
    """Per-repository policies from rows (repo_id, kind include/ignore, pattern).

    Patterns and paths meet by equal keys (ancestor, segment, ending), so a path finds its patterns
    without trying the others, and a large repository is spread over its keys. Only patterns with other wildcards
    are regular expressions; they meet the paths below their literal directory, sorted by pattern, so that each
    is compiled once a task. Repositories without a policy keep all paths, others drop null paths.
    """
    rules = policies.filter("pattern IS NOT NULL AND kind IN ('include', 'ignore')")
    keys = _pattern_keys(rules)
    met = df.filter(F.col(path).isNotNull()).select(REPO, F.col(path).alias("_path"), F.explode(_path_keys(F.col(path))).alias("k")).select(REPO, "_path", "k.*")
    slashed = F.concat(F.lit("/"), "_path")
    found = met.join(keys, [REPO, "where", "key"]).filter("NOT (last AND how IN ('inside', 'regex'))").sortWithinPartitions("text").filter(
        F.when(F.col("how") == "regex", F.expr("_path RLIKE text"))
        .when(F.col("how") == "run", F.concat(slashed, F.lit("/")).contains(F.col("text")))
        .when(F.col("how") == "below", slashed.contains(F.col("text"))).otherwise(True))
    side = lambda kind: F.max(F.col("kind") == kind)
    hits = found.groupBy(REPO, "_path").agg(side("include").alias("_in"), side("ignore").alias("_out"))
    ruled = rules.groupBy(REPO).agg(side("include").alias("_needs"))
    joined = df.join(ruled, REPO, "left").join(hits.withColumnRenamed("_path", path), [REPO, path], "left")
    keep = F.col(path).isNotNull() & (~F.col("_needs") | F.coalesce("_in", F.lit(False))) & ~F.coalesce("_out", F.lit(False))
    return joined.filter(F.col("_needs").isNull() | keep).select(*df.columns)


def filter_status(df: DataFrame, *statuses: str) -> DataFrame:
    return df.filter(F.col("status").isin(*statuses))


def filter_issues(df: DataFrame, severity: str | None = None, module: str | None = None) -> DataFrame:
    """Exact severity and case-insensitive module substring."""
    if severity:
        df = df.filter(F.col("severity") == severity)
    if module:
        df = df.filter(F.lower("module").contains(module.lower()))
    return df


def errors_for(errors: DataFrame, text: str) -> DataFrame:
    """Errors whose test or source file contains the text, ignoring case."""
    needle = text.lower()
    return errors.filter(F.lower("test_path").contains(needle)
                         | F.coalesce(F.lower("source_path").contains(needle), F.lit(False)))


def error_by_id(errors: DataFrame, error_id: int) -> DataFrame:
    return errors.filter(F.col("id") == error_id)


def board_list(tasks: DataFrame, status: str | None = None, priority: int | None = None) -> DataFrame:
    if status is not None:
        tasks = tasks.filter(F.col("status") == status)
    if priority is not None:
        tasks = tasks.filter(F.col("priority") == priority)
    return tasks.orderBy("priority", "task_id")


def due_on(tasks: DataFrame, day: str, column: str = "due_date") -> DataFrame:
    return tasks.filter(F.to_date(column) == F.to_date(F.lit(day)))


FULL_ID_LENGTH = 16


def resolve_prefix(tasks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each id prefix with its single task id, or ``missing`` / ``ambiguous``.

    Equi-join on the prefixes of every id, of the lengths that were asked for; from ``FULL_ID_LENGTH``
    characters on the whole id must be equal.
    """
    lengths = F.array_sort(F.collect_set(F.length("prefix")))  # at most FULL_ID_LENGTH values
    asked = prefixes.filter(F.length("prefix") < FULL_ID_LENGTH).agg(lengths.alias("_lengths"))
    cut = tasks.join(F.broadcast(asked)).select(  # one row
        "task_id", F.explode(F.filter("_lengths", lambda n: n <= F.length("task_id"))).alias("_n"))
    short = cut.select("task_id", F.expr("substring(task_id, 1, _n)").alias("prefix"))
    full = tasks.filter(F.length("task_id") >= FULL_ID_LENGTH).select("task_id", F.col("task_id").alias("prefix"))
    found = short.unionByName(full).groupBy("prefix").agg(F.count(F.lit(1)).alias("_matches"), F.min("task_id").alias("_one"))
    matches = F.coalesce("_matches", F.lit(0).cast("bigint"))
    state = F.when(matches == 0, "missing").when(matches == 1, "ok").otherwise("ambiguous")
    return prefixes.join(found, "prefix", "left").select(
        "prefix", matches.alias("matches"), state.alias("state"), F.when(matches == 1, F.col("_one")).alias("task_id"))


def ops_filter(tasks: DataFrame, status: str = "all", name: str = "all") -> DataFrame:
    """``running``, ``failed`` (failed, timeout, cancelled) or ``completed`` rows of one task or all."""
    wanted = {"running": ["running"], "failed": FAILED_STATES, "completed": ["completed"]}
    if status != "all":
        tasks = tasks.filter(F.col("status").isin(wanted[status]))
    return tasks if name == "all" else tasks.filter(F.col("task_name") == name)


def retry_candidates(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status").isin(FAILED_STATES)).withColumn(
        "retry_count", F.coalesce("retry_count", F.lit(0)) + 1)
