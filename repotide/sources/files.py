"""File inventories, change sets, project markers and result tables."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repotide.functions.paths import CODE_EXTENSIONS, base_name, dir_name, extension, not_excluded
from repotide.functions.text import line_count
from repotide.operators.windows import keep_last
from repotide.session import REPO, cut_counting

# Marker file -> (language, framework), in order of precedence.
LANGUAGE_MARKERS = [
    ("package.json", "javascript", "node"), ("tsconfig.json", "typescript", "node"),
    ("pyproject.toml", "python", "poetry"), ("setup.py", "python", "setuptools"),
    ("requirements.txt", "python", "pip"), ("go.mod", "go", "go"), ("Cargo.toml", "rust", "cargo"),
    ("pom.xml", "java", "maven"), ("build.gradle", "java", "gradle"), ("Gemfile", "ruby", "bundler"),
    ("composer.json", "php", "composer"),
]
# Marker file -> technology.
TECH_MARKERS = {
    "package.json": "node", "tsconfig.json": "typescript", "next.config.js": "nextjs",
    "next.config.mjs": "nextjs", "vite.config.js": "vite", "nuxt.config.ts": "nuxt",
    "pyproject.toml": "python", "requirements.txt": "python", "go.mod": "go", "Cargo.toml": "rust",
    "pom.xml": "java", "build.gradle": "java", "Gemfile": "ruby", "composer.json": "php",
}
# Fixed values: (language, marker file, test framework), in order of precedence per language.
TEST_MARKERS = [
    ("javascript", "vitest.config.js", "vitest"), ("javascript", "vitest.config.ts", "vitest"),
    ("javascript", "jest.config.js", "jest"), ("javascript", "jest.config.ts", "jest"),
    ("typescript", "vitest.config.ts", "vitest"), ("typescript", "jest.config.ts", "jest"),
    ("python", "pytest.ini", "pytest"), ("python", "pyproject.toml", "pytest"),
    ("python", "setup.cfg", "pytest"), ("go", "go.mod", "go"), ("rust", "Cargo.toml", "cargo"),
]
# Lock file -> package manager, in order of precedence.
PACKAGE_MANAGERS = [("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"),
                    ("package-lock.json", "npm")]


FOLDERS_A_TASK = 64  # folders that a task lists
FILES_A_TASK = 1000  # files that a task reads
BATCH_BYTES = 8 << 20  # of content in one Arrow batch, or one file


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's file sources leave out."""
    if folder and name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _lister(endings: tuple[str, ...]):
    """Lists folders (Arrow batches with ``file``): folders, and files with one of the endings in either case that are
    not empty, as Spark's file sources do."""
    schema = pa.schema([("file", pa.string()), ("folder", pa.bool_()), ("mtime", pa.timestamp("us", "UTC")), ("length", pa.int64())])

    def run(batches):
        rows = []
        for batch in batches:
            for folder in batch.column("file").to_pylist():
                with os.scandir(folder) as entries:
                    for entry in entries:
                        try:
                            if _hidden(entry.name, folder=entry.is_dir()):
                                continue
                            if entry.is_dir():
                                rows.append((entry.path, True, None, None))
                            elif entry.name.lower().endswith(endings) and (state := entry.stat()).st_size:
                                rows.append((entry.path, False, state.st_mtime_ns // 1_000_000 * 1000, state.st_size))
                        except FileNotFoundError:  # gone meanwhile, or a link to nothing
                            continue
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _read_contents(batches):
    """Adds ``content`` to Arrow batches of files, in batches of about BATCH_BYTES."""
    for batch in batches:
        start, held, contents = 0, 0, []
        for i, file in enumerate(batch.column("file").to_pylist()):
            with open(file, "rb") as source:
                contents.append(source.read())
            held += len(contents[-1])
            if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                part = batch.slice(start, len(contents))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*part.schema.names, "content"])
                start, held, contents = i + 1, 0, []


def _listed(spark: SparkSession, root: str, endings: tuple[str, ...], with_content: bool) -> DataFrame:
    """(file, mtime, length, content) of the files below a folder of a file system, level by level.

    Tasks list the folders of a level and read the files, so the driver holds neither. A task lists FOLDERS_A_TASK
    folders, one at least; what it finds is written as it comes. ``content`` is null unless asked for.
    """
    level, count, found = spark.createDataFrame([(root,)], "file string"), 1, []
    while count:
        spread = level.repartition(count // FOLDERS_A_TASK + 1)
        entries, seen = cut_counting(spread.mapInArrow(_lister(endings), "file string, folder boolean, mtime timestamp, length long"), folders=F.col("folder"))
        found.append((entries, seen["rows"] - seen["folders"]))
        level, count = entries.filter("folder").select("file"), seen["folders"]
    files = found[0][0]
    for entries, _ in found[1:]:
        files = files.unionByName(entries)
    files = files.filter("not folder").select("file", "mtime", "length")
    if not with_content:
        return files.withColumn("content", F.lit(None).cast("binary"))
    spread = files.repartition(sum(n for _, n in found) // FILES_A_TASK + 1)
    return spread.mapInArrow(_read_contents, "file string, mtime timestamp, length long, content binary")


def scan_files(spark: SparkSession, root: str, repo: str | None = None, extensions=CODE_EXTENSIONS,
               modified_after: str | None = None, with_content: bool = False) -> DataFrame:
    """Inventory of the files below ``root``: path, directory, time, and content when asked for.

    Without ``repo`` the folders directly below ``root`` are the repositories (``name`` or ``repo_id=name``), all
    listed in one scan, and paths are relative to them; files beside these folders belong to none and go.

    ``root`` is a path or URI of any store that Spark reads. Files without one of the extensions, in either case, are
    never input; ``content`` is read only when asked for. A folder of a file system is listed and read by tasks. In other
    stores the extension list becomes the file source's glob filter, and the driver holds the list of all files.
    """
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    qualified = store.makeQualified(folder).toUri()
    whole = qualified.getPath().rstrip("/") or "/"
    if qualified.getScheme() == "file" and os.path.isdir(whole):
        raw = _listed(spark, whole, tuple(e.lower() for e in extensions), with_content)
        if modified_after:
            raw = raw.filter(F.col("mtime") > F.lit(modified_after).cast("timestamp"))
        raw = raw.withColumnsRenamed({"file": "path", "mtime": "modificationTime"})
    else:
        either = lambda ext: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
        reader = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                  .option("pathGlobFilter", "*{" + ",".join(map(either, extensions)) + "}"))
        if modified_after:
            reader = reader.option("modifiedAfter", modified_after)
        raw = reader.load(root)
    tail = F.regexp_replace(F.col("path"), r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")  # scheme and host
    rel = F.substr(tail, F.lit(len(whole.rstrip("/")) + 2))
    if repo is None:
        raw = raw.filter(F.contains(rel, F.lit("/")))
        name = F.regexp_replace(F.substring_index(rel, "/", 1), f"^{REPO}=", "")
        rel = F.regexp_replace(rel, "^[^/]*/", "")
    else:
        name = F.lit(repo)
    out = raw.select(name.alias(REPO), rel.alias("path"), F.col("modificationTime").alias("mtime"),
                     F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("content"))
    out = scan_snapshot(out, extensions)
    if with_content:
        return out.withColumn("line_count", line_count(F.col("content")))
    return out.drop("content")


def scan_snapshot(files: DataFrame, extensions=CODE_EXTENSIONS) -> DataFrame:
    """Same rules over an inventory table: ignored and hidden directories and other extensions go."""
    path = F.col("path")
    return files.filter(extension(path).isin(list(extensions)) & not_excluded(path)).withColumns(
        {"dir": dir_name(path), "name": base_name(path), "ext": extension(path)})


def change_set(changes: DataFrame, suffixes=(".js", ".mjs", ".ts")) -> DataFrame:
    """One row per changed path: the staged entry wins; the status keeps its first letter.

    ``changes`` has ``stage`` (``staged`` or ``unstaged``) and ``status``.
    """
    kept = F.lit(False)
    for suffix in suffixes:
        kept = kept | F.col("path").endswith(suffix)
    rank = F.when(F.col("stage") == "staged", 0).otherwise(1)
    return changes.filter(kept).groupBy(REPO, "path").agg(
        F.min_by(F.substring("status", 1, 1), F.struct(rank, F.col("status"))).alias("status"))


def detect_stack(files: DataFrame, language_markers=LANGUAGE_MARKERS, tech_markers=TECH_MARKERS,
                 test_markers=TEST_MARKERS, package_managers=PACKAGE_MANAGERS) -> DataFrame:
    """Per repository: language and framework (first marker wins), technologies, test framework,
    package manager of JavaScript projects. One aggregation over the marker files."""
    name = F.col("name")
    marker = name.isin(sorted({m[0] for m in language_markers} | set(tech_markers) | {m[1] for m in test_markers}
                              | {m[0] for m in package_managers}))
    lang_rank = F.coalesce(*[F.when(name == m[0], i) for i, m in enumerate(language_markers)])
    tech = F.create_map(*[F.lit(x) for kv in tech_markers.items() for x in kv])
    names = files.select(REPO, base_name(F.col("path")).alias("name")).groupBy(REPO).agg(
        F.min(lang_rank).alias("_lang"), F.collect_set(F.when(marker, name)).alias("_names"),  # marker names only
        F.array_join(F.sort_array(F.collect_set(F.try_element_at(tech, name))), ",").alias("technologies"))
    has = lambda m: F.array_contains("_names", m)
    pick = lambda i: F.coalesce(*[F.when(F.col("_lang") == k, m[i])
                                  for k, m in enumerate(language_markers)], F.lit("unknown"))
    language = pick(1)
    framework = F.coalesce(*[F.when((language == lang) & has(m), fw) for lang, m, fw in test_markers],
                           F.lit("unknown"))
    manager = F.coalesce(*[F.when(language.isin("javascript", "typescript") & has(m), pm)
                           for m, pm in package_managers])
    return names.select(REPO, language.alias("language"), pick(2).alias("framework"), "technologies",
                        framework.alias("test_framework"), manager.alias("package_manager"))


def latest_projects(runs: DataFrame) -> DataFrame:
    """Project registry: one row per project path, the last run wins."""
    return runs.groupBy("project_path").agg(F.max("run_at").alias("last_run"), F.count(F.lit(1)).alias("runs"))


def write_result(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Write a result table partitioned by repository; re-running replaces only its partitions."""
    writer = df.write.mode(mode).partitionBy(REPO)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.format(fmt).save(path)


def trim_history(history: DataFrame, keys: list[str], ts: str, keep: int = 20) -> DataFrame:
    """History with the newest ``keep`` rows per key."""
    return keep_last(history, keys, [F.col(ts).desc()], keep)


FILE_NODE = T.StructType([
    T.StructField("imports", T.ArrayType(T.StringType())),
    T.StructField("importedBy", T.ArrayType(T.StringType())),
    T.StructField("exports", T.ArrayType(T.StringType())),
])
GRAPH = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("root", T.StringType()),
    T.StructField("files", T.MapType(T.StringType(), FILE_NODE)),
])
TEST_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("tests", T.ArrayType(T.StringType())),
])
TEST_MODULE = T.StructType([
    T.StructField("total", T.LongType()), T.StructField("covered", T.LongType()),
    T.StructField("stale", T.LongType()), T.StructField("untested", T.LongType()),
    T.StructField("files", T.MapType(T.StringType(), TEST_FILE)),
])
TEST_MAP = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("modules", T.MapType(T.StringType(), TEST_MODULE)),
])


def read_graph_json(spark: SparkSession, path: str, repo: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, exports) of dependency-graph JSON documents, one or several files for a repository.

    Without ``repo`` the documents of all repositories are read at once, from folders ``repo_id=name`` below ``path``.
    """
    schema = GRAPH if repo is not None else T.StructType([*GRAPH.fields, T.StructField(REPO, T.StringType())])
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    return graph_tables(doc.select(F.col(REPO) if repo is None else F.lit(repo).alias(REPO), "files"))


def parse_graph_json(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Same from a text column with one graph document per row."""
    return graph_tables(df.select(REPO, F.from_json(column, GRAPH)["files"].alias("files")))


def graph_tables(doc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    node = doc.select(REPO, F.explode("files").alias("path", "node"))
    nodes = node.select(REPO, "path")
    edges = node.select(REPO, F.col("path").alias("src"), F.explode("node.imports").alias("dst")).distinct()
    exports = node.select(REPO, "path", F.explode("node.exports").alias("symbol"))
    return nodes, edges, exports


def parse_test_map_json(df: DataFrame, column: str) -> DataFrame:
    """Rows (module, source, status, test) of nested test-map documents; untested sources have no test."""
    module = df.select(REPO, F.explode(F.from_json(column, TEST_MAP)["modules"]).alias("module", "m"))
    source = module.select(REPO, "module", F.explode("m.files").alias("name", "f"))
    return source.select(REPO, "module", F.col("f.path").alias("source_path"), F.col("f.status").alias("status"),
                         F.explode_outer("f.tests").alias("test_path"))
