"""Physical plans: pruning, rank limits, and no joins that pair everything with everything."""

import pytest

from repotide.catalog import QUERIES
from repotide.fixtures import table
from repotide.operators import entropy, freshness, joins, windows
from repotide.session import cut, release_all
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "f05_doc_freshness", "d01_doc_ownership", "d07_longest_prefix", "d09_match_by_name", "d10_resolve_imports", "d16_module_status",
    "e27_child_edges", "f11_effective_coverage", "f12_index_worklist", "f16_snapshot_trend", "f37_module_buckets", "c06_rule_scan"])
def test_only_equi_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_what_is_needed(spark):
    text = plan(freshness.doc_freshness(table(spark, SF, "fx_files"), table(spark, SF, "fx_docs")))
    assert "l_shipdate" in text and "l_extendedprice" not in text and "p_retailprice" not in text


def test_scope_filter_is_pushed_down(spark):
    from repotide.functions.paths import in_scope
    text = plan(spark.read.parquet(f"{SF}/customer.parquet").filter(in_scope(F.col("c_name"), "src/a")))
    assert "StringStartsWith(c_name,src/a/)" in text


def test_top_rows_per_key_are_limited_before_the_shuffle(spark):
    text = plan(windows.keep_last(table(spark, SF, "fx_tasks"), ["repo_id"], [F.col("updated_at").desc(), F.col("task_id")], 3))
    assert text.count("WindowGroupLimit") == 2


def test_files_are_joined_once(spark):
    owned = joins.own_files(table(spark, SF, "fx_files"), table(spark, SF, "fx_docs"))
    assert "CartesianProduct" not in plan(owned)
    assert set(owned.columns) >= {"owner", "doc_mtime", "path"}


def test_cut_tables_can_be_dropped(spark):
    df = cut(spark.range(10))
    assert df.count() == 10 and cut(df) is df
    release_all()
    with pytest.raises(Exception):  # noqa: B017
        df.count()


def test_entropy_checks_read_the_texts_once(spark, tmp_path):
    """All checks together give what each gives alone, from one scan of the texts."""
    code = table(spark, SF, "fx_code").select("repo_id", "path", "content").unionByName(table(spark, SF, "fx_dir_sources"))
    nulls = spark.createDataFrame([("r0", "x/null.js", None), ("r0", "x/empty.js", "")], "repo_id string, path string, content string")
    code.unionByName(nulls).write.parquet(str(tmp_path / "code"))
    files = spark.read.parquet(str(tmp_path / "code"))
    checks = (1, 2, 3, 4, 5, 6, 7)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    alone = [entropy.undocumented_exports, entropy.todo_markers, entropy.console_residue, entropy.swallowed_errors,
             entropy.index_gaps, entropy.unused_exports, entropy.async_without_try]
    each = [key(job(files)) for job in alone]
    assert all(each)
    assert key(entropy.entropy_scan(files, checks=checks)) == sorted(r for rows in each for r in rows)
    assert plan(entropy.facts(files, checks)).count("FileScan") == 1
    # What is left to read is the table of facts, not the texts.
    assert "content" not in plan(entropy.entropy_scan(files, checks=checks))
    assert plan(entropy.entropy_scan(files, checks=(1, 2, 3, 4, 7))).count("FileScan") == 1
