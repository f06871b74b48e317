"""Session set-up and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPO = "repo_id"
_TABLES: list[DataFrame] = []


def build_session(app: str = "repotide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for (AQE, UTC, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a scratch one only on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before iterative operators")
        configured = tempfile.mkdtemp(prefix="repotide-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the checkpoint folder and read it back.

    Lineage ends there, lost executors read the table again, and the optimiser sees real sizes
    (so it can choose broadcast joins for small rounds). A table that ``cut`` made comes back as is.
    """
    if getattr(df, "_repotide_table", None):
        return df
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/repotide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._repotide_table = path
    _TABLES.append(out)
    return out


def cut_wide(df: DataFrame) -> DataFrame:
    """``cut`` for the tables of loops: joins with them sort and merge, whatever their size.

    A table below the broadcast limit would otherwise go through the driver again in every round.
    """
    table = cut(df)
    out = table.hint("merge")
    out._repotide_table = table._repotide_table
    return out


def cut_counting(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut_wide(df)``, its number of rows as ``rows``, and the numbers of rows for which the conditions ``counts`` hold.

    The numbers are observed while the table is written, so a loop needs no second job to see whether it is done.
    """
    seen = Observation()
    out = cut_wide(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]))
    found = seen.get
    return out, {n: int(found.get(n) or 0) for n in ("rows", *counts)}


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that a later round has replaced."""
    for df in tables:
        path = getattr(df, "_repotide_table", None)
        if path:
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def release_all() -> None:
    """Delete every table ``cut`` made in this process; call it when the results are written."""
    while _TABLES:
        release(_TABLES.pop())
