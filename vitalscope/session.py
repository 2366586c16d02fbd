"""Session helpers: local sessions for tests and benches, checkpoints, sizes."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A side is broadcast or turned into a literal only below this many rows.
SMALL_ROWS = 20_000
# Scans below this many bytes are spread over the cores, see spread().
SPREAD_BYTES = 256 * 1024 * 1024


def local_session(cores: int = 8, name: str = "vitalscope", memory: str = "8g") -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own: on a
    cluster a machine-local folder dies with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="vitalscope-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a result that several later jobs read, and cut its lineage there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast ``df`` when a count proves it small, else leave it to a shuffle join."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def small_rows(df: DataFrame, max_rows: int = SMALL_ROWS) -> list | None:
    """The rows of ``df`` when there are at most ``max_rows``, else None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def spread(df: DataFrame) -> DataFrame:
    """Give a small scan one partition per core.

    A file with one row group is read by one task however many cores there
    are. Large scans already have a task per row group and are left alone, so
    no large table is ever shuffled for this.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def parallelism(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def with_evaluated(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a costly column that later columns read several times.

    Spark may copy an expression into each of its readers, Python functions
    included. Generating the value keeps one evaluation per row.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(column)).alias(name))
