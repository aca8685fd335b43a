"""Session helpers shared by every job."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusdiff")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    tune(spark)
    return spark


def tune(spark: SparkSession) -> None:
    """Settings the jobs want from any session.

    Signals and pair scores cost much CPU per byte, so small shuffle outputs must not be merged into one task. Their
    expressions are long: a generated method of more than 8000 bytes is never compiled by the JVM but interpreted, so steps
    that would give one are planned without whole-stage code, whose methods are short.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)


def pin(df: DataFrame) -> DataFrame:
    """Compute the columns of ``df`` here and only here.

    The optimizer copies column definitions into every expression and filter above that uses them; with definitions
    that build on each other the copies grow exponentially. A row number, which must not be copied, stops that.
    """
    row = "pin_"
    return df.withColumn(row, F.monotonically_increasing_id()).filter(F.col(row) >= 0).drop(row)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few splits to all cores. Large inputs have more splits than cores and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can write to.

    A cluster names it in ``spark.checkpoint.dir``. Only where neither that setting nor a checkpoint
    directory on the context exists (tests, one machine) a temporary folder is taken; on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if configured is None and not (context.master or "").startswith("local[") and context.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="corpusdiff-ckpt-"))
        current = context.getCheckpointDir()
    return configured or current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that later stages and retries start from files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_table(df: DataFrame, name: str) -> DataFrame:
    """:func:`cut_lineage` for wide rows: compressed columns in the shared folder, where a checkpoint holds plain rows. Later steps read only the columns they use."""
    path = scratch_table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, as ``--py-files`` does for a submitted job."""
    context = spark.sparkContext
    if getattr(context, "_corpusdiff_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="corpusdiff-py-")) / "corpusdiff.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._corpusdiff_shipped = True
