"""Session construction and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "wayfield", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that is given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where that is unset a local session gets a temporary one; on a
    cluster no folder of one machine will do, so it is an error there."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    already = spark.sparkContext.getCheckpointDir()
    if already:
        return already.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = os.path.join(tempfile.mkdtemp(prefix="wayfield-"), "scratch")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    The lineage ends there, a lost executor costs only the tasks that it ran, and later
    scans read only the columns that they need.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wayfield_path = path  # type: ignore[attr-defined]
    return out


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to enough tasks for all cores. Geometry is long work on few bytes, which Spark would put into one or two tasks by its bytes.
    What filters them comes after: Spark moves a filter below an exchange, with all that it needs to be worked out, but not below one that is not deterministic."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *by).filter(F.spark_partition_id() >= 0)


@contextmanager
def _set(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session (``__`` for a dot) for what is written within; then they are as before."""
    names = {k: k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(name, None) for k, name in names.items()}
    try:
        for k, name in names.items():
            spark.conf.set(name, values[k])
        yield
    finally:
        for k, name in names.items():
            spark.conf.unset(name) if before[k] is None else spark.conf.set(name, before[k])


def small_batches(spark: SparkSession, n_bytes: int = 4 << 20) -> AbstractContextManager[None]:
    """What is written within goes to Python in Arrow batches of about ``n_bytes`` (a longer row is one): a batch stands in
    buffers of the executor and, again, of its Python worker. Rows and their order do not depend on it."""
    return _set(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(n_bytes))


def exchanged_joins(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written within joins where the exchanges put its rows; only sides that ask for it are broadcast. Spark turns a join
    into a broadcast when one side, already exchanged, came out small; each costs the driver a thread and buffers that it keeps,
    and rounds over small tables have hundreds of them."""
    return _set(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_wayfield_path", None)
    if path:
        delete(df.sparkSession, path)
