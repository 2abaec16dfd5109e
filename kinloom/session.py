"""Session helpers: a tuned local session and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = f"kinloom-{uuid.uuid4().hex[:12]}"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested with."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kinloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session leaves it unset (local runs and tests) a folder of this machine is chosen and set.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        shared = "file://" + tempfile.mkdtemp(prefix="kinloom-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, executor loss is harmless."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{_RUN}/{name}-{uuid.uuid4().hex[:10]}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[tuple[SparkSession, str]] = []


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame returned by :func:`materialise`, once no later plan reads it."""
    for path in df.inputFiles()[:1]:
        for spark, written in list(_WRITTEN):
            if path.startswith(written) or path.replace("file:///", "file:/").startswith(written.replace("file:///", "file:/")):
                _delete(spark, written)
                _WRITTEN.remove((spark, written))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may already be gone
            return
