"""Session defaults, lineage cuts and stored intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .functions.files import Files


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "weftgraph") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only on a local master where the setting is absent."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    wanted = sc.getConf().get("spark.checkpoint.dir")
    if not wanted:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="weftgraph-checkpoint-")
        atexit.register(shutil.rmtree, wanted, ignore_errors=True)
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Used where a result is read more than once or where a loop would let the
    lineage grow; it survives lost executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as a table of columns, for what is read often and in part; it lasts as long as the session."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


_tables: list[tuple[SparkSession, str]] = []


def intact(spark: SparkSession) -> bool:
    """Whether the session's stored tables are still there; if some are gone, none is counted on any longer."""
    mine = [p for s, p in _tables if s is spark]
    if all(Files(spark, p).exists(p) for p in mine):
        return True
    _tables[:] = [t for t in _tables if t[0] is not spark]
    return False


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        Files(spark, path).delete(path)
