"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("basewise")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, once, as Spark does with added files."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        name = f"{tempfile.mkdtemp(prefix='basewise-package-')}/basewise"
        sc.addPyFile(shutil.make_archive(name, "zip", root.parent, root.name))
        _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the one the cluster names in ``spark.checkpoint.dir``, or the checkpoint folder already set.

    A session on one machine that names none (a test) gets a temporary one; on a cluster that
    is an error, as other machines couldn't read a folder of the driver's.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        sc.setCheckpointDir(named or _temporary_folder())
    return sc.getCheckpointDir()


def _temporary_folder() -> str:
    folder = tempfile.mkdtemp(prefix="basewise-checkpoint-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm

    def remove() -> None:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
        except Exception:  # the JVM is gone, or someone has cleared the folder
            pass

    atexit.register(remove)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table of the shared folder and read it from there.

    Any executor may be lost afterwards. Later steps read only the columns they use, and know
    the table's size.
    """
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
