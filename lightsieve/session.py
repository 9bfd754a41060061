"""Session, table and shared-folder helpers that every other module uses."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "lightsieve", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests, benchmarks and the command line. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package when it is not installed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_ROOT)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only a local session that names none (tests on one machine) gets a temporary folder, removed at exit. Executors of
    a cluster could not see such a folder, so there the setting must be given.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_dirs.get(spark.sparkContext.applicationId)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_dirs[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


#: by application: the temporary folder of a local session; the setting itself is fixed once a session runs
_local_dirs: dict[str, str] = {}


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lightsieve/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, is computed once, survives lost executors."""
    path = shared_path(df.sparkSession, label)
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[written] = path
    return written


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*materialized: DataFrame) -> None:
    """Deletes what materialize() wrote, once no plan reads it any more; frames of other origin are left alone."""
    for df in materialized:
        if path := _paths.pop(df, None):
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder; results not yet computed are lost with it."""
    _delete(spark, _run_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings of the session for as long as the block runs."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
