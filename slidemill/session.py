"""Spark session defaults, shipping of the package to executors, and shared scratch tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch: rows with long texts come some at a time, short ones many. Set once, unless the application sets it.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_scratch: list[str] = []


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "slidemill") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once per application.

    Functions that run in Python workers are pickled by reference, so the workers have to be able
    to import this package even where it isn't installed.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"slidemill-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"slidemill/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, "8m")
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset on a single machine (a local master, as in tests) is a temporary folder
    made and set; elsewhere its absence is an error.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="slidemill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder, deleted by ``release`` or when the application's JVM ends."""
    path = f"{shared_dir(spark)}/slidemill-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _scratch.append(path)
    return path


def scratch_mark() -> int:
    """A point in time for ``release``."""
    return len(_scratch)


def discard(copy: DataFrame) -> None:
    """Deletes the scratch copies that a materialised table reads, once nothing needs it any more."""
    spark = copy.sparkSession
    jvm, conf, read = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), copy.inputFiles()
    for path in [p for p in _scratch if any(f"/{p.rpartition('/')[2]}/" in f for f in read)]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        _scratch.remove(path)


def release(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Deletes the scratch copies made since a mark, but for those that ``keep`` reads."""
    read = set(keep.inputFiles())
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _scratch[since:]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not any(f"/{path.rpartition('/')[2]}/" in f for f in read):
            where.getFileSystem(conf).delete(where, True)
            _scratch.remove(path)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet under the shared folder and reads it back.

    Unlike a local checkpoint the copy survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The plain path of a ``file:`` URI or scheme-less path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def ensure_parent(path: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
