"""Session helpers: a local session for tests, the shared working folder, shipping the package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings this library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodestone")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where no checkpoint folder is set at all and all runs on one machine (tests), a local one is made and set.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(root)
    return root


_SCRATCH: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below this application's own folder, which clean() removes."""
    return "/".join((_home(spark), *_SCRATCH, f"{name}-{uuid.uuid4().hex}"))


def _home(spark: SparkSession) -> str:
    return f"{shared_root(spark).rstrip('/')}/lodestone/{spark.sparkContext.applicationId}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Working tables that are made inside go when it ends; what shall stay must be written elsewhere before."""
    _SCRATCH.append(f"scratch-{uuid.uuid4().hex}")
    at = "/".join((_home(spark), *_SCRATCH))
    try:
        yield
    finally:
        _SCRATCH.pop()
        remove(spark, at)


def clean(spark: SparkSession) -> None:
    """Remove all working tables of this application; results that were not written elsewhere go with them."""
    remove(spark, _home(spark))


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared store, whatever file system it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(conf).delete(hp, True)


#: Bytes and rows of an Arrow batch on its way to a Python worker (the row that goes over the bytes is still in it).
BATCH_BYTES, BATCH_ROWS = 2 << 20, 4096
_BYTES_KEY, _ROWS_KEY = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
_DEFAULT = ("67108864b", "10000")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of the shared store, None where it isn't there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hp = jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(conf)
    if not fs.exists(hp):
        return None
    stream = fs.open(hp)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file there at once: it is written beside and then renamed over the old one."""
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    beside, hp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path)
    out = hp.getFileSystem(conf).create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(hp.toUri(), conf).rename(beside, hp, how)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once a context, and bound their batches, if the session doesn't."""
    sc = spark.sparkContext
    if spark.conf.get(_BYTES_KEY) == _DEFAULT[0]:
        spark.conf.set(_BYTES_KEY, f"{BATCH_BYTES}b")
    if spark.conf.get(_ROWS_KEY) == _DEFAULT[1]:
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))
    if getattr(sc, "_lodestone_shipped", False):
        return
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="lodestone-zip-")) / "lodestone_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, Path("lodestone") / p.relative_to(top))
    sc.addPyFile(os.fspath(out))
    sc._lodestone_shipped = True
