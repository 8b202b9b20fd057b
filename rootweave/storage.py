"""Intermediate tables and checkpoints in the one folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where it is unset, which only a local master allows."""
    sc, name = spark.sparkContext, "spark.checkpoint.dir"
    now = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get(name, None) or (now.get() if now.isDefined() else None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(f"set {name} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rootweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(name, folder)
    if now.isEmpty():
        sc.setCheckpointDir(folder)
    return folder


_MADE: dict[tuple[str, str], object] = {}


def once(spark: SparkSession, name: str, make: Callable[[], object]) -> object:
    """What make() gives, made once for an application and a name: for tables that an index would hold."""
    key = spark.sparkContext.applicationId, name
    if key not in _MADE:
        for old in [k for k in _MADE if k[0] != key[0]]:
            del _MADE[old]
        _MADE[key] = make()
    return _MADE[key]


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows written as a compressed Parquet table in the shared folder and read again; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rootweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.rstrip("/"))


def read_text(folder: str, name: str) -> str | None:
    """A small file of a folder (path or URI), or None."""
    system, base = _system(folder)
    if system.get_file_info(f"{base}/{name}").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{base}/{name}") as f:
        return f.read().decode()


def write_text(folder: str, name: str, text: str) -> None:
    """Writes a small file whole: under a name of its own, then renamed."""
    system, base = _system(folder)
    system.create_dir(base, recursive=True)
    own = f"{base}/.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(text.encode())
    system.move(own, f"{base}/{name}")


def current_version(folder: str) -> int:
    """The number of a folder's current version, 0 if it has none."""
    return int(read_text(folder, "CURRENT") or 0)


def write_version(folder: str, tables: dict[str, DataFrame]) -> int:
    """Writes tables as the folder's next version and makes it the current one; older versions stay readable."""
    version = current_version(folder) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/v{version:06d}/{name}")
    write_text(folder, "CURRENT", str(version))
    return version


def open_version(spark: SparkSession, folder: str, names: Iterable[str], version: int | None = None) -> dict[str, DataFrame]:
    version = version or current_version(folder)
    if not version:
        raise FileNotFoundError(f"no version in {folder}")
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/v{version:06d}/{n}") for n in names}
