"""Places that the driver and every executor can see.

On a cluster the only such place is the folder named by `spark.checkpoint.dir`.
Without that setting a local master (tests) gets a temporary folder; any other
master is refused, since a folder of one machine is no place to cut lineage.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_HERE = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, from the session's `spark.checkpoint.dir`."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/geoloom-shared-{os.getuid()}"
    return qualified(spark, path.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark resolves it to (a bare path belongs to `fs.defaultFS`)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm_path).toString()


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/geoloom/{tag}-{uuid.uuid4().hex}"


def scopes() -> list[list[str]]:
    if not hasattr(_HERE, "scopes"):
        _HERE.scopes = []
    return _HERE.scopes


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialise` writes in this block are deleted at its end, but for those with `last`."""
    own: list[str] = []
    scopes().append(own)
    try:
        yield
    finally:
        scopes().remove(own)
        for path in own:
            discard(spark, path)


def materialise(df: DataFrame, tag: str, *, last: bool = False) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    `last` leaves the table to the scratch block around this one, if there is one.
    """
    path = new_path(df.sparkSession, tag)
    blocks = scopes()[:-1] if last else scopes()
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._geoloom_path = path
    return out


def discard(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Delete a table that `materialise` wrote and that nothing reads any more."""
    path = df_or_path if isinstance(df_or_path, str) else getattr(df_or_path, "_geoloom_path", None)
    if path:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


#: Schemes of Hadoop's stores by the name under which Arrow opens the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_fs(uri: str):
    """(pyarrow filesystem, path in it) for a URI; ValueError for a store that Arrow cannot open.

    A bare absolute path is refused: Spark may resolve it to another store than the
    executor's own disk (see `qualified`).
    """
    import pyarrow.fs as pafs

    scheme, colon, rest = uri.partition(":")
    if not colon:
        raise ValueError(f"{uri} names no store")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    except (OSError, ValueError, NotImplementedError) as e:
        raise ValueError(f"files cannot be written to {uri} from tasks: {e}") from e
