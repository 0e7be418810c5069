"""Places that the driver and all executors see, and files in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; a local master without it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/geoloom-shared"
    return qualified(spark, path.rstrip("/"))


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/geoloom/{tag}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark resolves it to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def open_store(uri: str):
    """(pyarrow file system, path in it) of a qualified URI."""
    import pyarrow.fs as pafs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def put(fs, path: str, data: bytes) -> None:
    """A whole file at once: readers see the old one or the new one, and a task that runs again writes the same."""
    staged = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(staged) as out:
        out.write(data)
    fs.move(staged, path)


def get(fs, path: str) -> bytes | None:
    if not fs.get_file_info(path).is_file:
        return None
    with fs.open_input_stream(path) as f:
        return f.read()


def publish(spark: SparkSession, staged: str, path: str) -> bool:
    """Give a finished folder its name, if none has it yet; else the staged one is deleted."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(source, target, none)
        return True
    except Exception:
        if not target.getFileSystem(conf).exists(target):
            raise
        source.getFileSystem(conf).delete(source, True)
        return False
