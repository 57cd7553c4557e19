"""The folder that driver and executors share, tables kept there, and files that only one writer can create."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a session in one process, as in tests, gets a temporary folder where it names none;
    on a cluster that is an error, as executors would not see each other's files.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir", None)
    if told:
        return told
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="moraine-")
    atexit.register(shutil.rmtree, made, True)
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder once and read from there; they go when the driver ends.

    Whatever depends on how rows were dealt out, as their numbers within a partition do, must be
    read from one writing: a plan that is run twice may deal them out in another way.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        fs, p = file_system(spark, path)
        fs.delete(p, True)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any scheme."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, p = file_system(spark, path)
    source = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    finally:
        source.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, sorted; none if there is no such folder."""
    fs, p = file_system(spark, folder)
    try:
        return sorted(s.getPath().getName() for s in fs.listStatus(p))
    except Py4JJavaError as e:
        if "FileNotFoundException" in str(e.java_exception):
            return []
        raise


def put_if_absent(spark: SparkSession, path: str, data: bytes) -> bool:
    """Create a file with these bytes, whole or not at all; False if there is one of that name.

    The bytes are written beside it first.  On a local path the file gets its name by a hard
    link, which the kernel makes for one of several writers only; elsewhere by a rename that
    does not overwrite, which HDFS makes within one lock.  A store whose rename is a copy
    does not exclude others: it needs a file system that says so by failing here.
    """
    jvm = spark.sparkContext._jvm
    fs, target = file_system(spark, path)
    real = fs.resolvePath(target.getParent())
    temp = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"
    write_bytes(spark, temp, data)
    try:
        if real.toUri().getScheme() == "file":
            folder = real.toUri().getPath()
            nio = lambda name: jvm.java.io.File(folder, name).toPath()
            jvm.java.nio.file.Files.createLink(nio(target.getName()), nio(temp.rpartition("/")[2]))
        else:
            flags = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(jvm.org.apache.hadoop.fs.Path(temp), target, flags)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        for name in (temp, f"{temp.rpartition('/')[0]}/.{temp.rpartition('/')[2]}.crc"):
            fs.delete(jvm.org.apache.hadoop.fs.Path(name), False)
