"""Tables that are written to the shared folder between steps, read back, and deleted when they are done with."""

from __future__ import annotations

import tempfile
import uuid
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a session on this machine alone gets a folder of its own; on a cluster that is an error,
    since a machine's own folder is seen by no other.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif context.master == "local" or context.master.startswith("local["):
            found = tempfile.mkdtemp(prefix="quarry-")
            context.setCheckpointDir(found)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return found.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, its rows are the same each time they are read, and a lost executor costs no recomputation."""
    path = staged_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.__dict__["_staged"] = path
    return found


class Folder:
    """A folder of the shared file system, by Hadoop's own interface."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.place = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.place.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.files.exists(self.place)

    def delete(self) -> bool:
        return self.files.delete(self.place, True)

    def rename(self, to: str) -> None:
        """Move it; the folder above the new place is made, and a failure is an error."""
        target = self.jvm.org.apache.hadoop.fs.Path(to)
        self.files.mkdirs(target.getParent())
        if not self.files.rename(self.place, target):
            raise OSError(f"could not move {self.path} to {to}")

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.files.listStatus(self.place)) if self.exists() else []

    def state(self) -> list[tuple[str, int, int]]:
        """(path, bytes, time of the last change) of each file below it, or of itself if it is one."""
        out, files = [], self.files.listFiles(self.place, True) if self.exists() else None
        while files is not None and files.hasNext():
            found = files.next()
            out.append((found.getPath().toString(), found.getLen(), found.getModificationTime()))
        return sorted(out)

    def empty(self, pattern: str) -> list[str]:
        """Paths of the files of no bytes below it whose name matches a pattern with wildcards."""
        out, files = [], self.files.listFiles(self.place, True) if self.exists() else None
        while files is not None and files.hasNext():
            found = files.next()
            if found.getLen() == 0 and fnmatch(found.getPath().getName(), pattern):
                out.append(found.getPath().toString())
        return sorted(out)

    def claim(self, text: str) -> bool:
        """Create it as a file that holds text, unless it is there: of several that try, one succeeds."""
        try:
            out = self.files.create(self.place, False)
        except Exception as e:  # noqa: BLE001  a Java exception
            if self.exists():
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True


def folder(spark: SparkSession, path: str) -> Folder:
    return Folder(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; others are left alone."""
    for df in tables:
        path = df.__dict__.pop("_staged", None)
        if path:
            folder(df.sparkSession, path).delete()
