"""Small files and folders on whatever file system Spark reaches."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the one named for checkpoints. One of our own only where everything runs on this machine."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return tempfile.mkdtemp(prefix="noteloom-")


class Files:
    """Small files and folders by Hadoop's file systems, as Spark reaches them."""

    def __init__(self, spark: SparkSession, root: str):
        self.conf, self.java = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
        self.root, self.fs = root, self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.java.org.apache.hadoop.fs.Path(name)

    def names(self) -> list[str]:
        folder = self.path(self.root)
        return [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return self.java.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """A whole file at once, under a name that must be new."""
        to, draft = self.path(f"{self.root}/{name}"), self.path(f"{self.root}/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.fs.exists(to) or not self.fs.rename(draft, to):
            self.fs.delete(draft, False)
            raise FileExistsError(f"{name}: another writer was first")

    def move(self, name: str, to: str) -> None:
        """Renames a file, over one that may be there."""
        source, target = self.path(f"{self.root}/{name}"), self.path(f"{self.root}/{to}")
        self.fs.delete(target, True)
        if not self.fs.rename(source, target):
            raise OSError(f"{name} can't become {to}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)
