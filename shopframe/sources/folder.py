"""A folder of the cluster's file system, with files that appear whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """Names in a sub-folder, sorted; none where it does not exist."""
        at = self.at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The whole file appears under its name at once, or not at all."""
        part = self.at(f"_parts/{uuid.uuid4().hex}")
        stream = self.fs.create(part)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.at(name).getParent())
        if not self.fs.rename(part, self.at(name)):
            raise OSError(f"cannot publish {self.at(name)}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)
