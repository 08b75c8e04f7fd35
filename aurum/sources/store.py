"""Parquet tables in versions: a new version is written beside the old one, then a pointer file names it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Tables below one folder of any Hadoop file system. One writer at a time; readers see a whole version.

    A table is a folder of versions and of pointer files p<number>, each naming a version; the highest pointer counts. A
    pointer is created in one step under a name that did not exist, so after a crash the table is either the old or the
    new version. The last KEEP versions stay for readers that still hold them."""

    KEEP = 2

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def pointers(self, name: str) -> list[int]:
        folder = self.path(f"{self.root}/{name}")
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "p" and n[1:].isdigit())

    def version(self, name: str, number: int) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}/p{number}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return bool(self.pointers(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{self.version(name, self.pointers(name)[-1])}")

    def append(self, name: str, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        """Adds rows to the present version."""
        if not self.exists(name):
            return self.replace(name, rows, partition_by)
        writer = rows.write.mode("append")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/{self.version(name, self.pointers(name)[-1])}")

    def replace(self, name: str, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        fresh = f"v-{uuid.uuid4().hex}"
        (rows.write.partitionBy(*partition_by) if partition_by else rows.write).parquet(f"{self.root}/{name}/{fresh}")
        old = self.pointers(name)
        waiting, target = self.path(f"{self.root}/{name}/.{fresh}"), self.path(f"{self.root}/{name}/p{old[-1] + 1 if old else 1}")
        stream = self.fs.create(waiting, False)
        stream.write(fresh.encode())
        stream.close()
        if not self.fs.rename(waiting, target):
            raise OSError(f"{target} is there already: another writer was faster")
        for number in old[: max(0, len(old) + 1 - self.KEEP)]:
            self.fs.delete(self.path(f"{self.root}/{name}/{self.version(name, number)}"), True)
            self.fs.delete(self.path(f"{self.root}/{name}/p{number}"), True)

    def discard(self, path: str) -> None:
        self.fs.delete(self.path(path), True)
