"""Result tables of streaming jobs in a shared folder.

A micro-batch writes its own rows or its own partial state and nothing else, so
what it writes does not grow with the table. Numbers make it repeatable: a
replayed batch overwrites the files of its number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NumberedFolder:
    """Folders ``<kind>-<number>`` below a root, each written by one Spark job."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind; the list is as long as ``every`` allows, or one per batch of an append table."""
        found = self._fs.globStatus(self._path(f"{self.root}/{kind}-*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName().rsplit("-", 1)[1]) for s in found)

    def folder(self, kind: str, n: int) -> str:
        return f"{self.root}/{kind}-{n:012d}"

    def write(self, kind: str, n: int, df: DataFrame) -> None:
        fields = self.spark.createDataFrame([], self.schema).schema
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.mode("overwrite").parquet(self.folder(kind, n))

    def read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def remove(self, kind: str, n: int) -> None:
        self._fs.delete(self._path(self.folder(kind, n)), True)


class AppendTable(NumberedFolder):
    """Rows of all batches."""

    def commit(self, n: int, rows: DataFrame) -> None:
        self.write("rows", n, rows)

    def current(self) -> DataFrame:
        return self.read([self.folder("rows", n) for n in self.numbers("rows")])


class FoldedTable(NumberedFolder):
    """Keyed state, kept as a base and the partial states of later batches.

    ``fold`` takes states of any number of batches (rows of ``schema``) and
    gives one row per key; it must not depend on the order or grouping of
    batches. Every ``every`` batches the parts are folded into a new base,
    after which they and the old base are removed; a batch that such a base
    already holds is not taken again.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, fold: Callable[[DataFrame], DataFrame], every: int = 16):
        super().__init__(spark, root, schema)
        self.fold, self.every = fold, every

    def commit(self, n: int, part: DataFrame) -> None:
        base = max(self.numbers("base"), default=-1)
        if n <= base:
            return
        self.write("part", n, part)
        if n - base >= self.every:
            self.write("base", n, self.current())
            base = n
        for kind in ("part", "base"):
            for old in self.numbers(kind):
                if old < base or (kind == "part" and old == base):
                    self.remove(kind, old)

    def current(self, before: int | None = None) -> DataFrame:
        """One row per key, over all batches or those numbered below ``before`` (which must be later than the base)."""
        base = max(self.numbers("base"), default=-1)
        parts = [n for n in self.numbers("part") if n > base and (before is None or n < before)]
        states = [self.read([self.folder("base", base)])] if base >= 0 else []
        states += [self.read([self.folder("part", n) for n in parts])] if parts else []
        return self.fold(reduce(DataFrame.unionByName, states)) if states else self.read([])


def drain(stream: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Take everything the source has, one ``commit(batch, number)`` per micro-batch."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(commit).start())
    query.awaitTermination()
