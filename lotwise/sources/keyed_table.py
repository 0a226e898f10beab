"""A table of one row a key that is changed in batches: upserts with guards, in versions, each batch once.

Rows lie in hash buckets of the key, as Parquet folders; a commit is a small file that names each bucket's folder. A batch
rewrites the buckets it touches and takes the next version's name for its commit; whoever comes second finds the name taken, and then
keeps his folders if the other batch touched other buckets, else computes them anew. Readers see a whole version. A batch has
an id and counts once: its mark is made after the commit, and the last commit tells of a batch whose mark is missing. A commit gets its
name when it is complete; one that cannot be read counts as none.

All files are reached through Spark's file systems, so the folder may be in any store that the driver and executors share and that
renames without replacing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Attempts to commit a batch beside others.
ATTEMPTS = 20
Merge = Callable[[str, Column, Column], Column]


class _Store:
    """Small files by the JVM's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.gateway = spark.sparkContext._gateway
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def create(self, name: str, text: str) -> bool:
        """Gives a file its name once it is written in full; false if the name is taken. Local disks link, others rename without replacing."""
        made, target = self._path(f"made/{uuid.uuid4().hex}"), self._path(name)
        out = self.fs.create(made, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.fs.mkdirs(target.getParent())
        try:
            if self.fs.getScheme() == "file":
                local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(target), local(made))
            else:
                hadoop = self.jvm.org.apache.hadoop.fs
                options = self.gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
                hadoop.FileContext.getFileContext(target.toUri(), self.conf).rename(made, target, options)
            return True
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        finally:
            if self.fs.exists(made):
                self.fs.delete(made, False)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


@dataclass(frozen=True)
class Version:
    number: int
    batch: str | None
    touched: list[int]
    folders: dict[str, str]


class KeyedTable:
    """The table in a folder. schema: of its rows; keys: their columns that name a row."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 32):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.store = _Store(spark, path)

    def version(self, number: int | None = None) -> Version:
        """A version, the last one by default; version 0 is empty."""
        for name in reversed(self.store.names("commits")):
            if name.endswith(".json") and (number is None or int(name[:12]) <= number):
                try:
                    return Version(**json.loads(self.store.read(f"commits/{name}")))
                except ValueError:  # not written to its end
                    continue
        return Version(0, None, [], {})

    def rows(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        return self._rows(self.version(number), buckets)

    def _rows(self, version: Version, buckets: list[int] | None = None) -> DataFrame:
        held = [f for b, f in version.folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in held]) if held else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _mark(self, batch: str) -> str:
        return f"batches/{hashlib.sha256(batch.encode()).hexdigest()}"

    def _last(self) -> tuple[Version, int]:
        """The last version, and the number that follows on it: a commit under that number builds on this version."""
        taken = max((int(n[:12]) for n in self.store.names("commits") if n.endswith(".json")), default=0)
        return self.version(taken), taken + 1

    def upsert(self, changes: DataFrame, batch: str, merge: Merge, guard: Callable[[Column, Column], Column] | None = None, insert: bool = True) -> bool:
        """Applies a batch of changes, at most one row a key; false if the batch had been applied before.

        merge(column, old row, new row): the value of a column; old is null for a new key. guard(old, new): whether a change
        takes place; a row whose change does not stays as it is. insert: whether keys that are new are added.
        """
        last, number = self._last()
        if last.batch is not None and not self.store.exists(self._mark(last.batch)):
            self.store.create(self._mark(last.batch), str(last.number))
        if self.store.exists(self._mark(batch)):
            return False
        new = changes.select(*[F.col(k) for k in self.keys], F.struct(*[F.col(f"`{c}`") for c in changes.columns]).alias("new"))
        touched = sorted(r["b"] for r in changes.select(self._bucket().alias("b")).distinct().collect())  # at most a row a bucket
        folders: dict[str, str] | None = None
        for _ in range(ATTEMPTS):
            if folders is None:
                folders = self._written(last, new, touched, merge, guard, insert)
            held = {b: f for b, f in last.folders.items() if int(b) not in touched} | folders
            if self.store.create(f"commits/{number:012d}.json", json.dumps({"number": number, "batch": batch, "touched": touched, "folders": held})):
                self.store.create(self._mark(batch), str(number))
                return True
            other, number = self._last()
            if self.store.exists(self._mark(batch)) or other.batch == batch:
                return False
            between = [self.version(n) for n in range(last.number + 1, other.number + 1)]
            if any({*v.touched} & {*touched} for v in between):
                folders = None
            last = other
        raise RuntimeError(f"batch {batch} found no free version in {ATTEMPTS} attempts")

    def _written(self, version: Version, new: DataFrame, touched: list[int], merge: Merge, guard, insert: bool) -> dict[str, str]:
        """Folders of the touched buckets with the changes applied."""
        names = self.schema.names
        old = self._rows(version, touched).select(*[F.col(k).alias(f"_{k}") for k in self.keys], F.struct(*names).alias("old"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
        met = new.join(old, same, "full")
        before, after = F.col("old"), F.col("new")
        takes = after.isNotNull() & (before.isNotNull() if not insert else F.lit(True))
        if guard is not None:
            takes &= before.isNull() | F.coalesce(guard(before, after), F.lit(False))
        value = lambda c: after[c] if c in self.keys else merge(c, before, after)
        out = met.withColumn("_takes", takes).where(F.col("_takes") | before.isNotNull())
        out = out.select(*[F.when(F.col("_takes"), value(c)).otherwise(before[c]).cast(self.schema[c].dataType).alias(c) for c in names])
        folder = f"data/{uuid.uuid4().hex}"
        out = out.withColumn("bucket_", self._bucket())
        out.repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/{folder}")
        made = {n.split("=")[1] for n in self.store.names(folder) if n.startswith("bucket_=")}
        return {b: f"{folder}/bucket_={b}" for b in made}


def replaced(column: str, old: Column, new: Column) -> Column:
    """A merge in which the new value holds."""
    return new[column]


def added(*columns: str) -> Merge:
    """A merge that adds the named columns and takes the greater of all others."""
    return lambda c, old, new: F.coalesce(old[c], F.lit(0)) + F.coalesce(new[c], F.lit(0)) if c in columns else F.greatest(old[c], new[c])
