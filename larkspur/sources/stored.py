"""A stored table of buckets, each written anew as a whole or added to, with versions that become visible at once.

Rows lie in buckets by the hash of a key. A change writes the buckets that it touches into a folder of its own and then a
version file, which names for every bucket the folders it is made of; the other buckets' files stay as they are. The
version file is put in place by a rename that fails if its number is taken, so readers see all of a change or nothing, and
of two writers at a time one has to start again. A change that fails leaves files that no version names; ``vacuum``
deletes those, and versions that are no longer wanted.

A version file has a line a bucket, and the number of buckets is fixed, so it stays as small as it began.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Folders a bucket is made of, from which on an append writes the bucket anew.
MOST_FOLDERS = 8


class Conflict(RuntimeError):
    """Another change has taken the version."""


class StoredTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        head = self._state(0)
        self.schema, self.key, self.count = T.StructType.fromJson(head["schema"]), head["key"], head["count"]

    @staticmethod
    def create(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64) -> StoredTable:
        """An empty table; ``key``: the column that its buckets go by."""
        table = StoredTable.__new__(StoredTable)
        table.spark, table.path = spark, path.rstrip("/")
        table.fs = table._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        table.schema, table.key, table.count = schema, key, buckets
        table._commit(-1, {})
        return table

    # versions

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._at("versions")
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _state(self, version: int) -> dict:
        stream = self.fs.open(self._at(f"versions/{version:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, base: int, folders: dict[str, list[str]]) -> int:
        """The version after ``base``; a version file of that number is an error."""
        version, made = base + 1, self._at(f"versions/.{uuid.uuid4().hex}")
        text = json.dumps({"schema": json.loads(self.schema.json()), "key": self.key, "count": self.count, "folders": folders})
        stream = self.fs.create(made, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        placed = self._at(f"versions/{version:012d}.json")
        if self.fs.exists(placed) or not self.fs.rename(made, placed):
            self.fs.delete(made, False)
            raise Conflict(f"version {version} of {self.path} is taken")
        return version

    # rows

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.count)).cast("int")

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, the last by default, of some buckets if named."""
        return self._rows(self._state(self.versions()[-1] if version is None else version)["folders"], buckets)

    def lookup(self, value, version: int | None = None) -> DataFrame:
        """The rows of one key, from its bucket's files."""
        key = F.lit(value).cast(self.schema[self.key].dataType)
        of = self.spark.range(1).select(self.bucket(key)).first()[0]
        return self.read(version, [of]).where(F.col(self.key).eqNullSafe(key))

    def _rows(self, folders: dict[str, list[str]], buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = folders if buckets is None else {str(b): folders.get(str(b), []) for b in buckets}
        paths = [f"{self.path}/data/{folder}/_bucket={b}" for b, names in sorted(wanted.items()) for folder in names]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _touched(self, *keys: DataFrame) -> list[int]:
        """Buckets of the keys: as many as there are buckets at most."""
        found = keys[0].select(self.bucket(F.col(self.key)).alias("b"))
        for more in keys[1:]:
            found = found.unionByName(more.select(self.bucket(F.col(self.key)).alias("b")))
        return sorted(r.b for r in found.distinct().collect())

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Rows into a new folder, a file a bucket, or more where a bucket is large."""
        name = uuid.uuid4().hex
        marked = rows.select(*self.schema.names).withColumn("_bucket", self.bucket(F.col(self.key)))
        # a rebalance by bucket, which adaptive execution splits where a bucket is large
        marked.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        files = self.fs.listStatus(self._at(f"data/{name}"))
        return name, sorted(int(f.getPath().getName().split("=")[1]) for f in files if f.isDirectory())

    def _changed(self, base: int, folders: dict[str, list[str]], touched: list[int], rows: DataFrame) -> int:
        """A version in which the touched buckets hold ``rows`` and nothing else."""
        name, held = self._write(rows)
        new = {b: names for b, names in folders.items() if int(b) not in set(touched)}
        return self._commit(base, new | {str(b): [name] for b in held})

    def _now(self) -> tuple[int, dict[str, list[str]]]:
        base = self.versions()[-1]
        return base, self._state(base)["folders"]

    def append(self, rows: DataFrame, unique: Sequence[str] = ()) -> int:
        """Add rows. With ``unique``, rows whose values in these columns (the table's key among them) are there stay out,
        and of those that are new one stays. Buckets are added to; one of many folders is written anew."""
        base, folders = self._now()
        if unique:
            rows = rows.select(*self.schema.names).dropDuplicates(list(unique))
            old = self._rows(folders, self._touched(rows)).select(*unique)
            rows = rows.join(old, list(unique), "left_anti").select(*self.schema.names)
        name, held = self._write(rows)
        new = {b: [*folders.get(b, []), name] for b in map(str, held)}
        long = sorted(int(b) for b, names in new.items() if len(names) > MOST_FOLDERS)
        folders = folders | new
        if long:
            return self._changed(base, folders, long, self._rows(folders, long))
        return self._commit(base, folders)

    def upsert(self, rows: DataFrame, partial: bool = False) -> int:
        """Rows take the place of those with their key; a key is there once. ``partial``: null columns leave what is
        there, and keys that are not there are ignored."""
        base, folders = self._now()
        touched = self._touched(rows)
        old = self._rows(folders, touched)
        rest = [c for c in self.schema.names if c != self.key]
        new = rows.select(F.col(self.key), *[F.col(c).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_there"))
        joined = old.withColumn("_was", F.lit(True)).join(new, self.key, "left" if partial else "full")
        taken = [(F.coalesce(f"_new_{c}", c) if partial else F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c))).alias(c) for c in rest]
        return self._changed(base, folders, touched, joined.select(self.key, *taken))

    def replace(self, keys: DataFrame, rows: DataFrame) -> int:
        """All rows of the keys go, and ``rows``, which are of these keys, come."""
        base, folders = self._now()
        keys = keys.select(self.key).distinct()
        strange = rows.join(keys, self.key, "left_anti")
        if not strange.isEmpty():
            raise ValueError("rows of keys that are not replaced")
        touched = self._touched(keys)
        kept = self._rows(folders, touched).join(keys, self.key, "left_anti")
        return self._changed(base, folders, touched, kept.select(*self.schema.names).unionByName(rows.select(*self.schema.names)))

    def delete(self, keys: DataFrame) -> int:
        """All rows of the keys go."""
        return self.replace(keys, self.spark.createDataFrame([], self.schema))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` versions, and the folders that none of those names; returns the folders. Not
        while a change is under way."""
        kept = self.versions()[-keep:]
        live = {name for v in {0, *kept} if v in self.versions() for names in self._state(v)["folders"].values() for name in names}
        for v in self.versions():
            if v not in kept and v:  # the first describes the table
                self.fs.delete(self._at(f"versions/{v:012d}.json"), False)
        data = self._at("data")
        found = [f.getPath().getName() for f in self.fs.listStatus(data)] if self.fs.exists(data) else []
        gone = [n for n in found if n not in live]
        for name in gone:
            self.fs.delete(self._at(f"data/{name}"), True)
        return gone
