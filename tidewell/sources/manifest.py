"""Keyed tables of Parquet files that change as a whole or not at all.

Rows are dealt to buckets by a hash of their keys.  An update writes new files for
the buckets it touches, beside the old ones, and then publishes a manifest that names
the folder of each bucket.  A manifest appears by a rename that fails if its number is
taken, so readers see the table before or after an update, and of two writers one
starts over.  A manifest also holds the last batch of each writer: an update that is
run again after a crash changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.staging import staged

RETRIES = 5


class Conflict(RuntimeError):
    """Another writer published the version that this one was about to publish."""


class Folder:
    """Files of a folder in whatever store Spark reads, through Hadoop's file contexts."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.spark, self._hadoop = path.rstrip("/"), spark, spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._system = self._at("").getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._system.getUri(), conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._system.listStatus(self._at(""))] if self._system.exists(self._at("")) else []

    def read(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def publish(self, name: str, text: str) -> None:
        """Write a whole file under a name that must not exist."""
        draft = f".draft-{uuid.uuid4().hex}"
        out = self._system.create(self._at(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        option = self._hadoop.Options.Rename
        options = self.spark._sc._gateway.new_array(option, 1)
        options[0] = option.NONE
        try:
            self._context.rename(self._at(draft), self._at(name), options)
        except Py4JJavaError as e:
            self._system.delete(self._at(draft), False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self._system.delete(self._at(name), True)


@dataclass
class Manifest:
    version: int = 0
    buckets: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class KeyedTable:
    """A table at ``path`` with one row for each value of ``keys``; null is a value like others."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16):
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.folder = Folder(spark, path)

    def manifest(self, version: int | None = None) -> Manifest:
        """The last manifest, or that of a version; version 0 is the empty table."""
        if version is None:
            version = max((int(n[9:-5]) for n in self.folder.names() if n.startswith("manifest-")), default=0)
        return Manifest(**json.loads(self.folder.read(f"manifest-{version:012d}.json"))) if version else Manifest()

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version).buckets.values())

    def _rows(self, folders) -> DataFrame:
        paths = [f"{self.folder.path}/{f}" for f in sorted(set(folders))]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        named = [F.coalesce(F.col(k).cast("string"), F.lit("\x00null")) for k in self.keys]
        return F.pmod(F.xxhash64(*named), F.lit(self.buckets)).cast("int")

    def update(self, make_changes, writer: str | None = None, batch: int | None = None) -> bool:
        """Put in the rows of ``make_changes(table)``, which replace those of equal keys; whether anything was done.

        The rows are made from the table as it stands and made again if another writer
        comes first.  Of several rows with equal keys the largest stays.  A batch that
        its writer has put in before is not put in again.
        """
        for _ in range(RETRIES):
            now = self.manifest()
            if writer is not None and batch is not None and now.batches.get(writer, -1) >= batch:
                return False
            values = [c for c in self.schema.names if c not in self.keys]
            rows = make_changes(self._rows(now.buckets.values())).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))
            one = rows.groupBy(*self.keys).agg(F.max(F.struct(*values)).alias("_values")).select(*self.keys, "_values.*").select(*self.schema.names)
            changes = staged(one.withColumn("_bucket", self._bucket()))
            touched = sorted(r[0] for r in changes.select("_bucket").distinct().collect())
            after = Manifest(now.version + 1, dict(now.buckets), now.batches | ({writer: batch} if writer is not None and batch is not None else {}))
            if touched:
                old = self._rows(f for b, f in now.buckets.items() if int(b) in touched)
                renamed = changes.select(*(F.col(k).alias(f"_k_{k}") for k in self.keys))
                kept = old.join(renamed, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys], "left_anti").withColumn("_bucket", self._bucket())
                data = f"data-{after.version:012d}-{uuid.uuid4().hex}"
                kept.unionByName(changes).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder.path}/{data}")
                after.buckets |= {str(b): f"{data}/_bucket={b}" for b in touched}
            elif after.batches == now.batches:
                return False
            try:
                self.folder.publish(f"manifest-{after.version:012d}.json", json.dumps(after.__dict__))
                return True
            except Conflict:
                if touched:
                    self.folder.delete(data)
        raise Conflict(f"{RETRIES} other writers came first")

    def clean(self, keep: int = 2) -> int:
        """Delete the files that none of the last ``keep`` versions names; how many folders went."""
        last = self.manifest().version
        held = {f.split("/")[0] for v in range(max(1, last - keep + 1), last + 1) for f in self.manifest(v).buckets.values()}
        gone = [n for n in self.folder.names() if n.startswith("data-") and n not in held and int(n.split("-")[1]) <= last]
        for name in gone:
            self.folder.delete(name)
        return len(gone)
