"""A keyed table in versioned files: rows are replaced by key, and a version counts once its manifest is written.

Rows lie in a fixed number of buckets by the hash of their keys, one folder each. A write makes new folders for the buckets
it touches, out of the old rows it does not replace and the new ones, and then a manifest that names the folder of every
bucket. Readers follow the newest manifest; whatever a failed write leaves behind is in no manifest. Two writers that start
from the same version cannot both finish: the second finds its manifest taken and fails.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "store_bucket"


class KeyedStore:
    """``keys`` are unique in the table: (section), (project, section, kind), whatever tells rows of one owner apart."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._text = jvm.org.apache.commons.io.IOUtils

    # manifests

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> dict | None:
        """The newest version, or the given one: its number, schema, bucket count and folder per bucket."""
        numbers = self._numbers()
        if not numbers or (number is not None and number not in numbers):
            return None
        source = self._files.open(self._path(f"{self.path}/manifests/{number if number is not None else numbers[-1]:09d}.json"))
        try:
            return json.loads(self._text.toString(source, "UTF-8"))
        finally:
            source.close()

    def _commit(self, manifest: dict) -> None:
        """The manifest appears under its final name whole or not at all."""
        final = self._path(f"{self.path}/manifests/{manifest['number']:09d}.json")
        draft = self._path(f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError(f"version {manifest['number']} of {self.path} was written by somebody else")

    # rows

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(buckets)).cast("int")

    def read(self, number: int | None = None, **keys) -> DataFrame:
        """Rows of the newest (or given) version; where all keys are named only their bucket is read."""
        found = self.manifest(number)
        if found is None:
            raise FileNotFoundError(f"no version of {self.path}")
        schema, folders = StructType.fromJson(found["schema"]), found["folders"]
        if set(keys) == set(self.keys):
            one = self.spark.range(1).select(*[F.lit(keys[k]).alias(k) for k in self.keys]).select(self._bucket(found["buckets"])).first()[0]
            folders = {b: f for b, f in folders.items() if int(b) == one}
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders.values()]) if folders else self.spark.createDataFrame([], schema)
        for name, value in keys.items():
            rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
        return rows

    def replace(self, rows: DataFrame, before_commit: Callable[[], None] | None = None) -> int:
        """Rows of the keys in ``rows`` take the place of what the table holds for them; returns the new version's number.

        Columns missing in ``rows`` become null, new columns are null in older rows. ``before_commit`` runs between the
        writing of the files and of the manifest."""
        old = self.manifest()
        buckets = old["buckets"] if old else self.buckets
        folders = dict(old["folders"]) if old else {}
        new = rows.withColumn(BUCKET, self._bucket(buckets))
        touched = {str(r[0]) for r in new.select(BUCKET).distinct().collect()}  # at most as many as buckets
        kept = {b: f for b, f in folders.items() if b in touched}
        merged = new
        if kept:
            before = self.spark.read.schema(StructType.fromJson(old["schema"])).parquet(*[f"{self.path}/{f}" for f in kept.values()]).withColumn(BUCKET, self._bucket(buckets))
            named = new.select(BUCKET, *[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
            stays = before.alias("o").join(named.alias("n"), [F.col(f"o.{BUCKET}") == F.col(f"n.{BUCKET}"), *same], "left_anti")
            merged = stays.unionByName(new, allowMissingColumns=True)
        version = f"data/{uuid.uuid4().hex}"
        merged.repartition(max(1, len(touched)), BUCKET).sortWithinPartitions(BUCKET, *self.keys).write.partitionBy(BUCKET).parquet(f"{self.path}/{version}")
        folders |= {b: f"{version}/{BUCKET}={b}" for b in touched}
        if before_commit:
            before_commit()
        schema = merged.drop(BUCKET).schema
        if old:  # buckets that were not touched may hold columns the new rows lack, and the other way round
            known = {f.name for f in schema.fields}
            schema = StructType([*schema.fields, *[f for f in StructType.fromJson(old["schema"]).fields if f.name not in known]])
        number = (old["number"] if old else 0) + 1
        self._commit({"number": number, "buckets": buckets, "schema": json.loads(schema.json()), "folders": folders})
        return number

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the newest ``keep`` and the files no kept one names; not to be run beside a writer.
        Returns how many version folders went."""
        numbers = self._numbers()
        for n in numbers[:-keep]:
            self._files.delete(self._path(f"{self.path}/manifests/{n:09d}.json"), False)
        alive = {f.split("/")[1] for n in numbers[-keep:] for f in self.manifest(n)["folders"].values()}
        data, gone = self._path(f"{self.path}/data"), 0
        for status in self._files.listStatus(data) if self._files.exists(data) else []:
            if status.getPath().getName() not in alive:
                self._files.delete(status.getPath(), True)
                gone += 1
        return gone
