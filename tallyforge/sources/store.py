"""Where tables live: upserts, load manifest, dead letters, archives and ordered refreshes."""

from __future__ import annotations

import json
import os
import uuid
import zipfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.sources.delimited import plain_path


def upserted(old: DataFrame | None, new: DataFrame, key: Sequence[str], sequence: str, update: bool = True) -> DataFrame:
    """old with new's rows put in by key; of several new rows with a key the last by ``sequence`` counts.

    Without key the rows are appended. With update=False existing keys stay as they
    are. New columns are null in old rows. The result is one plan: union and one
    window per key.
    """
    if not key:
        new = new.drop(sequence)
        return new if old is None else old.unionByName(new, allowMissingColumns=True)
    rows = new.withColumn("_tf_age", F.lit(1))
    if old is not None:
        rows = rows.unionByName(old.withColumns({"_tf_age": F.lit(0), sequence: F.lit(None).cast(dict(new.dtypes)[sequence])}), allowMissingColumns=True)
    first = F.col("_tf_age").desc() if update else F.col("_tf_age").asc()
    w = Window.partitionBy(*key).orderBy(first, F.col(sequence).desc_nulls_last())
    return rows.withColumn("_tf_rank", F.row_number().over(w)).where("_tf_rank = 1").drop("_tf_rank", "_tf_age", sequence)


class Snapshots:
    """Parquet tables in numbered snapshots on any file system Spark can write to; a refresh never touches what readers read.

    Every change writes new files and then a manifest that lists the folders of the
    table, under the next number; a reader takes the newest manifest. A manifest comes
    into being by a rename that fails when its number is taken, so that of two writers
    one gets an error instead of losing rows. Folders that no manifest names are left
    overs of failed runs and are never read.
    """

    #: Buckets by key of a table that is changed in part.
    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _newest(self, name: str) -> tuple[int, dict]:
        """The number and content of the newest manifest, (0, {}) without one."""
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return 0, {}
        found = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        numbers = [int(f[1:-5]) for f in found if f.startswith("m") and f.endswith(".json")]
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._path(f"{self.root}/{name}/m{max(numbers):06d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)

    def _publish(self, name: str, number: int, manifest: dict) -> None:
        draft = self._path(f"{self.root}/{name}/.draft-{uuid.uuid4()}")
        out = self._fs.create(draft)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        target = self._path(f"{self.root}/{name}/m{number:06d}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{name} was changed by another writer")

    def current(self, name: str) -> DataFrame | None:
        return self._read(name, self._newest(name)[1].get("parts", []))

    def _read(self, name: str, parts: Sequence[str]) -> DataFrame | None:
        if not parts:
            return None
        return self.spark.read.option("mergeSchema", len(parts) > 1).parquet(*[f"{self.root}/{name}/{p}" for p in parts])

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> DataFrame:
        """A whole new snapshot, sorted within files so that row-group statistics can skip."""
        number = self._newest(name)[0] + 1
        version = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
        writer = (df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/{version}")
        self._publish(name, number, {"parts": [version]})
        return self.current(name)

    def change(self, name: str, new: DataFrame, key: Sequence[str], merged: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
        """Puts new rows into the table by merged(old or None, new), rewriting only the buckets whose keys they have.

        The table lies in BUCKETS folders by the hash of its key; only those that new
        rows fall into are read and written, the others stay where they are. A table
        that was written whole is put into buckets by the first change.
        """
        number, manifest = self._newest(name)
        number += 1
        count = manifest.get("buckets") or self.BUCKETS
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(count)).cast("int")
        parts = {int(p.rsplit("=", 1)[1]): p for p in manifest["parts"]} if manifest.get("buckets") else {}
        if parts:
            touched = sorted(r["b"] for r in new.select(bucket.alias("b")).distinct().collect())  # at most BUCKETS numbers
            old = self._read(name, [parts[b] for b in touched if b in parts])
        else:
            old = self._read(name, manifest.get("parts", []))
        rows = merged(old, new)
        version = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("_tf_bucket", bucket).repartition("_tf_bucket").write.partitionBy("_tf_bucket").parquet(f"{self.root}/{name}/{version}")
        written = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/{name}/{version}")) if f.isDirectory()]
        parts |= {int(w.rsplit("=", 1)[1]): f"{version}/{w}" for w in written}
        if not parts:
            return self.write(name, rows)
        self._publish(name, number, {"parts": [parts[b] for b in sorted(parts)], "buckets": count})
        return self.current(name)

    def upsert(self, name: str, new: DataFrame, key: Sequence[str], sequence: str, update: bool = True) -> DataFrame:
        """upserted() in place; without key the rows are added to the table."""
        if not key:
            return self.add(name, new.drop(sequence))
        return self.change(name, new, key, lambda old, rows: upserted(old, rows, key, sequence, update))

    def add(self, name: str, new: DataFrame) -> DataFrame:
        """Rows below those the table has, which stay where they are."""
        number, manifest = self._newest(name)
        number += 1
        version = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
        new.write.parquet(f"{self.root}/{name}/{version}")
        self._publish(name, number, {"parts": [*manifest.get("parts", []), version]})
        return self.current(name)

    def refresh(self, jobs: Sequence[tuple[str, Callable[[], DataFrame]]]) -> None:
        """Stored views in the order in which they build on one another."""
        for name, build in jobs:
            self.write(name, build())


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, file_hash, bytes): SHA-256 of every file, computed where the files are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(plain_path(F.col("path")).alias("source_file"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("bytes"))


def files_to_load(found: DataFrame, manifest: DataFrame, table_name: str, source: str) -> DataFrame:
    """The files whose content was not yet loaded with success into the table (its name in any case)."""
    done = manifest.where((F.lower("table_name") == table_name.lower()) & (F.col("source") == source) & (F.col("rows_processed") > 0)).select("file_hash").distinct()
    return found.join(done, "file_hash", "left_anti")


def dead_letters(rejects: DataFrame, table_name: str, error: str, source_file: str) -> DataFrame:
    """(table_name, row_data, error_message, source_file): rejected rows as JSON."""
    rest = [c for c in rejects.columns if c not in (error, source_file)]
    return rejects.select(F.lit(table_name).alias("table_name"), F.to_json(F.struct(*rest)).alias("row_data"), F.col(error).alias("error_message"), F.col(source_file).alias("source_file"))


def with_deltas(base: DataFrame, inserts: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """A table after its delta files: deleted keys gone, inserted rows added."""
    return base.join(deletes.select(key).distinct(), key, "left_anti").unionByName(inserts, allowMissingColumns=True)


def archive_members(path: str, suffix: str = ".tsv") -> list[str]:
    """The members of a zip archive with a suffix, in any case."""
    with zipfile.ZipFile(path) as z:
        return sorted(n for n in z.namelist() if n.lower().endswith(suffix))


def extract_member(path: str, wanted: str, folder: str, spark: SparkSession | None = None) -> str:
    """Extracts a member by its exact name, by the end of its path, or with .txt added; returns the file.

    With spark, folder is any folder that Spark can write to, so that executors read the
    member from where it is put; without, it is a local one.
    """
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        hit = next((n for w in (wanted, wanted + ".txt") for n in names if n == w or n.lower().endswith("/" + w.lower())), None)
        if hit is None:
            raise FileNotFoundError(f"{wanted} is not in {path}")
        target = os.path.join(folder, os.path.basename(hit))
        if spark is None:
            os.makedirs(folder, exist_ok=True)
            out = open(target, "wb")
        else:
            place = spark._jvm.org.apache.hadoop.fs.Path(target)
            out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
        try:
            with z.open(hit) as src:
                while part := src.read(1 << 20):
                    out.write(part if spark is None else bytearray(part))
        finally:
            out.close()
    return target


def local_files(root: str, suffix: str = ".tsv") -> list[str]:
    """Files with a suffix, in any case, in root or else in its DATA folder."""
    for d in (root, os.path.join(root, "DATA")):
        if os.path.isdir(d) and (found := sorted(os.path.join(d, f) for f in os.listdir(d) if f.lower().endswith(suffix))):
            return found
    return []
