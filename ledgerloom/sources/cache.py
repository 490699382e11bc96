"""Loads and results kept on shared storage: found again by what the files hold, published whole or not at all."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.loader import LoadResult, load_file


def listing(spark: SparkSession, path: str) -> list[list]:
    """Path, length and time of change (microseconds) of each file under ``path``; contents stay unread."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.unix_micros("modificationTime").alias("t"))
    return sorted([r.path, r.length, r.t] for r in files.collect())


def content_digest(spark: SparkSession, path: str) -> str:
    """What the files under ``path`` hold, whatever their names and times: digests of all blocks, added up in any order, so every
    split is read by its own task. A block is what lies between two line feeds, with the place where its split begins."""
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("v"), F.col("_metadata.file_block_start").alias("at"))
    h = [F.xxhash64("v", "at", F.lit(i)) for i in range(2)]
    s = lines.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("v")), F.lit(0)).alias("size"), *[F.sum(x.cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i, x in enumerate(h)], *[F.bit_xor(x).alias(f"x{i}") for i, x in enumerate(h)]).first()
    return hashlib.sha256(json.dumps(list(s)).encode()).hexdigest()


def key_of(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class TableCache:
    """A folder that all executors share. An entry is a folder with the table as Parquet and a manifest; it is written under a name
    of its own and renamed when it is whole, so readers see all of it or nothing. Of two writers the first stays."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _manifest(self, name: str) -> dict | None:
        if not self._fs.exists(self._at(f"{name}/manifest")):
            return None
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/{name}/manifest").collect()))

    def _publish(self, name: str, df: DataFrame, manifest: dict) -> None:
        mine = f"_writing-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{mine}/table")
        self._note(mine, manifest)
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(mine), self._at(name)):
            self._fs.delete(self._at(mine), True)

    def _note(self, name: str, manifest: dict) -> None:
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}/manifest")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/table")

    def load(self, path: str, **options) -> LoadResult:
        """``load_file``, or what an earlier call has kept. Files that are listed as before (path, length, time) are not read at all;
        if they are listed otherwise, their content decides. Failed loads are not kept."""
        seen = f"seen-{key_of(listing(self.spark, path), options)}" if _there(self.spark, path) else None
        if seen is None:
            return load_file(self.spark, path, **options)
        noted = self._manifest(seen)
        name = noted["entry"] if noted else f"load-{key_of(content_digest(self.spark, path), path.rpartition('.')[2].lower(), options)}"
        manifest = self._manifest(name)
        if manifest is None:
            made = load_file(self.spark, path, **options)
            if not made.success:
                return made
            self._publish(name, made.df, {"file_type": made.file_type, "metadata": made.metadata})
            manifest = self._manifest(name)
        if noted is None:
            self._note(seen, {"entry": name})
        return LoadResult(path, self._table(name), manifest["file_type"], {**manifest["metadata"], "cache_entry": name})

    def result(self, analysis: str, inputs: list[LoadResult | str], make: Callable[[], DataFrame], **parameters) -> DataFrame:
        """The table that ``make`` gives, made once for the analysis, its inputs (loads of this cache, or texts that tell their state) and parameters."""
        name = f"result-{key_of(analysis, [x if isinstance(x, str) else x.metadata['cache_entry'] for x in inputs], parameters)}"
        if self._manifest(name) is None:
            self._publish(name, make(), {"analysis": analysis, "parameters": {k: str(v) for k, v in parameters.items()}})
        return self._table(name)

    def entries(self) -> DataFrame:
        """name, kind, files, bytes of each entry."""
        rows = []
        if self._fs.exists(self._at("")):
            for s in self._fs.listStatus(self._at("")):
                name, size = s.getPath().getName(), self._fs.getContentSummary(s.getPath())
                if name.partition("-")[0] in ("load", "result"):
                    rows.append((name, name.partition("-")[0], size.getFileCount(), size.getLength()))
        return self.spark.createDataFrame(rows, "name string, kind string, files long, bytes long")

    def clear(self) -> None:
        self._fs.delete(self._at(""), True)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
