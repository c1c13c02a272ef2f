"""Tables of an index as buckets of documents: a version of a bucket is written once and never altered, a manifest says which count.

A replacement writes new versions of the buckets that hold the documents and then swaps the manifest, so a reader keeps
what it has begun with, a table may be written to the place that it is read from, and a failure leaves the old index.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new index; a replacement rewrites those that hold one of its documents.
BUCKETS = 64
MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    manifest, fs = _fs(spark, f"{path}/{MANIFEST}")
    return fs.exists(manifest)


def _manifest(spark: SparkSession, path: str) -> dict:
    if not exists(spark, path):
        raise FileNotFoundError(f"no index in {path}")
    return json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])


def _swap(spark: SparkSession, path: str, manifest: dict) -> None:
    new, fs = _fs(spark, f"{path}/{MANIFEST}.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(json.dumps(manifest).encode())
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    overwrite[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(new, _fs(spark, f"{path}/{MANIFEST}")[0], overwrite)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")


def _written(spark: SparkSession, table: DataFrame, path: str, buckets: int, order: list[str]) -> dict[str, str]:
    """Bucket to folder, below path, of the rows of a table; large buckets are split over tasks as they come."""
    version = f"v-{uuid.uuid4().hex}"
    rows = table.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
    rows.write.partitionBy("bucket").parquet(f"{path}/{version}")
    folder, fs = _fs(spark, f"{path}/{version}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return {n.removeprefix("bucket="): f"{version}/{n}" for n in names if n.startswith("bucket=")}


def _read(spark: SparkSession, path: str, told: dict, buckets: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(told["schema"])
    parts = [f"{path}/{place}" for b, place in sorted(told["parts"].items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def save(tables: dict[str, DataFrame], path: str, order: dict[str, list[str]] | None = None, buckets: int = BUCKETS) -> None:
    """Write tables, each with a column document_id, as the index in path; what they read from there may be replaced by it."""
    spark = next(iter(tables.values())).sparkSession
    found = {n: {"schema": t.schema.jsonValue(), "parts": _written(spark, t, f"{path}/{n}", buckets, (order or {}).get(n, []))} for n, t in tables.items()}
    _swap(spark, path, {"buckets": buckets, "tables": found})


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: _read(spark, f"{path}/{n}", told) for n, told in _manifest(spark, path)["tables"].items()}


def replace_documents(spark: SparkSession, path: str, documents: DataFrame, new: dict[str, DataFrame] | None = None, order: dict[str, list[str]] | None = None) -> None:
    """Take documents (document_id) out of the index and put new's rows in, by writing the buckets of either again."""
    manifest = _manifest(spark, path)
    buckets, new = manifest["buckets"], new or {}
    gone = documents.select("document_id").distinct()
    keys = gone
    for table in new.values():
        keys = keys.union(table.select("document_id").distinct())
    touched = {str(r[0]) for r in keys.select(_bucket(buckets).alias("b")).distinct().collect()}  # as many as buckets at most
    for name, told in manifest["tables"].items():
        kept = _read(spark, f"{path}/{name}", told, touched).join(gone, "document_id", "left_anti")
        rows = kept.unionByName(new[name]) if name in new else kept
        parts = _written(spark, rows.select(*StructType.fromJson(told["schema"]).names), f"{path}/{name}", buckets, (order or {}).get(name, []))
        told["parts"] = {b: p for b, p in told["parts"].items() if b not in touched} | parts
    _swap(spark, path, manifest)


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete versions that no bucket of the manifest is in; readers of earlier manifests must be done."""
    for name, told in _manifest(spark, path)["tables"].items():
        used = {p.split("/")[0] for p in told["parts"].values()}
        folder, fs = _fs(spark, f"{path}/{name}")
        for status in fs.listStatus(folder):
            if status.getPath().getName() not in used:
                fs.delete(status.getPath(), True)
