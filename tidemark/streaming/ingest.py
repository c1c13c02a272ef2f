"""Ingesting files as they arrive: a stream of a landing folder, each micro-batch replacing its documents in the index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import engine
from tidemark.config import EngineConfig
from tidemark.sources.index_store import exists
from tidemark.sources.text_sources import csv_file_units, document_ids, page_blocks, paged_units, txt_units

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
PdfReader = Callable[[bytes], Iterator[dict]]


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(name.alias("file_name"), F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1)).alias("suffix"), "content", F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def units_of(found: DataFrame, read_pdf: PdfReader | None = None) -> DataFrame:
    """document_id, file_name, unit, text, n_units of TXT and CSV files and, with a reader of their pages, PDF files."""
    parts = [txt_units(found), csv_file_units(found)]
    if read_pdf is not None:
        names = document_ids(found.where("suffix = 'pdf'")).select("file_name", "document_id")
        parts.append(paged_units(page_blocks(found, read_pdf)).join(names, "file_name"))
    kept = ["document_id", "file_name", "unit", "text"]
    rows = parts[0].select(*kept)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*kept))
    return rows.withColumn("n_units", F.count("*").over(Window.partitionBy("document_id")))


def index_batch(batch: DataFrame, index_path: str, config: EngineConfig | None = None, read_pdf: PdfReader | None = None) -> None:
    """The files of a batch in the index, in place of what it holds of the same documents; a batch that runs again changes nothing."""
    if batch.isEmpty():
        return
    new = engine.build_index(units_of(batch, read_pdf), config)
    if exists(batch.sparkSession, index_path):
        engine.upsert_index(batch.sparkSession, index_path, new)
    else:
        engine.write_index(new, index_path)


def ingest(spark: SparkSession, landing: str, index_path: str, checkpoint: str, config: EngineConfig | None = None, read_pdf: PdfReader | None = None) -> StreamingQuery:
    """Index what lies in the landing folder and has not been seen by this checkpoint, then stop; engine.read_index reads the index."""
    run = lambda batch, _: index_batch(batch, index_path, config, read_pdf)
    return file_stream(spark, landing).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
