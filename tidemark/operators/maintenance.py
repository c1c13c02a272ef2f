"""Keeping an index: deduplication of files, listing, deletion, replacement, inventories, and stored conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of_each_content(files: DataFrame, name: str, content: str) -> DataFrame:
    """One row for each content by its sha256: the first by name, with the number of copies.

    Minima are formed map-side, so a content with very many copies meets nowhere.
    """
    hashed = files.select(F.col(name).alias("name"), F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.min("name").alias("name"), F.count("*").alias("copies"))


def file_listing(chunks: DataFrame) -> DataFrame:
    """For each file of chunks (file_name, upload_time, page, row_index, source_type, unit): counts, latest time, first type; newest first."""
    return chunks.groupBy("file_name").agg(
        F.count("*").alias("chunks"), F.max("upload_time").alias("upload_time"), F.countDistinct("page").alias("pages"), F.countDistinct("row_index").alias("rows"), F.min_by("source_type", "unit").alias("source_type")
    ).orderBy(F.desc("upload_time"), F.desc("file_name"))


def navigation_inventory(windows: DataFrame) -> DataFrame:
    """Number of windows and range of positions by document, kind and region."""
    return windows.groupBy("document_id", "kind", "region").agg(F.count("*").alias("windows"), F.min("position").alias("min_position"), F.max("position").alias("max_position"), F.min("window_start").alias("first_unit"), F.max("window_end").alias("last_unit"))


def document_outline(cards: DataFrame, limit: int = 80) -> DataFrame:
    """The first section cards of each document."""
    order = Window.partitionBy("document_id").orderBy("chunk_id")
    return cards.where("kind = 'section_card'").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def without_files(rows: DataFrame, files: DataFrame, key: str = "file_name") -> DataFrame:
    """rows but for those of the given files."""
    return rows.join(files.select(key).distinct(), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old with its rows replaced by rows of new with the same keys; of repeated new rows the last by order counts.

    Stored rows are never sorted: they are only held against the keys of the new ones.
    """
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    row = F.struct(*new.columns)
    last = new.groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("_row")).select("_row.*")
    return kept.unionByName(last.select(*old.columns))


def index_compatibility(meta: DataFrame, expected: dict[str, str]) -> DataFrame:
    """key, expected, found, ok for version stamps of an index (meta: key, value)."""
    wanted = meta.sparkSession.createDataFrame(list(expected.items()), "key string, expected string")
    return wanted.join(meta.select("key", F.col("value").alias("found")), "key", "left").withColumn("ok", F.col("expected").eqNullSafe(F.col("found")))


def last_turns(messages: DataFrame, role: str, n: int) -> DataFrame:
    """The last n messages of a role in each conversation; only they are kept on the way, however long it is."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.where(F.col("role") == role).withColumn("back", last).where(F.col("back") <= n)


def conversation_titles(messages: DataFrame, chars: int = 18, untitled: str = "新对话") -> DataFrame:
    """conv_id, title: the beginning of the first user message with text, marked where it is cut."""
    text = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    first = messages.withColumn("t", text).where("role = 'user' AND t <> ''").groupBy("conv_id").agg(F.min_by("t", "turn").alias("t"))
    named = first.select("conv_id", F.when(F.char_length("t") > chars, F.concat(F.left("t", F.lit(chars)), F.lit("..."))).otherwise(F.col("t")).alias("title"))
    return messages.select("conv_id").distinct().join(named, "conv_id", "left").select("conv_id", F.coalesce("title", F.lit(untitled)).alias("title"))


def trimmed_store(messages: DataFrame, conversations: int = 80, per_conversation: int = 120) -> DataFrame:
    """The newest conversations (by greatest turn time, here conv_id) with their last messages."""
    newest = messages.select("conv_id").distinct().orderBy(F.desc("conv_id")).limit(conversations)
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.join(F.broadcast(newest), "conv_id").withColumn("back", last).where(F.col("back") <= per_conversation)


def flattened_metadata(rows: DataFrame, column: str) -> DataFrame:
    """key, value of a map<string, variant>-like struct column's entries as scalars: complex values as JSON, nulls and NaN left out."""
    return rows.select("*", F.explode(F.map_entries(column)).alias("e")).where("e.value IS NOT NULL").select(*[c for c in rows.columns if c != column], "e.key", "e.value").where("lower(value) NOT IN ('nan', 'inf', '-inf', 'infinity', '-infinity')")
