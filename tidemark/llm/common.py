"""What the corpus operators share: words, table reading, hashing to (0, 1), Arrow batches and row filters by text."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import BATCH_ROWS, dropped, small_batches, stored as written  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, even where the body uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key's text alone; DuckDB: (('0x' || md5(..)[1:13])::BIGINT + 0.5) / 2^52."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def fold(key: str, parts: int) -> Column:
    """crc32 of the key's text, modulo parts; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


#: Rows of a part of a batch whose texts are Python strings at once.
SLICE_ROWS = 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices without copies; at the end what the task has freed goes back to the machine."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)
    release_memory()


def release_memory() -> None:
    """Workers live on between tasks; allocators would keep what they have freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def kept_by_text(docs: DataFrame, keeps: Callable[[list], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of docs whose text a function of a batch of texts keeps; each row goes through Python once."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(keeps(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
