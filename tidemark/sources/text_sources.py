"""Reading TXT, CSV and paged files into source units, and writing an index.

PDF text needs a reader of pages that this package doesn't bring; any function from bytes to blocks can be given.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import NumericType, StringType, StructType

from tidemark.functions import text as T

ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb18030", "latin-1")
SUFFIXES = ("txt", "csv", "pdf")


@pandas_udf(StringType())
def decoded(contents: pd.Series) -> pd.Series:
    """Bytes as text by the first encoding that fits, with any line end as a line feed."""

    def decode(content: bytes | None) -> str | None:
        for encoding in ENCODINGS if content is not None else ():
            try:
                return content.decode(encoding).replace("\r\n", "\n").replace("\r", "\n")
            except UnicodeDecodeError:
                continue
        return None

    return contents.map(decode)


def files(spark: SparkSession, path: str) -> DataFrame:
    """file_name, suffix, content, sha256, modified of the files below a path whose suffix is known."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = raw.select(name.alias("file_name"), F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1)).alias("suffix"), "content", F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))
    return rows.where(F.col("suffix").isin(*SUFFIXES))


def document_ids(rows: DataFrame) -> DataFrame:
    """rows (file_name, sha256) with document_id: the first 16 digits of a hash of both."""
    return rows.withColumn("document_id", F.substring(F.sha1(F.concat_ws(":", "sha256", "file_name")), 1, 16))


def txt_units(found: DataFrame) -> DataFrame:
    """A unit for each text file that has text: document_id, file_name, unit, text, source_type."""
    text = T.normalized(F.regexp_replace(decoded("content"), r"^\s+|\s+$", ""))
    rows = document_ids(found.where("suffix = 'txt'")).select("document_id", "file_name", F.lit(0).cast("bigint").alias("unit"), text.alias("text"), F.lit("txt").alias("source_type"))
    return rows.where("text <> ''")


def _json(name: str, numeric: bool) -> Column:
    """A column as a JSON value: numbers bare, all else quoted, nulls as the empty string."""
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    quoted = F.to_json(F.array(text))
    quoted = F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)
    return F.when(F.col(name).isNull(), F.lit('""')).otherwise(F.col(name).cast("string")) if numeric else quoted


def csv_text(file_name: Column, row_no: Column, schema: StructType) -> Column:
    """The text of a CSV row: file, column names, the row as JSON, and as name: value pairs; nulls are empty."""
    fields = [(f.name, isinstance(f.dataType, NumericType)) for f in schema.fields]
    row = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ": "), _json(n, numeric)) for n, numeric in fields]), F.lit("}"))
    pairs = F.concat_ws(" | ", *[F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n, _ in fields])
    names = " | ".join(n for n, _ in fields)
    return F.concat(F.lit("CSV 文件："), file_name, F.lit(f"\n列名：{names}\n第 "), row_no.cast("string"), F.lit(" 行："), row, F.lit("\nMarkdown 视图："), pairs)


def csv_units(spark: SparkSession, path: str, file_name: str) -> DataFrame:
    """A unit for each row of a CSV file, in its order.

    One file's rows are numbered in one task, as any reader of one file would; many files are read one by one.
    """
    rows = spark.read.option("header", "true").option("inferSchema", "true").option("multiLine", "true").option("escape", '"').csv(path)
    numbered = rows.withColumn("_n", F.monotonically_increasing_id()).withColumn("unit", F.row_number().over(Window.orderBy("_n")).cast("bigint"))
    return numbered.select(F.lit(file_name).alias("file_name"), "unit", csv_text(F.lit(file_name), F.col("unit"), rows.schema).alias("text"), F.lit("csv").alias("source_type"))


def _csv_rows(name: str, content: bytes) -> Iterator[tuple[int, str]]:
    """Row numbers and texts of a CSV file, as csv_text makes them; a column of numbers alone is bare, no file is an error."""
    text = next((t for e in ENCODINGS if (t := _decoded(content, e)) is not None), None)
    header, *rows = (list(csv.reader(io.StringIO(text.removeprefix("\ufeff")))) if text else []) or [[]]
    rows = [r + [""] * (len(header) - len(r)) for r in rows if r]
    numbers = [_numbers([r[k] for r in rows]) for k in range(len(header))]
    for n, row in enumerate(rows):
        shown = [str(numbers[k][n]) if numbers[k] and row[k] != "" else row[k] for k in range(len(header))]
        told = [shown[k] if numbers[k] and row[k] != "" else json.dumps(shown[k], ensure_ascii=False) for k in range(len(header))]
        as_json = ", ".join(f"{json.dumps(c, ensure_ascii=False)}: {v}" for c, v in zip(header, told, strict=True))
        pairs = " | ".join(f"{c}: {v}" for c, v in zip(header, shown, strict=True))
        yield n, f"CSV 文件：{name}\n列名：{' | '.join(header)}\n第 {n + 1} 行：{{{as_json}}}\nMarkdown 视图：{pairs}"


def _decoded(content: bytes, encoding: str) -> str | None:
    try:
        return content.decode(encoding)
    except UnicodeDecodeError:
        return None


def _numbers(values: list[str]) -> list | None:
    """The values as whole numbers, or as others, where all that aren't empty are such; else None."""
    for kind in (int, float):
        try:
            return [kind(v) if v else None for v in values] if any(values) else None
        except ValueError:
            continue
    return None


def csv_file_units(found: DataFrame) -> DataFrame:
    """A unit for each row of every CSV file among found, in any of the known encodings: document_id, file_name, unit, text, source_type.

    A file is read where it is, by one task; files are the unit of parallelism.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, name, content in zip(frame["document_id"], frame["file_name"], frame["content"], strict=True):
                rows = list(_csv_rows(name, content))
                yield pd.DataFrame({"document_id": d, "file_name": name, "unit": [n for n, _ in rows], "text": [t for _, t in rows], "source_type": "csv"}, columns=["document_id", "file_name", "unit", "text", "source_type"])

    rows = document_ids(found.where("suffix = 'csv'")).select("document_id", "file_name", "content")
    return rows.mapInPandas(run, "document_id string, file_name string, unit bigint, text string, source_type string")


BLOCKS = "page int, page_count int, page_width double, page_height double, x0 double, y0 double, x1 double, y1 double, text string, ocr boolean"


def page_blocks(found: DataFrame, read: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """file_name and the blocks that read gives for each PDF's bytes, made where the file is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        for frame in frames:
            rows = [{"file_name": n} | b for n, c in zip(frame["file_name"], frame["content"], strict=True) for b in read(c)]
            yield pd.DataFrame(rows, columns=["file_name", *names])

    return found.where("suffix = 'pdf'").select("file_name", "content").mapInPandas(run, f"file_name string, {BLOCKS}")


def paged_units(blocks: DataFrame) -> DataFrame:
    """Blocks of pages as units: margins and useless blocks left out, in reading order, each after a mark of its page.

    A page whose native text has fewer than OCR's characters takes those of OCR.
    """
    from tidemark.operators.structure import reading_order

    text = T.normalized(F.col("text"))
    rows = blocks.withColumn("text", text).where(T.is_useful(F.col("text")) & ~T.is_margin(F.col("text"), F.col("y0"), F.col("y1"), F.col("page_height"), F.col("page"), F.col("page_count")))
    size = F.char_length(F.regexp_replace("text", r"\s+", ""))
    page = Window.partitionBy("file_name", "page")
    native, ocr = F.sum(F.when(~F.col("ocr"), size)).over(page), F.sum(F.when(F.col("ocr"), size)).over(page)
    rows = rows.withColumn("_ocr", F.coalesce(ocr, F.lit(0)) > F.coalesce(native, F.lit(0))).where(F.col("ocr") == F.col("_ocr"))
    ordered = reading_order(rows.withColumns({"_page": F.col("page"), "page": F.concat_ws("#", "file_name", F.col("page").cast("string"))}))
    unit = F.row_number().over(Window.partitionBy("file_name").orderBy("_page", "block_no")) - 1
    return ordered.select("file_name", unit.cast("bigint").alias("unit"), F.col("_page").alias("page"), "page_count", F.col("block_no").alias("page_block_index"), "ocr", F.concat(F.lit("第 "), F.col("_page").cast("string"), F.lit(" 页\n\n"), F.col("text")).alias("text"))

