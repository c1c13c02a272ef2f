"""Structure of files: positions of their units, sections, segments, navigation windows and cards.

A unit is a row of (document_id, unit, text) where unit counts from 0 within its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

# The name of text without a heading, explicit headings, marks of pages.
BODY = "正文"
HEADING = r"(?i)^(第[一二三四五六七八九十百\d]+[章节条]|CHAPTER\s+\w+|PART\s+\w+|#{1,6}\s+|\d+(?:\.\d+)+)"
PAGE_MARK = r"^第\s*\d+\s*页(?:（OCR 识别）)?$"
#: A heading repeated within fewer units is a page header; one repeated after at least as many restarts the structure.
REPEAT_UNITS = 3
WINDOW_UNITS, SHORT_SEGMENT = 4, 8


def numbered_units(docs: DataFrame, file: str, order: str, text: str = "text") -> DataFrame:
    """document_id, unit, text, n_units: rows of a file in order, those without text left out.

    Rows of one file meet in one task, as its units need an order; files are the unit of parallelism.
    """
    kept = docs.where(F.btrim(F.coalesce(F.col(text), F.lit(""))) != "")
    by_file = Window.partitionBy(file)
    return kept.select(F.col(file).alias("document_id"), (F.row_number().over(by_file.orderBy(order)) - 1).cast("bigint").alias("unit"), F.col(order).alias("unit_key"), F.col(text).alias("text"), F.count("*").over(by_file).alias("n_units"))


def with_position(units: DataFrame) -> DataFrame:
    ratio = F.round(F.col("unit") / F.greatest(F.col("n_units") - 1, F.lit(1)), 6)
    return units.withColumn("position", ratio).withColumn("region", T.region_of(F.col("position")))


def heading_of(text: Column, block_index: Column | None = None) -> Column:
    """A unit's heading or the empty string: an explicit one, or a short first line without punctuation."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~x.rlike(PAGE_MARK))
    at_top = F.lit(True) if block_index is None else F.coalesce(block_index, F.lit(0)) == 0

    def heading(first: Column) -> Column:
        tight = F.regexp_replace(first, r"\s+", "")
        standalone = F.char_length(tight).between(2, 52) & ~tight.rlike("[。！？!?；;，,：:]") & first.rlike(r"^[A-Za-z0-9一-鿿·・•《》()（）\-—_ ]+$") & at_top
        return F.when(first.rlike(HEADING) | standalone, F.left(first, F.lit(120))).otherwise(F.lit(""))

    return T.let(F.coalesce(F.get(lines, 0), F.lit("")), heading)


def sections(units: DataFrame) -> DataFrame:
    """document_id, section, section_id, title, start_unit, end_unit from the units' headings.

    Of headings with the same key only one counts until REPEAT_UNITS units after the last that did; another key between
    them starts anew. The fold is over one file's headings alone. Units before the first heading are the body; a file
    without headings is one section.
    """
    heads = units.select("document_id", "unit", "n_units", heading_of(F.col("text")).alias("title")).where("title <> ''")
    heads = heads.withColumn("key", T.entity_key(F.col("title")))
    per_file = heads.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("unit", "key", "title"))).alias("h"))
    none = F.struct(F.lit(-REPEAT_UNITS).cast("bigint").alias("unit"), F.lit("").alias("key"), F.array().cast("array<struct<unit:bigint,key:string,title:string>>").alias("kept"))

    def accept(a: Column, h: Column) -> Column:
        repeat = (h["key"] == a["key"]) & (F.size(a["kept"]) > 0) & (h["unit"] - a["unit"] < REPEAT_UNITS)
        taken = F.struct(h["unit"].alias("unit"), h["key"].alias("key"), F.concat(a["kept"], F.array(h)).alias("kept"))
        return F.when(repeat, a).otherwise(taken)

    kept = per_file.select("document_id", F.explode(F.aggregate("h", none, accept, lambda a: a["kept"])).alias("h")).select("document_id", F.col("h.unit").alias("start_unit"), "h.title")
    files = units.groupBy("document_id").agg(F.first("n_units").alias("n_units"))
    body = files.join(kept.where("start_unit = 0").select("document_id"), "document_id", "left_anti").select("document_id", F.lit(0).cast("bigint").alias("start_unit"), F.lit(BODY).alias("title"))
    by_file = Window.partitionBy("document_id").orderBy("start_unit")
    out = kept.unionByName(body).join(files, "document_id").withColumns({"section": (F.row_number().over(by_file) - 1).cast("bigint"), "end_unit": (F.lead("start_unit").over(by_file) - 1)})
    has_heads = F.count("*").over(Window.partitionBy("document_id")) > 1
    out = out.withColumn("end_unit", F.coalesce("end_unit", F.col("n_units") - 1)).withColumn("alone", ~has_heads & (F.col("title") == BODY))
    named = F.concat_ws(":", F.lit("section"), F.col("section").cast("string"), F.when(T.entity_key(F.col("title")) == "", "untitled").otherwise(T.entity_key(F.col("title"))))
    return out.select("document_id", "section", F.when(F.col("alone"), "section:root").otherwise(named).alias("section_id"), "title", "start_unit", "end_unit", "n_units")


def segments(found: DataFrame) -> DataFrame:
    """document_id, segment_id, start_unit, end_unit: a file starts anew where a section's title comes back after REPEAT_UNITS units or more."""
    by_title = Window.partitionBy("document_id", "key").orderBy("start_unit")
    by_file = Window.partitionBy("document_id").orderBy("start_unit")
    keyed = found.withColumn("key", T.entity_key(F.col("title"))).withColumn("before", F.lag("start_unit").over(by_title))
    starts = keyed.where((F.col("start_unit") == 0) | ((F.col("key") != "") & (F.col("start_unit") - F.col("before") >= REPEAT_UNITS)))
    starts = starts.groupBy("document_id", "start_unit").agg(F.first("n_units").alias("n_units"), F.min_by("title", "section").alias("label"))
    return starts.select("document_id", F.concat(F.lit("segment:"), (F.row_number().over(by_file) - 1).cast("string")).alias("segment_id"), "label", "start_unit", F.coalesce(F.lead("start_unit").over(by_file) - 1, F.col("n_units") - 1).alias("end_unit"), "n_units")


def navigation_windows(found: DataFrame) -> DataFrame:
    """Count windows over the units of each segment: four units every two, all of a short segment, and one at its end."""
    span = F.col("end_unit") - F.col("start_unit") + 1
    size = F.when(span >= SHORT_SEGMENT, F.lit(WINDOW_UNITS).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), span))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("size") / 2))
    last = F.greatest(F.col("end_unit") - F.col("size") + 1, F.col("start_unit"))
    starts = F.array_sort(F.array_distinct(F.concat(F.sequence("start_unit", last, step), F.array(last))))
    rows = found.withColumn("size", size).select("*", F.explode(starts).alias("window_start")).withColumn("window_end", F.least("end_unit", F.col("window_start") + F.col("size") - 1))
    middle = (F.col("window_start") + F.col("window_end")) / 2
    inner = (middle - F.col("start_unit")) / F.greatest(F.col("end_unit") - F.col("start_unit"), F.lit(1))
    rows = rows.withColumns({"position": F.round(middle / F.greatest(F.col("n_units") - 1, F.lit(1)), 6), "segment_position": F.round(inner, 6), "region": T.region_of(inner)})
    kind = F.when(F.col("region") == "terminal", "terminal_window").otherwise("navigation_window")
    ids = F.concat_ws(":", F.col("document_id"), F.lit("w"), F.col("window_start").cast("string"), F.col("window_end").cast("string"))
    return rows.select("document_id", ids.alias("chunk_id"), kind.alias("kind"), "segment_id", "window_start", "window_end", "position", "segment_position", "region")


def spans_with_text(spans: DataFrame, units: DataFrame, start: str, end: str, key: str, head: int, tail: int) -> DataFrame:
    """spans with excerpt: their units' texts in order, two line feeds between, bounded to head and tail.

    Spans are short, so they are exploded to units and meet the texts by an equality join. A span with a unit that is longer than
    the bound is cut, so of such a unit only what can be within either end is moved, and just enough that the span is still cut.
    """
    cells = spans.select("document_id", key, F.explode(F.sequence(start, end)).alias("unit"))
    ends = lambda t: F.when(F.char_length(t) <= head + tail + T.SLACK, t).otherwise(F.concat(F.left(t, F.lit(head + T.SLACK + 1)), F.right(t, F.lit(tail))))
    texts = cells.join(units.select("document_id", "unit", T.let(F.btrim("text"), ends).alias("t")), ["document_id", "unit"])
    joined = texts.groupBy("document_id", key).agg(F.array_sort(F.collect_list(F.struct("unit", "t"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: x["t"]), "\n\n")
    return spans.join(joined.select("document_id", key, T.bounded_excerpt(whole, head, tail).alias("excerpt")), ["document_id", key])


def section_cards(found: DataFrame, units: DataFrame) -> DataFrame:
    """A card for each section: title, place and an excerpt of 900 and 700 characters."""
    rows = spans_with_text(found, units, "start_unit", "end_unit", "section", 900, 700)
    place = F.concat(F.lit("来源位置：单元 "), (F.col("start_unit") + 1).cast("string"), F.lit("-"), (F.col("end_unit") + 1).cast("string"), F.lit("/"), F.col("n_units").cast("string"))
    content = F.concat_ws("\n", F.concat(F.lit("文档区段："), F.col("title")), place, F.lit("页码：unknown"), F.concat(F.lit("区段原文摘录：\n"), F.col("excerpt")))
    return rows.select("document_id", F.concat_ws(":", "document_id", "section_id").alias("chunk_id"), F.lit("section_card").alias("kind"), "title", content.alias("content"))


def window_cards(windows: DataFrame, units: DataFrame) -> DataFrame:
    """A card for each navigation window, with an excerpt of 4200 and 2600 characters."""
    rows = spans_with_text(windows, units, "window_start", "window_end", "chunk_id", 4200, 2600)
    content = F.concat_ws("\n", F.lit("文档导航原文窗口"), F.concat(F.lit("结构片段："), F.col("segment_id")), F.concat(F.lit("区域："), F.col("region")), F.concat(F.lit("原文：\n"), F.col("excerpt")))
    return rows.select("document_id", "chunk_id", "kind", "segment_id", "window_start", "window_end", "position", "region", content.alias("content"))


def document_signals(units: DataFrame) -> DataFrame:
    """Type, layout, title, author, date, version and topics of each file, from its first units (eighty for the type)."""
    first = units.where("unit < 80").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("unit", "text"))).alias("u"), F.first("n_units").alias("n_units"))
    texts = F.transform("u", lambda x: x["text"])
    rows = first.select("document_id", "n_units", F.array_join(texts, "\n").alias("sample"), F.array_join(F.slice(texts, 1, 8), "\n").alias("head"))
    sample = F.col("sample")
    tables = sample.contains("|") | sample.contains("\t") | F.lower(sample).rlike("(列名|表格|table)")
    code = sample.contains("```") | sample.rlike(r"\b(def|class|import|function|const|let|var)\b")
    parts = sample.rlike(r"(?m)(第[一二三四五六七八九十百\d]+[章节条]|^\s*\d+(?:\.\d+)+)")
    rows = rows.withColumns({
        "document_type": T.document_type(sample, F.lower("document_id")), "has_tables": tables, "has_code": code, "has_sections": parts,
        "layout": F.when(tables, "table_heavy").when(code, "mixed").otherwise("text"),
        "title": T.infer_title(F.col("head"), F.col("document_id")), "author": T.infer_author(F.col("head")), "date": T.infer_date(F.col("head")), "version": T.infer_version(F.col("head")),
    })
    return rows.withColumn("topics", T.topics_of(F.col("head"), F.col("title"))).drop("sample", "head")


def document_cards(signals: DataFrame) -> DataFrame:
    unknown = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "unknown").otherwise(F.col(c))
    content = F.concat_ws(
        "\n", F.concat(F.lit("文档标题："), "title"), F.concat(F.lit("原始文件名："), "document_id"), F.concat(F.lit("作者/发布方："), unknown("author")), F.concat(F.lit("文档类型："), "document_type"),
        F.concat(F.lit("版本/日期："), unknown("version"), F.lit(" "), "date"), F.concat(F.lit("主题："), F.array_join("topics", "、")), F.lit("页数：unknown"), F.lit("证据页码：unknown"),
    )
    return signals.select("document_id", F.concat_ws(":", "document_id", F.lit("card")).alias("chunk_id"), F.lit("document_card").alias("kind"), "title", content.alias("content"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks (page, page_width, x0, y0, x1, y1, ...) with block_no: by column, then down, where a page looks like two columns."""
    centre = (F.col("x0") + F.col("x1")) / 2
    page = Window.partitionBy("page")
    two = (F.count_if(centre < F.col("page_width") * 0.48).over(page) >= 2) & (F.count_if(centre > F.col("page_width") * 0.52).over(page) >= 2)
    column = F.when(two & (centre >= F.col("page_width") / 2), 1).otherwise(0)
    order = Window.partitionBy("page").orderBy("_column", "y0", "x0")
    return blocks.withColumn("_column", column).withColumn("block_no", F.row_number().over(order) - 1).drop("_column")
