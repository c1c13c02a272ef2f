"""What a text offers as evidence: named tests, their coverage, and the order that they suggest; quality of content."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

# Patterns by requirement, over file, title, section, kind and text; case is ignored.
PATTERNS = {
    "relation_statement": r"(朋友|伙伴|同伴|父亲|母亲|兄弟|姐妹|同学|同事|关系|一起|共同|陪同|friend|companion|partner|father|mother|relationship|with)",
    "numeric_value": r"(\b\d+(?:[.,]\d+)?\b|[一二三四五六七八九十百千万两]+)",
    "unit_or_context": r"(岁|年龄|年纪|年|月|日|%|％|元|美元|公里|千米|米|数量|金额|比例|percent|percentage|age|years?|amount|count|date)",
    "author_or_publisher": r"(作者|著|译|出版社|出版|发布|author|publisher|issued by|translated by)",
    "code_symbol": r"(\b[A-Za-z_][A-Za-z0-9_]*\(|\bclass\s+\w+|\bdef\s+\w+|api|参数|函数|类)",
    "definition_or_callsite": r"(def |class |function|调用|定义|参数|returns?|raises?)",
    "clause_reference": r"(第\s*[一二三四五六七八九十百\d]+\s*条|\b\d+(?:\.\d+)+\b|clause|section)",
    "table_header_context": r"(列名|表头|字段|header|column|row|\|)",
}
IDENTITY = r"(是|为|叫|名叫|称为|被称为|指的是|属于|protagonist|character|is a|was a|known as|refers to)"
LOCATION_CONTEXT = r"(在|到|去|来|抵达|前往|离开|旅行|游历|位于|发生于|where|located|arrived|travel|visited|went to)"
FRONT_MATTER = r"(图书在版|CIP|ISBN|版权|出版社|出版|作者|译者|发布方|目录|前言|序言|metadata|copyright|publisher|author)"
TRAVEL = r"(去|到|来到|抵达|前往|驶向|进入|离开|旅行|游历|周游|访问|经过)"
PLACES = [
    r"[一-鿿]{1,8}(国|州|省|市|县|镇|村|岛|港|湾|海|洋|河|湖|山|谷|洞|城|堡|宫|馆|营|要塞|战壕|工场)",
    r"(国家|地区|城市|小镇|村庄|岛屿|港口|海岸|海峡|大陆|山洞|月亮|月球|太阳|地下|海底)",
    r"[A-Z][A-Za-z]{2,}(?:\s+[A-Z][A-Za-z]{2,}){0,3}",
]
IMPRINT = r"(?i)图书在版|CIP|ISBN|责任编辑|出版社|作者介绍|目录|目次|CONTENTS|版权|前言|序言|附录|编者|本书人物原型"
ASKS_IMPRINT = r"(作者|出版社|出版|ISBN|目录|前言|序|附录|编者)"
CHAPTER = r"(?i)第\s*[一二三四五六七八九十百\d]+\s*[章节回]|chapter"


def tests(searchable: Column, text: Column, kind: Column, focus: Column) -> dict[str, Column]:
    """Requirement to condition; focus is an array of compact terms."""
    has = lambda pattern: searchable.rlike("(?i)" + pattern)
    squeezed = T.compact(searchable)
    focused = (F.size(focus) == 0) | F.exists(focus, lambda t: (t != "") & F.contains(squeezed, t))
    names = F.array_union(F.regexp_extract_all(searchable, F.lit(r"[一-鿿]{2,8}(?:·[一-鿿]{1,8})?"), F.lit(0)), F.regexp_extract_all(searchable, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b"), F.lit(0)))
    places = squeezed.rlike(TRAVEL) | squeezed.rlike(PLACES[0]) | squeezed.rlike(PLACES[1]) | squeezed.rlike(PLACES[2])
    size = F.char_length(F.btrim(text))
    return {name: has(p) for name, p in PATTERNS.items()} | {
        "target_entity": focused, "identity_statement": focused & has(IDENTITY), "related_entity": focused & (F.size(names) >= 2), "location_name": places, "movement_or_location_context": places | has(LOCATION_CONTEXT),
        "source_metadata": kind.isin("document_card", "metadata") | has(FRONT_MATTER), "clause_text": size >= 60, "table_cell_or_row": (kind == "table_card") | text.contains("|") | text.contains("\t"), "answer_statement": size >= 40,
    }


def by_requirements(results: DataFrame, required: Iterable[str]) -> DataFrame:
    """results (query_id, rank, file_name, title, section_path, kind, text, score, focus) with coverage, covered and new_rank.

    Coverage of the requirements leads, 0.08 for focus and 0.05 of the score follow; rank tells ties.
    """
    names = list(dict.fromkeys(required))
    searchable = F.concat_ws(" ", "file_name", "title", "section_path", "kind", "text")
    rows = results.withColumn("_s", searchable)
    found = tests(F.col("_s"), F.col("text"), F.col("kind"), F.col("focus"))
    covered = F.filter(F.array(*[F.when(found[n], F.lit(n)) for n in names if n in found]), lambda x: x.isNotNull())
    bonus = F.when(found["target_entity"] & (F.size("focus") > 0), 0.08).otherwise(0.0)
    rows = rows.withColumns({"covered": covered, "_b": bonus}).withColumn("coverage", F.round(F.size("covered") / F.lit(max(len(names), 1)), 4))
    rows = rows.withColumn("prior", F.round(F.col("coverage") + F.col("_b") + F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)) * 0.05, 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("prior"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order)).drop("_s", "_b")


def keyword_overlap(query_tokens: Column, text: Column) -> Column:
    """The share of a query's tokens among the tokens of a text."""
    return F.when(F.size(query_tokens) > 0, F.size(F.array_intersect(query_tokens, T.search_tokens(text))) / F.greatest(F.size(query_tokens), F.lit(1))).otherwise(F.lit(0.0))


def content_quality(file_name: Column, text: Column, page: Column, query: Column, focus: Column) -> Column:
    """A factor of scores: focus held or not, very short texts, imprints, first pages, chapters."""
    source = T.compact(F.concat_ws(" ", file_name, text))
    held = F.when(F.size(focus) == 0, 1.0).when(F.exists(focus, lambda t: F.contains(source, t)), 1.12).otherwise(0.28)
    short = F.when(F.char_length(F.btrim(text)) < 80, 0.65).otherwise(1.0)
    first = F.coalesce(page <= 12, F.lit(False))
    imprint = F.when(query.rlike(ASKS_IMPRINT), 1.0).when(text.rlike(IMPRINT), F.when(first, 0.45).otherwise(0.7)).when(first, 0.75).otherwise(1.0)
    return held * short * imprint * F.when(text.rlike(CHAPTER), 1.04).otherwise(1.0)


def source_bundle(text: Column, most: int, anchors: Column, gap: int = 24, glue: str = "\n[…]\n") -> Column:
    """Spans of a long text within a budget: around the first three anchors found, and four evenly spaced ones.

    Spans that lie within a gap of each other become one; a short text stays whole.
    """
    budget = max(240, most)
    width = max(150, min(420, budget // 4))

    def bundle(value: Column) -> Column:
        n = F.char_length(value)
        span = lambda left: F.struct(F.greatest(F.lit(0), F.least(n, F.greatest(F.lit(0), left) + width) - width).cast("int").alias("a"), F.least(n, F.greatest(F.lit(0), left) + width).cast("int").alias("b"))
        at = lambda t: F.position(F.lower(t), F.lower(value)) - 1
        held = F.slice(F.filter(F.transform(F.filter(anchors, lambda t: F.char_length(F.btrim(t)) >= 2), lambda t: F.struct(at(F.btrim(t)).alias("p"), F.char_length(F.btrim(t)).alias("n"))), lambda x: x["p"] >= 0), 1, 3)
        around = F.transform(held, lambda x: span(x["p"] + F.shiftright(x["n"], 1) - width // 2))
        even = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: span(F.floor((n - width) * i / F.lit(3)).cast("int")))
        none = F.array().cast("array<struct<a:int,b:int>>")

        def merge(done: Column, x: Column) -> Column:
            last = F.try_element_at(done, F.lit(-1))
            apart = (F.size(done) == 0) | (x["a"] > last["b"] + gap)
            joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
            return F.when(apart, F.concat(done, F.array(x))).otherwise(joined)

        merged = F.aggregate(F.array_sort(F.concat(around, even)), none, merge)
        snippets = F.filter(F.transform(merged, lambda x: F.btrim(F.substring(value, x["a"] + 1, x["b"] - x["a"]))), lambda s: s != "")
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).alias("used"), F.lit(False).alias("full"))

        def take(a: Column, s: Column) -> Column:
            size = F.char_length(s) + F.when(F.size(a["done"]) > 0, 7).otherwise(0)
            rest = budget - a["used"] - 7
            fits = a["used"] + size <= budget
            out = lambda done, used, full: F.struct(done.alias("done"), used.cast("int").alias("used"), full.alias("full"))
            cut = F.when(rest >= 100, F.concat(a["done"], F.array(F.rtrim(F.left(s, F.greatest(rest, F.lit(0))))))).otherwise(a["done"])
            return F.when(a["full"], a).when(fits, out(F.concat(a["done"], F.array(s)), a["used"] + size, a["used"] + size >= budget)).otherwise(out(cut, a["used"], F.lit(True)))

        return F.when(n <= budget, value).otherwise(F.aggregate(snippets, start, take, lambda a: F.array_join(a["done"], glue)))

    return T.let(F.btrim(F.coalesce(text, F.lit(""))), bundle)
