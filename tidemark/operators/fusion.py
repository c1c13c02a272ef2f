"""Fusing channels: weighted reciprocal ranks, anchors, focus, diversity, reserved places, parents and the context budget.

Hits are rows of (query_id, channel, rank, chunk_id); fused lists rows of (query_id, rank, chunk_id, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import pairs

RRF_K, FUSED_ROWS = 60, 96
NEAR_DUPLICATE, NEAR_CHARS = 0.82, 500
# Channel weights by operation or intent.
WEIGHTS = {
    "enumerate": {"exact_entity": 1.0, "structured": 1.0, "lexical": 1.0, "dense_original_query": 1.25, "dense_evidence_view": 1.2, "navigation": 1.45, "coverage_dense_navigation": 1.5},
    "entity": {"exact_entity": 2.0, "structured": 1.6, "lexical": 1.2, "dense_original_query": 1.0, "dense_entity_alias": 0.8, "dense_generic_intent": 0.7, "dense_llm_variant": 0.7, "navigation": 2.2},
    "survey": {"dense_original_query": 1.3, "structured": 1.2, "lexical": 0.9, "exact_entity": 0.6, "navigation": 2.0},
    "location": {"exact_entity": 1.7, "structured": 1.3, "lexical": 1.2, "dense_original_query": 1.0, "dense_generic_intent": 0.8, "dense_llm_variant": 0.7, "navigation": 1.7},
    "code": {"exact_entity": 2.0, "structured": 1.6, "lexical": 1.3, "dense_original_query": 0.8, "navigation": 1.7},
    "default": {"exact_entity": 1.4, "structured": 1.2, "lexical": 1.1, "dense_original_query": 1.0, "dense_generic_intent": 0.8, "dense_llm_variant": 0.7, "navigation": 2.3},
}
INTENT_PROFILE = {"entity_definition": "entity", "entity_relation": "entity", "document_summary": "survey", "comparison": "survey", "procedure": "survey", "location_lookup": "location", "code_question": "code"}
# What a kind of record counts in the choice of an anchor.
ANCHOR_WEIGHTS = {"child": 1.0, "parent": 0.95, "navigation_window": 0.92, "terminal_window": 0.92, "section_card": 0.78, "entity_card": 0.72, "document_card": 0.55}


def weight_profile(intent: str, operation: str = "lookup") -> dict[str, float]:
    return WEIGHTS["enumerate" if operation == "enumerate" else INTENT_PROFILE.get(intent, "default")]


def channel_weight(channel: Column, profile: dict[str, float]) -> Column:
    """The weight of a channel: by name, by a listed name that it begins with, as navigation, as dense, else 1."""
    ladder = F.coalesce(*[F.when(channel == k, F.lit(w)) for k, w in profile.items()], *[F.when(channel.startswith(k), F.lit(w)) for k, w in profile.items()])
    other = F.when(channel.contains("navigation"), F.lit(profile.get("navigation", 1.9))).when(channel.startswith("dense"), F.lit(0.8)).otherwise(F.lit(1.0))
    return F.coalesce(ladder, other)


def weighted_rrf(hits: DataFrame, profile: dict[str, float], limit: int = FUSED_ROWS, k: int = RRF_K) -> DataFrame:
    """query_id, rank, chunk_id, score, channels: sums of weight over k + rank; ties by chunk."""
    part = channel_weight(F.col("channel"), profile) / (F.lit(k) + F.col("rank"))
    fused = hits.withColumn("part", part).groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def anchors(hits: DataFrame, top: int = 24) -> DataFrame:
    """query_id, document_id, segment_id, score: the span that most channels agree on (hits carry kind, document_id, segment_id).

    Spans with a segment come before documents without one; a further channel adds 0.08.
    """
    weight = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in ANCHOR_WEIGHTS.items()], F.lit(0.65))
    rows = hits.where((F.col("rank") <= top) & (F.coalesce(F.col("document_id"), F.lit("")) != "")).withColumn("segment_id", F.coalesce("segment_id", F.lit("")))
    spans = rows.groupBy("query_id", "document_id", "segment_id").agg(F.sum(weight / (F.col("rank") + 3)).alias("s"), F.countDistinct("channel").alias("channels"))
    spans = spans.withColumn("score", F.round(F.col("s") + 0.08 * F.col("channels"), 6))
    order = Window.partitionBy("query_id").orderBy((F.col("segment_id") == "").cast("int"), F.desc("score"), F.desc("channels"), "document_id", "segment_id")
    return spans.withColumn("n", F.row_number().over(order)).where("n = 1").select("query_id", "document_id", "segment_id", "score", "channels")


def focus_guard(ranked: DataFrame, top_k: int = 6) -> DataFrame:
    """ranked (query_id, rank, chunk_id, anchored, focused) reordered: anchored, focused, then a tail of min(3, top_k // 2) others.

    Where nothing is anchored or focused the order stays. Columns tier and new_rank are appended.
    """
    tier = F.when(F.col("anchored"), 0).when(F.col("focused"), 1).otherwise(2)
    by_query = Window.partitionBy("query_id")
    rows = ranked.withColumn("tier", tier).withColumn("any", F.min("tier").over(by_query) < 2)
    rows = rows.withColumn("in_tier", F.row_number().over(Window.partitionBy("query_id", "tier").orderBy("rank")))
    rows = rows.where(~F.col("any") | (F.col("tier") < 2) | (F.col("in_tier") <= min(3, max(0, top_k // 2))))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("any"), F.col("tier")).otherwise(0), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order)).drop("any", "in_tier")


def matches_focus(source: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: (t != "") & F.contains(T.compact(source), t))


def diversified(ranked: DataFrame, k: int, location: list[str]) -> DataFrame:
    """k rows of each query: the first of each location in order, then others in order."""
    first = F.row_number().over(Window.partitionBy("query_id", *location).orderBy("rank")) == 1
    rows = ranked.withColumn("repeat", (~first).cast("int"))
    order = Window.partitionBy("query_id").orderBy("repeat", "rank")
    return rows.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def greedy_distinct(ranked: DataFrame, k: int, text: str = "text", location: str = "location") -> DataFrame:
    """query_id, picks: up to k chunks of each query, in order, none at a location or like a text already taken; then back-filled.

    A fold over the at most FUSED_ROWS rows that a fused list of one query has.
    """
    tokens = T.search_tokens(F.left(F.coalesce(F.col(text), F.lit("")), F.lit(NEAR_CHARS)))
    lists = ranked.where(F.col("rank") <= FUSED_ROWS).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.col(location).cast("string").alias("loc"), tokens.alias("t")))).alias("all"))
    item = "struct<rank:int,chunk_id:string,loc:string,t:array<string>>"
    start = F.array().cast(f"array<{item}>")
    cast = lambda x: F.struct(x["rank"].cast("int").alias("rank"), x["chunk_id"].cast("string").alias("chunk_id"), x["loc"].alias("loc"), x["t"].alias("t"))

    def take(a: Column, x: Column) -> Column:
        alike = F.exists(a, lambda y: (F.coalesce(y["loc"], F.lit("")) == F.coalesce(x["loc"], F.lit(""))) | (overlap(x["t"], y["t"]) >= NEAR_DUPLICATE))
        return F.when((F.size(a) >= k) | alike, a).otherwise(F.concat(a, F.array(x)))

    rows = lists.withColumn("all", F.transform("all", cast)).withColumn("picks", F.transform(F.aggregate("all", start, take), lambda x: x["chunk_id"]))
    rest = F.array_except(F.transform("all", lambda x: x["chunk_id"]), F.col("picks"))
    return rows.select("query_id", F.slice(F.concat("picks", rest), 1, k).alias("picks"))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller of two sets of tokens; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1))).otherwise(F.lit(0.0))


def near_duplicates(rows: DataFrame, id_col: str, group: str, least: float = NEAR_DUPLICATE, text: str = "text") -> DataFrame:
    """Pairs of rows of one group whose first 500 characters' token sets overlap by at least the given share of the smaller.

    A file's rows are dealt to blocks of a bounded number of rows, and each pair of its blocks is one task, in which a prefix filter
    on rare tokens finds the pairs: candidates never leave it, and a row is moved once for each block of its file.
    """
    tokens = T.search_tokens(F.left(F.coalesce(F.col(text), F.lit("")), F.lit(NEAR_CHARS)))
    held = rows.where(F.col(id_col).isNotNull() & F.col(group).isNotNull())
    blocks = held.groupBy(F.col(group).alias("g")).agg(F.ceil(F.count("*") / pairs.BLOCK_SETS).cast("int").alias("blocks"))
    sets = held.select(F.col(id_col).alias("id"), F.col(group).alias("g"), tokens.alias("t")).join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = sets.select("id", "g", "t", "block", other).select("id", "g", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "t")
    kind = dealt.schema["id"].dataType.simpleString()
    found = dealt.groupBy("g", "low", "high").applyInArrow(pairs.overlapping(least), f"x {kind}, y {kind}, overlap double")
    return found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("overlap", 6).alias("overlap"))


def reserved_places(ranked: DataFrame, navigation: DataFrame, k: int, coverage: bool = False, places: int | None = None) -> DataFrame:
    """k rows of each query of which min(max(2, or 3 for coverage, (n + 1) // 2), n) go to navigation's chunks first; n is places, or k."""
    n = places or k
    reserve = min(max(3 if coverage else 2, (n + 1) // 2), n)
    marked = ranked.join(navigation.select("query_id", "chunk_id").distinct().withColumn("nav", F.lit(True)), ["query_id", "chunk_id"], "left").withColumn("nav", F.coalesce("nav", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("query_id", "nav").orderBy("rank"))
    pinned = F.col("nav") & (place <= reserve)
    rows = marked.withColumn("pinned", pinned).where("pinned OR NOT nav")
    order = Window.partitionBy("query_id").orderBy(F.col("pinned").desc(), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).drop("nav")


# Kinds of records that are source text.
SOURCE_KINDS = ["navigation_window", "terminal_window", "child", "parent"]


def enumeration_pool(candidates: DataFrame, navigation: DataFrame, k: int) -> DataFrame:
    """query_id, rank, chunk_id: source records of both lists (query_id, rank, chunk_id, kind, position), candidates first, spread over positions.

    A chunk counts once; the first of each of min(8, max(3, k // 4)) position bins leads, then the lists' order goes on.
    """
    names = ["query_id", "rank", "chunk_id", "kind", "position"]
    both = candidates.select(*names, F.lit(0).alias("src")).unionByName(navigation.select(*names, F.lit(1).alias("src"))).where(F.col("kind").isin(*SOURCE_KINDS))
    once = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("src", "rank")).alias("o"), F.first("position", ignorenulls=True).alias("position"))
    bins = min(8, max(3, k // 4))
    place = F.least(F.lit(bins - 1), F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("position", F.lit(0.5)))) * bins))
    rows = once.withColumns({"bin": place, "few": F.count("*").over(Window.partitionBy("query_id")) <= k})
    head = F.row_number().over(Window.partitionBy("query_id", "bin").orderBy("o", "chunk_id")) == 1
    tier = F.when(F.col("few") | ~F.col("head"), 1).otherwise(0)
    order = Window.partitionBy("query_id").orderBy(tier, F.when(tier == 0, F.col("bin")), "o", "chunk_id")
    return rows.withColumn("head", head).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id")


def with_parent_text(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children (parent_id, text, ...) with source_text: the parent's text where there is one that isn't empty."""
    held = parents.select(F.col("parent_id"), F.col("parent_text").alias("_p"))
    return children.join(held, "parent_id", "left").withColumn("source_text", F.coalesce(F.nullif("_p", F.lit("")), "text")).drop("_p")


def context_budget(blocks: DataFrame, budget: int, least_rest: int = 160) -> DataFrame:
    """Blocks of each query in order until the budget of characters is used; the one that crosses it is cut if 160 are left, else goes."""
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = blocks.withColumn("n", F.char_length("block")).withColumn("before", F.sum("n").over(order) - F.col("n"))
    rest = F.lit(budget) - F.col("before")
    cut = F.concat(F.rtrim(F.left("block", F.greatest(rest, F.lit(0)).cast("int"))), F.lit("…"))
    kept = rows.where((F.col("n") <= rest) | ((rest >= least_rest) & (rest < F.col("n"))))
    # nothing follows a block that crosses the budget
    kept = kept.withColumn("used", F.when(F.col("n") <= rest, F.col("block")).otherwise(cut))
    return kept.where(F.col("before") < budget).select("query_id", "rank", "used", F.col("before").cast("bigint").alias("before"))


def channel_agreement(hits: DataFrame) -> DataFrame:
    """query_id, agreeing: chunks among the first 8 exact hits that are among the first 12 lexical or structured ones."""
    exact = hits.where("channel = 'exact_entity' AND rank <= 8").select("query_id", "chunk_id")
    others = hits.where("channel IN ('lexical', 'structured') AND rank <= 12").select("query_id", "chunk_id")
    return exact.intersect(others).groupBy("query_id").agg(F.count("*").alias("agreeing"))


def hybrid_score(vector: Column, keyword: Column, evidence: Column, vector_rank: Column, keyword_rank: Column, multiplier: Column) -> Column:
    """0.42 vector + 0.34 keyword + 0.18 evidence + 0.06 min(30 x reciprocal ranks, 1), times a multiplier, within 0 and 1."""
    one = lambda r: F.when(r > 0, 1.0 / (F.lit(RRF_K) + r)).otherwise(F.lit(0.0))
    ranks = F.least((F.coalesce(one(vector_rank), F.lit(0.0)) + F.coalesce(one(keyword_rank), F.lit(0.0))) * 30.0, F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.42 * vector + 0.34 * keyword + 0.18 * evidence + 0.06 * ranks) * multiplier))
