"""The engine end to end: an index from source units, and batches of questions through all channels to cited context.

An index is a set of tables; write_index and read_index keep them as Parquet. Questions are rows of (query_id, text), and
may carry terms, an array of names to look for.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import EngineConfig
from tidemark.functions import text as T
from tidemark.functions.embedding import hashed_embedding
from tidemark.operators import chunking, entities, fusion, maintenance, metrics, search, structure
from tidemark.plans import evidence, focus, policy
from tidemark.plans.prompt import messages
from tidemark.plans.query_plan import Planner, QueryPlan, candidate_budget, channel_limits, is_deep, rerank_budget, variant_limit
from tidemark.sources import index_store
from tidemark.sources.tables import spread, stored

# Version stamps of an index.
VERSIONS = {"schema": "1", "lexical": "1", "normalization": "1", "structure": "1"}
CHUNK_COLUMNS = ["chunk_id", "document_id", "kind", "title", "section_path", "content", "parent_id", "segment_id", "position", "region", "window_start", "window_end"]


@dataclass(frozen=True)
class Index:
    """chunks: all kinds of records with CHUNK_COLUMNS; parents: parent_id, parent_text; units: unit, text, n_units; and so on.

    Every table but meta has a column document_id, by which documents are replaced and deleted.
    """

    chunks: DataFrame
    parents: DataFrame
    aliases: DataFrame
    postings: DataFrame
    units: DataFrame
    vectors: DataFrame
    meta: DataFrame


def _records(rows: DataFrame) -> DataFrame:
    """rows with all of CHUNK_COLUMNS, null where they have none."""
    kinds = {"position": "double", "window_start": "bigint", "window_end": "bigint"}
    return rows.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) if c in rows.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in CHUNK_COLUMNS])


def build_index(units: DataFrame, config: EngineConfig | None = None, embed: Callable[[Column], Column] | None = None) -> Index:
    """The tables of an index from units (document_id, unit, text, n_units); texts are parsed once for each table that is stored.

    embed makes vectors of a text column; without it tokens are hashed.
    """
    config = config or EngineConfig()
    units = spread(stored(units.select("document_id", "unit", "text", "n_units"), "units"))
    found = stored(structure.sections(units), "sections")
    windows = structure.navigation_windows(structure.segments(found))
    signals = structure.document_signals(units)
    merged = stored(entities.merged_entities(entities.entity_mentions(units)), "entities")
    placed = structure.with_position(units).select("document_id", "unit", "position", "region")
    # a unit's chunks carry its place and its section's title
    spans = found.select("document_id", F.col("title").alias("section_path"), F.explode(F.sequence("start_unit", "end_unit")).alias("unit"))
    children = chunking.chunk_ids(chunking.parent_child_chunks(units.select("document_id", "unit", "text"), parent=config.parent_chars, child=config.child_chars, overlap=config.child_overlap), "document_id", "unit")
    children = stored(children.join(placed, ["document_id", "unit"]).join(spans, ["document_id", "unit"], "left"), "children")
    parents = children.groupBy("document_id", "parent_id").agg(F.first("parent_text").alias("parent_text"))
    title = signals.select("document_id", "title")
    child_rows = children.join(title, "document_id", "left").select("chunk_id", "document_id", F.lit("child").alias("kind"), "title", "section_path", F.col("child_text").alias("content"), "parent_id", "position", "region")
    window_rows = structure.window_cards(windows, units).join(title, "document_id", "left")
    section_rows = structure.section_cards(found, units).withColumn("section_path", F.col("title"))
    document_rows = structure.document_cards(signals)
    entity_text = F.concat(F.lit("实体："), F.col("name"), F.lit("\n实体类型："), F.col("type"), F.lit("\n所属文档："), F.col("document_id"))
    entity_rows = merged.select(F.concat_ws(":", "document_id", F.lit("e"), "key").alias("chunk_id"), "document_id", F.lit("entity_card").alias("kind"), F.col("name").alias("title"), entity_text.alias("content"))
    tables = [child_rows, window_rows, section_rows, document_rows, entity_rows]
    chunks = _records(tables[0])
    for rows in tables[1:]:
        chunks = chunks.unionByName(_records(rows))
    chunks = spread(stored(chunks, "chunks"))
    none = F.array().cast("array<string>")
    named = merged.select("document_id", F.concat_ws(":", "document_id", F.lit("e"), "key").alias("chunk_id"), F.col("type").alias("entity_type"), T.surface_variants(F.col("name")).alias("aliases"), none.alias("exact_terms"))
    files = signals.select("document_id", F.concat_ws(":", "document_id", F.lit("card")).alias("chunk_id"), F.lit("文档").alias("entity_type"), F.concat(T.surface_variants(F.col("title")), T.surface_variants(F.col("document_id"))).alias("aliases"), none.alias("exact_terms"))
    vectors = chunks.where(F.col("kind").isin("child", *search.WINDOW_KINDS)).select("document_id", "kind", "position", F.col("chunk_id").alias("vec_id"), (embed or hashed_embedding)(F.col("content")).alias("embedding"))
    # every channel reads these again, so texts become vectors and tokens once
    vectors = stored(vectors, "vectors")
    spark = units.sparkSession
    postings = search.postings(chunks.withColumn("text", F.concat_ws(" ", "title", "section_path", "content")), "chunk_id", keep=["document_id"])
    postings = stored(postings, "postings")
    aliases = stored(entities.alias_rows(named.unionByName(files), keep=["document_id"]), "aliases")
    return Index(chunks, parents, aliases, postings, units, vectors, spark.createDataFrame(list(VERSIONS.items()), "key string, value string"))


#: Neighbouring terms lie together within a bucket, so a question reads few row groups.
ORDER = {"postings": ["term"], "aliases": ["normalized_name"]}


def _tables(index: Index) -> dict[str, DataFrame]:
    return {f.name: getattr(index, f.name) for f in fields(Index) if f.name != "meta"} | {"meta": index.meta.withColumn("document_id", F.lit(""))}


def write_index(index: Index, path: str, buckets: int = index_store.BUCKETS) -> None:
    """Write all of an index; path may be the one that it was read from."""
    index_store.save(_tables(index), path, ORDER, buckets)


def read_index(spark: SparkSession, path: str) -> Index:
    found = index_store.load(spark, path)
    return Index(**found | {"meta": found["meta"].drop("document_id")})


def upsert_index(spark: SparkSession, path: str, new: Index) -> None:
    """Put the documents of new into the index in path, in place of its own of the same name; only their buckets are written."""
    tables = _tables(new)
    index_store.replace_documents(spark, path, tables["units"].select("document_id").union(tables["meta"].select("document_id")), tables, ORDER)


def delete_documents(spark: SparkSession, path: str, documents: DataFrame) -> None:
    """Take documents (document_id) out of the index in path."""
    index_store.replace_documents(spark, path, documents, order=ORDER)


def reset_index(index: Index, path: str) -> None:
    """Leave an index without documents in path."""
    write_index(Index(**{f.name: getattr(index, f.name).limit(0) if f.name != "meta" else index.meta for f in fields(Index)}), path)


def records(index: Index, wanted: DataFrame) -> DataFrame:
    """The chunks of wanted (chunk_id), each once."""
    return index.chunks.join(search.small(wanted.select("chunk_id").distinct()), "chunk_id", "left_semi")


def compatibility(index: Index) -> DataFrame:
    return maintenance.index_compatibility(index.meta, VERSIONS)


def without_documents(index: Index, documents: DataFrame) -> Index:
    """The index without the given documents (document_id), for deletion or before new rows of them."""
    gone = search.small(documents.select("document_id").distinct())
    return Index(**{f.name: getattr(index, f.name).join(gone, "document_id", "left_anti") if f.name != "meta" else index.meta for f in fields(Index)})


def upsert(index: Index, new: Index) -> Index:
    """The index with the documents of new in place of its own of the same name."""
    kept = without_documents(index, new.units)
    merged = {f.name: getattr(kept, f.name).unionByName(getattr(new, f.name)) for f in fields(Index) if f.name != "meta"}
    return Index(**merged, meta=new.meta)


@dataclass(frozen=True)
class Models:
    """Functions of models, each optional.

    embed makes vectors of a text column; score rates (question, text) pairs; judge takes a question and candidates
    (chunk_id, text) and gives these back with answerability, relevance and judgement, a list of claims, as far as it has
    any. score and judge run on the workers; where they raise an error, the order stays as it was.
    """

    embed: Callable[[Column], Column] = hashed_embedding
    score: Callable[[list[tuple[str, str]]], list[float]] | None = None
    judge: Callable[[str, list[dict]], list[dict]] | None = None


@dataclass(frozen=True)
class Found:
    """results: query_id, rank, chunk_id, score, channels and the chunk's columns; hits: what each channel gave; links: query_id,
    confidence of the names in a question."""

    results: DataFrame
    hits: DataFrame
    links: DataFrame


JUDGED = "query_id {}, chunk_id string, judgement string, answerability double, relevance double"


def _hits(rows: DataFrame, channel: str) -> DataFrame:
    return rows.select("query_id", F.lit(channel).alias("channel"), F.col("rank").cast("int").alias("rank"), "chunk_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def linked_terms(index: Index, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query_id, term of the questions' names and of what they are known as in the index; and the confidence of these links."""
    named = questions.select("query_id", F.posexplode("terms").alias("n", "mention")).withColumn("mention_id", F.concat_ws("#", F.col("query_id").cast("string"), F.col("n").cast("string")))
    links = entities.link_entities(named.select("mention_id", "mention"), index.aliases)
    links = stored(named.select("query_id", "mention_id").join(search.small(stored(links, "links")), "mention_id"), "query-links")
    terms = named.select("query_id", F.col("mention").alias("term")).union(links.select("query_id", F.col("alias").alias("term"))).distinct()
    return terms, entities.link_confidence(links)


def recalled(index: Index, questions: DataFrame, terms: DataFrame, plan: QueryPlan, config: EngineConfig, models: Models) -> DataFrame:
    """Hits of the channels that look at the whole index: lexical, exact, structured, and dense for a question and its variants."""
    limits = channel_limits(candidate_budget(plan, config.top_k, config.candidates))
    hits = [_hits(search.bm25_of_postings(index.postings, questions, limits["lexical"]), "lexical")]
    if config.use_exact:
        hits.append(_hits(entities.exact_search(index.aliases, terms, limits["exact_entity"]), "exact_entity"))
    if config.use_structured:
        hits.append(_hits(search.structured_search(index.chunks, questions, limit=limits["structured"]), "structured"))
    # a variant is a query of its own, so all vectors are compared in one pass
    variants = F.slice(F.coalesce("variants", F.array().cast("array<string>")), 1, variant_limit(plan) - 1) if variant_limit(plan) > 1 else F.array().cast("array<string>")
    asked = questions.select("query_id", F.posexplode(F.concat(F.array("text"), F.filter(variants, lambda v: v != F.col("text")))).alias("n", "t"))
    asked = stored(asked.select(F.struct("query_id", "n").alias("query_id"), models.embed(F.col("t")).alias("embedding")), "question-vectors")
    dense = search.dense_top_k(index.vectors.select("vec_id", "embedding"), asked, limits["dense"], config.metric)
    channel = F.when(F.col("query_id.n") == 0, "dense_original_query").otherwise(F.concat(F.lit("dense_llm_variant_"), F.col("query_id.n").cast("string")))
    hits.append(dense.select("query_id.query_id", channel.alias("channel"), F.col("rank").cast("int").alias("rank"), "chunk_id"))
    return stored(_union(hits), "hits")


def read_windows(index: Index, questions: DataFrame, terms: DataFrame, anchored: DataFrame, plan: QueryPlan, config: EngineConfig, models: Models) -> list[DataFrame]:
    """Hits within the documents that questions are anchored to: windows by words and by place, after those around names, and by vectors."""
    budget, listing = candidate_budget(plan, config.top_k, config.candidates), plan.operation == "enumerate"
    windows = index.chunks.where(F.col("kind").isin(*search.WINDOW_KINDS))
    limit = min(max(24, budget // 2), 48) if listing else min(max(12 if policy.is_fallback(plan) else 6, budget // 3), 32)
    regions = [r for r in plan.read.regions if r != "all"]
    placed = search.navigation_scores(windows, anchored, plan.read.position_bias, regions)
    parts = [search.position_diverse(placed, limit).select("query_id", "rank", "chunk_id", F.lit(1).alias("tier"))]
    names = terms.join(search.small(anchored.select("query_id", "document_id")), "query_id")
    if listing:
        parts.append(search.entity_windows(windows, names, min(max(36, budget), 72)).select("query_id", "rank", "chunk_id", F.lit(0).alias("tier")))
    elif plan.read.need_entity_neighborhood and not policy.is_fallback(plan):
        units = structure.with_position(index.units)
        parts.append(search.terminal_neighbourhood(units, windows, names, limit=min(max(4, budget // 16), 8)).select("query_id", "rank", "chunk_id", F.lit(0).alias("tier")))
    first = _union(parts).groupBy("query_id", "chunk_id").agg(F.min(F.struct("tier", "rank")).alias("o"))
    order = Window.partitionBy("query_id").orderBy("o", "chunk_id")
    hits = [_hits(first.withColumn("rank", F.row_number().over(order)), "navigation")]
    asked = anchored.select("query_id", F.col("document_id").alias("label"), models.embed(F.col("text")).alias("embedding"))
    vectors = index.vectors.where(F.col("kind").isin(*search.WINDOW_KINDS)).select("vec_id", "embedding", F.col("document_id").alias("label"), "position")
    most = min(max(24, budget // 2), 48) if listing else min(max(10, budget // 2), 24)
    dense = search.dense_top_k(vectors, stored(asked, "anchored-vectors"), most if not listing else 160, config.metric)
    if listing:
        dense = search.position_diverse(dense.drop("rank").join(index.vectors.select(F.col("vec_id").alias("chunk_id"), "position"), "chunk_id"), most)
    return [*hits, _hits(dense, "coverage_dense_navigation")]


def _judgements(rows: DataFrame, models: Models, plan: QueryPlan, limit: int) -> DataFrame:
    """query_id, chunk_id and what the judge says of the first candidates of each question; more of them, in batches, where a
    list is asked for and no claim of the first ones counts. A question has FUSED_ROWS candidates at most."""
    judge, listing = models.judge, plan.operation == "enumerate"
    schema = JUDGED.format(rows.schema["query_id"].dataType.simpleString())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        question, pool = frame["question"].iloc[0], frame[["chunk_id", "text"]].to_dict("records")

        def told(candidates: list[dict]) -> list[dict]:
            try:
                return judge(question, candidates)
            except Exception:  # the judge is optional
                return candidates

        qualifies = lambda c: any(x.get("qualifies") and evidence.is_grounded(x.get("excerpt") or "", c["text"]) for x in c.get("judgement") or [])
        found = told(pool[:limit])
        if listing:
            found = evidence.second_pass(found, pool, told, limit, qualifies)
        rows = [(frame["query_id"].iloc[0], c["chunk_id"], json.dumps(c["judgement"], ensure_ascii=False) if c.get("judgement") else None, c.get("answerability"), c.get("relevance")) for c in found]
        return pd.DataFrame(rows, columns=["query_id", "chunk_id", "judgement", "answerability", "relevance"]).astype({"answerability": "float64", "relevance": "float64"})

    return rows.select("query_id", "rank", "question", "chunk_id", "text").groupBy("query_id").applyInPandas(run, schema)


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.drop("rank", "tier").withColumnRenamed("new_rank", "rank")


def retrieve(index: Index, questions: DataFrame, config: EngineConfig | None = None, plan: QueryPlan | None = None, models: Models | None = None) -> Found:
    """Questions (query_id, text, terms and variants if there are any), all read by one plan, to their top_k results.

    Channels over the index; windows of the documents that they agree on, where the plan reads deep; fusion, focus,
    reranker and judge as settings, plan and what was found ask for; then, for lists, a result for each new claim, else
    places kept for windows and results that are unlike each other. Questions of several plans are several calls.
    """
    config, plan, models = config or EngineConfig(), plan or QueryPlan(""), models or Models()
    listing, deep = plan.operation == "enumerate", is_deep(plan)
    none = F.array().cast("array<string>")
    told = questions.withColumns({c: v for c, v in {"terms": F.array("text"), "variants": none}.items() if c not in questions.columns})
    questions = stored(told.select("query_id", "text", "terms", "variants"), "questions")
    terms, links = linked_terms(index, questions)
    terms = stored(terms, "terms")
    hits = recalled(index, questions, terms, plan, config, models)
    anchored = None
    if deep:
        spans = fusion.anchors(index.chunks.select("chunk_id", "document_id", "segment_id", "kind").join(search.small(hits), "chunk_id"))
        anchored = stored(spans.select("query_id", "document_id").join(questions.select("query_id", "text"), "query_id"), "anchored")
        hits = stored(_union([hits, *read_windows(index, questions, terms, anchored, plan, config, models)]), "all-hits")
    navigation = hits.where(F.col("channel").isin("navigation", "coverage_dense_navigation")).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))

    fused = stored(fusion.weighted_rrf(hits, fusion.weight_profile(plan.intent, plan.operation), k=config.rrf_k), "fused")
    names = terms.groupBy("query_id").agg(F.collect_set(T.compact(F.col("term"))).alias("focus"))
    asked = questions.select("query_id", F.col("text").alias("question")).join(names, "query_id", "left").withColumn("focus", F.filter(F.coalesce("focus", none), lambda t: F.char_length(t) >= 2))
    rows = index.chunks.join(search.small(fused), "chunk_id").join(search.small(stored(asked, "focus")), "query_id")
    rows = rows.withColumns({"text": F.col("content"), "anchored": F.contains("channels", F.lit("exact_entity")), "focused": fusion.matches_focus(F.concat_ws(" ", "document_id", "title", "section_path", "content"), F.col("focus"))})
    rows = stored(_renamed(fusion.focus_guard(rows, config.top_k)), "guarded")

    budget = rerank_budget(plan, config.top_k, config.rerank_candidates)
    if listing:
        pool = fusion.enumeration_pool(rows, navigation.join(index.chunks.select("chunk_id", "kind", "position"), "chunk_id"), budget)
        rows = rows.join(pool.select("query_id", "chunk_id", F.col("rank").alias("new_rank")), ["query_id", "chunk_id"]).transform(_renamed)
    else:
        rows = _renamed(fusion.diversified(rows.where(F.col("rank") <= budget), budget, ["document_id", "window_start", "parent_id"])).drop("repeat")
    rows = rows.withColumn("rerank", F.lit(None).cast("double"))
    if models.score is not None and policy.runs_reranker(config, plan, 1, strong=False):
        # a question whose first result two channels of the index agree on keeps its order, unless the plan or settings ask for all
        strong = F.lit(False)
        if config.reranker_mode != "always" and not deep and not policy.is_fallback(plan):
            local = F.size(F.array_intersect(F.split("channels", ","), F.array(*map(F.lit, sorted(policy.LOCAL_CHANNELS)))))
            sure = (F.coalesce("confidence", F.lit(0.0)) >= policy.SURE_LINK) & F.contains("channels", F.lit("exact_entity")) & F.col("kind").isin(*policy.CARD_KINDS)
            strong = F.max(F.when(F.col("rank") == 1, (local >= 2) | sure)).over(Window.partitionBy("query_id"))
        rows = stored(rows.join(search.small(stored(links, "confidence")), "query_id", "left").withColumn("strong", F.coalesce(strong, F.lit(False))).drop("confidence"), "pool")
        scored = evidence.reranked(rows.where("NOT strong").drop("rerank").withColumnRenamed("question", "query"), models.score, budget).withColumnRenamed("query", "question")
        rows = _renamed(scored).unionByName(rows.where("strong")).drop("strong")
    for name, kind in (("judgement", "string"), ("answerability", "double"), ("relevance", "double"), ("qualified", "bigint")):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    if models.judge is not None and policy.runs_judge(config, plan, 1):
        limit = max(12, min(24, budget)) if listing else min(10 if policy.is_fallback(plan) else 6, max(config.top_k + 3, 5))
        rows = stored(rows.drop("judgement", "answerability", "relevance", "qualified"), "reranked")
        said = stored(_judgements(rows, models, plan, limit), "judgements")
        rows = rows.join(search.small(said), ["query_id", "chunk_id"], "left")
        claims = stored(evidence.qualified_claims(rows.where("judgement IS NOT NULL"), plan.intent == "entity_relation"), "claims")
        counts = claims.groupBy("query_id", "chunk_id").agg(F.count("*").alias("qualified"))
        rows = evidence.judged_order(rows.join(search.small(counts), ["query_id", "chunk_id"], "left"), listing)
        rows = stored(_renamed(rows.drop("score").withColumnRenamed("boosted", "score")), "judged")
        if listing:
            first = evidence.distinct_evidence(claims.drop("rank").join(rows.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"]), 1 << 20).select("query_id", "chunk_id", F.lit(0).alias("_claim"))
            order = Window.partitionBy("query_id").orderBy(F.coalesce("_claim", F.lit(1)), "rank")
            rows = _renamed(rows.join(search.small(first), ["query_id", "chunk_id"], "left").withColumn("new_rank", F.row_number().over(order)).drop("_claim"))
    rows = stored(_renamed(fusion.focus_guard(rows, config.top_k)), "candidates")

    if listing:
        results = rows.where(F.col("rank") <= max(config.top_k, min(10, config.top_k + 2)))
    else:
        if deep:
            rows = stored(_renamed(fusion.reserved_places(rows, navigation, fusion.FUSED_ROWS, plan.read.scope == "collection", places=config.top_k)).drop("pinned"), "reserved")
        picks = fusion.greedy_distinct(rows.withColumn("location", F.concat_ws(":", "document_id", "parent_id", F.col("window_start").cast("string"), "kind")), config.top_k)
        chosen = picks.select("query_id", F.posexplode("picks").alias("n", "chunk_id")).select("query_id", "chunk_id", (F.col("n") + 1).cast("int").alias("new_rank"))
        results = _renamed(rows.join(search.small(stored(chosen, "picks")), ["query_id", "chunk_id"]))
    return Found(stored(results.drop("focus", "question", "text"), "results"), hits, links)


def contexts(index: Index, questions: DataFrame, found: Found, config: EngineConfig | None = None) -> DataFrame:
    """query_id, context: cited blocks of a question's results within the budget of characters."""
    config = config or EngineConfig()
    rows = fusion.with_parent_text(found.results.withColumn("text", F.col("content")), index.parents)
    rows = rows.join(search.small(questions.select("query_id", F.col("text").alias("question"))), "query_id")
    anchor = F.left(F.col("text"), F.lit(80))
    excerpt = evidence.excerpt_of(F.col("source_text"), F.array().cast("array<string>"), T.search_tokens(F.col("question")), anchor, config.excerpt_chars)
    unit = F.lit(None).cast("int")
    rows = rows.withColumn("excerpt", excerpt)
    blocks = rows.withColumn("block", evidence.cited_block(F.col("rank"), F.col("document_id"), unit, unit, F.col("section_path"), F.col("excerpt")))
    cut = fusion.context_budget(blocks.select("query_id", "rank", "block"), config.context_chars)
    joined = cut.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "used"))).alias("b"))
    return joined.select("query_id", F.array_join(F.transform("b", lambda x: x["used"]), "\n\n---\n\n").alias("context"))


def confidences(found: Found) -> DataFrame:
    """query_id, confidence of a question's results."""
    quality = T.text_quality(F.col("content"))
    missed = ~F.max(F.when(F.col("rank") <= 10, F.col("focused"))).over(Window.partitionBy("query_id"))
    rows = found.results.select("query_id", "rank", F.split("channels", ",").alias("channels"), "score", "rerank", quality.alias("quality"), F.col("document_id").alias("file_name"), F.coalesce(missed, F.lit(False)).alias("coverage_failed"))
    return metrics.calibrated_confidence(rows)


def diagnostics(found: Found, n: int = 10) -> DataFrame:
    """query_id, channel, ids: the first ids of each channel."""
    rows = found.hits.where(F.col("rank") <= n).groupBy("query_id", "channel").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("h"))
    return rows.select("query_id", "channel", F.transform("h", lambda x: x["chunk_id"]).alias("ids"))


def answer(index: Index, query: str, stream: Callable[[list[dict]], Iterator[str]], planner: Planner | None = None, history: list[dict] | None = None, config: EngineConfig | None = None, models: Models | None = None) -> Iterator[str]:
    """The pieces of a chat model's answer to one question, over what was retrieved for it."""
    config = config or EngineConfig()
    asks = planner is not None and policy.asks_planner(config, query)
    plan = planner.plan(query) if asks else Planner(None).plan(query)
    spark = index.chunks.sparkSession
    names = focus.expanded_names(list(plan.entities)) or focus.focus_terms(query) or [query]
    questions = spark.createDataFrame([(1, query, names, [v for v in plan.variants if v != query])], "query_id int, text string, terms array<string>, variants array<string>")
    found = retrieve(index, questions, config, plan, models)
    rows = contexts(index, questions, found, config).collect()
    yield from stream(messages(query, rows[0]["context"] if rows else "", history or [], plan, config.history_messages))
