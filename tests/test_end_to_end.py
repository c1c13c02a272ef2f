"""The engine from units to cited context, its maintenance, and its driver-side parts."""

import pytest
from pyspark.sql import functions as F

from tidemark import engine
from tidemark.config import EngineConfig
from tidemark.plans import focus, policy, prompt
from tidemark.plans.query_plan import Planner, QueryPlan, coverage_plan

PAGES = {
    "tom.txt": ["Chapter 1\nTom Sawyer lived with Aunt Polly in the village.", "He met Huck Finn by the river at night.", "Chapter 2\nBecky Thatcher came to the school.", "Tom Sawyer and Becky Thatcher were lost in the cave."],
    "api.txt": ["Chapter 1\nThe client waits for a timeout of 30 seconds.", "The function get_token() returns a token for the server.", "Errors are retried twice by the client."],
    "汤姆.txt": ["第一章\n汤姆·索亚是一个男孩。", "他认识哈克·费恩。"],
}


@pytest.fixture(scope="module")
def index(spark):
    return engine.build_index(units(spark, PAGES))


def units(spark, pages):
    rows = [(d, i, t, len(texts)) for d, texts in pages.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "document_id string, unit bigint, text string, n_units bigint")


def ask(spark, *texts):
    rows = [(i + 1, t, [n]) for i, (t, n) in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id int, text string, terms array<string>")


def test_questions_find_their_documents(spark, index):
    questions = ask(spark, ("Who was lost in the cave?", "Becky Thatcher"), ("What does get_token() return?", "get_token()"), ("汤姆索亚是谁", "汤姆索亚"))
    found = engine.retrieve(index, questions, plan=QueryPlan("", operation="verify"))
    top = {r["query_id"]: r["document_id"] for r in found.results.where("rank = 1").collect()}
    assert top == {1: "tom.txt", 2: "api.txt", 3: "汤姆.txt"}
    text = {r["query_id"]: r["context"] for r in engine.contexts(index, questions, found).collect()}
    assert "lost in the cave" in text[1] and "[S1]" in text[1] and all(len(t) <= 7000 + 200 for t in text.values())
    assert {r["channel"] for r in engine.diagnostics(found).collect()} >= {"lexical", "exact_entity", "structured", "dense_original_query", "navigation", "coverage_dense_navigation"}
    assert all(0.08 <= r["confidence"] <= 0.96 for r in engine.confidences(found).collect())


def test_index_is_written_read_replaced_and_deleted(spark, index, tmp_path):
    engine.write_index(index, str(tmp_path / "index"))
    again = engine.read_index(spark, str(tmp_path / "index"))
    assert again.chunks.count() == index.chunks.count() and all(r["ok"] for r in engine.compatibility(again).collect())
    new = engine.build_index(units(spark, {"api.txt": ["Chapter 9\nNothing but water."]}))
    once = engine.upsert(again, new)
    twice = engine.upsert(once, new)
    for name in ("chunks", "postings", "aliases", "vectors", "units"):
        assert getattr(once, name).count() == getattr(twice, name).count()
    assert once.chunks.where("document_id = 'api.txt' AND content LIKE '%token%'").count() == 0 and once.chunks.where("content LIKE '%water%'").count() > 0
    engine.write_index(once, str(tmp_path / "index"))  # to the place that it was read from
    back = engine.read_index(spark, str(tmp_path / "index"))
    assert back.chunks.count() == once.chunks.count() and again.chunks.where("content LIKE '%token%'").count() > 0
    engine.upsert_index(spark, str(tmp_path / "index"), engine.build_index(units(spark, {"tom.txt": ["Chapter 3\nTom went home."]})))
    engine.delete_documents(spark, str(tmp_path / "index"), spark.createDataFrame([("汤姆.txt",)], "document_id string"))
    engine.index_store.vacuum(spark, str(tmp_path / "index"))
    last = engine.read_index(spark, str(tmp_path / "index"))
    for name in ("chunks", "postings", "aliases", "vectors", "units", "parents"):
        assert {r[0] for r in getattr(last, name).select("document_id").distinct().collect()} == {"api.txt", "tom.txt"}, name
    assert last.chunks.where("content LIKE '%cave%'").count() == 0 and last.chunks.where("content LIKE '%went home%'").count() > 0 and last.meta.count() == len(engine.VERSIONS)
    assert engine.retrieve(last, ask(spark, ("Who went home?", "Tom"))).results.where("rank = 1 AND document_id = 'tom.txt'").count() == 1
    some = last.chunks.select("chunk_id").limit(3)
    assert engine.records(last, some.union(some)).count() == 3
    engine.reset_index(last, str(tmp_path / "index"))
    assert engine.read_index(spark, str(tmp_path / "index")).chunks.count() == 0
    left = engine.without_documents(index, spark.createDataFrame([("tom.txt",)], "document_id string"))
    assert {r[0] for r in left.chunks.select("document_id").distinct().collect()} == {"api.txt", "汤姆.txt"}


def test_answer_streams_with_evidence(spark, index):
    seen = []

    def stream(sent):
        seen.extend(sent)
        yield from ("a", "b")

    planner = Planner(lambda _: '{"intent": "fact_lookup", "operation": "lookup", "entity_mentions": ["cave"]}')
    assert "".join(engine.answer(index, "Who was lost in the cave?", stream, planner, [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "no"}])) == "ab"
    assert [m["role"] for m in seen] == ["system", "user", "user"] and "lost in the cave" in seen[-1]["content"]


CAVE = ("Who was lost in the cave?", "Becky Thatcher")


def ids(found):
    return [r["chunk_id"] for r in found.results.where("query_id = 1").orderBy("rank").collect()]


def test_settings_change_results(spark, index):
    questions = ask(spark, CAVE)
    plain = engine.retrieve(index, questions, EngineConfig())
    score = lambda f: f.results.where("rank = 1").first()["score"]
    assert plain.results.count() <= 6 and engine.retrieve(index, questions, EngineConfig(top_k=2)).results.count() == 2
    assert score(engine.retrieve(index, questions, EngineConfig(rrf_k=5))) > score(plain)
    channels = lambda f: {r["channel"] for r in f.hits.select("channel").distinct().collect()}
    assert channels(plain) == {"lexical", "exact_entity", "structured", "dense_original_query"}
    assert channels(engine.retrieve(index, questions, EngineConfig(use_exact=False, use_structured=False))) == {"lexical", "dense_original_query"}
    dense = lambda f: {r["chunk_id"]: r["rank"] for r in f.hits.where("channel = 'dense_original_query'").collect()}
    assert dense(plain) and dense(engine.retrieve(index, questions, EngineConfig(metric="ip"))) == dense(plain)  # hashed vectors have length one
    assert [r["confidence"] for r in plain.links.collect()] == [1.0]


def test_variants_are_queries_of_their_own(spark, index):
    questions = ask(spark, CAVE).withColumn("variants", F.array(F.lit("token for the server"), F.lit("timeout"), F.lit("x"), F.lit("y")))
    found = lambda plan: {r["channel"] for r in engine.retrieve(index, questions, plan=plan).hits.select("channel").distinct().collect() if r["channel"].startswith("dense")}
    assert found(QueryPlan("")) == {"dense_original_query"}
    assert found(QueryPlan("", operation="enumerate")) == {"dense_original_query", *(f"dense_llm_variant_{k}" for k in (1, 2, 3))}


def test_reranker_orders_and_failures_dont(spark, index):
    questions = ask(spark, CAVE)
    plain = ids(engine.retrieve(index, questions))
    backwards = engine.Models(score=lambda pairs: [float(len(t)) for _, t in pairs])
    again = engine.retrieve(index, questions, EngineConfig(use_reranker=True, reranker_mode="always"), models=backwards)
    assert all(r["rerank"] is not None for r in again.results.collect()) and ids(engine.retrieve(index, questions, EngineConfig(use_reranker=False), models=backwards)) == plain

    def fails(pairs):
        raise RuntimeError

    assert ids(engine.retrieve(index, questions, EngineConfig(use_reranker=True, reranker_mode="always"), models=engine.Models(score=fails))) == plain


def _judge(question, candidates):
    """Claims that hold the words of one sentence; only windows and children that hold it qualify."""
    said = "Tom Sawyer and Becky Thatcher were lost in the cave"
    claim = lambda t: [{"statement": said, "excerpt": said, "qualifies": True, "roles": {"target_entity": "Tom Sawyer", "object": "Becky Thatcher"}}] if said in t else []
    return [c | {"answerability": float(said in c["text"]), "relevance": 0.5, "judgement": claim(c["text"])} for c in candidates]


def test_judge_leads_and_lists_claims_once(spark, index):
    questions = ask(spark, CAVE)
    models = engine.Models(judge=_judge)
    found = engine.retrieve(index, questions, EngineConfig(judge_mode="always"), models=models).results.orderBy("rank").collect()
    # what is found by name or about it still leads; within that the judge's order holds
    tier = lambda r: 0 if r["anchored"] else 1 if r["focused"] else 2
    assert [(tier(r), -(r["answerability"] or 0)) for r in found] == sorted((tier(r), -(r["answerability"] or 0)) for r in found) and any(r["answerability"] == 1.0 for r in found)
    listed = engine.retrieve(index, questions, plan=QueryPlan("", operation="enumerate"), models=models).results.orderBy("rank").collect()
    counted = [r for r in listed if r["qualified"]]
    assert counted and all("lost in the cave" in r["content"] for r in counted) and len(listed) <= 8

    def fails(question, candidates):
        raise RuntimeError

    assert ids(engine.retrieve(index, questions, EngineConfig(judge_mode="always"), models=engine.Models(judge=fails))) == ids(engine.retrieve(index, questions))


def test_plans_read_what_they_name(spark, index):
    from tidemark.plans.query_plan import ReadStrategy

    questions = ask(spark, CAVE)
    plan = QueryPlan("", read=ReadStrategy("document", ("terminal",), "terminal", need_entity_neighborhood=True))
    found = engine.retrieve(index, questions, plan=plan)
    kinds = {r["kind"] for r in found.results.join(found.hits.where("channel = 'navigation'").select("chunk_id").distinct(), "chunk_id").collect()}
    assert kinds and kinds <= {"navigation_window", "terminal_window"}


def test_empty_questions(spark, index):
    assert engine.retrieve(index, ask(spark, ("x", "x")).limit(0)).results.count() == 0


def test_settings_are_held():
    c = EngineConfig.from_dict({"top_k": 0, "rrf_k": 999, "metric": "COSINE", "child_chars": 10, "child_overlap": 500, "use_judge": "no", "candidates": "x", "collection": "a b/c", "unknown": 1})
    assert (c.top_k, c.rrf_k, c.metric, c.child_chars, c.child_overlap, c.use_judge, c.collection) == (1, 200, "cosine", 120, 100, False, "a_b_c")


def test_gates():
    c, plain = EngineConfig(use_reranker=True), QueryPlan("q")
    assert policy.runs_reranker(c, plain, 5, strong=False) and not policy.runs_reranker(c, plain, 5, strong=True) and not policy.runs_reranker(EngineConfig(), plain, 5, strong=False)
    assert policy.runs_judge(c, coverage_plan("q"), 1) and not policy.runs_judge(c, plain, 1) and policy.runs_judge(c, QueryPlan("q", operation="enumerate"), 1)
    assert policy.strong_local_evidence(plain, {"lexical", "exact_entity"}, "child") and not policy.strong_local_evidence(coverage_plan("q"), {"lexical", "exact_entity"}, "child")
    assert policy.confidence_of_answer(0.9, "无法确定，但现有证据可确认一点", 2) == (0.62, "部分证据") and policy.confidence_of_answer(0.9, "无法确定", 2) == (0.9, "直接证据不足") and policy.confidence_of_answer(0.9, "好的", 2) == (0.9, None)


@pytest.mark.parametrize("question,first", [("汤姆·索亚认识哪些人？", "汤姆索亚"), ("Who is Tom Sawyer?", "tom sawyer"), ("Tom Sawyer's friends", "tom sawyer friends"), ("", None)])
def test_focus(question, first):
    terms = focus.focus_terms(question)
    assert (terms[:1] or [None]) == [first] and len(terms) <= 5


def test_names_and_prompt():
    assert focus.expanded_names(["Tom Sawyer", "tom  sawyer", "汤姆·索亚"]) == ["Tom Sawyer", "Tom", "汤姆·索亚", "汤姆"]
    sent = prompt.messages("q", "", [{"role": "user", "content": str(i)} for i in range(9)], QueryPlan("q", answer_mode="inferred"))
    assert [m["content"] for m in sent[1:-1]] == ["5", "6", "7", "8"] and "inferences" in sent[-1]["content"]
