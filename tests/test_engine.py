"""Operators on small literal tables: invariants, scenarios and brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import chunking, entities, fusion, maintenance, metrics, search, structure
from tidemark.plans import evidence, query_plan
from tidemark import engine
from tidemark.sources import text_sources
from tidemark.streaming import ingest


def windows_of(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab c", max_size=60), min_size=1, max_size=6), st.integers(3, 20), st.integers(0, 5))
def test_sliding_windows(spark, texts, size, overlap):
    overlap = min(overlap, size - 1)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", chunking.sliding_windows(F.col("x"), size, overlap).alias("w")).collect()
    for r in rows:
        assert r["w"] == windows_of(texts[r["i"]], size, overlap)


def test_chunks_keep_their_bounds_and_words(spark):
    random.seed(3)
    texts = ["\n\n".join(" ".join("".join(random.choices("abc", k=5)) for _ in range(random.randint(1, 60))) + "." for _ in range(random.randint(1, 8))) for _ in range(12)]
    texts += ["", "x" * 900, "A. B. C.", "short"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", "x", chunking.split_text(F.col("x"), 200, 40).alias("c")).collect()
    for r in rows:
        assert all(len(c) <= 200 + 40 + 2 for c in r["c"])
        if len(r["x"]) > 200:
            assert all(c.strip() for c in r["c"])
            assert set(r["x"].split()) <= set(" ".join(r["c"]).split()) or "x" * 50 in r["x"]
        else:
            assert r["c"] == [r["x"]]


@pytest.fixture(scope="module")
def pages(spark):
    """Twelve pages of a file, the last an epilogue."""
    rows = [("book", i, f"第 {i + 1} 页\n\n" + ("Chapter 1\nTom Sawyer ran." if i == 0 else "Epilogue\nTom Sawyer came home." if i == 11 else f"Then something went on, part {i}."), 12) for i in range(12)]
    return spark.createDataFrame(rows, "document_id string, unit bigint, text string, n_units bigint")


def test_navigation_scenario(spark, pages):
    found = structure.sections(pages)
    windows = structure.navigation_windows(structure.segments(found))
    cards = structure.window_cards(windows, pages).collect()
    assert any(c["kind"] == "terminal_window" and "came home" in c["content"] for c in cards)
    terms = spark.createDataFrame([(1, "book", "Tom Sawyer")], "query_id int, document_id string, term string")
    near = search.terminal_neighbourhood(structure.with_position(pages), windows, terms).orderBy("rank").collect()
    assert near and near[0]["chunk_id"] == "book:w:8:11"


def test_repeated_heading_starts_a_segment(spark):
    rows = [("f", i, t, 8) for i, t in enumerate(["Part One", "Part One", "text, a", "text, b", "Part One", "text, c", "Other", "text, d"])]
    units = spark.createDataFrame(rows, "document_id string, unit bigint, text string, n_units bigint")
    found = structure.sections(units)
    assert [(r["title"], r["start_unit"], r["end_unit"]) for r in found.orderBy("section").collect()] == [("Part One", 0, 3), ("Part One", 4, 5), ("Other", 6, 7)]
    assert [(r["start_unit"], r["end_unit"]) for r in structure.segments(found).orderBy("start_unit").collect()] == [(0, 3), (4, 7)]


def test_alias_search_and_links(spark):
    chunks = spark.createDataFrame([("c1", "person", ["汤姆·索亚", "汤姆索亚", "Tom Sawyer"], []), ("c2", "place", ["Sawyer House"], ["house()"])], "chunk_id string, entity_type string, aliases array<string>, exact_terms array<string>")
    aliases = entities.alias_rows(chunks)
    terms = spark.createDataFrame([(1, "tom sawyer"), (2, "汤姆 索亚"), (3, None)], "query_id int, term string")
    assert {(r["query_id"], r["chunk_id"]) for r in entities.exact_search(aliases, terms).collect()} == {(1, "c1"), (2, "c1")}
    links = entities.link_entities(spark.createDataFrame([(1, "Sawyer"), (2, "x")], "mention_id int, mention string"), aliases).collect()
    assert {r["normalized_name"] for r in links} == {"tomsawyer", "sawyerhouse"} and all(r["score"] >= 0.82 for r in links)


def test_bm25_equals_the_formula(spark):
    import math

    docs = {1: "red fox jumps", 2: "red dog", 3: "blue fox fox", 4: ""}
    chunks = spark.createDataFrame(list(docs.items()), "id int, text string")
    rows = search.bm25_scores(search.postings(chunks, "id"), spark.createDataFrame([(7, "red fox")], "query_id int, text string")).collect()
    tokens = {k: list(dict.fromkeys(v.split())) for k, v in docs.items() if v}
    mean = sum(map(len, tokens.values())) / len(tokens)
    for r in rows:
        t = tokens[r["chunk_id"]]
        score = sum(math.log(1 + (3 - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(t) / mean)) for q in ("red", "fox") if q in t for df in [sum(q in x for x in tokens.values())])
        assert abs(r["score"] - score) < 1e-9
    assert {r["chunk_id"] for r in rows} == {1, 2, 3}


def test_rrf_uses_ranks_not_scores(spark):
    hits = spark.createDataFrame([(1, "lexical", 1, "a"), (1, "lexical", 2, "b"), (1, "exact_entity", 1, "b")], "query_id int, channel string, rank int, chunk_id string")
    rows = {r["chunk_id"]: r["score"] for r in fusion.weighted_rrf(hits, fusion.weight_profile("fact_lookup")).collect()}
    assert rows == {"a": round(1.1 / 61, 6), "b": round(1.1 / 62 + 1.4 / 61, 6)}


@pytest.mark.parametrize("channel,weight", [("exact_entity", 1.4), ("dense_llm_structured_1", 0.8), ("dense_llm_variant_2", 0.7), ("coverage_dense_navigation", 2.3), ("other", 1.0)])
def test_channel_weights(spark, channel, weight):
    assert spark.range(1).select(fusion.channel_weight(F.lit(channel), fusion.weight_profile("fact_lookup")).alias("w")).first()["w"] == weight


def test_focus_guard_keeps_a_short_tail(spark):
    rows = [(1, i + 1, str(i), False, i == 4) for i in range(8)]
    out = fusion.focus_guard(spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, anchored boolean, focused boolean")).orderBy("new_rank").collect()
    assert [r["chunk_id"] for r in out] == ["4", "0", "1", "2"]
    rows = [(1, i + 1, str(i), False, False) for i in range(8)]
    assert len(fusion.focus_guard(spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, anchored boolean, focused boolean")).collect()) == 8


def test_greedy_distinct_drops_likenesses(spark):
    rows = [(1, 1, "a", "one two three four", "x"), (1, 2, "b", "one two three four five", "y"), (1, 3, "c", "six seven eight", "z"), (1, 4, "d", "nine ten", "x")]
    table = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, text string, location string")
    assert fusion.greedy_distinct(table, 3).first()["picks"] == ["a", "c", "b"]


def test_near_duplicates_against_all_pairs(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(30)]
    base = [random.sample(words, 12) for _ in range(6)]
    texts = [" ".join(random.choice(base)[: random.randint(8, 12)] + random.sample(words, 2)) for _ in range(60)]
    rows = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "id int, g int, text string")
    found = {(r["a"], r["b"]) for r in fusion.near_duplicates(rows, "id", "g").collect()}
    sets = [set(t.split()) for t in texts]
    assert found == {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) >= 0.82}


def test_measures(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "b"), (1, 3, "a")], "query_id int, rank int, chunk_id string")
    wanted = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "z", 1.0)], "query_id int, chunk_id string, gain double")
    rows = {r["query_id"]: r for r in metrics.retrieval_metrics(ranked, wanted, 2).collect()}
    assert (rows[1]["recall"], rows[1]["mrr"]) == (0.5, 0.5) and rows[2]["recall"] == 0.0
    assert spark.range(1).select(metrics.unsupported_rate(F.lit(4), F.lit(1)).alias("r")).first()["r"] == 0.75


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, n int")
    once = maintenance.upserted(old, new, ["id"], "n")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 0), (2, "d", 2), (3, "e", 1)]
    assert sorted(map(tuple, maintenance.upserted(once, new, ["id"], "n").collect())) == sorted(map(tuple, once.collect()))


def test_grounding_and_claims():
    assert evidence.is_grounded("Tom met Becky in the cave", "… Tom met Becky, in the cave!")
    assert not evidence.is_grounded("Tom", "Tom") and not evidence.is_grounded("a fight broke out", "nothing of the kind happened here")


def test_rerank_failure_keeps_order(spark):
    rows = spark.createDataFrame([(1, i, "q", f"t{i}") for i in (1, 2, 3)], "query_id int, rank int, query string, text string")

    def fails(pairs):
        raise RuntimeError

    assert [r["rank"] for r in evidence.reranked(rows, fails, 2).orderBy("new_rank").collect()] == [1, 2, 3]
    assert [r["rank"] for r in evidence.reranked(rows, lambda p: [float(t[1:]) for _, t in p], 2).orderBy("new_rank").collect()] == [2, 1, 3]


def test_plans():
    clock = [0.0]
    answers = iter(['noise {"intent": "entity_relation", "operation": "enumerate", "entity_mentions": [{"text": "Tom"}, {"text": "Nobody"}], "read_strategy": {"scope": "document", "regions": ["all", "front", "bad"]}} tail', "no json"])
    asked = []

    def ask(prompt):
        asked.append(prompt)
        return next(answers)

    planner = query_plan.Planner(ask, clock=lambda: clock[0])
    plan = planner.plan("Whom does Tom know?")
    assert (plan.intent, plan.operation, plan.entities, plan.read.scope, plan.read.regions) == ("entity_relation", "enumerate", ("Tom",), "document", ("front",))
    assert query_plan.is_deep(plan) and query_plan.candidate_budget(plan) == 72 and query_plan.rerank_budget(plan) == 36
    assert planner.plan("again?").source == "coverage_fallback"
    clock[0] = 10.0
    assert planner.plan("again?").operation == "verify" and len(asked) == 2
    simple = query_plan.plan_from_payload("q", {"operation": "nonsense"})
    assert simple.operation == "lookup" and query_plan.candidate_budget(simple) == 48 and query_plan.variant_limit(simple) == 1
    assert query_plan.balanced_json('x [1, "]", {"a": 2}] y', "[") == '[1, "]", {"a": 2}]'


def test_sources_and_stream(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.txt").write_bytes("Überschrift\r\nerster Satz.".encode())
    (landing / "b.txt").write_bytes("中文内容在这里".encode("gbk"))
    (landing / "c.csv").write_text('n,name\n1,"x, y"\n,z\n')
    (landing / "d.bin").write_bytes(b"\0")
    (landing / "e.txt").write_bytes(b"  ")
    found = text_sources.files(spark, str(landing))
    assert {r["file_name"] for r in found.collect()} == {"a.txt", "b.txt", "c.csv", "e.txt"}
    texts = {r["file_name"]: r["text"] for r in text_sources.txt_units(found).collect()}
    assert texts == {"a.txt": "Überschrift erster Satz.", "b.txt": "中文内容在这里"}
    rows = text_sources.csv_units(spark, str(landing / "c.csv"), "c.csv").orderBy("unit").collect()
    assert rows[0]["text"] == 'CSV 文件：c.csv\n列名：n | name\n第 1 行：{"n": 1, "name": "x, y"}\nMarkdown 视图：n: 1 | name: x, y' and '"n": ""' in rows[1]["text"]
    (landing / "f.csv").write_bytes("\ufeff名,x\n汤姆,1.50\n\n索亚,2\n".encode("gbk", "ignore"))
    rows = {(r["file_name"], r["unit"]): r["text"] for r in text_sources.csv_file_units(text_sources.files(spark, str(landing))).collect()}
    assert rows["c.csv", 0] == 'CSV 文件：c.csv\n列名：n | name\n第 1 行：{"n": 1, "name": "x, y"}\nMarkdown 视图：n: 1 | name: x, y' and '"n": ""' in rows["c.csv", 1]
    assert '{"名": "汤姆", "x": 1.5}' in rows["f.csv", 0] and '"x": 2.0' in rows["f.csv", 1] and len(rows) == 4
    read = lambda content: [{"page": 1, "page_count": 1, "page_width": 600.0, "page_height": 800.0, "x0": 10.0, "y0": 100.0, "x1": 200.0, "y1": 120.0, "text": content.decode(), "ocr": False}]
    (landing / "g.pdf").write_bytes(b"words of a page in a file")
    for _ in range(2):
        ingest.ingest(spark, str(landing), str(tmp_path / "index"), str(tmp_path / "state"), read_pdf=read).awaitTermination()
    index = engine.read_index(spark, str(tmp_path / "index"))
    assert index.units.select("document_id").distinct().count() == 5 and index.units.where("text LIKE '%words of a page%'").count() == 1
    (landing / "h.txt").write_bytes(b"A late file about rivers.")
    ingest.ingest(spark, str(landing), str(tmp_path / "index"), str(tmp_path / "state"), read_pdf=read).awaitTermination()
    later = engine.read_index(spark, str(tmp_path / "index"))
    assert later.units.select("document_id").distinct().count() == 6 and later.chunks.where("content LIKE '%rivers%'").count() > 0 and later.chunks.count() > index.chunks.count()


def test_paged_units(spark):
    blocks = [("f", 1, 1, 600.0, 800.0, 10.0, y, 200.0, y + 20, t, False) for y, t in ((100.0, "left column one"), (300.0, "left column two"))]
    blocks += [("f", 1, 1, 600.0, 800.0, 400.0, y, 590.0, y + 20, t, False) for y, t in ((50.0, "right column one"), (200.0, "right column two"), (780.0, "margin text here"))]
    rows = text_sources.paged_units(spark.createDataFrame(blocks, f"file_name string, {text_sources.BLOCKS}")).orderBy("unit").collect()
    assert [r["text"].split("\n\n")[1] for r in rows] == ["left column one", "left column two", "right column one", "right column two"]
    assert rows[0]["text"].startswith("第 1 页")


def test_bundle_keeps_anchors_and_budget(spark):
    from tidemark.functions.requirements import source_bundle

    def wanted(value, most, anchors):
        budget, n = max(240, most), len(value)
        if n <= budget:
            return value
        width = max(150, min(420, budget // 4))
        lefts = [value.lower().find(a.lower()) + len(a) // 2 - width // 2 for a in anchors if len(a) > 1 and a.lower() in value.lower()][:3]
        spans = []
        for left in lefts + [(n - width) * i // 3 for i in range(4)]:
            right = min(n, max(0, left) + width)
            spans.append((max(0, right - width), right))
        spans.sort()
        merged = [list(spans[0])]
        for a, b in spans[1:]:
            if a > merged[-1][1] + 24:
                merged.append([a, b])
            else:
                merged[-1][1] = max(merged[-1][1], b)
        parts, used = [], 0
        for a, b in merged:
            s = value[a:b].strip(" ")
            size = len(s) + (7 if parts else 0)
            if used + size > budget:
                if budget - used - 7 >= 100:
                    parts.append(s[: budget - used - 7].rstrip(" "))
                break
            parts.append(s)
            used += size
            if used >= budget:
                break
        return "\n[…]\n".join(parts)

    random.seed(11)
    texts = ["".join(random.choices("abc ", k=n)).strip() + " Anchor here " + "".join(random.choices("xyz ", k=m)).strip() for n, m in ((10, 20), (600, 900), (3000, 10), (20, 5000), (900, 900))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", source_bundle(F.col("t"), 600, F.array(F.lit("anchor"), F.lit("nowhere"))).alias("b")).collect()
    for r in rows:
        assert r["b"] == wanted(texts[r["i"]], 600, ["anchor", "nowhere"])
        assert len(r["b"]) <= 620


def test_judged_order(spark):
    rows = [(1, 1, 0.5, 0.2, 0.9, 0), (1, 2, 0.1, 0.8, 0.1, 2), (1, 3, 0.9, None, None, None), (1, 4, 0.2, 0.8, 0.5, 0)]
    table = spark.createDataFrame(rows, "query_id int, rank int, score double, answerability double, relevance double, qualified int")
    assert [r["rank"] for r in evidence.judged_order(table).orderBy("new_rank").collect()] == [4, 2, 1, 3]
    out = evidence.judged_order(table, enumerate_claims=True).orderBy("new_rank").collect()
    assert [r["rank"] for r in out] == [2, 4, 1, 3] and out[0]["boosted"] == round(0.1 + 0.016 + 0.03, 6) and out[3]["boosted"] == 0.9


def test_enumeration_pool(spark):
    names = "query_id int, rank int, chunk_id string, kind string, position double"
    found = spark.createDataFrame([(1, i, f"c{i}", "child" if i != 2 else "entity_card", i / 10) for i in range(1, 7)], names)
    windows = spark.createDataFrame([(1, 1, "w1", "terminal_window", 0.99), (1, 2, "c1", "child", 0.1)], names)
    assert [r["chunk_id"] for r in fusion.enumeration_pool(found, windows, 4).orderBy("rank").collect()] == ["c1", "c4", "w1", "c3"]


def test_second_pass():
    batches = []

    def judge(batch):
        batches.append(len(batch))
        return [c | {"ok": c["chunk_id"] == "p20"} for c in batch]

    pool = [{"chunk_id": f"p{i}"} for i in range(40)]
    out = evidence.second_pass(pool[:3], pool, judge, 12, lambda c: c.get("ok", False))
    assert batches == [12, 12] and [c["chunk_id"] for c in out] == [f"p{i}" for i in range(27)] and out[20]["ok"]
    head = [{"chunk_id": "x", "ok": True}]
    assert evidence.second_pass(head, pool, judge, 12, lambda c: c["ok"]) == head and len(batches) == 2


def test_sources_reach_the_workers(spark, monkeypatch):
    from tidemark import shipping

    monkeypatch.setattr(shipping, "_found_by_workers", lambda: False)
    shipping.ship(spark)
    shipping.ship(spark)
    assert any("tidemark-src.zip" in f for f in spark.sparkContext.listFiles)


def test_dense_neighbours_in_parts(spark, monkeypatch):
    """Products of matrices, over several parts of queries and with equal vectors, give what every pair compared gives; no pair is a row."""
    random.seed(5)
    rows = [(i, [float(random.randint(-3, 3)) for _ in range(6)], i % 3) for i in range(300)] + [(300 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0], 1) for i in range(30)] + [(400, None, 1)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    asked = vectors.where("vec_id % 20 = 0 AND embedding IS NOT NULL").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(search.best, "PART_CELLS", 30)

    def score(a, b):
        if b is None or not any(a) or not any(b):
            return 0.0
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return round(max(0.0, dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5), 5)

    for labelled in (False, True):
        found = search.dense_top_k(vectors, asked if labelled else asked.drop("label"), 7)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
        for q in asked.collect():
            all_of = sorted((-score(q["embedding"], v), i) for i, v, label in rows if not labelled or label == q["label"])
            assert got[q["query_id"]] == [(i, -s) for s, i in all_of[:7]]


def test_batches_of_questions_keep_ties(spark, monkeypatch):
    """BM25 and containment in parts and blocks of queries: the same as one by one, ties by chunk, stored once."""
    random.seed(6)
    words = ["red", "fox", "foxes", "blue", "a-b", "东京塔", "x/y", "infrared", "zz"]
    docs = spark.createDataFrame([(i, " ".join(random.choices(words, k=random.randint(0, 5)))) for i in range(200)], "id bigint, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "blue 东京"), (3, "zz"), (4, "the"), (5, "ox/y /y")], "query_id int, text string")
    wanted = search.top_k(search.bm25_scores(search.postings(docs, "id"), asked).withColumn("score", F.round("score", 6)), 5).select("query_id", "rank", "chunk_id", "score").collect()
    plain = [(q, c, sum(t in x for t in ts)) for q, ts in [(1, ["red", "fox"]), (2, ["blue", "东京"]), (3, ["zz"]), (5, ["ox/y", "/y"])] for c, x in docs.collect() if any(t in x for t in ts)]
    monkeypatch.setattr(search.best, "PART_QUERIES", 2)
    monkeypatch.setattr(search.best, "WORD_QUERIES", 1)
    for found in (search.bm25_top_k(docs, asked, "id", 5), search.bm25_of_postings(search.postings(docs, "id"), asked, 5)):
        assert sorted(map(tuple, found.select("query_id", "rank", "chunk_id", "score").collect())) == sorted(map(tuple, wanted))
        assert found.inputFiles()  # a table: what follows reads it, and scores are not made again
    found = {(r["query_id"], r["chunk_id"]): r["score"] for r in search.containment_top_k(docs, asked, "id", 1000).collect()}
    assert all(found[q, c] == n for q, c, n in plain if q != 5)


def test_no_card_and_no_entity_is_left_out(spark):
    """Structured search looks at all cards, and a file keeps all its entities, unless a number is given."""
    cards = spark.createDataFrame([(f"c{i:03}", "section_card", "t", None, "needle" if i == 150 else "hay") for i in range(151)], "chunk_id string, kind string, title string, section_path string, content string")
    asked = spark.createDataFrame([(1, "needle"), (2, "the")], "query_id int, text string")
    found = search.structured_search(cards, asked, limit=2)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "c150", 1), (2, 1, "c000", 0), (2, 2, "c001", 0)]
    assert search.structured_search(cards, asked.where("query_id = 1"), limit=2, first=72).count() == 0
    units = spark.createDataFrame([("d", 0, " ".join(f"client_{i}" for i in range(200)))], "document_id string, unit bigint, text string")
    merged = entities.merged_entities(entities.entity_mentions(units))
    assert merged.count() == 200 and entities.merged_entities(entities.entity_mentions(units), 160).count() == 160
