"""Steps that grew faster than their input: the same results by the way that doesn't."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of, sql
from tidemark.functions import plain
from tidemark.functions import text as T
from tidemark.operators import best, fusion, pairs, search, structure
from tidemark.queries import ORACLES, QUERIES

ODD = [
    None, "", "  ", "Straße STRASSE ẞ é é ÑANDÚ İstanbul ΟΔΟΣ", "汤姆·索亚历险记是谁写的", "東京タワーはどこ パ", "API timeout v1.2.0 C++ C# .NET C:\\tmp\\foo_bar.py foo() /a/b.c v1.2 v1",
    "서울 타워", "a–b—c－d • e·f [x](y) «z» ‘q’ 、。", "nb\u00a0sp\x85ace\x1cunit\x0btab\u2003em", "the and of", "x" * 300 + " y/z/../.. ...", "😀 emojí a\u0301b", "一二三\n四，五",
]


def test_tokens_in_workers_are_those_of_the_expressions(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id int, text string")
    for r in rows.select("text", T.search_tokens(F.col("text")).alias("t"), F.split(T.fold_lexical(F.col("text")), " ").alias("w")).collect():
        assert plain.tokens(r["text"]) == set(r["t"])
        assert plain.lexical_words(r["text"]) == set(r["w"]) - {""}


def test_terms_within_words():
    random.seed(3)
    word = lambda n: "".join(random.choice("abé汤") for _ in range(n))
    terms = sorted({word(random.randint(1, 14)) for _ in range(300)} | {"abababab", "ababababa", "abababab汤"})
    words = [word(random.randint(1, 60)) for _ in range(400)] + ["abababababababab汤", ""]
    found: list[set] = [set() for _ in words]
    for w, i in zip(*best._Within(terms)(words), strict=True):
        found[w].add(i)
    assert found == [{i for i, t in enumerate(terms) if t in w} for w in words]


def test_navigation_holds_words_against_terms_once(spark):
    windows = spark.createDataFrame([(f"d{i % 3}" if i % 7 else None, f"w{i}", "terminal_window" if i % 2 else "navigation_window", i / 30, "terminal" if i % 2 else "front", ODD[i % len(ODD)] or "") for i in range(30)], "document_id string, chunk_id string, kind string, position double, region string, content string")
    questions = spark.createDataFrame([(1, "d0", "timeout foo() strasse"), (2, "d1", "索亚历 ..."), (3, None, "api"), (4, "d2", ""), (1, "d1", "v1.2 /a/b.c")], "query_id int, document_id string, text string")
    found = search.navigation_scores(windows, questions, "front", ["terminal"])
    wanted = []
    for w in windows.where("region = 'terminal'").withColumn("t", T.fold_lexical(F.col("content"))).collect():
        for q in questions.collect():
            if w["document_id"] is not None and w["document_id"] == q["document_id"]:
                terms = plain.tokens(q["text"])
                share = sum(t in w["t"] for t in terms) / len(terms) if terms else 0
                wanted.append((q["query_id"], w["chunk_id"], round(share * 0.9 + (1 - w["position"]) * 0.55 + 0.1, 6)))
    assert sorted((r["query_id"], r["chunk_id"], round(r["score"], 6)) for r in found.collect()) == sorted(wanted)
    # before, every question's tokens were looked for in every text of its document
    assert "contains(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_position_bins_look_at_few_rows_a_bin(spark):
    random.seed(1)
    rows = spark.createDataFrame([(q, f"c{i}", random.random() * (0.3 if q == 2 else 1.0), random.randint(0, 40) / 10) for q, n in [(1, 300), (2, 60), (3, 8), (4, 9), (5, 1)] for i in range(n)], "query_id int, chunk_id string, position double, score double")
    out = search.position_diverse(rows, 8)
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["chunk_id"])
    for q, ids in found.items():
        mine = sorted((r for r in rows.collect() if r["query_id"] == q), key=lambda r: (-r["score"], -r["position"], r["chunk_id"]))
        heads = {}
        for r in mine:
            heads.setdefault(min(2, int(r["position"] * 3)), r["chunk_id"])
        first = [heads[b] for b in sorted(heads)] if len(mine) > 8 else []
        assert ids == (first + [r["chunk_id"] for r in mine if r["chunk_id"] not in first])[:8]
    # before, all rows of a query were ordered
    assert "WindowGroupLimit" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sizes", [(6920,), (6921,), (9000, 10), (10, 9000, 5), (4200, 2600), (3000, 3000, 3000), (6921, 20000), (4199, 1, 2600, 121)])
def test_excerpts_of_long_units(spark, sizes):
    texts = [" " + "".join(chr(97 + (i * 7 + j) % 26) for j in range(n)) + " " for i, n in enumerate(sizes)]
    units = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "document_id string, unit bigint, text string")
    spans = spark.createDataFrame([("d", "w", 0, len(sizes) - 1)], "document_id string, chunk_id string, window_start bigint, window_end bigint")
    whole = "\n\n".join(t.strip() for t in texts)
    wanted = whole if len(whole) <= 6920 else whole[:4200] + "\n\n[...中间原文窗口省略...]\n\n" + whole[-2600:]
    assert structure.spans_with_text(spans, units, "window_start", "window_end", "chunk_id", 4200, 2600).first()["excerpt"] == wanted


@pytest.mark.parametrize("name", ["navigation_search", "position_bins", "bm25_topk", "like_search"])
def test_odd_texts_against_sql(spark, tmp_path, name):
    """Texts of many scripts and lengths, some anchored to files that questions name."""
    random.seed(11)
    texts = [" ".join(random.choice(["Foo()", "straße", "token", "café.", "v1.2.0", "/a/b", "the", "timeout;", "x" * 40]) for _ in range(random.choice([1, 5, 40, 1500]))) for _ in range(60)] + ["", " ", None]
    rows = [(i, t, f"src{i % 4}", "en", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint").toPandas().to_parquet(tmp_path / "documents.parquet")
    asked = [(i, t) for i, t in enumerate(["cafe token", "foo() strasse", "meou /a", "the", "xxxxxxxxxxxx v1.2", "middle segment", "src"])]
    spark.createDataFrame(asked, "item_id bigint, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    assert rows_of(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows_of(sql(str(tmp_path), ORACLES[name]))


@pytest.mark.parametrize("block", [50_000, 7])
def test_near_duplicates_in_blocks(spark, monkeypatch, block):
    """Blocks of a file meet in pairs; copies, single words and texts without tokens among them."""
    random.seed(9)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(random.sample(words[: random.choice([3, 12, 40])], random.randint(1, 3))) for _ in range(40)] + [" ".join(random.sample(words, 14)) for _ in range(20)]
    texts += [t + " " + random.choice(words) for t in texts[:20]] + ["", "the of", None] + texts[:5] * 2
    rows = spark.createDataFrame([(i, f"f{i % 2}" if i % 9 else None, t) for i, t in enumerate(texts)], "id bigint, g string, text string")
    monkeypatch.setattr(pairs, "BLOCK_SETS", block)
    out = fusion.near_duplicates(rows, "id", "g")
    wanted, sets = [], [plain.tokens(t) for t in texts]
    for j in range(len(texts)):
        for i in range(j):
            least = min(len(sets[i]), len(sets[j]))
            if i % 9 and j % 9 and i % 2 == j % 2 and least and len(sets[i] & sets[j]) / least >= 0.82:
                wanted.append((i, j, round(len(sets[i] & sets[j]) / least, 6)))
    assert sorted(tuple(r) for r in out.collect()) == sorted(wanted)
    # before, candidates were joined with both texts' tokens: eight exchanges of rows by token or pair
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4
