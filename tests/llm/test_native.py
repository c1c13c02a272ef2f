"""URL filters, mixing, quality rules, fingerprints and chat formatting on odd tables and against brute force."""

import hashlib
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of, sql
from tidemark.llm import chat, minhash, mixing, quality, urls
from tidemark.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x") for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, small, name):
    found, wanted = QUERIES[name](spark, small).toPandas(), sql(small, ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


# URLs

URLS = [
    (1, "http://a.example.net/en/x?q#f"), (2, "https://EXAMPLE.net/de"), (3, "https://x.net"), (4, "ftp://x.example.com/de/"), (5, "http://b.org/fr/a"), (6, "http://org/fr/"), (7, "http://notexample.com/de/"),
    (8, None), (9, ""), (10, "no scheme.net/"), (11, "http://"), (12, "http://x.net#a/"), (13, "http://a.net/?x://y.org/fr/"), (3, "https://x.net"), (None, "http://q.net/"), (14, "http://a.net/\nb"),
]


def judged(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_urls(spark, broadcast):
    rows = urls.judge_urls(spark.createDataFrame([(i, u, "h") for i, u in URLS], "page_id bigint, url string, host string"), urls.rule_table(spark), broadcast_rules=broadcast).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows) == Counter((i, *judged(u)) for i, u in URLS)


def test_urls_without_rows_or_rules(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judge_urls(none, urls.rule_table(spark)).count() == 0
    rules = spark.createDataFrame([(None, "/", "block")], "rule_host string, rule_path string, rule_verdict string")
    assert [r["verdict"] for r in urls.judge_urls(spark.createDataFrame([(1, "http://x.net/")], "page_id bigint, url string"), rules).collect()] == ["allow"]


def test_rules_that_end_within_a_part_and_ties(spark):
    rules = spark.createDataFrame([("a.b", "/pre", "block"), ("a.b", "/pre", "allow"), ("b", "/pref.", "allow")], "rule_host string, rule_path string, rule_verdict string")
    rows = urls.judge_urls(spark.createDataFrame([(1, "http://a.b/prefix"), (2, "http://a.b/pref.x"), (3, "http://a.b/p")], "page_id bigint, url string"), rules).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in rows} == {1: ("a.b/pre", "block"), 2: ("b/pref.", "allow"), 3: (None, "allow")} or {r["page_id"]: r["verdict"] for r in rows} == {1: "block", 2: "block", 3: "allow"}


def test_digest_tells_equal_short_hashes_apart(spark, monkeypatch):
    monkeypatch.setattr(urls, "SHORT_BITS", 1)
    for broadcast in (500_000, 0):
        rows = urls.judge_urls(spark.createDataFrame(URLS, "page_id bigint, url string"), urls.rule_table(spark), broadcast_rules=broadcast).collect()
        assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows) == Counter((i, *judged(u)) for i, u in URLS)


def test_urls_meet_rules_by_short_hash_alone(spark):
    plan = urls.judge_urls(spark.createDataFrame(URLS, "page_id bigint, url string"), urls.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"BroadcastHashJoin \[(.*?)\], \[(.*?)\]", plan)
    assert len(keys) == 1 and re.fullmatch(r"short#\d+L", keys[0][0]) and re.fullmatch(r"r_short#\d+L", keys[0][1])


def test_hosts_of_many_labels_and_letters_beyond_ascii(spark):
    rules = spark.createDataFrame([("Ä.DE", "/", "block"), ("", "/", "block")], "rule_host string, rule_path string, rule_verdict string")
    given = spark.createDataFrame([(1, "http://Ä.dE/x"), (2, "http://ä.de/x"), (3, "http://" + "a." * 5000 + "Ä.de/"), (4, None)], "page_id bigint, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge_urls(given, rules).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}


# mixing


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (budget - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark, monkeypatch):
    random.seed(1)
    monkeypatch.setattr(mixing, "BINS", 8)
    monkeypatch.setattr(mixing, "ORDERED_AT_ONCE", 5)
    rows = [(i, " ".join(["w"] * random.choice([0, 1, 3, 50, 900])), random.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(2007, "x y", "a")] * 3 + [(None, "q", "b"), (1000, None, "d"), (1001, " \t", None)]
    found = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    wanted = targets(sizes)
    taken = Counter()
    source = {i: s for i, _, s in rows}
    for r in found:
        assert abs(r["target"] - wanted[source[r["doc_id"]]]) < 1e-6 and r["source_size"] == sizes[source[r["doc_id"]]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s, t in wanted.items():
        assert taken[s] == int(t + 1e-9) or abs(taken[s] - t) <= 1
    again = mixing.mix_sources(docs(spark, rows).repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_mixed_documents_keep_columns(spark):
    rows = [(i, " ".join(["w"] * 20), "a" if i < 60 else "b") for i in range(80)]
    given = docs(spark, rows)
    out = mixing.mixed_documents(given)
    assert out.columns == given.columns
    counts = Counter(r["doc_id"] for r in out.collect())
    assert max(counts.values()) <= 2 and abs(sum(counts.values()) - 120) <= 2


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(docs(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]


# quality rules


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    random.seed(2)
    texts = [" ".join(random.choices("ab", k=random.randint(0, 60))) for _ in range(60)] + ["a b c d e f g h " * 40, "x\n" * 30, "\n\n \n", None, "", "é ü\x0bx\x1fy", "#*$%&|<>" * 9, "w " * 30_000]
    rows = quality.quality_report(docs(spark, [(i, t, None) for i, t in enumerate(texts)] + [(None, "a", None)])).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r["doc_id"] is not None:
            n, chars, symbols, dup, rep = base(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
            assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n) and not (r["base_failed"] and r["kept"])


def test_cascade_order_and_filter(spark):
    rows = docs(spark, [(i, "plain words " + " ".join(f"w{j}x{i}" for j in range(25)) if i % 2 else "few", None) for i in range(50)])
    rules = quality.order_rules(quality.measured(rows, ["doc_id"]), [quality.Rule("never", F.lit(False)), quality.Rule("half", F.length("_t") < 10)])
    assert [r.name for r in rules] == ["half", "never"]
    kept = quality.quality_filter(rows)
    assert kept.columns == rows.columns and {r["doc_id"] % 2 for r in kept.collect()} == {1}
    assert quality.quality_report(docs(spark, [])).count() == 0


def test_later_rules_see_only_what_earlier_ones_leave(spark):
    """A rule that raises an error for rows of the base, or of an earlier rule, if it is evaluated for them."""
    plain = " ".join(f"w{j}" for j in range(30))
    rows = docs(spark, [(1, "few", None), (2, "first " + plain, None), (3, plain, None), (4, "last " + plain, None)])
    fails = lambda column, word: F.when(F.col(column).startswith(word), F.raise_error(F.lit("evaluated"))).otherwise(F.lit(False)).cast("boolean")
    first, last = quality.Rule("first", fails("_t", "few") | F.col("_t").startswith("first")), quality.Rule("last", fails("_t", "first") | F.col("_t").startswith("last"))
    verdict = F.when(quality.first_rejection(quality.base_rules()).isNotNull(), F.lit("base")).otherwise(quality.first_rejection([first, last]))
    found = quality.measured(rows, ["doc_id"]).select("doc_id", verdict.alias("v")).collect()
    assert {r["doc_id"]: r["v"] for r in found} == {1: "base", 2: "first", 3: None, 4: "last"}


@pytest.mark.parametrize(("text", "rule"), [("one two " * 15 + " ".join(f"w{j}" for j in range(40)), "base"), (" ".join(["ab cd", *(f"x{j} ab cd" for j in range(20))]), "common_pair"), (" ".join("12 345 6 78".split() * 1 + [str(j * 7919) for j in range(40)]), "few_letters"), ("\n".join(f"line {j} goes on here ..." for j in range(20)), "broken_lines"), (" ".join(f"w{j}" for j in range(40)) + "#" * 15, "symbols")])
def test_rules_of_the_cascade(spark, text, rule):
    assert quality.quality_report(docs(spark, [(1, text, None)])).first()["rejected_by"] == rule


# fingerprints


def test_fingerprints(spark):
    random.seed(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(random.choices(words, k=n)) for n in (400, 400, 300, 90, 20, 5, 3, 1)] + ["", None, "", "same text of a few words", "same text of a few words", "ünïcödé 漢字 " * 20]
    table = [(i, t, None) for i, t in enumerate(texts)] + [(None, "no id", None)]
    rows = {r["doc_id"]: r for r in minhash.fingerprint_documents(docs(spark, table)).collect()}
    assert len(rows) == len(table)
    order = [*range(len(texts) - 1, -1, -1), None]
    of = dict(enumerate(texts)) | {None: "no id"}

    def shingles(t):
        w = WORD.findall(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def like(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, i in enumerate(order):
        text, following = of[i] or "", of[order[(k + 1) % len(order)]] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + following[:m]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - like(text, edited)) < 0.2 and abs(r["near_next"] - like(text, following)) < 0.2
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 2 * minhash.BINS
    assert rows[11]["fingerprint"] == rows[12]["fingerprint"] and rows[8]["fingerprint"] == rows[9]["fingerprint"] == minhash.NOTHING


def test_next_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 3)
    random.seed(6)
    ids = random.sample(range(10_000), 200)
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "k bigint, v string")
    found = {r["k"]: r["next_v"] for r in minhash.with_next(rows, "k", ["v"]).collect()}
    ordered = sorted(ids, reverse=True)
    assert found == {i: str(ordered[(n + 1) % len(ordered)]) for n, i in enumerate(ordered)}


def test_fingerprints_of_one_and_none(spark):
    assert minhash.fingerprint_documents(docs(spark, [])).count() == 0
    r = minhash.fingerprint_documents(docs(spark, [(1, "a b c d e f", None)])).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"a b c d e f"[:8] + b"a b").hexdigest()


# chat

SCHEMAS = [("find", json.dumps({"properties": {"q": {"type": "string"}, "n": {"type": "integer"}, "w": {"type": "number"}}, "required": ["q"], "additionalProperties": False}))]


def call(i, after=(), name="find", arguments=None):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": {"q": "x"} if arguments is None else arguments, "after": list(after)}) + "</tool_call>"


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", "look " + call("b", ["a"]) + call("a", [], "find", {"q": "y", "n": 3, "w": 1})), (1, 2, "tool", '<tool_result>{"id": "a", "content": "r1"}</tool_result>'),
        (1, 3, "tool", '<tool_result>{"id": "a", "content": "r2"}</tool_result><tool_result>{"id": "z", "content": "lost"}</tool_result>'), (2, 0, "assistant", call("a", ["b"]) + call("b", ["a"])),
        (2, 1, "assistant", call("c", [], "find", {"n": "3", "k": 1}) + call("d", [], "none") + call("e", [], "find", [1]) + "<tool_call>oops</tool_call>"), (None, 0, None, None),
    ]
    messages = spark.createDataFrame([(*r, "e") for r in rows], "conv_id bigint, turn bigint, role string, text string, extra string")
    out = chat.format_messages(messages, spark.createDataFrame(SCHEMAS, "name string, schema string")).collect()
    calls = {(r["conv_id"], r["call_id"]): r for r in out if r["kind"] == "call"}
    assert calls[1, "a"]["level"] == 0 and calls[1, "b"]["level"] == 1 and calls[1, "a"]["result_turn"] == 2 and calls[1, "b"]["result_turn"] is None
    assert calls[2, "a"]["level"] is None and calls[2, "b"]["level"] is None and calls[2, "c"]["level"] == 0
    assert calls[1, "a"]["valid"] and calls[2, "c"]["errors"] == "missing q; type of n; unknown k" and calls[1, "b"]["valid"] and calls[2, "d"]["errors"] == "unknown tool" and calls[2, "e"]["errors"] == "no object" and calls[2, None]["errors"] == "unknown tool"
    told = json.loads(calls[1, "a"]["json"])
    assert told["result"] == {"content": "r1", "turn": 2} and told["arguments"] == {"n": 3, "q": "y", "w": 1}
    assert calls[1, "a"]["json"] == json.dumps(told, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    alone = [json.loads(r["json"])["content"] for r in out if r["kind"] == "result"]
    assert sorted(alone) == ["lost", "r2"]
    assert [json.loads(r["json"])["content"] for r in out if r["kind"] == "message" and r["conv_id"] == 1 and r["turn"] == 1] == ["look"]


NESTED = {
    "type": "object", "required": ["a"], "additionalProperties": {"type": ["string", "null"]}, "properties": {
        "a": {"type": "object", "properties": {"b": {"type": "array", "items": {"type": "object", "required": ["c"], "properties": {"c": {"type": "integer"}}}}}, "additionalProperties": False},
        "e": {"enum": ["x", 2, {"k": [1]}, None]}, "n": {"type": "number"}, "t": {"type": ["integer", "boolean"]}}}


FITS = [
    ({"a": {}}, []), ({}, ["missing a"]), ({"a": []}, ["type of a"]), ({"a": {"z": 1}}, ["unknown a.z"]), ({"a": {"b": [{"c": 1}, {"c": 2}]}}, []), ({"a": {"b": [{"c": "1"}, {}, 7]}}, ["missing a.b[1].c", "type of a.b[0].c", "type of a.b[2]"]),
    ({"a": {}, "e": "x"}, []), ({"a": {}, "e": {"k": [1]}}, []), ({"a": {}, "e": None}, []), ({"a": {}, "e": "y"}, ["value of e"]), ({"a": {}, "n": 1}, []), ({"a": {}, "n": 1.5}, []), ({"a": {}, "n": "1"}, ["type of n"]),
    ({"a": {}, "t": True}, []), ({"a": {}, "t": 1.5}, ["type of t"]), ({"a": {}, "other": None, "more": "s"}, []), ({"a": {}, "other": 1}, ["type of other"]),
]


def test_schemas(spark):
    calls = spark.createDataFrame([(1, i, "i", "f", json.dumps(a), []) for i, (a, _) in enumerate(FITS)], "conv_id bigint, turn bigint, call_id string, name string, arguments string, after array<string>")
    found = chat.with_validation(calls, spark.createDataFrame([("f", json.dumps(NESTED))], "name string, schema string")).collect()
    assert {r["turn"]: r["errors"] for r in found} == {i: e for i, (_, e) in enumerate(FITS)}


def test_long_chains_and_circles(spark):
    """A chain of a thousand calls, each named before the one that it needs; a diamond; circles, and what needs them."""
    links = [(1, f"c{i}", [f"c{i + 1}"] if i < 999 else []) for i in range(1000)] + [(2, "a", ["b", "c"]), (2, "b", ["d"]), (2, "c", ["e"]), (2, "d", []), (2, "e", ["d"]), (2, "a", ["nobody"])]
    links += [(3, "a", ["a"]), (3, "b", ["a"]), (3, "c", []), (4, "a", ["b"]), (4, "b", ["c"]), (4, "c", ["a"]), (4, "d", ["e"]), (4, "e", []), (None, "a", ["b"]), (5, None, ["a"])]
    calls = spark.createDataFrame([(c, 0, i, a) for c, i, a in links], "conv_id bigint, turn bigint, call_id string, after array<string>")
    rows = chat.with_levels(calls).collect()
    assert len(rows) == len(links)
    found = {(r["conv_id"], r["call_id"]): r["level"] for r in rows}
    assert [found[1, f"c{i}"] for i in range(1000)] == [999 - i for i in range(1000)]
    assert [found[2, x] for x in "abcde"] == [3, 1, 2, 0, 1]
    assert [found[3, x] for x in "abc"] == [None, None, 0] and [found[4, x] for x in "abcde"] == [None, None, None, 1, 0]
    assert found[None, "a"] == found[5, None] == 0


def test_plain_turns_and_blocks_together(spark, tmp_path):
    """op3 over a table with tool blocks, plain turns, a very long text, nulls, repeated rows and extra columns."""
    long = "word " * 50_000
    rows = [(1, 0, "user", "a prompt of some length " * 8), (1, 1, "assistant", "fine"), (1, 2, "user", long), (1, 3, "assistant", "see " + call("x", ["1-2"], "reply", {"prompt": "p", "about": {"turn": 1}})), (1, 4, "tool", '<tool_result>{"id": "x", "content": "r"}</tool_result>')]
    rows += [(2, 0, "user", None), (None, None, None, None), (1, 1, "assistant", "fine")]
    spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id bigint, turn bigint, role string, text string, level int, name string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = chat.op3_chat_formatting(spark, str(tmp_path)).collect()
    calls = {(r["conv_id"], r["call_id"]): r for r in out if r["kind"] == "call"}
    assert calls[1, "1-0"]["level"] == 0 and calls[1, "1-2"]["level"] == 1 and calls[1, "1-2"]["errors"] == "value of about.size" and calls[1, "x"]["level"] == 2 and calls[1, "x"]["valid"] and calls[1, "x"]["result_turn"] == 4
    assert calls[2, "2-s"]["errors"] == "type of prompt" and calls[1, "1-0"]["result_turn"] == 1
    assert json.loads(calls[1, "1-2"]["json"])["arguments"]["prompt"] == long
    assert sorted(json.loads(r["json"])["content"] or "" for r in out if r["kind"] == "message") == ["", "", "see"]


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    calls, results = chat.turns_as_calls(none)
    assert chat.link_calls(calls, results, spark.createDataFrame(SCHEMAS, "name string, schema string")).count() == 0
