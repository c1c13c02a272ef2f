"""Tokens, packing, near-duplicates, languages, toxicity and the pipeline, against libraries, brute force and held-out rows."""

import json
import random
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import components, langid, packing, pretokens, simhash, tokens, toxicity
from tidemark.llm.common import written

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    None, "", " \t\n ", "plain text", "It's we'll THEY'VE  two  spaces \n\n lines\t", "naïve Straße ÇA İstanbul ΣΑΣ", "漢字かな交じり文 and 한국어", "emoji 👩‍👩‍👧 ok 🎉🎉", "<|endoftext|> in <|startoftext|>text<|endoftext|>", "<|ENDOFTEXT|> <|",
    "１２３ ½ ² x²", "a\u00a0b\u2003c\u3000d\u0085e", "e\u0301 combining", "tab\x0bvt\x0cff\x1cfs\x00nul", "don''t 's 'S '", "x" * 5000, "word " * 3000, "\u2028line\u2029par", "ﬁ ligature Ǆ", "'ll've", "ſ K Å", "a\r\nb", "مرحبا بالعالم", "0123456789 99", "ab\x01cdefgh\x1fij",
]


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, more.get("lang", "en"), f"s{i % 3}", 0) for i, t in enumerate(texts)], DOCS)


def library(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_token_counts(spark):
    rows = tokens.count_tokens(docs(spark, ODD), public_tokenizers.path("word_bpe_49k.json")).collect()
    wanted = library("word_bpe_49k.json", ODD)
    for r in rows:
        assert r["n_tokens"] == len(wanted[r["doc_id"]]), ODD[r["doc_id"]]
        assert r["n_bytes"] == len((ODD[r["doc_id"]] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 2048)
    assert tokens.count_tokens(docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "other"])
def test_any_tokenizer_file_and_long_runs(spark, tmp_path, name):
    """Both kinds that are cut here, one that isn't, and a megabyte of characters without a space, of which no cache keeps a thing."""
    path = public_tokenizers.path(name if name != "other" else "byte_bpe_50k.json")
    if name == "other":
        told = json.loads(Path(path).read_text())
        told["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, told["pre_tokenizer"]]}
        path = str(tmp_path / "other.json")
        Path(path).write_text(json.dumps(told))
    texts = ODD + ["漢字仮名" * 80_000, "12345 year 2024"]
    library = [Tokenizer.from_file(path).encode(x or "", add_special_tokens=False).ids for x in texts]
    found = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs(spark, texts), path).collect()}
    assert [found[i] for i in range(len(texts))] == [len(x) for x in library]
    encoded = packing.Encoder(path)
    for text, ids in zip(texts, library, strict=True):
        assert encoded(text or "") == np.array(ids, "<u4").tobytes()
    cache = encoded.ids.__self__
    assert all(len(k) <= pretokens.CACHED_CHARS for k in cache)


def test_caches_may_be_emptied(monkeypatch):
    monkeypatch.setattr(pretokens, "CACHE_ENTRIES", 2)
    n = pretokens.lengths(public_tokenizers.path("word_bpe_49k.json"), {"the": 1})
    words = ["the", "unusualness", "b", "c", "d", "unusualness", "the"]
    wanted = [len(x) for x in library("word_bpe_49k.json", words)]
    assert [n[w] for w in words] == wanted and len(n) + len(n.older) <= 4


def test_packing(spark):
    random.seed(1)
    texts = ODD + [" ".join(random.choices(["alpha", "beta", "gamma"], k=n)) for n in (10, 2047, 2048, 2049, 5000, 700, 1300, 1, 1, 1)]
    given = docs(spark, texts).where("doc_id IN (3, 4)").union(docs(spark, texts))
    rows = packing.pack_documents(given, public_tokenizers.path("byte_bpe_50k.json"), 2048).collect()
    ids = [x + [0] for x in library("byte_bpe_50k.json", texts)]
    by_doc, by_sequence = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and 0 < r["length"] <= 2048
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    copies = Counter([*range(len(texts)), 3, 4])
    for i, x in enumerate(ids):
        assert sum(r["length"] for r in by_doc[i]) == len(x) * copies[i]
        if len(x) <= 2048:
            assert all(r["piece"] == 0 for r in by_doc[i])
        else:
            assert sorted(r["length"] for r in by_doc[i])[1:] == [2048] * (len(by_doc[i]) - 1)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(x) * copies[i] for i, x in enumerate(ids))
    assert len(by_sequence) <= -(-total // 2048) + 1
    assert packing.pack_documents(docs(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_runs_are_best_fit_decreasing():
    random.seed(2)
    for _ in range(30):
        sizes = sorted((random.randint(1, 50) for _ in range(200)), reverse=True)
        gaps = []
        for s in sizes:
            fits = [g for g in gaps if g >= s]
            if fits:
                g = min(fits)
                gaps.remove(g)
            else:
                g = 50
            gaps.append(g - s)
        runs = packing.best_fit_runs(Counter(sizes), 50)
        n = Counter(sizes)
        ends = {}
        ranked = [(*r, (q[1] if q[0] == r[0] else n[r[0]])) for r, q in zip(runs, [*runs[1:], (0, 0, 0, 0)], strict=True)]
        for size, rank, first, offset, until in sorted(ranked, key=lambda r: (-r[0], r[1])):
            for k in range(until - rank):
                assert ends.get(first + k, 0) == offset
                ends[first + k] = offset + size
        assert sum(ends.values()) == sum(sizes) and len(ends) == len(gaps) and sorted(50 - e for e in ends.values()) == sorted(gaps)


def print_of(text, words=4):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(prints, ids, radius):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    f = np.array(prints, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= radius) + i + 1:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(f)):
        r = root(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[root(i)] for i in range(len(f))]


def test_simhash_components(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(30):
        w = random.choices(words, k=random.choice([3, 30, 300]))
        for _ in range(random.randint(1, 4)):
            v = list(w)
            if len(v) > 50:
                v[random.randrange(len(v))] = "edit"
            texts.append(" ".join(v))
    texts += ["", None, "  ", "ONE two", "one TWO", "é\x0bÉ a\x00b", "İ x"]
    rows = {r["doc_id"]: r for r in simhash.simhash_components(docs(spark, texts)).collect()}
    prints = [print_of(t) for t in texts]
    assert [int(rows[i]["fingerprint"], 16) for i in range(len(texts))] == prints
    assert [rows[i]["component_id"] for i in range(len(texts))] == components_of(prints, list(range(len(texts))), 4)
    assert simhash.simhash_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7, 13])
def test_forest_loses_no_link(spark, monkeypatch, radius):
    """Random fingerprints, chains of near ones and a dense group, through many shards and small leaves."""
    monkeypatch.setattr(simhash, "SHARD", 60)
    monkeypatch.setattr(simhash, "LEAF", 20)
    r = np.random.default_rng(radius)
    f = [int(x) for x in r.integers(0, 1 << 63, 400, dtype=np.uint64)]
    for x in list(f[:60]):
        for _ in range(3):
            for b in r.choice(64, max(1, radius), replace=False):
                x ^= 1 << int(b)
            f.append(x)
    centre = f[0]
    f += [centre ^ 1 << int(a) ^ 1 << int(b) for a, b in r.integers(0, 64, (300, 2))]
    f = sorted(set(f))
    signed = np.array(f, np.uint64).view(np.int64).tolist()
    table = written(spark.createDataFrame([(x,) for x in signed], "f0 long"), "prints")
    # the workers import the module anew, so small leaves are tried in this process too
    found = components.connected_components(written(simhash.near_links(table, simhash.blocks_of(radius), radius), "links")).toPandas()
    root = dict(zip(found["node"], found["root"], strict=True))
    wanted = components_of(f, signed, radius)
    assert [root.get(x, x) for x in signed] == wanted
    arr = np.array(f, np.uint64)
    up = list(range(len(f)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for bits, allowance in simhash.blocks_of(radius):
        for i, j in enumerate(simhash.shard_links(simhash.values_of([arr], bits), arr, None, np.zeros(len(arr), bool), allowance, radius, 0)):
            a, b = top(i), top(int(j))
            up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(f)):
        groups.setdefault(top(i), []).append(signed[i])
    assert [min(groups[top(i)]) for i in range(len(f))] == wanted


def test_leaf_keeps_links_between_reached_positions():
    """Sparse 4-chains s1-q1-q2-s2 in one leaf, the ends before the middles, so that both ends are searched from at once."""
    r = np.random.default_rng(5)
    base = [int(x) for x in r.integers(0, 1 << 63, 300, dtype=np.uint64)]
    ends, middles = [], []
    for x in base:
        bits = [1 << int(b) for b in r.choice(64, 12, replace=False)]
        chain = [x]
        for k in range(3):
            for b in bits[4 * k : 4 * k + 4]:
                x ^= b
            chain.append(x)
        ends += [chain[0], chain[3]]
        middles += chain[1:3]
    for f in (ends + middles, [int(x) for x in r.permutation(np.array(ends + middles, np.uint64))]):
        assert len(f) > 1000
        forest = simhash.Forest(len(f))
        simhash._leaf(forest, np.array(f, np.uint64), np.array(f, np.uint64), None, np.arange(len(f)), np.zeros(len(f), bool), 4, 4, 0)
        assert [forest.root(i) for i in range(len(f))] == components_of(f, list(range(len(f))), 4)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(5, 5), (7, 6)]
    rows = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(50)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group(spark):
    random.seed(8)
    words = [f"w{i}" for i in range(500)]
    a, b = (random.choices(words, k=300) for _ in range(2))
    near = list(a)
    near[150] = "changed"
    rows = [(3, " ".join(a)), (1, " ".join(near)), (2, " ".join(b)), (4, " ".join(a)), (4, " ".join(a)), (None, " ".join(b)), (5, None), (6, ""), (7, "lonely words here")]
    given = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    out = simhash.one_of_each_group(given)
    assert out.columns == given.columns and Counter(r["doc_id"] for r in out.collect()) == Counter([1, 2, 5, 7])
    twins = spark.createDataFrame([(9, "the same row", "en", "s", 0)] * 3, DOCS)
    assert simhash.one_of_each_group(twins).count() == 1 and simhash.one_of_each_group(twins.limit(0)).count() == 0


def pair_alike(r, n, resemblance):
    """Two texts with about n five-word shingles each, so many of them shared, and the exact resemblance of their sets."""
    words = [f"w{x}" for x in r.integers(0, 1 << 40, n + 4)]
    other = list(words)
    at = 0
    while True:
        a, b = (set(zip(*[w[k:] for k in range(5)])) for w in (words, other))
        if len(a & b) / len(a | b) <= resemblance:
            return " ".join(words), " ".join(other), len(a & b) / len(a | b)
        other[len(other) - 1 - at] = f"v{r.integers(0, 1 << 40)}"
        at += 1


def test_stage_keeps_what_is_less_alike(spark):
    """Pairs below 0.8, and documents that share nothing but one line many times over."""
    r = np.random.default_rng(11)
    texts = [t for x in (0.6, 0.7, 0.75, 0.78) for _ in range(15) for t in pair_alike(r, 200, x)[:2]]
    line = " ".join(f"l{k}" for k in range(10))
    texts += [" ".join([f"u{x}" for x in r.integers(0, 1 << 40, 300)] + [line] * 60) for _ in range(10)]
    assert simhash.one_of_each_group(docs(spark, texts)).count() == len(texts)


def test_stage_finds_what_is_alike(spark):
    """Isolated pairs at 0.8 or a little more."""
    r = np.random.default_rng(13)
    pairs = [p for x in (0.81, 0.82, 0.85, 0.9) for _ in range(30) if (p := pair_alike(r, 200, x))[2] >= 0.8]
    assert len(pairs) > 100 and simhash.one_of_each_group(docs(spark, [t for a, b, _ in pairs for t in (a, b)])).count() == len(pairs)


def test_alike_roots_against_brute_force():
    r = np.random.default_rng(12)
    for _ in range(30):
        sets = []
        for _ in range(6):
            b = r.integers(0, 1 << 62, r.integers(1, 40), dtype=np.uint64)
            for k in range(5):
                c = b.copy()
                m = r.integers(0, len(c) // 4 + 2)
                c[:m] = r.integers(0, 1 << 62, len(c[:m]), dtype=np.uint64)
                sets.append(np.unique(c))
                b = c if k % 2 else b
        up = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if shared / (len(sets[i]) + len(sets[j]) - shared) >= 0.8:
                    a, b = up[i], up[j]
                    up = [min(a, b) if x in (a, b) else x for x in up]
        assert simhash.alike_roots(sets) == up


def test_language(spark):
    random.seed(9)
    parts = {"en": ["the", "tion", "ing", "and", "th"], "de": ["der", "ung", "sch", "ü", "ich"], "fr": ["eau", "le", "é", "que", "ou"]}
    rows = [(i, " ".join("".join(random.choices(parts[lang], k=2)) for _ in range(40)), lang) for i, lang in enumerate(random.choices(list(parts), k=400))]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?", "fr"), (1003, "unlabelled theing", None), (None, "eauque leque", "fr")]
    given = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)
    out = {r["doc_id"]: r for r in langid.identify_languages(given).collect()}
    held = [(i, lang) for i, _, lang in rows if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] for i, _ in held) and np.mean([out[i]["lang_pred"] == lang for i, lang in held]) > 0.95
    assert [out[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1003]["lang_pred"] == "en" and 0 <= out[1003]["score"] <= 1
    assert langid.identify_languages(given.where("doc_id < 0")).count() == 0
    blind = {r["lang_pred"] for r in langid.identify_languages(given.withColumn("lang", F.lit(None).cast("string"))).collect()}
    assert blind == {"und"}


def test_letters_decide():
    assert not len(langid.codes_of("🎉 123 ½ _ \u0301")) and not len(langid.codes_of("")) and all(len(langid.codes_of(t)) for t in ("𝒜", "漢", "ª", "x"))
    assert langid.codes_of("a--B").tolist() == [0, 1, 0, 2, 0]


def test_scores_do_not_depend_on_neighbours():
    model = langid.train([("a", *langid.counts_of("abab baba abab")), ("b", *langid.counts_of("xyxy yxyx xyxy"))] * 10)
    texts = ["abab", "x", "yx yx", "", "ab xy", "b"]
    assert langid.score_texts(texts, model)[0] == [langid.score_texts([t], model)[0][0] for t in texts]
    together, alone = langid.score_texts(texts, model)[1], [langid.score_texts([t], model)[1][0] for t in texts]
    assert np.allclose(together, alone)


def toxic_corpus(spark, n=1500):
    random.seed(10)
    words = [a + b for a in ("ba", "ke", "lo", "mi", "nu") for b in ("ra", "so", "ti", "ve", "zu")]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = random.choices(words, k=random.randint(20, 80))
        if toxic:
            for _ in range(random.randint(2, 5)):
                w[random.randrange(len(w))] = random.choice(["you idiot", "vixor" + random.choice("abc"), "M0RON", "clown!"])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (None, "words", "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark):
    given, labels = toxic_corpus(spark)
    out = toxicity.score_toxicity(given, labels).toPandas()
    assert len(out) == given.count() and out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.5)).all()
    held = out[out["held_out"] & (out["doc_id"] < 5000)]
    assert ((held["doc_id"] % 5 == 0) == (held["predicted"] == 1)).mean() > 0.95
    assert (out[out["doc_id"] >= 5000]["predicted"] == 0).all()
    assert toxicity.score_toxicity(given, labels.limit(0)).count() == given.count()
    assert toxicity.score_toxicity(given.limit(0), labels).count() == 0


@pytest.mark.parametrize("filler", [20, 400])
def test_spelled_insults_and_capitals_count_at_any_length(filler):
    """A text whose only toxic content is spelled out, and one that shouts without a word of the lexicon."""
    scan, plain = toxicity.Scanner({}), "quiet words " * filler
    spelt, shouting = scan.features(plain + "i d i o t"), scan.features(plain + "LOUD WORDS")
    assert spelt[8] == 1 and scan.features(plain)[8] == 0
    assert shouting[9] == pytest.approx(200 / (2 * filler + 2)) and scan.features(plain)[9] == 0


def test_counts_and_splits_against_brute_force(spark):
    """Words by part and label against counting by hand; the best split of a node against trying all."""
    given, labels = toxic_corpus(spark, 300)
    sample = toxicity.labelled_texts(given, labels)
    rows = [tuple(r) for r in sample.collect()]
    sizes = np.zeros((toxicity.FOLDS, 2), int)
    for p, t, _ in rows:
        sizes[p, 1 - t] += 1
    wanted = []
    for left_out in [*range(toxicity.FOLDS), None]:
        seen = {}
        for p, t, text in rows:
            if p != left_out:
                for k in toxicity._keys_of(text):
                    seen.setdefault(k, [0, 0])[1 - t] += 1
        n = sizes[[p for p in range(toxicity.FOLDS) if p != left_out]].sum(axis=0)
        wanted.append(toxicity.learn_lexicon([(k, *v) for k, v in seen.items()], (int(n[0]), int(n[1]))))
    found = toxicity.lexicons(sample, sizes)
    assert found == wanted and len(found[-1]) > 3
    part, x, y = toxicity.fold_features(sample, found)
    by_hand = sorted((p, float(t), *toxicity.Scanner(found[p]).features(text)) for p, t, text in rows)
    assert np.allclose(sorted((p, t, *v) for p, t, v in zip(part.tolist(), y.tolist(), x.tolist(), strict=True)), by_hand)
    r = np.random.default_rng(3)
    binned, g, h = r.integers(0, 6, (60, 4)), r.normal(size=60), r.uniform(0.1, 1, 60)
    gain = toxicity.split_gains(binned, g, h, 6)
    for j in range(4):
        for k in range(5):
            left = binned[:, j] <= k
            few = min(left.sum(), (~left).sum()) < toxicity.LEAST_LEAF
            hand = 0 if few else g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
            assert abs(gain[j, k] - hand) < 1e-9


def test_ftrl_against_one_number_at_a_time():
    rows = [(0, np.array([0, 2]), np.array([1.0, 0.5])), (1, np.array([1, 2]), np.array([2.0, 0.25])), (1, np.array([1]), np.array([1.0]))] * 3
    z, n = [[0.0, 0.0] for _ in range(4)], [[0.0, 0.0] for _ in range(4)]

    def weight(i, k):
        if abs(z[i][k]) <= langid.L1:
            return 0.0
        return -(z[i][k] - np.sign(z[i][k]) * langid.L1) / ((langid.BETA + n[i][k] ** 0.5) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(11)
    for _ in range(2):
        for at in order.permutation(len(rows)):
            truth, ids, values = rows[at]
            x = [*zip(ids.tolist(), values.tolist(), strict=True), (3, 1.0)]
            score = [np.exp(sum(weight(i, k) * v for i, v in x)) for k in range(2)]
            step = []
            for i, v in x:
                for k in range(2):
                    g = v * (score[k] / sum(score) - (k == truth))
                    step.append((i, k, g, ((n[i][k] + g * g) ** 0.5 - n[i][k] ** 0.5) / langid.ALPHA * weight(i, k)))
            for i, k, g, pull in step:
                z[i][k] += g - pull
                n[i][k] += g * g
    assert np.allclose(langid.ftrl(rows, 3, 2, passes=2), [[weight(i, k) for k in range(2)] for i in range(4)])


def test_language_sample_is_held_once_on_the_driver(spark):
    draw = random.Random(3)
    letters = ["abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzéèàçùœ"]
    made = [(i, "".join(draw.choices(letters[i % 2], k=6000)) if i % 20 else "123", ("en", "fr")[i % 2], "s", 0) for i in range(200)]
    given = spark.createDataFrame(made, DOCS).repartition(7)
    tracemalloc.start()
    rows = langid.sample_grams(given, F.lit(False))
    model = langid.train(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * sum(len(ids) for _, ids, _ in rows)  # as Python's numbers they would take 80 bytes and more
    wanted = [(lang, *langid.counts_of(text)) for _, text, lang, *_ in sorted(made, key=lambda r: str(r[0])) if text != "123"]
    assert len(rows) == len(wanted) == 190 and model.languages == ["en", "fr"]
    for (lang, ids, shares), (its_lang, its_ids, its_shares) in zip(rows, wanted, strict=True):
        assert lang == its_lang and ids.tolist() == its_ids.tolist() and shares.tolist() == its_shares.astype(np.float32).tolist()
    same = langid.train([(lang, ids, shares.astype(np.float32).astype(np.float64)) for lang, ids, shares in wanted])
    assert model.bias.tolist() == same.bias.tolist() and model.temperature == same.temperature and np.array_equal(model.weights, same.weights)


def test_rare_languages_and_vowel_signs(spark):
    """A language of one row in five hundred is learned; vowel signs don't part words."""
    rows = [(i, "the thing and " * 20, "en") for i in range(3000)] + [(5000 + i, "eauque leau " * 20, "fr") for i in range(6)]
    given = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)
    model = langid.fit_language_model(given)
    assert model.languages == ["en", "fr"] and langid.score_texts(["eauque leau", "the thing"], model)[0] == ["fr", "en"]
    word = langid.codes_of("\u0915\u093f\u0924\u093e\u092c").tolist()
    assert len(word) == 7 and all(word[1:-1]) and not len(langid.codes_of("\u093f"))


def test_calibration_rises():
    points, values = toxicity.isotonic(np.array([0.0, 1.0, 2.0, 3.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(points) > 0).all() and (np.diff(values) >= 0).all()


CLASHES = ["size", "score", "row_key", "key", "row", "_key", "f0", "node", "held_out", "chunk", "_row", "_text", "skey", "target", "full", "at", "label", "toxic", "length", "rank", "t", "s", "_k", "_b", "lang_pred", "n_words", "kept"]


def test_extra_columns_may_have_any_name(spark, small):
    from tidemark.llm import minhash, mixing, quality

    plain = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    odd = plain.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHES])
    labels = spark.read.parquet(f"{small}/labels.parquet")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for run in (
        lambda d: toxicity.score_toxicity(d, labels), lambda d: tokens.count_tokens(d, path), simhash.simhash_components, mixing.mix_sources, minhash.fingerprint_documents, langid.identify_languages,
        lambda d: quality.quality_report(d).drop("rejected_by"), lambda d: packing.pack_documents(d, path),
    ):
        a, b = run(plain), run(odd)
        assert a.columns == b.columns and Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        a, b = stage(spark, plain, small), stage(spark, odd, small)
        assert b.columns == odd.columns and all(r["size"] == "size!" for r in b.collect()), name
        assert Counter(r["doc_id"] for r in a.collect()) == Counter(r["doc_id"] for r in b.collect()), name


def test_pipeline(spark, small):
    frames = [spark.read.parquet(f"{small}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(written(stage(spark, frames[-1], small), "stage"))
    raw, lang, clean, single, mix, packed = frames
    assert all(f.columns == raw.columns and f.dtypes == raw.dtypes for f in frames[:-1])
    ids = lambda f: {r[0] for r in f.select("doc_id").collect()}
    assert ids(lang) <= ids(raw) and ids(clean) <= ids(lang) and ids(single) <= ids(clean) and ids(mix) <= ids(single) and ids(packed) == ids(mix)
    assert lang.count() >= 0.98 * raw.count()
    texts = [r[0] for r in single.select("text").collect()]
    assert len(texts) == len(set(texts))
    assert corpus_pipeline.run(spark, small).count() == packed.count()
