"""Quality rules: a short-circuit cascade in the order of rejections per cost, both estimated on a sample."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, let, read_table, uniform, whole, word_list, written

#: Words of a window whose repetition counts.
WINDOW = 8
#: Rows on which costs and selectivities are estimated, as an expected number; the estimate alters the order alone.
SAMPLE_ROWS = 2000
#: Passes over the sample for each rule.
PASSES = 2


def n_duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line; the lines are looked at one by one only where any two are equal."""
    def count(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
        return F.when(F.size(F.array_distinct(lines)) == F.size(lines), F.lit(0)).otherwise(let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))))

    return let(F.split(text, "\n"), count).cast("bigint")


def _window_hashes(words: Column) -> Column:
    last = F.size(words) - WINDOW
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(let(hashed, lambda h: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))))


def _covered(starts: Column) -> Column:
    """Words within windows at the given ascending starts."""
    first = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).cast("bigint").alias("n"), (p + WINDOW).cast("bigint").alias("end"))
    return F.aggregate(starts, first, step, lambda a: a["n"])


def n_repeated_words(words: Column) -> Column:
    """Words in windows of eight words that the text has twice or more.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Where all differ, which holds for most texts,
    nothing is sorted; else the windows are sorted by hash, and those with an equal neighbour are the repeated ones.
    """
    def repeated(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("bigint").alias("i"))))
        twin = lambda s, x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        starts = let(ordered, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: twin(s, x, k)), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(_covered(starts))

    return let(_window_hashes(words), repeated).cast("bigint")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)


def n_commonest_pair(words: Column) -> Column:
    """How often the commonest pair of neighbouring words occurs: the longest run among the pairs' sorted 64-bit hashes."""
    start = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, h: Column) -> Column:
        run = F.when(a["h"] == h, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(h.alias("h"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    hashes = F.array_sort(F.filter(pairs, lambda h: h.isNotNull()))
    return F.aggregate(hashes, start, step, lambda a: a["best"])


@dataclass(frozen=True)
class Rule:
    """rejects: a condition over the columns of measured(), true where the document goes."""

    name: str
    rejects: Column


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep with _t, the text (a null one as empty), _w, its words, and the base counts."""
    text = whole("text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_t"), word_list(text).alias("_w"))
    return rows.select(
        *[F.col(f"`{c}`") for c in keep], "_t", "_w", F.size("_w").cast("bigint").alias("n_words"), F.char_length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"), n_duplicate_lines(F.col("_t")).alias("n_dup_lines"), n_repeated_words(F.col("_w")).alias("n_repeat_words"),
    )


def base_rules() -> list[Rule]:
    return [Rule("few_words", F.expr("n_words < 20")), Rule("repeated_words", F.expr("100 * n_repeat_words > 30 * n_words"))]


def standard_rules() -> list[Rule]:
    """Word length, symbols, equal lines, words without a letter, lines that break off, one pair of words all over.

    The first two read counts that the base has made; the others look at words or lines again, each at its own cost.
    """
    words, text, n = F.col("_w"), F.col("_t"), F.col("n_words")
    lettered = F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))
    broken = let(lines_of(text), lambda x: 100 * F.size(F.filter(x, lambda y: y.rlike(r"(?:…|\.\.\.)[\x20\x09-\x0D]*\z"))) > 30 * F.size(x))
    return [
        Rule("word_length", F.expr("word_chars < 2 * n_words OR word_chars > 15 * n_words")), Rule("symbols", F.expr("10 * n_symbols > 3 * n_words")), Rule("duplicate_lines", 100 * F.col("n_dup_lines") > 30 * F.size(lines_of(text))),
        Rule("few_letters", 2 * lettered < n), Rule("broken_lines", broken), Rule("common_pair", 100 * n_commonest_pair(words) > 20 * n),
    ]


def order_rules(rows: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> list[Rule]:
    """The rules by rejections per second, both measured on a sample of rows (of measured()); equal ones keep their order.

    A rule's cost is the least time of PASSES passes over the written sample, less that of passes that only read it. The
    sample holds sample_rows documents or so at any size. The order changes what a row costs, never its verdict.
    """
    n = rows.count()
    sample = written(rows.where(uniform(F.col(id_col), "rules:") < F.lit(min(1.0, sample_rows / max(n, 1)))), "rule-sample")

    def passed(condition: Column) -> tuple[float, int]:
        times, hits = [], 0
        for _ in range(PASSES):
            began = time.perf_counter()
            hits = sample.agg(F.count_if(condition), F.count_if(F.size("_w") + F.length("_t") < 0)).first()[0]
            times.append(time.perf_counter() - began)
        return min(times), hits

    passed(F.lit(False))  # the first pass also compiles
    idle = passed(F.lit(False))[0]
    found = []
    for rule in rules:
        seconds, hits = passed(rule.rejects)
        found.append(hits / max(seconds - idle, 1e-4))
    dropped(rows.sparkSession, sample)
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -found[i])]


def first_rejection(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def quality_filter(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The documents that pass the base and all rules, with their columns.

    Null texts count as empty, and few words reject them. Rows are judged one by one, so repeated ones stay or go together;
    an empty table gives an empty table. The order of the cascade comes from a sample drawn by text.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    rules = order_rules(measured(rows, ["text"]), base_rules() + (standard_rules() if rules is None else rules), id_col="text")
    return measured(rows, ["row"]).where(first_rejection(rules).isNull()).select("row.*")


def quality_report(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by for each row.

    Null texts count as empty and fail the base. Repeated rows and null ids each give a row; other columns are not read;
    an empty table gives an empty table. Base counts are made for every row. The rules run as a cascade in the order that
    the sample gives, for rows that have passed the base, and each only for rows that no earlier one has rejected;
    rejected_by names the one that did. kept doesn't depend on the order; rejected_by does where several would reject.
    """
    rows = measured(docs, ["doc_id"])
    rules = order_rules(rows, standard_rules() if rules is None else rules)
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = first_rejection(base_rules())
    judged = rows.select(*counts, base.isNotNull().alias("base_failed"), F.when(base.isNotNull(), F.lit("base")).otherwise(first_rejection(rules)).alias("rejected_by"))
    return judged.select(*counts, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the rules over every document; without rejected_by, which may differ between reruns."""
    return quality_report(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("rejected_by")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  list_transform(range(0, len(w) - 7), lambda i: array_to_string(w[i + 1:i + 8], ' ')) AS g FROM d),
x AS (SELECT doc_id, unnest(g) AS h, unnest(range(0, len(g))) AS i FROM l),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM x),
p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM r WHERE c > 1),
n AS (SELECT doc_id, sum(least(8, i - coalesce(q, -8)))::BIGINT AS n FROM p GROUP BY doc_id),
f AS (SELECT doc_id, max(c) AS pair FROM (SELECT doc_id, p, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM d) GROUP BY ALL) GROUP BY doc_id),
b AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS lettered,
  len(list_filter(lines, lambda x: regexp_matches(x, '(?:…|\.\.\.)[\x20\x09-\x0D]*\z'))) AS broken, coalesce(f.pair, 0) AS pair FROM l LEFT JOIN n ON l.doc_id = n.doc_id LEFT JOIN f ON l.doc_id = f.doc_id),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > 3 * n_words
  OR 100 * n_dup_lines > 30 * n_lines OR 2 * lettered < n_words OR 100 * broken > 30 * n_lines OR 100 * pair > 20 * n_words) AS kept
FROM v
"""
