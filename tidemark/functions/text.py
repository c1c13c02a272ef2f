"""Text as columns: normal forms, tokens, sentences, scripts, language and quality, all on the JVM side.

Full Unicode compatibility folding has no built-in expression; fold_exact covers letters of European scripts and kana, and
fold_exact_unicode, an Arrow function, covers the rest.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Words that questions carry and search ignores.
QUESTION_NOISE = [
    "请问", "介绍一下", "说明一下", "解释一下", "告诉我", "这个", "那个", "一下", "是谁", "是什么", "什么是", "为什么", "怎么", "如何", "多少", "多少岁", "几岁", "多大",
    "有哪些", "哪一些", "哪些", "哪里", "哪儿", "什么地方", "什么地点", "最好的朋友", "朋友", "关系", "的", "了", "吗", "呢",
    "who", "what", "where", "when", "why", "how", "is", "are", "was", "were", "do", "does", "did", "about", "tell", "me",
]
STOPWORDS = QUESTION_NOISE + ["the", "and", "or", "of", "to", "in", "on", "for", "with", "a", "an"]

# Characters that stand for a space or a hyphen, and punctuation that search drops.
MIDDLE_DOTS = "·・•"
DASHES = "–—－"
DROPPED = "，。！？；：、,!?;:()[]{}<>《》「」『』“”\"'"
DROPPED_CLASS = r"[，。！？；：、,!?;:()\[\]{}<>《》「」『』“”\"']"
CJK_CLASS = r"[一-鿿぀-ヿ가-힯]"
SYMBOLS = r"\.[A-Za-z][A-Za-z0-9_+#-]*|[A-Za-z_][A-Za-z0-9_]*\(\)|[A-Za-z]:\\[^\s]+|/[^\s]+|v\d+(?:\.\d+)+|C\+\+|C#"

# Code point ranges of scripts, as character classes.
SCRIPTS = {
    "Arabic": r"؀-ۿݐ-ݿ",
    "Cyrillic": r"Ѐ-ӿ",
    "Digit": r"0-9０-９",
    "Han": r"一-鿿㐀-䶿豈-﫿",
    "Hangul": r"가-힯ᄀ-ᇿ",
    "Hiragana": r"぀-ゟ",
    "Katakana": r"゠-ヿㇰ-ㇿ",
    "Latin": r"A-Za-zÀ-ɏ",
}


def _accents() -> tuple[str, str]:
    """Lower-case letters and kana that decompose to one character and marks, and those characters.

    Hangul is left composed: its syllables decompose to letters, not to marks.
    """
    found = {}
    for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000), *range(0x3040, 0x3100)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1 and c == c.lower():
            found[c] = base
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _accents()


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row, even where the body has it within lambdas or branches."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeezed(c: Column) -> Column:
    # a single space is one already, so only longer runs and other white space are replaced
    return F.btrim(F.regexp_replace(c, r"\s{2,}|[\t\n\x0B\f\r]", " "), F.lit(" "))


def fold_exact(c: Column) -> Column:
    """Lower case without accents, middle dots as spaces, dashes as hyphens, single spaces; null as empty."""
    v = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))
    v = F.translate(v, MIDDLE_DOTS + DASHES + ACCENTED, "   ---" + PLAIN)
    return squeezed(F.regexp_replace(v, r"\p{Mn}", ""))


@pandas_udf(StringType())
def fold_exact_unicode(texts: pd.Series) -> pd.Series:
    """fold_exact after compatibility composition and full case folding of all of Unicode."""
    table = str.maketrans(MIDDLE_DOTS + DASHES, "   ---")

    def fold(text: str | None) -> str:
        v = unicodedata.normalize("NFKC", text or "").casefold().translate(table)
        return " ".join("".join(x for x in unicodedata.normalize("NFD", v) if unicodedata.category(x) != "Mn").split())

    return texts.map(fold)


def lexical_of(folded: Column) -> Column:
    """A folded text with punctuation as spaces; . / + # - _ and backslashes stay."""
    return squeezed(F.translate(folded, DROPPED, " " * len(DROPPED)))


def fold_lexical(c: Column) -> Column:
    return lexical_of(fold_exact(c))


def entity_key(c: Column) -> Column:
    """The folded name without separators and punctuation; . + # / _ stay."""
    return F.translate(F.regexp_replace(fold_exact(c), r"[\s·・•\-—–]+", ""), DROPPED, "")


def compact(c: Column) -> Column:
    """The text without white space, separators, quotes, brackets and sentence marks; case stays."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s·・•《》「」『』“”\"'：:，,。？?！!、()（）\[\]【】\-_—.]+", "")


def ngrams(chars: Column, n: int) -> Column:
    """Runs of n elements of an array of characters, joined."""
    starts = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), ""))


def _unspaced(c: Column) -> Column:
    """fold_lexical but for white space, which is left as it is: one translation folds letters and drops punctuation."""
    v = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))
    plain = "".join(" " if x in DROPPED else x for x in "   ---" + PLAIN) + " " * len(DROPPED)
    return F.regexp_replace(F.translate(v, MIDDLE_DOTS + DASHES + ACCENTED + DROPPED, plain), r"\p{Mn}", "")


def _symbols(c: Column) -> Column:
    """What SYMBOLS finds, lower-cased; most texts hold none of its marks, and are not searched for it."""
    text = F.coalesce(c, F.lit(""))
    marked = F.contains(text, F.lit("/")) | F.contains(text, F.lit("()")) | F.contains(text, F.lit(":\\")) | F.contains(text, F.lit("C+")) | F.contains(text, F.lit("C#")) | text.rlike(r"\.[A-Za-z]|v\d")
    return F.when(marked, F.transform(F.regexp_extract_all(text, F.lit(SYMBOLS), F.lit(0)), F.lower)).otherwise(F.array().cast("array<string>"))


def _grams(lexical: Column) -> Column:
    grams = let(F.regexp_extract_all(lexical, F.lit(CJK_CLASS), F.lit(0)), lambda cjk: F.concat(ngrams(cjk, 2), ngrams(cjk, 3)))
    return F.when(lexical.rlike(CJK_CLASS), grams).otherwise(F.array().cast("array<string>"))


def search_tokens(c: Column, stopwords: list[str] | None = None) -> Column:
    """Distinct tokens in order: words of two or more characters, CJK bigrams and trigrams over all CJK characters, symbols."""
    symbols = _symbols(c)

    def tokens(lexical: Column) -> Column:
        return F.concat(F.regexp_extract_all(lexical, F.lit(r"[a-z0-9_+#./-]{2,}"), F.lit(0)), _grams(lexical), symbols)

    return F.array_except(let(_unspaced(c), tokens), F.array(*map(F.lit, STOPWORDS if stopwords is None else stopwords)))


def lexical_words(c: Column) -> Column:
    """Distinct strings without white space: whatever holds no space occurs in a text's tokens or in its lexical form where it occurs
    in one of these. Tokens that are words are parts of the lexical form's words, so only the other tokens are added to those."""
    symbols = _symbols(c)
    stop = F.array(*map(F.lit, STOPWORDS))

    def words(lexical: Column) -> Column:
        return F.array_union(F.split(lexical, r"\s+"), F.flatten(F.transform(F.array_except(F.concat(_grams(lexical), symbols), stop), lambda x: F.split(x, " "))))

    return F.filter(let(_unspaced(c), words), lambda w: w != "")


def sentences(c: Column) -> Column:
    """Sentences, trimmed: a break after 。！？!?；; or after . ! ? and white space before a capital, digit or quote."""
    parts = F.split(c, r"(?<=[。！？!?；;])\s*|(?<=[.!?])\s+(?=[A-Z0-9\"'])")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def script_counts(c: Column) -> Column:
    """Script name to number of characters, for scripts that occur."""
    text = F.coalesce(c, F.lit(""))
    entries = F.array(*[F.struct(F.lit(name).alias("key"), F.regexp_count(text, F.lit(f"[{chars}]")).alias("value")) for name, chars in SCRIPTS.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def script_distribution(c: Column) -> Column:
    """Script name to its share of all characters of a known script, to four places."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda a, x: a + x)
    return let(script_counts(c), lambda m: let(total(m), lambda n: F.transform_values(m, lambda _, v: F.round(v / n, 4))))


def language_by_script(c: Column) -> Column:
    """struct(language, confidence, is_mixed) by the shares of scripts; Latin texts get en at 0.45, as no model is asked."""
    return let(script_distribution(c), _language_of)


def _language_of(d: Column) -> Column:
    share = lambda s: F.coalesce(F.element_at(d, s), F.lit(0.0))
    has = lambda s: share(s) > 0
    mixed = F.size(F.filter(F.map_entries(d), lambda e: (e["key"] != "Digit") & (e["value"] >= 0.18))) >= 2
    # the largest share wins, the first by name between equal ones
    first = {name: len(SCRIPTS) - i for i, name in enumerate(sorted(SCRIPTS))}
    order = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    major = F.array_max(F.transform(F.map_entries(d), lambda e: F.struct(e["value"].alias("v"), F.element_at(order, e["key"]).alias("o"), e["key"].alias("name"))))
    kana = has("Hiragana") | has("Katakana")
    out = lambda lang, conf: F.struct(F.lit(lang).alias("language"), conf.cast("double").alias("confidence"), F.coalesce(mixed, F.lit(False)).alias("is_mixed"))
    return (
        F.when(F.size(d) == 0, out("unknown", F.lit(0.0)))
        .when(has("Han") & kana, out("ja", F.least(F.lit(0.95), share("Han") + share("Hiragana") + share("Katakana"))))
        .when(has("Hangul"), out("ko", share("Hangul")))
        .when(has("Han") & ~mixed, out("zh", share("Han")))
        .when(has("Arabic") & ~mixed, out("ar", share("Arabic")))
        .when(has("Cyrillic") & ~mixed, out("ru", share("Cyrillic")))
        .when(mixed, out("mixed", major["v"]))
        .when(major["name"] == "Latin", out("en", F.lit(0.45)))
        .otherwise(out("unknown", major["v"]))
    )


def text_quality(c: Column, ocr: Column | None = None) -> Column:
    """Share of letters and digits less twice the share of long repeats, 0 to 1 to four places; times 0.88 for OCR."""
    tight = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    size = F.greatest(F.char_length(tight), F.lit(1))
    valid = F.regexp_count(tight, F.lit(r"[A-Za-z0-9一-鿿぀-ヿ가-힯Ѐ-ӿ؀-ۿ]"))
    repeats = F.regexp_count(tight, F.lit(r"(.)\1{4,}"))
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), valid / size - 2.0 * repeats / size))
    return F.round(q if ocr is None else F.when(ocr, q * 0.88).otherwise(q), 4)


def without_controls(c: Column) -> Column:
    """The text without control characters below space but for line feeds and tabs."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B-\x1F]", "")


def is_useful(c: Column) -> Column:
    """Eight characters or more besides white space, of which at least 35 % letters, digits or CJK."""
    tight = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    good = F.regexp_count(tight, F.lit(r"[A-Za-z0-9一-鿿]"))
    return (F.char_length(tight) >= 8) & (good / F.greatest(F.char_length(tight), F.lit(1)) >= 0.35)


def is_margin(text: Column, y0: Column, y1: Column, page_height: Column, page: Column, pages: Column) -> Column:
    """An empty block, or one in the top or bottom 6 % of its page that is short or nothing but the page's mark."""
    tight = F.regexp_replace(text, r"\s+", "")
    number = page.cast("string")
    mark = (tight == number) | (tight == F.concat(number, F.lit("/"), pages.cast("string"))) | (tight == F.concat(F.lit("-"), number, F.lit("-")))
    return (tight == "") | (((y1 < page_height * 0.06) | (y0 > page_height * 0.94)) & ((F.char_length(tight) <= 30) | mark))


def joined_lines(c: Column) -> Column:
    """Lines wrapped by a layout joined to paragraphs.

    A line is joined to the one before unless that ends in . 。 ！ ? ？ ； ; ： : or it begins like a heading. A hyphen before
    a lower-case letter goes; where CJK outweighs Latin no space is put in between. Empty lines end a paragraph and stay.
    """
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, line: Column) -> Column:
        text = a["open"]
        cjk = F.regexp_count(F.concat(text, line), F.lit(r"[一-鿿]")) > F.regexp_count(F.concat(text, line), F.lit("[A-Za-z]"))
        joins = ~text.rlike(r"[.。！?？；;：:]$") & ~line.rlike(r"^\s*(第?\d+[章节条.、)]|[A-Z][A-Z\s]{4,})")
        glued = F.when(text.endswith("-") & line.rlike(r"^\p{Ll}"), F.concat(F.left(text, F.char_length(text) - 1), line)).when(cjk, F.concat(text, line)).otherwise(F.concat(text, F.lit(" "), line))
        pair = lambda done, rest: F.struct(done.alias("done"), rest.alias("open"))
        closed = F.when(text == "", a["done"]).otherwise(F.concat(a["done"], F.array(text)))
        return (
            F.when(line == "", pair(F.concat(closed, F.array(F.lit(""))), F.lit("")))
            .when(text == "", pair(a["done"], line))
            .when(joins, pair(a["done"], glued))
            .otherwise(pair(closed, line))
        )

    finish = lambda a: F.array_join(F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))), "\n")
    return F.aggregate(lines, empty, step, finish)


def normalized(c: Column) -> Column:
    """Controls gone, spaces squeezed within lines, wrapped lines joined, at most one blank line in a row."""
    lines = F.regexp_replace(without_controls(c), r"[ \t]+", " ")
    text = joined_lines(lines)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "), r"^\s+|\s+$", "")


#: Characters over both ends that a text may have and stay whole.
SLACK = 120


def bounded_excerpt(c: Column, head: int, tail: int, slack: int = SLACK) -> Column:
    """The text, or where it is longer than head, tail and slack together its two ends with a mark between."""
    gap = F.lit("\n\n[...中间原文窗口省略...]\n\n")
    return F.when(F.char_length(c) <= head + tail + slack, c).otherwise(F.concat(F.left(c, F.lit(head)), gap, F.right(c, F.lit(tail))))


def region_of(position: Column) -> Column:
    return F.when(position <= 0.16, "front").when(position >= 0.78, "terminal").otherwise("middle")


def surface_variants(c: Column) -> Column:
    """The name, its key, and the keys of its dotted or spaced runs; distinct, without blanks."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(r"[一-鿿A-Za-z]+[·・•\s]+[一-鿿A-Za-z·・•\s]+"), F.lit(0)), entity_key)
    return F.filter(F.array_distinct(F.concat(F.array(c, entity_key(c)), runs)), lambda x: F.btrim(x) != "")


# What marks a type of document, in the order in which they are tried; of lower-cased text but for the third,
# and the fifth also of the file's name.
DOCUMENT_TYPES = {
    "contract": r"(合同|协议|甲方|乙方|违约|contract|agreement)",
    "policy": r"(制度|政策|办法|条例|policy|procedure)",
    "technical_doc": r"(def |class |function|api|README|```|参数|接口)",
    "report": r"(报告|年度|季度|分析|report)",
    "book": r"(小说|历险记|chapter|第[一二三四五六七八九十百\d]+章|文学)",
}
# Dates, versions, authors, lines that are no titles, titles in brackets.
DATE = r"(20\d{2}|19\d{2})[-年./](\d{1,2})?[-月./]?(\d{1,2})?"
VERSION = r"(?i)\b(v?\d+(?:\.\d+){1,3})\b|版本[:：\s]*([A-Za-z0-9_.-]+)"
AUTHORS = [r"(?i)(?:作者|著|发布方|编者|Author|By)[:：\s]+([^\n]{2,80})", r"([^\n]{1,40})(?:著|编著|译)"]
NO_TITLE = r"ISBN|CIP|责任编辑|出版社|第\s*\d+\s*页"
BRACKETED = "《([^》]{2,40})》"


def document_type(sample: Column, lower_name: Column) -> Column:
    low = F.lower(sample)
    over = {"technical_doc": sample, "book": F.concat(low, lower_name)}
    return F.coalesce(*[F.when(over.get(kind, low).rlike(pattern), F.lit(kind)) for kind, pattern in DOCUMENT_TYPES.items()], F.lit("unknown"))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), pattern, group)


def infer_date(c: Column) -> Column:
    return first_match(c, DATE)


def infer_version(c: Column) -> Column:
    return F.concat(first_match(c, VERSION, 1), first_match(c, VERSION, 2))


def infer_author(c: Column) -> Column:
    """By the first pattern that finds one; the empty string if none does."""
    return F.coalesce(*[F.nullif(F.btrim(first_match(c, p, 1)), F.lit("")) for p in AUTHORS], F.lit(""))


def infer_title(c: Column, stem: Column) -> Column:
    """The first of eight lines of 2 to 80 characters that is no imprint or page mark; else the file's stem."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.btrim(x))
    fit = F.slice(F.filter(lines, lambda x: (F.char_length(x) >= 2) & (F.char_length(x) <= 80)), 1, 8)
    return F.coalesce(F.get(F.filter(fit, lambda x: ~x.rlike(NO_TITLE)), 0), stem)


def topics_of(c: Column, title: Column) -> Column:
    found = F.concat(F.array(title), F.regexp_extract_all(c, F.lit(BRACKETED), F.lit(1)))
    return F.slice(F.filter(F.array_distinct(F.transform(found, lambda x: F.btrim(x))), lambda x: x != ""), 1, 8)


def safe_name(c: Column) -> Column:
    """The last part of a path with .. as an underscore."""
    return F.replace(F.element_at(F.split(c, r"[\\/]"), -1), F.lit(".."), F.lit("_"))


def collection_name(c: Column) -> Column:
    return F.left(F.regexp_replace(c, r"[^A-Za-z0-9_-]+", "_"), F.lit(63))
