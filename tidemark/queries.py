"""The registered queries: each applies operators to whole test tables; SQL says the same where it can.

documents are source units: source is the file, doc_id the order in it. benchmark holds the questions, embeddings the vectors.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import requirements
from tidemark.functions import text as T
from tidemark.functions.embedding import hashed_embedding
from tidemark.operators import chunking, entities, fusion, maintenance, metrics, search, structure
from tidemark.plans import evidence
from tidemark.plans.query_plan import coverage_plan
from tidemark.sources.tables import small_batches, spread, stored
from tidemark.sources.text_sources import csv_text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name == "documents" else found  # whose texts take time


# SQL of the text functions

_DROP = T.DROPPED_CLASS.replace("'", "''")
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
_SYM = T.SYMBOLS


def s_fold(x: str) -> str:
    folded = f"replace(strip_accents(replace(lower(coalesce({x}, '')), 'ß', 'ss')), 'ß', 'ss')"
    return f"trim(regexp_replace(translate({folded}, '·・•–—－', '   ---'), '\\s+', ' ', 'g'))"


def s_lex(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({s_fold(x)}, '{_DROP}', ' ', 'g'), '\\s+', ' ', 'g'))"


def s_key(x: str) -> str:
    return f"regexp_replace(regexp_replace({s_fold(x)}, '[\\s·・•\\-—–]+', '', 'g'), '{_DROP}', '', 'g')"


def s_tokens(x: str) -> str:
    """Distinct tokens, sorted."""
    cjk = f"regexp_extract_all({s_lex(x)}, '{_CJK}')"
    grams = "||".join(f"list_transform(range(1, len({cjk}) - {n - 2}), lambda i: array_to_string({cjk}[i:i+{n - 1}], ''))" for n in (2, 3))
    words = f"regexp_extract_all({s_lex(x)}, '[a-z0-9_+#./-]{{2,}}') || {grams} || list_transform(regexp_extract_all(coalesce({x}, ''), '{_SYM}'), lambda y: lower(y))"
    return f"list_sort(list_distinct(list_filter({words}, lambda y: NOT list_contains({_STOP}, y))))"


# text functions


def _text_query(column, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", column(F.col("text")).alias(name))

    return run


@query(f"SELECT doc_id, {s_fold('text')} AS folded FROM documents")
def fold_exact(spark, sf_dir):
    return _text_query(T.fold_exact, "folded")(spark, sf_dir)


@query(f"SELECT doc_id, {s_fold('text')} AS folded FROM documents")
def fold_exact_unicode(spark, sf_dir):
    return _text_query(T.fold_exact_unicode, "folded")(spark, sf_dir)


@query(f"SELECT doc_id, {s_lex('text')} AS lexical FROM documents")
def lexical_norm(spark, sf_dir):
    return _text_query(T.fold_lexical, "lexical")(spark, sf_dir)


@query(f"SELECT doc_id, {s_key('text')} AS key FROM documents")
def entity_key(spark, sf_dir):
    return _text_query(T.entity_key, "key")(spark, sf_dir)


@query(f"SELECT doc_id, len(t)::INT AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {s_tokens('text')} AS t FROM documents)")
def token_counts(spark, sf_dir):
    tokens = F.array_sort(T.search_tokens(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


_CJK_ROWS = [(1, "汤姆·索亚历险记是谁写的"), (2, "東京タワーはどこ"), (3, "API timeout v1.2.0 C++ C# .NET C:\\tmp\\foo_bar.py"), (4, "서울 타워"), (5, ""), (6, "Müller—Straße café")]
_CJK_VALUES = ", ".join("({}, '{}')".format(i, x) for i, x in _CJK_ROWS)


@query(f"WITH r(id, x) AS (VALUES {_CJK_VALUES}) SELECT id::INT AS id, array_to_string({s_tokens('x')}, '|') AS tokens FROM r")
def cjk_ngrams(spark, sf_dir):
    rows = spark.createDataFrame(_CJK_ROWS, "id int, x string")
    return rows.select("id", F.array_join(F.array_sort(T.search_tokens(F.col("x"))), "|").alias("tokens"))


_SQL_SCRIPTS = {"Digit": r"[0-9\x{ff10}-\x{ff19}]", "Latin": r"[A-Za-z\x{00c0}-\x{024f}]", "Han": r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]", "Cyrillic": r"[\x{0400}-\x{04ff}]"}


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::INT AS {n.lower()}" for n, p in _SQL_SCRIPTS.items()) + " FROM documents")
def script_counts(spark, sf_dir):
    m = T.script_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", m.alias("m")).select("doc_id", *[F.coalesce(F.element_at("m", n), F.lit(0)).alias(n.lower()) for n in _SQL_SCRIPTS])


@query(
    f"WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '{_SQL_SCRIPTS['Latin']}')) AS l, len(regexp_extract_all(text, '{_SQL_SCRIPTS['Digit']}')) AS d FROM documents) "
    "SELECT doc_id, CASE WHEN l + d = 0 THEN 'unknown' WHEN l >= d AND l > 0 AND NOT (l = d AND false) AND round(l / (l + d), 4) > round(d / (l + d), 4) THEN 'en' ELSE 'unknown' END AS language, "
    "CASE WHEN l + d = 0 THEN 0.0::DOUBLE WHEN round(l / (l + d), 4) > round(d / (l + d), 4) THEN 0.45::DOUBLE ELSE round(d / (l + d), 4) END AS confidence FROM c"
)
def detect_language_script(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.language_by_script(F.col("text")).alias("p")).select("doc_id", "p.language", "p.confidence")


@query("""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS t FROM documents), c AS (SELECT doc_id, t, string_split(t, '') AS l, greatest(length(t), 1) AS n FROM d),
r AS (SELECT doc_id, n, len(regexp_extract_all(t, '[A-Za-z0-9\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}\\x{0400}-\\x{04ff}\\x{0600}-\\x{06ff}]')) AS valid,
  len(list_filter(range(1, len(l) - 3), lambda i: l[i] = l[i + 1] AND l[i] = l[i + 2] AND l[i] = l[i + 3] AND l[i] = l[i + 4] AND (i = 1 OR l[i - 1] <> l[i]))) AS runs FROM c)
SELECT doc_id, round(greatest(0.0, least(1.0, valid / n - 2.0 * runs / n)), 4)::DOUBLE AS quality FROM r""".replace("\\\\", "\\"))
def text_quality(spark, sf_dir):
    return _text_query(T.text_quality, "quality")(spark, sf_dir)


@query(
    "SELECT doc_id FROM (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM documents) WHERE length(t) >= 8 AND len(regexp_extract_all(t, '[A-Za-z0-9\\x{4e00}-\\x{9fff}]')) / length(t) >= 0.35"
)
def useful_text_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.is_useful(F.col("text"))).select("doc_id")


@query("SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g') AS clean FROM documents")
def control_char_clean(spark, sf_dir):
    return _text_query(T.without_controls, "clean")(spark, sf_dir)


_SENT = "regexp_replace(regexp_replace(text, '([。！？!?；;])\\s*', '\\1' || chr(1), 'g'), '([.])\\s+([A-Z0-9\"''])', '\\1' || chr(1) || '\\2', 'g')"


@query(f"SELECT doc_id, unnest(s) AS sentence, unnest(range(0, len(s)))::INT AS n FROM (SELECT doc_id, list_filter(list_transform(string_split({_SENT}, chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS s FROM documents)")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


@query("""
WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 380) / 300.0)::BIGINT) + 1)) AS i FROM documents),
t AS (SELECT doc_id, i, regexp_replace(substring(text, (i * 300 + 1)::BIGINT, 380), '^\\s+|\\s+$', '', 'g') AS part FROM w)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS n, part FROM t WHERE part <> ''
""")
def sliding_windows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.sliding_windows(F.col("text"), 380, 80)).alias("n", "part"))


@query()
def chunk_pack(spark, sf_dir):
    chunks = chunking.split_text(T.normalized(F.col("text")), chunking.PARENT_CHARS, chunking.CHILD_OVERLAP)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks).alias("n", "chunk"))


@query()
def parent_child_chunks(spark, sf_dir):
    units = structure.numbered_units(table(spark, sf_dir, "documents"), "source", "doc_id").select("document_id", "unit", "text")
    return chunking.chunk_ids(chunking.parent_child_chunks(units), "document_id", "unit").select("chunk_id", "parent_id", "content_hash", "child_text")


@query("SELECT doc_id, CASE WHEN length(text) <= 1720 THEN text ELSE left(text, 900) || chr(10) || chr(10) || '[...中间原文窗口省略...]' || chr(10) || chr(10) || right(text, 700) END AS excerpt FROM documents")
def bounded_excerpt(spark, sf_dir):
    return _text_query(lambda c: T.bounded_excerpt(c, 900, 700), "excerpt")(spark, sf_dir)


# structure

_UNITS = "u AS (SELECT source AS document_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS unit, doc_id AS unit_key, text, count(*) OVER (PARTITION BY source) AS n_units FROM documents WHERE trim(coalesce(text, '')) <> '')"
_REGION = "CASE WHEN {0} <= 0.16 THEN 'front' WHEN {0} >= 0.78 THEN 'terminal' ELSE 'middle' END"
_HEAD_SQL = r"""h0 AS (SELECT document_id, unit, n_units, coalesce(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^第\s*\d+\s*页(?:（OCR 识别）)?$'))[1], '') AS first FROM u),
h1 AS (SELECT *, regexp_replace(first, '\s+', '', 'g') AS tight FROM h0),
h2 AS (SELECT document_id, unit, n_units, left(first, 120) AS title FROM h1 WHERE regexp_matches(first, '(?i)^(第[一二三四五六七八九十百\d]+[章节条]|CHAPTER\s+\w+|PART\s+\w+|#{1,6}\s+|\d+(?:\.\d+)+)')
  OR (length(tight) BETWEEN 2 AND 52 AND NOT regexp_matches(tight, '[。！？!?；;，,：:]') AND regexp_matches(first, '^[A-Za-z0-9\x{4e00}-\x{9fff}·・•《》()（）\-—_ ]+$'))),
""" + f"h AS (SELECT *, {s_key('title')} AS key FROM h2)"
# consecutive equal headings are suppressed when fewer than three units apart: within a run of equal keys, greedily
_SECTIONS_SQL = f"""{_UNITS}, {_HEAD_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY unit) AS n FROM h),
k AS (SELECT document_id, n, unit, title, key, n_units, unit AS last, true AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.document_id, o.n, o.unit, o.title, o.key, o.n_units, CASE WHEN o.key = k.key AND o.unit - k.last < 3 THEN k.last ELSE o.unit END, NOT (o.key = k.key AND o.unit - k.last < 3)
  FROM k JOIN o ON o.document_id = k.document_id AND o.n = k.n + 1),
a AS (SELECT document_id, unit AS start_unit, title, n_units FROM k WHERE kept UNION ALL
  SELECT document_id, 0, '正文', any_value(n_units) FROM u WHERE document_id NOT IN (SELECT document_id FROM k WHERE kept AND unit = 0) GROUP BY document_id),
s AS (SELECT document_id, row_number() OVER w - 1 AS section, title, start_unit, coalesce(lead(start_unit) OVER w - 1, n_units - 1) AS end_unit, n_units, count(*) OVER (PARTITION BY document_id) AS c FROM a WINDOW w AS (PARTITION BY document_id ORDER BY start_unit))"""
_SEGMENTS_SQL = f"""{_SECTIONS_SQL},
sk AS (SELECT *, {s_key('title')} AS key2 FROM s),
sb AS (SELECT *, lag(start_unit) OVER (PARTITION BY document_id, key2 ORDER BY start_unit) AS before FROM sk),
g0 AS (SELECT * FROM sb WHERE start_unit = 0 OR (key2 <> '' AND start_unit - before >= 3)),
g AS (SELECT document_id, 'segment:' || (row_number() OVER w - 1) AS segment_id, start_unit, coalesce(lead(start_unit) OVER w - 1, n_units - 1) AS end_unit, n_units FROM g0 WINDOW w AS (PARTITION BY document_id ORDER BY start_unit))"""
_WINDOWS_SQL = f"""{_SEGMENTS_SQL},
z AS (SELECT *, CASE WHEN end_unit - start_unit + 1 >= 8 THEN 4 ELSE greatest(1, end_unit - start_unit + 1) END AS size FROM g),
z1 AS (SELECT *, list_distinct(range(start_unit, greatest(end_unit - size + 1, start_unit) + 1, greatest(1, size // 2)) || [greatest(end_unit - size + 1, start_unit)]) AS starts FROM z),
z2 AS (SELECT *, unnest(starts) AS window_start FROM z1),
z3 AS (SELECT *, least(end_unit, window_start + size - 1) AS window_end FROM z2),
z4 AS (SELECT *, (window_start + window_end) / 2 AS middle, ((window_start + window_end) / 2 - start_unit) / greatest(end_unit - start_unit, 1) AS inn FROM z3),
w AS (SELECT document_id, document_id || ':w:' || window_start || ':' || window_end AS chunk_id, CASE WHEN inn >= 0.78 THEN 'terminal_window' ELSE 'navigation_window' END AS kind, segment_id, window_start, window_end,
  round(middle / greatest(n_units - 1, 1), 6) AS position, round(inn, 6) AS segment_position, {_REGION.format('inn')} AS region FROM z4)"""


def _units(spark, sf_dir):
    return structure.numbered_units(table(spark, sf_dir, "documents"), "source", "doc_id")


def _windows(spark, sf_dir):
    return structure.navigation_windows(structure.segments(structure.sections(_units(spark, sf_dir))))


def _window_cards(spark, sf_dir):
    units = stored(_units(spark, sf_dir), "units")  # read for headings, sizes and texts
    windows = stored(structure.navigation_windows(structure.segments(structure.sections(units))), "windows")
    return structure.window_cards(windows, units)


@query(f"WITH {_UNITS}, p AS (SELECT *, round(unit / greatest(n_units - 1, 1), 6) AS position FROM u) SELECT document_id, unit, unit_key, n_units, position, {_REGION.format('position')} AS region FROM p")
def unit_positions(spark, sf_dir):
    return structure.with_position(_units(spark, sf_dir)).drop("text")


@query(f"WITH RECURSIVE {_SECTIONS_SQL} SELECT document_id, section, CASE WHEN c = 1 AND title = '正文' THEN 'section:root' ELSE 'section:' || section || ':' || CASE WHEN {s_key('title')} = '' THEN 'untitled' ELSE {s_key('title')} END END AS section_id, title, start_unit, end_unit FROM s")
def sections(spark, sf_dir):
    return structure.sections(_units(spark, sf_dir)).drop("n_units")


@query(f"WITH RECURSIVE {_SEGMENTS_SQL} SELECT document_id, segment_id, start_unit, end_unit FROM g")
def segments(spark, sf_dir):
    return structure.segments(structure.sections(_units(spark, sf_dir))).select("document_id", "segment_id", "start_unit", "end_unit")


@query(f"WITH RECURSIVE {_WINDOWS_SQL} SELECT document_id, chunk_id, kind, segment_id, window_start, window_end, position, segment_position, region FROM w")
def navigation_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


_WCARDS_SQL = f"""{_WINDOWS_SQL},
wt AS (SELECT w.document_id, w.chunk_id, array_to_string(list(trim(u.text) ORDER BY u.unit), chr(10) || chr(10)) AS t FROM w JOIN u ON u.document_id = w.document_id AND u.unit BETWEEN w.window_start AND w.window_end GROUP BY ALL),
wc AS (SELECT w.document_id, w.chunk_id, w.kind, w.segment_id, w.window_start, w.window_end, w.position, w.region,
  '文档导航原文窗口' || chr(10) || '结构片段：' || w.segment_id || chr(10) || '区域：' || w.region || chr(10) || '原文：' || chr(10) || CASE WHEN length(t) <= 6920 THEN t ELSE left(t, 4200) || chr(10) || chr(10) || '[...中间原文窗口省略...]' || chr(10) || chr(10) || right(t, 2600) END AS content
  FROM w JOIN wt ON w.document_id = wt.document_id AND w.chunk_id = wt.chunk_id)"""


@query(f"WITH RECURSIVE {_WCARDS_SQL} SELECT * FROM wc")
def window_cards(spark, sf_dir):
    return _window_cards(spark, sf_dir)


@query(f"""WITH RECURSIVE {_SECTIONS_SQL},
sc AS (SELECT s.document_id, section, title, start_unit, end_unit, s.n_units, c, array_to_string(list(trim(u.text) ORDER BY u.unit), chr(10) || chr(10)) AS t FROM s JOIN u ON u.document_id = s.document_id AND u.unit BETWEEN start_unit AND end_unit GROUP BY ALL)
SELECT document_id, document_id || ':' || CASE WHEN c = 1 AND title = '正文' THEN 'section:root' ELSE 'section:' || section || ':' || CASE WHEN {s_key('title')} = '' THEN 'untitled' ELSE {s_key('title')} END END AS chunk_id, 'section_card' AS kind, title,
  '文档区段：' || title || chr(10) || '来源位置：单元 ' || (start_unit + 1) || '-' || (end_unit + 1) || '/' || n_units || chr(10) || '页码：unknown' || chr(10) || '区段原文摘录：' || chr(10)
  || CASE WHEN length(t) <= 1720 THEN t ELSE left(t, 900) || chr(10) || chr(10) || '[...中间原文窗口省略...]' || chr(10) || chr(10) || right(t, 700) END AS content FROM sc""")
def section_cards(spark, sf_dir):
    units = _units(spark, sf_dir)
    return structure.section_cards(structure.sections(units), units)


@query()
def document_cards(spark, sf_dir):
    return structure.document_cards(structure.document_signals(_units(spark, sf_dir)))


_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}"
_MENTIONS_SQL = rf"""{_UNITS},
m0 AS (SELECT document_id, unit, list_transform(regexp_extract_all(text, '《([^》]{{2,40}})》', 1), lambda x: {{'name': x, 'type': '作品', 'confidence': 0.84::DOUBLE}}) ||
  list_transform(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]{{2,10}}[·・•][\x{{4e00}}-\x{{9fff}}]{{1,10}}|{_NAME}'), lambda x: {{'name': x, 'type': '人物', 'confidence': 0.66::DOUBLE}}) ||
  list_transform(list_filter(regexp_extract_all(text, '\b[A-Za-z_][A-Za-z0-9_]*\(\)|\b[A-Za-z_][A-Za-z0-9_]*\b'), lambda x: length(x) >= 3 AND regexp_matches(x, '(?i)(api|class|function|timeout|token|config|client|server)')), lambda x: {{'name': x, 'type': '代码模块', 'confidence': 0.6::DOUBLE}}) AS m FROM u),
m1 AS (SELECT document_id, unit, unnest(range(0, len(m)))::INT AS place, unnest(m) AS x FROM m0),
m AS (SELECT document_id, unit, place, x.name AS name, x.type AS type, x.confidence AS confidence FROM m1)"""


@query(f"WITH {_MENTIONS_SQL} SELECT * FROM m")
def entity_mentions(spark, sf_dir):
    return entities.entity_mentions(_units(spark, sf_dir))


_MERGED_SQL = f"""{_MENTIONS_SQL}, mk AS (SELECT *, {s_key('name')} AS key FROM m),
e0 AS (SELECT document_id, key, arg_min(name, unit * 100000 + place) AS name, arg_min(type, unit * 100000 + place) AS type, max(confidence) AS confidence, list_sort(list_distinct(list(unit))) AS units, count(*) AS mentions FROM mk WHERE length(key) >= 2 GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, len(units) DESC, key) AS rank FROM e0 QUALIFY rank <= 160)"""


def _merged(spark, sf_dir):
    return entities.merged_entities(entities.entity_mentions(_units(spark, sf_dir)), entities.MOST_ENTITIES)


@query(f"WITH {_MERGED_SQL} SELECT document_id, key, name, type, confidence, array_to_string(units, ',') AS units, mentions, rank::INT AS rank FROM e")
def entity_merge(spark, sf_dir):
    return _merged(spark, sf_dir).withColumn("units", F.array_join(F.transform("units", lambda x: x.cast("string")), ","))


@query(f"""WITH {_MERGED_SQL}, uk AS (SELECT document_id, unit, {s_key('text')} AS t FROM u),
x AS (SELECT uk.document_id, uk.unit, list_distinct(list(e.name ORDER BY e.rank, e.name)) AS l, list(e.name ORDER BY e.rank, e.name)[1:16] AS n FROM uk JOIN e ON e.document_id = uk.document_id AND length(e.key) >= 3 AND contains(uk.t, e.key) GROUP BY ALL)
SELECT document_id, unit, array_to_string(n, '|') AS mentions FROM x""")
def unit_mentions(spark, sf_dir):
    found = entities.unit_mentions(_units(spark, sf_dir), _merged(spark, sf_dir))
    return found.select("document_id", "unit", F.array_join("mentions", "|").alias("mentions"))


# aliases: a document's source, language and benchmark-like name stand for the aliases of its chunk
_ALIAS_SQL = f"""al0 AS (SELECT doc_id, unnest([{{'a': source, 's': 'alias', 'n': 0}}, {{'a': 'Lang ' || lang, 's': 'alias', 'n': 1}}, {{'a': source || '_' || lang || '()', 's': 'exact_term', 'n': 2}}]) AS x FROM documents),
al1 AS (SELECT doc_id::VARCHAR AS chunk_id, x.a AS alias, x.s AS source, x.n AS n, {s_key('x.a')} AS normalized_name FROM al0 WHERE x.a IS NOT NULL),
al AS (SELECT normalized_name, chunk_id, arg_max(alias, n) AS alias, 'document' AS entity_type, arg_max(source, n) AS source FROM al1 WHERE normalized_name <> '' GROUP BY ALL)"""


def _aliases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.lit("document").alias("entity_type"), F.array(F.col("source"), F.concat(F.lit("Lang "), F.col("lang"))).alias("aliases"),
        F.array(F.concat(F.col("source"), F.lit("_"), F.col("lang"), F.lit("()"))).alias("exact_terms"),
    )
    return entities.alias_rows(rows)


@query(f"WITH {_ALIAS_SQL} SELECT * FROM al")
def alias_index(spark, sf_dir):
    return _aliases(spark, sf_dir)


_TERMS = [(1, "SRC 3"), (1, "src5"), (2, "lang-FR"), (3, "nothing"), (4, "Src0_en()")]
_TERM_VALUES = ", ".join(f"({i}, '{t}')" for i, t in _TERMS)


@query(f"""WITH {_ALIAS_SQL}, q(query_id, term) AS (VALUES {_TERM_VALUES}), k AS (SELECT DISTINCT query_id, {s_key('term')} AS normalized_name FROM q)
SELECT query_id::INT AS query_id, (row_number() OVER (PARTITION BY query_id ORDER BY al.normalized_name, chunk_id))::INT AS rank, chunk_id, alias, al.normalized_name FROM k JOIN al USING (normalized_name) QUALIFY rank <= 24""")
def exact_search(spark, sf_dir):
    return entities.exact_search(_aliases(spark, sf_dir), spark.createDataFrame(_TERMS, "query_id int, term string"))


_MENTION_ROWS = [(1, "src1"), (2, "Lang"), (3, "the file src7_de() here"), (4, "zz"), (5, "x")]


@query(f"""WITH {_ALIAS_SQL}, q(mention_id, mention) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in _MENTION_ROWS)}),
g AS (SELECT normalized_name, min(alias) AS alias, max(entity_type) AS entity_type, max(source) AS source, count(DISTINCT chunk_id) AS support FROM al GROUP BY ALL),
k AS (SELECT mention_id, {s_key('mention')} AS key FROM q), x AS (SELECT k.*, EXISTS (SELECT 1 FROM g WHERE g.normalized_name = k.key) AS known FROM k WHERE length(key) >= 2)
SELECT mention_id::INT AS mention_id, key, normalized_name, alias, entity_type, source, support, known AS exact FROM x JOIN g ON CASE WHEN known THEN g.normalized_name = key ELSE contains(g.normalized_name, key) OR contains(key, g.normalized_name) END""")
def entity_link_candidates(spark, sf_dir):
    return entities.link_candidates(spark.createDataFrame(_MENTION_ROWS, "mention_id int, mention string"), _aliases(spark, sf_dir))


@query()
def entity_link(spark, sf_dir):
    return entities.link_entities(spark.createDataFrame(_MENTION_ROWS, "mention_id int, mention string"), _aliases(spark, sf_dir))


# search

_BM25_SQL = f"""dt AS (SELECT doc_id AS chunk_id, {s_tokens('text')} AS t FROM documents),
dl AS (SELECT chunk_id, len(t) AS length, t FROM dt WHERE len(t) > 0), st AS (SELECT count(*)::DOUBLE AS n, greatest(avg(length), 1.0) AS mean FROM dl),
po AS (SELECT chunk_id, length, unnest(t) AS term FROM dl), qt AS (SELECT item_id AS query_id, unnest({s_tokens('text')}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM po WHERE term IN (SELECT term FROM qt) GROUP BY term),
sc AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM po JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 10)"""


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, sf_dir, k=10):
    return search.bm25_top_k(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), "doc_id", k)


@query(f"WITH {_BM25_SQL} SELECT query_id, chunk_id, score, rank::INT AS rank FROM bm")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir)


@query(f"""WITH q AS (SELECT item_id AS query_id, unnest({s_tokens('text')}) AS term FROM benchmark), d AS (SELECT doc_id AS chunk_id, array_to_string({s_tokens('text')}, ' ') || ' ' || {s_lex('text')} AS t FROM documents),
c AS (SELECT query_id, chunk_id, count(*)::INT AS score FROM q JOIN d ON contains(d.t, q.term) GROUP BY ALL)
SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM c QUALIFY rank <= 10""")
def like_search(spark, sf_dir):
    return search.containment_top_k(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), "doc_id", 10)


_CARD_SQL = """cd AS (SELECT 'd' || doc_id AS chunk_id, CASE doc_id % 4 WHEN 0 THEN 'document_card' WHEN 1 THEN 'entity_card' WHEN 2 THEN 'section_card' ELSE 'child' END AS kind, source AS title, lang AS section_path, text AS content FROM documents)"""


def _cards(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["document_card", "entity_card", "section_card", "child"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), kind.alias("kind"), F.col("source").alias("title"), F.col("lang").alias("section_path"), F.col("text").alias("content"))


@query(f"""WITH {_CARD_SQL}, f AS (SELECT *, CASE kind WHEN 'entity_card' THEN 0 WHEN 'document_card' THEN 1 WHEN 'section_card' THEN 2 ELSE 9 END AS o FROM cd WHERE kind IN ('document_card', 'entity_card', 'section_card', 'metadata') ORDER BY o, chunk_id LIMIT 72),
t AS (SELECT chunk_id, o, {s_lex("title || ' ' || coalesce(section_path, '') || ' ' || content")} AS t FROM f), q AS (SELECT item_id AS query_id, unnest({s_tokens('text')}) AS term FROM benchmark),
c AS (SELECT query_id, chunk_id, o, count(*)::INT AS score FROM q JOIN t ON contains(t.t, q.term) GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, chunk_id))::INT AS rank, chunk_id, score FROM c QUALIFY rank <= 24""")
def structured_search(spark, sf_dir):
    return search.structured_search(_cards(spark, sf_dir), _questions(spark, sf_dir), first=72)


# every question is anchored to the file that its number points to
_ANCHOR_SQL = "qa AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS document_id, text FROM benchmark)"


def _anchored(spark, sf_dir):
    return _questions(spark, sf_dir).withColumn("document_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))


_NAV_SQL = f"""{_WCARDS_SQL}, {_ANCHOR_SQL}, qn AS (SELECT query_id, document_id, {s_tokens('text')} AS q FROM qa),
nl AS (SELECT document_id, chunk_id, kind, position, {s_lex('content')} AS t FROM wc WHERE region IN ('middle', 'terminal')),
ns AS (SELECT query_id, chunk_id, position, round(CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda x: contains(t, x))) / len(q) ELSE 0 END * 0.9 + position * 0.55 + CASE WHEN kind = 'terminal_window' THEN 0.1 ELSE 0 END, 9) AS score FROM nl JOIN qn USING (document_id))"""


def _navigation(spark, sf_dir):
    return search.navigation_scores(_window_cards(spark, sf_dir), _anchored(spark, sf_dir), "terminal", ["middle", "terminal"])


@query(f"WITH RECURSIVE {_NAV_SQL} SELECT query_id, chunk_id, position, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position DESC, chunk_id))::INT AS rank FROM ns QUALIFY rank <= 24")
def navigation_search(spark, sf_dir):
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("position"), "chunk_id")
    return _navigation(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where("rank <= 24")


@query(f"""WITH RECURSIVE {_NAV_SQL}, b AS (SELECT *, least(2, floor(least(1, greatest(0, position)) * 3))::INT AS bin, count(*) OVER (PARTITION BY query_id) <= 8 AS few FROM ns),
hd AS (SELECT *, row_number() OVER (PARTITION BY query_id, bin ORDER BY score DESC, position DESC, chunk_id) = 1 AS head FROM b), ti AS (SELECT *, CASE WHEN few OR NOT head THEN 1 ELSE 0 END AS tier FROM hd)
SELECT query_id, chunk_id, position, score, bin, (row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 0 THEN bin END, score DESC, position DESC, chunk_id))::INT AS rank FROM ti QUALIFY rank <= 8""")
def position_bins(spark, sf_dir):
    return search.position_diverse(_navigation(spark, sf_dir), 8)


_ENT_ROWS = [(1, "src1", "MIT License"), (1, "src1", "the"), (2, "src2", "and the"), (3, "src3", "nowhere to be found")]
_ENT_VALUES = ", ".join(f"({q}, '{d}', '{t}')" for q, d, t in _ENT_ROWS)
_ENT_SQL = f"et0(query_id, document_id, term) AS (VALUES {_ENT_VALUES}), et AS (SELECT query_id::INT AS query_id, document_id, {s_key('term')} AS key FROM et0)"


@query(f"""WITH RECURSIVE {_WCARDS_SQL}, {_ENT_SQL}, t AS (SELECT document_id, chunk_id, position, {s_key('content')} AS t FROM wc),
c AS (SELECT query_id, chunk_id, position, string_agg(key, ',' ORDER BY key) AS matched FROM t JOIN et USING (document_id) WHERE contains(t, key) GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY position, chunk_id))::INT AS rank, chunk_id, position, matched FROM c QUALIFY rank <= 72""")
def entity_window_search(spark, sf_dir):
    return search.entity_windows(_window_cards(spark, sf_dir), spark.createDataFrame(_ENT_ROWS, "query_id int, document_id string, term string"))


@query(f"""WITH RECURSIVE {_WINDOWS_SQL}, {_ENT_SQL}, t AS (SELECT document_id, unit, round(unit / greatest(n_units - 1, 1), 6) AS position, {s_key('text')} AS t FROM u),
f0 AS (SELECT DISTINCT query_id, t.document_id, unit, position FROM t JOIN et USING (document_id) WHERE contains(t, key)),
f AS (SELECT * FROM f0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position DESC, unit DESC, document_id) <= 5),
c AS (SELECT query_id, chunk_id, max(round(2.2 + f.position * 0.4 + CASE WHEN kind = 'terminal_window' THEN 0.35 ELSE 0 END, 6)) AS score FROM f JOIN w ON w.document_id = f.document_id AND f.unit BETWEEN w.window_start AND w.window_end GROUP BY ALL)
SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM c QUALIFY rank <= 16""")
def terminal_neighborhood(spark, sf_dir):
    units = _units(spark, sf_dir)
    windows = structure.navigation_windows(structure.segments(structure.sections(units)))
    return search.terminal_neighbourhood(structure.with_position(units), windows, spark.createDataFrame(_ENT_ROWS, "query_id int, document_id string, term string"))


def _dense_sql(label: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS w, label AS l FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT query_id, vec_id AS chunk_id, round(greatest(0.0, list_cosine_similarity(w, embedding::DOUBLE[])), 5) AS score FROM embeddings JOIN q ON {label})
SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM c QUALIFY rank <= 10"""


@query(_dense_sql("true"))
def dense_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search.dense_top_k(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query(_dense_sql("label = l"))
def dense_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = search.dense_top_k(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label"))
    return found


@query()
def hash_embedding(spark, sf_dir):
    small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(hashed_embedding(F.col("text"), 128), lambda x: F.round(x, 6)).alias("embedding"))


# fusion: three channels of hits made from BM25 ranks and identifiers

_HITS_SQL = f"""{_BM25_SQL},
hits AS (SELECT query_id, 'lexical' AS channel, rank, chunk_id::VARCHAR AS chunk_id FROM bm UNION ALL
  SELECT query_id, 'exact_entity', 11 - rank, chunk_id::VARCHAR FROM bm WHERE (chunk_id + query_id) % 3 <> 0 UNION ALL
  SELECT query_id, 'dense_llm_structured_1', (rank * 7) % 11, chunk_id::VARCHAR FROM bm WHERE chunk_id % 2 = 0)"""


def _hits(spark, sf_dir):
    bm = _bm25(spark, sf_dir).select("query_id", "rank", "chunk_id")
    name = lambda rows, channel, rank: rows.select("query_id", F.lit(channel).alias("channel"), rank.alias("rank"), F.col("chunk_id").cast("string").alias("chunk_id"))
    return (
        name(bm, "lexical", F.col("rank")).unionByName(name(bm.where("(chunk_id + query_id) % 3 <> 0"), "exact_entity", 11 - F.col("rank")))
        .unionByName(name(bm.where("chunk_id % 2 = 0"), "dense_llm_structured_1", (F.col("rank") * 7) % 11))
    )


_RRF_SQL = f"""{_HITS_SQL}, fu AS (SELECT query_id, chunk_id, round(sum(CASE channel WHEN 'lexical' THEN 1.1 WHEN 'exact_entity' THEN 1.4 ELSE 0.8 END / (60 + rank)), 6) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM hits GROUP BY ALL),
fr AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM fu)"""


@query(f"WITH {_RRF_SQL} SELECT query_id, chunk_id, score, channels, rank FROM fr WHERE rank <= 96")
def weighted_rrf(spark, sf_dir):
    return fusion.weighted_rrf(_hits(spark, sf_dir), fusion.weight_profile("fact_lookup"))


@query(f"""WITH {_HITS_SQL}, a AS (SELECT hits.*, d.source AS document_id, CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE 'segment:' || (d.doc_id % 3) END AS segment_id, CASE WHEN d.doc_id % 2 = 0 THEN 'child' ELSE 'section_card' END AS kind FROM hits JOIN documents d ON d.doc_id::VARCHAR = chunk_id),
s AS (SELECT query_id, document_id, segment_id, round(sum(CASE kind WHEN 'child' THEN 1.0 ELSE 0.78 END / (rank + 3)) + 0.08 * count(DISTINCT channel), 6) AS score, count(DISTINCT channel) AS channels FROM a WHERE rank <= 24 GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (segment_id = '')::INT, score DESC, channels DESC, document_id, segment_id) = 1""")
def anchor_vote(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("segment:"), (F.col("doc_id") % 3).cast("string"))).alias("segment_id"),
        F.when(F.col("doc_id") % 2 == 0, "child").otherwise("section_card").alias("kind"),
    )
    return fusion.anchors(docs.join(search.small(_hits(spark, sf_dir)), "chunk_id"))


@query(f"""WITH {_RRF_SQL}, x AS (SELECT query_id, rank, chunk_id, chunk_id::BIGINT % 5 = 0 AS anchored, chunk_id::BIGINT % 3 = 0 AS focused FROM fr),
t AS (SELECT *, CASE WHEN anchored THEN 0 WHEN focused THEN 1 ELSE 2 END AS tier FROM x), y AS (SELECT *, min(tier) OVER (PARTITION BY query_id) < 2 AS a, row_number() OVER (PARTITION BY query_id, tier ORDER BY rank) AS n FROM t)
SELECT query_id, rank, chunk_id, anchored, focused, tier, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN a THEN tier ELSE 0 END, rank))::INT AS new_rank FROM y WHERE NOT a OR tier < 2 OR n <= 3""")
def focus_guard(spark, sf_dir):
    ranked = fusion.weighted_rrf(_hits(spark, sf_dir), fusion.weight_profile("fact_lookup")).select("query_id", "rank", "chunk_id")
    n = F.col("chunk_id").cast("bigint")
    return fusion.focus_guard(ranked.withColumns({"anchored": n % 5 == 0, "focused": n % 3 == 0}))


_PLACED_SQL = f"{_RRF_SQL}, pl AS (SELECT query_id, rank, chunk_id, d.source AS file_name, d.text FROM fr JOIN documents d ON d.doc_id::VARCHAR = chunk_id)"


def _placed(spark, sf_dir):
    ranked = fusion.weighted_rrf(_hits(spark, sf_dir), fusion.weight_profile("fact_lookup")).select("query_id", "rank", "chunk_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("file_name"), "text")
    return docs.join(search.small(ranked), "chunk_id")


@query(f"""WITH {_PLACED_SQL}, x AS (SELECT query_id, rank, chunk_id, file_name, (row_number() OVER (PARTITION BY query_id, file_name ORDER BY rank) > 1)::INT AS repeat FROM pl)
SELECT query_id, rank, chunk_id, file_name, repeat, (row_number() OVER (PARTITION BY query_id ORDER BY repeat, rank))::INT AS new_rank FROM x QUALIFY new_rank <= 6""")
def diversify_location(spark, sf_dir):
    return fusion.diversified(_placed(spark, sf_dir).drop("text"), 6, ["file_name"])


@query()
def diversify_greedy(spark, sf_dir):
    found = fusion.greedy_distinct(_placed(spark, sf_dir), 6, location="file_name")
    return found.select("query_id", F.array_join("picks", ",").alias("picks"))


@query(f"""WITH t AS (SELECT doc_id AS id, source AS g, {s_tokens('left(text, 500)')} AS t FROM documents)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) AS overlap FROM t a JOIN t b ON a.g = b.g AND a.id < b.id WHERE len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) >= 0.82""")
def near_duplicates(spark, sf_dir):
    return fusion.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "source")


@query(f"""WITH {_RRF_SQL}, m AS (SELECT query_id, rank, chunk_id, chunk_id::BIGINT % 4 = 1 AS nav FROM fr), p AS (SELECT *, nav AND row_number() OVER (PARTITION BY query_id, nav ORDER BY rank) <= 3 AS pinned FROM m)
SELECT query_id, rank, chunk_id, pinned, (row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, rank))::INT AS new_rank FROM p WHERE pinned OR NOT nav QUALIFY new_rank <= 6""")
def read_plan_pin(spark, sf_dir):
    ranked = fusion.weighted_rrf(_hits(spark, sf_dir), fusion.weight_profile("fact_lookup")).select("query_id", "rank", "chunk_id")
    return fusion.reserved_places(ranked, ranked.where(F.col("chunk_id").cast("bigint") % 4 == 1), 6)


@query(f"""WITH {_PLACED_SQL}, x AS (SELECT query_id, rank, left(text, 1000) AS block, length(left(text, 1000)) AS n FROM pl), y AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY rank) - n AS before FROM x)
SELECT query_id, rank, CASE WHEN n <= 4000 - before THEN block ELSE rtrim(left(block, (4000 - before)::BIGINT)) || '…' END AS used, before::BIGINT AS before FROM y WHERE before < 4000 AND (n <= 4000 - before OR 4000 - before >= 160)""")
def context_budget(spark, sf_dir):
    rows = _placed(spark, sf_dir).select("query_id", "rank", F.left("text", F.lit(1000)).alias("block"))
    return fusion.context_budget(rows, 4000)


@query("""SELECT c.conv_id, c.turn, CASE WHEN coalesce(p.text, '') <> '' THEN p.text ELSE c.text END AS source_text FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def parent_lookup(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    key = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    children = turns.select("conv_id", "turn", "text", key(1).alias("parent_id"))
    parents = turns.select(key(0).alias("parent_id"), F.col("text").alias("parent_text"))
    return fusion.with_parent_text(children, parents).select("conv_id", "turn", "source_text")


@query(f"WITH {_HITS_SQL}, e AS (SELECT query_id, chunk_id FROM hits WHERE channel = 'exact_entity' AND rank <= 8), o AS (SELECT query_id, chunk_id FROM hits WHERE channel IN ('lexical', 'structured') AND rank <= 12) SELECT query_id, count(*) AS agreeing FROM (SELECT * FROM e INTERSECT SELECT * FROM o) GROUP BY query_id")
def channel_agreement(spark, sf_dir):
    return fusion.channel_agreement(_hits(spark, sf_dir))


@query("""SELECT vec_id, round(greatest(0, least(1, (0.42 * v + 0.34 * k + 0.18 * e + 0.06 * least((CASE WHEN a > 0 THEN 1.0 / (60 + a) ELSE 0 END + CASE WHEN b > 0 THEN 1.0 / (60 + b) ELSE 0 END) * 30, 1)) * CASE WHEN label % 2 = 0 THEN 1.12 ELSE 0.28 END)), 6) AS score
FROM (SELECT vec_id, label, abs(embedding[1]::DOUBLE) AS v, abs(embedding[2]::DOUBLE) AS k, abs(embedding[3]::DOUBLE) AS e, vec_id % 7 AS a, vec_id % 11 AS b FROM embeddings)""")
def hybrid_score(spark, sf_dir):
    part = lambda i: F.abs(F.element_at("embedding", i).cast("double"))
    score = fusion.hybrid_score(part(1), part(2), part(3), F.col("vec_id") % 7, F.col("vec_id") % 11, F.when(F.col("label") % 2 == 0, 1.12).otherwise(0.28))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(score, 6).alias("score"))


# maintenance


@query("SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS name, count(*) AS copies FROM documents GROUP BY 1")
def rebuild_dedupe(spark, sf_dir):
    return maintenance.first_of_each_content(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT source AS file_name, count(*) AS chunks, max(doc_id) AS upload_time, count(DISTINCT doc_id % 7) AS pages, count(DISTINCT n_chars) AS rows, arg_min(lang, doc_id) AS source_type FROM documents GROUP BY source")
def file_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("file_name"), F.col("doc_id").alias("upload_time"), (F.col("doc_id") % 7).alias("page"), F.col("n_chars").alias("row_index"), F.col("lang").alias("source_type"), F.col("doc_id").alias("unit"))
    return maintenance.file_listing(rows)


@query(f"WITH RECURSIVE {_WINDOWS_SQL} SELECT document_id, kind, region, count(*) AS windows, min(position) AS min_position, max(position) AS max_position, min(window_start) AS first_unit, max(window_end) AS last_unit FROM w GROUP BY ALL")
def navigation_inventory(spark, sf_dir):
    return maintenance.navigation_inventory(_windows(spark, sf_dir))


@query("SELECT doc_id, source AS file_name FROM documents WHERE source NOT IN ('src1', 'src2')")
def delete_file(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_name"))
    return maintenance.without_files(rows, spark.createDataFrame([("src1",), ("src2",)], "file_name string")).select("doc_id", "file_name")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE source END AS source, CASE WHEN doc_id % 10 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents")
def upsert_chunks(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    new = old.where("doc_id % 10 = 0").select("doc_id", F.lit("new").alias("source"), F.explode(F.array(F.col("n_chars"), F.col("n_chars") + 1)).alias("n_chars"))
    return maintenance.upserted(old, new, ["doc_id"], "n_chars")


def _csv_sql(name: str, numbers: list[str], strings: list[str], order: str) -> str:
    columns = sorted([*numbers, *strings], key=order.split(",").index)
    as_json = " || ', ' || ".join(f"'\"{c}\": ' || " + (f"{c}::VARCHAR" if c in numbers else f"to_json({c})") for c in columns)
    pairs = " || ' | ' || ".join(f"'{c}: ' || {c}::VARCHAR" for c in columns)
    return f"SELECT '{name}.csv' AS file_name, row_number() OVER (ORDER BY {columns[0]}) AS unit, 'CSV 文件：{name}.csv' || chr(10) || '列名：{' | '.join(columns)}' || chr(10) || '第 ' || row_number() OVER (ORDER BY {columns[0]}) || ' 行：' || '{{' || {as_json} || '}}' || chr(10) || 'Markdown 视图：' || {pairs} AS text FROM {name}"


@query(_csv_sql("region", ["r_regionkey"], ["r_name"], "r_regionkey,r_name") + " UNION ALL " + _csv_sql("nation", ["n_nationkey", "n_regionkey"], ["n_name"], "n_nationkey,n_name,n_regionkey"))
def csv_rows(spark, sf_dir):
    def rows(name: str, key: str) -> DataFrame:
        t = table(spark, sf_dir, name)
        unit = F.row_number().over(Window.orderBy(key)).cast("bigint")
        return t.withColumn("unit", unit).select(F.lit(f"{name}.csv").alias("file_name"), "unit", csv_text(F.lit(f"{name}.csv"), F.col("unit"), t.schema).alias("text"))

    return rows("region", "r_regionkey").unionByName(rows("nation", "n_nationkey"))


@query("SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC))::INT AS back FROM conversations WHERE role = 'user' QUALIFY back <= 2")
def conversation_tail(spark, sf_dir):
    return maintenance.last_turns(table(spark, sf_dir, "conversations"), "user", 2).drop("role")


@query("""WITH f AS (SELECT conv_id, arg_min(t, turn) AS t FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user') WHERE t <> '' GROUP BY conv_id)
SELECT conv_id, coalesce(CASE WHEN length(t) > 18 THEN left(t, 18) || '...' ELSE t END, '新对话') AS title FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN f USING (conv_id)""")
def conversation_titles(spark, sf_dir):
    return maintenance.conversation_titles(table(spark, sf_dir, "conversations"))


@query("""SELECT c.conv_id, c.turn, c.role, c.text, (row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC))::INT AS back FROM conversations c JOIN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id DESC LIMIT 80) n USING (conv_id) QUALIFY back <= 120""")
def conversation_store(spark, sf_dir):
    return maintenance.trimmed_store(table(spark, sf_dir, "conversations"))


_META = [(1, {"file": "a.txt", "page": "3", "score": "NaN", "tags": '["x","y"]', "none": None}), (2, {"ratio": "0.5", "bad": "inf", "ok": "true"})]


@query("WITH m(id, key, value) AS (VALUES (1, 'file', 'a.txt'), (1, 'page', '3'), (1, 'tags', '[\"x\",\"y\"]'), (2, 'ratio', '0.5'), (2, 'ok', 'true')) SELECT id::INT AS id, key, value FROM m")
def metadata_flatten(spark, sf_dir):
    return maintenance.flattened_metadata(spark.createDataFrame(_META, "id int, meta map<string,string>"), "meta")


# measures

_RELEVANT_SQL = "re AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, 1.0::DOUBLE AS gain FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _relevant(spark, sf_dir):
    """Documents that hold a question's passage; candidates share the passage's rarest token, so no pair is formed without one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = _questions(spark, sf_dir)
    # a passage's first and last words may be parts of words in the document, so only inner words of it count
    inner = asked.select("query_id", F.explode(T.search_tokens(F.regexp_replace("text", r"^\S*\s|\s\S*$", " "))).alias("term"))
    index = stored(search.postings(docs, "chunk_id", terms=inner).where("term <> ''").select("chunk_id", "term"), "passages")
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    rarest = inner.join(df, "term").groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("r")).select("query_id", F.col("r.term").alias("term"))
    pairs = index.join(search.small(rarest), "term").select("query_id", "chunk_id").distinct()
    texts = docs.join(search.small(pairs), "chunk_id").join(search.small(asked.withColumnRenamed("text", "passage")), "query_id")
    return texts.where("contains(text, passage)").select("query_id", "chunk_id", F.lit(1.0).alias("gain"))


@query("WITH " + _RELEVANT_SQL + " SELECT query_id, chunk_id, gain FROM re")
def relevant_documents(spark, sf_dir):
    return _relevant(spark, sf_dir)


@query(f"""WITH {_BM25_SQL}, {_RELEVANT_SQL}, tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, chunk_id) AS r FROM re),
t AS (SELECT query_id, count(*) AS n, sum(CASE WHEN r <= 10 THEN (pow(2, gain) - 1) / log2(r + 1) ELSE 0 END) AS ideal FROM tr GROUP BY query_id),
f AS (SELECT bm.query_id, count(DISTINCT bm.chunk_id) AS hit, min(rank) AS first, sum((pow(2, gain) - 1) / log2(rank + 1)) AS dcg FROM bm JOIN re ON re.query_id = bm.query_id AND re.chunk_id = bm.chunk_id GROUP BY bm.query_id)
SELECT t.query_id, round(coalesce(hit / n, 0), 6)::DOUBLE AS recall, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr, round(CASE WHEN ideal > 0 THEN coalesce(dcg / ideal, 0) ELSE 0 END, 6)::DOUBLE AS ndcg FROM t LEFT JOIN f USING (query_id)""")
def recall_mrr_ndcg(spark, sf_dir):
    return metrics.retrieval_metrics(_bm25(spark, sf_dir), _relevant(spark, sf_dir))


@query("""WITH r AS (SELECT DISTINCT item_id AS query_id, unnest(['the', 'src' || item_id % 3, split_part(text, ' ', 2)]) AS entity FROM benchmark), h AS (SELECT query_id, entity, max(contains(lower(b.text), lower(entity))::INT) AS held FROM r JOIN benchmark b ON b.item_id = query_id WHERE entity <> '' GROUP BY ALL)
SELECT query_id, round(avg(held), 6) AS coverage FROM h GROUP BY query_id""")
def entity_coverage(spark, sf_dir):
    asked = _questions(spark, sf_dir)
    names = F.array(F.lit("the"), F.concat(F.lit("src"), (F.col("query_id") % 3).cast("string")), F.split_part("text", F.lit(" "), F.lit(2)))
    return metrics.entity_coverage(asked.select("query_id", F.explode(names).alias("entity")), asked)


@query(f"""WITH {_PLACED_SQL}, x AS (SELECT pl.query_id, pl.rank, fr.channels, fr.score, pl.file_name, CASE WHEN fr.rank % 2 = 0 THEN 0.9 END AS quality, CASE WHEN pl.query_id % 3 = 0 THEN fr.rank - 4.0 END AS rerank, pl.query_id % 5 = 0 AND fr.rank = 2 AS failed FROM pl JOIN fr ON fr.query_id = pl.query_id AND fr.chunk_id = pl.chunk_id),
g AS (SELECT query_id, count(*) AS n, arg_min(channels, rank) AS channels, arg_min(score, rank) AS score, max(CASE WHEN rank = 1 THEN rerank END) AS rerank, avg(CASE WHEN rank <= 4 THEN coalesce(quality, 0.75) END) AS quality, count(DISTINCT CASE WHEN rank <= 4 THEN file_name END) AS files, bool_or(rank <= 3 AND failed) AS failed FROM x GROUP BY query_id),
c AS (SELECT *, 0.18 + CASE WHEN contains(channels, 'exact') THEN 0.18 ELSE 0 END + CASE WHEN contains(channels, ',structured') THEN 0.12 ELSE 0 END + coalesce(greatest(0, least(0.22, (rerank + 5) / 10 * 0.22)), 0) + least(n, 4) * 0.05 + least(score * 18, 0.22) + quality * 0.18 AS total FROM g),
k AS (SELECT *, CASE WHEN files > 1 AND NOT contains(channels, 'exact') THEN least(total, 0.48) ELSE total END AS capped FROM c)
SELECT query_id, round(greatest(0.08, least(0.96, CASE WHEN failed THEN capped * 0.78 ELSE capped END)), 6)::DOUBLE AS confidence FROM k""")
def confidence(spark, sf_dir):
    fused = fusion.weighted_rrf(_hits(spark, sf_dir), fusion.weight_profile("fact_lookup"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("file_name"))
    rows = files.join(search.small(fused), "chunk_id").select(
        "query_id", "rank", F.split("channels", ",").alias("channels"), "score", F.when(F.col("query_id") % 3 == 0, F.col("rank") - 4.0).alias("rerank"), F.when(F.col("rank") % 2 == 0, 0.9).alias("quality"), "file_name",
        ((F.col("query_id") % 5 == 0) & (F.col("rank") == 2)).alias("coverage_failed"),
    )
    return metrics.calibrated_confidence(rows)


_JUDGED = [
    (1, 1, "a", "Tom met Becky in the cave near the river.", [{"statement": "Tom met  Becky", "excerpt": "Tom met Becky in the cave", "qualifies": True, "roles": {"target_entity": "Tom", "object": "Becky"}}]),
    (1, 2, "b", "Becky and Tom were seen again by Huck.", [{"statement": "tom met becky", "excerpt": "Tom were seen again", "qualifies": True, "roles": {"target_entity": "tom", "object": "BECKY"}}, {"statement": "Huck saw Tom", "excerpt": "seen again by Huck", "qualifies": True, "roles": {"target_entity": "Tom", "object": "Huck"}}]),
    (1, 3, "c", "Nothing of note.", [{"statement": "Tom fought Joe", "excerpt": "a fight broke out between them", "qualifies": True, "roles": {"target_entity": "Tom", "object": "Joe"}}]),
    (2, 1, "d", "The river rose in spring.", [{"statement": "no", "excerpt": "The river rose in spring", "qualifies": False, "roles": {}}]),
]


def _judgements(spark):
    return spark.createDataFrame([(q, r, c, t, json.dumps(j)) for q, r, c, t, j in _JUDGED], "query_id int, rank int, chunk_id string, text string, judgement string")


@query("WITH c(query_id, rank, chunk_id, claim_key, statement) AS (VALUES (1, 1, 'a', 'relation:tom:becky', 'Tom met  Becky'), (1, 2, 'b', 'relation:tom:becky', 'tom met becky'), (1, 2, 'b', 'relation:tom:huck', 'Huck saw Tom')) SELECT * FROM c")
def claim_roles(spark, sf_dir):
    return evidence.qualified_claims(_judgements(spark), relation=True)


@query("WITH c(query_id, rank, chunk_id) AS (VALUES (1, 1, 'a'), (1, 2, 'b')) SELECT * FROM c")
def distinct_evidence(spark, sf_dir):
    return evidence.distinct_evidence(evidence.qualified_claims(_judgements(spark), relation=True), 6)


@query("""SELECT lang || '; ' || source AS reason, 0 AS n FROM documents WHERE false UNION ALL
SELECT reason, count(*) AS n FROM (SELECT unnest([lang, source]) AS reason FROM documents) GROUP BY reason ORDER BY n DESC, reason LIMIT 8""")
def rejection_histogram(spark, sf_dir):
    return metrics.rejection_histogram(table(spark, sf_dir, "documents").select(F.concat_ws("; ", "lang", "source").alias("reason")))


@query("""WITH v AS (SELECT source AS group_id, lang AS language, sum(greatest((doc_id % 10) / 10.0, 0.1)) AS v, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT group_id, arg_max(language, (v, language)) AS language, max(v) AS v, sum(n) AS n FROM v GROUP BY group_id)
SELECT group_id, language, round(least(1.0, v / n), 6)::DOUBLE AS confidence FROM b""")
def language_vote(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("group_id"), F.col("lang").alias("language"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"))
    return metrics.language_vote(rows)


@query(f"""WITH {_PLACED_SQL}, q AS (SELECT item_id AS query_id, {s_tokens('text')} AS q FROM benchmark),
p0 AS (SELECT query_id, rank, file_name, text, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS p, generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n'), 1) AS i FROM pl WHERE rank <= 6),
p1 AS (SELECT query_id, rank, file_name, text, regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS p, i FROM p0),
p2 AS (SELECT p1.*, 0.6 * len(list_filter(q, lambda x: contains({s_lex('p')}, x))) + CASE WHEN length(p) >= 40 THEN 0.15 ELSE 0 END AS v FROM p1 JOIN q USING (query_id) WHERE p <> ''),
p3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY v DESC, i) AS n FROM p2),
p4 AS (SELECT query_id, rank, any_value(file_name) AS file_name, any_value(text) AS text, array_to_string(list(p ORDER BY i) FILTER (n <= 2), chr(10) || chr(10)) AS best FROM p3 GROUP BY query_id, rank),
p5 AS (SELECT query_id, rank, file_name, CASE WHEN length(text) <= 1000 THEN text ELSE best END AS c FROM p4)
SELECT query_id, rank, '[S' || rank || '] 来源: ' || file_name || ' | 定位未知' || chr(10) || CASE WHEN length(c) <= 1000 THEN c ELSE left(c, 750) || chr(10) || '…' || chr(10) || right(c, 250) END AS block FROM p5""".replace("\\\\", "\\"))
def evidence_excerpts(spark, sf_dir):
    rows = _placed(spark, sf_dir).where("rank <= 6").join(search.small(_questions(spark, sf_dir).withColumnRenamed("text", "question")), "query_id")
    tokens = T.search_tokens(F.col("question"))
    excerpt = evidence.excerpt_of(F.col("text"), F.array().cast("array<string>"), tokens, F.lit(""), 1000)
    rows = rows.withColumn("excerpt", excerpt)
    return rows.select("query_id", "rank", evidence.cited_block(F.col("rank"), F.col("file_name"), F.lit(None), F.lit(None), F.lit(None), F.col("excerpt")).alias("block"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every question the ten documents of highest BM25, and whether one holds the passage."""
    ranked = _bm25(spark, sf_dir)
    held = _relevant(spark, sf_dir).select("query_id", "chunk_id", F.lit(True).alias("holds_passage"))
    return ranked.join(held, ["query_id", "chunk_id"], "left").withColumn("holds_passage", F.coalesce("holds_passage", F.lit(False)))


# evidence by tests

_SQL_TESTS = {n: requirements.PATTERNS[n] for n in ("relation_statement", "unit_or_context", "author_or_publisher", "definition_or_callsite", "table_header_context")}


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(source || ' child ' || text, '(?i){p}') AS {n}" for n, p in _SQL_TESTS.items()) + ", length(trim(text)) >= 60 AS clause_text, contains(text, '|') OR contains(text, chr(9)) AS table_cell_or_row, length(trim(text)) >= 40 AS answer_statement FROM documents")
def evidence_tests(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", "source", F.lit("child"), "text").alias("s"))
    found = requirements.tests(F.col("s"), F.col("text"), F.lit("child"), F.array().cast("array<string>"))
    return rows.select("doc_id", *[found[n].alias(n) for n in [*_SQL_TESTS, "clause_text", "table_cell_or_row", "answer_statement"]])


@query()
def evidence_requirements(spark, sf_dir):
    rows = _placed(spark, sf_dir).withColumns({"title": F.col("file_name"), "section_path": F.lit(None).cast("string"), "kind": F.lit("child"), "score": 1.0 / (60 + F.col("rank")), "focus": F.array().cast("array<string>")})
    return requirements.by_requirements(rows, ["numeric_value", "unit_or_context", "answer_statement"]).select("query_id", "rank", "chunk_id", "coverage", "prior", "new_rank")


@query(f"""WITH {_PLACED_SQL}, q AS (SELECT item_id AS query_id, {s_tokens('text')} AS q FROM benchmark), t AS (SELECT query_id, rank, chunk_id, {s_tokens('text')} AS t FROM pl)
SELECT query_id, rank, chunk_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END, 6)::DOUBLE AS overlap FROM t JOIN q USING (query_id)""")
def keyword_overlap(spark, sf_dir):
    asked = _questions(spark, sf_dir).select("query_id", T.search_tokens(F.col("text")).alias("q"))
    rows = _placed(spark, sf_dir).join(search.small(asked), "query_id")
    return rows.select("query_id", "rank", "chunk_id", F.round(requirements.keyword_overlap(F.col("q"), F.col("text")), 6).alias("overlap"))


@query("""SELECT doc_id, round(CASE WHEN contains(regexp_replace(source || ' ' || text, '[\\s·・•《》「」『』“”"''：:，,。？?！!、()（）\\[\\]【】\\-_—.]+', '', 'g'), 'src1') THEN 1.12 ELSE 0.28 END * CASE WHEN length(trim(text)) < 80 THEN 0.65 ELSE 1 END
* CASE WHEN regexp_matches(text, '(?i)图书在版|CIP|ISBN|责任编辑|出版社|作者介绍|目录|目次|CONTENTS|版权|前言|序言|附录|编者|本书人物原型') THEN CASE WHEN doc_id % 40 <= 12 THEN 0.45 ELSE 0.7 END WHEN doc_id % 40 <= 12 THEN 0.75 ELSE 1 END
* CASE WHEN regexp_matches(text, '(?i)第\\s*[一二三四五六七八九十百\\d]+\\s*[章节回]|chapter') THEN 1.04 ELSE 1 END, 6)::DOUBLE AS factor FROM documents""".replace("\\\\", "\\"))
def content_quality(spark, sf_dir):
    factor = requirements.content_quality(F.col("source"), F.col("text"), F.col("doc_id") % 40, F.lit("what is it"), F.array(F.lit("src1")))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(factor, 6).alias("factor"))


@query()
def source_bundle(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", requirements.source_bundle(F.col("text"), 1200, F.array(F.lit("license"), F.lit("the"))).alias("bundle"))


@query(rf"""WITH n AS (SELECT doc_id, lang || ' ' || source AS x FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct([x, {s_key('x')}] || list_transform(regexp_extract_all(x, '[\x{{4e00}}-\x{{9fff}}A-Za-z]+[·・•\s]+[\x{{4e00}}-\x{{9fff}}A-Za-z·・•\s]+'), lambda y: {s_key('y')}))), '|') AS variants FROM n""")
def surface_variants(spark, sf_dir):
    named = F.concat("lang", F.lit(" "), "source")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.surface_variants(named)), "|").alias("variants"))


@query(f"WITH {_CARD_SQL} SELECT title AS document_id, chunk_id FROM cd WHERE kind = 'section_card' QUALIFY row_number() OVER (PARTITION BY title ORDER BY chunk_id) <= 80")
def document_outline(spark, sf_dir):
    return maintenance.document_outline(_cards(spark, sf_dir).withColumnRenamed("title", "document_id")).select("document_id", "chunk_id")


# the engine end to end


def _engine(spark, sf_dir):
    from tidemark import engine

    small_batches(spark)
    index = engine.build_index(_units(spark, sf_dir).select("document_id", "unit", "text", "n_units"))
    questions = _questions(spark, sf_dir).withColumn("terms", F.slice(F.split("text", " "), 1, 2))
    return index, questions, engine.retrieve(index, questions, plan=coverage_plan(""))


@query()
def engine_search(spark, sf_dir):
    return _engine(spark, sf_dir)[2].results.select("query_id", "rank", "chunk_id", "document_id", "kind", "score", "channels", "anchored", "focused")


@query()
def engine_context(spark, sf_dir):
    from tidemark import engine

    index, questions, found = _engine(spark, sf_dir)
    context = engine.contexts(index, questions, found)
    return context.join(engine.confidences(found), "query_id")
