"""Mixing sources to target weights: water-filled targets, whole epochs first, then Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, read_table, uniform, whole, written

#: Weights of the sources in code-point order of their names (null last), repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all sizes.
SHARE = 1.5
#: A source's target stops at so many times its size.
MOST_EPOCHS = 2
SEED = "mix-1:"
#: Key intervals a source is divided into in each refinement, and rows of a source that are ordered exactly at most.
BINS = 4096
ORDERED_AT_ONCE = 100_000
#: A table of sources up to this many rows (about 60 bytes each) is broadcast; beyond, Spark joins by shuffle.
BROADCAST_SOURCES = 200_000


def quality_weight(text: Column, size: Column) -> Column:
    """0.05 to 1: falls with the share of symbol characters, and for very short texts."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    clean = F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * symbols / F.greatest(F.char_length(text), F.lit(1)))
    return F.greatest(F.lit(0.05), clean * size / (size + F.lit(20)))


def sampling_key(id_col: Column, weight: Column) -> Column:
    """Exponential key over the weight: ascending order draws without replacement with chances by weight."""
    return -F.log(uniform(id_col, SEED)) / weight


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target for rows of (source, size).

    The weights share out the budget; a source whose part is above most times its size stops there, and the excess goes to
    the others by weight until none is above: the sources in order of size over weight stop for as long as their cap is
    below the level that the rest would get.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * most)
    # running sums in the order in which sources reach their caps; ties in any order give the same level
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    free = F.col("cap") > F.col("level") * F.col("w")
    per = per.withColumn("free_level", F.min(F.when(free, F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"])
    target = F.when(F.col("free_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap").cast("double"), F.col("free_level") * F.col("w")))
    return per.select("source", F.col("source_size").cast("bigint").alias("source_size"), target.cast("double").alias("target"))


def _with_sources(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    right = sources.withColumnRenamed("source", "of_source")
    return rows.join(F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def draw(keyed: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> tuple[DataFrame, int]:
    """From rows of (source, size, skey), a row per source that says where its budget ends, and the number of sources.

    full: epochs that every document is taken; left: words of the next one; low, high, before: the interval of keys in
    which the budget ends, and the words that lie below it. Documents below low are taken once more, those from high on
    are not, and only those between need an order. The interval is narrowed by histograms of BINS parts of every source at
    once until it holds few rows, so no source's documents meet in one task.
    """
    sources = source_targets(keyed, weights, share, most)
    whole_words = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(whole_words / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    state = written(sources.withColumn("full", full).withColumn("left", (whole_words - full * F.col("source_size")).cast("bigint")).withColumns({"low": F.lit(0.0), "high": F.lit(1.0), "before": F.lit(0).cast("bigint"), "inside": F.lit(0).cast("bigint")}), "mix-sources")
    n_sources = state.count()
    while True:
        inside = _with_sources(keyed, state, n_sources).withColumn("at", F.col("skey") / (F.col("skey") + 1)).where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
        bin_of = F.least(F.lit(BINS - 1), F.floor((F.col("at") - F.col("low")) / (F.col("high") - F.col("low")) * BINS))
        bins = inside.groupBy("source", bin_of.alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("at").alias("at"))
        running = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumns({"below": F.sum("words").over(running) - F.col("words"), "next_at": F.lead("at").over(running)})
        bins = bins.withColumnsRenamed({"source": "of_source", "at": "bin_at"})
        begins = F.col("before") + F.col("below")
        # one bin of every source holds the end of its budget; a source without words has none and is not drawn from
        ends = state.join(bins, F.col("source").eqNullSafe(F.col("of_source")) & (begins <= F.col("left")) & (F.col("left") < begins + F.col("words")), "left")
        new = written(ends.select("source", "source_size", "target", "full", "left", F.coalesce("bin_at", "low").alias("low"), F.when(F.col("bin_at").isNull(), F.col("low")).otherwise(F.coalesce("next_at", "high")).alias("high"), (F.col("before") + F.coalesce("below", F.lit(0))).cast("bigint").alias("before"), F.coalesce("n", F.lit(0)).cast("bigint").alias("inside")), "mix-ends")
        far = new.join(state.select(F.col("source").alias("s0"), F.col("inside").alias("was")), F.col("source").eqNullSafe(F.col("s0"))).agg(F.max(F.when((F.col("was") == 0) | (F.col("inside") < F.col("was")), F.col("inside")))).first()[0]
        dropped(keyed.sparkSession, state)
        state = new
        if (far or 0) <= ORDERED_AT_ONCE:  # or all keys of an interval are one and the same
            return state, n_sources


def taken_words(keyed: DataFrame, ends: DataFrame, n_sources: int, tie: list[str]) -> DataFrame:
    """The rows with source_size, target, full and extra: the words taken beyond the whole epochs."""
    rows = _with_sources(keyed, ends, n_sources).withColumn("at", F.col("skey") / (F.col("skey") + 1))
    between = (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
    apart = rows.where(~between).withColumn("extra", F.when(F.col("at") < F.col("low"), F.col("size")).otherwise(F.lit(0)).cast("bigint"))
    order = Window.partitionBy("source").orderBy("skey", *tie).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    exact = rows.where(between).withColumn("extra", F.least(F.col("size"), F.greatest(F.col("left") - gone, F.lit(0))).cast("bigint"))
    return apart.unionByName(exact).drop("at", "low", "high", "before", "inside", "left")


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    text = whole("text")
    size = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    rows = docs.select(*keep, "doc_id", "source", size.alias("size"), text.alias("_text"))
    return rows.withColumn("skey", sampling_key(F.col("doc_id"), quality_weight(F.col("_text"), F.col("size")))).drop("_text")


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document (one row for each row, repeated ones too).

    A null text or one of white space has size 0 and gives nothing. Null is a source of its own, the last by name. Every
    document is taken target // source_size times whole; the rest of the target is drawn in the order of the sampling keys,
    and the document in which the budget ends gives only the words that are left. Keys depend on doc_id alone, so reruns
    agree; equal keys go by doc_id, then size. An empty table gives an empty table.
    """
    keyed = written(sized(docs), "mix-keys")
    ends, n = draw(keyed)
    rows = taken_words(keyed, ends, n, ["doc_id", "size"])
    return rows.select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("extra")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix has them: a row for each time a document is taken, with the columns of docs.

    Documents stay whole: the one in which a budget ends is taken once more if at least half of its words are.
    """
    keyed = written(sized(docs), "mix-keys")
    ends, n = draw(keyed)
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_row"), "doc_id", "source", "text")
    rows = sized(rows, "_row")
    rows = taken_words(rows, ends, n, ["doc_id", "size"])
    times = F.col("full") + F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)
    return rows.where(times > 0).withColumn("_time", F.explode(F.sequence(F.lit(1), times.cast("int")))).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the mix of all documents, sources weighing 5, 2, 1, sharing 150% of all sizes."""
    return mix_sources(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
  / greatest(0.05, greatest(0.05, 1.0 - 5.0 * len(regexp_extract_all(t, '[#*$%&|<>]')) / greatest(length(t), 1)) * size / (size + 20)) AS skey FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, cap / w) AS free_level FROM l WHERE cap > level * w),
t AS (SELECT source, source_size, CASE WHEN free_level IS NULL THEN cap ELSE least(cap::DOUBLE, free_level * w) END AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN (floor(target)::BIGINT // source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, floor(e.target)::BIGINT - e.epochs * e.source_size AS rest,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.skey, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target, (epochs * size + least(size, greatest(rest - gone, 0)))::BIGINT AS taken FROM r
"""
