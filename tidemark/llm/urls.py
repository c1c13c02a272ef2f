"""URL filters: host-suffix and path-prefix expressions, joined to rules by short hashes, then confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: (host, path, verdict) of the rules that op5 applies.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Rules up to this many are broadcast (about 100 bytes each); beyond, both sides are shuffled and the urls salted.
BROADCAST_RULES = 500_000
SALTS = 32
#: Bits of the short hash that urls and rules meet by; a digest then tells those apart that only share it.
SHORT_BITS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def _expression(host: Column, path: Column) -> Column:
    # a host holds no slash and a path is empty or starts with one, so the concatenation stands for one pair only
    return F.concat(host, path)


def _short(expression: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(expression), 64 - SHORT_BITS)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Return id, host, path, rule, verdict for each row of urls.

    A rule fits its host and all subdomains of it where the path starts with the rule's path; the longest rule wins,
    between equally long ones a block wins, then the greater text. Null url, or none with ://: empty host and path, no
    rule, the default verdict. Repeated rows, null ids included, each get their row; other columns are not read.
    Rules with a null or empty host, or a null path or verdict, are ignored; A-Z in their hosts count as lower case, as in
    urls. An empty rule table gives every url the default.

    A url's expressions (host suffixes of as many labels as rules have, path prefixes as long as theirs) meet the rules by
    the short hash alone; the digest is made for what has met. All expressions of a row stay in its partition, so their
    maxima are formed before the one shuffle, which is by row: a frequent host, path or null url is no key of anything.
    """
    host = F.translate("rule_host", UPPER, LOWER)
    rules = rules.dropna(subset=["rule_host", "rule_path", "rule_verdict"]).where("rule_host <> ''").select(host.alias("r_host"), F.col("rule_path").alias("r_path"), F.col("rule_verdict").alias("r_verdict"))
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block over allow
    expression = _expression(F.col("r_host"), F.col("r_path"))
    rank = F.struct(F.char_length(expression).alias("n"), (F.col("r_verdict") == "block").alias("b"), expression.alias("t"), F.col("r_verdict").alias("v"))
    rules = rules.select("r_host", "r_path", _short(expression).alias("r_short"), _digest(expression).alias("r_digest"), rank.alias("r_rank"))
    counted = rules.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.char_length("r_path"))).alias("lengths"), F.sort_array(F.collect_set(F.size(F.split("r_host", r"\.")))).alias("labels")).first()
    numbers = lambda found: F.array(*[F.lit(x) for x in found]).cast("array<int>")  # noqa: E731  as many as rules have lengths

    base = urls.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("row"))

    def expressions(labels: Column) -> Column:
        n = F.size(labels)
        suffixes = F.transform(F.filter(numbers(counted["labels"]), lambda k: k <= n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
        prefixes = F.transform(F.filter(numbers(counted["lengths"]), lambda k: k <= F.char_length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
        return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _expression(h, p))))

    expanded = base.select("*", F.explode_outer(let(F.split("host", r"\."), expressions)).alias("e")).withColumn("short", _short(F.col("e")))
    if counted["n"] <= broadcast_rules:
        met = expanded.join(F.broadcast(rules), F.col("short") == F.col("r_short"), "left")
    else:  # a frequent expression such as a top-level domain is spread over the salts
        salted = rules.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
        met = expanded.withColumn("salt", salt).join(salted, (F.col("short") == F.col("r_short")) & (F.col("salt") == F.col("r_salt")), "left")
    confirmed = F.when(_digest(F.col("e")) == F.col("r_digest"), F.col("r_rank"))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(confirmed).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.t").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every url of pages under the four rules."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rule_table(spark))


OP5_SQL = r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT rh || rp FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS rule,
  coalesce((SELECT rv FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1), 'allow') AS verdict
FROM v
"""
