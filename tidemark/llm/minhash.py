"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits and bias correction.

Every shingle is hashed once. The hash's upper bits name its bin, and the least hash of a bin stands for it; an empty bin
takes the value of another that is drawn for it at random until a full one is met. Each bin keeps its low-order byte.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, read_table, uniform, whole, word_list

WORDS = 5
BIN_BITS, BINS = 7, 128
#: Draws that all empty bins make together before those still empty take the full bin that is least by a hash of both.
DRAWS = 5
#: Rows of a bucket of neighbouring ids to aim at, and ids drawn for each bucket's bounds; they steer buckets' sizes alone.
BUCKET_ROWS, DRAWN_IDS, MOST_BUCKETS = 2_000, 24, 200_000
NOTHING = "00" * BINS

_LOW = (1 << 64 - BIN_BITS) - 1
_signed = lambda x: x - (1 << 64) if x >> 63 else x


def _numbers(values, kind: str) -> Column:
    """A constant array, kept as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _draw(step: int) -> Column:
    """The bin that each bin draws in a step: sha256 of step and bin, modulo the bins."""
    return _numbers([int.from_bytes(hashlib.sha256(f"{step}:{j}".encode()).digest()[:4], "big") % BINS for j in range(BINS)], "int")


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def shingle_hashes(words: Column) -> Column:
    """A 64-bit hash of each five-word shingle; of the whole sequence if there are fewer words; none without words."""
    last = F.size(words) - WORDS
    many = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)])))
    few = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(last >= 0, many).otherwise(few)


def signature(text: Column) -> Column:
    """BINS low-order bytes, less 128, as array<tinyint>; empty for a text without words."""
    edge = _numbers([_signed(b << 64 - BIN_BITS | _LOW) for b in range(BINS)], "bigint")  # greatest hash of each bin, standing for an empty one
    ordered = lambda hashes: F.sort_array(F.concat(hashes, edge))
    firsts = lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1))))
    byte = lambda h: F.when(h.bitwiseAND(F.lit(_LOW)) == _LOW, F.lit(None)).otherwise(h.bitwiseAND(F.lit(255)).cast("int") - 128)

    def densified(v: Column) -> Column:
        def last_resort(w: Column) -> Column:
            full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(v, i).isNotNull())
            least = lambda e, j: F.array_min(F.transform(e, lambda i: F.xxhash64(i, j).bitwiseAND(F.lit(-BINS)).bitwiseOR(i.cast("bigint")))).bitwiseAND(F.lit(BINS - 1)).cast("int")
            return let(full, lambda e: F.transform(w, lambda x, j: F.coalesce(x, F.get(v, least(e, j)))))

        def step(w: Column, k: int) -> Column:
            if k == DRAWS:
                more = last_resort(w)
            else:
                more = let(F.transform(w, lambda x, j: F.coalesce(x, F.get(v, F.get(_draw(k), j)))), lambda u: step(u, k + 1))
            return F.when(F.exists(w, lambda x: x.isNull()), more).otherwise(w)

        return step(v, 0)

    def of(hashes: Column) -> Column:
        values = let(ordered(hashes), lambda s: F.transform(firsts(s), byte))
        return F.when(F.size(hashes) == 0, F.array().cast("array<tinyint>")).otherwise(let(values, densified).cast("array<tinyint>"))

    return let(word_list(text), lambda w: let(shingle_hashes(w), of))


def packed(sig: Column) -> Column:
    """Two hexadecimal digits a bin; zeros for a text without words."""
    digits = F.split(F.lit(",".join(f"{b:02x}" for b in range(256))), ",")
    return F.when(F.size(sig) == 0, F.lit(NOTHING)).otherwise(F.array_join(F.transform(sig, lambda b: F.get(digits, b.cast("int") + 128)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance: the share of equal bytes, less the 1 in 256 of unlike bins that agree by chance; 0 to 1.

    Two texts without words are alike, one without words and another aren't.
    """
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    share = (same / F.lit(float(BINS)) - F.lit(1 / 256)) / F.lit(1 - 1 / 256)
    none = F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), none).otherwise(F.greatest(F.lit(0.0), share))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    table = _numbers(bounds, "bigint")
    first = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        right = (a["lo"] < a["hi"]) & (F.get(table, mid) <= key)
        return F.struct(F.when(right, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(right | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), first, halve, lambda a: a["lo"]).cast("int")


def with_next(rows: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """rows with next_<c> for each carried column: its value in the next row by descending key, in the first after the last.

    Rows are dealt to buckets of neighbouring keys; each bucket also gets a copy of the first row of the bucket below it,
    so no order over all rows is needed. Equal keys go by the carried columns; null keys come last.
    """
    least = -(1 << 63)
    keyed = rows.withColumn("_k", F.coalesce(F.col(key).cast("bigint"), F.lit(least)))
    n = rows.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    drawn = sorted(r[0] for r in keyed.where(uniform(F.col("_k"), "bounds:") < min(1.0, DRAWN_IDS * buckets / max(n, 1))).select("_k").collect()) if buckets > 1 else []
    bounds = sorted({drawn[len(drawn) * i // buckets] for i in range(1, buckets)}) if drawn else []
    keyed = keyed.withColumn("_b", _bucket(F.col("_k"), bounds))
    greatest = [r[0] for r in keyed.groupBy("_b").agg(F.max("_k").alias("m")).select("m").collect()]  # one for each bucket
    greatest.sort()
    # the greatest key of a bucket is followed up by the bucket above it, the greatest of all by the lowest
    ghosts = [(m, bisect.bisect_right(bounds, greatest[(i + 1) % len(greatest)])) for i, m in enumerate(greatest)]
    ghosts = rows.sparkSession.createDataFrame(ghosts, "_g bigint, _gb int")
    placed = keyed.join(F.broadcast(ghosts), F.col("_k") == F.col("_g"), "left")
    own = F.struct(F.col("_b").cast("int").alias("b"), F.lit(False).alias("ghost"))
    places = F.when(F.col("_gb").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_gb").alias("b"), F.lit(True).alias("ghost"))))
    placed = placed.select(*rows.columns, "_k", F.explode(places).alias("_at"))
    order = Window.partitionBy("_at.b").orderBy("_at.ghost", F.col("_k").desc(), *carried)
    return placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where(~F.col("_at.ghost")).drop("_k", "_at")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    A null text counts as empty. The edited text has its last third (in whole code points, rounded down) replaced by as
    many from the beginning of the next document by descending doc_id, or by all of it; after the last comes the first, and
    a single document is its own next. Repeated rows follow one another in the order of their texts; null ids come last;
    other columns are not read; an empty table gives an empty table.
    """
    text = whole("text")
    rows = docs.select("doc_id", text.alias("t"), signature(text).alias("s"))
    ordered = with_next(rows, "doc_id", ["t", "s"])
    n = F.char_length("t")
    cut = F.floor(n / F.lit(3)).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), n - cut), F.substring("next_t", F.lit(1), cut))
    out = ordered.withColumns({"n_chars": n.cast("bigint"), "e": edited}).withColumn("es", signature(F.col("e")))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.encode("e", "UTF-8"), 256).alias("edited_sha256"), packed(F.col("s")).alias("fingerprint"), packed(F.col("es")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("es")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))
