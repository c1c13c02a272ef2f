"""Token counts by a map-side two-tier lookup: a broadcast table of frequent pre-tokens' lengths, then worker caches."""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, small_batches
from .pretokens import Cutter, kept, lengths, tokenizer

#: Entries of the broadcast table; with its keys under 1 MB.
FREQUENT = 8192
#: Distinct pre-tokens that a task counts at once, and those it keeps when there are more.
COUNTED, KEPT = 400_000, 100_000
#: Longest pre-token that the table may hold.
LONGEST = 40
OVER = 2048


def _summaries(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(path)
        counts: Counter = Counter()
        for batch in slices(batches) if cutter.kind else ():
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    for part in cutter.parts(text):
                        if part not in cutter.special:
                            found.update(cutter.pretokens(part))
            for key, n in found.items():
                if len(key) <= LONGEST:
                    counts[key] += n
            if len(counts) > COUNTED:
                counts = Counter(dict(counts.most_common(KEPT)))
        yield pa.RecordBatch.from_pydict({"summary": pa.array([_packed(counts)], pa.binary())})

    return run


def _packed(counts: Counter) -> bytes:
    return zlib.compress(pickle.dumps(counts.most_common(2 * FREQUENT)), 1)


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    counts: Counter = Counter()
    for summary in frame["summary"]:
        for k, n in pickle.loads(zlib.decompress(summary)):
            counts[k] += n
        if len(counts) > COUNTED:
            counts = Counter(dict(counts.most_common(KEPT)))
    return pd.DataFrame({"summary": [_packed(counts)]})


def frequent_pretokens(texts: DataFrame, path: str, size: int = FREQUENT) -> dict[str, int]:
    """The most frequent pre-tokens of all texts and their numbers of tokens.

    Every task sums up its own texts in one bounded summary; summaries, never pre-tokens, are merged, in about the square
    root of their number of groups, and as many come to the driver. A task with more distinct pre-tokens than it may count
    forgets rare ones, which costs speed alone: any pre-token out of the table is encoded.
    """
    partials = texts.mapInArrow(_summaries(path), "summary binary")
    groups = max(1, int(texts.rdd.getNumPartitions() ** 0.5))
    merged = partials.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups))).groupBy("g").applyInPandas(_merged, "summary binary")
    counts: Counter = Counter()
    for row in merged.toLocalIterator():
        counts.update(dict(pickle.loads(zlib.decompress(row["summary"]))))
    encode = tokenizer(path).encode
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]
    return {k: len(encode(k, add_special_tokens=False).ids) for k, _ in top}


def _counter(path: str, frequent, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = kept("lengths", path, lambda: lengths(path, frequent.value)).__getitem__  # whichever table a cache began with, lengths are the same
        cutter = Cutter(path)
        cut, ids = cutter.pretokens, cutter.special
        for batch in slices(batches):
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                n_tokens.append(sum(1 if x in ids else sum(map(length, cut(x))) for x in cutter.parts(text)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_())})

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs, whole texts, in place (no shuffle of rows or pre-tokens).

    A null text counts as the empty one: no bytes, no tokens. The strings of special tokens count as one token each, as
    the library has them by default. Repeated rows and null ids each give a row; other columns are not read. A tokenizer
    file of a kind that isn't cut here gets whole texts, and no table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    frequent = spark.sparkContext.broadcast(frequent_pretokens(docs.select("text"), path))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_counter(path, frequent, limit), f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: tokens of every document's whole text under the word-end vocabulary."""
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
