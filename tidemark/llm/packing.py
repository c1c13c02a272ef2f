"""Best-fit packing into sequences of a fixed number of tokens, in bulk-synchronous rounds over size classes.

Pieces and gaps have whole sizes of at most the capacity, so pieces of one size are interchangeable, and so are gaps. The
range sort is kept in run-length form: a piece stands for (size, rank within its size), gaps for runs of sequences with
the same room. Ranks are made by the cluster; a round takes the largest size that is left, sweeps to its successor, the
least room that it fits, gives the pieces of lowest rank to the gaps of that class (as many as there are, so no two pieces
ask for one gap), updates the rooms, and repeats. The state of a round is bounded by the capacity, not by the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, slices, small_batches, written
from .pretokens import Cutter, id_bytes, kept

CAPACITY = 2048
END = b"\0\0\0\0"  # the id that follows every document

class Encoder:
    """The library's ids of texts, without special tokens added, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.ids, self.cutter = id_bytes(path).__getitem__, Cutter(path)

    def __call__(self, text: str) -> bytes:
        ids, cut, special = self.ids, self.cutter.pretokens, self.cutter.special
        return b"".join(special[x].to_bytes(4, "little") if x in special else b"".join(map(ids, cut(x))) for x in self.cutter.parts(text))


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: full ones but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = kept("ids", path, lambda: Encoder(path))
        for batch in slices(batches):
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = encoded(text or "") + END
                for k, (s, n) in enumerate(piece_bounds(len(found) // 4, capacity)):
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(found[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, batch.schema.field(0).type), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """For every size, runs of ranks and where they go: (size, first rank, first sequence, offset), ascending.

    Ranks from the first up to the next run's first go to as many sequences from the first on, at the offset. Where no
    gap is large enough, as many sequences are opened as the remaining pieces of the size fill.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    mask, sequences, out = 0, 0, []

    def put(room: int, first: int, n: int) -> None:
        nonlocal mask
        if room:
            rooms.setdefault(room, []).append((first, n))
            mask |= 1 << room

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            fits = mask >> size
            if not fits:
                opened = -(-left // (capacity // size))
                put(capacity, sequences, opened)
                sequences += opened
                continue
            room = size + (fits & -fits).bit_length() - 1
            first, n = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
            k = min(n, -(-left // (room // size)))  # gaps that the pieces fill; the next rounds take what is left of them first
            if k < n:
                put(room, first + k, n - k)
            put(room - size, first, k)
            out.append((size, rank, first, capacity - room))
            rank, left = rank + k, left - k
    return sorted(out)


def _placed(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first_rank, first_seq, offset = runs.value
        key = size.astype(np.int64) << 40 | first_rank
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            out = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": pa.array(first_seq[at] + rank - first_rank[at], pa.int64()), "offset": pa.array(offset[at], pa.int64())})

    return run


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs.

    A null text counts as empty and gives one piece of one id. Repeated rows are packed once each; null ids are kept; other
    columns are not read; an empty table gives an empty table. Ties go by chunk of the written table, id and piece.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(_cut(path, capacity), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")
    pieces = written(pieces.withColumn("chunk", F.spark_partition_id()), "pieces")
    # ranks within a size: by chunk, then within the chunk, so that no size's pieces meet in one task
    per_chunk = pieces.groupBy("length", "chunk").count()
    offsets = per_chunk.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("chunk")) - F.col("count")).select("length", "chunk", "before")
    counts = {r["length"]: r["n"] for r in per_chunk.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # a row per size at most
    runs = np.array(best_fit_runs(counts, capacity), dtype=np.int64).reshape(-1, 4)
    within = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("within", within).join(offsets, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("within"))
    plan = spark.sparkContext.broadcast(tuple(runs.T.copy()))
    return ranked.drop("chunk", "before", "within").mapInArrow(_placed(plan), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
