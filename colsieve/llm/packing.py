"""Best-fit-decreasing packing of token sequences.

Lengths are whole numbers up to the capacity, so documents of one length are interchangeable and
the exact global best-fit-decreasing plan follows from the histogram of lengths alone. The planner
holds a segment tree over remaining capacities: it finds the tightest open bin in logarithmic
time, for one document or for a whole run of equal ones at once. Its input has at most `capacity`
rows whatever the corpus, so it runs on the driver; pieces themselves never leave the executors.
Each piece learns its rank among the pieces of its length from per-task counts, and looks its
bin up in the plan.

Null and empty texts yield one piece holding only the separator. Documents longer than the
capacity are cut into whole-capacity pieces, the last may be shorter. Repeated rows are packed
once each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsieve.llm.bpe import encoder
from colsieve.llm.common import map_arrow, prepare
from colsieve.session import materialize


class CapacityTree:
    """A segment tree over remaining capacities 0..size that counts open bins."""

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._open = [0] * (2 * self._leaves)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self._leaves
        while i:
            self._open[i] += bins
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of an open bin that is at least `need`."""
        i, tree = need + self._leaves, self._open
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self._leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self._leaves
            i >>= 1
        return None


def plan_best_fit(lengths: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first_rank, count, first_bin, offset): that run of equal pieces goes one each to that run of bins.

    Bins with the same contents so far form runs of neighbouring numbers. Each length opens at most two
    new runs and splits at most two, so there are at most 4 * capacity runs whatever the corpus.
    """
    tree = CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}
    plan: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(remaining: int, first: int, count: int) -> None:
        if not count:
            return
        runs.setdefault(remaining, []).append((first, count))
        tree.add(remaining, count)

    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first = capacity, bins
                count = -(-left // (capacity // length))
                bins += count
            else:
                first, count = runs[remaining].pop()
                tree.add(remaining, -count)
            each = remaining // length  # a bin that takes one of equal pieces is the tightest for the next
            used = min(count, -(-left // each))
            full = min(used, left // each)
            put(remaining, first + used, count - used)
            for start, bins_here, pieces_here in ((first, full, each), (first + full, used - full, left - full * each)):
                if bins_here:
                    for i in range(pieces_here):
                        plan.append((length, rank, bins_here, start, capacity - remaining + i * length))
                        rank += bins_here
                    put(remaining - pieces_here * length, start, bins_here)
            left = lengths[length] - rank
    return np.array(plan, dtype=np.int64).reshape(-1, 5)


def pieces(df: DataFrame, path: str, capacity: int, separator: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenized pieces, each with its rank among the pieces of its length in the same task."""
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, task_rank bigint" + (", ids array<bigint>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, task = encoder(path), np.array([separator], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        width = 4 * capacity
        for batch in batches:
            row, piece, start, length, crc, rank, ids_out = [], [], [], [], [], [], []
            for i, ids in enumerate(bpe.encode_all(batch.column("__text"))):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    n = len(part) // 4
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    rank.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        ids_out.append(np.frombuffer(part, "<u4").astype("i8").tolist())
            out = [batch.column("__id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32", "task", "task_rank"]
            if row:
                yield pa.RecordBatch.from_arrays(out + ([pa.array(ids_out, pa.list_(pa.int64()))] if with_ids else []), names + (["ids"] if with_ids else []))

    return map_arrow(df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")), run, schema)


def pack(df: DataFrame, path: str, capacity: int = 4096, separator: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids when with_ids).

    Shuffles carry counts only: (task, length, number of pieces). The table of pieces is written
    once, so ranks given by a task stay as they were even if an executor is lost later.
    """
    spark = df.sparkSession
    prepare(spark)
    made = materialize(pieces(df, path, capacity, separator, id_col, text_col, with_ids), "pieces")
    counts = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_best_fit(histogram, capacity)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    shared = spark.sparkContext.broadcast(plan[order])
    stride = int(plan[:, 2].max(initial=0)) + sum(histogram.values()) + 1
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "task", F.coalesce("base", F.lit(0)).alias("base"))
    ranked = made.join(before, ["length", "task"]).withColumn("rank", F.col("base") + F.col("task_rank")).drop("base")
    keep = [id_col, "piece", "start", "length", "ids_crc32"]
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + (", ids array<bigint>" if with_ids else "")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] * stride + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * stride + rank, "right") - 1
            out = [batch.column(c) for c in keep] + [pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])]
            names = [*keep, "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(out + ([batch.column("ids")] if with_ids else []), names + (["ids"] if with_ids else []))

    return map_arrow(ranked, place, schema)
