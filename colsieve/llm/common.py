"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.session import ensure_checkpoint, materialize, ship_package

#: Rows per Arrow batch for text columns, so that a batch of long texts stays small.
TEXT_BATCH_ROWS = 1000
#: Bits of a key filter, in rows of 512 words of 64: at most 1024 rows, 4 MB, whatever the number of keys.
FILTER_BITS, _ROW_BITS = 1 << 25, 1 << 15
#: glibc's way to return free memory, where it is the C library.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: What a worker process keeps from one task to the next, by what made it, and what of it the current task has asked for.
_KEPT: dict[str, Any] = {}
_ASKED: set[str] = set()


def held_over(name: str, make: Callable[[], Any]) -> Any:
    """The process's own object of this name, made when it is first asked for. It stays as long as each task asks for it."""
    if name not in _KEPT:
        _KEPT[name] = make()
    _ASKED.add(name)
    return _KEPT[name]


def begin_task() -> None:
    _ASKED.clear()


def end_task() -> None:
    """Drops what the task hasn't asked for, and gives unused memory back to the system: idle workers wait for other operators' tasks."""
    if dropped := _KEPT.keys() - _ASKED:
        for name in dropped:
            del _KEPT[name]
        gc.collect()  # an encoder and its memos refer to each other
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers hold no more after a task than what it has asked `held_over` for."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        try:
            yield from run(batches)
        finally:
            end_task()

    return df.mapInArrow(whole, schema)


def prepare(spark: SparkSession) -> None:
    """Ship the package, make sure there is a checkpoint folder, keep Arrow batches small.

    The two Arrow settings are the session's from then on: lazy results are evaluated after the operator has returned.
    """
    ship_package(spark)
    ensure_checkpoint(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with one output batch per non-empty input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None and out.num_rows:
                yield out

    return map_arrow(df, run, schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 byte strings (None for null), without decoding."""
    return binary(batch.column(name)).to_pylist()


def binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def quoted(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _filter_bit(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def key_filter(df: DataFrame, *keys: str) -> DataFrame:
    """A fixed-size filter (row, words) of the keys of df: a bit for each key's hash, as a written table of at most 4 MB."""
    bit = df.select(_filter_bit([quoted(k) for k in keys]).alias("bit"))
    words = bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    entry = F.struct(F.expr(f"word % {_ROW_BITS // 64}"), "bits")
    held = words.groupBy(F.expr(f"word div {_ROW_BITS // 64}").alias("row")).agg(F.map_from_entries(F.collect_list(entry)).alias("held"))
    return materialize(held.select("row", F.expr(f"transform(sequence(0, {_ROW_BITS // 64 - 1}), i -> coalesce(held[cast(i as bigint)], 0L))").alias("words")), "filter")


def with_filter(df: DataFrame, keys_filter: DataFrame, *keys: str) -> DataFrame:
    """df and __may: false for rows whose keys are certainly not in the filter, true for all others.

    It saves wide rows a shuffle before a join that most of them would not survive. What slips through is left to
    that join, so results never depend on it. Beyond some tens of millions of keys the bits fill up and it lets everything through.
    """
    probe = df.withColumn("__bit", _filter_bit([quoted(k) for k in keys])).withColumn("__at", F.expr(f"__bit div {_ROW_BITS}"))
    may = F.expr(f"coalesce(shiftright(element_at(__words, cast((__bit % {_ROW_BITS}) div 64 as int) + 1), cast(__bit % 64 as int)) & 1L = 1L, false)")
    words = F.broadcast(keys_filter.select(F.col("row").alias("__at"), F.col("words").alias("__words")))  # of bounded size, see FILTER_BITS
    return probe.join(words, "__at", "left").withColumn("__may", may).drop("__bit", "__words", "__at")


class Carried:
    """All columns of a table under names that clash with nothing, for a pass over its text that gives them back.

    `df` has __c0, __c1, ... and __text; `schema` and `columns(batch)` describe them in a pass's output.
    """

    def __init__(self, df: DataFrame, text_col: str):
        self._names, self._text = df.columns, text_col
        self._rest = [(i, c) for i, c in enumerate(df.columns) if c != text_col]
        types = [f.dataType.simpleString() for f in df.schema.fields]
        self.df = df.select(*(quoted(c).alias(f"__c{i}") for i, c in self._rest), quoted(text_col).cast("string").alias("__text"))
        self.schema = ", ".join([*(f"__c{i} {types[i]}" for i, _ in self._rest), "__text string"])
        self.names = [*(f"__c{i}" for i, _ in self._rest), "__text"]

    def of(self, column: str) -> str:
        return "__text" if column == self._text else f"__c{self._names.index(column)}"

    def columns(self, batch: pa.RecordBatch) -> list[pa.Array]:
        return [batch.column(n) for n in self.names]

    def restore(self, df: DataFrame, text: str = "__text") -> DataFrame:
        return df.select(*((F.col(text) if c == self._text else F.col(f"__c{i}")).alias(c) for i, c in enumerate(self._names)))
