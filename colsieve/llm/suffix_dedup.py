"""Repeated-passage removal: prefix-free parsing, then suffix order of what is left to decide.

The text is parsed at triggers of a rolling hash. The trigger of a position is the smallest hash
among the next WINDOW positions, so it depends on nothing but the bytes that follow, equal strings
are parsed alike wherever they stand, and every 400-byte string holds its trigger. Positions with
one trigger form a phrase.

* Dictionary: a phrase's core, the bytes from its trigger on that all of its 400-byte strings share.
  Phrases whose core stands in the corpus once can hold no repeat and are dropped.
* Parse: the phrase with all that its strings read, its context. Equal contexts settle every string
  of their phrases at once, which is what makes highly repetitive text cheap.
* The remaining phrases share their core with others but not their context: there a repeat begins or
  ends. Dictionary and parse come together there: the distinct contexts of a core are put in suffix
  order (a suffix array by prefix doubling, cut at 400 bytes), in which equal strings are neighbours.
* A core with more than GROUP_ROWS distinct contexts is parsed again, deeper: its starts are halved by their distance
  to the trigger, and each half shares a longer core than before. Equal strings have one distance, so they stay
  together. Halving goes on, level by level over all such cores at once, until a core is rare, its contexts are
  equal or the group is small enough for a suffix sort; at one distance the core is the whole string, so it always
  ends. No group is gathered whole, however many copies it has.

Matches never cross documents; every string is judged on the input. Null text is empty. Texts below
400 bytes lose nothing. Repeated rows are each other's copies, also under one id. Ids are cast to bigint (a
string that isn't a number raises). Long texts are parsed in overlapping slices of SLICE starts, with the same phrases.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsieve.llm.common import Carried, key_filter, map_arrow, map_batches, prepare, quoted, utf8, with_filter
from colsieve.session import materialize

LENGTH = 400
GRAM, WINDOW = 16, 192
#: Bytes of contexts that share one suffix sort, and the distinct contexts of one core above which it is parsed deeper.
SORT_BYTES, GROUP_ROWS = 1 << 20, 512
#: Starts that are parsed at once, which bounds a task's memory whatever the length of a text.
SLICE = 1 << 20
PHRASE_COLUMNS = ["row", "tag", "first", "last", "lead", "core", "context"]
RANGE = ["row", "tag", "first", "last"]
_BASE = 0x9E3779B97F4A7C15


def rolling(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of every GRAM bytes, by doubling."""
    h, width, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % (1 << 64)
        width *= 2
    return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    have, m = 1, v
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


def _triggers(data: np.ndarray, starts: int, window: int) -> np.ndarray:
    """The trigger of each of the first `starts` positions."""
    h = rolling(data)
    h ^= h >> np.uint64(32)
    h = (h * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFFFFFF00000000)
    h |= np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64)  # ties: the rightmost
    return (np.uint64(0xFFFFFFFF) - (sliding_min(h, window)[:starts] & np.uint64(0xFFFFFFFF))).astype(np.int64)


def phrases(raw: bytes, length: int = LENGTH, window: int = WINDOW, slice_: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, trigger) of each phrase: starts of `length`-byte strings with one trigger."""
    starts = len(raw) - length + 1
    if starts < 1:
        return (np.zeros(0, np.int64),) * 3
    firsts, triggers, before = [], [], -1
    for at in range(0, starts, slice_):
        n = min(slice_, starts - at)
        trigger = _triggers(np.frombuffer(raw, np.uint8, n + window + GRAM - 2, at), n, window) + at
        first = np.flatnonzero(np.diff(trigger, prepend=before))
        firsts.append(first + at)
        triggers.append(trigger[first])
        before = int(trigger[-1])
    first = np.concatenate(firsts)
    return first, np.append(first[1:], starts) - 1, np.concatenate(triggers)


def parse(df: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Rows (row, tag, first, last, lead, core, context) for each phrase of df (row, tag, __text); lead: from first to the trigger."""
    core_bytes = length - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in PHRASE_COLUMNS]
            held = 0
            for row, tag, raw in zip(batch.column("row").to_pylist(), batch.column("tag").to_pylist(), utf8(batch, "__text"), strict=True):
                first, last, trigger = phrases(raw or b"", length, window)
                if not len(first):
                    continue
                view, fp = memoryview(raw), xxhash.xxh3_64_intdigest
                lead = trigger - first
                core = np.fromiter((fp(view[t : t + core_bytes]) for t in trigger.tolist()), np.uint64, len(first))
                spans = zip(first.tolist(), last.tolist(), lead.tolist(), strict=True)
                context = np.fromiter((fp(view[a : b + length], seed=d) for a, b, d in spans), np.uint64, len(first))
                values = (np.full(len(first), row), np.full(len(first), tag), first.astype(np.int32), last.astype(np.int32))
                for column, v in zip(out, (*values, lead.astype(np.int32), core.view(np.int64), context.view(np.int64)), strict=True):
                    column.append(v)
                held += len(first)
                if held > 50_000:
                    yield _phrase_batch(out)
                    out, held = [[] for _ in PHRASE_COLUMNS], 0
            if held:
                yield _phrase_batch(out)

    return map_arrow(df, run, "row bigint, tag bigint, first int, last int, lead int, core bigint, context bigint")


def _phrase_batch(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], PHRASE_COLUMNS)


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every position's next `length` bytes in suffix order; equal strings share a rank. Zeros pad the end.

    Prefix doubling: ranks of width w at i and i + w give those of width 2w. The first round packs eight bytes.
    """
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    packed = np.zeros(len(data), np.uint64)
    width = min(8, length)
    for k in range(width):
        packed = packed << np.uint64(8) | padded[k : k + len(data)]
    rank = np.unique(packed, return_inverse=True)[1]
    while width < length:
        step = min(width, length - width)
        after = np.zeros(len(data), np.int64)
        after[: len(data) - step] = rank[step:] + 1
        rank = np.unique(rank * (len(data) + 2) + after, return_inverse=True)[1]
        width += step
    return rank


def repeated_starts(contexts: list[bytes], spans: list[int], open_: list[bool], length: int) -> Iterator[tuple[int, int, int]]:
    """(context, first, last): runs of an open context's starts whose string also stands in another context or start."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    rank = suffix_ranks(data, length)
    sizes, spans_ = np.array([len(c) for c in contexts]), np.array(spans)
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(contexts)), spans_)
    offset = np.arange(int(spans_.sum())) - np.repeat(np.cumsum(spans_) - spans_, spans_)
    ranks = rank[base[owner] + offset]
    _, inverse, count = np.unique(ranks, return_inverse=True, return_counts=True)
    hit = (count[inverse] > 1) & np.array(open_)[owner]
    edge = np.flatnonzero(hit)
    if not len(edge):
        return
    breaks = np.flatnonzero((np.diff(edge) != 1) | (np.diff(owner[edge]) != 0)) + 1
    for run in np.split(edge, breaks):
        yield int(owner[run[0]]), int(offset[run[0]]), int(offset[run[-1]])


def _local_repeats(rows: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated starts from rows (core, row, tag, first, last, open, bytes) that lie sorted by core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, core = 0, None

        def flush() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            found = list(repeated_starts([h[4] for h in held], [h[3] - h[2] + 1 for h in held], [h[5] for h in held], length))
            if not found:
                return None
            rows_, tags, starts, _, _, _ = zip(*(held[i] for i, _, _ in found), strict=True)
            first = [s + a for s, (_, a, _) in zip(starts, found, strict=True)]
            last = [s + b for s, (_, _, b) in zip(starts, found, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(rows_, pa.int64()), pa.array(tags, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], RANGE)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("core", "row", "tag", "first", "last", "bytes", "open")]
            for c, *rest in zip(*columns, strict=True):
                if c != core and size >= SORT_BYTES:  # only whole groups share a sort
                    if (out := flush()) is not None:
                        yield out
                    held, size = [], 0
                core = c
                held.append(tuple(rest))
                size += len(rest[4])
        if held and (out := flush()) is not None:
            yield out

    return map_arrow(rows, run, "row bigint, tag bigint, first int, last int")


def halves(first: int, last: int, lead: int, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
    """(lo, hi, first, last) of the starts at distance mid..hi and of those at lo..mid from the trigger; starts count from `first`."""
    mid = (lo + hi) // 2
    for a, b in ((mid, hi), (lo, mid)):
        start, end = max(0, lead - b + 1), min(last - first, lead - a)
        if start <= end:
            yield a, b, start, end


def _halved(rows: DataFrame, length: int) -> DataFrame:
    """Rows of contexts (lo, hi: the distances of their starts to the trigger) as those of both halves, with their longer cores."""
    names = ["core", "context", "lo", "hi", "open", "row", "tag", "first", "last", "lead", "bytes"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = xxhash.xxh3_64_intdigest
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("core", "lo", "hi", "open", "row", "tag", "first", "last", "lead", "bytes")]
            out: list[tuple] = []
            for core, lo, hi, is_open, row, tag, first, last, lead, data in zip(*columns, strict=True):
                for a, b, start, end in halves(first, last, lead, lo, hi):
                    shared = data[lead - a : lead - b + 1 + length]
                    own = data[start : end + length]
                    key = fp(shared, seed=(2 * core + (a == lo)) & 0xFFFFFFFFFFFFFFFF)
                    out.append((signed(key), signed(fp(own, seed=lead - start)), a, b, is_open, row, tag, first + start, first + end, lead - start, own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "core bigint, context bigint, lo int, hi int, open boolean, row bigint, tag bigint, first int, last int, lead int, bytes binary"
    return map_arrow(rows, run, schema)


def repeated_ranges(texts: DataFrame, length: int = LENGTH, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Ranges (row, tag, first, last) of starts whose `length`-byte string stands elsewhere too, from texts (row, tag, __text)."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = materialize(parse(texts, length, window), "parse")
    # Phrases of cores that stand once are left out as far as the filter knows them; the others' contexts turn out single. What is
    # joined is written first: then both sides of a join are plain exchanges, whose skewed parts Spark splits.
    cores = parsed.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core")
    shared = with_filter(parsed, key_filter(cores, "core"), "core").filter("__may").drop("__may")
    one = F.min(F.struct("row", "tag", "first", "last", "lead")).alias("one")
    kinds = materialize(shared.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), one), "contexts")
    repeated = materialize(kinds.filter("n > 1").select("core", "context"), "repeated")
    likely = with_filter(shared, key_filter(repeated, "core", "context"), "core", "context").filter("__may")
    found = [likely.join(repeated, ["core", "context"], "left_semi").select(*RANGE)]
    wanted = _undecided(kinds.select("core", (F.col("n") == 1).alias("open"), "one.*"), group_rows)
    body = F.expr(f"substring(cast(__text AS binary), first + 1, last - first + {length})")
    keyed = with_filter(texts, key_filter(wanted, "row", "tag"), "row", "tag").filter("__may").drop("__may")
    level = materialize(keyed.join(wanted, ["row", "tag"]).select("core", F.lit(0).alias("lo"), F.lit(window).alias("hi"), "large", "open", *RANGE, "lead", body.alias("bytes")), "open")
    small = []
    while True:
        small.append(level.filter("NOT large").select("core", "open", *RANGE, "bytes"))
        large = level.filter("large")
        if large.isEmpty():
            break
        halved = materialize(_halved(large, length), "halves")
        rows = F.min(F.struct("row", "tag", "first", "last", "lead", "lo", "hi", "bytes")).alias("one")
        kinds = materialize(halved.groupBy("core", "context").agg((F.count(F.lit(1)) == 1).alias("single"), F.max("open").alias("any"), rows), "contexts")
        repeated = materialize(kinds.filter("NOT single AND any").select("core", "context"), "repeated")
        found.append(halved.filter("open").join(repeated, ["core", "context"], "left_semi").select(*RANGE))
        level = materialize(_undecided(kinds.select("core", F.expr("single AND any").alias("open"), "one.*"), group_rows), "open")
    # Equal strings share their level and core, so one pass sorts the groups of all levels.
    groups = functools.reduce(DataFrame.unionByName, small).repartition(n, "core").sortWithinPartitions("core")
    return functools.reduce(DataFrame.unionByName, [*found, _local_repeats(groups, length)])


def _undecided(kinds: DataFrame, group_rows: int) -> DataFrame:
    """The distinct contexts (core, open, ...) of cores that have several, one of them open; large: more than group_rows."""
    counts = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("rows"), F.max("open").alias("mixed")).filter("rows > 1 AND mixed")
    return kinds.join(materialize(counts.select("core", (F.col("rows") > group_rows).alias("large")), "groups"), "core")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, window: int = WINDOW, group_rows: int = GROUP_ROWS, with_spans: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, kept_text; with with_spans also spans (start, end).

    The digest is of the remaining bytes; kept_text is cut at whole characters: one that is only partly covered stays.
    """
    rows = df.select(quoted(id_col).alias("__id"), quoted(text_col).cast("string").alias("__text"))
    schema = f"__id {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
    names = ["__id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"] + ["spans"] * with_spans

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, removed, runs, marks, texts, spans_out = [], [], [], [], [], []
        for raw, found in zip(utf8(batch, "__text"), batch.column("ranges").to_pylist(), strict=True):
            raw, spans = raw or b"", spans_of(found, length)
            kept = without(raw, spans)
            total.append(len(raw))
            removed.append(len(raw) - len(kept))
            runs.append(len(spans))
            marks.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept_text(raw, spans))
            spans_out.append([{"start": a, "end": b} for a, b in spans])
        out = [batch.column("__id"), *(pa.array(c, pa.int64()) for c in (total, removed, runs)), pa.array(marks), pa.array(texts, pa.string())]
        if with_spans:
            out.append(pa.array(spans_out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
        return pa.RecordBatch.from_arrays(out, names)

    made = map_batches(_with_ranges(rows, "__id", length, window, group_rows), run, schema + ", spans array<struct<start:int,end:int>>" * with_spans)
    return made.withColumnRenamed("__id", id_col)


def stripped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, length: int = LENGTH, window: int = WINDOW, min_words: int = 0) -> DataFrame:
    """All rows and columns, each text without its repeated strings (at whole characters); length_col gets its new number of characters.

    min_words: maximal repeated runs with fewer words, counting those that the run cuts into, stay.
    """
    carried = Carried(df, text_col)
    names = carried.names

    def kept(raw: bytes, found: list[dict] | None) -> str:
        return kept_text(raw, [(a, b) for a, b in spans_of(found, length) if not min_words or len(raw[a:b].split()) >= min_words])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if raw is None else kept(raw, found) for raw, found in zip(utf8(batch, "__text"), batch.column("ranges").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-1]), pa.array(texts, pa.string())], names)

    made = carried.restore(map_batches(_with_ranges(carried.df, carried.of(id_col), length, window, GROUP_ROWS), run, carried.schema))
    return made.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType)) if length_col in df.columns else made


def _with_ranges(rows: DataFrame, id_col: str, length: int, window: int, group_rows: int) -> DataFrame:
    """rows (with __text) and the list of ranges of their repeated starts; texts without any aren't moved."""
    prepare(rows.sparkSession)
    # Rows are keyed by id and checksum of the text; null ids are keyed below all others.
    text = F.coalesce(F.col("__text"), F.lit(""))
    keyed = rows.select("*", F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("__row"), F.xxhash64(text).alias("__tag"))
    ranges = repeated_ranges(keyed.select(F.col("__row").alias("row"), F.col("__tag").alias("tag"), text.alias("__text")), length, window, group_rows)
    listed = ranges.groupBy(F.col("row").alias("__row"), F.col("tag").alias("__tag")).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    listed = materialize(listed, "ranges")
    probed = with_filter(keyed, key_filter(listed, "__row", "__tag"), "__row", "__tag")
    unmoved = probed.filter("NOT __may").withColumn("ranges", F.lit(None).cast(listed.schema["ranges"].dataType))
    moved = probed.filter("__may").join(listed.hint("merge"), ["__row", "__tag"], "left")
    return unmoved.unionByName(moved).drop("__row", "__tag", "__may")


def spans_of(ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    return merged([(r["first"], r["last"] + length) for r in ranges or []])


def kept_text(raw: bytes, spans: list[tuple[int, int]]) -> str:
    return without(raw, [whole_characters(raw, a, b) for a, b in spans]).decode()


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching [start, end) ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of [a, b) that ends and begins at UTF-8 characters."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b
