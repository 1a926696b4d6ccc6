"""Near-duplicates by an LSH forest over MinHash signatures, every link confirmed on full shingle sets.

1. A narrow pass gives each text its number of shingles, a fingerprint of its words and a signature.
   Texts of equal words form a class; only its smallest id goes on, so copies are never paired.
2. The forest: each tree is one sorted order of the representatives by DEPTH signature values.
   The length of the common prefix of every two neighbours is computed; from MIN_DEPTH values on they are
   candidates, and the length is kept with the link. Orders are range-partitioned, so a dense region is
   spread over tasks like any other.
3. Candidate links give regions (components at depth MIN_DEPTH). In a region all pairs are confirmed exactly, save
   those already known to be connected. A region above a size bound adapts its depth: its members are
   grouped by components of deeper links, one value deeper as long as a group is too large, which brings close texts together in
   blocks. Links within blocks come first, then links between the blocks' components. Whatever is not in the largest
   component then meets the blocks of texts whose sizes allow the similarity. No pair of a region is dropped.
4. Components of the confirmed links give each text its smallest reachable id.

Texts without words (null, empty, white space) have no shingles and link with nothing. Null ids
stand for themselves alone. Repeated rows and copies share one component. An empty table is empty. Ids are cast
to bigint (a string that isn't a number raises).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsieve.llm.bpe import _Memo
from colsieve.llm.common import held_over, key_filter, map_arrow, map_batches, prepare, quoted, utf8, with_filter
from colsieve.llm.components import connected_components
from colsieve.session import materialize

WIDTH, PERCENT = 5, 75
#: Trees, signature values of each tree's own, values that an order is sorted by (the last ones are the next tree's first), and the least common prefix of a candidate.
TREES, OWN, DEPTH, MIN_DEPTH = 20, 6, 8, 4
#: A region with more members or shingles (32 MB) than this is worked on in blocks of about half of it.
REGION_ROWS, REGION_SHINGLES = 2_000, 4_000_000

_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_MULTIPLIERS = (np.random.default_rng(7).integers(0, 1 << 31, TREES * OWN, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    memo = held_over("word hashes", lambda: _Memo(xxhash.xxh3_64_intdigest))
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _POWERS[4]
    h = (h ^ (h >> np.uint64(29))) * _POWERS[1]
    return h ^ (h >> np.uint64(32))


def shingle_set(raw: bytes | None) -> tuple[np.ndarray, bytes]:
    """Sorted distinct 64-bit shingle hashes of a text, and a fingerprint of its word sequence (empty without words)."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64), b""
    h = word_hashes(words)
    mark = xxhash.xxh3_128_digest(h.tobytes())
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=1)], np.uint64), mark
    n = len(words) - WIDTH + 1
    total = h[:n] * _POWERS[0]
    for k in range(1, WIDTH):
        total += h[k : k + n] * _POWERS[k]
    return np.unique(_mix(total)), mark


def signature(shingles: np.ndarray) -> bytes:
    """TREES * OWN MinHash values, of which the low 16 bits are kept: equal minima stay equal, others agree by chance in 1 of 65,536."""
    low = shingles.astype(np.uint32)[:, None]
    least = np.full(len(_MULTIPLIERS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, (low[at : at + 2048] * _MULTIPLIERS).min(axis=0), out=least)
    return least.astype(np.uint16).tobytes()


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, marks, signatures = [], [], []
        for raw in utf8(batch, "__text"):
            s, mark = shingle_set(raw)
            n.append(len(s))
            marks.append(mark if len(s) else None)
            signatures.append(signature(s) if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(signatures, pa.binary())], ["id", "n", "mark", "sig"])

    id_type = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__text")), run, f"id {id_type}, n bigint, mark binary, sig binary")


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading values that rows of a and b have in common."""
    return np.logical_and.accumulate(a == b, axis=1).sum(axis=1)


def forest_links(reps: DataFrame) -> DataFrame:
    """Candidate links (a, b, depth): neighbours of a tree's sorted order with a common prefix of at least MIN_DEPTH values.

    depth is the longest such prefix over all trees. Neighbours on both sides of a partition's edge are linked, too.
    """
    order = F.expr(f"substring(concat(sig, substring(sig, 1, {2 * (DEPTH - OWN)})), tree * {2 * OWN} + 1, {2 * DEPTH})").alias("key")
    rows = reps.select("id", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig").select("id", "tree", order)
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    names = ["a", "b", "depth", "tree", "key"]

    def edge(tree: int, key: np.ndarray, member: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([member]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([tree], pa.int32()), pa.array([key.tobytes()])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, trees = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "tree"))
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint16).reshape(-1, DEPTH)
            if held is None:
                yield edge(int(trees[0]), keys[0], int(ids[0]))
            else:
                ids, trees, keys = (np.concatenate([x, y]) for x, y in zip(held, (ids, trees, keys), strict=True))
            depth = common_prefix(keys[:-1], keys[1:]) * (trees[:-1] == trees[1:])
            near = np.flatnonzero(depth >= MIN_DEPTH)
            if len(near):
                yield pa.RecordBatch.from_arrays([pa.array(ids[near]), pa.array(ids[near + 1]), pa.array(depth[near].astype(np.int32)), pa.nulls(len(near), pa.int32()), pa.nulls(len(near), pa.binary())], names)
            held = ids[-1:], trees[-1:], keys[-1:]
        if held is not None:
            yield edge(int(held[1][0]), held[2][0], int(held[0][0]))

    found = materialize(map_arrow(ordered, run, "a bigint, b bigint, depth int, tree int, key binary"), "forest")
    return materialize(found.filter("tree IS NULL").select("a", "b", "depth").unionAll(_seams(found)).groupBy("a", "b").agg(F.max("depth").alias("depth")), "candidates")


def _seams(found: DataFrame) -> DataFrame:
    """Links of the last member of each partition with the first one of the next; there are two rows for each partition."""
    following = Window.orderBy("tree", "key", "a")
    seams = found.filter("tree IS NOT NULL").select("tree", "key", "a", *(F.lead(c).over(following).alias(f"next_{c}") for c in ("tree", "key", "a")))
    depth = F.lit(0)
    for d in range(MIN_DEPTH, DEPTH + 1):
        depth = F.when(F.expr(f"substring(key, 1, {2 * d}) = substring(next_key, 1, {2 * d})"), F.lit(d)).otherwise(depth)
    return seams.filter("tree = next_tree AND a <> next_a").select("a", F.col("next_a").alias("b"), depth.alias("depth")).filter("depth > 0")


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, column, weight of each column) of a group's sets: shingles that the same members hold are one column, those of one member none."""
    order = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    at = np.argsort(order, kind="stable")
    order, owner = order[at], owner[at]
    start = np.flatnonzero(np.diff(order, prepend=~order[:1]) != 0) if len(order) else np.zeros(0, np.int64)
    held = np.diff(np.append(start, len(order)))
    marks = np.random.default_rng(0).integers(0, 1 << 63, (2, len(sets)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        kinds = np.stack([np.add.reduceat(m[owner], start) for m in marks], axis=1) if len(start) else np.zeros((0, 2), np.uint64)
    start, held, kinds = start[held > 1], held[held > 1], kinds[held > 1]
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)
    _, first, weight = np.unique(kinds.view("V16").ravel(), return_index=True, return_counts=True)
    sizes = held[first]
    pick = np.repeat(start[first] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return owner[pick], np.repeat(np.arange(len(first)), sizes), weight.astype(float)


def _links(ids: list[int], sets: list[np.ndarray], split: int | None = None, known: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Links (by position) that connect what similarity connects; pairs already connected are skipped.

    With split, only pairs of one member before and one from split on are tried. known: labels of members connected already.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    label = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    owner, column, weight = _postings(sets)
    entry = weight[column]
    by_owner = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[by_owner], np.arange(n + 1))
    has = np.zeros(len(weight), bool)
    a, b = [], []
    for i in range(n if split is None else split):
        lo = i + 1 if split is None else split
        open_ = np.flatnonzero((label[lo:] != label[i]) & (100 * np.minimum(size[lo:], size[i]) >= PERCENT * np.maximum(size[lo:], size[i]))) + lo
        if not len(open_):
            continue
        own = column[by_owner[ends[i] : ends[i + 1]]]
        has[own] = True
        if len(open_) < 0.5 * n:
            wanted = np.concatenate([by_owner[ends[j] : ends[j + 1]] for j in open_.tolist()])
            wanted = wanted[has[column[wanted]]]
        else:
            wanted = np.flatnonzero(has[column])
        has[own] = False
        common = np.bincount(owner[wanted], entry[wanted], minlength=n)
        for j in open_[100 * common[open_] >= PERCENT * (size[open_] + size[i] - common[open_])]:
            if label[j] != label[i]:
                a.append(i)
                b.append(int(j))
                label[label == label[j]] = label[i]
    return a, b


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray], list[bool], list[int]]]:
    """Members of one group at a time, from rows sorted by (region, block)."""
    key, ids, sets, old, known = None, [], [], [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("region", "block", "id", "shingles", "old", "known")]
        for region, block, i, raw, o, k in zip(*columns, strict=True):
            if (region, block) != key:
                if len(ids) > 1:
                    yield ids, sets, old, known
                key, ids, sets, old, known = (region, block), [], [], [], []
            ids.append(i)
            sets.append(np.frombuffer(raw, np.uint64))
            old.append(o)
            known.append(k)
    if len(ids) > 1:
        yield ids, sets, old, known


def _confirm(rows: DataFrame, bipartite: bool = False) -> DataFrame:
    """Confirmed links (a, b) within each (region, block) of rows (region, block, id, shingles, old, known)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, old, known in _runs(batches):
            split = None
            if bipartite:
                order = sorted(range(len(ids)), key=lambda k: not old[k])
                ids, sets, known = [ids[k] for k in order], [sets[k] for k in order], [known[k] for k in order]
                split = sum(old)
                of: dict[int, int] = {}
                known = [len(ids) + at if k is None else of.setdefault(k, len(of)) for at, k in enumerate(known)]  # null: connected to nothing yet
            a, b = _links(ids, sets, split, known if bipartite else None)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in a], pa.int64()), pa.array([ids[k] for k in b], pa.int64())], ["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(rows.repartition(n, "region", "block").sortWithinPartitions("region", "block", "old", "id"), run, "a bigint, b bigint")


def _place(large: DataFrame, links: DataFrame) -> DataFrame:
    """The block of each member (id, mark, n, region, blocks) of a large region.

    Members that deeper links join share a block, one value deeper as long as a group is above a block's size; a group that
    is still too large at the last depth, and members that no deeper link joins, are spread by id, so no block is unbounded.
    """
    open_, placed = large.withColumn("part", F.col("region")), []
    inner = materialize(links.join(large.select(F.col("id").alias("a")).distinct(), "a"), "inner")
    for depth in range(MIN_DEPTH + 1, DEPTH + 1):
        parts = connected_components(inner.filter(F.col("depth") >= depth)).withColumnRenamed("node", "id")
        named = materialize(open_.drop("part").join(parts, "id", "left").withColumn("part", F.coalesce("root", "id")).drop("root"), "parts")
        counts = materialize(named.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")), "counts")
        sized = named.join(counts, "part").withColumn("fits", F.expr(f"rows <= {REGION_ROWS // 2} AND (shingles <= {REGION_SHINGLES // 2} OR rows = 1)"))
        placed.append(sized.filter("fits").select("id", "mark", "region", "blocks", F.xxhash64("part").alias("h")))
        open_ = materialize(sized.filter("NOT fits").select(*large.columns, "part"), "too-large")
        if open_.isEmpty():
            break
    placed.append(open_.select("id", "mark", "region", "blocks", F.xxhash64("id").alias("h")))
    return functools.reduce(DataFrame.unionAll, placed).select("id", "mark", "region", "blocks", F.expr("cast(pmod(h, blocks) as int)").alias("block"))


def _sets_of(df: DataFrame, id_col: str, text_col: str, placed: DataFrame) -> DataFrame:
    """(id, region, blocks, block, n, shingles) of each placed class; only texts that may be placed are moved."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(raw) for raw in utf8(batch, "__text")]
        own = pa.array([mark == m for (_, mark), m in zip(found, batch.column("mark").to_pylist(), strict=True)])  # else another text under the same id
        out = [*(batch.column(c) for c in ("id", "region", "blocks", "block")), pa.array([len(s) for s, _ in found], pa.int64()), pa.array([s.tobytes() for s, _ in found], pa.binary())]
        return pa.RecordBatch.from_arrays(out, ["id", "region", "blocks", "block", "n", "shingles"]).filter(own)

    texts = df.select(quoted(id_col).cast("bigint").alias("id"), quoted(text_col).cast("string").alias("__text"))
    likely = with_filter(texts, key_filter(placed, "id"), "id").filter("__may").drop("__may")
    joined = likely.join(placed.hint("merge"), "id")  # one plan at every size: members grow with the corpus
    return materialize(map_batches(joined, run, "id bigint, region bigint, blocks int, block int, n bigint, shingles binary"), "sets")


def confirmed_links(df: DataFrame, id_col: str, text_col: str, reps: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links between representatives that hold on full sets and connect all that such links connect."""
    regions = connected_components(candidates)
    members = materialize(reps.select("id", "n", "mark").join(regions.withColumnRenamed("node", "id").withColumnRenamed("root", "region"), "id"), "members")
    # Sizes by region are written before they are joined: both sides of the join are plain exchanges then, whose skewed parts Spark splits.
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("rows") * 2 / REGION_ROWS), F.ceil(F.col("shingles") * 2 / REGION_SHINGLES)).cast("int")
    wide = materialize(sizes.select("region", blocks.alias("blocks")).filter("blocks > 2"), "wide")
    placed = members.join(wide, "region", "left_anti").select("id", "mark", "region", F.lit(1).alias("blocks"), F.lit(0).alias("block"))
    any_large = not wide.isEmpty()
    if any_large:
        large = materialize(members.join(wide, "region").select("id", "mark", "n", "region", "blocks"), "large")
        placed = placed.unionByName(_place(large, candidates))
    sets = _sets_of(df, id_col, text_col, materialize(placed, "placed"))
    row = [F.lit(False).alias("old"), F.lit(0).cast("bigint").alias("known")]
    links = materialize(_confirm(sets.select("region", "block", "id", "shingles", *row)), "links")
    return _across_blocks(sets.filter("blocks > 1"), links, row) if any_large else links


def _across_blocks(large: DataFrame, links: DataFrame, row: list[Column]) -> DataFrame:
    """links and those between blocks of large regions. Sets move only by id or by (region, block), so no task receives a region; what is joined by region is narrow."""
    places = materialize(large.select("id", "region", "blocks", "n"), "places")

    def rooted() -> DataFrame:
        labels = connected_components(links).withColumnRenamed("node", "id")
        return materialize(places.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")

    def with_sets(rows: DataFrame) -> DataFrame:
        likely = with_filter(large.select("id", "shingles"), key_filter(rows, "id"), "id").filter("__may").drop("__may")
        return rows.join(likely, "id")

    # One member of each block's components stands for it, and these are linked first.
    heads = materialize(rooted().filter("id = root").select("region", F.expr("cast(pmod(xxhash64(id), greatest(1, blocks div 8)) as int)").alias("block"), "id"), "heads")
    links = materialize(links.unionAll(_confirm(with_sets(heads).select("region", "block", "id", "shingles", *row))), "links")
    named = rooted()
    sizes = materialize(named.groupBy("region", "root").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    largest = materialize(sizes.groupBy("region").agg(F.max_by("root", F.struct("rows", "root")).alias("main")), "largest")
    rest = materialize(named.join(largest, "region").filter("root <> main").drop("main"), "rest")
    if rest.isEmpty():
        return links
    # The rest meets every member of its region whose size allows the similarity: sizes are cut into classes by a factor of
    # 4/3, so only the classes beside a member's own can hold a partner. A class is met in tiles of bounded size.
    kind = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / PERCENT))).cast("int").alias("kind")
    tiles = materialize(places.select("region", "n", kind).groupBy("region", "kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).select(
        "region", "kind", F.greatest(F.ceil(F.col("rows") * 2 / REGION_ROWS), F.ceil(F.col("shingles") * 2 / REGION_SHINGLES)).cast("int").alias("tiles")
    ), "tiles")
    asking = materialize(rest.select("region", kind).groupBy("region", "kind").agg(F.count(F.lit(1)).alias("rows")).join(tiles, ["region", "kind"]).select("region", F.col("kind").alias("own"), F.col("tiles").alias("slices")), "asking")
    pairs = asking.select("*", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("kind")).join(tiles, ["region", "kind"])
    cell = F.xxhash64("own", "slice", "kind", "tile").alias("block")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = with_sets(materialize(rest.select("region", "id", F.col("root").alias("known"), kind.alias("own")), "asked"))
    left = left.join(pairs, ["region", "own"]).withColumn("slice", F.expr("cast(pmod(xxhash64(id, 1), slices) as int)")).withColumn("tile", each("tiles"))
    right = large.select("region", "id", "shingles", kind).join(pairs, ["region", "kind"]).withColumn("tile", F.expr("cast(pmod(xxhash64(id, 2), tiles) as int)")).withColumn("slice", each("slices"))
    meet = left.select("region", cell, "id", "shingles", F.lit(True).alias("old"), "known").unionAll(right.select("region", cell, "id", "shingles", F.lit(False).alias("old"), F.lit(None).cast("bigint").alias("known")))
    return materialize(links.unionAll(_confirm(meet, bipartite=True)), "links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    prepare(df.sparkSession)
    made = materialize(sketches(df, id_col, text_col), "sketches")
    usable = made.filter("mark IS NOT NULL AND id IS NOT NULL")
    classes = materialize(usable.groupBy("mark").agg(F.min("id").cast("bigint").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "classes")
    links = confirmed_links(df, id_col, text_col, classes, forest_links(classes.select("id", "sig")))
    roots = connected_components(links)
    of_class = classes.select("mark", F.col("id").alias("rep"), "copies").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("mark", F.coalesce("root", "rep").alias("root"), "rep", "copies").filter("copies > 1 OR root <> rep").select("mark", "root")
    id_type = df.schema[id_col].dataType.simpleString()
    of_class = materialize(of_class, "of-class")
    return made.select("id", "n", "mark").join(of_class, "mark", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.col("root").cast(id_type), F.col("id")).alias("component_id"), F.coalesce(F.coalesce(F.col("root").cast(id_type), F.col("id")) == F.col("id"), F.lit(True)).alias("kept")
    )


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id. Of rows that repeat an id and its text one stays."""
    found = materialize(near_duplicates(df, id_col, text_col).select(F.col(id_col).alias("__id"), "kept", "n_shingles"), "near")
    dropped = materialize(found.filter("NOT kept").select("__id").distinct(), "dropped")
    keyed = with_filter(df.withColumn("__id", quoted(id_col)), key_filter(dropped, "__id"), "__id")
    kept = keyed.filter("NOT __may").unionByName(keyed.filter("__may").join(dropped.hint("merge"), "__id", "left_anti")).drop("__may", "__id")
    repeated = found.filter("n_shingles > 0 AND __id IS NOT NULL").groupBy("__id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates([id_col, text_col])
